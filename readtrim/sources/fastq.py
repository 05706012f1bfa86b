"""FASTQ files as DataFrames with an explicit record index, and back.

Reading uses Spark's text source (plain files are split, ``.gz`` and ``.bz2`` decoded by extension, any store Spark can
open). The text is scanned once: its lines are packed into chunks, written with the file block they came from and their place
in it, so nothing depends on how Spark would split the files another time. A running sum over the few blocks of each file gives
every chunk the number of its first line. Chunks are cut where a group of records begins, and one exchange of those pieces
brings a group's text together, of both mates for pairs (they share sample and idx); lines become columns there, group by group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs
from ..plans.options import COMPRESSIONS
from ..plans.store import materialize

FIELDS = ("id", "seq", "des", "qual")
#: Bytes of text in a chunk of lines (a longer line is one of its own).
CHUNK = 1 << 16
#: Records that are put together at once, and the bytes they have on average: the lesser of both counts.
GROUP, GROUP_BYTES = 4096, 1 << 22
#: Row groups of the table of chunks, compressed: a reader holds one.
_ROW_GROUP = 1 << 24
#: Columns of a chunk; all its filled lines; columns of a piece of text.
_PLACED = ["part", "block", "at", "n", "size", *(f"filled{r}" for r in range(4))]
_FILLED = " + ".join(_PLACED[5:])
_PIECE = ["file", "sample", "group", "mate", "line", "text"]


def sample_name(path: str) -> str:
    """File name without folder and FASTQ suffixes.

    >>> sample_name("/a/x.R1.fastq.gz")
    'x.R1'
    """
    return re.sub(r"\.(fastq|fq)(\.gz|\.bz2)?$", "", path.rstrip("/").rsplit("/", 1)[-1], flags=re.I)


def output_name(path: str, compress: str = "AUTO", mark: str = "trimmed") -> str:
    """``x.fastq.gz`` to ``x.trimmed.fastq.gz``; the ending follows the compression.

    >>> output_name("d/x.fastq.gz"), output_name("x.fq", "BZ2"), output_name("x.fastq.gz", "NO")
    ('x.trimmed.fastq.gz', 'x.trimmed.fq.bz2', 'x.trimmed.fastq')
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = codec(path, compress)
    plain = re.sub(r"\.(gz|bz2)$", "", name, flags=re.I)
    stem, dot, ending = plain.rpartition(".")
    ending = f"{stem}.{mark}.{ending}" if dot else f"{plain}.{mark}"
    return ending + {"gzip": ".gz", "bzip2": ".bz2", "none": ""}[kind]


def codec(path: str, compress: str = "AUTO") -> str:
    """Spark's name of the output codec; AUTO follows the input file."""
    if compress.upper() not in COMPRESSIONS:
        raise ValueError(f"unknown compression {compress!r}; known: {', '.join(COMPRESSIONS)}")
    kind = COMPRESSIONS[compress.upper()]
    if kind == "auto":
        kind = "gzip" if re.search(r"\.gz$", path, re.I) else "bzip2" if re.search(r"\.bz2$", path, re.I) else "none"
    return kind


def _packed(text: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (part, block, value) of a task, as they come, to chunks: (part, block, at, n, size, filled0 to filled3[, text]).

    ``at`` is the place of the first line in the block, ``filled`` how many lines at places of that rest by 4 aren't empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for rb in batches:
            part, block, value = rb.columns
            rows = len(value)
            if not rows:
                continue
            size = pc.binary_length(value).to_numpy().astype(np.int64)
            cut = np.diff((np.cumsum(size) - size) // CHUNK) != 0
            cut |= np.diff(block.to_numpy()) != 0
            cut |= pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in range(9)]
            texts: list[pa.Array] = []
            edges = [0, *(np.flatnonzero(cut) + 1).tolist(), rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if here != (here := (part[lo].as_py(), block[lo].as_py())):
                    at = 0
                filled = np.bincount((at + np.flatnonzero(size[lo:hi])) % 4, minlength=4)
                for column, v in zip(out, (*here, at, hi - lo, int(size[lo:hi].sum()), *filled.tolist()), strict=True):
                    column.append(v)
                if text:
                    texts.append(pc.binary_join(pa.ListArray.from_arrays([0, hi - lo], value[lo:hi].cast(pa.string())), "\n"))
                at += hi - lo
            columns = [pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(texts)] if text else columns, names=[*_PLACED, "text"] if text else _PLACED)

    return run


def _scanned(spark: SparkSession, paths: list[str], text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, blocks) of text files, read once: see :func:`_packed`; per block its file, ``before`` (lines of the file in front of it), n, size, filled0 to filled3.

    Splits may differ from one scan to the next (they follow the cores at hand), so both come from one written table.
    """
    lines = spark.read.text(list(dict.fromkeys(paths))).select(
        F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    schema = "part string, " + ", ".join(f"{c} bigint" for c in _PLACED[1:]) + (", text string" if text else "")
    chunks = materialize(lines.mapInArrow(_packed(text), schema), "chunks", **{"parquet.block.size": _ROW_GROUP})
    blocks = chunks.groupBy("part", "block").agg(*[F.sum(c).alias(c) for c in ("n", "size", *_PLACED[5:])])
    before = F.sum("n").over(W.partitionBy("file").orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1))
    # one row per block: a few thousand for a terabyte
    blocks = blocks.withColumn("file", F.regexp_replace("part", "/part-[^/]*$", "")).withColumn("before", F.coalesce(before, F.lit(0)))
    return chunks, materialize(blocks, "blocks")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, value): every line with its number in its file, from 0.

    A folder of parts, as Spark writes it, counts as one file: its parts follow each other by name.
    """
    chunks, blocks = _scanned(spark, paths)
    placed = chunks.join(F.broadcast(blocks.select("part", "block", "file", "before")), ["part", "block"])
    lines = placed.select("file", (F.col("before") + F.col("at")).alias("first"), F.posexplode(F.split("text", "\n")).alias("k", "value"))
    return lines.select("file", (F.col("first") + F.col("k")).alias("line"), "value")


def _cut(lines: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks (file, sample, mate, line, n, text) cut at multiples of ``lines``: (file, sample, group, mate, line, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows, groups, firsts, texts = [], [], [], []
            for k, (line, n, text) in enumerate(zip(rb.column("line").to_pylist(), rb.column("n").to_pylist(), rb.column("text"), strict=True)):
                data, ends = memoryview(text.as_buffer()), None
                low, last = line, line + n
                while low < last:
                    high = min(last, (low // lines + 1) * lines)
                    if ends is None and high < last:
                        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                    begin = 0 if low == line else int(ends[low - line - 1]) + 1
                    end = len(data) if high == last else int(ends[high - line - 1])
                    rows.append(k)
                    groups.append(low // lines)
                    firsts.append(low)
                    texts.append(bytes(data[begin:end]))
                    low = high
            own = [rb.column(c).take(pa.array(rows, pa.int64())) for c in ("file", "sample", "mate")]
            text = pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array(groups, pa.int64()), own[2], pa.array(firsts, pa.int64()), text], names=_PIECE)

    return run


def _assembled(group: int, mates: tuple[int, ...]) -> Callable[[tuple, pa.Table], pa.Table]:
    """All pieces of one group of records to its records; fields that a mate's file doesn't reach are null."""

    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        lines = {}
        for m in mates:
            mine = pieces.filter(pc.equal(pieces["mate"], m)).sort_by("line")["text"].combine_chunks()
            lines[m] = pc.list_flatten(pc.split_pattern(mine, "\n"))
        rows = max(-(-len(v) // 4) for v in lines.values())
        columns = {"sample": pa.array([key[1].as_py()] * rows, pa.string()), "idx": pa.array(key[2].as_py() * group + np.arange(rows))}
        for m, have in lines.items():
            for k, f in enumerate(FIELDS):
                at = 4 * np.arange(rows) + k
                columns[f"{f}{m}"] = have.take(pa.array(at, mask=at >= len(have)))
            # blank lines behind the last record are none
            columns[f"id{m}"] = pc.if_else(pc.equal(columns[f"id{m}"], ""), None, columns[f"id{m}"])
        return pa.table(columns)

    return run


def _records(chunks: DataFrame, owned: DataFrame, mates: tuple[int, ...], first_reads: int | None) -> DataFrame:
    """(sample, idx, id, seq, des and qual of each mate). ``owned``: blocks with ``sample`` and ``mate``, once for each they serve."""
    widest = owned.groupBy("file").agg((F.sum("size") / F.sum("n")).alias("bytes")).agg(F.max("bytes")).first()[0] or 0
    group = int(max(1, min(GROUP, GROUP_BYTES // (4 * widest + 1))))
    starts = F.broadcast(owned.select("part", "block", "file", "sample", "mate", "before"))
    placed = chunks.join(starts, ["part", "block"]).select("file", "sample", "mate", (F.col("before") + F.col("at")).alias("line"), "n", "text")
    if first_reads is not None:
        placed = placed.where(F.col("line") < 4 * first_reads)
    pieces = placed.mapInArrow(_cut(4 * group), "file string, sample string, group bigint, mate int, line bigint, text string")
    if len(mates) > 1:  # mates lie in different files
        pieces = pieces.withColumn("file", F.lit(""))
    fields = ", ".join(f"{f}{m} string" for m in mates for f in FIELDS)
    rows = pieces.groupBy("file", "sample", "group").applyInArrow(_assembled(group, mates), f"sample string, idx bigint, {fields}")
    return rows if first_reads is None else rows.where(F.col("idx") < first_reads)


def _checked(df: DataFrame, mates: tuple[str, ...]) -> DataFrame:
    """Records with a wrong shape stop the job: no @, no +, or sequence and quality of different length."""
    for m in mates:
        i, s, d, q = (F.col(f"{f}{m}") for f in FIELDS)
        ok = i.startswith("@") & d.startswith("+") & (F.length(s) == F.length(q))
        bad = F.raise_error(F.concat(F.lit("broken FASTQ record: "), F.coalesce(i, F.lit("?")))).cast("string")
        df = df.withColumn(f"seq{m}", F.when(F.coalesce(ok, F.lit(False)), s).otherwise(bad))
    return df


def read_single(spark: SparkSession, paths: list[str] | str, allow_empty: bool = False, first_reads: int | None = None) -> DataFrame:
    """(sample, idx, id1, seq1, des1, qual1) of single-end files; an input without reads is an error.

    ``first_reads``: only that many of each file, told before lines are exchanged.
    """
    chunks, blocks = _scanned(spark, [paths] if isinstance(paths, str) else list(paths))
    if not allow_empty and not (blocks.agg(F.sum(F.expr(_FILLED))).first()[0] or 0):
        raise ValueError("empty input")
    owned = blocks.withColumns({"sample": _sample_of(F.col("file")), "mate": F.lit(1)})
    rows = _records(chunks, owned, (1,), first_reads)
    return _checked(rows.where("id1 is not null or seq1 <> ''"), ("1",))


def _sample_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)/?$", 1), r"(?i)\.(fastq|fq)(\.gz|\.bz2)?$", "")


def read_pairs(spark: SparkSession, paths1: list[str] | str, paths2: list[str] | str, first_reads: int | None = None) -> DataFrame:
    """(sample, idx, id1, seq1, des1, qual1, id2, seq2, des2, qual2); ``sample`` is named after mate 1's file.

    Files pair by position. A pair of files with different numbers of reads is paired as far as the shorter one goes
    (see :func:`unpaired`); if one of them has no reads at all that is an error. ``first_reads``: only that many of each file.
    """
    chunks, owned, files = _paired_blocks(spark, paths1, paths2)
    filled = files.join(owned, ["sample", "mate"], "left").groupBy("sample", "mate").agg(F.coalesce(F.sum(F.expr(_FILLED)), F.lit(0)).alias("filled"))
    mates = {(r["sample"], r["mate"]): r["filled"] for r in filled.collect()}  # two rows per sample
    samples = {s for s, _ in mates}
    if any((not mates.get((s, 1))) != (not mates.get((s, 2))) for s in samples):
        raise ValueError("one of the mates has no reads")
    rows = _records(chunks, owned, (1, 2), first_reads)
    return _checked(rows.where("id1 is not null and id2 is not null"), ("1", "2"))


def _paired_blocks(spark: SparkSession, paths1: list[str] | str, paths2: list[str] | str, text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, blocks by sample and mate, samples and mates), from one scan of all files."""
    paths1, paths2 = ([p] if isinstance(p, str) else list(p) for p in (paths1, paths2))
    if len(paths1) != len(paths2):
        raise ValueError("as many files of mate 2 as of mate 1 are needed")
    names = [sample_name(p) for p in paths1]
    if len(set(names)) < len(names):
        raise ValueError("files of mate 1 need different names")

    def whole(path: str) -> str:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()

    bare = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:")  # noqa: E731  file:/x and file:///x are the same
    # one row per input file; a file may serve several samples or mates
    pairs = [(whole(p), n, m) for m, paths in ((1, paths1), (2, paths2)) for p, n in zip(paths, names, strict=True)]
    files = spark.createDataFrame(pairs, "path string, sample string, mate int").select(bare(F.col("path")).alias("path"), "sample", "mate")
    chunks, blocks = _scanned(spark, [*paths1, *paths2], text)
    owned = blocks.withColumn("path", bare(F.col("file"))).join(F.broadcast(files), "path").drop("path")
    return chunks, owned, files.select("sample", "mate")


def unpaired(spark: SparkSession, paths1: list[str] | str, paths2: list[str] | str) -> DataFrame:
    """(sample, mate1, mate2, unpaired): how many reads each file has. Their lines are counted where they are scanned, none is kept."""
    _, owned, _ = _paired_blocks(spark, paths1, paths2, text=False)
    # the lines that begin a record are those at this rest in the block
    heads = F.element_at(F.array(*_PLACED[5:]), (F.pmod(-F.col("before"), F.lit(4)) + 1).cast("int"))
    has = lambda m: F.sum(F.when(F.col("mate") == m, heads).otherwise(0))
    return owned.groupBy("sample").agg(has(1).alias("mate1"), has(2).alias("mate2"), (F.abs(has(1) - has(2))).alias("unpaired"))


def interleave(pairs: DataFrame) -> DataFrame:
    """(sample, idx, mate, id, seq, des, qual): two rows per pair; mate 1 comes first in (idx, mate)."""
    own = [c for c in ("sample", "idx") if c in pairs.columns]
    mate = lambda m: F.struct(F.lit(m).alias("mate"), *[(F.col(f"{f}{m}") if f"{f}{m}" in pairs.columns else F.lit("+")).alias(f) for f in FIELDS])
    return pairs.select(*own, F.explode(F.array(mate(1), mate(2))).alias("__read")).select(*own, "__read.*")


def formatted(reads: DataFrame, mate: int = 1, ordered: bool = False) -> DataFrame:
    """(value): one record of four lines per row, in input order; ``ordered`` reads lie in it already and are not sorted again."""
    order = [] if ordered else [c for c in ("sample", "idx") if c in reads.columns]
    des = F.col(f"des{mate}") if f"des{mate}" in reads.columns else F.lit("+")
    value = exprs.format_record(F.col(f"id{mate}"), F.col(f"seq{mate}"), des, F.col(f"qual{mate}"))
    return (reads.orderBy(*order) if order else reads).select(value.alias("value"))


def write_fastq(reads: DataFrame, path: str, mate: int = 1, compression: str = "none") -> None:
    """A folder of text parts in input order (range partitioned by idx: parts concatenate to the whole file)."""
    formatted(reads, mate).write.mode("overwrite").option("compression", compression).text(path)


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The parts of ``folder`` as one file, in order, byte by byte (compressed parts stay valid one behind the other).

    The bytes pass through the driver in small buffers; on a cluster the folder itself is the faster form.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    parts = sorted(str(f.getPath()) for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in parts:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    finally:
        out.close()


def read_aln_lengths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, length) of the reads of a simulator's alignment files: the aligned read (third line of a record) without gaps."""
    lines = numbered_lines(spark, [path] if isinstance(path, str) else list(path))
    # record heads start with ">": chromosome, read id, position, strand; then the reference's and the read's alignment
    heads = lines.where(F.col("value").startswith(">")).select("file", (F.col("line") + 2).alias("line"), F.split("value", "\t")[1].alias("id"))
    return heads.join(lines, ["file", "line"]).select("id", F.length(F.regexp_replace("value", "-", "")).alias("length"))


def completed(spark: SparkSession, report_path: str) -> bool:
    """Whether a run's JSON report exists and holds something: then the sample is skipped unless forced."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(report_path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop) and fs.getContentSummary(hadoop).getLength() > 0)


def write_json(spark: SparkSession, path: str, report: dict) -> None:
    """A report as one JSON file with sorted keys."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hadoop, True)
    out.write(bytearray(json.dumps(report, indent=4, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
