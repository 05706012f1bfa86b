"""Command line: ``python -m readtrim.cli trim|simulate|randtrim|readstat|plot|truth|evaluate|times|replicates ...``."""

from __future__ import annotations

import argparse
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dedup, detect, simulate, stats
from .plans.options import TrimOptions
from .plans.pipeline import Pipeline
from .plans.store import materialize, new_path as materialized_path
from .sources import fastq

#: Flags that switch something off, by option.
_OFF = {"adapter_trim": "no-adapter-trim", "consensus": "no-consensus", "quality_trim": "no-quality-trim", "tail_n_trim": "no-tail-n-trim", "length_filtration": "no-length-filtration"}
_SHORT = {
    "order": "-O", "adapter1": "-a", "adapter2": "-A", "kmer_tolerance": "-T", "pe_adapter_diff": "-d", "r1_r2_diff": "-D", "kmer_n_match": "-s",
    "tail_length": "-l", "max_n": "-n", "clip3_r1": "-z", "clip3_r2": "-Z", "clip_after_r1": "-b", "clip_after_r2": "-B", "clip5_r1": "-e", "clip5_r2": "-E",
    "quality_score": "-q",
}
#: Options of older versions: what to say about them.
_GONE = {"clip_after": "--clip-after is gone: use --clip-after-r1 and --clip-after-r2", "clip5": "--clip5 is gone: use --clip5-r1 and --clip5-r2"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readtrim", description=__doc__)
    sub = top.add_subparsers(dest="program", required=True)
    trim = sub.add_parser("trim", help="trim and filter reads, or detect adapters")
    trim.add_argument("-r", "--read1", nargs="+", required=True)
    trim.add_argument("-R", "--read2", nargs="*", default=[])
    trim.add_argument("-o", "--output-dir", default=".")
    trim.add_argument("-g", "--compress", default="AUTO")
    trim.add_argument("-f", "--force", action="store_true")
    trim.add_argument("--detect-adapter", action="store_true")
    trim.add_argument("-t", "--threads", type=int, help="cores of a local session (a cluster's master decides otherwise)")
    trim.add_argument("--log2-chunk-size", type=int, default=26, help="bytes of an input split, as a power of two (20 to 30)")
    trim.add_argument("--stats", action="store_true", help="accepted, without effect")
    trim.add_argument("-p", "--procs", type=int, default=4, help="samples at work at the same time")
    trim.add_argument("--single-files", action="store_true", help="good reads as one file per mate instead of a folder of parts")
    trim.add_argument("-C", "--clip-after", type=int, default=0, help=argparse.SUPPRESS)
    trim.add_argument("-c", "--clip5", type=int, default=0, help=argparse.SUPPRESS)
    trim.add_argument("--collisions", action="store_true", help="with PCR dedup: list short keys that different sequences share")
    for f in fields(TrimOptions):
        if f.name in _OFF:
            trim.add_argument(f"--{_OFF[f.name]}", dest=f.name, action="store_false")
            continue
        flags = [*([_SHORT[f.name]] if f.name in _SHORT else []), "--enable-complexity-filtration" if f.name == "complexity_filtration" else "--" + f.name.replace("_", "-")]
        if isinstance(f.default, bool):
            trim.add_argument(*flags, dest=f.name, action="store_true")
        elif isinstance(f.default, tuple):
            trim.add_argument(*flags, dest=f.name, nargs="+", default=list(f.default))
        else:
            trim.add_argument(*flags, dest=f.name, type=type(f.default), default=f.default)
    sim = sub.add_parser("simulate", help="read pairs with known truth")
    sim.add_argument("-o", "--prefix", required=True)
    sim.add_argument("-i", "--insert-sizes", "--insert-size-range", nargs="+", type=int, default=list(range(66, 121, 2)))
    sim.add_argument("-x", "--repeat", type=int, default=30_000)
    sim.add_argument("-s", "--seq-length", type=int, default=100)
    sim.add_argument("-a", "--adapter1", default=simulate.ADAPTER1)
    sim.add_argument("-A", "--adapter2", default=simulate.ADAPTER2)
    for name, flag, default in (("substitution", "-S", simulate.RATES), ("insertion", "-I", simulate.INDELS), ("deletion", "-D", simulate.INDELS)):
        sim.add_argument(flag, f"--{name}-rate", dest=name, nargs="+", type=float, default=list(default))
    sim.add_argument("--seed", type=int, default=0)
    rnd = sub.add_parser("randtrim", help="cut one mate of each pair to a random length")
    rnd.add_argument("files", nargs="+", help="R1 R2 [R1 R2 ...]")
    rnd.add_argument("--seed", type=int, default=0)
    stat = sub.add_parser("readstat", help="score trimmed simulated reads")
    stat.add_argument("files", nargs="+", help="R1 R2 [R1 R2 ...]")
    plot = sub.add_parser("plot", help="plot tables of readstat summaries")
    plot.add_argument("files", nargs="+")
    plot.add_argument("-o", "--output-dir", default=".")
    truth = sub.add_parser("truth", help="lengths of simulated reads from alignment files")
    truth.add_argument("files", nargs="+")
    truth.add_argument("-o", "--output", required=True)
    ev = sub.add_parser("evaluate", help="confusion matrix of trimmed lengths against true ones")
    ev.add_argument("truth", help="table of id and length, without header")
    ev.add_argument("read1")
    ev.add_argument("--full-length", type=int, default=100)
    times = sub.add_parser("times", help="speed table of GNU time logs (one command and its log lines per row, tab separated)")
    times.add_argument("file")
    times.add_argument("--bases", type=int, default=1)
    rep = sub.add_parser("replicates", help="mean and deviation of each cell of files of the same form")
    rep.add_argument("files", nargs="+")
    return top


def options_of(args: argparse.Namespace) -> TrimOptions:
    value = lambda v: tuple(v) if isinstance(v, list) else v
    return TrimOptions(**{f.name: value(getattr(args, f.name)) for f in fields(TrimOptions)})


def _tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def trim_sample(spark: SparkSession, args: argparse.Namespace, file1: str, file2: str | None, options: TrimOptions) -> dict | None:
    """Trim one sample; its report, or None if it was done before."""
    out, name = args.output_dir.rstrip("/"), fastq.sample_name(file1)
    report_path = f"{out}/{name}.trimmed.log.json"
    if not args.force and fastq.completed(spark, report_path):
        print(f"skip completed: {report_path} (--force to do it again)")
        return None
    began = time.time()
    reads = fastq.read_pairs(spark, file1, file2) if file2 else fastq.read_single(spark, file1)
    chain = Pipeline(options, paired=file2 is not None)
    trimmed = materialize(chain.apply(reads), "trimmed")  # read by the writers of both mates and by the report
    good = chain.good(trimmed)
    files = {}
    for m, f in enumerate([file1, file2] if file2 else [file1], 1):
        files[f"good-read{m}"] = f"{out}/{fastq.output_name(f, args.compress)}"
        target = files[f"good-read{m}"]
        folder = materialized_path(spark, "parts") if args.single_files else target
        fastq.write_fastq(good, folder, m, fastq.codec(f, args.compress))
        if args.single_files:
            fastq.join_parts(spark, folder, target)
    figures = chain.report(trimmed.drop("sample")).first().asDict()
    if options.pcr_dedup:
        alive = trimmed.where(F.col("drop_reason").isNull() | (F.col("drop_reason") == "PCRDedup"))
        totals = dedup.totals(alive).first()
        figures["pcr_dedup_in_groups"] = totals.in_groups
        if options.pcr_dedup_count:
            _tsv(dedup.counts(alive.drop("sample")).select("count", "id"), f"{out}/{name}.trimmed.pcr_dedup_count.tsv")
        if args.collisions and file2:
            key = F.concat_ws("/", dedup.lossy_key(F.col("seq1")), dedup.lossy_key(F.col("seq2")))
            found = dedup.collisions(alive.drop("sample"), key)
            found.write.mode("overwrite").json(f"{out}/{name}.trimmed.pcr_hash_collision.json")
    kind = "read-pairs" if file2 else "reads"
    report = {
        "arguments": options.as_dict(),
        "version": {"spark-version": spark.version},
        "input-files": {f"input-read{m}": f for m, f in enumerate([file1, file2] if file2 else [file1], 1)},
        "output-files": files | {"json-log": report_path},
        "runtime": {"seconds": round(time.time() - began, 3)},
        "trimming-details": {f"good-{kind}": figures["good"], f"total-{kind}": figures["total"]},
    }
    if file2:
        report["order"] = list(options.order)
    for m in chain.mates:
        key = f"stats-r{m}" if file2 else "stats"
        report[key] = {c[:-3]: v for c, v in figures.items() if c.endswith(f"_r{m}")}
    if "pcr_dedup_in_groups" in figures:
        report["pcr-dedup-in-groups"] = figures["pcr_dedup_in_groups"]
    fastq.write_json(spark, report_path, report)
    return report


def detect_adapters(spark: SparkSession, args: argparse.Namespace, options: TrimOptions) -> DataFrame:
    """Paired: a summary row per pair of files. Single: the five best known adapters of each file, none where too few reads have one."""
    if args.read2:
        pairs = fastq.read_pairs(spark, args.read1, args.read2, detect.SAMPLE_READS)
        found = detect.detect_pairs(pairs, options.kmer_tolerance + 1)
        files = spark.createDataFrame([(fastq.sample_name(a), a, b) for a, b in zip(args.read1, args.read2, strict=True)], "sample string, r1 string, r2 string")
        return detect.summary(found, files)
    out = None
    for f in args.read1:  # one table of five rows per file
        reads = materialize(fastq.read_single(spark, f, first_reads=detect.SAMPLE_READS), "head")
        counts = materialize(detect.count_known(reads), "known")
        top = detect.top_known(counts).withColumn("file", F.lit(f))
        if detect.found_known(counts, reads.count()).isEmpty():
            print(f"no adapter detected: {f}")
            top = top.where("false")
        out = top if out is None else out.unionByName(top)
    return out


def _pairs_of(files: list[str]) -> list[tuple[str, str]]:
    if len(files) % 2:
        raise SystemExit("files must come in pairs: R1 R2 [R1 R2 ...]")
    return list(zip(files[::2], files[1::2], strict=True))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("readtrim")
    if getattr(args, "threads", None):
        builder = builder.master(f"local[{args.threads}]")
    spark = builder.getOrCreate()
    if args.program == "trim":
        try:
            gone = [text for name, text in _GONE.items() if getattr(args, name)]
            if gone:
                raise ValueError("; ".join(gone))
            if not 20 <= args.log2_chunk_size <= 30:
                raise ValueError("--log2-chunk-size must be 20 to 30")
            if args.procs < 1:
                raise ValueError("--procs must be at least 1")
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << args.log2_chunk_size))
            options = options_of(args)
            if args.read2 and len(args.read1) != len(args.read2):
                raise ValueError("as many files of mate 2 as of mate 1 are needed")
            Pipeline(options, bool(args.read2))
        except ValueError as e:
            print(f"readtrim: {e}")
            return 3
        if args.detect_adapter:
            found = materialize(detect_adapters(spark, args, options), "detected")
            found.show(truncate=False)
            if args.read2:
                _tsv(found, f"{args.output_dir.rstrip('/')}/adapter_detection.{time.strftime('%Y%m%d-%H%M%S')}.tsv")
            return 0
        with ThreadPoolExecutor(min(args.procs, len(args.read1))) as pool:  # samples are jobs of their own, side by side
            list(pool.map(lambda f, g: trim_sample(spark, args, f, g, options), args.read1, args.read2 or [None] * len(args.read1)))
    elif args.program == "simulate":
        pairs = materialize(simulate.simulate(
            spark, args.insert_sizes, args.repeat, args.seq_length, args.adapter1, args.adapter2, tuple(args.substitution), tuple(args.insertion), tuple(args.deletion), args.seed
        ), "simulated")
        for m in (1, 2):
            fastq.write_fastq(pairs, f"{args.prefix}.R{m}.fastq", m)
    elif args.program == "randtrim":
        for a, b in _pairs_of(args.files):
            cut = materialize(simulate.random_trim(fastq.read_pairs(spark, a, b), args.seed), "randtrim")
            for m, f in ((1, a), (2, b)):
                fastq.write_fastq(cut, f.removesuffix("/").removesuffix(".fastq") + ".randtrim.fastq", m)
    elif args.program == "readstat":
        for a, b in _pairs_of(args.files):
            both = fastq.interleave(fastq.read_pairs(spark, a, b)).withColumn("ord", 2 * F.col("idx") + F.col("mate") - 1)
            found = materialize(stats.detail(both.select("ord", "id", "seq")), "detail")
            base = f"{a.rstrip('/')}.r12"
            _tsv(found.orderBy("ord").drop("ord"), f"{base}.stat-detail.tsv")
            _tsv(stats.run_summary(found).orderBy("run").drop("run"), f"{base}.stat.tsv")
    elif args.program == "truth":
        fastq.read_aln_lengths(spark, args.files).write.mode("overwrite").option("sep", "\t").csv(args.output)
    elif args.program == "evaluate":
        truth = spark.read.schema("id string, length int").option("sep", "\t").csv(args.truth)
        reads = fastq.read_single(spark, args.read1, allow_empty=True)
        # the id in the table is the read's without @ and up to a slash
        trimmed = reads.select(F.regexp_extract("id1", "^@([^/]*)", 1).alias("id"), F.length("seq1").alias("trimmed_length"))
        stats.confusion(truth, trimmed, args.full_length).show(truncate=False)
    elif args.program == "times":
        rows = spark.read.text(args.file).select(F.split("value", "\t").alias("p"))
        stats.time_table(rows.select(F.col("p")[0].alias("command"), F.col("p").alias("lines")), args.bases).show(1000, truncate=False)
    elif args.program == "replicates":
        lines = stats.replicate_cells(stats.cells(spark, args.files)).groupBy("line").agg(F.sort_array(F.collect_list(F.struct("cell", "text"))).alias("c"))
        for r in lines.orderBy("line").select(F.array_join(F.transform("c", lambda x: x["text"]), "\t").alias("t")).toLocalIterator():
            print(r.t)
    else:
        tables = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(args.files)
        path = F.input_file_name()
        tables = tables.withColumn("file", F.regexp_extract(path, "([^/]+)/[^/]*$", 1)).withColumn("adapter_length", F.regexp_extract(path, "adapter_length_([0-9]+)", 1).try_cast("int"))
        tables = materialize(tables, "plot")
        for name, df in {
            "rates": stats.plot_rates(tables), "error_rate": stats.plot_accuracy(tables), "adapter_length": stats.plot_accuracy(tables, "adapter_length"),
            "deviation": stats.plot_deviation(tables),
        }.items():
            _tsv(df, f"{args.output_dir.rstrip('/')}/plot.{name}.tsv")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
