"""Adapter detection: known adapters in single reads, unknown ones behind the overlap of mates.

Both take the first ``sample_reads`` reads of each sample (idx below the bound), as the feature asks for; no row count
beyond that depends on the input. Scans run map side and emit partial sums; a few rows per task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batch import CODE, Mate
from ..functions.kernels import infer_adapters, needle, scan
from ..sources.adapters import KNOWN_ADAPTERS

#: Reads of a sample that detection looks at; best share of reads below which there is no adapter.
SAMPLE_READS, LEAST_SHARE = 200_000, 0.0004


def _sampled(reads: DataFrame, sample_reads: int | None) -> DataFrame:
    return reads.where(F.col("idx") < sample_reads) if sample_reads is not None else reads


def count_known(reads: DataFrame, candidates: tuple[str, ...] = KNOWN_ADAPTERS, tolerance: int = 2, sample_reads: int | None = SAMPLE_READS) -> DataFrame:
    """(ord, adapter, count, identity): reads that hold each candidate, and the mean share of bases that fit (NaN without reads)."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, fit = np.zeros(len(candidates), np.int64), np.zeros(len(candidates), np.int64)
        for b in batches:
            m = Mate.of(b.column(0), b.column(1))
            for k, a in enumerate(candidates):
                hit = scan(needle(a), m.codes, m.n, 1, tolerance)
                found = hit.n >= 16 - tolerance
                n[k] += int(found.sum())
                fit[k] += int(hit.n[found].sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(candidates)), pa.int32()), pa.array(n), pa.array(fit)], names=["ord", "n", "fit"])

    adapters = F.element_at(F.array(*[F.lit(a) for a in candidates]), F.col("ord") + 1)
    seqs = _sampled(reads, sample_reads).select("seq1", F.lit("").alias("qual1"))
    return (
        seqs.mapInArrow(tally, "ord int, n long, fit long").groupBy("ord")
        .agg(F.sum("n").alias("count"), F.sum("fit").alias("fit"))
        .select("ord", adapters.alias("adapter"), "count", F.when(F.col("count") > 0, F.col("fit") / F.col("count") / 16).otherwise(F.lit(float("nan"))).alias("identity"))
    )


def top_known(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent candidates; ties in the order of the list."""
    return counts.orderBy(F.desc("count"), "ord").limit(k).drop("ord")


def found_known(counts: DataFrame, n_reads: int, least: float = LEAST_SHARE) -> DataFrame:
    """The best candidate, or no row if too few reads hold it."""
    return top_known(counts, 1).where(F.col("count") >= least * n_reads)


def candidates_behind_overlap(pairs: DataFrame, tolerance: int = 3) -> DataFrame:
    """(sample, mate, adapter, prob, start): what follows the overlap in each mate of good quality, at most 16 bases."""
    has_sample = "sample" in pairs.columns

    def infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r1, r2 = Mate.of(b.column(1), b.column(2)), Mate.of(b.column(3), b.column(4))
            if not len(r1):
                continue
            start, found = infer_adapters(r1, r2, tolerance)
            for mate, (letters, length, prob) in enumerate(found, 1):
                rows = np.flatnonzero((start >= 16) & (length > 0) & (prob > 0.75))
                text = [letters[i, : length[i]].tobytes().decode() for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array([mate] * len(rows), pa.int32()), pa.array(text, pa.string()), pa.array(prob[rows]), pa.array(start[rows])],
                    names=["sample", "mate", "adapter", "prob", "start"],
                )

    own = F.col("sample") if has_sample else F.lit("")
    return pairs.select(own.alias("sample"), "seq1", "qual1", "seq2", "qual2").mapInArrow(infer, "sample string, mate int, adapter string, prob double, start long")


def adapter_stats(candidates: DataFrame, n_reads: DataFrame) -> DataFrame:
    """(sample, mate, adapter, count, occurance, identity, adapter_start_position) before prefixes are merged."""
    return (
        candidates.groupBy("sample", "mate", "adapter")
        .agg(F.count("*").alias("count"), F.avg("prob").alias("identity"), F.avg("start").alias("adapter_start_position"))
        .join(n_reads, "sample")
        .select("sample", "mate", "adapter", "count", (F.col("count") / F.col("n_reads")).alias("occurance"), "identity", "adapter_start_position", "n_reads")
    )


def _starts(long: str, short: str) -> bool:
    """Whether ``long`` begins with ``short``; codes of ``short`` stand for all their bases."""
    return len(long) > len(short) and all(CODE[ord(a)] and CODE[ord(a)] & ~CODE[ord(b)] == 0 for a, b in zip(long, short, strict=False))


def merge_prefixes(rows: list[dict]) -> list[dict]:
    """Shares of adapters cut short go in equal parts to all longer ones that they begin, the shortest first."""
    rows = [dict(r) for r in rows]
    rows.sort(key=lambda r: (len(r["adapter"]), r["adapter"]))
    out = []
    by_head: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for k in range(1, len(r["adapter"])):
            by_head.setdefault(r["adapter"][:k], []).append(i)
    for i, r in enumerate(rows):
        short = r["adapter"]
        plain = set(short) <= set("ACGT")
        # plain prefixes by lookup; ambiguity codes are compared one by one
        longer = [] if len(short) >= 16 else [j for j in by_head.get(short, []) if j > i] if plain else [j for j in range(i + 1, len(rows)) if _starts(rows[j]["adapter"], short)]
        if not longer:
            out.append(r)
            continue
        share = r["occurance"] / len(longer)
        for j in longer:
            p = rows[j]
            total = p["occurance"] + share
            for c in ("identity", "adapter_start_position"):
                p[c] = (p[c] * p["occurance"] + r[c] * share) / total
            p["occurance"] = total
    return out


def merged(stats: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Per sample and mate: adapters after merging, frequent enough and at least 0.3 of the best, the best first (``rank``).

    A group is bounded by the reads that detection looks at, see SAMPLE_READS.
    """

    def merge(pdf):
        import pandas as pd

        n = int(pdf["n_reads"].iloc[0])
        rows = merge_prefixes(pdf.to_dict("records"))
        for r in rows:
            r["count"] = round(r["occurance"] * n)
        rows = [r for r in rows if r["occurance"] > least]
        rows.sort(key=lambda r: (-r["count"], -r["identity"]))
        rows = [r for r in rows if r["count"] > 0.3 * rows[0]["count"]]
        names = ["sample", "mate", "adapter", "count", "occurance", "identity", "adapter_start_position"]
        return pd.DataFrame([{**{c: r[c] for c in names}, "rank": k} for k, r in enumerate(rows, 1)], columns=[*names, "rank"])

    schema = "sample string, mate int, adapter string, count long, occurance double, identity double, adapter_start_position double, rank int"
    return stats.groupBy("sample", "mate").applyInPandas(merge, schema)


def detect_pairs(pairs: DataFrame, tolerance: int = 3, sample_reads: int | None = SAMPLE_READS, least: float = LEAST_SHARE) -> DataFrame:
    """Adapters of both mates of each sample, best first. Groups of adapter strings are bounded by ``sample_reads``."""
    taken = _sampled(pairs, sample_reads)
    own = F.col("sample") if "sample" in pairs.columns else F.lit("")
    n_reads = taken.groupBy(own.alias("sample")).agg(F.count("*").alias("n_reads"))
    return merged(adapter_stats(candidates_behind_overlap(taken, tolerance), n_reads), least)


def summary(detected: DataFrame, files: DataFrame) -> DataFrame:
    """One row per pair of files (``files``: sample, r1, r2): the best adapter of either mate, empty and NaN where there is none."""
    best = detected.where("rank = 1")
    names = ("adapter", "occurance", "identity", "adapter_start_position")
    out = files
    for m in (1, 2):
        mine = best.where(F.col("mate") == m).select("sample", *[F.col(c).alias(f"{'best_adapter' if c == 'adapter' else c}{m}") for c in names])
        out = out.join(mine, "sample", "left")
    fill = lambda c: F.coalesce(F.col(c), F.lit("") if c.startswith("best") else F.lit(float("nan"))).alias(c)
    return out.select(
        "r1", *[fill(f"{c}1") for c in ("best_adapter", *names[1:])], "r2", *[fill(f"{c}2") for c in ("best_adapter", *names[1:])]
    )


