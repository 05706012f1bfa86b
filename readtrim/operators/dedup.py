"""PCR duplicates: reads or pairs whose sequences are equal; the one with the smallest index stays.

Counting is a hash aggregate with map-side partial sums, so a sequence that a third of all reads share is one row per
task when it is shuffled. Marking duplicates is a join on the index, which is unique. Dropping them is a row number of at
most 1, which Spark also applies before the shuffle: again a task sends one read per distinct sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keys(df: DataFrame) -> list[str]:
    """Both mates' sequences, and the sample where there is one: samples never share duplicates."""
    return [c for c in ("sample", "seq1", "seq2", "seq") if c in df.columns]


def place(df: DataFrame) -> list[str]:
    return [c for c in ("sample", "idx") if c in df.columns]


def groups(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Per distinct sequence (pair): ``n`` and ``first`` (smallest idx), and that read's id."""
    aggregates = [F.count("*").alias("n"), F.min("idx").alias("first")]
    if id_col:
        aggregates.append(F.min_by(id_col, "idx").alias("id"))
    return df.groupBy(*keys(df)).agg(*aggregates)


def mark(df: DataFrame, live: Column | None = None) -> DataFrame:
    """``df`` with ``duplicate``; rows that aren't ``live`` are neither counted nor duplicates. ``df`` is read twice."""
    counted = df if live is None else df.where(live)
    first = groups(counted).select(*[c for c in ("sample",) if c in df.columns], F.col("first").alias("idx"), F.lit(True).alias("__first"))
    out = df.join(first, place(df), "left")
    duplicate = F.col("__first").isNull() if live is None else live & F.col("__first").isNull()
    return out.withColumn("duplicate", duplicate).drop("__first")


def dedup(df: DataFrame) -> DataFrame:
    """The first of each group of equal reads, all columns as they came. ``df`` is read once."""
    rank = F.row_number().over(W.partitionBy(*keys(df)).orderBy("idx"))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def counts(df: DataFrame, id_col: str = "id1") -> DataFrame:
    """(count, id) of the groups with more than one member."""
    own = ["sample"] if "sample" in df.columns else []
    return groups(df, id_col).where("n > 1").select(*own, F.col("n").alias("count"), "id")


def totals(df: DataFrame) -> DataFrame:
    """One row: ``in_groups`` (all members of groups with duplicates, as the run report has it) and ``removed`` (without the one that stays)."""
    g = groups(df)
    return g.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed")
    )


def lossy_key(seq: Column) -> Column:
    """A short key that different sequences may share: bases by pairs, pairs with an ambiguous base count as CC."""
    even = F.when(F.length(seq) % 2 == 1, F.concat(seq, F.lit("-"))).otherwise(seq)
    pairs = F.regexp_extract_all(even, F.lit("(?s).."), F.lit(0))
    clean = F.array_join(F.transform(pairs, lambda p: F.when(p.rlike("^[ACGT]{2}$"), p).otherwise(F.lit("CC"))), "")
    bits = F.length(seq) + 3 * (F.length(seq) - F.length(F.translate(seq, "N", "")))
    c_like = F.length(seq) - F.length(F.translate(seq, "CN", ""))
    return F.concat_ws(":", bits.cast("string"), c_like.cast("string"), F.length(seq).cast("string"), clean)


def collisions(df: DataFrame, key: Column) -> DataFrame:
    """Keys that different sequences share, with those sequences. Distinct first, so copies collapse map side."""
    parts = [c for c in keys(df) if c != "sample"]
    distinct = df.select(key.alias("key"), *parts).distinct()
    return distinct.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("sequences"), F.count("*").alias("n")).where("n > 1")
