"""Shared helpers of the corpus operators: the shared folder, materialised tables and row-local lets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import materialize, new_path, shared_dir

BATCH = "8m"
#: Rows of one key that a join keeps together at most, where the key may be hot.
HOT = 512
#: Hash slots of keys that a broadcast may hold: one long each.
SLOTS = 1 << 20
#: Characters that separate words everywhere in this package: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to Arrow batches of at most BATCH bytes where the size was left at Spark's default.

    Rows hold whole texts: with few bytes a batch, two tasks and their workers stay small whatever the texts' lengths.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "64m") in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(name, BATCH)
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda variable, so Catalyst can't inline it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _broadcasts(df: DataFrame) -> bool:
    """Whether the planner takes ``df`` for small enough to broadcast it; such a join shuffles nothing."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def dealt_join(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (one row per ``key``; ``n``: how many rows of ``big`` have it).

    Keys with more than HOT rows are dealt: ``small``'s row is repeated for each part, a row of ``big`` goes to the
    part that the hash of ``spread`` names. The table of such keys holds at most 1 / HOT of ``big``'s rows; the planner sees its size.
    Where it broadcasts ``small`` no key is shuffled at all.
    """
    if _broadcasts(small.drop("n")) or (small.agg(F.max("n")).first()[0] or 0) <= HOT:
        return big.join(small.drop("n"), key, how)
    hot = materialize(small.where(F.col("n") > HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("__parts")), "hot")
    small = small.drop("n")
    part = F.pmod(F.xxhash64(F.col(spread), F.lit(11)), F.coalesce("__parts", F.lit(1))).cast("int").alias("__part")
    mine = big.join(hot, key, "left").select(*big.columns, part)
    parts = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    theirs = small.join(hot, key, "left").select(*small.columns, F.explode(parts).alias("__part"))
    return mine.join(theirs, [key, "__part"], how).drop("__part")


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that certainly have none of the ``keys``, all others): told by hash slots, SLOTS numbers at most, which are broadcast.

    The first part needs no shuffle whatever the rows hold; only the second one has to meet the keys themselves.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("__slot")
    slots = materialize(keys.select(slot).distinct(), "slots")
    marked = rows.withColumn("__slot", slot)
    return tuple(marked.join(F.broadcast(slots), "__slot", how).select(*rows.columns) for how in ("left_anti", "left_semi"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["BATCH", "HOT", "SLOTS", "WORD", "bounded_batches", "dealt_join", "let", "materialize", "new_path", "parted", "shared_dir", "table"]
