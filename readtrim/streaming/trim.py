"""Trimming as a Structured Streaming job.

Row-local steps run on a stream as they do on a table (projections and one Arrow pass). PCRDedup, wherever it stands, keeps state by
sequence: the first pair to arrive stays. That state only grows, as duplicates may come at any time; with an event-time column
and a watermark it can be bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import TrimOptions
from ..plans.pipeline import GROUPS, Pipeline


def trim_stream(reads: DataFrame, options: TrimOptions | None = None, paired: bool = True, event_time: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """The good reads of a streaming DataFrame. PCRDedup keeps state where it stands; the steps before and after it are row-local."""
    options = options or TrimOptions()
    names = [n for s in options.order for n in GROUPS.get(s, (s,))]
    parts: list[list[str]] = [[]]
    for name in names:
        if name == "PCRDedup" and options.pcr_dedup:
            parts.append([])
        elif name != "PCRDedup":
            parts[-1].append(name)
    if event_time and len(parts) > 1:
        reads = reads.withWatermark(event_time, watermark)
    good = reads
    for k, part in enumerate(parts):
        if k:
            keys = [c for c in ("sample", "seq1", "seq2") if c in good.columns]
            good = good.dropDuplicatesWithinWatermark(keys) if event_time else good.dropDuplicates(keys)
        chain = Pipeline(replace(options, order=tuple(part), pcr_dedup=False), paired)
        good = chain.good(chain.apply(good))
    return good


def pair_streams(mate1: DataFrame, mate2: DataFrame) -> DataFrame:
    """Mates that arrive on two streams, paired by (sample, idx); one waits for the other in state.

    ``mate1``: sample, idx, id1, seq1, des1, qual1; ``mate2`` likewise. Give both a watermark to bound the wait.
    """
    keys = [c for c in ("sample", "idx") if c in mate1.columns]
    return mate1.join(mate2, keys)


def counters_stream(reads: DataFrame, options: TrimOptions | None = None, paired: bool = True) -> DataFrame:
    """Running totals of the report over a stream (output mode complete or update)."""
    chain = Pipeline(replace(options or TrimOptions(), pcr_dedup=False), paired)
    return chain.report(chain.apply(reads))


def trim_folder(
    spark: SparkSession, source: str, sink: str, checkpoint: str, options: TrimOptions | None = None, paired: bool = True, event_time: str | None = None
):
    """Trim all Parquet files of reads that have landed in ``source`` since the last call, exactly once, and stop."""
    reads = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = trim_stream(reads, options, paired, event_time)
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fastq_folder(spark: SparkSession, source: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*"):
    """Call ``handle(files, batch)`` with the paths of FASTQ files (column ``path``) that are new in ``source``, and stop."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(source).select(F.col("path"))
    query = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
