"""Scores of trimmed reads against their truth, plot tables, and run-time tables."""

from __future__ import annotations

import math
import re
import statistics

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = ("seq_length", "insert_size", "error_rate")
#: Rows of a block when runs are told apart; blocks are numbered by ``ord``.
BLOCK = 1 << 16


def detail(reads: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """Per simulated read: the figures of its header, the trimmed length and how far off it is. Other headers stop the job."""
    name, seq = F.col(id_col), F.col(seq_col)
    ok = name.startswith("@PeReadSimulator")
    parts = F.split(F.when(ok, name).otherwise(F.raise_error(F.concat(F.lit("no simulated read: "), name)).cast("string")), " ")
    value = lambda k: F.regexp_extract(F.get(parts, F.lit(k)), "=(.*)$", 1)  # noqa: E731  by position
    trimmed = F.when(seq == "N", 0).otherwise(F.length(seq))
    others = [c for c in reads.columns if c not in (id_col, seq_col)]
    out = reads.select(
        *others,
        F.get(parts, F.lit(0)).alias("seq_id"),
        value(4).cast("int").alias("seq_length"),
        value(2).cast("int").alias("insert_size"),
        value(3).cast("double").alias("error_rate"),
        value(5).cast("int").alias("error_insert"),
        value(6).cast("int").alias("error_adapter"),
        value(1).cast("int").alias("true_length"),
        trimmed.alias("trimmed_length"),
    )
    return out.withColumn("delta_length", F.col("true_length") - F.col("trimmed_length")).withColumn("is_trim_successful", F.col("delta_length") == 0)


def with_runs(df: DataFrame, order: str = "ord", keys: tuple[str, ...] = RUN, block: int = BLOCK) -> DataFrame:
    """``df`` with ``run``: rows next to each other (by ``order``, a dense or sparse long) with equal keys share a number.

    Changes inside blocks of ``order`` are found by a window per block; what precedes a block and how many runs it has
    comes from one row per block, so no task ever holds all rows.
    """
    key = F.struct(*keys)
    here = W.partitionBy("__block").orderBy(order)
    df = df.withColumn("__block", F.floor(F.col(order) / block)).withColumn("__new", (~key.eqNullSafe(F.lag(key).over(here))).cast("int"))
    ends = df.groupBy("__block").agg(
        F.min_by(key, order).alias("first"), F.max_by(key, order).alias("last"), F.sum("__new").alias("n")
    )  # a block's first row counts as new here
    across = W.orderBy("__block")
    before = F.lag("last").over(across)
    same = (F.col("first").eqNullSafe(before) & F.lag("__block").over(across).isNotNull()).cast("int")
    starts = ends.select("__block", "n", same.alias("same"))
    base = F.sum(F.col("n") - F.col("same")).over(across.rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select("__block", (F.coalesce(base, F.lit(0)) - F.col("same")).alias("__base"))
    inside = F.sum("__new").over(here.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("__inside", inside).join(starts, "__block").withColumn("run", F.col("__base") + F.col("__inside")).drop("__block", "__new", "__base", "__inside")


def summary(detailed: DataFrame, by: tuple[str, ...] = RUN) -> DataFrame:
    """Rates and median deviations per group; undertrim deviations are negative, medians without rows 0."""
    d = F.col("delta_length")
    n = F.count("*")
    rate = lambda test: F.sum(F.when(test, 1).otherwise(0)) / n
    median = lambda test, v: F.coalesce(F.median(F.when(test, v)), F.lit(0.0))
    return detailed.groupBy(*by).agg(
        n.alias("repeat"),
        rate(d == 0).alias("precision"),
        rate(d > 0).alias("rate_overtrim"),
        rate(d < 0).alias("rate_undertrim"),
        median(d != 0, F.abs(d)).alias("deviation"),
        median(d > 0, d).alias("deviation_overtrim"),
        median(d < 0, d).alias("deviation_undertrim"),
        rate(F.abs(d) <= 1).alias("rate_precision_in1"),
        rate(d > 1).alias("rate_overtrim_gt1"),
        rate(d < -1).alias("rate_undertrim_gt1"),
    )


def run_summary(detailed: DataFrame, order: str = "ord") -> DataFrame:
    """As :func:`summary`, one row for each run of neighbouring reads with equal keys, in order (``run``)."""
    return summary(with_runs(detailed, order), ("run", *RUN))


RATES_LONG = ("Accurate Trim", "Over Trim = 1 bp", "Under Trim = 1 bp", "Over Trim > 1 bp", "Under Trim > 1 bp")


def _plotted(stats: DataFrame) -> DataFrame:
    return stats.withColumn("has_adapter", F.col("seq_length") > F.col("insert_size"))


def plot_rates(stats: DataFrame) -> DataFrame:
    """(file, has_adapter, name, value): mean rates, one row each (stacked bars)."""
    one = lambda side: F.avg(f"rate_{side}") - F.avg(f"rate_{side}_gt1")
    wide = _plotted(stats).groupBy("file", "has_adapter").agg(
        F.avg("precision").alias(RATES_LONG[0]), one("overtrim").alias(RATES_LONG[1]), one("undertrim").alias(RATES_LONG[2]),
        F.avg("rate_overtrim_gt1").alias(RATES_LONG[3]), F.avg("rate_undertrim_gt1").alias(RATES_LONG[4]),
    )
    return wide.unpivot(["file", "has_adapter"], list(RATES_LONG), "name", "value")


def plot_accuracy(stats: DataFrame, by: str = "error_rate") -> DataFrame:
    """(file, has_adapter, by, accurate, accurate_1bp): lines over error rates or adapter lengths."""
    return _plotted(stats).groupBy("file", "has_adapter", by).agg(F.avg("precision").alias("accurate"), F.avg("rate_precision_in1").alias("accurate_1bp"))


def plot_deviation(stats: DataFrame) -> DataFrame:
    """(file, insert_size, deviations): undertrim turned positive."""
    return stats.groupBy("file", "insert_size").agg(
        F.avg("deviation").alias("deviation"), F.avg("deviation_overtrim").alias("deviation_overtrim"), F.avg(-F.col("deviation_undertrim")).alias("deviation_undertrim")
    )


def confusion(truth: DataFrame, trimmed: DataFrame, full_length: int, id_col: str = "id") -> DataFrame:
    """One row: TP, FP_ft, FP_ot, FN_fr, FN_ut, TN and PPV, Sen, Spec, mCC, FPR of trimmed lengths against true ones.

    ``truth``: (id, length); ``trimmed``: (id, trimmed_length). Reads that are gone count as length 0.
    """
    t, m = F.col("length"), F.col("trimmed_length")
    gone, full = m.isNull(), F.lit(full_length)
    n = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))
    joined = truth.select(id_col, "length").join(trimmed.select(id_col, "trimmed_length"), id_col, "left")
    equal = ~gone & (t == m)
    c = joined.agg(
        n((gone & (t == 0)) | (equal & (t != full))).alias("TP"),
        n((gone & (t != 0) & (t == full)) | (~gone & (t > m) & (t == full))).alias("FP_ft"),
        n((gone & (t != 0) & (t != full)) | (~gone & (t > m) & (t != full))).alias("FP_ot"),
        n(~gone & (t < m) & (m == full)).alias("FN_fr"),
        n(~gone & (t < m) & (m != full)).alias("FN_ut"),
        n(equal & (t == full)).alias("TN"),
    )
    tp, fp, fp2, fn, fn2, tn = (F.col(x) for x in ("TP", "FP_ft", "FP_ot", "FN_fr", "FN_ut", "TN"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    root = F.sqrt((tp + fp + fp2).cast("double") * (tp + fn + fn2) * (tn + fp + fp2) * (tn + fn + fn2))
    return (
        c.withColumn("PPV", over(tp, tp + fp + fp2 + fn2))
        .withColumn("Sen", over(tp, tp + fn + fp2 + fn2))
        .withColumn("Spec", over(tn, tn + fp))
        .withColumn("mCC", over(tp * tn - (fp + fp2) * (fn + fn2), root))
        .withColumn("FPR", 1 - F.col("Spec"))
    )


# ---------------------------------------------------------------- run times


def seconds(text: Column) -> Column:
    """A number, a percentage (as a fraction) or D:H:M:S as a double."""
    parts = F.reverse(F.split(text, ":"))
    clock = sum((F.coalesce(F.get(parts, F.lit(k)).cast("double"), F.lit(0.0)) * w for k, w in enumerate((1, 60, 3600, 86400))), F.lit(0.0))
    return F.when(text.endswith("%"), F.regexp_replace(text, "%$", "").cast("double") / 100).otherwise(clock)


_TIMED = {
    "UserTime": "User time (seconds): ",
    "SystemTime": "System time (seconds): ",
    "ElapsedTime": "Elapsed (wall clock) time (h:mm:ss or m:ss): ",
    "MaxMemory": "Maximum resident set size (kbytes): ",
}


def time_table(runs: DataFrame, bases: int = 1) -> DataFrame:
    """(Threads, Command, Efficiency, Speed, UserTime, SystemTime, CPU, ElapsedTime, MaxMemory), by threads.

    ``runs``: ``command`` and ``lines`` (array of the lines of GNU time's verbose output). Speeds are million bases a second.
    """
    value = lambda mark: seconds(
        F.trim(F.regexp_replace(F.element_at(F.filter("lines", lambda x: F.contains(x, F.lit(mark))), 1), F.lit(".*" + re.escape(mark)), F.lit("")))
    )
    threads = F.lit(1)
    for flag in ("-threads", "-thread", "-cores", "-t"):  # a later one wins
        found = F.regexp_extract("command", flag + r"[= ]*([0-9]+)", 1)
        threads = F.when(found != "", found.cast("int")).otherwise(threads)
    out = runs.select(threads.alias("Threads"), F.col("command").alias("Command"), *[value(m).alias(c) for c, m in _TIMED.items()])
    out = out.withColumn("CPU", (F.col("UserTime") + F.col("SystemTime")) / F.col("ElapsedTime"))
    out = out.withColumn("Speed", F.lit(float(bases)) / F.col("ElapsedTime") / 1e6).withColumn("Efficiency", F.col("Speed") / F.col("CPU"))
    return out.select(
        "Threads", "Command", "Efficiency", "Speed", "UserTime", "SystemTime", "CPU", "ElapsedTime", F.col("MaxMemory").cast("long").alias("MaxMemory")
    ).orderBy("Threads")


def mean_and_deviation(values: list[float]) -> str:
    """Mean and sample deviation, both cut to the deviation's second significant digit.

    >>> mean_and_deviation([1.0, 2.0, 4.0]), mean_and_deviation([100.0, 200.0]), mean_and_deviation([3.0, 3.0])
    ('2.3 ± 1.5', '150 ± 71', '3 ± 0')
    """
    mean, dev = statistics.fmean(values), statistics.stdev(values) if len(values) > 1 else math.nan
    digits = 1 - math.floor(math.log10(dev)) if dev > 0 else 0
    if math.isnan(dev):
        return f"{mean:g} ± nan"
    return f"{round(mean)} ± {round(dev)}" if digits <= 0 else f"{round(mean, digits)} ± {float(f'{dev:.2g}')}"


def replicates(tables: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Replicates of a table, cell by cell: mean and deviation of each value column as text, by ``keys``."""

    def text(c: str) -> Column:
        mean, dev = F.avg(c), F.stddev_samp(c)
        digits = 1 - F.floor(F.log10(dev))
        # digits of the mean: those of the deviation; format_number needs a literal, so scaled rounding it is
        scaled = lambda v, d: F.round(v * F.pow(F.lit(10.0), d)) / F.pow(F.lit(10.0), d)
        fine = F.concat_ws(" ± ", scaled(mean, digits).cast("string"), scaled(dev, digits).cast("string"))
        whole = F.concat_ws(" ± ", F.bround(mean).cast("long").cast("string"), F.bround(dev).cast("long").cast("string"))
        return F.when((dev > 0) & (digits > 0), fine).otherwise(whole)

    return tables.groupBy(*keys).agg(*[text(c).alias(c) for c in values])


def spread(tables: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """As :func:`replicates`, as numbers: ``<value>_mean`` and ``<value>_std``."""
    return tables.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


_CELL = r"[\w.:-]+"


def cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line, cell, text) of text files of the same form: runs of letters, digits, points, colons and dashes."""
    from ..sources.fastq import numbered_lines

    found = F.posexplode(F.regexp_extract_all("value", F.lit(_CELL), F.lit(0)))
    return numbered_lines(spark, paths).select("file", "line", found.alias("cell", "text"))


def replicate_cells(found: DataFrame) -> DataFrame:
    """(line, cell, text): mean and deviation where all files have numbers or times in a cell, else the first file's text."""
    number = F.col("text").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    clock = F.col("text").rlike(r"^(\d+:){1,3}\d+(\.\d+)?$")
    valued = found.withColumn("value", F.when(number, F.col("text").try_cast("double")).when(clock, seconds(F.when(clock, F.col("text")))))
    dev, mean = F.coalesce(F.stddev_samp("value"), F.lit(0.0)), F.avg("value")
    g = valued.groupBy("line", "cell").agg(
        F.min_by("text", "file").alias("first"), F.every(F.col("value").isNotNull()).alias("numeric"), mean.alias("mean"), dev.alias("dev")
    )
    digits = 1 - F.floor(F.log10("dev"))
    scaled = lambda v: F.round(F.col(v) * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    whole = lambda v: F.bround(v).cast("long").cast("string")
    both = F.when((F.col("dev") > 0) & (digits > 0), F.concat_ws(" ± ", scaled("mean").cast("string"), scaled("dev").cast("string"))).otherwise(
        F.concat_ws(" ± ", whole("mean"), whole("dev"))
    )
    return g.select("line", "cell", F.when(F.col("numeric"), both).otherwise(F.col("first")).alias("text"))
