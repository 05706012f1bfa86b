"""Queries of the read engine over the driver's tables, and their SQL.

Read pairs are derived from ``orders`` by one SQL text that Spark and DuckDB share: MD5 digits become bases, so reads are
the same everywhere; every seventh pair has the same flaw (tail of N, G tail, low complexity, poor tail, short mate, wrong base).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pair_reads, pair_sql
from .functions import exprs, sql
from .operators import dedup, detect, simulate, stats
from .plans.options import ADAPTER1, ADAPTER2, TrimOptions
from .plans.pipeline import Pipeline
from .plans.store import materialize, new_path, spread
from .sources import fastq
from .sources.adapters import KNOWN_ADAPTERS
from .streaming.trim import trim_stream

PAIRS_SQL = """
WITH k AS (
  SELECT o_orderkey AS idx, o_orderkey % 7 AS v, cast(o_custkey AS varchar(20)) AS seed, 40 + o_custkey % 81 AS insert_size
  FROM {orders}),
h AS (
  SELECT idx, v, seed, cast(insert_size AS int) AS insert_size,
    translate(concat(md5(concat(seed, ':0')), md5(concat(seed, ':1')), md5(concat(seed, ':2')), md5(concat(seed, ':3'))),
              '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna,
    translate(concat(md5(concat(seed, ':4')), md5(concat(seed, ':5'))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS filler,
    translate(concat(md5(concat(seed, ':6')), md5(concat(seed, ':7')), md5(concat(seed, ':8')), md5(concat(seed, ':9'))),
              '0123456789abcdef', 'IIIIIIIIHHHGF5+#') AS q
  FROM k),
f AS (SELECT *, substring(dna, 1, insert_size) AS frag FROM h),
r AS (
  SELECT idx, v, insert_size, least(insert_size, 100) AS true_len,
    substring(concat(frag, 'AGATCGGAAGAGCACACGTCTGAACTCCAGTCA', filler), 1, 100) AS s1,
    substring(concat(translate(reverse(frag), 'ACGT', 'TGCA'), 'AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT', filler), 1, 100) AS s2,
    substring(q, 1, 100) AS q1, substring(reverse(q), 1, 100) AS q2
  FROM f)
SELECT idx, v, insert_size, true_len,
  concat('@sim:', cast(idx AS varchar(20)), ' 1') AS id1,
  concat('@sim:', cast(CASE WHEN idx % 50 = 0 THEN idx + 1 ELSE idx END AS varchar(20)), ' 2') AS id2,
  CASE WHEN v = 0 THEN concat(substring(s1, 1, 88), 'NNNNNNNNNNNN')
       WHEN v = 1 THEN concat(substring(s1, 1, 80), 'GGGGGGGGGAGGGGGGGGGG')
       WHEN v = 2 THEN concat(substring(s1, 1, 20), repeat('A', 60), substring(s1, 81, 20))
       WHEN v = 4 THEN substring(s1, 1, cast(20 + idx % 81 AS int))
       WHEN v = 5 THEN concat(substring(s1, 1, 9), translate(substring(s1, 10, 1), 'ACGT', 'CGTA'), substring(s1, 11, 90))
       ELSE s1 END AS seq1,
  s2 AS seq2,
  CASE WHEN v = 3 THEN concat(substring(q1, 1, 88), '!!!!!!!!!!!!')
       WHEN v = 4 THEN substring(q1, 1, cast(20 + idx % 81 AS int))
       WHEN v = 5 THEN concat(substring(q1, 1, 9), '#', substring(q1, 11, 90))
       WHEN v = 6 THEN concat(substring(q1, 1, 70), repeat('#', 30))
       ELSE q1 END AS qual1,
  q2 AS qual2
FROM r
"""


def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of PAIRS_SQL."""
    return pair_reads.read_pairs(spread(_keys(spark, sf_dir)))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")


#: Pairs in a part of the files that queries write, about.
_PART = 100_000


def _pairs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs in the order of idx. Their keys are sorted before reads are made of them: no read is shuffled, or made once more to find the ranges."""
    keys = _keys(spark, sf_dir)
    parts = max(spark.sparkContext.defaultParallelism, keys.count() // _PART + 1)
    return pair_reads.read_pairs(keys.repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey"))


_P = f"p AS ({PAIRS_SQL.format(orders='orders')})"
_READS = ("idx", "seq1", "qual1", "seq2", "qual2")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _only(*order: str, **options) -> Pipeline:
    """A chain of the named steps only; adapters and poly tails off, so tails go by N."""
    return Pipeline(TrimOptions(order=order, **({"adapter_trim": False} | options)))


def _trimmed(spark: SparkSession, sf_dir: str, chain: Pipeline, *more: str) -> DataFrame:
    return chain.apply(read_pairs(spark, sf_dir).select(*_READS)).select(*_READS, *more)


# ---------------------------------------------------------------- clips and tails


@_query(f"""WITH {_P} SELECT idx, substring(seq1, 1, greatest(length(seq1) - 10, 0)) AS seq1, substring(qual1, 1, greatest(length(seq1) - 10, 0)) AS qual1,
  substring(seq2, 1, greatest(length(seq2) - 25, 0)) AS seq2, substring(qual2, 1, greatest(length(seq2) - 25, 0)) AS qual2 FROM p""")
def hard_clip_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, _only("HardClipEnd", clip3_r1=10, clip3_r2=25))


@_query(f"""WITH {_P} SELECT idx, substring(seq1, 1, 80) AS seq1, substring(qual1, 1, 80) AS qual1, substring(seq2, 1, 70) AS seq2, substring(qual2, 1, 70) AS qual2,
  cast(length(seq1) > 80 AS int) AS hard_clip_after_r1, cast(length(seq2) > 70 AS int) AS hard_clip_after_r2 FROM p""")
def hard_clip_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, _only("HardClipAfter", clip_after_r1=80, clip_after_r2=70), "hard_clip_after_r1", "hard_clip_after_r2")


@_query(f"WITH {_P} SELECT idx, substring(seq1, 7) AS seq1, substring(qual1, 7) AS qual1, substring(seq2, 4) AS seq2, substring(qual2, 4) AS qual2 FROM p")
def hard_clip_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, _only("HardClipFront", clip5_r1=6, clip5_r2=3))


@_query(f"""WITH {_P} SELECT idx, regexp_replace(seq1, 'N+$', '') AS seq1, substring(qual1, 1, length(regexp_replace(seq1, 'N+$', ''))) AS qual1,
  regexp_replace(seq2, 'N+$', '') AS seq2, substring(qual2, 1, length(regexp_replace(seq2, 'N+$', ''))) AS qual2,
  cast(seq1 LIKE '%N' AS int) AS tail_N_trim_r1, cast(seq2 LIKE '%N' AS int) AS tail_N_trim_r2 FROM p""")
def tail_n_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, _only("TailNTrim"), "tail_N_trim_r1", "tail_N_trim_r2")


_LOW = """regexp_replace(qual{m}, '[!"]+$', '')"""


@_query(f"""WITH {_P} SELECT idx, substring(seq1, 1, length({_LOW.format(m=1)})) AS seq1, {_LOW.format(m=1)} AS qual1,
  substring(seq2, 1, length({_LOW.format(m=2)})) AS seq2, {_LOW.format(m=2)} AS qual2 FROM p""")
def tail_low_qual_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, Pipeline(TrimOptions(order=("TailNTrim",))))


def _quality_sql(m: int, score: int = 53, k: int = 5) -> str:
    """How many bases of mate ``m`` QualityTrim keeps."""
    q = f"list_transform(range(1, length(qual{m}) + 1), lambda i: ascii(substring(qual{m}, cast(i AS int), 1)))"
    return f"""q{m}a AS (SELECT idx, length(qual{m}) AS n, {q} AS q FROM p),
q{m}b AS (SELECT idx, n, q, list_min(list_filter(range(1, n + 1), lambda i: q[i] < {score})) AS low FROM q{m}a),
q{m}c AS (SELECT *, coalesce(list_min(list_filter(range(low, n - {k} + 2), lambda i: list_sum(q[i:i + {k} - 1]) < {score} * {k})), greatest(low, n - {k} + 2)) AS stop
  FROM q{m}b),
q{m} AS (SELECT idx, coalesce(CASE WHEN low IS NULL THEN NULL ELSE list_min(list_filter(range(stop, n + 1), lambda i: q[i] < {score})) - 1 END, n) AS keep{m} FROM q{m}c)"""


@_query(f"""WITH {_P}, {_quality_sql(1)}, {_quality_sql(2)}
SELECT p.idx, substring(seq1, 1, cast(keep1 AS int)) AS seq1, substring(qual1, 1, cast(keep1 AS int)) AS qual1,
  substring(seq2, 1, cast(keep2 AS int)) AS seq2, substring(qual2, 1, cast(keep2 AS int)) AS qual2
FROM p JOIN q1 ON p.idx = q1.idx JOIN q2 ON p.idx = q2.idx""")
def quality_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, _only("QualityTrim"))


def _poly_sql(m: int, base: str, misses: int = 2, least: int = 10) -> str:
    """Bases of mate ``m`` that a poly-tail trim keeps. Tail scan, bridge over one more mismatch, look back from its begin."""
    return f"""t{m}a AS (SELECT idx, seq{m} AS s, length(seq{m}) AS n, reverse(seq{m}) AS b FROM p),
t{m}b AS (SELECT *, coalesce(list_min(list_filter(range(1, n + 1), lambda k: length(regexp_replace(substring(b, 1, cast(k AS int)), '[{base}N]', '', 'g')) > {misses})), n + 1) AS stop FROM t{m}a),
t{m}c AS (SELECT *, length(regexp_replace(substring(b, 1, cast(stop - 1 AS int)), '[^{base}N]+$', '')) AS best,
  length(regexp_extract(substring(b, cast(stop + 1 AS int)), '^{base}*')) AS run FROM t{m}b),
t{m}d AS (SELECT idx, s, n, CASE WHEN run > 0 THEN n - (stop + run) + 1 WHEN best > 0 THEN n - best + 1 ELSE 0 END AS pos FROM t{m}c),
t{m}e AS (SELECT *, substring(s, cast(pos + 1 AS int)) AS rest FROM t{m}d),
t{m}f AS (SELECT *, length(regexp_extract(rest, '^{base}*')) AS ahead, length(regexp_extract(rest, '^{base}*([^{base}]*)', 1)) AS missed FROM t{m}e),
t{m}g AS (SELECT idx, n, CASE WHEN pos > 0 AND ahead < {misses} AND missed >= 1 + ahead AND ahead < n - pos THEN pos + ahead + missed + 1 ELSE pos END AS pos FROM t{m}f),
t{m} AS (SELECT idx, CASE WHEN pos > 0 AND pos <= n AND n - pos + 1 >= {least} THEN pos - 1 ELSE n END AS keep{m} FROM t{m}g)"""


@_query(f"""WITH {_P}, {_poly_sql(1, "G")}, {_poly_sql(2, "G")}
SELECT p.idx, substring(seq1, 1, cast(keep1 AS int)) AS seq1, substring(qual1, 1, cast(keep1 AS int)) AS qual1,
  substring(seq2, 1, cast(keep2 AS int)) AS seq2, substring(qual2, 1, cast(keep2 AS int)) AS qual2
FROM p JOIN t1 ON p.idx = t1.idx JOIN t2 ON p.idx = t2.idx""")
def poly_g_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, _only("PolyG", polyG=True))


@_query(f"""WITH {_P}, {_poly_sql(1, "A", 3, 4)}, {_poly_sql(2, "A", 3, 4)}
SELECT p.idx, keep1, keep2 FROM p JOIN t1 ON p.idx = t1.idx JOIN t2 ON p.idx = t2.idx""")
def poly_a_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _only("PolyX", polyA=True, poly_mismatch_per_16mer=3, poly_length=4)
    out = chain.apply(read_pairs(spark, sf_dir))
    return out.select("idx", *[F.length(f"seq{m}").cast("long").alias(f"keep{m}") for m in (1, 2)])


def _poly(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    chain = _only(f"Poly{base}", poly_mismatch_per_16mer=3, poly_length=4, **{f"poly{base}": True})
    return chain.apply(read_pairs(spark, sf_dir)).select("idx", *[F.length(f"seq{m}").cast("long").alias(f"keep{m}") for m in (1, 2)])


@_query(f"""WITH {_P}, {_poly_sql(1, "T", 3, 4)}, {_poly_sql(2, "T", 3, 4)}
SELECT p.idx, keep1, keep2 FROM p JOIN t1 ON p.idx = t1.idx JOIN t2 ON p.idx = t2.idx""")
def poly_t_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _poly(spark, sf_dir, "T")


@_query(f"""WITH {_P}, {_poly_sql(1, "C", 3, 4)}, {_poly_sql(2, "C", 3, 4)}
SELECT p.idx, keep1, keep2 FROM p JOIN t1 ON p.idx = t1.idx JOIN t2 ON p.idx = t2.idx""")
def poly_c_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _poly(spark, sf_dir, "C")


# ---------------------------------------------------------------- filters


@_query(f"WITH {_P} SELECT idx, length(seq1) BETWEEN 50 AND 100 AND length(seq2) BETWEEN 50 AND 100 AS good FROM p")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _only("LengthFilter", length_range="50:100").apply(read_pairs(spark, sf_dir))
    return out.select("idx", F.col("drop_reason").isNull().alias("good"))


@_query(f"WITH {_P} SELECT idx, length(seq1) - length(replace(seq1, 'N', '')) <= 5 AND length(seq2) - length(replace(seq2, 'N', '')) <= 5 AS good FROM p")
def max_n_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _only("MaxNFilter", max_n=5).apply(read_pairs(spark, sf_dir)).select("idx", F.col("drop_reason").isNull().alias("good"))


@_query(f"""WITH {_P}, h AS (SELECT idx, id1, id2, regexp_extract(id1, '^[^ /]*') AS head FROM p)
SELECT idx, CASE WHEN length(head) < length(id1) THEN substring(id2, 1, length(head)) = head ELSE id1 = id2 END AS same FROM h""")
def check_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pairs(spark, sf_dir).select("idx", exprs.same_identifier(F.col("id1"), F.col("id2")).alias("same"))


def _complexity_sql(m: int) -> str:
    pair = f"CASE WHEN substring(seq{m}, cast(i AS int), 1) = 'N' AND substring(seq{m}, cast(i + 1 AS int), 1) = 'N' THEN 4 WHEN substring(seq{m}, cast(i AS int), 1) = 'N' OR substring(seq{m}, cast(i + 1 AS int), 1) = 'N' OR substring(seq{m}, cast(i AS int), 1) = substring(seq{m}, cast(i + 1 AS int), 1) THEN 1 ELSE 0 END"
    n = f"length(seq{m})"
    ones = f"coalesce(list_sum(list_transform(list_filter(range(1, {n}), lambda i: i % 16 <> 0), lambda i: {pair})), 0)"
    return f"1 - {ones} / CASE WHEN {n} % 16 = 0 THEN 15 * ({n} // 16) ELSE 15 * ({n} // 16) + {n} % 16 END::double"


@_query(f"""WITH {_P}, c AS (SELECT idx, {_complexity_sql(1)} AS c1, {_complexity_sql(2)} AS c2 FROM p)
SELECT idx, round(c1, 6) AS complexity1, c1 >= 0.6 AND c2 >= 0.6 AS good FROM c""")
def complexity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = F.pandas_udf(sql.complexity, "double")  # less work than the expression; an empty read's NaN would become null
    value = F.when(F.length("seq1") == 0, F.lit(float("nan"))).otherwise(kernel("seq1"))
    pairs = read_pairs(spark, sf_dir).select(*_READS, F.round(value, 6).alias("complexity1"))
    out = _only("ComplexityFilter", complexity_filtration=True, min_complexity=0.6).apply(pairs)
    return out.select("idx", "complexity1", F.col("drop_reason").isNull().alias("good"))


# ---------------------------------------------------------------- scalar functions


@_query(f"WITH {_P} SELECT idx, translate(reverse(seq1), 'ACGTN', 'TGCAN') AS rc1, translate(reverse(seq2), 'ACGTN', 'TGCAN') AS rc2 FROM p")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rc = lambda c: exprs.reverse_complement(F.col(c))
    return read_pairs(spark, sf_dir).select("idx", rc("seq1").alias("rc1"), rc("seq2").alias("rc2"))


@_query(f"""WITH {_P} SELECT idx, round(list_avg(list_transform(range(1, length(qual1) + 1), lambda i: 1 - pow(10, -least(ascii(substring(qual1, cast(i AS int), 1)) - 33, 50) / 10.0))), 6) AS mean1,
  round(coalesce(list_avg(list_transform(range(90, least(length(qual1), 105) + 1), lambda i: 1 - pow(10, -least(ascii(substring(qual1, cast(i AS int), 1)) - 33, 50) / 10.0))), 0), 6) AS tail1 FROM p""")
def qual_prob_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("qual1")
    return read_pairs(spark, sf_dir).select(
        "idx", F.round(exprs.mean_probability(q), 6).alias("mean1"), F.round(exprs.mean_probability(q, 90, F.lit(105)), 6).alias("tail1")
    )


# ---------------------------------------------------------------- duplicates


@_query(f"WITH {_P}, w AS (SELECT *, row_number() OVER (PARTITION BY seq1, seq2 ORDER BY idx) AS k FROM p) SELECT idx, seq1, qual1, seq2, qual2 FROM w WHERE k = 1")
def pcr_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(read_pairs(spark, sf_dir).select(*_READS))


@_query(f"WITH {_P} SELECT count(*) AS count, arg_min(id1, idx) AS id FROM p GROUP BY seq1, seq2 HAVING count(*) > 1")
def pcr_dedup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.counts(read_pairs(spark, sf_dir))


@_query(f"""WITH {_P}, g AS (SELECT count(*) AS n FROM p GROUP BY seq1, seq2)
SELECT cast(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS in_groups, cast(sum(n - 1) AS BIGINT) AS removed FROM g""")
def pcr_dedup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.totals(read_pairs(spark, sf_dir))


@_query(f"""WITH {_P}, h AS (SELECT substring(seq1, 1, 5) AS seq1, substring(seq2, 1, 1) AS seq2 FROM p),
d AS (SELECT DISTINCT concat_ws('/', {pair_sql.lossy_key('seq1')}, {pair_sql.lossy_key('seq2')}) AS key, seq1, seq2 FROM h)
SELECT key, count(*) AS n, array_to_string(list_sort(list(seq1 || '+' || seq2)), ',') AS sequences FROM d GROUP BY key HAVING count(*) > 1""")
def hash_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different heads of five bases and one under one short key: the odd base is lost in it."""
    heads = read_pairs(spark, sf_dir).select(F.substring("seq1", 1, 5).alias("seq1"), F.substring("seq2", 1, 1).alias("seq2"))
    found = dedup.collisions(heads, F.concat_ws("/", dedup.lossy_key(F.col("seq1")), dedup.lossy_key(F.col("seq2"))))
    text = F.array_join(F.array_sort(F.transform("sequences", lambda s: F.concat_ws("+", s["seq1"], s["seq2"]))), ",")
    return found.select("key", "n", text.alias("sequences"))


# ---------------------------------------------------------------- adapters

_WINDOWS = """w AS (SELECT idx, length(seq1) AS n, seq1, unnest(range(0, (length(seq1) - 15) // 2 + 1)) AS pair FROM p WHERE length(seq1) >= 15)"""


def _scan_sql(head: str, second: str, width: int) -> str:
    """Scores of both placements at each pair of bases: from the needle's second base (one place earlier), from its first.

    A base of the read that is N fits any; windows over the end are short, so lengths are equalled first.
    """
    score = lambda needle, start, k: (
        f"length(substring(seq1, cast({start} AS int), {k})) - hamming(translate(substring(seq1, cast({start} AS int), {k}), 'N', '-'), substring({needle}, 1, length(substring(seq1, cast({start} AS int), {k}))))"
        f" + length(substring(seq1, cast({start} AS int), {k})) - length(replace(substring(seq1, cast({start} AS int), {k}), 'N', ''))"
    )
    return f"unnest([{{'pos': 2 * pair, 'fit': {score(second, '2 * pair + 1', width)}}}, {{'pos': 2 * pair + 1, 'fit': {score(head, '2 * pair + 1', 16)}}}], recursive := true)"


_SE = f"""{_WINDOWS}, s AS (SELECT idx, n, {_scan_sql(f"'{ADAPTER1[:16]}'", f"'{ADAPTER1[1:17]}'", 16)} FROM w),
b AS (SELECT idx, max(fit) AS fit, arg_min(pos, -fit * 1000 + pos) AS pos FROM s WHERE pos <= n GROUP BY idx HAVING max(fit) >= 14)"""


@_query(f"WITH {_P}, {_SE} SELECT idx, pos, fit FROM b")
def adapter_scan_16mer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the adapter's 16-mer fits with at most two mismatches (whole 16-mers only)."""
    import pyarrow as pa

    from .functions.batch import Mate
    from .functions.kernels import needle, scan

    def find(batches):
        for b in batches:
            m = Mate.of(b.column(1), b.column(1))
            hit = scan(needle(ADAPTER1), m.codes, m.n, 1, 2)
            rows = pa.array(hit.n >= 14)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(rows), pa.array(hit.idx).filter(rows), pa.array(hit.n.astype("int64")).filter(rows)], names=["idx", "pos", "fit"])

    return read_pairs(spark, sf_dir).select("idx", "seq1").mapInArrow(find, "idx long, pos long, fit long")


@_query(f"""WITH {_P}, {_SE} SELECT p.idx, substring(seq1, 1, cast(greatest(coalesce(pos - 1, length(seq1)), 0) AS int)) AS seq1,
  substring(qual1, 1, cast(greatest(coalesce(pos - 1, length(seq1)), 0) AS int)) AS qual1 FROM p LEFT JOIN b ON p.idx = b.idx""")
def adapter_trim_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Pipeline(TrimOptions(order=("AdapterTrim",)), paired=False)
    return chain.apply(read_pairs(spark, sf_dir).select("idx", "seq1", "qual1")).select("idx", "seq1", "qual1")


_CANDIDATES = ", ".join(f"({k}, '{a}')" for k, a in enumerate(KNOWN_ADAPTERS))


@_query(f"""WITH {_P}, r AS (SELECT seq1, count(*) AS m FROM p GROUP BY seq1), a AS (SELECT * FROM (VALUES {_CANDIDATES}) t(ord, adapter)),
w AS (SELECT seq1, m, unnest(range(0, (length(seq1) - 15) // 2 + 1)) AS pair FROM r WHERE length(seq1) >= 15),
e AS (SELECT seq1, m, pair, translate(substring(seq1, cast(2 * pair + 1 AS int), 16), 'N', '-') AS win FROM w),
s AS (SELECT ord, adapter, seq1, m, greatest(
        15 - hamming(substring(win, 1, 15), substring(adapter, 2, 15)) + 15 - length(replace(substring(win, 1, 15), '-', '')),
        length(win) - hamming(win, substring(adapter, 1, length(win))) + length(win) - length(replace(win, '-', ''))) AS fit FROM e, a),
b AS (SELECT ord, adapter, seq1, any_value(m) AS m, max(fit) AS fit FROM s GROUP BY ord, adapter, seq1 HAVING max(fit) >= 14),
t AS (SELECT a.ord, a.adapter, cast(coalesce(sum(m), 0) AS BIGINT) AS count, sum(fit * m) AS fit FROM a LEFT JOIN b ON a.ord = b.ord GROUP BY a.ord, a.adapter)
SELECT adapter, count, CASE WHEN count > 0 THEN round(fit / count / 16, 6) END AS identity FROM t ORDER BY count DESC, ord LIMIT 5""")
def detect_adapter_se_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = detect.top_known(detect.count_known(read_pairs(spark, sf_dir), sample_reads=None))
    return top.select("adapter", "count", F.round(F.nanvl("identity", F.lit(None).cast("double")), 6).alias("identity"))


def _pairs(columns: str = ", ".join(_READS), where: str = "") -> pair_sql.Chain:
    return pair_sql.Chain(f"{_P}, r AS (SELECT {columns} FROM p {where})", "r")


def _detected_sql(select: str, where: str = "") -> str:
    c = _pairs(where=where)
    pair_sql.behind_overlap(c)
    pair_sql.merge_and_rank(c, "SELECT count(*) FROM r")
    return c.sql(select)


_FOUND = "SELECT cast(mate AS int) AS mate, rank, adapter, count, round(occ, 6) AS occurance, round(identity, 6) AS identity, round(pos, 6) AS adapter_start_position FROM {prev}"


def _found(found: DataFrame) -> DataFrame:
    return found.select("mate", "rank", "adapter", "count", *[F.round(c, 6).alias(c) for c in ("occurance", "identity", "adapter_start_position")])


@_query(_detected_sql(_FOUND))
def detect_adapter_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detect.detect_pairs(read_pairs(spark, sf_dir), sample_reads=None))


@_query(_detected_sql(_FOUND, "WHERE idx < 1000"))
def detect_adapter_pe_first_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection looks at the first reads of a sample: the bound is the feature."""
    return _found(detect.detect_pairs(read_pairs(spark, sf_dir), sample_reads=1000))


@_query(_detected_sql("""SELECT 'a_1.fq' AS r1, 'a_2.fq' AS r2, """ + ", ".join(
    f"coalesce(max(adapter) FILTER (WHERE mate = {m}), '') AS best_adapter{m}, " + ", ".join(
        f"round(coalesce(max({c}) FILTER (WHERE mate = {m}), 'nan'::double), 6) AS {n}{m}" for c, n in (("occ", "occurance"), ("identity", "identity"), ("pos", "adapter_start_position")))
    for m in (1, 2)) + " FROM {prev} WHERE rank = 1"))
def detect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_pairs(read_pairs(spark, sf_dir), sample_reads=None)
    files = spark.createDataFrame([("", "a_1.fq", "a_2.fq")], "sample string, r1 string, r2 string")
    out = detect.summary(found, files)
    return out.select(*[c if kind == "string" else F.round(c, 6).alias(c) for c, kind in out.dtypes])


def _stats_sql() -> str:
    c = _pairs()
    pair_sql.behind_overlap(c)
    return c.sql("""SELECT cast(mate AS int) AS mate, adapter, count(*) AS count, round(count(*) / (SELECT count(*) FROM r), 6) AS occurance, round(avg(prob), 6) AS identity,
  round(avg(start), 6) AS adapter_start_position FROM {prev} GROUP BY mate, adapter""")


@_query(_stats_sql())
def adapter_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregation behind detection over what follows the overlap in every pair."""
    pairs = read_pairs(spark, sf_dir)
    n_reads = pairs.groupBy(F.lit("").alias("sample")).agg(F.count("*").alias("n_reads"))
    found = detect.adapter_stats(detect.candidates_behind_overlap(pairs), n_reads)
    return found.select("mate", "adapter", "count", *[F.round(c, 6).alias(c) for c in ("occurance", "identity", "adapter_start_position")])


def _adapter_sql(adapters: list[tuple[str, str]], consensus: bool = True) -> str:
    c = _pairs()
    pair_sql.trim_adapters(c, adapters, consensus)
    return c.sql(f"SELECT {', '.join(_READS)}, adapter_trim_r1 FROM {{prev}}")


@_query(_adapter_sql([(ADAPTER1, ADAPTER2)], False))
def adapter_trim_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, Pipeline(TrimOptions(order=("AdapterTrim",), consensus=False)), "adapter_trim_r1")


@_query(_adapter_sql([(ADAPTER1, ADAPTER2)]))
def pe_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, Pipeline(TrimOptions(order=("AdapterTrim",))), "adapter_trim_r1")


_TWO = (ADAPTER1[::-1], ADAPTER1), ("CTGTCTCTTATACACATCTGACGCTGCCGACGA", ADAPTER2)


@_query(_adapter_sql(list(zip(*_TWO, strict=True))))
def multi_adapter_trim_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir, Pipeline(TrimOptions(order=("AdapterTrim",), adapter1=_TWO[0], adapter2=_TWO[1])), "adapter_trim_r1")


# ---------------------------------------------------------------- whole chains

_CHAIN = f"""WITH {_P}, {_quality_sql(1)}, {_quality_sql(2)},
a AS (SELECT p.idx, substring(seq1, 1, cast(keep1 AS int)) AS s1, substring(seq2, 1, cast(keep2 AS int)) AS s2, length(seq1) AS n1, length(seq2) AS n2, keep1, keep2
  FROM p JOIN q1 ON p.idx = q1.idx JOIN q2 ON p.idx = q2.idx),
b AS (SELECT *, regexp_replace(s1, 'N+$', '') AS t1, regexp_replace(s2, 'N+$', '') AS t2 FROM a),
c AS (SELECT *, CASE WHEN NOT (length(t1) BETWEEN 30 AND 999999 AND length(t2) BETWEEN 30 AND 999999) THEN 'LengthFilter' END AS drop_reason FROM b)"""


@_query(f"""{_CHAIN} SELECT coalesce(drop_reason, 'good') AS outcome, cast(length(t1) // 10 * 10 AS BIGINT) AS bucket, count(*) AS pairs FROM c GROUP BY 1, 2""")
def trim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and tail trimming, then the length filter: pairs by outcome and length."""
    out = _only("QualityTrim", "TailNTrim", "LengthFilter").apply(read_pairs(spark, sf_dir).select(*_READS))
    bucket = (F.floor(F.length("seq1") / 10) * 10).cast("long")
    return out.groupBy(F.coalesce("drop_reason", F.lit("good")).alias("outcome"), bucket.alias("bucket")).agg(F.count("*").alias("pairs"))


@_query(f"""{_CHAIN} SELECT count(*) AS total, count(*) FILTER (WHERE drop_reason IS NULL) AS good,
  count(*) FILTER (WHERE keep1 < n1) AS quality_trim_r1, count(*) FILTER (WHERE keep2 < n2) AS quality_trim_r2,
  count(*) FILTER (WHERE length(t1) < length(s1)) AS tail_N_trim_r1, count(*) FILTER (WHERE length(t2) < length(s2)) AS tail_N_trim_r2,
  count(*) FILTER (WHERE drop_reason IS NOT NULL) AS length_filtered_r1, count(*) FILTER (WHERE drop_reason IS NOT NULL) AS length_filtered_r2 FROM c""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _only("QualityTrim", "TailNTrim", "LengthFilter")
    report = chain.report(chain.apply(read_pairs(spark, sf_dir).select(*_READS)))
    return report.select("total", "good", *[f"{c}_r{m}" for c in ("quality_trim", "tail_N_trim", "length_filtered") for m in (1, 2)])


def _default_sql(paired: bool) -> str:
    """Every step of the default order; a pair that a filter drops is gone."""
    mates = (1, 2) if paired else (1,)
    long_enough = " AND ".join(f"length(seq{m}) BETWEEN 30 AND 999999" for m in mates)
    if paired:
        cut = ", ".join(f"substring({s}{m}, 1, cast(keep{m} AS int)) AS {s}{m}" for m in mates for s in ("seq", "qual"))
        c = pair_sql.Chain(f"""{_P}, {_poly_sql(1, "G")}, {_poly_sql(2, "G")}, r AS (SELECT p.idx, {cut} FROM p JOIN t1 ON p.idx = t1.idx JOIN t2 ON p.idx = t2.idx)""", "r")
        c.where(long_enough)
        pair_sql.trim_adapters(c, [(ADAPTER1, ADAPTER2)])
    else:
        c = _pairs("idx, seq1, qual1").where(long_enough)
        pair_sql.adapter_cut_single(c, ADAPTER1)
    for m in mates:
        pair_sql.quality_cut(c, m)
        pair_sql.poor_tail_cut(c, m)
    c.where(" AND ".join(f"length(seq{m}) - length(replace(seq{m}, 'N', '')) <= 15" for m in mates)).where(long_enough)
    if paired:
        c.where(" AND ".join(f"{_complexity_sql(m)} >= 0.3" for m in mates))
    seqs, columns = ", ".join(f"seq{m}" for m in mates), ", ".join(f"seq{m}, qual{m}" for m in mates)
    c.add(copy=f"row_number() OVER (PARTITION BY {seqs} ORDER BY idx)").where("copy = 1")
    return c.sql(f"SELECT idx, {columns} FROM {{prev}}")


@_query(_default_sql(True))
def trim_default_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default order with poly-G, complexity filter and duplicates on: the good pairs."""
    chain = Pipeline(TrimOptions(polyG=True, complexity_filtration=True, pcr_dedup=True))
    return chain.good(chain.apply(read_pairs(spark, sf_dir).select(*_READS)))


@_query(_default_sql(False))
def trim_default_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Pipeline(TrimOptions(pcr_dedup=True), paired=False)
    return chain.good(chain.apply(read_pairs(spark, sf_dir).select("idx", "seq1", "qual1")))


# ---------------------------------------------------------------- files and streams


@_query(f"""WITH {_P} SELECT idx, 1 AS mate, id1 AS id, seq1 AS seq FROM p UNION ALL SELECT idx, 2 AS mate, id2 AS id, seq2 AS seq FROM p""")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastq.interleave(read_pairs(spark, sf_dir)).select("idx", "mate", "id", "seq")


@_query(f"WITH {_P} SELECT idx, id1, seq1, qual1, id2, seq2, qual2 FROM p")
def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as two FASTQ files (folders of parts, plain and gzip) and read back."""
    pairs = _pairs_in_order(spark, sf_dir)
    base = new_path(spark, "fastq")
    fastq.formatted(pairs, 1, ordered=True).write.text(f"{base}/a")
    fastq.formatted(pairs, 2, ordered=True).write.option("compression", "gzip").text(f"{base}/b")
    back = fastq.read_pairs(spark, f"{base}/a", f"{base}/b")
    return back.select("idx", "id1", "seq1", "qual1", "id2", "seq2", "qual2")


@_query(f"WITH {_P} SELECT idx, id1, seq1, qual1 FROM p")
def fastq_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as one bzip2 FASTQ (a folder of parts) and read back alone."""
    base = new_path(spark, "fastq")
    fastq.formatted(_pairs_in_order(spark, sf_dir), 1, ordered=True).write.option("compression", "bzip2").text(f"{base}/a")
    return fastq.read_single(spark, f"{base}/a").select("idx", "id1", "seq1", "qual1")


@_query(f"WITH {_P} SELECT count(*) AS mate1, count(*) FILTER (WHERE idx < 1000) AS mate2, count(*) FILTER (WHERE idx >= 1000) AS unpaired FROM p")
def fastq_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of unequal length: how many reads of either have a mate."""
    base, pairs = new_path(spark, "fastq"), _pairs_in_order(spark, sf_dir)
    fastq.formatted(pairs, 1, ordered=True).write.text(f"{base}/a")
    fastq.formatted(pairs.where("idx < 1000"), 2, ordered=True).write.text(f"{base}/b")
    return fastq.unpaired(spark, f"{base}/a", f"{base}/b").select("mate1", "mate2", "unpaired")


def _streamed(spark: SparkSession, sf_dir: str, *order: str) -> DataFrame:
    """The chain as a stream over files that have landed, duplicates by state; what it wrote."""
    landed = materialize(read_pairs(spark, sf_dir).select(*_READS), "landed")
    base = new_path(spark, "stream")
    source = spark.readStream.schema(landed.schema).parquet(landed.inputFiles()[0].rsplit("/", 1)[0])
    options = TrimOptions(order=order, clip_after_r1=60, clip_after_r2=60, pcr_dedup=True, adapter_trim=False)
    query = (
        trim_stream(source, options).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(landed.schema).parquet(f"{base}/out").select("seq1", "seq2")


@_query(f"""WITH {_P} SELECT DISTINCT substring(seq1, 1, 60) AS seq1, substring(seq2, 1, 60) AS seq2 FROM p WHERE length(seq1) >= 30""")
def stream_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, "LengthFilter", "HardClipAfter", "PCRDedup")


@_query(f"""WITH {_P}, d AS (SELECT DISTINCT seq1, seq2 FROM p) SELECT substring(seq1, 1, 60) AS seq1, substring(seq2, 1, 60) AS seq2 FROM d WHERE length(seq1) >= 30""")
def stream_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by state before the steps that cut: pairs that only become alike by the cut stay."""
    return _streamed(spark, sf_dir, "PCRDedup", "LengthFilter", "HardClipAfter")


# ---------------------------------------------------------------- simulation and scores

_RANDOM = """cast(('0x' || substr(md5(idx || ':7:{salt}'), 1, 8)) AS BIGINT)"""


@_query(f"""WITH {_P}, d AS (SELECT idx, seq1, seq2, {_RANDOM.format(salt='mate')} % 2 = 0 AS first, {_RANDOM.format(salt='length')} AS u FROM p)
SELECT idx, CASE WHEN first THEN substring(seq1, 1, cast(u % (length(seq1) + 1) AS int)) ELSE seq1 END AS seq1,
  CASE WHEN NOT first THEN substring(seq2, 1, cast(u % (length(seq2) + 1) AS int)) ELSE seq2 END AS seq2 FROM d""")
def random_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.random_trim(read_pairs(spark, sf_dir), seed=7).select("idx", "seq1", "seq2")


@_query("""SELECT cast(size AS int) AS insert_size, round(k * 0.00102::double, 6) AS error_rate, 1000 AS pairs, 1000 AS whole
FROM (SELECT unnest(range(66, 121, 2)) AS size), (SELECT unnest(range(1, 6)) AS k)""")
def simulate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulator's whole grid, 28 insert sizes and 5 error profiles, with 1,000 of its 30,000 repeats: pairs made, and those of the wanted length.

    A deletion or insertion at the very end makes a read one base shorter or longer.
    """
    head = lambda name, kind: F.regexp_extract("id1", f" {name}=([^ ]+)", 1).cast(kind)
    made = simulate.simulate(spark, repeat=1000).withColumns({"insert_size": head("INSERT_SIZE", "int"), "error_rate": F.round(head("ERROR_RATE", "double"), 6)})
    whole = [F.length(f"seq{m}").between(99, 101) & (F.length(f"seq{m}") == F.length(f"qual{m}")) for m in (1, 2)]
    return made.groupBy("insert_size", "error_rate").agg(F.count("*").alias("pairs"), F.count_if(whole[0] & whole[1]).alias("whole"))


#: Reads with a header of known truth, cut where their adapter begins give or take a base.
_HEADERS = f"""{_P}, s AS (SELECT idx, concat('@PeReadSimulator2:', cast(idx AS varchar(20)), ':1 TRUE=', cast(true_len AS varchar(20)), ' INSERT_SIZE=', cast(insert_size AS varchar(20)),
   ' ERROR_RATE=', CASE WHEN idx % 2 = 0 THEN '0.001' ELSE '0.002' END, ' SEQ_LENGTH=100 ERROR_INSERT=', cast(idx % 3 AS varchar(20)), ' ERROR_ADAPTER=0') AS id,
   substring(seq2, 1, cast(true_len + CASE WHEN idx % 11 = 0 THEN idx % 5 - 2 WHEN idx % 13 = 0 THEN 3 ELSE 0 END AS int)) AS seq, true_len, insert_size, CASE WHEN idx % 2 = 0 THEN 0.001e0 ELSE 0.002e0 END AS error_rate
  FROM p)"""


def _simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_HEADERS.replace('FROM orders', 'FROM {orders}')} SELECT idx, id, seq FROM s", orders=spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")))


_DETAIL = f"""{_HEADERS}, d AS (SELECT idx, regexp_extract(id, '^[^ ]*') AS seq_id, 100 AS seq_length, insert_size, error_rate, cast(idx % 3 AS int) AS error_insert, 0 AS error_adapter,
  cast(true_len AS int) AS true_length, cast(length(seq) AS int) AS trimmed_length, cast(true_len - length(seq) AS int) AS delta_length, true_len = length(seq) AS is_trim_successful FROM s)"""
_SUMMARY = """count(*) AS repeat, round(avg(CASE WHEN delta_length = 0 THEN 1 ELSE 0 END), 6) AS precision,
  round(avg(CASE WHEN delta_length > 0 THEN 1 ELSE 0 END), 6) AS rate_overtrim, round(avg(CASE WHEN delta_length < 0 THEN 1 ELSE 0 END), 6) AS rate_undertrim,
  coalesce(median(abs(delta_length)) FILTER (WHERE delta_length <> 0), 0.0) AS deviation, coalesce(median(delta_length) FILTER (WHERE delta_length > 0), 0.0) AS deviation_overtrim,
  coalesce(median(delta_length) FILTER (WHERE delta_length < 0), 0.0) AS deviation_undertrim, round(avg(CASE WHEN abs(delta_length) <= 1 THEN 1 ELSE 0 END), 6) AS rate_precision_in1,
  round(avg(CASE WHEN delta_length > 1 THEN 1 ELSE 0 END), 6) AS rate_overtrim_gt1, round(avg(CASE WHEN delta_length < -1 THEN 1 ELSE 0 END), 6) AS rate_undertrim_gt1"""
_RATES = ("precision", "rate_overtrim", "rate_undertrim", "rate_precision_in1", "rate_overtrim_gt1", "rate_undertrim_gt1")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in _RATES})


@_query(f"WITH {_DETAIL} SELECT * FROM d")
def readstat_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.detail(_simulated(spark, sf_dir))


@_query(f"WITH {_DETAIL} SELECT seq_length, insert_size, error_rate, {_SUMMARY} FROM d GROUP BY seq_length, insert_size, error_rate")
def readstat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.summary(stats.detail(_simulated(spark, sf_dir))))


@_query(f"""WITH {_DETAIL}, c AS (SELECT *, seq_length + insert_size // 41 AS g FROM d),
n AS (SELECT *, CASE WHEN g IS DISTINCT FROM lag(g) OVER (ORDER BY idx) OR lag(idx) OVER (ORDER BY idx) IS NULL THEN 1 ELSE 0 END AS new FROM c),
r AS (SELECT *, sum(new) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT cast(run AS BIGINT) AS run, cast(g AS BIGINT) AS g, count(*) AS n, cast(sum(delta_length) AS BIGINT) AS delta FROM r GROUP BY run, g""")
def readstat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring reads with equal keys, told apart block by block."""
    d = stats.detail(_simulated(spark, sf_dir)).withColumn("g", (F.col("seq_length") + F.floor(F.col("insert_size") / 41)).cast("long"))
    runs = stats.with_runs(d, "idx", ("g",), block=1 << 12)
    return runs.groupBy("run", "g").agg(F.count("*").alias("n"), F.sum("delta_length").alias("delta"))


@_query(f"""WITH {_HEADERS}, t AS (SELECT true_len AS t, CASE WHEN idx % 17 <> 0 THEN length(seq) END AS m FROM s),
c AS (SELECT count(*) FILTER (WHERE (m IS NULL AND t = 0) OR (m = t AND t <> 100)) AS TP, count(*) FILTER (WHERE t = 100 AND (m IS NULL OR t > m)) AS FP_ft,
  count(*) FILTER (WHERE t <> 100 AND t <> 0 AND (m IS NULL OR t > m)) AS FP_ot, count(*) FILTER (WHERE t < m AND m = 100) AS FN_fr, count(*) FILTER (WHERE t < m AND m <> 100) AS FN_ut,
  count(*) FILTER (WHERE m = t AND t = 100) AS TN FROM t)
SELECT *, round(TP / (TP + FP_ft + FP_ot + FN_ut), 6) AS PPV, round(TP / (TP + FN_fr + FP_ot + FN_ut), 6) AS Sen, round(TN / (TN + FP_ft), 6) AS Spec,
  round((TP * TN - (FP_ft + FP_ot) * (FN_fr + FN_ut)) / sqrt((TP + FP_ft + FP_ot)::double * (TP + FN_fr + FN_ut) * (TN + FP_ft + FP_ot) * (TN + FN_fr + FN_ut)), 6) AS mCC,
  round(1 - TN / (TN + FP_ft), 6) AS FPR FROM c""")
def trim_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.detail(_simulated(spark, sf_dir))
    truth, trimmed = d.select("idx", F.col("true_length").alias("length")), d.where("idx % 17 <> 0").select("idx", "trimmed_length")
    out = stats.confusion(truth, trimmed, 100, "idx")
    return out.withColumns({c: F.round(c, 6) for c in ("PPV", "Sen", "Spec", "mCC", "FPR")})


_FILES = f"{_DETAIL}, e AS (SELECT CASE WHEN insert_size % 2 = 0 THEN 'a' ELSE 'b' END AS file, seq_length, insert_size, error_rate, {_SUMMARY} FROM d GROUP BY ALL), x AS (SELECT *, seq_length > insert_size AS has_adapter FROM e)"


def _stat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readstat_summary(spark, sf_dir).withColumn("file", F.when(F.col("insert_size") % 2 == 0, "a").otherwise("b"))


@_query(f"""WITH {_FILES}, m AS (SELECT file, has_adapter, avg(precision) AS "Accurate Trim", avg(rate_overtrim) - avg(rate_overtrim_gt1) AS "Over Trim = 1 bp",
  avg(rate_undertrim) - avg(rate_undertrim_gt1) AS "Under Trim = 1 bp", avg(rate_overtrim_gt1) AS "Over Trim > 1 bp", avg(rate_undertrim_gt1) AS "Under Trim > 1 bp" FROM x GROUP BY ALL)
SELECT file, has_adapter, name, round(value, 5) AS value FROM (UNPIVOT m ON "Accurate Trim", "Over Trim = 1 bp", "Under Trim = 1 bp", "Over Trim > 1 bp", "Under Trim > 1 bp" INTO NAME name VALUE value)""")
def stats_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.plot_rates(_stat_files(spark, sf_dir)).withColumn("value", F.round("value", 5))


@_query(f"WITH {_FILES} SELECT file, has_adapter, error_rate, round(avg(precision), 5) AS accurate, round(avg(rate_precision_in1), 5) AS accurate_1bp FROM x GROUP BY ALL")
def stats_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.plot_accuracy(_stat_files(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("accurate", "accurate_1bp")})


@_query(f"""WITH {_FILES} SELECT file, insert_size, round(avg(deviation), 5) AS deviation, round(avg(deviation_overtrim), 5) AS deviation_overtrim,
  round(avg(-deviation_undertrim), 5) AS deviation_undertrim FROM x GROUP BY file, insert_size""")
def stats_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.plot_deviation(_stat_files(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("deviation", "deviation_overtrim", "deviation_undertrim")})


@_query(f"WITH {_FILES} SELECT insert_size, round(avg(precision), 5) AS precision_mean, round(stddev_samp(precision), 5) AS precision_std FROM x GROUP BY insert_size")
def replicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spread(_stat_files(spark, sf_dir), ["insert_size"], ["precision"]).withColumns({c: F.round(c, 5) for c in ("precision_mean", "precision_std")})


@_query("""SELECT n_nationkey % 4 + 1 AS Threads, concat('trim -t ', n_nationkey % 4 + 1, ' ', n_name) AS Command, round(1e9 / (60.0 + n_nationkey) / 1e6, 6) AS Speed,
  round(1e9 / (60.0 + n_nationkey) / 1e6 / ((100.5 + n_nationkey + 2.25) / (60.0 + n_nationkey)), 6) AS Efficiency, cast(100.5 + n_nationkey AS double) AS UserTime, 2.25::double AS SystemTime,
  round((100.5 + n_nationkey + 2.25) / (60.0 + n_nationkey), 6) AS CPU, cast(60.0 + n_nationkey AS double) AS ElapsedTime, cast(1000 + n_nationkey AS BIGINT) AS MaxMemory FROM nation""")
def time_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    runs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        text("trim -t ", (n % 4 + 1).cast("string"), " ", F.col("n_name")).alias("command"),
        F.array(
            text("\tUser time (seconds): ", (n + 100.5).cast("string")), F.lit("\tSystem time (seconds): 2.25"), F.lit("\tPercent of CPU this job got: 180%"),
            text("\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:", F.lpad(n.cast("string"), 2, "0"), ".00"),
            text("\tMaximum resident set size (kbytes): ", (n + 1000).cast("string")),
        ).alias("lines"),
    )
    out = stats.time_table(runs, 1_000_000_000)
    return out.withColumns({c: F.round(c, 6) for c in ("Speed", "CPU", "Efficiency")})
