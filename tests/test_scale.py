"""What the reading, writing and making of reads may cost: records are exchanged as text of whole groups, keys are sorted instead of reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from reads import mate, random_reads

from readtrim import queries
from readtrim.functions import exprs, kernels
from readtrim.sources import fastq

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk, group", [(1, 1), (70, 3), (1 << 16, 7)])
def test_reads_come_back_whole_whatever_the_chunks_and_groups(spark, tmp_path, monkeypatch, chunk, group):
    monkeypatch.setattr(fastq, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(fastq, "GROUP", group, raising=False)
    rng = np.random.default_rng(5)
    reads = [(f"@ä{k}", s, "@" * len(s)) for k, s in enumerate(random_reads(rng, 60, 0, 90))]
    for name, rows in (("a.fq", reads), ("b.fq", reads[:41])):
        (tmp_path / name).write_text("".join(f"{i}\n{s}\n+\n{q}\n" for i, s, q in rows) + "\n" * (name == "b.fq"))
    a, b = str(tmp_path / "a.fq"), str(tmp_path / "b.fq")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        single, pairs = fastq.read_single(spark, a), fastq.read_pairs(spark, a, b)
        assert [tuple(r) for r in single.orderBy("idx").select("idx", "id1", "seq1", "qual1").collect()] == [(k, *r) for k, r in enumerate(reads)]
        assert [(r.idx, r.id1, r.seq2) for r in pairs.orderBy("idx").collect()] == [(k, r[0], r[1]) for k, r in enumerate(reads[:41])]
        assert fastq.read_single(spark, a, first_reads=10).count() == 10
        assert [tuple(r) for r in fastq.unpaired(spark, a, b).collect()] == [("a", 60, 41, 19)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # the exchange moves text of whole groups: no line is sorted or aggregated by itself
    assert "FlatMapGroupsInArrow" in plan(single) and "Aggregate" not in plan(single) + plan(pairs)


def test_files_are_written_in_order_without_moving_reads(spark):
    ordered = fastq.formatted(queries._pairs_in_order(spark, SF), 2, ordered=True)
    steps = plan(ordered).split("Final Plan")[-1]
    assert steps.count("Exchange rangepartitioning") == 1 and steps.index("MapInArrow") < steps.index("Exchange")  # below it: keys only
    heads = [int(r.value.split("\n")[0].split(":")[1].split(" ")[0]) // 50 for r in ordered.collect()]
    assert heads == [k // 50 for k in range(1500)]


def test_made_reads_are_those_of_the_sql(spark):
    odd = spark.range(-300, 300).selectExpr("if(id % 97 = 5, null, id) o_orderkey", "if(id % 89 = 7, null, id * 71 - 900) o_custkey")
    from readtrim import pair_reads

    made, wanted = pair_reads.read_pairs(odd), spark.sql(queries.PAIRS_SQL, orders=odd)
    assert made.columns == wanted.columns and [f.dataType for f in made.schema] == [f.dataType for f in wanted.schema]
    assert sorted(map(str, made.collect())) == sorted(map(str, wanted.collect()))


def test_complexity_of_every_letter_is_the_kernels(spark):
    seqs = random_reads(np.random.default_rng(6), 200, 0, 70, "ACGTUNRYSWKMBDHVacgtunryswkmbdhv-")
    df = spark.createDataFrame(list(enumerate(seqs)), "idx long, s string").orderBy("idx")
    assert np.allclose([r.c for r in df.select(exprs.complexity(F.col("s")).alias("c")).collect()], kernels.complexity(mate(*seqs)), equal_nan=True)
    lambdas = queries.complexity_filter(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in lambdas  # no look-up of bases one by one


def test_counting_unpaired_reads_keeps_no_text(spark, tmp_path, monkeypatch):
    kept = []
    write = fastq.materialize
    monkeypatch.setattr(fastq, "materialize", lambda df, *a, **o: kept.append(df.columns) or write(df, *a, **o))
    (tmp_path / "a.fq").write_text("@r\nAC\n+\nII\n" * 3)
    assert fastq.unpaired(spark, str(tmp_path / "a.fq"), str(tmp_path / "a.fq")).first().mate2 == 3
    assert kept and not {"value", "text"} & {c for columns in kept for c in columns}


def test_digests_are_md5():
    from hashlib import md5

    from readtrim.pair_reads import digests

    keys = np.array([0, 7, -3, 10**12, 2**63 - 1, -(2**63)])
    expected = [b"".join(md5(f"{k}:{j}".encode()).digest() for j in range(10)) for k in keys.tolist()]
    assert [bytes(r) for r in digests(keys)] == expected
