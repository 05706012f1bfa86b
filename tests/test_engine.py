"""Chains, files, duplicates, detection, simulation, scores, streams and the command line on small data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from reads import random_reads

from readtrim import cli
from readtrim.functions import exprs
from readtrim.operators import dedup, detect, simulate, stats
from readtrim.plans.options import ADAPTER1, ADAPTER2, TrimOptions, length_range, quality_offset
from readtrim.plans.pipeline import Pipeline, explain
from readtrim.sources import fastq
from readtrim.streaming.trim import fastq_folder, trim_folder

SCHEMA = "idx long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string"


def frame(spark, seqs1, seqs2, quals1=None, quals2=None):
    q1, q2 = quals1 or ["I" * len(s) for s in seqs1], quals2 or ["I" * len(s) for s in seqs2]
    rows = [(k, f"@r{k} 1", a, p, f"@r{k} 2", b, q) for k, (a, p, b, q) in enumerate(zip(seqs1, q1, seqs2, q2, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def reads(spark):
    rng = np.random.default_rng(9)
    quals = ["".join(chr(int(c)) for c in rng.integers(33, 74, n)) for n in rng.integers(0, 70, 300)]
    seqs = ["".join(rng.choice(list("ACGTN"), len(q))) + "" for q in quals]
    seqs = [s[: len(s) // 2] + "N" * (len(s) - len(s) // 2) if k % 5 == 0 else s for k, s in enumerate(seqs)]
    return frame(spark, seqs, seqs[::-1], quals, quals[::-1]).cache()


@pytest.mark.parametrize(
    "options",
    [
        dict(order=("HardClipEnd", "HardClipAfter", "HardClipFront"), clip3_r1=5, clip3_r2=7, clip_after_r1=30, clip_after_r2=20, clip5_r1=2, clip5_r2=3),
        dict(order=("TailNTrim",)),
        dict(order=("TailNTrim", "LengthFilter", "MaxNFilter", "HardClipFrontR1"), adapter_trim=False, length_range="10:50", max_n=3, clip5_r1=4),
    ],
)
def test_projection_and_arrow_pass_agree(reads, options):
    chain = Pipeline(TrimOptions(**options))
    assert all(s.expr is not None for s in chain.steps)
    a = chain.apply(reads)
    chain2 = Pipeline(TrimOptions(**options))
    for s in chain2.steps:
        s.expr = None
    b = chain2.apply(reads)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_complexity_and_n_expressions_agree_with_kernels(spark):
    from reads import mate

    from readtrim.functions import kernels

    rng = np.random.default_rng(4)
    seqs = random_reads(rng, 200, 0, 50, "AACGTN")
    got = frame(spark, seqs, seqs).orderBy("idx").select(exprs.complexity(F.col("seq1")).alias("c"), exprs.count_n(F.col("seq1")).alias("n")).collect()
    m = mate(*seqs)
    assert np.allclose([r.c for r in got], kernels.complexity(m), equal_nan=True) and np.allclose([r.n for r in got], kernels.count_n(m))


def test_dropped_reads_are_left_alone_and_counted_once(spark):
    df = frame(spark, ["ACGT" * 10, "AC", "A" * 40], ["ACGT" * 10, "ACGT" * 10, "ACGT" * 10])
    chain = Pipeline(TrimOptions(order=("LengthFilter", "HardClipAfter", "ComplexityFilter", "LengthFilter"), clip_after_r1=35, clip_after_r2=35, adapter_trim=False, complexity_filtration=True))
    rows = {r.idx: r for r in chain.apply(df).collect()}
    assert [rows[k].drop_reason for k in range(3)] == [None, "LengthFilter", "ComplexityFilter"]
    assert rows[1].seq2 == "ACGT" * 10 and rows[0].seq1 == ("ACGT" * 10)[:35]
    report = chain.report(chain.apply(df)).first()
    assert (report.total, report.good, report.length_filtered_r1, report.length_filtered_r2, report.complexity_filtered_r1, report.hard_clip_after_r1) == (3, 1, 1, 1, 1, 2)
    assert [c for c in chain.good(chain.apply(df)).columns] == df.columns


def test_stages_are_one_pass_between_barriers():
    plan = explain(TrimOptions(pcr_dedup=True, check_identifier=True))
    assert plan == ["projection: CheckIdentifier", "arrow: LengthFilter, AdapterTrim, QualityTrim, TailNTrim, MaxNFilter, LengthFilter", "shuffle: PCRDedup"]
    with pytest.raises(ValueError, match="unknown step"):
        Pipeline(TrimOptions(order=("Nope",)))


def test_identifier_check_stops_the_run(spark):
    df = frame(spark, ["ACGT"], ["ACGT"]).withColumn("id2", F.lit("@other 2"))
    chain = Pipeline(TrimOptions(order=("CheckIdentifier",), check_identifier=True))
    for use in (lambda d: d.collect(), lambda d: chain.report(d).collect()):
        with pytest.raises(Exception, match="identifiers differ"):
            use(chain.apply(df))
    same = {("@a 1", "@a 2"): True, ("@a/1", "@a/2"): True, ("@a 1", "@b 2"): False, ("@a", "@a"): True, ("@a", "@ab"): False, ("@a 1", "@ab"): True}
    got = spark.createDataFrame(list(same), "a string, b string").select("a", "b", exprs.same_identifier(F.col("a"), F.col("b")).alias("s")).collect()
    assert {(r.a, r.b): r.s for r in got} == same


def test_options_are_checked():
    assert quality_offset("solexa") == 64 and length_range("1:2") == (1, 2)
    for bad in (dict(adapter1=("XYZ!",)), dict(kmer_tolerance=16), dict(min_complexity=0.9), dict(quality_format="nope"), dict(length_range="9"), dict(poly_length=0), dict(trim_score_pe=33)):
        with pytest.raises(ValueError):
            TrimOptions(**bad)
    with pytest.raises(ValueError, match="as many adapters"):
        Pipeline(TrimOptions(adapter1=(ADAPTER1, ADAPTER1)))


def test_wrong_quality_format_is_an_error(spark):
    with pytest.raises(Exception, match="wrong quality format"):
        Pipeline(TrimOptions(quality_format="64")).apply(frame(spark, ["ACGT" * 20], ["ACGT" * 20], ["#" * 80], ["#" * 80])).collect()


def test_dedup_keeps_the_first_and_counts(spark):
    df = frame(spark, ["A", "A", "C", "A", "C"], ["T", "T", "T", "G", "T"])
    assert sorted(r.idx for r in dedup.dedup(df).collect()) == [0, 2, 3]
    assert sorted((r["count"], r.id) for r in dedup.counts(df).collect()) == [(2, "@r0 1"), (2, "@r2 1")]
    assert tuple(dedup.totals(df).first()) == (4, 2)
    plan = dedup.dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # duplicates go before the shuffle, too
    marked = dedup.mark(df, F.col("idx") != 0)
    assert sorted((r.idx, r.duplicate) for r in marked.collect()) == [(0, False), (1, False), (2, False), (3, False), (4, True)]
    assert dedup.dedup(df.where("false")).count() == 0 and tuple(dedup.totals(df.where("false")).first()) == (0, 0)


def test_lossy_keys_collide_as_described(spark):
    key = lambda s: spark.createDataFrame([(s,)], "s string").select(dedup.lossy_key(F.col("s"))).first()[0]
    assert key("AN") == key("GN") and key("NA") == key("AN") and key("ACA") == key("ACG") and key("AC") != key("AG")
    df = frame(spark, ["AN", "GN", "GN", "AC"], ["A"] * 4).select("idx", "seq1", "seq2")
    found = dedup.collisions(df, dedup.lossy_key(F.col("seq1"))).collect()
    assert len(found) == 1 and [s.seq1 for s in found[0].sequences] == ["AN", "GN"]


# ---------------------------------------------------------------- files


@pytest.mark.parametrize("ending", ["", ".gz", ".bz2"])
def test_fastq_round_trip(spark, tmp_path, ending):
    import bz2
    import gzip

    rows = [(f"@r{k} x", "ACGTN"[: k % 6] or "", "@IIII"[: k % 6]) for k in range(1, 400) if k % 6]
    text = "".join(f"{i}\n{s}\n+\n{q}\n" for i, s, q in rows)
    data = text.encode()
    path = tmp_path / f"a.R1.fastq{ending}"
    path.write_bytes(gzip.compress(data) if ending == ".gz" else bz2.compress(data) if ending == ".bz2" else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")  # records cross blocks
    try:
        got = fastq.read_single(spark, str(path)).orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.idx, r.id1, r.seq1, r.qual1) for r in got] == [(k, *x) for k, x in enumerate(rows)]
    assert got[0].sample == "a.R1"
    out = str(tmp_path / "out")
    fastq.write_fastq(fastq.read_single(spark, str(path)), out, 1, fastq.codec(str(path)))
    back = "".join(r.value + "\n" for r in spark.read.text(sorted(str(p) for p in (tmp_path / "out").glob("part*"))).collect())
    assert sorted(back.split("\n")) == sorted(text.split("\n"))


def test_folders_of_parts_are_one_file(spark, tmp_path):
    df = frame(spark, ["ACGT"[: k % 4 + 1] for k in range(500)], ["A"] * 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fastq.write_fastq(df, str(tmp_path / "x.fastq"), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "x.fastq").glob("part*"))) > 1
    got = fastq.read_single(spark, str(tmp_path / "x.fastq")).orderBy("idx").collect()
    assert [(r.sample, r.idx, r.id1) for r in got] == [("x", k, f"@r{k} 1") for k in range(500)]


def test_other_splits_later_lose_no_line(spark, tmp_path):
    """Spark may cut the files differently from one job to the next, as executors come and go."""
    n = 60_000
    (tmp_path / "x.fq").write_text("".join(f"@r{k}\nACGT\n+\nIIII\n" for k in range(n)))
    name = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(name, "4")
        reads = fastq.read_single(spark, str(tmp_path / "x.fq"))
        pairs = fastq.read_pairs(spark, str(tmp_path / "x.fq"), str(tmp_path / "x.fq"))
        spark.conf.set(name, "7")
        assert reads.where("id1 = concat('@r', idx)").count() == n
        spark.conf.set(name, "2")
        assert pairs.where("id2 = concat('@r', idx)").count() == n
    finally:
        spark.conf.unset(name)


def test_parts_joined_to_one_file(spark, tmp_path):
    import gzip

    df = frame(spark, ["ACGT"] * 300, ["A"] * 300).repartition(5)
    for codec, ending in (("none", ""), ("gzip", ".gz")):
        fastq.write_fastq(df, str(tmp_path / f"parts{ending}"), 1, codec)
        fastq.join_parts(spark, str(tmp_path / f"parts{ending}"), str(tmp_path / f"x.fq{ending}"))
        raw = (tmp_path / f"x.fq{ending}").read_bytes()
        lines = (gzip.decompress(raw) if ending else raw).decode().splitlines()
        assert lines[::4] == [f"@r{k} 1" for k in range(300)]
        assert fastq.read_single(spark, str(tmp_path / f"x.fq{ending}")).count() == 300


def test_pairs_of_several_samples_and_unequal_files(spark, tmp_path):
    def put(name, n, mate):
        (tmp_path / name).write_text("".join(f"@{name}.{k} {mate}\nACGT\n+\nIIII\n" for k in range(n)))
        return str(tmp_path / name)

    a1, a2, b1, b2 = put("a_1.fq", 5, 1), put("a_2.fq", 5, 2), put("b_1.fq", 4, 1), put("b_2.fq", 3, 2)
    pairs = fastq.read_pairs(spark, [a1, b1], [a2, b2])
    assert sorted((r.sample, r.idx, r.id1, r.id2) for r in pairs.collect()) == [
        *[("a_1", k, f"@a_1.fq.{k} 1", f"@a_2.fq.{k} 2") for k in range(5)], *[("b_1", k, f"@b_1.fq.{k} 1", f"@b_2.fq.{k} 2") for k in range(3)]
    ]
    assert sorted(map(tuple, fastq.unpaired(spark, [a1, b1], [a2, b2]).collect())) == [("a_1", 5, 5, 0), ("b_1", 4, 3, 1)]
    assert fastq.read_pairs(spark, [a1, b1], ["file://" + a2, b2], first_reads=2).count() == 4
    assert fastq.read_pairs(spark, a1, a1).where("id1 = id2").count() == 5  # one file as both mates
    with pytest.raises(ValueError, match="no reads"):
        fastq.read_pairs(spark, a1, put("empty.fq", 0, 2))
    with pytest.raises(ValueError, match="empty input"):
        fastq.read_single(spark, put("none.fq", 0, 1))
    (tmp_path / "blank.fq").write_text("@a\nACGT\n+\nIIII\n\n\n")
    assert fastq.read_single(spark, str(tmp_path / "blank.fq")).count() == 1
    assert fastq.read_pairs(spark, str(tmp_path / "blank.fq"), str(tmp_path / "blank.fq")).count() == 1
    (tmp_path / "hole.fq").write_text("@a\nACGT\n+\nIIII\n\n@b\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        fastq.read_single(spark, str(tmp_path / "hole.fq")).collect()
    broken = tmp_path / "broken.fq"
    broken.write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        fastq.read_single(spark, str(broken)).collect()


def test_empty_reads_are_written_as_one_n(spark):
    df = frame(spark, ["", "AC"], ["A", "A"])
    assert sorted(r.value for r in fastq.formatted(df).collect()) == ["@r0 1\nN\n+\n!", "@r1 1\nAC\n+\nII"]


def test_alignment_lengths(spark, tmp_path):
    (tmp_path / "x.aln").write_text("##header\n>chr1\tread-1\t10\t+\nACG-T\nAC-GT\n>chr1\tread-2\t11\t-\nACGT\nA--T\n")
    assert sorted(map(tuple, fastq.read_aln_lengths(spark, str(tmp_path / "x.aln")).collect())) == [("read-1", 4), ("read-2", 2)]


# ---------------------------------------------------------------- adapters


def test_known_adapters_are_counted_like_single_scans(spark):
    rng = np.random.default_rng(8)
    seqs = ["".join(rng.choice(list("ACGT"), 40)) + ADAPTER1[:20] for _ in range(30)] + ["".join(rng.choice(list("ACGT"), 60)) for _ in range(30)]
    counts = detect.count_known(frame(spark, seqs, seqs))
    top = detect.top_known(counts).collect()
    assert len(top) == 5 and top[0].adapter == "AGATCGGAAGAGCACA" and top[0]["count"] == 30 and top[0].identity == 1.0
    assert detect.found_known(counts, 60).first().adapter == "AGATCGGAAGAGCACA"
    nothing = detect.count_known(frame(spark, ["ACGT"], ["ACGT"]))
    assert detect.found_known(nothing.where("count < 0"), 1).count() == 0 and np.isnan(nothing.first().identity)


def test_unknown_adapters_are_found_behind_the_overlap(spark):
    pairs = simulate.simulate(spark, range(40, 96, 5), 12, adapter1="CTGTCTCTTATACACATCTGACGC", adapter2="GACTTGACCAGTTGACTCATGCAT", seed=3)
    found = {r.mate: r for r in detect.detect_pairs(pairs).where("rank = 1").collect()}
    assert found[1].adapter == "CTGTCTCTTATACACA" and found[2].adapter == "GACTTGACCAGTTGAC" and found[1].identity > 0.99
    files = spark.createDataFrame([("", "a", "b"), ("none", "c", "d")], "sample string, r1 string, r2 string")
    rows = {r.r1: r for r in detect.summary(detect.detect_pairs(pairs), files).collect()}
    assert rows["a"].best_adapter1 == "CTGTCTCTTATACACA" and rows["c"].best_adapter2 == "" and np.isnan(rows["c"].occurance1)


def test_prefixes_flow_to_longer_adapters():
    row = lambda a, o: {"adapter": a, "occurance": o, "identity": 1.0, "adapter_start_position": 10.0}
    long1, long2 = "ACGTACGTACGTACGT", "ACGTACGTACGTAAAA"
    out = {r["adapter"]: r["occurance"] for r in detect.merge_prefixes([row(long1, 0.4), row(long2, 0.2), row("ACG", 0.1), row("TT", 0.05)])}
    assert out == {long1: pytest.approx(0.45), long2: pytest.approx(0.25), "TT": 0.05}
    assert {r["adapter"] for r in detect.merge_prefixes([row("AN", 0.1), row("ACG", 0.1)])} == {"ACG"}


# ---------------------------------------------------------------- simulation and scores


def test_simulation_is_a_function_of_seed_and_truth_holds(spark):
    clean = dict(insert_sizes=[0, 40, 100, 150], repeat=10, substitution=(0.0,), insertion=(0.0,), deletion=(0.0,))
    a = simulate.simulate(spark, seed=1, **clean)
    b = simulate.simulate(spark, seed=1, **clean).repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for r in a.collect():
        size = min(100, [0, 40, 100, 150][r.idx // 10])
        assert f" TRUE={size} " in r.id1 and len(r.seq1) == len(r.seq2) == 100
        assert r.seq1[size : size + 20] == ADAPTER1[: max(min(20, 100 - size), 0)]
    noisy = stats.detail(fastq.interleave(simulate.simulate(spark, [60], 50, substitution=(0.1,), insertion=(0.05,), deletion=(0.05,))))
    assert noisy.where("error_insert > 0").count() > 90 and noisy.where("seq_length = 100 and trimmed_length >= 99").count() == 100
    with pytest.raises(ValueError):
        simulate.simulate(spark, substitution=(0.5,), insertion=(0.4,), deletion=(0.2,))


def test_trimming_simulated_reads_finds_their_truth(spark):
    pairs = simulate.simulate(spark, range(66, 121, 6), 20, seed=5)
    chain = Pipeline(TrimOptions(order=("AdapterTrim",)))
    both = fastq.interleave(chain.good(chain.apply(pairs)))
    scored = stats.detail(both.select("id", "seq"))
    assert scored.where("abs(delta_length) <= 1").count() / scored.count() > 0.97
    again = chain.good(chain.apply(chain.good(chain.apply(pairs))))
    assert again.count() == pairs.count()


def test_random_trim_keeps_truth_in_step(spark):
    pairs = simulate.simulate(spark, [50], 40, seed=2)
    out = {r.idx: r for r in simulate.random_trim(pairs, 1).collect()}
    for r in pairs.collect():
        n = out[r.idx]
        assert (n.seq1 == r.seq1) != (n.seq2 == r.seq2) or (n.seq1, n.seq2) == (r.seq1, r.seq2)
        for m in (1, 2):
            true = int(n[f"id{m}"].split(" TRUE=")[1].split(" ")[0])
            assert len(n[f"seq{m}"]) == len(n[f"qual{m}"]) and (len(n[f"seq{m}"]) >= true or len(n[f"seq{m}"]) == 0 == true)


def test_runs_cross_blocks(spark):
    keys = [1, 1, 2, 2, 2, 1, 3, 3, None, None, 1, 1, 1, 1, 1, 1, 1, 2]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(keys)], "ord long, k int").repartition(5)
    expected, run = [], 0
    for k, v in enumerate(keys):
        run += k == 0 or v != keys[k - 1]
        expected.append(run)
    for block in (1, 2, 3, 100):
        assert [r.run for r in stats.with_runs(df, "ord", ("k",), block).orderBy("ord").collect()] == expected


def test_summary_by_hand(spark):
    head = "@PeReadSimulator2:1:1 TRUE={t} INSERT_SIZE=50 ERROR_RATE=0.001 SEQ_LENGTH=100 ERROR_INSERT=0 ERROR_ADAPTER=0 SUB=0 INS=0 DEL=0"
    rows = [(head.format(t=4), "ACGT"), (head.format(t=5), "ACGT"), (head.format(t=8), "ACGT"), (head.format(t=1), "ACGT"), (head.format(t=0), "N")]
    s = stats.summary(stats.detail(spark.createDataFrame(rows, "id string, seq string"))).first()
    assert (s.repeat, s.precision, s.rate_overtrim, s.rate_undertrim) == (5, 0.4, 0.4, 0.2)
    assert (s.deviation, s.deviation_overtrim, s.deviation_undertrim, s.rate_precision_in1) == (3.0, 2.5, -3.0, 0.6)
    with pytest.raises(Exception, match="no simulated read"):
        stats.detail(spark.createDataFrame([("@x", "A")], "id string, seq string")).collect()


def test_confusion_by_hand(spark):
    truth = spark.createDataFrame([("a", 100), ("b", 50), ("c", 50), ("d", 50), ("e", 100), ("f", 0), ("g", 60)], "id string, length int")
    cut = spark.createDataFrame([("a", 100), ("b", 50), ("c", 100), ("d", 60), ("e", 90)], "id string, trimmed_length int")
    r = stats.confusion(truth, cut, 100).first()
    assert (r.TN, r.TP, r.FN_fr, r.FN_ut, r.FP_ft, r.FP_ot) == (1, 2, 1, 1, 1, 1)


def test_times_and_replicates(spark):
    got = spark.createDataFrame([("90%",), ("1:02:03.5",), ("2:00",), ("7.25",), ("1:00:00:00",)], "t string").select(stats.seconds(F.col("t"))).collect()
    assert [r[0] for r in got] == [0.9, 3723.5, 120.0, 7.25, 86400.0]
    assert stats.mean_and_deviation([1.0, 2.0, 4.0]) == "2.3 ± 1.5"
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 4.0), ("y", 100.0), ("y", 200.0)], "k string, v double")
    assert {r.k: r.v for r in stats.replicates(df, ["k"], ["v"]).collect()} == {"x": "2.3 ± 1.5", "y": "150 ± 71"}


def test_replicated_files_cell_by_cell(spark, tmp_path):
    for k, (v, t) in enumerate(((1.0, "1:00"), (2.0, "2:00"), (4.0, "3:00"))):
        (tmp_path / f"r{k}.txt").write_text(f"name\tvalue\nx\t{v}\ntime\t{t}\n")
    got = {(r.line, r.cell): r.text for r in stats.replicate_cells(stats.cells(spark, [str(tmp_path / f"r{k}.txt") for k in range(3)])).collect()}
    assert got == {(0, 0): "name", (0, 1): "value", (1, 0): "x", (1, 1): "2.3 ± 1.5", (2, 0): "time", (2, 1): "120 ± 60"}


def test_sql_functions_are_the_kernels(spark):
    from readtrim.functions import sql

    sql.register(spark)
    rng = np.random.default_rng(3)
    seqs = [s + ADAPTER1 if k % 2 else s for k, s in enumerate(random_reads(rng, 40, 0, 50, "ACGTN"))] + ["ACGT" + "G" * 12, None]
    spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "k int, seq string").createOrReplaceTempView("sql_reads")
    rows = spark.sql(
        f"SELECT seq, read_adapter(seq, '{ADAPTER1}', 2) a, read_poly_tail(seq, 'G', 2) g, read_complexity(seq) c, read_count_n(seq) n, read_revcomp(seq) r,"
        " read_quality_keep(repeat('#', length(seq)), 20, 5) q FROM sql_reads ORDER BY k"
    ).collect()
    assert rows[1].a.n == 16 and rows[-2].g == (5, 12) and rows[-1].r == "" and rows[0].q == 0
    from reads import rc

    assert all(r.r == rc(r.seq) for r in rows if r.seq is not None)


# ---------------------------------------------------------------- streams and command line


def test_folder_stream_trims_new_files_once(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    options = TrimOptions(pcr_dedup=True)
    pairs = simulate.simulate(spark, [60, 120], 20, substitution=(0.0,), insertion=(0.0,), deletion=(0.0,))
    pairs.write.parquet(src)
    trim_folder(spark, src, out, log, options)
    chain = Pipeline(options)
    expected = sorted((r.seq1, r.seq2) for r in chain.good(chain.apply(pairs)).collect())
    assert sorted((r.seq1, r.seq2) for r in spark.read.parquet(out).collect()) == expected
    pairs.write.mode("append").parquet(src)  # all duplicates
    trim_folder(spark, src, out, log, options)
    assert spark.read.parquet(out).count() == len(expected)


def test_mates_on_two_streams_are_paired(spark, tmp_path):
    from readtrim.streaming.trim import pair_streams

    one = spark.createDataFrame([("s", k, f"@{k}", "ACGT", "+", "IIII") for k in range(6)], "sample string, idx long, id1 string, seq1 string, des1 string, qual1 string")
    two = one.select("sample", "idx", *[F.col(f"{c}1").alias(f"{c}2") for c in ("id", "seq", "des", "qual")]).where("idx <> 2")
    for m, df in ((1, one), (2, two)):
        df.write.parquet(str(tmp_path / f"m{m}"))
    streams = [spark.readStream.schema(df.schema).parquet(str(tmp_path / f"m{m}")) for m, df in ((1, one), (2, two))]
    query = (
        pair_streams(*streams).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 3, 4, 5]


def test_small_expressions(spark):
    row = spark.createDataFrame([("ACGTN", "TGCAN", "I+!", "ACG!")], "a string, b string, q string, x string").select(
        exprs.is_complement(F.col("a"), F.col("b")).alias("c"), exprs.n_to_gap(F.col("a")).alias("g"), exprs.is_dna(F.col("a")).alias("d"), exprs.is_dna(F.col("x")).alias("e"),
        exprs.bits(F.col("a")).alias("bits"), exprs.probability_sum(F.col("q")).alias("s"), exprs.mean_probability(F.col("q"), 3, F.lit(9)).alias("m"),
        exprs.mean_probability(F.col("q"), 5).alias("n"),
    ).first()
    assert (row.c, row.g, row.d, row.e, row.bits) == (True, "ACGT-", True, False, "1111 1000 0100 0010 0001")
    assert row.s == pytest.approx(1 - 1e-4 + 0.9 + 0) and row.m == 0 and row.n == 0


def test_fastq_folder_hands_over_new_files(spark, tmp_path):
    src = tmp_path / "land"
    src.mkdir()
    (src / "a.fq").write_text("@a\nA\n+\nI\n")
    seen = []
    handle = lambda files, batch: seen.extend(r.path.rsplit("/", 1)[-1] for r in files.collect())
    fastq_folder(spark, str(src), str(tmp_path / "log"), handle)
    (src / "b.fq").write_text("@b\nA\n+\nI\n")
    fastq_folder(spark, str(src), str(tmp_path / "log"), handle)
    assert seen == ["a.fq", "b.fq"]


def test_command_line_end_to_end(spark, tmp_path, monkeypatch, capsys):
    base = str(tmp_path / "s")
    assert cli.main(["simulate", "-o", base, "--insert-sizes", "60", "110", "--repeat", "15", "--substitution-rate", "0.001", "--insertion-rate", "1e-5", "--deletion-rate", "1e-5"]) == 0
    r1, r2, out = base + ".R1.fastq", base + ".R2.fastq", str(tmp_path / "out")
    assert cli.main(["trim", "-r", r1, "-R", r2, "-o", out, "--pcr-dedup", "--pcr-dedup-count", "--collisions", "--check-identifier", "-g", "GZ"]) == 0
    report = json.loads((tmp_path / "out" / "s.R1.trimmed.log.json").read_text())
    assert report["trimming-details"]["total-read-pairs"] == 30 and report["stats-r1"]["adapter_trim"] >= 14
    good = fastq.read_pairs(spark, f"{out}/s.R1.trimmed.fastq.gz", f"{out}/s.R2.trimmed.fastq.gz")
    assert good.count() == report["trimming-details"]["good-read-pairs"]
    capsys.readouterr()
    cli.main(["trim", "-r", r1, "-R", r2, "-o", out])
    assert "skip completed" in capsys.readouterr().out
    assert cli.main(["trim", "-r", r1, "-o", out, "-f"]) == 0
    assert cli.main(["trim", "-r", r1, "-R", r2, "-o", out, "--detect-adapter"]) == 0
    assert cli.main(["trim", "-r", r1, "-o", out, "--detect-adapter"]) == 0
    for bad in (["-O", "Nope"], ["-C", "5"], ["--log2-chunk-size", "9"], ["-q", "20", "--kmer-tolerance", "99"]):
        assert cli.main(["trim", "-r", r1, "-o", out, *bad]) == 3
    assert cli.main(["randtrim", r1, r2]) == 0
    assert cli.main(["readstat", base + ".R1.randtrim.fastq", base + ".R2.randtrim.fastq"]) == 0
    assert cli.main(["plot", base + ".R1.randtrim.fastq.r12.stat.tsv", "-o", str(tmp_path / "plots")]) == 0
    table = spark.read.option("sep", "\t").option("header", True).csv(base + ".R1.randtrim.fastq.r12.stat.tsv")
    assert sum(int(r.repeat) for r in table.collect()) == 60 and ADAPTER2
    (tmp_path / "x.aln").write_text(">chr1\tr-1\t10\t+\nACG-T\nAC-GT\n")
    assert cli.main(["truth", str(tmp_path / "x.aln"), "-o", str(tmp_path / "truth.tsv")]) == 0
    (tmp_path / "y.fq").write_text("@r-1/1\nACGT\n+\nIIII\n")
    capsys.readouterr()
    assert cli.main(["evaluate", str(tmp_path / "truth.tsv"), str(tmp_path / "y.fq")]) == 0
    assert "mCC" in capsys.readouterr().out
    (tmp_path / "t.tsv").write_text("trim -t 4\tUser time (seconds): 2.0\tSystem time (seconds): 1.0\tElapsed (wall clock) time (h:mm:ss or m:ss): 0:02.00\tMaximum resident set size (kbytes): 9\n")
    assert cli.main(["times", str(tmp_path / "t.tsv"), "--bases", "4000000"]) == 0
    assert "|1.5" in capsys.readouterr().out.replace(" ", "")
    assert cli.main(["replicates", str(tmp_path / "t.tsv"), str(tmp_path / "t.tsv")]) == 0
