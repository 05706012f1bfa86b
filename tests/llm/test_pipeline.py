"""The corpus pipeline, stage by stage against brute force, and on awkward rows."""

from collections import Counter

import brute
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "pii", "mixing", "best_fit_packing"]


@pytest.mark.parametrize("which", ["small tables", "awkward"])
def test_stage_by_stage(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "small tables" else brute.documents(spark)
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, SF).cache()
    assert kept.columns == columns
    from readtrim.llm.quality_rules import assess

    good = Counter(str(r.doc_id) for r in assess(docs).where("kept").collect())
    assert Counter(str(r.doc_id) for r in kept.select("doc_id").collect()) == good

    deduped = stage["simhash_near_dedup"](spark, kept, SF).cache()
    rows = kept.select("doc_id", "text").collect()
    groups = brute.components([r.doc_id for r in rows], [brute.fingerprint(r.text) for r in rows])
    assert deduped.columns == columns and sorted(str(r.doc_id) for r in deduped.collect()) == sorted({str(g) for g in groups})

    clean = stage["pii"](spark, deduped, SF).cache()
    assert clean.columns == columns and clean.count() == deduped.count()
    assert not any(brute.base_spans(r.text) for r in clean.collect())

    mixed = stage["mixing"](spark, clean, SF).cache()
    assert mixed.columns == columns and 0 <= mixed.count() <= clean.count()

    packed = stage["best_fit_packing"](spark, mixed, SF)
    ids = Counter(str(r.doc_id) for r in packed.where("piece = 0").collect())
    assert ids == Counter(str(r.doc_id) for r in mixed.collect())


def test_run_packs_what_the_stages_keep(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    from readtrim.llm.quality_rules import assess

    good = {r.doc_id for r in assess(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    assert {r.doc_id for r in rows} <= good
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_empty_documents(spark, tmp_path):
    brute.documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
