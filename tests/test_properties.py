"""Properties of the chain over arbitrary reads (kernels only, no Spark)."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from readtrim.functions.batch import Mate
from readtrim.plans.options import ADAPTER1, ADAPTER2, TrimOptions
from readtrim.plans.pipeline import Batch, Pipeline

READ = st.tuples(st.text("ACGTN", max_size=90), st.integers(0, 2**32 - 1))
PAIRS = st.lists(st.tuples(READ, READ), min_size=1, max_size=12)
CHAIN = Pipeline(TrimOptions(polyG=True, polyA=True, complexity_filtration=True, clip_after_r1=60, clip5_r2=2, length_range="5:200"))


def column(reads, extra):
    rng = [np.random.default_rng(seed) for _, seed in reads]
    seqs = [s + extra[: int(r.integers(0, 30))] for (s, _), r in zip(reads, rng, strict=True)]
    quals = ["".join(chr(int(q)) for q in r.integers(33, 75, len(s))) for s, r in zip(seqs, rng, strict=True)]
    return pa.array(seqs, pa.string()), pa.array(quals, pa.string())


def run(pairs, chain=CHAIN):
    one, two = column([p[0] for p in pairs], ADAPTER1), column([p[1] for p in pairs], ADAPTER2)
    batch = Batch([Mate.of(*one), Mate.of(*two)], [None] * len(pairs))
    for step in chain.steps:
        if step.kernel:
            step.kernel(batch)
    return one, two, batch


@settings(max_examples=150, deadline=None)
@given(PAIRS)
def test_reads_only_get_shorter_and_stay_whole(pairs):
    one, two, batch = run(pairs)
    for (seq, _), mate in zip((one, two), batch.mates, strict=True):
        s, q = mate.columns()
        for before, after, qual in zip(seq.to_pylist(), s.to_pylist(), q.to_pylist(), strict=True):
            assert len(after) == len(qual) <= len(before) and set(after) <= set("ACGTN")
        assert not mate.seq[~mate.inside].any() and not mate.qual[~mate.inside].any()  # zero behind the end


@settings(max_examples=100, deadline=None)
@given(PAIRS)
def test_pairs_do_not_see_each_other(pairs):
    _, _, whole = run(pairs)
    texts = [m.columns()[0].to_pylist() for m in whole.mates]
    for k, p in enumerate(pairs):
        _, _, one = run([p])
        assert [m.columns()[0].to_pylist()[0] for m in one.mates] == [t[k] for t in texts]
        assert one.reason[0] == whole.reason[k]


@settings(max_examples=100, deadline=None)
@given(PAIRS)
def test_drops_follow_their_reasons(pairs):
    _, _, batch = run(pairs)
    n = [m.n for m in batch.mates]
    for k, reason in enumerate(batch.reason):
        if reason is None:
            assert 5 <= n[0][k] <= 60 and 5 <= n[1][k] <= 200
    assert sum(int(np.sum(v)) for c, v in batch.counts.items() if c.startswith(("length", "complexity", "max_n"))) == sum(r is not None for r in batch.reason)


@settings(max_examples=60, deadline=None)
@given(PAIRS)
def test_tail_and_quality_steps_are_stable(pairs):
    """What these steps have cut they don't cut again."""
    chain = Pipeline(TrimOptions(order=("QualityTrim", "TailNTrim"), adapter_trim=False))
    _, _, batch = run(pairs, chain)
    before = [m.columns() for m in batch.mates]
    again = Batch([Mate.of(s, q) for s, q in before], [None] * len(pairs))
    chain.steps[1].kernel(again)
    assert [m.n.tolist() for m in again.mates] == [[len(x) for x in s.to_pylist()] for s, _ in before]
