"""Queries that stand for an operator run it over every pair: against brute force on the small table."""

from collections import defaultdict

import pytest
from test_kernels import common

from reads import rc
from readtrim.queries import QUERIES, read_pairs

SF = "/root/testdata/sf0.001"


def insert_size(head: str, read: str, tolerance: int = 3) -> tuple[int, int]:
    """(insert size, fitting bases) by every placement of a mate's head in the other's reverse complement, tails included."""
    hay, n, best = rc(read), len(read), (0, 0)
    last = (n - 15) // 2
    stages = [(16, 0, last, tolerance, 8)]
    for width, ahead, enough in ((8, 4, 4), (4, 2, 2)):
        tolerance = (tolerance + 1) // 2
        stages.append((width, last + 1, last + ahead, tolerance, enough))
        last += ahead
    stages.append((2, last + 1, (n - 1) // 2, (tolerance + 1) // 2, 0))
    for width, lo, hi, tol, enough in stages:
        for p in range(max(lo, 0), min(hi, (n + 1) // 2) + 1):
            for skip in (1, 0):
                fit = common(head[skip : skip + width], hay[2 * p : 2 * p + width])
                if fit >= width - tol and fit > best[1]:
                    best = (2 * p + 1 - skip, fit)
        if best[1] >= enough:
            break
    return (n - best[0] + 1, best[1]) if 0 < best[0] <= n else (0, 0)


def test_adapter_stats_count_every_pair(spark):
    rows = read_pairs(spark, SF).collect()
    expected, flaws = defaultdict(list), set()
    for r in rows:
        (size, fit1), (_, fit2) = insert_size(r.seq2, r.seq1), insert_size(r.seq1, r.seq2)
        for mate, seq, qual, fit in ((1, r.seq1, r.qual1, fit1), (2, r.seq2, r.qual2, fit2)):
            cut, q = seq[size : size + 16], [1 - 10 ** (-min(ord(c) - 33, 50) / 10) for c in qual[size : size + 16]]
            if size >= 15 and fit >= 9 and cut and sum(q) / len(q) > 0.75:
                expected[mate, cut].append((sum(q) / len(q), size + 1))
                flaws.add(r.v)
    assert flaws == set(range(7))
    got = {(r.mate, r.adapter): r for r in QUERIES["adapter_group_stats"](spark, SF).collect()}
    assert set(got) == set(expected)
    for k, found in expected.items():
        n = len(found)
        assert got[k]["count"] == n and got[k].occurance == pytest.approx(n / len(rows), abs=1e-6)
        assert (got[k].identity, got[k].adapter_start_position) == pytest.approx([sum(x) / n for x in zip(*found, strict=True)], abs=2e-6)


def test_length_filter_judges_every_pair(spark):
    rows = read_pairs(spark, SF).collect()
    got = {r.idx: r.good for r in QUERIES["length_filter"](spark, SF).collect()}
    assert got == {r.idx: all(50 <= len(s) <= 100 for s in (r.seq1, r.seq2)) for r in rows}
    assert any(len(r.seq1) == 100 and got[r.idx] for r in rows) and not all(got.values())
