import numpy as np
import pytest
from reads import QUAL1, QUAL2, SEQ1, SEQ2, mate, random_reads, rc, text

from readtrim.functions import kernels as K
from readtrim.functions.batch import CODE, reverse_complement

NEEDLE = "ACCCGGTCAGTACGTCAGTACGCAGTAGTGTA"


@pytest.mark.parametrize(
    "hay, tolerance, found",
    [  # fixed values: placements that the fast tail search is known to give, some of them not the best ones
        ("NNNACCCGGTCAGTACGTCAGTACGCAGTAGTGTA", 0, (4, 16)),
        ("NNNNACCCGGTCAGTACGTCAGTACGCAGTAGTGTA", 0, (5, 16)),
        ("GGTCAGTACGTCAGTACGCAGTAGTGTANNNNACCC", 0, (33, 4)),
        ("GGTCAGTACGTCAGTACGCAGTAGTGTANNNNCCC", 0, (31, 4)),
        ("GGTCAGTACGTCAGTACGCAGTAGTGTATTTTCCC", 5, (32, 3)),
        ("GGTCAGTACGTCAGTACGCAGTAGTGTATTTTACCC", 5, (33, 4)),
        ("GGTCAGTACGTCAGTACGCAGTAGTGTATTTTAC", 5, (33, 2)),
        ("GGTCAGTACGTCAGTACGCAGTAGTGTATTTAC", 5, (32, 1)),
        ("GGTCAGTACGTCAGTACGCAGTAGTGTATTTACC", 5, (31, 2)),
    ],
)
def test_scan_known_placements(hay, tolerance, found):
    m = mate(hay)
    hit = K.scan(K.needle(NEEDLE), m.codes, m.n, 1, tolerance)
    assert (hit.idx[0], hit.n[0]) == found


def common(a: str, b: str) -> int:
    return sum(int(CODE[ord(x)] & CODE[ord(y)]).bit_count() for x, y in zip(a, b, strict=False))


def brute_whole(needle: str, hay: str, tolerance: int) -> tuple[int, int]:
    """All whole 16-mer placements, the leftmost best; (0, 0) below the threshold."""
    best = (0, 0)
    for p in range((len(hay) - 15) // 2 + 1):
        for idx, head in ((2 * p, needle[1:17]), (2 * p + 1, needle[:16])):
            n = common(head, hay[2 * p : 2 * p + 16])
            if n >= 16 - tolerance and n > best[1]:
                best = (idx, n)
    return best if best[0] <= len(hay) else (0, 0)


def test_scan_agrees_with_brute_force_on_whole_placements():
    rng = np.random.default_rng(1)
    hays = random_reads(rng, 400, 30, 70, "ACGTN")
    for k in range(0, 400, 2):  # plant needles with mismatches
        at = int(rng.integers(0, len(hays[k]) - 16))
        head = list(NEEDLE[:17])
        for _ in range(int(rng.integers(0, 3))):
            head[int(rng.integers(0, 17))] = "ACGT"[int(rng.integers(4))]
        hays[k] = (hays[k][:at] + "".join(head) + hays[k][at + 17 :])[: len(hays[k])]
    m = mate(*hays)
    for tolerance in (0, 2, 4):
        hit = K.scan(K.needle(NEEDLE), m.codes, m.n, 1, tolerance)
        for k, hay in enumerate(hays):
            expected = brute_whole(NEEDLE, hay, tolerance)
            if expected[1] >= 8:
                assert (hit.idx[k], hit.n[k]) == expected
            else:
                assert hit.n[k] < 16 - tolerance


def test_scan_of_short_and_empty_reads_stays_inside():
    m = mate("", "A", "ACG", "ACCCGGTCAGT", "ACCCGGTCAGTACG")
    hit = K.scan(K.needle(NEEDLE), m.codes, m.n, 1, 2)
    assert (hit.idx <= np.maximum(m.n, 0)).all() and hit.n[0] == 0


def test_reverse_complement_of_codes():
    m = mate("ACGTN", "AAC", "")
    back = reverse_complement(m.codes, m.n)
    assert back[0, :5].tolist() == [CODE[ord(c)] for c in "NACGT"]
    assert back[1, :3].tolist() == [CODE[ord(c)] for c in "GTT"]


def test_quality_keep_known_and_brute_force():
    m = mate(SEQ2, quals=(QUAL2,))
    assert K.quality_keep(m.qual, m.n, 5, 5, 33)[0] == 301  # never that poor: nothing is cut
    assert K.quality_keep(m.qual, m.n, 12, 5, 33)[0] == 226

    def brute(q: list[int], low: int, k: int) -> int:
        i = next((i for i, x in enumerate(q) if x < low), None)
        if i is None:
            return len(q)
        while i + k <= len(q) and sum(q[i : i + k]) >= low * k:
            i += 1
        return next((j for j in range(i, len(q)) if q[j] < low), len(q))

    rng = np.random.default_rng(2)
    quals = ["".join(chr(int(x)) for x in rng.integers(33, 75, rng.integers(0, 40))) for _ in range(500)]
    m = mate(*["A" * len(q) for q in quals], quals=tuple(quals))
    for score, k in ((20, 5), (25, 1), (15, 8)):
        got = K.quality_keep(m.qual, m.n, score, k, 33)
        assert got.tolist() == [brute([ord(c) for c in q], score + 33, k) for q in quals]


def test_poly_tail_brute_force():
    def brute(s: str, x: str, allowed: int) -> tuple[int, int]:
        n, misses, best, stop = len(s), 0, 0, 0
        for i in range(n, 0, -1):
            if s[i - 1] in (x, "N"):
                best = i
            else:
                misses += 1
                if misses > allowed:
                    stop = i
                    break
        if stop:
            i = stop - 1
            while i >= 1 and s[i - 1] == x:
                best, i = i, i - 1
        if not best:
            return 0, 0
        # look to the right of the beginning
        i, right = best + 1, 1
        while i <= n and right <= allowed and s[i - 1] == x:
            right, i = right + 1, i + 1
        if right <= allowed and i <= n:
            wrong = 0
            while i <= n and s[i - 1] != x:
                wrong, i = wrong + 1, i + 1
            if wrong >= right:
                best = i
        return (best, n - best + 1) if best <= n else (0, 0)

    rng = np.random.default_rng(3)
    reads = ["".join(rng.choice(list("GGGGGGACTN"), rng.integers(0, 40))) for _ in range(800)]
    m = mate(*reads)
    for allowed in (0, 1, 2, 4):
        idx, length = K.poly_tail(m, "G", allowed)
        assert list(zip(idx.tolist(), length.tolist(), strict=True)) == [brute(r, "G", allowed) for r in reads]


def test_complexity_known_values():
    m = mate("A" * 24, "ATT" * 8, "", "ACGT" * 4, "N" * 3)
    c = K.complexity(m)
    assert c[0] == pytest.approx(0.0435, abs=1e-4) and c[1] == pytest.approx(0.652, abs=1e-3)
    assert np.isnan(c[2]) and c[3] == 1.0


def test_count_n():
    assert K.count_n(mate(SEQ1, SEQ2, "RYB-", quals=(QUAL1, QUAL2, "IIII"))).round(6).tolist() == [0.0, 2.0, round((1 + 1 + 2 - 1) / 3, 6)]


def test_tail_and_adapter_keep():
    m = mate("ACGNN", "NNN", "", "ACG")
    assert K.tail_keep(m.codes == 15, m.n).tolist() == [3, 0, 0, 3]
    adapter = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
    reads = mate("TTTTTCCCCCTTTTT" + adapter, "TTTTTCCCCCTTTTTCCCCCTTTTTCC", adapter)
    assert K.adapter_keep(reads, [adapter], 2, 10.0).tolist() == [15, 27, 0]
    assert K.adapter_keep(reads, ["CCCCCTTTTTCCCCCTTTTT", adapter], 2, 10.0).tolist() == [15, 5, 0]


def pair(n1: int, n2: int, seq1: str = SEQ1, qual1: str = QUAL1):
    return mate(seq1[:n1], quals=(qual1[:n1],)), mate(SEQ2[:n2], quals=(QUAL2[:n2],))


def n_count(m) -> float:
    return float(K.count_n(m)[0])


@pytest.mark.parametrize("n1, n2", [(301, 301), (187, 150), (188, 150), (250, 150)])
def test_consensus_of_known_insert(n1, n2):
    r1, r2 = pair(n1, n2)
    turned = rc(SEQ1[:n1])
    done = K.call_consensus(r1, r2, np.array([0]), np.array([187]), K.PairOptions())
    assert len(done) == 1 and n_count(r2) == 0
    last = min(187, n2)
    assert text(r2)[0][:last] == turned[n1 - 187 :][:last]


def test_consensus_corrects_mate_one_only_where_it_overlaps():
    r1, r2 = pair(150, 187, "ACCCAANN" + SEQ1[8:], QUAL2[:8] + QUAL1[8:])
    assert len(K.call_consensus(r1, r2, np.array([0]), np.array([187]), K.PairOptions())) == 1
    assert n_count(r2) == 2 and n_count(r1) == 0
    assert rc(text(r1)[0]) == text(r2)[0][187 - 150 :]


@pytest.mark.parametrize("n1, n2, skip1, skip2", [(187, 187, 0, 0), (185, 160, 0, 2)])
def test_consensus_without_adapters(n1, n2, skip1, skip2):
    r1, r2 = pair(n1, n2)
    rcs = [reverse_complement(m.codes, m.n) for m in (r1, r2)]
    done = K.overlap_consensus(r1, r2, *rcs, np.array([0]), K.PairOptions())
    assert len(done) == 1 and n_count(r2) == 0
    size = min(n2, n1 + n2 - 187) if n1 < 187 else n2
    assert rc(SEQ1[:n1])[: n2 - skip2] == text(r2)[0][skip2:][: n2 - skip2] and size > 0


def test_untrimmed_pair_has_no_consensus():
    r1, r2 = pair(301, 301)
    rcs = [reverse_complement(m.codes, m.n) for m in (r1, r2)]
    assert len(K.overlap_consensus(r1, r2, *rcs, np.array([0]), K.PairOptions())) == 0


def test_pairs_with_known_inserts_are_cut_right():
    rng = np.random.default_rng(5)
    a1, a2 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"
    sizes = rng.integers(30, 140, 600)
    inserts = ["".join(rng.choice(list("ACGT"), s)) for s in sizes]
    tail = lambda: "".join(rng.choice(list("ACGT"), 100))
    r1 = mate(*[(i + a1 + tail())[:100] for i in inserts])
    r2 = mate(*[(rc(i) + a2 + tail())[:100] for i in inserts])
    K.trim_pairs(r1, r2, np.ones(600, bool), [(a1, a2)], K.PairOptions())
    truth = np.minimum(sizes, 100)
    assert (r1.n == truth).mean() > 0.97 and (r2.n == truth).mean() > 0.97
    assert (r1.n[sizes < 85] == sizes[sizes < 85]).all()


def test_kernels_do_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    s1, s2 = random_reads(rng, 60, 20, 90), random_reads(rng, 60, 20, 90)
    adapters = [("AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT")]
    whole = (mate(*s1), mate(*s2))
    K.trim_pairs(*whole, np.ones(60, bool), adapters, K.PairOptions())
    for k in range(60):
        one = (mate(s1[k]), mate(s2[k]))
        K.trim_pairs(*one, np.ones(1, bool), adapters, K.PairOptions())
        assert text(one[0])[0] == text(whole[0])[k] and text(one[1])[0] == text(whole[1])[k]
