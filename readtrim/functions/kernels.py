"""Vectorised kernels over batches of reads: approximate matching, tails, qualities, overlap decisions, consensus.

Rows are reads, columns positions (see batch.py). Positions in arguments and results count from 1; 0 means no hit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .batch import CODE, COMPLEMENT, SWAP, Mate, gather, reverse_complement

NEVER = np.int64(1 << 60)


def needle(seq: str) -> np.ndarray:
    """Bits of an adapter, padded to 17 bases and more."""
    return np.concatenate([CODE[np.frombuffer(seq.encode(), np.uint8)], np.zeros(20, np.uint8)])[None, :]


@dataclass
class Hit:
    """Best placement of each row: where (1-based; 0 none) and how many bases are compatible."""

    idx: np.ndarray
    n: np.ndarray

    def where(self, test: np.ndarray, other: Hit) -> Hit:
        return Hit(np.where(test, other.idx, self.idx), np.where(test, other.n, self.n))


def _half(x: np.ndarray) -> np.ndarray:
    """Integer half, towards zero."""
    return np.where(x < 0, -((-x) // 2), x // 2)


_WIDTHS = {16: "<u8", 8: "<u4", 4: "<u2", 2: "u1"}


def _packed(codes: np.ndarray) -> np.ndarray:
    """Two bases a byte, the first in the low half; eight bytes of zeros behind."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray(np.pad(codes[:, ::2] | codes[:, 1::2] << 4, ((0, 0), (0, 8))))


def _words(heads: np.ndarray, width: int, skip: int) -> np.ndarray:
    """``width`` bases of the needles from base ``skip + 1`` on, as one integer each."""
    part = heads[:, skip : skip + width]
    if part.shape[1] < width:
        part = np.pad(part, ((0, 0), (0, width - part.shape[1])))
    return np.ascontiguousarray(part[:, ::2] | part[:, 1::2] << 4).view(_WIDTHS[width])


def scan(heads: np.ndarray, hay: np.ndarray, n: np.ndarray, start, tolerance, until=None) -> Hit:
    """Where the first 16 bases of ``heads`` (one row for all, or a row each) fit best in ``hay``.

    A placement scores the number of common bits (two Ns count four). Placements go by pairs of bases; at each pair the
    needle is tried from its second base (one place earlier) and from its first; the leftmost best wins. Whole 16-mers
    must reach 16 - tolerance. If fewer than 8 bases fit, the tail is tried with the first 8, 4 and 2 bases, each with half the
    tolerance (rounded up); the tails begin where the 16-mers end, whatever ``start`` is.
    """
    rows = len(n)
    tol = np.broadcast_to(np.asarray(tolerance, np.int64), (rows,))
    first = np.maximum(_half(np.broadcast_to(np.asarray(start, np.int64), (rows,)) - 1), 0)
    last_word = _half(n - 15)
    limit = np.full(rows, NEVER) if until is None else _half(np.broadcast_to(np.asarray(until, np.int64), (rows,)) - 1)
    bytes_ = _packed(hay)
    best = Hit(np.zeros(rows, np.int64), np.zeros(rows, np.int64))
    if not rows:
        return best

    def stage(live: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray, tol: np.ndarray, best: Hit) -> Hit:
        lo, hi = np.maximum(lo, 0), np.minimum(hi, _half(n + 1))
        live = live & (lo <= hi)
        if not live.any():
            return best
        at = np.flatnonzero(live)
        lo, hi = lo[at], hi[at]
        if width == 16 and len(at) == rows and until is None:
            a = int(lo.min())
            steps = int(hi.max()) - a + 1
            windows = np.ndarray((rows, steps), _WIDTHS[16], bytes_, a, (bytes_.strides[0], 1))
            p = np.arange(a, a + steps)[None, :]
        else:
            steps = int((hi - lo).max()) + 1
            p = lo[:, None] + np.arange(steps)
            size = width // 2
            cut = np.minimum(p, bytes_.shape[1] - size)
            flat = cut + (at * bytes_.shape[1])[:, None]
            windows = np.ndarray((bytes_.size - size + 1,), _WIDTHS[width], bytes_, 0, (1,))[flat]
        ok = (p >= lo[:, None]) & (p <= hi[:, None])
        own = heads if len(heads) == 1 else heads[at]
        score = np.empty((len(at), 2 * steps), np.int16)
        score[:, 0::2] = np.bitwise_count(windows & _words(own, width, 1))
        score[:, 1::2] = np.bitwise_count(windows & _words(own, width, 0))
        least = (width - tol[at])[:, None]
        score[~np.repeat(ok, 2, axis=1) | (score < least)] = -1
        k = score.argmax(axis=1)
        found = score[np.arange(len(at)), k]
        idx = 2 * np.broadcast_to(p, (len(at), steps))[np.arange(len(at)), k // 2] + k % 2
        better = found > best.n[at]
        out = Hit(best.idx.copy(), best.n.copy())
        out.idx[at[better]], out.n[at[better]] = idx[better], found[better]
        return out

    live = np.ones(rows, bool)
    best = stage(live, 16, first, np.minimum(last_word, limit), tol, best)
    live &= ~((best.n >= 8) | (limit <= last_word))
    for width, ahead, enough in ((8, 4, 4), (4, 2, 2)):
        tol = (tol + 1) // 2
        lo = last_word + 1
        last_word = last_word + ahead
        best = stage(live, width, lo, np.minimum(last_word, limit), tol, best)
        live &= ~((best.n >= enough) | (limit <= last_word))
    tol = (tol + 1) // 2
    best = stage(live, 2, last_word + 1, _half(n - 1), tol, best)
    over = live & (best.idx > n)
    return Hit(np.where(over, 0, best.idx), np.where(over, 0, best.n))


def scan_reverse(heads: np.ndarray, rc: np.ndarray, n: np.ndarray, start, tolerance, until=None) -> Hit:
    """Scan of a reverse complement; idx is the insert size it tells (0: none)."""
    hit = scan(heads, rc, n, start, tolerance, until)
    none = hit.idx == 0
    return Hit(np.where(none, 0, n - hit.idx + 1), np.where(none, 0, hit.n))


def mean_probability(mate: Mate, start: np.ndarray, length: int = 16, end: np.ndarray | None = None) -> np.ndarray:
    """Mean over positions start..start+length-1 (or ..end) that lie in the read; 0 if none does."""
    end = start + length - 1 if end is None else end
    lo, hi = np.maximum(start, 1), np.minimum(end, mate.n)
    k = lo[:, None] + np.arange(length)
    ok = k <= hi[:, None]
    p = mate.prob(np.where(ok, k - 1, 0))
    return np.where(ok, p, 0).sum(axis=1) / np.maximum(ok.sum(axis=1), 1)


# ---------------------------------------------------------------- single reads


def quality_keep(qual: np.ndarray, n: np.ndarray, score: int, window: int, offset: int) -> np.ndarray:
    """How many bases to keep: up to the first low base of the first low window; n where there is none."""
    keep = n.astype(np.int64).copy()
    width = qual.shape[1]
    if not width:
        return keep
    columns = np.arange(width)
    low = (qual < score + offset) & (columns < n[:, None])
    rows = np.flatnonzero(low.any(axis=1))  # most good reads have no low base at all
    if not len(rows):
        return keep
    low, q, n = low[rows], qual[rows], n[rows]
    nxt = _next(low)  # first low base at or after each position (0-based)
    start = nxt[:, 0]
    sums = np.zeros((len(rows), width + 1), np.int32)
    np.cumsum(np.where(columns < n[:, None], q, 0), axis=1, dtype=np.int32, out=sums[:, 1:])
    total = sums[:, np.minimum(columns + window, width)] - sums[:, :width]
    poor = (total < (score + offset) * window) & (columns + window <= n[:, None]) & (columns >= start[:, None])
    stop = np.where(poor.any(axis=1), poor.argmax(axis=1), np.maximum(start, n - window + 1))
    cut = nxt[np.arange(len(rows)), np.minimum(stop, width - 1)]
    keep[rows] = np.where((start < n) & (stop < n), np.minimum(cut, n), n)
    return keep


def _next(flag: np.ndarray) -> np.ndarray:
    """Column of the next True at or after each column; the width if there is none."""
    width = flag.shape[1]
    at = np.where(flag, np.arange(width, dtype=np.int32), np.int32(width))
    return np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]


def tail_keep(flag: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length without the run of flagged positions at the end."""
    ok = ~flag & (np.arange(flag.shape[1]) < n[:, None])
    return np.where(ok.any(axis=1), flag.shape[1] - ok[:, ::-1].argmax(axis=1), 0)


def poly_tail(mate: Mate, base: str, mismatches: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(first position, length) of a tail of one base; (0, 0) without one. ``mismatches`` are allowed in all.

    Tails shorter than ``least`` may come out as (0, 0).
    """
    idx, length = np.zeros(len(mate.n), np.int64), np.zeros(len(mate.n), np.int64)
    x = CODE[ord(base)]
    # the last bases tell most reads apart: a tail holds its mismatches and one bridged at most
    back = mate.n[:, None] - 1 - np.arange(least)
    last = gather(mate.codes, np.maximum(back, 0))
    misses = ((last & x != x) & (back >= 0)).sum(axis=1)
    rows = np.flatnonzero((misses <= mismatches + 1) & (mate.n >= least))
    if len(rows):
        idx[rows], length[rows] = _poly_tail(mate.codes[rows], mate.n[rows], x, mismatches)
    return idx, length


def _poly_tail(codes: np.ndarray, n: np.ndarray, x: int, mismatches: int) -> tuple[np.ndarray, np.ndarray]:
    width = codes.shape[1]
    rows = np.arange(len(n))
    columns = np.arange(width)
    inside = columns < n[:, None]
    back = n[:, None] - 1 - columns  # column k of the turned matrices is the k-th base from the end
    there = back >= 0
    turned = np.where(there, gather(codes, np.maximum(back, 0)), 0)
    like = there & (turned & x == x)
    over = np.cumsum(there & ~like, axis=1, dtype=np.int32) > mismatches
    stop = np.where(over.any(axis=1), over.argmax(axis=1), n)  # the scan breaks here
    hit = like & (columns < stop[:, None])
    best = np.where(hit.any(axis=1), width - hit[:, ::-1].argmax(axis=1), 0)  # bases from the end
    # one more mismatch is bridged if the very base goes on behind it
    after = _next(~(there & (turned == x)))
    beyond = np.minimum(stop + 1, width - 1)
    run = np.where(stop + 1 < n, after[rows, beyond] - (stop + 1), 0)
    best = np.where(run > 0, stop + 1 + run, best)
    idx = np.where(best > 0, n - best + 1, 0)
    # look back to the right: a weak beginning is given up
    forward = codes == x
    at = np.minimum(idx, width - 1)  # 0-based column behind the first base
    first_other = np.minimum(_next(~forward & inside)[rows, at], n)
    matched = np.minimum(np.maximum(first_other - at, 0), mismatches)
    stopped = (matched >= mismatches) | (at + matched >= n)
    nxt = np.minimum(_next(forward)[rows, np.minimum(at + matched, width - 1)], n)
    missed = np.where(stopped, 0, nxt - (at + matched))
    idx = np.where((idx > 0) & (missed >= 1 + matched), at + matched + missed + 1, idx)
    idx = np.where(idx > n, 0, idx)
    return idx, np.where(idx > 0, n - idx + 1, 0)


def complexity(mate: Mate) -> np.ndarray:
    """One minus the share of equal neighbours inside blocks of 16; NaN for an empty read."""
    c, n = mate.codes, mate.n
    pair = np.bitwise_count(c[:, :-1] & c[:, 1:]).astype(np.int64)
    pair[:, 15::16] = 0  # neighbours in different blocks
    ones = pair.sum(axis=1)
    blocks, rest = -(-n // 16), n % 16
    below = np.where(rest == 0, 15 * blocks, 15 * (blocks - 1) + rest)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, 1 - ones / below, np.nan)


def count_n(mate: Mate) -> np.ndarray:
    """Ambiguity in units of N: an N is 1, two or three possible bases are 1/3 or 2/3."""
    return (np.bitwise_count(mate.codes).sum(axis=1, dtype=np.int64) - mate.n) / 3


def adapter_keep(mate: Mate, adapters: list[str], tolerance: int, trim_score: float) -> np.ndarray:
    """Single-end: bases to keep; of several adapters the shortest rest. n where no adapter scores above the threshold."""
    keep = mate.n.copy()
    for a in adapters:
        hit = scan(needle(a), mate.codes, mate.n, 1, tolerance)
        score = hit.n * np.maximum(mean_probability(mate, hit.idx), 0.75)
        found = (hit.idx > 0) & (score > trim_score)
        keep = np.where(found, np.minimum(keep, np.maximum(hit.idx - 1, 0)), keep)
    return keep


# ---------------------------------------------------------------- read pairs


@dataclass(frozen=True)
class PairOptions:
    kmer_tolerance: int = 2
    pe_adapter_diff: int = 0
    r1_r2_diff: int = 0
    kmer_n_match: int = 9
    trim_score_pe: float = 10.0
    trim_score_se: float = 10.0
    tail_length: int = 12
    consensus: bool = True
    kmer_tolerance_consensus: int = 10
    min_ratio_mismatch: float = 0.28
    overlap_score: float = 0.0
    prob_diff: float = 0.0


def _decide(size_a, score_a, size_b, score_b, diff: int):
    """Within one mate: adapter (a) against overlap (b); equal scores go to the overlap."""
    same, near = size_a == size_b, np.abs(size_a - size_b) <= diff
    size = np.where(same, size_a, np.where(near, np.minimum(size_a, size_b), np.where(score_a > score_b, size_a, size_b)))
    return size, np.where(same | near, score_a + score_b, np.maximum(score_a, score_b))


def _doubtful(a1, p1, n1, a2, p2, n2, diff: int, tail: int) -> np.ndarray:
    """An adapter that is missing or in the tail while the overlap says otherwise, and no mate where both agree."""
    skip = (n1 < np.maximum(a2, p2)) | (n2 < np.maximum(a1, p1))
    odd = lambda a, p, n: ((a > n - tail) | (a == -1)) & (p < n - tail)
    agree = (np.abs(a1 - p1) <= diff) | (np.abs(a2 - p2) <= diff)
    return ~skip & (odd(a1, p1, n1) | odd(a2, p2, n2)) & ~agree


@dataclass
class Decision:
    trim: np.ndarray
    size1: np.ndarray
    size2: np.ndarray
    score: np.ndarray


def decide_pairs(r1: Mate, r2: Mate, rc1: np.ndarray, rc2: np.ndarray, adapter1: str, adapter2: str, o: PairOptions) -> Decision:
    """Whether and where to cut each pair, from both adapters and both overlaps (all as insert sizes)."""
    h1, h2, n1, n2 = needle(adapter1), needle(adapter2), r1.n, r2.n
    few = o.kmer_n_match
    a1, a2 = scan(h1, r1.codes, n1, 1, o.kmer_tolerance), scan(h2, r2.codes, n2, 1, o.kmer_tolerance)
    tol = o.kmer_tolerance + (np.maximum(a1.n, a2.n) < few)
    p1, p2 = scan_reverse(r2.codes, rc1, n1, 1, tol), scan_reverse(r1.codes, rc2, n2, 1, tol)
    a1, a2 = Hit(a1.idx - 1, a1.n), Hit(a2.idx - 1, a2.n)

    # one good match: look for the others at its place, more leniently
    best = a1
    for other in (a2, p1, p2):
        best = best.where(other.n >= best.n, other)
    place = best.idx + 1
    loose = o.kmer_tolerance + 3
    sure = best.n > few

    def again(hit: Hit, heads: np.ndarray, hay: np.ndarray, n: np.ndarray, reverse: bool) -> Hit:
        todo = np.flatnonzero(sure & (hit.n < few))
        if not len(todo):
            return hit
        at = (n[todo] - place[todo] + 2) if reverse else place[todo]
        new = scan(heads if len(heads) == 1 else heads[todo], hay[todo], n[todo], at, loose, at + 1)
        size = np.where(new.idx == 0, 0, n[todo] - new.idx + 1) if reverse else new.idx - 1
        ok = new.n > few
        out = Hit(hit.idx.copy(), hit.n.copy())
        out.idx[todo[ok]], out.n[todo[ok]] = size[ok], new.n[ok]
        return out

    a1, a2 = again(a1, h1, r1.codes, n1, False), again(a2, h2, r2.codes, n2, False)
    p1, p2 = again(p1, r2.codes, rc1, n1, True), again(p2, r1.codes, rc2, n2, True)

    adapter = lambda hit, mate: hit.n * np.maximum(mean_probability(mate, hit.idx + 1), 0.75)
    one = np.ones(len(n1), np.int64)
    overlap = lambda hit, mate, other: (
        hit.n * (np.maximum(mean_probability(mate, hit.idx - 15), 0.75) * np.maximum(mean_probability(other, one), 0.75))
    )
    size1, score1 = _decide(a1.idx, adapter(a1, r1), p1.idx, overlap(p1, r1, r2), o.pe_adapter_diff)
    size2, score2 = _decide(a2.idx, adapter(a2, r2), p2.idx, overlap(p2, r2, r1), o.pe_adapter_diff)
    agree = np.abs(size1 - size2) <= o.r1_r2_diff
    lead = ~agree & (score1 > score2)
    both1, both2 = np.where(agree | lead, size1, size2), np.where(agree | ~lead, size2, size1)
    score = np.where(agree, score1 + score2, np.maximum(score1, score2))

    # the other mate is too poor there to say anything
    alone1 = ~agree & (score1 > o.trim_score_se)
    alone2 = ~agree & ~(score1 > o.trim_score_se) & (score2 > o.trim_score_se)
    trim = (alone1 & (mean_probability(r2, size1 + 1) < 0.6)) | (alone2 & (mean_probability(r1, size2 + 1) < 0.6))
    trim |= (score > o.trim_score_pe) & ~_doubtful(a1.idx, p1.idx, n1, a2.idx, p2.idx, n2, o.pe_adapter_diff, o.tail_length)
    return Decision(trim, both1, both2, score)


def shift_by_one(mate: Mate, adapter: str, keep: np.ndarray, check: int = 4) -> np.ndarray:
    """Move a cut by one base if the adapter's first bases agree better there; ties stay, then go left."""
    head = np.frombuffer(adapter.encode()[:check], np.uint8)
    head = CODE[head]

    def same(at: np.ndarray) -> np.ndarray:
        k = at[:, None] - 1 + np.arange(len(head))
        ok = (k >= 0) & (k < mate.n[:, None])
        return ((gather(mate.codes, np.where(ok, k, 0)) == head) & ok).sum(axis=1)

    here, left, right = same(keep + 1), same(keep), same(keep + 2)
    move = np.where(here >= left, np.where(here >= right, 0, 1), np.where(left >= right, -1, 1))
    return np.where((keep >= mate.n - 3) | (keep < 1), keep, keep + move)


#: N of mate 2 counts as a gap.
_NO_N = np.where(np.arange(16) == 15, 0, SWAP).astype(np.uint8)


def call_consensus(r1: Mate, r2: Mate, rows: np.ndarray, size: np.ndarray, o: PairOptions) -> np.ndarray:
    """Correct ``rows`` in place where the mates overlap: the base with the better quality overwrites the other.

    Pairs with too many mismatches are left alone; the last block of 16 is not looked at for that. Returns the rows done.
    """
    if not len(rows):
        return rows
    n1, n2, ins = r1.n[rows], r2.n[rows], size[rows]
    short = n2 < ins
    first = np.where(short, ins - n2 + 1, 1)
    bump = short & (first % 2 == 0)
    first = first + bump
    skip = np.where(short, bump.astype(np.int64), n2 - ins)  # bases of mate 2's reverse complement before the overlap
    overlap = np.minimum(np.where(short, n2 - bump, ins), n1 - first + 1)
    ok = (overlap > 0) & (ins > 0)
    rows, n1, n2, ins, first, skip, overlap = (v[ok] for v in (rows, n1, n2, ins, first, skip, overlap))
    if not len(rows):
        return rows
    columns = np.arange(int(overlap.max()))
    inside = columns < overlap[:, None]
    x = gather(r1.codes, np.minimum(first[:, None] - 1 + columns, r1.codes.shape[1] - 1), rows)
    # base k of mate 2's reverse complement is the complement of its base n - k + 1; an N of mate 2 is no mismatch
    at = n2[:, None] - 1 - skip[:, None] - columns
    inside &= at >= 0
    y = np.where(inside, _NO_N[gather(r2.codes, np.where(inside, at, 0), rows)], 0)
    wrong = np.bitwise_count(y & ~x & 15)
    steps = (overlap + 1) // 2
    blocks = steps // 8  # all but the last one read
    seen = np.where(columns < 16 * blocks[:, None], wrong, 0).sum(axis=1)
    ones = overlap - -(-steps // 8) * 16 + 16 * blocks + seen
    good = ones <= np.floor((1 + o.min_ratio_mismatch) * overlap).astype(np.int64)
    rows, n1, n2, ins, first = rows[good], n1[good], n2[good], ins[good], first[good]
    if not len(rows):
        return rows
    last = np.minimum(n1, ins)
    i = first[:, None] + np.arange(max(int((last - first).max()) + 1, 0))
    j = ins[:, None] - i + 1
    live = (i <= last[:, None]) & (j >= 1) & (j <= n2[:, None])
    ii, jj = np.where(live, i - 1, 0), np.where(live, j - 1, 0)
    differ = live & (SWAP[gather(r1.codes, ii, rows)] != gather(r2.codes, jj, rows))
    some = np.flatnonzero(differ.any(axis=1))  # most overlaps agree
    if not len(some):
        return rows
    at, ii, jj, differ = rows[some], ii[some], jj[some], differ[some]
    p1, p2 = r1.prob(ii, at), r2.prob(jj, at)
    to2, to1 = differ & (p1 - p2 > o.prob_diff), differ & (p2 - p1 > o.prob_diff)
    for put, dst, di, src, si in ((to2, r2, jj, r1, ii), (to1, r1, ii, r2, jj)):
        r, c = np.nonzero(put)
        d, f = di[r, c], si[r, c]
        dst.seq[at[r], d] = COMPLEMENT[src.seq[at[r], f]]
        dst.qual[at[r], d] = src.qual[at[r], f]
        dst.codes[at[r], d] = CODE[dst.seq[at[r], d]]
    return rows


def overlap_consensus(r1: Mate, r2: Mate, rc1: np.ndarray, rc2: np.ndarray, rows: np.ndarray, o: PairOptions) -> np.ndarray:
    """Consensus of pairs without adapters: both mates must tell the same overlap."""
    if not len(rows):
        return rows
    x, y = (r1, r2) if len(rows) == len(r1) else (r1.take(rows), r2.take(rows))
    h1 = scan(rc2[rows], x.codes, x.n, 1, o.kmer_tolerance_consensus)
    h2 = scan(rc1[rows], y.codes, y.n, 1, o.kmer_tolerance_consensus)
    over1, over2 = x.n - h1.idx + 1, y.n - h2.idx + 1
    ok = over1 == over2
    if o.overlap_score > 0:
        score = np.maximum(h1.n * mean_probability(x, h1.idx), h2.n * mean_probability(y, h2.idx))
        ok &= score >= o.overlap_score
    size = np.zeros(len(r1), np.int64)
    size[rows] = x.n + y.n - over1
    return call_consensus(r1, r2, rows[ok], size, o)


def trim_pairs(r1: Mate, r2: Mate, live: np.ndarray, adapters: list[tuple[str, str]], o: PairOptions) -> np.ndarray:
    """Adapter trimming and consensus of the ``live`` pairs, in place; which pairs were decided to be trimmed.

    Of several adapter pairs the first with the best score counts; above 28.8 no further one is tried.
    """
    rows, whole = np.flatnonzero(live), bool(live.all())
    x, y = (r1, r2) if whole else (r1.take(rows), r2.take(rows))
    rc1, rc2 = reverse_complement(x.codes, x.n), reverse_complement(y.codes, y.n)
    m = len(rows)
    best = Decision(np.zeros(m, bool), np.full(m, NEVER), np.full(m, NEVER), np.full(m, -1.0))
    which = np.zeros(m, np.int64)
    open_ = np.ones(m, bool)
    for k, (a1, a2) in enumerate(adapters):
        if not open_.any():
            break
        d = decide_pairs(x, y, rc1, rc2, a1, a2, o)
        take = open_ & d.trim & (~best.trim | (best.score < d.score))
        best = Decision(*(np.where(take, p, q) for p, q in ((d.trim, best.trim), (d.size1, best.size1), (d.size2, best.size2), (d.score, best.score))))
        which = np.where(take, k, which)
        open_ &= ~(best.score > 28.8)
    if o.consensus:
        overlap_consensus(x, y, rc1, rc2, np.flatnonzero(~best.trim), o)
        call_consensus(x, y, np.flatnonzero(best.trim & (best.size1 == best.size2) & (best.size1 > 0)), best.size1, o)
    keep1, keep2 = x.n.copy(), y.n.copy()
    for k, (a1, a2) in enumerate(adapters):
        mine = best.trim & (which == k)
        keep1 = np.where(mine, np.maximum(shift_by_one(x, a1, best.size1), 0), keep1)
        keep2 = np.where(mine, np.maximum(shift_by_one(y, a2, best.size2), 0), keep2)
    x.keep_head(keep1)
    y.keep_head(keep2)
    for mate, part in () if whole else ((r1, x), (r2, y)):
        mate.seq[rows], mate.qual[rows], mate.n[rows] = part.seq, part.qual, part.n
        mate.changed()
    out = np.zeros(len(r1), bool)
    out[rows] = best.trim
    return out


def infer_adapters(r1: Mate, r2: Mate, tolerance: int = 3, few: int = 9):
    """What follows the overlap in each mate: (start, [(letters, length, mean probability) of mate 1, of mate 2]).

    ``start`` is mate 1's insert size plus one and serves both mates.
    """
    rc1, rc2 = reverse_complement(r1.codes, r1.n), reverse_complement(r2.codes, r2.n)
    p1, p2 = scan_reverse(r2.codes, rc1, r1.n, 1, tolerance), scan_reverse(r1.codes, rc2, r2.n, 1, tolerance)
    start = p1.idx + 1
    found = []
    for mate, hit in ((r1, p1), (r2, p2)):
        end = np.minimum(start + 15, mate.n)
        length = np.where(hit.n < few, 0, np.maximum(end - start + 1, 0))
        k = np.clip(start[:, None] - 1 + np.arange(16), 0, mate.seq.shape[1] - 1)
        found.append((gather(mate.seq, k), length, mean_probability(mate, start, end=end)))
    return start, found
