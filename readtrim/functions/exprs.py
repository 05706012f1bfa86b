"""Read operations as Catalyst expressions: everything that needs no scan over positions stays in the JVM.

Positions count from 1. Sequences and qualities are strings of equal length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every base or ambiguity code and its complement.
_FROM, _TO = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), _FROM, _TO)


def keep_head(value: Column, keep: Column | int) -> Column:
    """The first ``keep`` characters; nothing for 0 or less."""
    return F.substring(value, F.lit(1), F.greatest(F.lit(keep) if isinstance(keep, int) else keep, F.lit(0)))


def drop_head(value: Column, n: int) -> Column:
    return F.substring(value, n + 1, 1 << 30) if n > 0 else value


def without_tail_n(seq: Column) -> Column:
    return F.regexp_replace(seq, "N+$", "")


def low_quality_keep(qual: Column, offset: int = 33) -> Column:
    """Length without the trailing qualities 0 and 1, whose chance to be right is below 0.3."""
    low = "".join(rf"\x{offset + q:02x}" for q in (0, 1))
    return F.length(F.regexp_replace(qual, f"[{low}]+$", ""))


def count_n(seq: Column) -> Column:
    """Ambiguity in units of N: 1 for N, 2/3 for three possible bases, 1/3 for two, -1/3 for a gap."""
    thirds = sum((F.lit(w) * (F.length(seq) - F.length(F.translate(seq, chars, ""))) for w, chars in ((3, "Nn"), (2, "BDHVbdhv"), (1, "RYSWKMryswkm"))), F.lit(0))
    gaps = F.length(F.regexp_replace(seq, "[A-Za-z]", ""))
    return (thirds - gaps) / F.lit(3.0)


def probability(q: Column) -> Column:
    """Chance that a base of quality ``q`` is right; qualities over 50 count as 50, below 0 is an error."""
    p = 1 - F.pow(F.lit(10.0), -F.least(q, F.lit(50)) / 10.0)
    return F.when(q < 0, F.raise_error(F.lit("quality below the offset: wrong quality format?")).cast("double")).otherwise(p)


def complement(seq: Column) -> Column:
    return F.translate(seq, _FROM, _TO)


def is_complement(a: Column, b: Column) -> Column:
    """Base by base, in the same direction."""
    return complement(a) == b


def n_to_gap(seq: Column) -> Column:
    return F.translate(seq, "Nn", "--")


def is_dna(seq: Column) -> Column:
    """Bases, ambiguity codes and gaps only, at least one."""
    return seq.rlike(f"^[{_FROM}-]+$")


def bits(seq: Column) -> Column:
    """Sets of bases as bits, four a base (A 1, C 2, G 4, T 8, unions for ambiguity codes), the first base last."""
    sets = [0b0001, 0b0010, 0b0100, 0b1000, 0b1000, 0b1111, 0b0101, 0b1010, 0b0110, 0b1001, 0b1100, 0b0011, 0b1110, 0b1101, 0b1011, 0b0111]
    table = F.create_map(*[F.lit(x) for c, v in zip(_FROM[:16], sets, strict=True) for x in (c, f"{v:04b}")])
    letters = F.filter(F.split(F.upper(F.reverse(seq)), ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c: F.coalesce(table[c], F.lit("0000"))), " ")


def mean_probability(qual: Column, start: Column | int = 1, end: Column | None = None, offset: int = 33) -> Column:
    """Mean chance over positions start..end that lie in the read; 0 if none does."""
    part = _part(qual, start, end)
    return F.when(F.length(part) > 0, _sum(part, offset) / F.length(part)).otherwise(F.lit(0.0))


def probability_sum(qual: Column, start: Column | int = 1, end: Column | None = None, offset: int = 33) -> Column:
    """Sum of the chances over positions start..end that lie in the read."""
    return _sum(_part(qual, start, end), offset)


def _part(qual: Column, start: Column | int, end: Column | None) -> Column:
    lo = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    hi = F.length(qual) if end is None else F.least(end, F.length(qual))
    return F.when(hi >= lo, F.substring(qual, lo, (hi - lo + 1).cast("int"))).otherwise("")


def _sum(part: Column, offset: int) -> Column:
    letters = F.filter(F.split(part, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), lambda acc, c: acc + probability(F.ascii(c) - F.lit(offset)))


def same_identifier(id1: Column, id2: Column) -> Column:
    """Identifiers agree up to mate 1's first space or slash; without one they must be equal."""
    head = F.regexp_extract(id1, "^[^ /]*", 0)
    return F.when(F.length(head) < F.length(id1), F.substring(id2, F.lit(1), F.length(head)) == head).otherwise(id1 == id2)


def complexity(seq: Column) -> Column:
    """One minus the share of equal neighbours inside blocks of 16 (bases that both may be: N N counts four, N and a base one).

    For each base the letters that may be it and stand before another such are taken out of the whole read at once; what is gone is counted.
    """
    n = F.length(seq)
    rest, blocks = n % 16, F.ceil(n / 16)
    parted = F.regexp_replace(seq, "(?s)(.{16})", "$1-")  # neighbours in different blocks are none
    twice = lambda may: F.length(parted) - F.length(F.regexp_replace(parted, f"[{may}](?=[{may}])", ""))
    ones = sum((twice(may) for may in ("CMSYVHBNcmsyvhbn", "GRSKVDBNgrskvdbn", "TUWYKHDBNtuwykhdbn")), twice("AMRWVHDNamrwvhdn"))
    below = F.when(n == 0, F.lit(float("nan"))).when(rest == 0, 15 * blocks).otherwise(15 * (blocks - 1) + rest)
    return 1 - ones / below  # no branch around it: Catalyst makes the parted read once only where it is always needed


def format_record(name: Column, seq: Column, des: Column, qual: Column) -> Column:
    """Four lines of text; an empty sequence is written as one N of quality 0."""
    empty = F.length(seq) == 0
    return F.concat_ws("\n", name, F.when(empty, "N").otherwise(seq), F.coalesce(des, F.lit("+")), F.when(empty, "!").otherwise(qual))
