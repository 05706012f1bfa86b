"""Options of a trimming run, with their ranges checked on creation."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from ..functions.batch import CODE
from ..functions.kernels import PairOptions

ADAPTER1, ADAPTER2 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"
#: Quality formats by name: the character of quality 0.
QUALITY_FORMATS = {"ILLUMINA1.3": 64, "ILLUMINA1.5": 64, "SOLEXA": 64, "SANGER": 33, "ILLUMINA1.8": 33}
COMPRESSIONS = {"AUTO": "auto", "NO": "none", "GZ": "gzip", "GZIP": "gzip", "BZ2": "bzip2", "BZIP2": "bzip2"}


def quality_offset(name: str) -> int:
    """
    >>> quality_offset("Illumina1.5"), quality_offset("33")
    (64, 33)
    """
    if re.fullmatch(r"\d+", name):
        return int(name)
    if name.upper() not in QUALITY_FORMATS:
        raise ValueError(f"unknown quality format {name!r}; known: {', '.join(QUALITY_FORMATS)} or a character code")
    return QUALITY_FORMATS[name.upper()]


def length_range(text: str) -> tuple[int, int]:
    """
    >>> length_range("30:100")
    (30, 100)
    """
    if not re.fullmatch(r"\d+:\d+", text):
        raise ValueError(f"length range {text!r} is not MIN:MAX")
    low, high = text.split(":")
    return int(low), int(high)


def is_dna(seq: str) -> bool:
    return bool(seq) and all(ord(c) < 256 and (CODE[ord(c)] or c == "-") for c in seq)


@dataclass(frozen=True)
class TrimOptions:
    """Names follow the command line (see cli.py)."""

    order: tuple[str, ...] = ("DefaultOrder",)
    check_identifier: bool = False
    polyG: bool = False
    polyT: bool = False
    polyA: bool = False
    polyC: bool = False
    poly_length: int = 10
    poly_mismatch_per_16mer: int = 2
    adapter_trim: bool = True
    adapter1: tuple[str, ...] = (ADAPTER1,)
    adapter2: tuple[str, ...] = (ADAPTER2,)
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
    clip3_r1: int = 0
    clip3_r2: int = 0
    clip_after_r1: int = 0
    clip_after_r2: int = 0
    clip5_r1: int = 0
    clip5_r2: int = 0
    quality_trim: bool = True
    quality_score: int = 20
    quality_kmer: int = 5
    quality_format: str = "33"
    tail_n_trim: bool = True
    max_n: int = 15
    length_filtration: bool = True
    length_range: str = "30:999999"
    complexity_filtration: bool = False
    min_complexity: float = 0.3
    pcr_dedup: bool = False
    pcr_dedup_count: bool = False

    def __post_init__(self):
        wrong = []
        ranges = {
            "poly_mismatch_per_16mer": (0, 15), "poly_length": (1, None), "kmer_tolerance": (0, 15), "pe_adapter_diff": (0, None), "r1_r2_diff": (0, None),
            "kmer_n_match": (0, 16), "trim_score_se": (0, 16), "trim_score_pe": (0, 32), "kmer_tolerance_consensus": (0, 15), "overlap_score": (0, 16),
            "min_ratio_mismatch": (0, 1), "prob_diff": (0, 1), "quality_kmer": (0, None),
        }
        for name, (low, high) in ranges.items():
            value = getattr(self, name)
            if value < low or high is not None and value > high:
                wrong.append(f"{name} must be {low} to {'any' if high is None else high}, not {value}")
        if not 0 < self.min_complexity < 0.8:
            wrong.append(f"min_complexity must lie between 0 and 0.8, not {self.min_complexity}")
        if not self.adapter1:
            wrong.append("adapter1 is empty")
        wrong += [f"{a!r} is no DNA" for a in (*self.adapter1, *self.adapter2) if not is_dna(a)]
        for check in (lambda: quality_offset(self.quality_format), lambda: length_range(self.length_range)):
            try:
                check()
            except ValueError as e:
                wrong.append(str(e))
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def offset(self) -> int:
        return quality_offset(self.quality_format)

    @property
    def lengths(self) -> tuple[int, int]:
        return length_range(self.length_range)

    @property
    def tail_low_quality(self) -> bool:
        """Tails are cut by quality, not by N, as soon as any tail or adapter trimming is on."""
        return self.polyG or self.polyT or self.polyA or self.polyC or self.adapter_trim

    def pair(self) -> PairOptions:
        return PairOptions(
            self.kmer_tolerance, self.pe_adapter_diff, self.r1_r2_diff, self.kmer_n_match, self.trim_score_pe, self.trim_score_se,
            self.tail_length, self.consensus, self.kmer_tolerance_consensus, self.min_ratio_mismatch, self.overlap_score, self.prob_diff,
        )

    def as_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}
