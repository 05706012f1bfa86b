"""A real pair of reads whose insert is 187 bases long (fixed values), and helpers."""

import numpy as np
import pyarrow as pa

from readtrim.functions.batch import Mate

SEQ1 = (
    "ACCCAAGGCGTGCTCGTAGGATTTGTCGACATAGTCGATCAGACCTTCGTCCAGCGGCCAGGCGTTAACCTGACCTTCCCAATCGTCGATGATGGTGTTGCCGAAGCGGAACACTTCACTTTGCAGGTACGGCACGCGCGCGGCGACCCAGG"
    "CAGCCTTGGCGGCTTTCAGGGTCTCGGCGTTCGGCCTGTCTCTTATACACATCTCCGAGCCCACGAGCCGTAGAGGAATCTCGTATGCCGTCTTCTGCTTGAAAAAAAAAGACAAGCACTCTATACATCCGTCTCACCCGATACACTCC"
)
QUAL1 = (
    "CCCCCGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGFGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGDGGGGGGDGGGGGGG"
    "GCGGGGGGGGGGGGGGGGFGGGGGGFGGGGGGGGGGGGGGFGGGEDGG>GFFGGGGDGGGDGFGG7;)9C>DF3B4)76676:@DF?F?>D@F3=FFFF?=<6*600)07).)0.)818)))**0=***))0((.**)0))0.7*/62("
)
SEQ2 = (
    "GCCGAANNCCGAGACCCTGAAAGCCGCCAAGGCTGCCTGGGTCGCCGCGCGCGTGCCGTACCTGCAAAGTGAAGTGTTCCGCTTCGGCAACACCATCATCGACGATTGGGAAGGTCAGGTTAACGCCTGGCCGCTGGACGAAGGTCTGATCG"
    "ACTATGTCGACAAATCCTACGAGCACGCCTTGGGTCTGTCTCTTATACACCTCTGACGCTGCCGACGATACCCCCTGTGTCACACTTCGCAGTCGACGTCTCCGTAACAAAAACTCAGAAGTATACACTAGAATACTACGTAGGATATC"
)
QUAL2 = (
    "CCCCCG##GGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGGDGGGGGGGGGGGGGGGGFGGGGGGGGGGGFGGGGGGGGGGGGGGGGGGGGGGEDGGGGGFGGGGGGGGGFFFCFGGDGGCGFDCCEC>E>EGGGG7EFGGFG"
    "GEEE9FFGFFEDGGDFGGGGG**9DDDCEFDFDD5CFD>**::C699FG><57*)7FBDB3)8>>@>EB>:9)7)5)))1**8*))**.)))0)))))0000*).50.19)08().4)))..).64-))5).)).-)-)(().(+++++"
)
_SWAP = str.maketrans("ACGTN", "TGCAN")


def rc(s: str) -> str:
    return s[::-1].translate(_SWAP)


def mate(*seqs: str, quals: tuple[str, ...] | None = None) -> Mate:
    return Mate.of(pa.array(list(seqs), pa.string()), pa.array(list(quals or ["I" * len(s) for s in seqs]), pa.string()))


def text(m: Mate) -> list[str]:
    return m.columns()[0].to_pylist()


def random_reads(rng: np.random.Generator, n: int, low: int = 0, high: int = 60, letters: str = "ACGT") -> list[str]:
    return ["".join(rng.choice(list(letters), rng.integers(low, high + 1))) for _ in range(n)]
