"""Known adapters: what single-end detection tries."""

from __future__ import annotations

# The first 16 bases of widely used library adapters and primers.
KNOWN_ADAPTERS = (
    "AAGTCGGAGGCCAAGC", "AAGTCGGATCGTAGCC", "AATGATACGGCGACCA", "ACACTCTTTCCCTACA", "AGATCGGAAGAGCACA", "AGATCGGAAGAGCGGT", "AGATCGGAAGAGCGTC",
    "AGATCGGAAGAGCTCG", "CAAGCAGAAGACGGCA", "CCACTACGCCTCCGCT", "CCGACAGGTTCAGAGT", "CCGAGCCCACGAGACA", "CCGAGCCCACGAGACC", "CCGAGCCCACGAGACG",
    "CCGAGCCCACGAGACT", "CGACAGGTTCAGAGTT", "CGGTCTCGGCATTCCT", "CTAATACGACTCACTA", "CTGAGCGGGCTGGCAA", "CTGATGGCGCGAGGGA", "CTGCCCCGGGTTCCTC",
    "CTGTCTCTTATACACA", "GACGCTGCCGACGAAC", "GACGCTGCCGACGAAG", "GACGCTGCCGACGAAT", "GACGCTGCCGACGACG", "GACGCTGCCGACGACT", "GACGCTGCCGACGAGC",
    "GACGCTGCCGACGATA", "GACGCTGCCGACGATC", "GATCGGAAGAGCACAC", "GATCGGAAGAGCGGTT", "GATCGGAAGAGCGTCG", "GATCGGAAGAGCTCGT", "GATCGTCGGACTGTAG",
    "GTCTCGTGGGCTCGGA", "GTGACTGGAGTTCAGA", "TACACTCTTTCCCTAC", "TCGGACTGTAGAACTC", "TCGTCGGCAGCGTCAG", "TGGAATTCTCGGGTGC",
)
