"""The reads of ``queries.PAIRS_SQL`` made from keys in an Arrow pass, batch by batch: the same rows for a small part of its time.

Spark's ``translate`` looks every character up by itself, which is most of what the SQL costs there. Here the MD5 digests
of a batch are one matrix of hex digits, and bases, qualities and the seven flaws are look-ups in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.batch import COMPLEMENT, gather, to_column, to_matrix

_BASES = np.frombuffer(b"ACGT" * 4, np.uint8)
_QUALS = np.frombuffer(b"IIIIIIIIHHHGF5+#", np.uint8)
_BEHIND = [np.frombuffer(a, np.uint8) for a in (b"AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", b"AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT")]
_WRONG = np.arange(256, dtype=np.uint8)
_WRONG[list(b"ACGT")] = list(b"CGTA")
_LENGTH, _ROWS = 100, 2048
_COLUMNS = ("seq1", "qual1", "seq2", "qual2")


_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])


def digests(customer: np.ndarray) -> np.ndarray:
    """MD5 of ``<customer>:0`` to ``<customer>:9``: ten times 16 bytes a row. Each text is one block, so all of them go round together."""
    text, n = to_matrix(pa.array(customer, pa.int64()).cast(pa.string()), 0)
    rows, each = len(n), np.arange(len(n))
    blocks = np.zeros((10, rows, 64), np.uint8)
    blocks[:, :, : text.shape[1]] = text
    blocks[:, each, n] = ord(":")
    blocks[:, each, n + 1] = ord("0") + np.arange(10)[:, None]
    blocks[:, each, n + 2] = 0x80
    blocks[:, :, 56] = (n + 2) * 8
    words = np.ascontiguousarray(blocks.view("<u4").reshape(10 * rows, 16).T)
    start = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
    a, b, c, d = (np.full(10 * rows, x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        f += words[g]
        turn = np.uint32(_TURNS[i // 16, i % 4])
        a, d, c, b = d, c, b, b + (f << turn | f >> (np.uint32(32) - turn))
    out = np.stack([a, b, c, d], axis=1) + start
    return out.astype("<u4").view(np.uint8).reshape(10, rows, 16).transpose(1, 0, 2).reshape(rows, 160)


def make(idx: np.ndarray, v: np.ndarray, customer: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bytes, lengths) of seq1, qual1, seq2 and qual2."""
    rows = len(idx)
    data = digests(customer)
    digits = np.stack([data >> 4, data & 15], axis=2).reshape(rows, 320)
    dna, filler, q = _BASES[digits[:, :128]], _BASES[digits[:, 128:192]], _QUALS[digits[:, 192:]]
    size = np.maximum(40 + np.fmod(customer, 81), 0)[:, None]
    at = np.arange(_LENGTH)
    inside, behind = at < size, np.maximum(at - size, 0)
    seqs = []
    for k, adapter in enumerate(_BEHIND):
        tail = np.zeros((rows, _LENGTH), np.uint8)  # an empty insert's read ends with its filler
        tail[:, :33], tail[:, 33:97] = adapter, filler
        insert = dna[:, :_LENGTH] if k == 0 else COMPLEMENT[gather(dna, np.maximum(size - 1 - at, 0))]
        seqs.append(np.where(inside, insert, gather(tail, behind)))
    n = np.minimum(size[:, 0] + 97, _LENGTH)
    s, p = seqs[0], q[:, :_LENGTH].copy()
    n1, np1 = n.copy(), np.full(rows, _LENGTH)
    s[v == 0, 88:], n1[v == 0] = ord("N"), _LENGTH
    s[v == 1, 80:], n1[v == 1] = np.frombuffer(b"GGGGGGGGGAGGGGGGGGGG", np.uint8), _LENGTH
    s[v == 2, 20:80] = ord("A")
    p[v == 3, 88:] = ord("!")
    short = v == 4
    n1[short], np1[short] = np.minimum(n, 20 + np.fmod(idx, 81))[short], (20 + np.fmod(idx, 81))[short]
    s[v == 5, 9], p[v == 5, 9] = _WRONG[s[v == 5, 9]], ord("#")
    p[v == 6, 70:] = ord("#")
    return [(s, n1), (p, np1), (seqs[1], n), (q[:, ::-1][:, :_LENGTH], np.full(rows, _LENGTH))]


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, _ROWS):  # matrices that stay in a core's cache
            rb = whole.slice(first, _ROWS)
            idx, customer = (c.fill_null(0).cast(pa.int64()).to_numpy() for c in rb.columns)
            v = np.where(rb.column(0).is_null().to_numpy(zero_copy_only=False), -1, np.fmod(idx, 7))  # no key, no flaw
            made = [to_column(*c) for c in make(idx, v, customer)]
            if rb.column(1).null_count:
                made = [pa.array(np.where(rb.column(1).is_null().to_numpy(zero_copy_only=False), None, c.to_numpy(zero_copy_only=False)), pa.string()) for c in made]
            yield pa.RecordBatch.from_arrays([*rb.columns, *made], names=[*rb.schema.names, *_COLUMNS])


def read_pairs(keys: DataFrame) -> DataFrame:
    """The columns of PAIRS_SQL for ``keys`` (o_orderkey, o_custkey), in their order."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields), *(f"{c} string" for c in _COLUMNS)])
    key, size = F.col("o_orderkey"), 40 + F.col("o_custkey") % 81
    name = lambda k, m: F.concat(F.lit("@sim:"), k.cast("string"), F.lit(f" {m}"))
    return keys.mapInArrow(_run, schema).select(
        key.alias("idx"), (key % 7).alias("v"), size.cast("int").alias("insert_size"), F.least(size.cast("int"), F.lit(100)).alias("true_len"),
        name(key, 1).alias("id1"), name(F.when(key % 50 == 0, key + 1).otherwise(key), 2).alias("id2"), "seq1", "seq2", "qual1", "qual2",
    )
