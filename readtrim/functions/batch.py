"""Columns of reads as padded matrices: what the kernels work on. numpy and Arrow only, no Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: One bit a base; ambiguity codes are unions; anything else is a gap.
_BITS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15}
CODE = np.zeros(256, np.uint8)
for _k, _v in _BITS.items():
    CODE[ord(_k)] = CODE[ord(_k.lower())] = _v
LETTER = np.frombuffer(b"-ACMGRSVTWYHKDBN", np.uint8).copy()
#: Complement of a set of bases: A and T, C and G change places.
SWAP = np.array([(c & 1) << 3 | (c & 8) >> 3 | (c & 2) << 1 | (c & 4) >> 1 for c in range(16)], np.uint8)
COMPLEMENT = np.arange(256, dtype=np.uint8)
for _c in range(1, 16):
    COMPLEMENT[LETTER[_c]] = LETTER[SWAP[_c]]

PAD = 40  # columns of zeros behind every row: windows may run over the end


def to_matrix(column: pa.Array, pad: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a string column; nulls are empty; rows are padded with zeros."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    n = np.diff(offsets)
    width = int(n.max(initial=0)) + pad
    out = np.zeros((len(column), width), np.uint8)
    if len(column):
        mask = np.arange(width) < n[:, None]
        out[mask] = data[offsets[0] : offsets[-1]]
    return out, n


def to_column(matrix: np.ndarray, n: np.ndarray) -> pa.Array:
    """The first ``n`` bytes of each row as strings."""
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    data = matrix[np.arange(matrix.shape[1]) < n[:, None]]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data.tobytes())).cast(pa.string())


def chances(offset: int) -> np.ndarray:
    """Chance that a base is right by quality character: 1 - 10^(-q/10) with q at most 50; NaN below the offset."""
    q = np.arange(256) - offset
    return np.where(q < 0, np.nan, 1 - 10 ** (-np.clip(q, 0, 50) / 10))


def gather(matrix: np.ndarray, columns: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """``matrix[rows, columns]`` for a matrix of columns (inside the matrix), one line per row."""
    first = (np.arange(len(matrix)) if rows is None else rows) * matrix.shape[1]
    return np.take(matrix.ravel(), columns + first[:, None])


class Mate:
    """One mate of a batch: letters, qualities and lengths. Both matrices are zero behind each read's end."""

    def __init__(self, seq: np.ndarray, qual: np.ndarray, n: np.ndarray, offset: int = 33):
        width = max(seq.shape[1], qual.shape[1])
        self.seq, self.qual = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (seq, qual))
        self.n, self.offset = n.astype(np.int64), offset
        self._codes: np.ndarray | None = None
        self._chances: np.ndarray | None = None

    @classmethod
    def of(cls, seq: pa.Array, qual: pa.Array, offset: int = 33) -> Mate:
        s, n = to_matrix(seq)
        q, _ = to_matrix(qual)
        return cls(s, q, n, offset)

    def __len__(self) -> int:
        return len(self.n)

    @property
    def inside(self) -> np.ndarray:
        return np.arange(self.seq.shape[1]) < self.n[:, None]

    @property
    def codes(self) -> np.ndarray:
        """Bits of the bases; zero behind the end."""
        if self._codes is None:
            self._codes = CODE[self.seq]
        return self._codes

    def prob(self, columns: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Chances of the bases at ``columns``. A quality below the offset anywhere in the batch is an error."""
        if self._chances is None:
            if ((self.qual < self.offset) & (self.qual > 0)).any():
                raise ValueError("quality below the offset: wrong quality format?")
            self._chances = chances(self.offset)
        return self._chances[gather(self.qual, columns, rows)]

    def changed(self) -> None:
        self._codes = None

    def take(self, rows: np.ndarray) -> Mate:
        return Mate(self.seq[rows], self.qual[rows], self.n[rows], self.offset)

    def keep_head(self, keep: np.ndarray) -> None:
        """Keep the first ``keep`` bases where that is fewer than there are."""
        keep = np.clip(keep, 0, self.n)
        rows = np.flatnonzero(keep < self.n)
        self.n = keep
        if len(rows):
            inside = np.arange(self.seq.shape[1]) < keep[rows][:, None]
            for matrix in (self.seq, self.qual) if self._codes is None else (self.seq, self.qual, self._codes):
                matrix[rows] *= inside

    def drop_head(self, drop: np.ndarray) -> None:
        drop = np.clip(drop, 0, self.n)
        if not drop.any():
            return
        at = np.minimum(np.arange(self.seq.shape[1]) + drop[:, None], self.seq.shape[1] - 1)  # the last column is zero
        self.seq, self.qual = gather(self.seq, at), gather(self.qual, at)
        self.n = self.n - drop
        self.changed()

    def columns(self) -> tuple[pa.Array, pa.Array]:
        return to_column(self.seq, self.n), to_column(self.qual, self.n)


def reverse_complement(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros_like(codes)
    if len(n) and (n == n[0]).all():
        out[:, : n[0]] = SWAP[codes[:, : n[0]][:, ::-1]]
        return out
    at = n[:, None] - 1 - np.arange(codes.shape[1])
    return SWAP[gather(codes, np.where(at >= 0, at, codes.shape[1] - 1))]  # the last column is zero
