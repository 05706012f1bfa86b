"""Simulated read pairs with known truth, and random trimming of them.

Every pair is made from its own number and the seed alone, so the data don't depend on partitions or retries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import ADAPTER1, ADAPTER2

_BASES = np.frombuffer(b"ATCG", np.uint8)
_PAIR = bytes.maketrans(b"ATCGN", b"TAGCN")
RATES = tuple(round(0.001 * k, 3) for k in range(1, 6))
INDELS = tuple(round(1e-5 * k, 5) for k in range(1, 6))
SCHEMA = "idx long, id1 string, seq1 string, des1 string, qual1 string, id2 string, seq2 string, des2 string, qual2 string"


def quality_char(error_rate: float) -> str:
    """
    >>> quality_char(0.001), quality_char(1e-5)
    ('?', 'J')
    """
    return "J" if error_rate < 1e-4 else chr(round(-10 * np.log10(error_rate)) + 33)


def with_errors(rng: np.random.Generator, seq: bytes, sub: float, ins: float, dele: float) -> list[bytes]:
    """What is read for each base: another one, itself and a random one, nothing, or itself."""
    u = rng.random(len(seq))
    out = [seq[k : k + 1] for k in range(len(seq))]
    for k in np.flatnonzero(u <= sub + ins + dele).tolist():
        if u[k] <= sub:
            out[k] = bytes(rng.choice([b for b in b"ATCG" if b != seq[k]], 1).astype(np.uint8))
        elif u[k] <= sub + ins:
            out[k] += _BASES[rng.integers(4, size=1)].tobytes()
        else:
            out[k] = b""
    return out


def read_of(rng: np.random.Generator, insert: bytes, adapter: bytes, rates: tuple[float, float, float], length: int) -> tuple[bytes, int, int, int]:
    """(read, true insert length, errors in the insert, errors in the adapter).

    A base inserted after the insert's last base (or over the read's end) is not part of the fragment.
    """
    parts, size, errors = [], 0, 0
    last = b""
    for own, part in zip((insert[k : k + 1] for k in range(len(insert))), with_errors(rng, insert, *rates), strict=True):
        parts.append(part)
        size += len(part)
        errors += part != own
        last = part
        if size >= length:
            break
    read = b"".join(parts)
    if size >= length:
        read = read[: size - (len(last) == 2)]
        return read, len(read), errors, 0
    true = size - (len(last) == 2)
    wrong = 0
    for own, part in zip((adapter[k : k + 1] for k in range(len(adapter))), with_errors(rng, adapter, *rates), strict=True):
        read += part
        wrong += part != own
        if len(read) >= length:
            return read, true, errors, wrong
    return read + _BASES[rng.integers(4, size=length - len(read))].tobytes(), true, errors, wrong


def simulate(
    spark: SparkSession,
    insert_sizes: list[int] | range = range(66, 121, 2),
    repeat: int = 30_000,
    seq_length: int = 100,
    adapter1: str = ADAPTER1,
    adapter2: str = ADAPTER2,
    substitution: tuple[float, ...] = RATES,
    insertion: tuple[float, ...] = INDELS,
    deletion: tuple[float, ...] = INDELS,
    seed: int = 0,
) -> DataFrame:
    """Pairs over the grid insert size x error profile x repeat, in this order of ``idx``; headers carry the truth."""
    if not len(substitution) == len(insertion) == len(deletion):
        raise ValueError("as many substitution as insertion and deletion rates are needed")
    if any(sum(r) > 1 for r in zip(substitution, insertion, deletion, strict=True)):
        raise ValueError("the rates of a profile add up to more than one")
    grid = list(product([s for s in insert_sizes if s >= 0], zip(substitution, insertion, deletion, strict=True)))
    total = len(grid) * repeat

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for idx in b.column(0).to_pylist():
                size, rates = grid[idx // repeat]
                rng = np.random.Generator(np.random.Philox(key=[seed, idx]))
                insert = _BASES[rng.integers(4, size=size)].tobytes()
                error = rates[1] + rates[2] + rates[0]
                row = {"idx": idx}
                for m, (dna, adapter) in enumerate(((insert, adapter1), (insert[::-1].translate(_PAIR), adapter2)), 1):
                    read, true, wrong, wrong_adapter = read_of(rng, dna, adapter.encode(), rates, seq_length)
                    row |= {
                        f"id{m}": f"@PeReadSimulator2:{idx + 1}:{idx % repeat + 1} TRUE={true} INSERT_SIZE={size} ERROR_RATE={error} SEQ_LENGTH={seq_length}"
                        f" ERROR_INSERT={wrong} ERROR_ADAPTER={wrong_adapter} SUB={rates[0]} INS={rates[1]} DEL={rates[2]}",
                        f"seq{m}": read.decode(), f"des{m}": "+", f"qual{m}": quality_char(error) * len(read),
                    }
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("idx", pa.int64()), *((f"{f}{m}", pa.string()) for m in (1, 2) for f in ("id", "seq", "des", "qual"))]))

    return spark.range(total).mapInArrow(make, SCHEMA)


def random_trim(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """Cut one mate of each pair to a random length; a TRUE in its header shrinks with it. A function of idx and seed (MD5)."""
    digest = lambda salt: F.md5(F.concat_ws(":", F.col("idx").cast("string"), F.lit(str(seed)), F.lit(salt)))
    draw = lambda salt: F.conv(F.substring(digest(salt), 1, 8), 16, 10).cast("long")
    first = draw("mate") % 2 == 0

    def cut(m: int, mine: Column) -> dict[str, Column]:
        seq, qual, name = (F.col(f"{f}{m}") for f in ("seq", "qual", "id"))
        keep = (draw("length") % (F.length(seq) + 1)).cast("int")
        true = F.regexp_extract(name, " TRUE=([0-9]+)", 1)
        shorter = mine & (true != "") & (keep < true.cast("int"))
        head = lambda c: F.substring(c, F.lit(1), keep)
        return {
            f"seq{m}": F.when(mine, head(seq)).otherwise(seq),
            f"qual{m}": F.when(mine, head(qual)).otherwise(qual),
            f"id{m}": F.when(shorter, F.regexp_replace(name, F.lit(" TRUE=[0-9]+"), F.concat(F.lit(" TRUE="), keep.cast("string")))).otherwise(name),
        }

    return pairs.withColumns(cut(1, first) | cut(2, ~first))
