"""Packing token sequences into as few rows of CAPACITY tokens as possible, by a configuration linear program.

The input of the program is the histogram of piece lengths: at most CAPACITY numbers, whatever the corpus. A
configuration is a multiset of lengths that fits. Covering all pieces with the fewest configurations is solved by
multiplicative weights: a length's weight falls exponentially as it gets covered, its price is its size (large ones a
little dearer, so that small ones are left to fill gaps) raised by its weight, and a knapsack dynamic program over the
capacity finds the configuration worth most. Prices over that worth are a solution of the dual program, so every
step also bounds the optimum from below; the best bound is returned with the plan. The solution is rounded down; what
remains is packed by best-fit decreasing over its histogram, and if that alone, over all pieces, needs fewer sequences it
is the plan. The plan is a table of (length, ranks, sequence numbers), as small as the histogram.

Distributed: documents are tokenised map side and written once as pieces. Where the tokenizer file allows it (checked on
load) ids come from a leaner byte-pair encoder over the same merges; tests hold it against the library. A piece's rank among those of its length
comes from its bucket (a hash; one for each PER_BUCKET pieces, BUCKETS at least), so neither a frequent length nor a hot group lies in
one task: counts per bucket and length give each bucket's first rank, a window numbers the rows inside. Only the
histogram goes to the driver; first ranks are joined on the key that the window has dealt the rows by. The plan is looked up map side.

Edge cases: a null text counts as empty (one piece: the end token); repeated rows and ids are packed as rows of their
own; longer documents are cut into whole CAPACITY pieces after a first, shorter one; empty in, empty out; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

CAPACITY, END, BUCKETS, PER_BUCKET = 1024, 2, 256, 1 << 20
#: Steps of the program; how fast a length's weight falls as it gets covered, how much its size adds to its price.
STEPS, RATE, LARGE = 700, 4.0, 0.1
#: How much a length's weight adds to its price. The program is solved for each; the best plan and the best bound count.
NEEDS = (0.05, 0.5)
LONG = 1_000_000
#: Fixed value: how byte-level pre-tokenizers cut a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORKER: dict = {}


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write bytes as characters: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def fast_encoder(tokenizer):
    """A byte-pair encoder of the same ids that skips all bookkeeping, or None where the file isn't of that kind.

    It needs a byte-level model without normalizer or prefix space whose ids are the ranks of its merges.
    """
    import tiktoken

    spec = json.loads(tokenizer.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    byte, vocab = _byte_of(), model["vocab"]
    special = {a["content"] for a in spec["added_tokens"]}
    try:
        ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    except KeyError:
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(ranks) != 256 + len(merges) or any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)):
        return None
    return tiktoken.Encoding("same", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class Ids:
    """Token ids (little-endian uint32 bytes) of whole texts by a tokenizer file."""

    def __init__(self, path: str):
        if path not in _WORKER:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _WORKER[path] = (tokenizer, fast_encoder(tokenizer), tuple(a.content for a in tokenizer.get_added_tokens_decoder().values()))
        self.tokenizer, self.fast, self.special = _WORKER[path]

    def text(self, text: str) -> bytes:
        # texts with a special string go to the library itself: such strings are tokens of their own;
        # so do very long ones, whose runs of white space would overflow the fast one's pattern matcher
        if self.fast is None or len(text) > LONG or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Ids(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    raw = coder.text(text or "") + tail
                    n = len(raw) // 4
                    s, e, p = 0, (n - 1) % capacity + 1, 0
                    while s < n:
                        piece.append(p)
                        row.append(k)
                        start.append(s)
                        length.append(e - s)
                        own = raw[4 * s : 4 * e]
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                        s, e, p = e, e + capacity, p + 1
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(cut, schema)


def _priced(value: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """Knapsack: the multiset of lengths (value[l] each, 0 where absent) worth most within the capacity, and its worth."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        v = value[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(v.argmax())
        if v[k] > best[c - 1] + 1e-15:
            best[c], took[c] = v[k], k + 1
        else:
            best[c], took[c] = best[c - 1], 0
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c]:
            out[int(took[c])] = out.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return out, float(best[capacity])


def _rest(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: equal bins move together, so the work depends on the lengths, not on the counts."""
    bins: list[Counter] = [Counter() for _ in range(capacity + 1)]  # by room left: contents -> how many
    free = np.zeros(capacity + 1, np.int64)

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        bins[room][content] += n
        free[room] += n

    for size in range(capacity, 0, -1):
        n = int(count[size])
        while n:
            fits = np.flatnonzero(free[size:])
            if len(fits):
                room = size + int(fits[0])
                content, there = next(iter(bins[room].items()))
                m = min(there, n)
                bins[room][content] -= m
                free[room] -= m
                if m == there:
                    del bins[room][content]
                put(room - size, (*content, size), m)
            elif full := n // (capacity // size):  # new bins, filled with this length alone
                k = capacity // size
                m = full * k
                put(capacity - k * size, (size,) * k, full)
            else:
                m = n
                put(capacity - n * size, (size,) * n, 1)
            n -= m
    return [(dict(Counter(content)), n) for by_content in bins for content, n in by_content.items()]


Plan = list[tuple[dict[int, int], int]]


@dataclass(frozen=True)
class Solution:
    """Configurations and how often each is used, and a lower bound (by the dual program) for the sequences of any plan."""

    plan: Plan
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.plan)


def program(demand: np.ndarray, capacity: int, steps: int = STEPS, need: float = NEEDS[0], rate: float = RATE) -> tuple[dict[tuple, float], float]:
    """Multiplicative weights for the covering program: (configuration -> amount, lower bound of its optimum)."""
    sizes = np.arange(capacity + 1) / capacity
    covered, used = np.zeros(capacity + 1), {}
    bound = float((sizes * demand).sum())  # sizes are prices too: a configuration is worth 1 at most
    worth = sizes * (1 + LARGE * sizes)
    step = max(bound, 1.0) / steps  # no fewer sequences than `steps` such steps
    for _ in range(2 * steps):
        weight = np.exp(-rate * covered / np.maximum(demand, 1))
        price = np.where(covered < demand - 1e-9, worth * (1 + need * weight), 0.0)
        if not price.any():
            break
        config, value = _priced(price, capacity)
        bound = max(bound, float((price * demand).sum()) / value)
        amount = max(min([step, *((demand[s] - covered[s]) / k for s, k in config.items())]), 1e-9)
        key = tuple(sorted(config.items()))
        used[key] = used.get(key, 0.0) + amount
        for s, k in config.items():
            covered[s] += k * amount
    return used, bound


def _rounded(used: dict[tuple, float], count: np.ndarray, capacity: int) -> Plan:
    """Whole amounts of the program's configurations, the rest by best-fit decreasing."""
    left, plan = count.copy(), []
    for key, x in sorted(used.items(), key=lambda u: -u[1]):
        n = min([int(x + 1e-6), *(int(left[s]) // k for s, k in key)])
        if n > 0:
            plan.append((dict(key), n))
            for s, k in key:
                left[s] -= n * k
    return plan + _rest(left, capacity)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS, needs: tuple[float, ...] = NEEDS, rate: float = RATE) -> Solution:
    """A plan that holds every piece exactly once, and its bound. The program runs for histograms of any size."""
    count = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        count[size] = n
    whole: Plan = [({capacity: 1}, int(count[capacity]))] if count[capacity] else []
    count[capacity] = 0
    solved = [program(count.astype(float), capacity, steps, need, rate) for need in needs]
    plans = [*(_rounded(used, count, capacity) for used, _ in solved), _rest(count, capacity)]
    best = min(plans, key=lambda p: sum(n for _, n in p))
    bound = max((b for _, b in solved), default=float(sum(count * np.arange(capacity + 1))) / capacity)
    return Solution(whole + best, sum(n for _, n in whole) + int(np.ceil(bound - 1e-6)))


def _lookup(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length a sequence, offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for config, n in plan:
        offset = 0
        for size, k in config.items():
            rows.append((size, rank.get(size, 0), first, k, offset))
            rank[size] = rank.get(size, 0) + n * k
            offset += size * k
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a table with ``length`` in 1 to capacity) with ``sequence_id`` and ``offset``; other columns stay."""
    others = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    cut = materialize(cut.select(*others), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = _lookup(solve(histogram, capacity).plan)
    shared = cut.sparkSession.sparkContext.broadcast(table)
    buckets = max(BUCKETS, sum(histogram.values()) // PER_BUCKET)
    bucketed = cut.withColumn("__bucket", F.pmod(F.xxhash64(*[c for c in others if c != "ids"]), F.lit(buckets)).cast("int"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    # one row per length and bucket
    counts = materialize(bucketed.groupBy("length", "__bucket").agg(F.count("*").alias("n")), "counts")
    first = counts.select(F.col("length").alias("__of"), F.col("__bucket").alias("__in"), F.coalesce(before, F.lit(0)).alias("__first"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        span = int(table[:, 1].max(initial=0)) + 1 if len(table) else 1
        keys = table[:, 0] * span + table[:, 1]
        for b in batches:
            length, rank = (b.column(b.num_columns - k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 1))
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            _, first, seq, k, offset = table[at].T
            inside = rank - first
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(others)], pa.array(seq + inside // k), pa.array(offset + inside % k * length)], names=[*others, "sequence_id", "offset"]
            )

    row = F.row_number().over(W.partitionBy("length", "__bucket").orderBy(*[c for c in others if c != "ids"]))
    ranked = bucketed.withColumn("__row", row).join(first, (F.col("length") == F.col("__of")) & (F.col("__bucket") == F.col("__in")))
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in others) + ", sequence_id long, offset long"
    return ranked.select(*others, F.col("length").alias("__length"), (F.col("__first") + F.col("__row") - 1).alias("__rank")).mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed rows themselves; ``packed`` carries ``ids``. A group is at most CAPACITY tokens."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs.select("doc_id", "text"), tokenizer_path, capacity), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
