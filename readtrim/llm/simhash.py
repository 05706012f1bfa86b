"""SimHash near-duplicates by a trie self-join over distinct fingerprints, and their connected components.

1. Fingerprints (map side, Arrow): words of the lower-cased text, 4-word shingles with repeats, XXH64 seed 42, majority
   bits. Written once to the shared folder; copies collapse to one row per fingerprint before anything is joined.
2. The join's upper levels are keys: 64 bits are cut into m blocks; with at most 4 differing bits m - 4 of them at
   least agree, so a pair meets under one of C(m, 4) keys. m (5 to 8) is the fewest that keeps the mean key below ``GROUP``
   fingerprints; every m finds the same links. A key that holds more than ``GROUP`` is dealt into pairs of sub-blocks,
   so no task ever takes an unbounded group and no pair is lost.
3. Below a key, sorted fingerprints are a binary trie (a node is a range of rows that share a prefix). From the key's
   root, pairs of nodes are walked together level by level, differing bits add up, and a pair goes as soon as they
   exceed the budget. A node of one row is a leaf: its remaining bits are compared at once.
4. Of the links in a group only a spanning forest leaves the task (the components stay the same), then components come
   from alternating large-star and small-star steps, each materialised in the shared folder. Joins on a key that may be
   hot (a star's centre, a label, a fingerprint with many copies) deal the key's rows into parts of ``common.HOT`` rows.

Edge cases: a null or empty text has fingerprint zero and links like any other; repeated rows and ids are rows of
their own; a null id never is a component's id unless all its ids are null; extra columns are ignored; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, dealt_join, materialize

BITS, BUDGET, GROUP = 64, 4, 4096
#: Node pairs that a task splits at once.
FRONTIER = 500_000


def blocks(m: int) -> tuple[tuple[int, int], ...]:
    """``m`` blocks of the 64 bits as (shift, width), widths as equal as can be.

    >>> blocks(5)
    ((51, 13), (38, 13), (25, 13), (12, 13), (0, 12))
    """
    widths = [BITS // m + (k < BITS % m) for k in range(m)]
    return tuple((sum(widths[k + 1 :]), w) for k, w in enumerate(widths))


def block_count(n: int) -> int:
    """The fewest blocks for ``n`` fingerprints: those that agree hold log2(n / GROUP) bits at least."""
    return next((m for m in range(BUDGET + 1, 8) if n <= GROUP << (m - BUDGET) * (BITS // m)), 8)


def hashes(text: bytes, width: int = 4) -> list[int]:
    """XXH64 (seed 42) of each shingle of ``width`` words, in text order; all words if fewer; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only; splits at space and U+0009 to U+000D
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, 42)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[width:]] + [len(joined)]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)]


def fingerprints_of(texts: list[bytes], width: int = 4) -> np.ndarray:
    """Unsigned fingerprints of a batch: a bit is set if over half of the hashes have it."""
    out, start = np.zeros(len(texts), np.uint64), 0
    weights = (np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)).astype(np.uint64)
    held: list[tuple[int, list[int]]] = []

    def flush() -> None:
        rows = [(k, h) for k, h in held if h]
        if rows:
            flat = np.array([x for _, h in rows for x in h], np.uint64)
            n = np.array([len(h) for _, h in rows])
            bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=np.int32)
            out[[k for k, _ in rows]] = ((2 * sums > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        held.clear()

    for k, t in enumerate(texts):
        h = hashes(t, width)
        held.append((k, h))
        start += len(h)
        if start > 200_000:
            flush()
            start = 0
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of([x or b"" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("__text")).mapInArrow(
        make, f"`{id_col}` {kind}, fp long"
    )


def walk(fp: np.ndarray, group: np.ndarray, budget: int = BUDGET, visited: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within a group that differ in at most ``budget`` bits, in slabs of bounded size.

    ``fp`` (uint64) is sorted within runs of equal ``group``. Every group is walked from its trie's root: a node is a
    range of rows with a common prefix; pairs of nodes are split on the next bit together, their differing bits add
    up, and pairs over the budget are pruned. Pairs of leaves (one row each) are compared on what bits remain.
    ``visited`` takes the numbers of node pairs seen. At most FRONTIER node pairs are split at once, the deepest first.
    """
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    todo = [(BITS - 1, (lo, hi, lo, hi, np.zeros(len(lo), np.int8)))]
    while todo:
        bit, nodes = todo.pop()
        n = len(nodes[0])
        if not n:
            continue
        if n > FRONTIER:
            todo += [(bit, tuple(x[: n // 2] for x in nodes)), (bit, tuple(x[n // 2 :] for x in nodes))]
            continue
        if visited is not None:
            visited.append(n)
        a0, a1, b0, b1, err = nodes
        if bit < 0:  # rows of one node and equal in all bits
            for p, q, r, t in zip(*(x.tolist() for x in nodes[:4]), strict=True):
                for k in range(p, q):
                    j = np.arange(max(r, k + 1), t)
                    yield np.full(len(j), k), j
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[leaf], b0[leaf]
        near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        if near.any():
            yield i[near], j[near]
        a0, a1, b0, b1, err = (x[~leaf] for x in nodes)
        am, bm = (_first_one(fp, p, q, bit) for p, q in ((a0, a1), (b0, b1)))
        kept = []
        other = a0 != b0
        for p, q, r, t, e, ok in ((a0, am, b0, bm, err, True), (am, a1, bm, b1, err, True), (a0, am, bm, b1, err + 1, True), (am, a1, b0, bm, err + 1, other)):
            live = (p < q) & (r < t) & (e <= budget) & ok
            kept.append([x[live] for x in (p, q, r, t, e)])
        todo.append((bit - 1, tuple(np.concatenate(x) for x in zip(*kept, strict=True))))


def _first_one(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """The first row of each sorted range (common prefix above ``bit``) that has the bit, by bisection."""
    lo, hi, one = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        has = fp[mid] & one != 0
        hi[open_[has]] = mid[has]
        lo[open_[~has]] = mid[~has] + 1


def near_pairs(fp: np.ndarray, group: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of :func:`walk`."""
    found = list(walk(fp, group, budget)) or [(np.zeros(0, np.int64),) * 2]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def spanning(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of ``n`` nodes that a spanning forest needs. Pairs come and go slab by slab."""
    root = np.arange(n)
    out: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    for i, j in pairs:
        new = root[i] != root[j]  # most pairs of a large group are told here
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        while True:  # every node points to its root again
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return i, j


def _key(fp: Column, chosen: tuple[tuple[int, int], ...], number: int) -> Column:
    """One number of a choice of blocks and the bits in them (a hash: other bits may share it, which costs no link)."""
    bits = [F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in chosen]
    return F.xxhash64(F.lit(number), *bits)


def links(distinct: DataFrame, m: int | None = None) -> DataFrame:
    """Links (a < b, longs) between distinct fingerprints, enough of them to span every component."""
    m = block_count(distinct.count()) if m is None else m
    choices = tuple(combinations(blocks(m), m - BUDGET))
    keyed = distinct.select("fp", F.explode(F.array(*[_key(F.col("fp"), c, k) for k, c in enumerate(choices)])).alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    # A key's rows are dealt into `parts` sub-blocks; each pair of sub-blocks is one group of bounded size.
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int"))
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("parts")).cast("int")
    grouped = keyed.join(sizes, "key").select(
        "fp",
        "key",
        F.explode(
            F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.col("parts") - 1),
                    lambda k: F.least(k, mine) * F.col("parts") + F.greatest(k, mine),
                )
            )
        ).alias("part"),
    )

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"a": pa.int64(), "b": pa.int64()})

        def found(key, part, fp) -> pa.RecordBatch:
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) if len(key) else np.zeros(0, bool)
            group = np.cumsum(new)
            order = np.lexsort((fp, group))
            fp = fp[order]
            i, j = spanning(len(fp), walk(fp, group[order]))  # rows of different groups are different nodes
            a, b = fp.view(np.int64)[i], fp.view(np.int64)[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

        # Rows come sorted by group; a group may go on in the next batch and is bounded by 2 * GROUP or so.
        held = None
        for b in batches:
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            now[2] = now[2].astype(np.int64).view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            n = len(held[0])
            if not n:
                continue
            other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut > 4096:
                yield found(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield found(*held)

    return (
        grouped.select("key", "part", "fp")
        .repartition(F.col("key"), F.col("part"))
        .sortWithinPartitions("key", "part")
        .mapInArrow(join, "a long, b long")
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in a link: label is the component's smallest node. Large-star, then small-star."""
    edges = materialize(edges.select("a", "b"), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "low")
        large = dealt_join(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # a > b now. Small-star: every node's smaller neighbours and itself go to the smallest of them.
        large = materialize(large, "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = (
            dealt_join(large, least, "a", "b")
            .select(F.col("b").alias("x"), "m").where("x <> m")
            .union(least.select(F.col("a").alias("x"), "m"))
            .select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        )
        edges = materialize(small, "edges")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    # the smallest node of a component is its own label
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _classes(prints: DataFrame, order: Column) -> DataFrame:
    """(fp, least, n): the smallest ``order`` of each fingerprint's component, and how many rows the fingerprint has."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(order).alias("least"), F.count("*").alias("n")), "distinct")
    nodes = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "label")
    # only linked fingerprints have a component to look up; all others are their own
    linked = materialize(nodes.join(distinct.select("fp", "least"), "fp"), "linked")
    smallest = materialize(linked.groupBy("label").agg(F.min("least").alias("first"), F.count("*").alias("n")), "smallest")
    found = dealt_join(linked.select("fp", "label"), smallest, "label", "fp").select("fp", "first")
    return materialize(distinct.join(found, "fp", "left").select("fp", F.coalesce("first", "least").alias("least"), "n"), "classes")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp (signed long), ``component_id`` (smallest id of the component)."""
    # the id goes by a name of its own, whatever it is called outside
    prints = materialize(fingerprints(docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__doc")), "__id", "__doc"), "fp")
    classes = _classes(prints, F.col("__id")).withColumnRenamed("least", "component_id")
    return dealt_join(prints, classes, "fp", "__id").select(F.col("__id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group stays, all columns as they came.

    The one with the smallest ``doc_id`` (nulls last), of rows that share it the one with the smallest MD5 of its
    text; of rows alike in both any one.

    Only narrow rows are joined to tell who goes. Texts are not shuffled for it: a table of SLOTS hash slots at most, the
    slots of documents that go or are repeated, is broadcast, and documents outside them stay where they are. Those inside are
    looked at exactly, once per key.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.struct(F.isnull("doc_id").alias("nul"), F.col("doc_id").alias("id"), F.md5(text).alias("mark"))
    prints = materialize(fingerprints(docs.select(name.alias("__key"), "text"), "__key", "text"), "fp")
    decided = dealt_join(prints, _classes(prints, F.col("__key")), "fp", "__key").groupBy("__key").agg(F.min("least").alias("__least"), F.count("*").alias("n"))
    slot = lambda key: F.pmod(F.xxhash64(key["nul"], key["id"], key["mark"]), F.lit(SLOTS))
    touched = materialize(
        decided.where(~F.col("__key").eqNullSafe(F.col("__least")) | (F.col("n") > 1))
        .select(F.col("__key"), F.col("__key").eqNullSafe(F.col("__least")).alias("stays")),
        "touched",
    )
    slots = materialize(touched.select(slot(F.col("__key")).alias("__slot")).distinct(), "slots")
    # rows by position: columns of the input may have any name
    rows = docs.select(F.struct("*").alias("__row"), name.alias("__key"))
    rows = rows.withColumn("__slot", slot(F.col("__key")))
    clear = rows.join(F.broadcast(slots), "__slot", "left_anti").select("__row.*")
    doubtful = rows.join(F.broadcast(slots), "__slot", "left_semi").select("__row", "__key").dropDuplicates(["__key"])
    gone = touched.where(~F.col("stays")).select(F.col("__key").alias("__gone"))
    same = F.col("__key.mark").eqNullSafe(F.col("__gone.mark")) & F.col("__key.nul").eqNullSafe(F.col("__gone.nul")) & F.col("__key.id").eqNullSafe(F.col("__gone.id"))
    return clear.unionAll(doubtful.join(gone, same, "left_anti").select("__row.*"))


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _xxh64_sql(text: str, seed: int = 42) -> str:
    """XXH64 of a string's UTF-8 bytes in 128-bit whole numbers, as a column expression; ``text`` is a column."""
    wide = 1 << 64
    low = lambda x: f"(({x}) & {wide - 1}::UHUGEINT)"
    turn = lambda x, r: low(f"({x} << {r}) | ({x} >> {64 - r})")
    num = lambda at, n: "cast('0x' || " + " || ".join(f"substr(hexed, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + " AS UHUGEINT)"
    once = lambda value, body: f"list_transform([{value}], lambda x: {body})[1]"  # noqa: E731  a value that is used twice
    mixed = lambda acc, lane: low(once(low(f"{acc} + {lane} * {_P2}::UHUGEINT"), turn("x", 31)) + f" * {_P1}::UHUGEINT")
    start = [(seed + _P1 + _P2) % wide, (seed + _P2) % wide, seed, (seed - _P1) % wide]
    acc = [f"list_reduce(list_transform(range(0, size // 32), lambda s: {num(f'32 * s + {8 * k}', 8)}), lambda a, y: {mixed('a', 'y')}, {v}::UHUGEINT)" for k, v in enumerate(start)]
    joined = low(" + ".join(turn(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    for k in range(4):
        joined = low(f"xor({joined}, {mixed('0::UHUGEINT', f'v{k}')}) * {_P1}::UHUGEINT + {_P4}::UHUGEINT")
    rest = "size // 32 * 32"
    eights = f"list_transform(range({rest}, {rest} + (size % 32) // 8 * 8, 8), lambda o: {num('o', 8)})"
    by8 = low(once(f"xor(a, {mixed('0::UHUGEINT', 'y')})", turn("x", 27)) + f" * {_P1}::UHUGEINT + {_P4}::UHUGEINT")
    fours = f"CASE WHEN size % 8 >= 4 THEN [{num('size // 8 * 8', 4)}] ELSE [] END"
    by4 = low(once(f"xor(a, {low(f'y * {_P1}::UHUGEINT')})", turn("x", 23)) + f" * {_P2}::UHUGEINT + {_P3}::UHUGEINT")
    ones = f"list_transform(range(size // 4 * 4, size), lambda o: {num('o', 1)})"
    by1 = low(once(f"xor(a, {low(f'y * {_P5}::UHUGEINT')})", turn("x", 11)) + f" * {_P1}::UHUGEINT")
    return f"""x0 AS (SELECT DISTINCT {text} AS shingle, hex(encode({text})) AS hexed FROM shingles),
x1 AS (SELECT *, length(hexed) // 2 AS size FROM x0),
x2 AS (SELECT *, {', '.join(f'{a} AS v{k}' for k, a in enumerate(acc))} FROM x1),
x3 AS (SELECT shingle, hexed, size, {low(f"CASE WHEN size >= 32 THEN {joined} ELSE {(seed + _P5) % wide}::UHUGEINT END + cast(size AS UHUGEINT)")} AS h FROM x2),
x4 AS (SELECT shingle, hexed, size, list_reduce({eights}, lambda a, y: {by8}, h) AS h FROM x3),
x5 AS (SELECT shingle, hexed, size, list_reduce(cast({fours} AS UHUGEINT[]), lambda a, y: {by4}, h) AS h FROM x4),
x6 AS (SELECT shingle, list_reduce({ones}, lambda a, y: {by1}, h) AS h FROM x5),
x7 AS (SELECT shingle, {low(f"xor(h, h >> 33) * {_P2}::UHUGEINT")} AS h FROM x6),
x8 AS (SELECT shingle, {low(f"xor(h, h >> 29) * {_P3}::UHUGEINT")} AS h FROM x7),
hashed AS (SELECT shingle, cast(xor(h, h >> 32) AS UBIGINT) AS h FROM x8)"""


_BITS_SQL = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(BITS))
#: Fingerprints by XXH64 in plain arithmetic, links by comparing all distinct fingerprints, components by walking links.
SQL = f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT k, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM docs)),
{_xxh64_sql("shingle")},
prints AS MATERIALIZED (SELECT docs.k, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM docs LEFT JOIN
  (SELECT k, {_BITS_SQL} AS fp FROM shingles JOIN hashed USING (shingle) GROUP BY k) f ON docs.k = f.k),
nodes AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {BUDGET}),
reach(a, b) AS (SELECT fp, fp FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT r.a AS fp, min(n.least) AS component_id FROM reach r JOIN nodes n ON r.b = n.fp GROUP BY r.a)
SELECT doc_id, lpad(lower(hex(p.fp)), 16, '0') AS fingerprint, component_id FROM prints p JOIN found f ON p.fp = f.fp"""
