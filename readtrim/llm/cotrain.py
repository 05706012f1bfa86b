"""Quality classifier by co-training: a text view and a metadata view teach each other, then score all documents.

* Text view: hashed words, word shapes and form ratios of the whole text (DIM features). Metadata view: language,
  source, their pair and the length class (META features).
* Both views of every row are made once, map side, and kept as sparse rows in the shared folder; every later step
  (drawing the sample, each round's scores, the final ones) reads those instead of the texts.
* Each round both logistic models are fitted, score every document, and each hands its MOST most confident documents
  of either class (at least CONFIDENT sure) to the other's training set as pseudo-labels.
* Both views are calibrated (Platt) on a held-out fifth of the labelled sample; the final score adds their calibrated
  log-odds to the log-odds of the share of good labels. A document is kept if the calibrated views together speak for it.

Models are fitted on the driver: on at most SAMPLE labelled documents of each class (those with the smallest hash of
their id) and at most 2 * MOST pseudo-labels a view and round; these are documented bounds, and so is the size of
the weights that are broadcast (DIM + META numbers). Scoring covers every document, map side, whole texts.

Edge cases: null texts count as empty, null metadata is a value of its own; labels without a document or a
null label are ignored, repeated labels of a document are averaged; without two classes among the labels every
document gets their share (0.5 if none) and is kept; repeated rows are scored each; empty in, empty out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_batches, materialize

DIM, META, FORM = 4096, 256, 16
SAMPLE, MOST, ROUNDS, CONFIDENT = 1500, 250, 2, 0.9
_SYMBOLS = "#*$%&|<>"
_LIMIT = 100_000
_WORDS: dict[str, tuple[int, int, int]] = {}
_SHAPES: dict[str, int] = {}


class _Kinds(dict):
    """Letter, digit or sign, for str.translate."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return self[code]


_KINDS = _Kinds()


def _slot(x: str, dim: int) -> int:
    return xxh64_intdigest(x, 11) % dim


def _shape(kinds: str) -> int:
    """Slot of a word's beginning and end as kinds of characters, runs as one."""
    found = _SHAPES.get(kinds)
    if found is None:
        out = "".join(c for k, c in enumerate(kinds) if not k or kinds[k - 1] != c)
        found = FORM + _slot("s" + out, DIM - FORM)
        if len(_SHAPES) < _LIMIT:
            _SHAPES[kinds] = found
    return found


def _word(word: str) -> tuple[int, int, int]:
    """(slot of the word, slot of its shape, capitals)."""
    made = (FORM + _slot("w" + word.lower(), DIM - FORM), _shape((word[:4] + word[-4:]).translate(_KINDS)), 0 if word.islower() else sum(map(str.isupper, word)))
    if len(word) <= 48:
        if len(_WORDS) >= _LIMIT:
            _WORDS.clear()
        _WORDS[word] = made
    return made


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of the text view: form ratios, and hashed words and shapes (log counts, unit length)."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int16), np.zeros(0, np.float32)
    counts = Counter(words)
    look = _WORDS.get
    rows = [look(w) or _word(w) for w in counts]
    table = np.array(rows, np.int64)
    k = np.fromiter(counts.values(), np.float64, len(rows))
    v = np.bincount(table[:, 0], k, DIM) + np.bincount(table[:, 1], k, DIM)
    slots = np.flatnonzero(v)
    values = np.log1p(v[slots])
    values /= max(float(np.linalg.norm(values)), 1e-9)
    chars = max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    form = (
        min(sum(text.count(c) for c in _SYMBOLS) / n, 2.0),
        min(text.count("!") / n, 2.0),
        min((chars - n) / n / 8, 3.0),
        len(counts) / n,
        float(k.max()) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        min(float(k @ table[:, 2]) / chars, 1.0),
        min(math.log1p(n) / 8, 2.0),
        min(len(lines) / n * 4, 2.0),
        1.0,
    )
    return np.concatenate([np.arange(len(form)), slots]).astype(np.int16), np.concatenate([form, values]).astype(np.float32)


def meta_features(lang: str | None, source: str | None, n: int) -> np.ndarray:
    """Slots of the metadata view, each worth 0.5 (a slot may be there twice)."""
    return np.array([_slot(x, META) for x in (f"l{lang}", f"s{source}", f"p{lang}|{source}", f"n{int(n).bit_length()}")], np.int16)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, lr: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over the whole sample; classes weigh the same."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32) / len(y)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y).astype(np.float32) * weight
        gw, gb = x.T @ g + l2 * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= lr * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) with log-odds a * z + b, on held-out scores; targets are smoothed, classes weigh the same."""
    z = np.clip(z, -30, 30)
    pos, neg = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = weight * (p - t)
        h = np.maximum(weight * p * (1 - p), 1e-12)
        ga, gb = (g * z).sum(), g.sum()
        haa, hab, hbb = (h * z * z).sum() + 1e-6, (h * z).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


def _views(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, slots, values, meta): both views of every row, sparse."""
    arrays = {"slots": pa.int16(), "values": pa.float32(), "meta": pa.int16()}

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                text, lang, source = (part.column(k).to_pylist() for k in (1, 2, 3))
                made = [text_features(x or "") for x in text]
                meta = [meta_features(lg, s, len(x or "")) for x, lg, s in zip(text, lang, source, strict=True)]
                columns = ([m[0] for m in made], [m[1] for m in made], meta)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(_lists(c, kind) for c, kind in zip(columns, arrays.values(), strict=True))], names=[id_col, *arrays]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    columns = docs.select(F.col(id_col), *[F.col(c).cast("string").alias(f"__{c}") for c in ("text", "lang", "source")])
    return bounded_batches(columns).mapInArrow(make, f"`{id_col}` {kind}, slots array<smallint>, values array<float>, meta array<smallint>")


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, elements) of a list column."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]


def _known(views: DataFrame, ids: DataFrame, id_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both views of the documents with these ids, dense; ``ids`` is bounded by the caller (SAMPLE, MOST)."""
    picked = views.join(F.broadcast(ids.select(id_col)), id_col, "left_semi")
    # copies of an id: the one with the fewest, then smallest features, whatever the partitions
    own = picked.groupBy(id_col).agg(F.min(F.struct(F.size("slots").alias("n"), "slots", "values", "meta")).alias("v"))
    out = {}
    for r in own.select(id_col, "v.slots", "v.values", "v.meta").toLocalIterator():
        t, m = np.zeros(DIM, np.float32), np.zeros(META, np.float32)
        t[r.slots] = r["values"]
        np.add.at(m, r.meta, 0.5)
        out[r[0]] = (t, m)
    return out


def _scored(views: DataFrame, models, id_col: str) -> DataFrame:
    """(id, z_text, z_meta): calibrated log-odds of both views for every row."""
    shared = views.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (wt, bt, at, ct), (wm, bm, am, cm) = shared.value
        line = lambda z, a, c: pa.array(np.clip(z, -30, 30) * a + c)
        for b in batches:
            row, slots = _flat(b.column(1))
            _, values = _flat(b.column(2))
            meta_row, meta = _flat(b.column(3))
            zt = np.bincount(row, wt[slots] * values.astype(np.float64), b.num_rows) + bt
            zm = np.bincount(meta_row, wm[meta] * 0.5, b.num_rows) + bm
            yield pa.RecordBatch.from_arrays([b.column(0), line(zt, at, ct), line(zm, am, cm)], names=[id_col, "z_text", "z_meta"])

    kind = views.schema[id_col].dataType.simpleString()
    return bounded_batches(views).mapInArrow(score, f"`{id_col}` {kind}, z_text double, z_meta double")


def _most(scored: DataFrame, view: str, id_col: str) -> list[tuple[int, int]]:
    """(id, class) of the documents this view is surest of: MOST of each class, one per id."""
    sure = math.log(CONFIDENT / (1 - CONFIDENT))
    out = []
    for label, order, test in ((1, F.desc(view), F.col(view) >= sure), (0, F.asc(view), F.col(view) <= -sure)):
        top = scored.where(test & F.col(id_col).isNotNull()).orderBy(order, id_col).select(id_col).limit(MOST).collect()
        out += [(r[0], label) for r in top]
    return list(dict.fromkeys(out))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, ``p_text``, ``p_meta``, ``score`` (probability of being good) and ``kept``: the views' joint evidence
    speaks for good (score >= the share of good labels, so that rare bad documents aren't overruled by their rarity)."""
    spark = docs.sparkSession
    given = materialize(
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col)
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y")),
        "labels",
    )
    share = given.agg(F.avg("y")).first()[0]
    lg = lambda c: 1 / (1 + F.exp(-F.col(c)))
    if share is None or share in (0.0, 1.0):
        p = F.lit(0.5 if share is None else float(share))
        return docs.select(id_col, p.alias("p_text"), p.alias("p_meta"), p.alias("score"), F.lit(True).alias("kept"))
    picked = materialize(
        given.where("y = 1").orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).union(given.where("y = 0").orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)),
        "sample",
    )
    truth = {r[0]: r.y for r in picked.collect()}
    views = materialize(_views(docs, id_col), "views")
    known = _known(views, picked, id_col)
    ids = sorted((i for i in known if i in truth), key=lambda i: _slot(str(i), 1 << 30))
    held, train = ids[: len(ids) // 5], ids[len(ids) // 5 :]
    extra: list[dict] = [{}, {}]  # pseudo-labels of the text view's and the metadata view's training sets

    def both():
        models = []
        for view in (0, 1):
            rows = [(known[i][view], truth[i]) for i in train] + [(known[i][view], y) for i, y in extra[view].items()]
            y = np.array([r[1] for r in rows], np.float32)
            if len(set(y.tolist())) < 2:
                models.append((np.zeros((DIM, META)[view], np.float32), 0.0, 0.0, 0.0))
                continue
            w, b = fit(np.stack([r[0] for r in rows]), y)
            z = np.array([float(known[i][view] @ w) + b for i in held])
            a, c = platt(z, np.array([truth[i] for i in held])) if held else (1.0, 0.0)
            models.append((w, b, a, c))
        return models

    for _ in range(rounds):
        scored = materialize(_scored(views, both(), id_col), "scored")
        chosen = {"z_text": _most(scored, "z_text", id_col), "z_meta": _most(scored, "z_meta", id_col)}
        new = {i for found in chosen.values() for i, _ in found if i not in truth and i not in known}
        if new:
            frame = spark.createDataFrame([(i,) for i in sorted(new)], docs.select(id_col).schema)
            known |= _known(views, frame, id_col)
        for view, teacher in ((0, "z_meta"), (1, "z_text")):  # each is taught by the other
            extra[view] |= {i: y for i, y in chosen[teacher] if i not in truth and i in known}
    prior = math.log(share / (1 - share))
    return (
        _scored(views, both(), id_col)
        .withColumn("z", F.col("z_text") + F.col("z_meta") + F.lit(prior))
        .select(id_col, lg("z_text").alias("p_text"), lg("z_meta").alias("p_meta"), lg("z").alias("score"), (F.col("z_text") + F.col("z_meta") >= 0).alias("kept"))
    )
