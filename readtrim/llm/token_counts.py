"""Exact token counts of whole texts by a two-tier, map-side lookup; no pre-token is ever shuffled.

Tier 1 is a broadcast table of the corpus's frequent pre-tokens and their token counts. Each scan task summarises
its texts with Misra-Gries counters (at most ``SUMMARY`` rows leave a task, whatever it read); the summaries of all
tasks are added up and the ``TABLE`` most frequent pre-tokens are encoded once: a proven bound of TABLE rows of at
most ``KEY`` characters. Tier 2 is a cache in each Python worker: a pre-token that the table misses is encoded once
per worker and kept (the cache is emptied at ``CACHE`` entries; that costs time, never exactness).

A pre-token here is a piece of text at whose edges the SentencePiece model can't merge: no piece of the vocabulary
holds a space mark after another character, nor a newline (``Counter_`` checks this and else encodes whole texts).
So token counts of pre-tokens add up to the count of the whole text.

Texts are cut into pre-tokens, and equal ones of a batch told, by Arrow's kernels; only texts with unusual spaces are cut in
Python. A batch looks each different pre-token up once.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated ids each keep their row;
null ids pass through; other columns are ignored; an empty table gives an empty result; no text is cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY, TABLE, KEY, CACHE, COUNTERS = 1024, 32_768, 48, 400_000, 65_536
_RUNS = re.compile(r"^[^ ]+| +[^ ]*")
_MARK = "▁"


def pre_tokens(text: str) -> list[str]:
    """Keys whose counts add up to the text's: ``"\\n"`` leads keys that follow a newline, the rest stand after a space.

    >>> pre_tokens("a b\\nc  d ")
    ['a', 'b', '\\nc', ' d', '']
    """
    if not text:
        return []
    out: list[str] = []
    for k, line in enumerate(text.replace(_MARK, " ").split("\n")):
        if "  " in line or line[:1] == " " or line[-1:] == " ":
            # runs of spaces stay with the word that they precede; one space of each run is the key's own mark
            parts = _RUNS.findall(line if k else " " + line)
            first = parts.pop(0) if k and line[:1] != " " else None
            if k:
                out.append("\n" + (first or ""))
            out += [x[1:] for x in parts]
        else:
            parts = line.split(" ")
            if k:
                parts[0] = "\n" + parts[0]
            out += parts
    return out


class Encoder:
    """Token counts of keys and texts by a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = " a  b Äﬁ　 c"
        self.splits = (
            not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces)
            and self.sp.piece_to_id(_MARK) != self.sp.unk_id()
            and self.sp.normalize(probe) == _MARK + probe.replace(" ", _MARK)
        )

    def keys(self, text: str) -> list[str]:
        return pre_tokens(text) if self.splits else [text] if text else []

    def count(self, keys: list[str]) -> list[int]:
        found = [len(x) for x in self.sp.encode(keys, num_threads=1)] if keys else []
        if self.splits:
            # a newline key carries the dummy mark that the text has not; an empty key is a lone mark
            found = [n - 1 if k[:1] == "\n" else n or 1 for k, n in zip(keys, found, strict=True)]
        return found


#: What makes a text's lines begin or end with a space or hold runs of them.
_UNUSUAL = "  | \n|\n |^ | $|^$"


def keyed(enc: Encoder, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different keys, number of each key occurrence, its row) of a batch of strings."""
    texts = pc.fill_null(texts, "")
    if not enc.splits:
        rows = np.flatnonzero(pc.not_equal(texts, "").to_numpy(zero_copy_only=False))
        found = texts.take(pa.array(rows)).dictionary_encode()
        return found.dictionary, found.indices.to_numpy(zero_copy_only=False), rows
    texts = pc.replace_substring(texts, _MARK, " ")
    odd = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    # in a text with single spaces, none of them beside a newline, a space before each newline makes the keys
    lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
    slow = [enc.keys(t) for t in texts.take(pa.array(rest)).to_pylist()]
    values = pa.concat_arrays([lists.flatten(), pa.array(chain.from_iterable(slow), texts.type)]).dictionary_encode()
    rows = np.concatenate([np.repeat(plain, pc.list_value_length(lists).to_numpy(zero_copy_only=False)), np.repeat(rest, [len(x) for x in slow]).astype(np.int64)])
    return values.dictionary, values.indices.to_numpy(zero_copy_only=False), rows


_WORKER: dict = {}


def _worker(path: str) -> tuple[Encoder, dict[str, int]]:
    if path not in _WORKER:
        _WORKER[path] = (Encoder(path), {})
    return _WORKER[path]


def _prune(counts: Counter, k: int) -> None:
    """Misra-Gries: keep at most ``k`` counters by taking the (k+1)-th largest count off all."""
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        for x in [x for x, n in counts.items() if n <= cut]:
            del counts[x]


def frequent(docs: DataFrame, model_path: str, text_col: str = "text") -> dict[str, int]:
    """Tier 1: the most frequent pre-tokens of all texts with their token counts."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = _worker(model_path)[0], Counter()
        for b in batches:
            if enc.splits:
                keys, codes, _ = keyed(enc, b.column(0))
                n = np.bincount(codes, minlength=len(keys))
                if len(n) > COUNTERS:  # Misra-Gries within the batch first
                    n = n - np.partition(n, len(n) - COUNTERS - 1)[len(n) - COUNTERS - 1]
                some = np.flatnonzero(n > 0)
                counts.update(dict(zip(keys.take(pa.array(some)).to_pylist(), n[some].tolist(), strict=True)))
                _prune(counts, COUNTERS)
        top = [(k, n) for k, n in counts.most_common(4 * SUMMARY) if len(k) <= KEY][:SUMMARY]
        yield pa.RecordBatch.from_pylist([{"k": k, "n": n} for k, n in top], pa.schema({"k": pa.string(), "n": pa.int64()}))

    found = (
        docs.select(F.col(text_col).cast("string").alias("t"))
        .mapInArrow(summarise, "k string, n long")
        .groupBy("k").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "k").limit(TABLE).select("k").collect()
    )
    keys = [r.k for r in found]
    return dict(zip(keys, Encoder(model_path).count(keys), strict=True))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens`` of the whole text, ``over_limit``."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, model_path, text_col))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cache = _worker(model_path)
        first = table.value
        for b in batches:
            texts = b.column(1)
            keys, codes, rows = keyed(enc, texts)
            own = keys.to_pylist()
            missing = [k for k in own if k not in first and k not in cache]
            if len(cache) + len(missing) > CACHE:
                cache.clear()
                missing = [k for k in own if k not in first]
            extra = dict(zip(missing, enc.count(missing), strict=True))
            counts = np.fromiter((first[k] if k in first else extra[k] if k in extra else cache[k] for k in own), np.int64, len(own))
            n_tokens = np.bincount(rows, counts[codes], b.num_rows).astype(np.int64)
            if len(cache) < CACHE:
                cache.update((k, n) for k, n in extra.items() if len(k) <= KEY)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
