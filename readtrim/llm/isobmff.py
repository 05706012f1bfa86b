"""ISO base media files: write payloads as raw samples, and read codec, duration and keyframe byte ranges from the boxes.

The reader walks nested boxes (32- and 64-bit sizes, size 0 = to the end) with a stack, so depth costs nothing, decodes
the sample tables (stts, stsc, stsz or stz2, stco or co64, stss) and fragments (trex, tfhd, trun), and never touches a
sample: ranges come from the tables alone. Counts are held against the file's length before anything is allocated.
Every track is returned; the file's own figures are those of its first video track, or of its first track without one.

The writer stores a payload as 8-bit PCM (`raw `) in one track, SAMPLE bytes a sample, CHUNK samples a chunk, every
KEY-th sample marked as a sync sample; it has no clock and no random ids, so equal texts give equal files.

Edge cases: a null text counts as empty (one sample of zeros); repeated rows stay; a file that is not a whole box
structure, or whose tables contradict each other or its length, has status ``broken`` and null figures; a file without a
track is ``no track``; one whose tracks hold no samples is ``no samples``; empty in, empty out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, CHUNK, KEY, RATE = 64, 512, 16, 8000
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}  # boxes that hold boxes only


def _box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)
    return b"".join((head, *parts))


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write(payload: bytes) -> bytes:
    """A file that holds ``payload`` (a positive multiple of SAMPLE bytes) as samples."""
    if not payload or len(payload) % SAMPLE:
        raise ValueError("payload must be a positive multiple of the sample size")
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK)
    sync = np.arange(1, n + 1, KEY, dtype=">u4").tobytes()
    entry = struct.pack(">I4s6xH8xHHHHI", 36, b"raw ", 1, 1, 8, 0, 0, RATE << 16)

    def moov(at: int) -> bytes:
        offsets = at + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * SAMPLE)
        wide = int(offsets[-1]) >= 1 << 32
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            _full(b"stss", struct.pack(">I", len(sync) // 4), sync),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n * SAMPLE, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, n * SAMPLE, 0, 0, 0x100, 0), matrix, b"\0" * 8, version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, n * SAMPLE, 0x10000, 0x100), matrix, b"\0" * 24, struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    at = 0
    while True:  # the offsets' width depends on where mdat lies, which depends on the width
        m = moov(at)
        new = len(ftyp) + len(m) + head
        if new == at:
            break
        at = new
    return b"".join((ftyp, m, _box(b"mdat", payload)))


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the content, end) of each box in data[start:end]."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("truncated box")
        n, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if n == 1:
            if end - start < 16:
                raise ValueError("truncated box")
            n, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif n == 0:
            n = end - start
        if n < head or start + n > end:
            raise ValueError("box beyond its parent")
        yield kind, start + head, start + n
        start += n


def tree(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of the content, end) of each box and of those inside container boxes, in file order."""
    todo = [((), boxes(data, start, end))]
    while todo:
        path, level = todo[-1]
        found = next(level, None)
        if found is None:
            todo.pop()
            continue
        kind, a, b = found
        # a path ends with its last four boxes: enough to tell where a box belongs, and short however deep it lies
        here = (*path[-3:], kind)
        yield here, a, b
        if kind in _NESTED:
            todo.append((here, boxes(data, a, b)))


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _table(data: memoryview, at: int, end: int, dtype: str, width: int, skip: int = 0) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4 + skip)
    _need(at + 8 + skip + n * width <= end, "table beyond its box")
    return np.frombuffer(data, dtype, n * width // np.dtype(dtype).itemsize, at + 8 + skip).astype(np.int64)


def _sizes(data: memoryview, kind: bytes, a: int, b: int) -> np.ndarray:
    """Sample sizes of an stsz or stz2 box."""
    size, n = struct.unpack_from(">II", data, a + 4)
    if kind == b"stsz" and size:
        _need(n * size <= len(data), "samples beyond the file")
        return np.full(n, size, np.int64)
    if kind == b"stsz":
        return _table(data, a, b, ">u4", 4, skip=4)
    bits = size & 0xFF
    _need(bits in (4, 8, 16) and a + 12 + (n * bits + 7) // 8 <= b, "bad compact sizes")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
        return np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, ">u1" if bits == 8 else ">u2", n, a + 12).astype(np.int64)


def _track(data: memoryview, start: int, end: int) -> dict:
    t: dict = {"id": None, "codec": None, "handler": None, "timescale": None, "duration": None, "sync": None, "sizes": np.zeros(0, np.int64), "offsets": np.zeros(0, np.int64), "stsc": np.zeros((0, 3), np.int64)}
    for path, a, b in tree(data, start, end):
        kind = path[-1]
        if kind == b"tkhd":
            (t["id"],) = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))
        elif kind == b"hdlr":
            t["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd":
            _need(a + 16 <= b, "truncated sample description")
            t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stts":
            t["stts"] = _table(data, a, b, ">u4", 8).reshape(-1, 2)
        elif kind == b"stss":
            t["sync"] = _table(data, a, b, ">u4", 4)
        elif kind == b"stsc":
            t["stsc"] = _table(data, a, b, ">u4", 12).reshape(-1, 3)
        elif kind in (b"stsz", b"stz2"):
            t["sizes"] = _sizes(data, kind, a, b)
        elif kind in (b"stco", b"co64"):
            t["offsets"] = _table(data, a, b, *((">u4", 4) if kind == b"stco" else (">u8", 8)))
    return t


def sample_ranges(t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(offset, size) of every sample, from stsc, stsz and the chunk offsets."""
    chunks, sizes, runs = t["offsets"], t["sizes"], t["stsc"]
    if not len(sizes):
        return np.zeros(0, np.int64), sizes
    first = runs[:, 0] - 1
    _need(len(runs) > 0 and first[0] == 0 and bool((np.diff(first) > 0).all()) and first[-1] < len(chunks), "bad runs of chunks")
    per = np.repeat(runs[:, 1], np.diff(np.append(first, len(chunks))))
    ends = np.cumsum(per)
    _need(ends[-1] >= len(sizes), "fewer samples in chunks than sizes")
    chunk = np.searchsorted(ends, np.arange(len(sizes)), side="right")
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    start = (ends - per)[chunk]
    return chunks[chunk] + before - before[start], sizes


def _fragments(data: memoryview, tracks: list[dict]) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]:
    """Track id -> (offsets, sizes, whether a sync sample, duration) of each run of its fragments."""
    defaults: dict[int, tuple[int, int, int]] = {}
    runs: dict[int, list] = {}
    moof, base, track, own, follow = 0, 0, 0, (0, 0, 0), 0
    for path, a, b in tree(data):
        kind = path[-1]
        if kind == b"trex":
            track, _, *rest = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = tuple(rest)  # duration, size, flags
        elif kind == b"moof":
            moof = a - 8
            follow = moof
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
            at, own = a + 8, list(defaults.get(track, (0, 0, 0)))
            # without a base of its own a fragment counts from its moof, or goes on behind the one before
            base = moof if flags & 0x20000 else follow
            if flags & 1:
                (base,) = struct.unpack_from(">Q", data, at)
                at += 8
            at += 4 * bool(flags & 2)
            for k, bit in enumerate((8, 0x10, 0x20)):
                if flags & bit:
                    (own[k],) = struct.unpack_from(">I", data, at)
                    at += 4
            follow = base
        elif kind == b"trun":
            flags, n = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
            at, start = a + 8, follow
            if flags & 1:
                start = base + struct.unpack_from(">i", data, at)[0]
                at += 4
            first = None
            if flags & 4:
                (first,) = struct.unpack_from(">I", data, at)
                at += 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            _need(at + 4 * n * len(fields) <= b and n * max(own[1], 1) * (0x200 not in fields) <= len(data), "run beyond its box")
            table = np.frombuffer(data, ">u4", n * len(fields), at).reshape(n, len(fields)).astype(np.int64)
            column = lambda bit, default: table[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)  # noqa: E731, B023
            sizes, state = column(0x200, own[1]), column(0x400, own[2])
            if first is not None and n:
                state = np.concatenate([[first], state[1:]])
            offsets = start + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64)
            follow = start + int(sizes.sum())
            runs.setdefault(track, []).append((offsets, sizes, (state & 0x10000) == 0, int(column(0x100, own[0]).sum())))
    known = {t["id"] for t in tracks}
    _need(set(runs) <= known, "fragment of an unknown track")
    return runs


def parse(media: bytes) -> dict:
    """Every track (``tracks``), and the main one's codec, timescale, duration, samples and the byte ranges of its keyframes."""
    data = memoryview(media)
    try:
        tracks = [_track(data, a, b) for path, a, b in tree(data) if path[-2:] == (b"moov", b"trak")]
        if not tracks:
            return {"status": "no track"}
        more = _fragments(data, tracks)
        for t in tracks:
            offsets, sizes = sample_ranges(t)
            if t["sync"] is not None:
                _need(not len(t["sync"]) or (t["sync"].min() >= 1 and t["sync"].max() <= len(sizes)), "sync sample that is none")
            key = t["sync"] - 1 if t["sync"] is not None else np.arange(len(sizes))  # no stss: every sample is one
            for o, z, sync, duration in more.get(t["id"], ()):
                key = np.concatenate([key, len(sizes) + np.flatnonzero(sync)])
                offsets, sizes = np.concatenate([offsets, o]), np.concatenate([sizes, z])
                t["duration"] = (t["duration"] or 0) + duration
            _need(not len(sizes) or (offsets.min() >= 0 and (offsets + sizes).max() <= len(media)), "sample beyond the file")
            t |= {"samples": len(sizes), "all": (offsets, sizes), "key_offset": offsets[key], "key_size": sizes[key]}
    except (ValueError, KeyError, TypeError, IndexError, OverflowError, struct.error):
        return {"status": "broken"}
    main = next((t for t in tracks if t["handler"] == "vide"), tracks[0])
    return main | {"status": "ok" if any(t["samples"] for t in tracks) else "no samples", "tracks": tracks}


def payload_of(media: bytes, t: dict) -> bytes:
    """The samples' bytes, joined (contiguous ones are read as one)."""
    offsets, sizes = t["all"]
    if not len(sizes):
        return b""
    new = np.flatnonzero(np.concatenate([[True], offsets[1:] != offsets[:-1] + sizes[:-1]]))
    ends = np.append(new[1:], len(sizes)) - 1
    return b"".join(media[a:b] for a, b in zip(offsets[new].tolist(), (offsets[ends] + sizes[ends]).tolist(), strict=True))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as a media file."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):  # media of a few rows at a time
                part = b.slice(k, 256)
                texts = [x or b"" for x in part.column(1).to_pylist()]
                media = [write(x + b"\0" * (-len(x) % SAMPLE or (SAMPLE if not x else 0))) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("__text")).mapInArrow(
        make, f"`{id_col}` {kind}, n_bytes long, media binary"
    )


_RANGES = "array<struct<start:long,length:long>>"
MEDIA_COLUMNS = (
    f"status string, codec string, timescale long, duration long, samples long, keyframes {_RANGES}, "
    f"tracks array<struct<handler:string,codec:string,timescale:long,duration:long,samples:long,keyframes:{_RANGES}>>"
)


_KEYS = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64()}))
_TRACKS = pa.list_(
    pa.struct({"handler": pa.string(), "codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "samples": pa.int64(), "keyframes": _KEYS})
)


def _keyframes(t: dict) -> list[dict]:
    return [{"start": s, "length": n} for s, n in zip(t["key_offset"].tolist(), t["key_size"].tolist(), strict=True)]


def media_columns(files: DataFrame, media_col: str = "media") -> DataFrame:
    """``files`` without ``media_col``, with MEDIA_COLUMNS and the payload's digests read from the stored bytes.

    Columns of ``files`` that clash with the new ones are replaced. The payload is that of the main track.
    """
    new = ["status", "codec", "timescale", "duration", "samples", "keyframes", "tracks", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    others = [c for c in files.columns if c != media_col and c not in new]
    schema = ", ".join([f"`{c}` {files.schema[c].dataType.simpleString()}" for c in others] + [MEDIA_COLUMNS, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"])
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _KEYS, _TRACKS, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(len(others)):
                m = m.as_py()
                t = parse(m) if m is not None else {"status": "broken"}
                ok = t["status"] in ("ok", "no samples")
                payload = payload_of(m, t) if ok else None
                rows.append((
                    t["status"], t.get("codec"), t.get("timescale"), t.get("duration"), t.get("samples"),
                    _keyframes(t) if ok else None,
                    [{c: x[c] for c in ("handler", "codec", "timescale", "duration", "samples")} | {"keyframes": _keyframes(x)} for x in t["tracks"]] if ok else None,
                    len(payload) if ok else None, hashlib.sha256(payload).hexdigest() if ok else None,
                    zlib.crc32(payload[-64:]) if ok else None, len(m) if m is not None else None,
                    hashlib.sha256(m).hexdigest() if m is not None else None,
                ))
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(others)], *(pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True))], names=[*others, *new]
            )

    return files.select(*others, media_col).mapInArrow(read, schema)


def feature(df: DataFrame) -> DataFrame:
    """``feature``: the media columns in one string: codec, duration, samples, keyframes, and the first and last keyframe's byte range."""
    k = F.col("keyframes")
    first, last = F.get(k, F.lit(0)), F.get(k, F.size(k) - 1)
    rng = lambda x: F.concat_ws("+", x["start"].cast("string"), x["length"].cast("string"))
    return df.withColumn(
        "feature",
        F.concat_ws(
            ";",
            F.concat(F.lit("codec="), F.trim("codec")),
            F.concat(F.lit("duration="), F.col("duration").cast("string"), F.lit("/"), F.col("timescale").cast("string")),
            F.concat(F.lit("samples="), F.col("samples").cast("string")),
            F.concat(F.lit("keyframes="), F.size(k).cast("string")),
            F.concat(F.lit("first="), rng(first)),
            F.concat(F.lit("last="), rng(last)),
        ),
    )
