"""Operators on documents against brute force: awkward rows, empty tables, clashing columns, and the small test tables."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from readtrim.llm import common, cotrain, isobmff, mixing, packing, pii, quality_rules, queries, simhash, token_counts

SF = "/root/testdata/sf0.001"


def key(v):
    return str(v)


@pytest.fixture(scope="module", params=["awkward", "small tables"])
def docs(request, spark):
    return brute.documents(spark).cache() if request.param == "awkward" else spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


def same(got, expected):
    assert sorted(map(key, got)) == sorted(map(key, expected))


# ---------------------------------------------------------------- token counts


def test_token_counts(docs, rows):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = token_counts.count_tokens(docs, model).collect()
    expected = [(r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in rows]
    same(map(tuple, got), expected)
    assert token_counts.count_tokens(docs.where("false"), model).count() == 0


def test_token_count_caches_may_be_small(spark, monkeypatch):
    """Nothing but time depends on the sizes of the table and the cache."""
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    enc = token_counts.Encoder(model)
    texts = [r[1] for r in brute.ROWS if r[1]] + ["a\n\nb", "\n", " \n ", "▁", "a▁b ▁ c", "x  \n  y", " lead", "trail "]
    for t in texts:
        assert sum(enc.count(enc.keys(t))) == len(sp.encode(t)), t
    monkeypatch.setattr(token_counts, "SUMMARY", 3)
    monkeypatch.setattr(token_counts, "TABLE", 2)
    assert len(token_counts.frequent(brute.documents(spark), model)) <= 2


def test_arrow_and_python_cut_texts_alike():
    import pyarrow as pa

    enc = token_counts.Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r[1] for r in brute.ROWS] + ["a\n\nb", "\n", " \n ", "▁", "a▁b ▁ c", "x  \n  y", " lead", "trail ", "a b\nc d", "\na", "a\n", "", None, "tab\tand\r\nreturn", "a \nb", "a\n b"] * 2
    keys, codes, rows = token_counts.keyed(enc, pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for k, r in zip(keys.take(pa.array(codes)).to_pylist(), rows.tolist(), strict=True):
        got[r].append(k)
    assert got == [token_counts.pre_tokens(t or "") for t in texts]
    enc.splits = False
    keys, codes, rows = token_counts.keyed(enc, pa.array(texts, pa.string()))
    assert [(r, k) for r, k in zip(rows.tolist(), keys.take(pa.array(codes)).to_pylist(), strict=True)] == [(i, t) for i, t in enumerate(texts) if t]


def test_summaries_keep_frequent_keys():
    counts = Counter({"often": 50, **{f"r{k}": 1 for k in range(100)}})
    token_counts._prune(counts, 10)
    assert "often" in counts and len(counts) <= 10


# ---------------------------------------------------------------- personal data


def test_base_spans(docs, rows):
    got = pii.find(docs).collect()
    expected = []
    for r in rows:
        spans = brute.base_spans(r.text)
        expected.append((r.doc_id, *[sum(1 for s in spans if s[1] == k) for k in range(4)], hashlib.sha256(brute.joined(spans).encode()).hexdigest()))
    same([tuple(r)[:6] for r in got], expected)
    text_of = defaultdict(set)
    for r in rows:
        text_of[r.doc_id].add(r.text or "")
    for r in got:
        own = [set(brute.joined(brute.base_spans(t)).split(",")) - {""} for t in text_of[r.doc_id]]
        assert any(o <= set(r.spans.split(",")) for o in own)
    assert pii.find(docs.where("false")).count() == 0


def bootstrap_docs(spark, share=0):
    """Mail addresses after the same words; one address shape that no expression knows, after the same words too."""
    rows = [(k, f"Please {'really ' * (k % 3)}write to user{k}@site{k}.example.org about it", "en", "s", 0) for k in range(30)]
    rows += [(100, "Please write to admin@intranet about it", "en", "s", 0), (101, "Meet me @home or at root@localhost tomorrow", "en", "s", 0)]
    rows += [(200 + k, "Please write to shared@copied.example.org about it", "en", "s", 0) for k in range(share)]
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(4)


@pytest.mark.parametrize("share", [0, 60])
def test_confident_patterns_discover_unseen_identifiers(spark, share):
    got = {r.doc_id: r for r in pii.find(bootstrap_docs(spark, share)).collect()}
    assert got[100].spans == "email:16:30" and got[100].n_email == 0 and got[100].n_added == 1
    assert got[101].spans == ""  # the same shape without a trusted context
    few = {r.doc_id: r for r in pii.find(bootstrap_docs(spark).where("doc_id in (0, 1, 100)")).collect()}
    assert few[100].spans == ""  # two instances don't make a pattern


def test_bootstrap_scores_by_hand(spark):
    conf = {r.pattern.replace("\x1f", "|"): r.conf for r in pii.bootstrap(pii.scan(bootstrap_docs(spark))).collect()}
    assert set(conf) >= {"email|L|write to", "email|M|to|about"} and all(0.8 <= c < 1 for c in conf.values())


def test_found_instances_make_patterns_without_seeds_confident(spark):
    """Seeds trust 'call me'; the numbers found there trust 'dial desk', where no seed ever stands; 'order code' stays out."""
    texts = [f"{'well ' * (k % 3)}please call me +1 212 555 {1000 + k} now" for k in range(30)]
    texts += [f"{'well ' * (k % 3)}please call me 212-555-{2000 + k} now" for k in range(10)]
    texts += [f"then dial desk 212-555-{2000 + k} {'again ' * (k % 2)}" for k in range(10)]
    texts += ["then dial desk 212-555-3000", *(f"see order code 313-555-{4000 + k}" for k in range(10))]
    got = pii.find(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], brute.SCHEMA).repartition(4)).collect()
    assert {r.doc_id: r.spans for r in got}[50] == "phone:15:27"
    assert sorted(r.doc_id for r in got if r.n_added) == list(range(30, 51))


UNSEEN = ["fe80::1", "2001:db8:0:1:1:1:1:1", "2001:db8::8a2e:370:7334", "::1", "300.1.2.3", "10 . 0 . 0 . 7", "10[.]0[.]0[.]8", "10.0(dot)0.9"]


def test_trusted_contexts_discover_ips_and_mail_at_the_end_of_a_sentence(spark):
    texts = [f"{'well ' * (k % 3)}please connect to 10.0.0.{k} now" for k in range(30)] + [f"{'well ' * (k % 3)}please write to u{k}@s{k}.example.org now" for k in range(30)]
    texts += [f"please connect to {x}{end}" for x in UNSEEN for end in (" now", ". Then", ".")] + ["please write to admin@intranet. Then", "please write to admin@intranet."]
    texts += ["at 12:30:45 see std::vector, version 300.1.2.3 and root@localhost.", "please connect to std::map 1:2:3 and 1.2.3 and ::"]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], brute.SCHEMA).repartition(4)).collect()}
    for k, x in enumerate([x for x in UNSEEN for _ in range(3)], 60):
        assert (got[k].spans, got[k].n_ip, got[k].n_added) == (f"ip:18:{18 + len(x)}", 0, 1), texts[k]
    assert got[84].spans == got[85].spans == "email:16:30"
    assert got[86].spans == got[87].spans == ""


def plain_bootstrap(texts):
    """(confident patterns with their confidence, spans added to each text), in plain Python."""
    import math
    import re

    mentions = []  # text number, start, end, kind or None, string, patterns, is a seed
    for number, text in enumerate(texts):
        text = text or ""
        base = brute.base_spans(text)
        taken, found = list(base), []

        def add(matches, order):
            kept, reach = [], -1
            for a, z, kind in sorted(matches, key=lambda m: (m[0], m[1])):
                free = all(z <= s or e <= a for s, _, e in taken)
                if free and reach <= a:
                    kept.append((a, z, kind))
                if free:
                    reach = max(reach, z)
            taken.extend((a, None, z) for a, z, _ in kept)
            found.extend((a, z, kind, order) for a, z, kind in kept)

        def contexts(a, z, matches):
            gap = max([0, *(e for s, e in matches if e <= a)])
            until = min([len(text), *(s for s, e in matches if s >= z)])
            before = re.findall(r"\S+", text[gap:a])[-2:]
            after = re.match(r"\s*(\S+)", text[z:until])
            before, after = [w.lower() for w in before], after and after[1].lower()
            return [("L", " ".join(before))] * (len(before) == 2) + ([("M", before[-1], after)] if before and after else [])

        raw = {}
        for kind, rx in pii.LOOSE.items():
            raw[kind] = [m.span() for m in re.finditer(rx, text)]
        raw["any"] = [m.span() for m in re.finditer(pii.OTHER, text)]
        plain = {k: [m.span() for m in re.finditer(brute.PATTERNS[k], text)] for k in brute.KINDS}
        for s, k, e in base:
            kind = brute.KINDS[k]
            mentions.append((number, s, e, kind, text[s:e], [(kind, *c) for c in contexts(s, e, plain[kind])], True))
        add([(a, z, kind) for kind in brute.KINDS for a, z in raw[kind] if kind != "card" or not brute.luhn(text[a:z])], 0)
        add([(a, z, "any") for a, z in raw["any"]], 1)
        for a, z, kind, _ in found:
            kinds = brute.KINDS if kind == "any" else (kind,)
            cs = contexts(a, z, raw[kind])
            mentions.append((number, a, z, kind, text[a:z], [(k, *c) for k in kinds for c in cs], False))
    graph = defaultdict(dict)
    for *_, string, patterns, seed in mentions:
        for p in patterns:
            graph[p][p[0], string] = max(graph[p].get((p[0], string), 0.0), float(seed))
    graph = {p: i for p, i in graph.items() if len(i) >= pii.SUPPORT}
    score = {i: 0.0 for x in graph.values() for i in x}
    seeds = {i for x in graph.values() for i, s in x.items() if s}
    score |= dict.fromkeys(seeds, 1.0)
    conf = lambda: {p: sum(score[i] if i not in own or not own[i] else 1.0 for i in own) / (len(own) + 1) for p, own in graph.items()}
    for _ in range(pii.ROUNDS):
        c = conf()
        score = {i: 1.0 if i in seeds else 1 - math.prod(1 - min(c[p], 0.95) for p, own in graph.items() if i in own) for i in score}
    trusted = {p: x for p, x in conf().items() if x >= pii.CONFIDENT}
    added = defaultdict(set)
    for number, a, z, _, _, patterns, seed in mentions:
        kinds = [brute.KINDS.index(p[0]) for p in patterns if p in trusted]
        if kinds and not seed:
            added[number].add((a, min(kinds), z))
    return trusted, added


def planted():
    """Seeds in four contexts; unseen shapes in the same ones (to be found), and in others (to be left alone)."""
    texts, unseen, clean = [], {}, set()
    digits = lambda k, good: next(f"4111 1111 {2000 + k} {x}" for x in range(1000, 2000) if brute.luhn(f"4111 1111 {2000 + k} {x}") == good)
    contexts = {
        "email": ("please write to", lambda k: f"user{k}@site{k}.example.org", lambda k: f"user{k}@intranet"), "ip": ("now connect to", lambda k: f"10.1.{k}.7", lambda k: f"300.1.{k}.{k + 1}"),
        "card": ("card number is", lambda k: digits(k, True), lambda k: digits(k, False)),
        "phone": ("call me on", lambda k: f"+1 212 555 {1000 + k}", lambda k: f"ext/{k}55{k}77{k}"),
    }
    for kind, (words, seed, odd) in contexts.items():
        for k in range(40):
            texts.append(f"{'well ' * (k % 4)}{words} {seed(k)} or so")
        for k in range(10):
            unseen[len(texts)] = kind
            texts.append(f"{'then ' * (k % 3)}{words} {odd(k)} or so")
            clean.add(len(texts))
            texts.append(f"{'then ' * (k % 3)}see item code {odd(k + 100)} on the shelf")
    return texts, unseen, clean


def test_graph_scores_and_spans_against_plain_python(spark):
    texts, unseen, clean = planted()
    texts += [r[1] for r in brute.ROWS] + ["dial desk 212-555-2000 and 2001:db8::1 with x12345 " * 3, "A" * 300 + " " + "b" * 300 + " x1234 " + "c" * 300]
    trusted, added = plain_bootstrap(texts)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], brute.SCHEMA).repartition(4)
    conf = {tuple(r.pattern.split("\x1f")): r.conf for r in pii.bootstrap(pii.scan(docs)).collect()}
    assert conf.keys() == trusted.keys() and all(abs(conf[p] - trusted[p]) < 1e-9 for p in conf)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k].spans == brute.joined(sorted([*brute.base_spans(t), *added[k]], key=lambda s: (s[0], s[1], s[2]))), t
    # all planted ones of known and of unknown shape are found with their kind, and none in other contexts
    assert all(got[k].n_added == 1 and got[k].spans.startswith(kind) for k, kind in unseen.items())
    assert not any(got[k].n_added for k in clean)


def test_many_spans_take_linear_time_and_keep_their_places(spark):
    import time

    def run(n):
        text = " ".join(f"u{k}@h{k}.org {k}-x1234 10.0.{k % 250}.1" for k in range(n))
        df = spark.createDataFrame([(1, text, "en", "s", 0)], brute.SCHEMA)
        began = time.perf_counter()
        spans, new = pii.find(df).first().spans, pii.redact(df).first().text
        took = time.perf_counter() - began
        assert spans.count(",") + 1 >= 2 * n
        assert new == " ".join(f"[EMAIL] {k}-x1234 [IP]" for k in range(n))
        return took

    run(50)
    assert run(10_000) < 20 * max(run(1_000), 1.0)


def test_columns_of_any_name_ride_along(spark):
    df = spark.createDataFrame([(1, "write to a@b.org", 5, 6, 7)], ["doc_id", "text", "__row", "a.b", "__found"])
    assert [tuple(r) for r in pii.redact(df).collect()] == [(1, "write to [EMAIL]", 5, 6, 7)]
    assert pii.redact(df).columns == df.columns


def test_redaction_keeps_columns_and_all_but_the_spans(docs, rows):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    expected = []
    for r in rows:
        t, at, new = r.text, 0, []
        spans = brute.base_spans(t)
        for start, k, end in spans:
            if start >= at:
                new += [t[at:start], f"[{brute.KINDS[k].upper()}]"]
            at = max(at, end)
        expected.append((r.doc_id, None if t is None else "".join(new) + t[at:]))
    same([(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()], expected)


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (pii.find(docs), pii.redact(docs), mixing.sample(docs), quality_rules.assess(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---------------------------------------------------------------- packing


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    want = Counter()
    total = 0
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        for p, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : s + 1024] if p else ids[:first]
            want[r.doc_id, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) * 1.05 + 1
    assert packing.pack_documents(docs.where("false"), path).count() == 0


@pytest.mark.parametrize("lengths", [[512] * 9, [700] * 5 + [324] * 5, [1024, 1, 1], [400, 300, 324] * 50, list(range(1, 1025)), [341] * 100 + [683] * 40 + [7] * 999])
def test_plans_hold_every_piece_once_and_few_sequences(lengths):
    solution = packing.solve(dict(Counter(lengths)))
    plan = solution.plan
    assert -(-sum(lengths) // 1024) <= solution.bound <= solution.sequences
    used = Counter()
    for config, n in plan:
        assert sum(s * k for s, k in config.items()) <= 1024 and n > 0
        for s, k in config.items():
            used[s] += k * n
    assert used == Counter(lengths)
    bound = max(-(-sum(lengths) // 1024), sum(1 for x in lengths if x > 512))
    assert sum(n for _, n in plan) <= bound * 1.01 + 1


def test_weights_save_sequences_where_sizes_alone_do_not():
    """20,000 pieces of 300 to 400 tokens: three fit at most, and which three matters."""
    lengths = Counter(np.random.default_rng(0).integers(300, 401, 20_000).tolist())
    count = np.zeros(1025, np.int64)
    for size, n in lengths.items():
        count[size] = n
    greedy = sum(n for _, n in packing._rest(count, 1024))
    flat, weighted = packing.solve(lengths, needs=(0.0,)), packing.solve(lengths)
    assert weighted.sequences < 0.97 * min(greedy, flat.sequences) and weighted.bound > sum(k * n for k, n in lengths.items()) / 1024


def test_bounds_hold_against_every_packing():
    """Small cases: no plan goes below the bound, and the plan is within one sequence of the best there is."""
    def fewest(items, room=12):
        best = [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[k] <= room and bins[b] not in bins[:b]:
                    place(k + 1, [*bins[:b], bins[b] + items[k], *bins[b + 1 :]])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best[0]

    rng = np.random.default_rng(5)
    for _ in range(12):
        items = sorted(rng.integers(1, 13, 11).tolist(), reverse=True)
        s = packing.solve(dict(Counter(items)), 12, steps=60)
        assert s.bound <= fewest(items) <= s.sequences <= fewest(items) + 1


def test_both_encoders_across_the_limit_of_long_texts(spark, monkeypatch):
    """Texts on either side of LONG, and one beyond the real one, get the library's ids."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, coder = Tokenizer.from_file(path), packing.Ids(path)
    text = "Ein längerer Satz, 3.14 and some \n\n  code_like(words) 中文 😀 " * 40
    want = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    for limit in (len(text) - 1, len(text), len(text) + 1):
        monkeypatch.setattr(packing, "LONG", limit)
        assert coder.text(text) == want(text)
    monkeypatch.undo()
    for n in (packing.LONG - 5, packing.LONG + 5):
        whole = (text * (n // len(text) + 1))[:n]
        assert coder.text(whole) == want(whole)


def test_ranks_of_more_buckets(spark, monkeypatch):
    """Buckets grow with the pieces and change nothing about the packing."""
    monkeypatch.setattr(packing, "PER_BUCKET", 1)
    monkeypatch.setattr(packing, "BUCKETS", 1)
    rows = [(k, 100 + k % 3) for k in range(500)] + [(7, 100)] * 20
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long").repartition(7), 1024).collect()
    assert Counter((r.doc_id, r.length) for r in out) == Counter(rows)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024


def test_packed_rows_are_the_documents_tokens(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = brute.documents(spark)
    packed = packing.pack(packing.pieces(docs, path, capacity=64, with_ids=True), 64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)
    assert all(len(x) <= 64 for x in whole.values())


# ---------------------------------------------------------------- media


def test_media_payloads(docs, rows):
    got = isobmff.media_columns(isobmff.encode(docs)).collect()
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], [(r.doc_id, *brute.payload(r.text)) for r in rows])
    assert {r.status for r in got} <= {"ok"}
    by_payload = defaultdict(set)
    for r in isobmff.feature(isobmff.media_columns(isobmff.encode(docs))).collect():
        by_payload[r.payload_sha256, r.n_bytes].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_payload.values())
    assert isobmff.media_columns(isobmff.encode(docs.where("false"))).count() == 0


def test_keyframe_ranges_point_at_the_samples():
    payload = bytes(range(256)) * 1000
    media = isobmff.write(payload)
    t = isobmff.parse(media)
    assert (t["status"], t["codec"], t["timescale"], t["duration"], t["samples"]) == ("ok", "raw ", 8000, len(payload), len(payload) // 64)
    for k, (at, n) in enumerate(zip(t["key_offset"].tolist(), t["key_size"].tolist(), strict=True)):
        assert media[at : at + n] == payload[k * 16 * 64 : k * 16 * 64 + 64]
    assert isobmff.payload_of(media, t) == payload


def test_foreign_and_broken_files(spark):

    box, full = isobmff._box, isobmff._full
    # two chunks, samples of different sizes, 64-bit offsets and box sizes, no sync table, version-0 headers
    sizes, data = [3, 5, 7], b"aaabbbbbccccccc"
    def moov(at):
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), struct.pack(">I4s", 8, b"mp4v")), full(b"stts", struct.pack(">III", 1, 3, 10)),
            full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 1, 1)),
            full(b"stsz", struct.pack(">II", 0, 3), struct.pack(">3I", *sizes)), full(b"co64", struct.pack(">I", 2), struct.pack(">2Q", at, at + 8)),
        )
        mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, 90, 30))
        return box(b"moov", box(b"trak", box(b"mdia", mdhd, full(b"hdlr", struct.pack(">I4s", 0, b"vide")), box(b"minf", stbl))))

    size = len(moov(0))
    media = moov(size + 16) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    t = isobmff.parse(media)
    assert t["codec"] == "mp4v" and t["duration"] == 30 and t["key_size"].tolist() == sizes and isobmff.payload_of(media, t) == data
    assert isobmff.parse(media[:-4])["status"] == "broken" and isobmff.parse(b"")["status"] == "no track" and isobmff.parse(b"\0\0\0\x07moov")["status"] == "broken"
    with pytest.raises(ValueError):
        isobmff.write(b"abc")
    files = spark.createDataFrame([(1, media), (2, b"junk"), (3, None)], "doc_id long, media binary")
    assert {r.doc_id: (r.status, r.payload_bytes) for r in isobmff.media_columns(files).collect()} == {1: ("ok", 15), 2: ("broken", None), 3: ("broken", None)}


def _file(*tracks, fragments=b"", data=b"", more=b""):
    """A file of ``tracks`` (functions of where the data begins), its data and fragments behind."""
    box = isobmff._box
    make = lambda at: box(b"moov", *[t(at) for t in tracks], more)
    at = len(make(0)) + 8
    return make(at) + box(b"mdat", data) + fragments


def _trak(number, handler, codec, tables):
    box, full = isobmff._box, isobmff._full
    tkhd = full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0))
    mdia = lambda stbl: box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 90, 0)), full(b"hdlr", struct.pack(">I4s", 0, handler)), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), struct.pack(">I4s", 8, codec)), *stbl)))
    return lambda at: box(b"trak", tkhd, mdia(tables(at)))


def test_all_tracks_compact_sizes_and_the_video_first(spark):
    full = isobmff._full
    one = lambda sizes, at: [
        full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), full(b"stz2", struct.pack(">II", 4, len(sizes)), bytes([sizes[0] << 4 | sizes[1], sizes[2] << 4])), full(b"stco", struct.pack(">II", 1, at)),
    ]
    audio = _trak(1, b"soun", b"mp4a", lambda at: one([1, 2, 3], at))
    video = _trak(2, b"vide", b"avc1", lambda at: [*one([4, 5, 6], at + 6), full(b"stss", struct.pack(">II", 1, 2))])
    media = _file(audio, video, data=b"aabbccddddeeeeeffffff"[:21])
    t = isobmff.parse(media)
    at = media.index(b"mdat") + 4
    assert t["status"] == "ok" and t["codec"] == "avc1" and [x["codec"] for x in t["tracks"]] == ["mp4a", "avc1"]
    assert t["key_offset"].tolist() == [at + 10] and t["key_size"].tolist() == [5]
    row = isobmff.media_columns(spark.createDataFrame([(1, media)], "doc_id long, media binary")).first()
    assert [(x.handler, x.samples, [tuple(k) for k in x.keyframes]) for x in row.tracks] == [("soun", 3, [(at, 1), (at + 1, 2), (at + 3, 3)]), ("vide", 3, [(at + 10, 5)])]
    assert row.payload_bytes == 15 and row.codec == "avc1"


def test_fragments_are_decoded():
    box, full = isobmff._box, isobmff._full
    empty = _trak(7, b"vide", b"avc1", lambda at: [full(b"stsz", struct.pack(">II", 0, 0)), full(b"stsc", struct.pack(">I", 0)), full(b"stco", struct.pack(">I", 0))])
    trex = box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 10, 4, 0x10000)))
    head = _file(empty, more=trex, data=b"")
    assert isobmff.parse(head)["status"] == "no samples"

    def fragment(first):
        # sizes of its own, then the track's default size; the first sample of a run is a sync sample
        trun = lambda at: full(b"trun", struct.pack(">IiI", 2, at, 0), struct.pack(">II", 3, 5), flags=0x205)
        rest = full(b"trun", struct.pack(">I", 2))
        make = lambda at: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), trun(at), rest))
        return make(len(make(0)) + 8) + box(b"mdat", first)

    body = [fragment(b"abcdefghIIIIJJJJ"), fragment(b"ABCDEFGHiiiijjjj")]
    t = isobmff.parse(head + b"".join(body))
    assert t["status"] == "ok" and t["samples"] == 8 and t["duration"] == 80
    assert isobmff.payload_of(head + b"".join(body), t) == b"abcdefghIIIIJJJJABCDEFGHiiiijjjj"
    ends = [len(head) + len(body[0]) - 16, len(head) + len(b"".join(body)) - 16]
    assert t["key_offset"].tolist() == ends and t["key_size"].tolist() == [3, 3]


def test_hostile_files_are_broken_not_fatal():
    box, full = isobmff._box, isobmff._full
    deep = b""
    for _ in range(3000):
        deep = box(b"dinf", deep)
    assert isobmff.parse(box(b"moov", deep))["status"] == "no track"
    huge = lambda *tables: _file(_trak(1, b"vide", b"avc1", lambda at: tables), data=b"x" * 50)
    offsets, runs = full(b"stco", struct.pack(">II", 1, 100)), full(b"stsc", struct.pack(">IIII", 1, 1, 0xFFFFFFFF, 1))
    for tables in (
        (full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)), runs, offsets),  # four thousand million samples in a small file
        (full(b"stsz", struct.pack(">II", 0, 0xFFFFFFFF)), runs, offsets),
        (full(b"stsz", struct.pack(">II", 4, 2)), full(b"stsc", struct.pack(">IIII", 1, 5, 1, 1)), offsets),
        (full(b"stsz", struct.pack(">II", 4, 2)), runs, offsets, full(b"stss", struct.pack(">II", 1, 0))),
        (full(b"stsz", struct.pack(">II", 40, 2)), runs, full(b"stco", struct.pack(">II", 1, 1 << 31))),
    ):
        assert isobmff.parse(huge(*tables))["status"] == "broken"
    assert isobmff.parse(huge(full(b"stsz", struct.pack(">II", 4, 2)), runs, offsets))["samples"] == 2


# ---------------------------------------------------------------- near-duplicates


def test_fingerprints_and_components(docs, rows):
    got = simhash.dedup(docs).collect()
    prints = [brute.fingerprint(r.text) for r in rows]
    expected = brute.components([r.doc_id for r in rows], prints)
    same([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got], [(r.doc_id, p, c) for r, p, c in zip(rows, prints, expected, strict=True)])
    assert simhash.dedup(docs.where("false")).count() == 0


def test_trie_join_against_all_pairs():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    for k in range(300):  # neighbours at 0 to 6 bits
        flips = rng.choice(64, int(rng.integers(0, 7)), replace=False)
        fp[300 + k] = fp[k] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else fp[k]
    group = np.sort(rng.integers(0, 4, 600))
    order = np.lexsort((fp, group))
    fp, group = fp[order], group[order]
    for budget in (0, 2, 4):
        i, j = simhash.near_pairs(fp, group, budget)
        want = {(a, b) for a in range(600) for b in range(a + 1, 600) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= budget}
        assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want
        assert len(i) == len(want)


def test_the_trie_is_walked_and_prunes():
    """Even a group of three is walked; of many far rows hardly any pair of leaves is reached; slabs change nothing."""
    rng = np.random.default_rng(2)
    three, seen = np.sort(np.array([1 << 60, (1 << 60) + 1, (1 << 16) - 1], np.uint64)), []
    assert [(i, j) for x, y in simhash.walk(three, np.zeros(3), visited=seen) for i, j in zip(x.tolist(), y.tolist(), strict=True)] == [(1, 2)] and len(seen) > 3
    fp = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    fp[::10] = fp[1::10] ^ np.uint64(1)
    fp, seen = np.sort(fp), []
    pairs = list(simhash.walk(fp, np.zeros(len(fp)), visited=seen))
    assert sum(len(i) for i, _ in pairs) >= 400
    # budget 4 of about 12 levels down to single rows: the share of node pairs left is that of 4 errors in 12 bits
    assert max(seen) < 0.5 * len(fp) * len(fp) / 2


def test_slabs_and_forests_lose_no_link(monkeypatch):
    rng = np.random.default_rng(3)
    fp = np.sort(np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 300).astype(np.uint64)))
    whole = set(zip(*(x.tolist() for x in simhash.near_pairs(fp, np.zeros(300))), strict=True))
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    assert set(zip(*(x.tolist() for x in simhash.near_pairs(fp, np.zeros(300))), strict=True)) == whole
    i, j = simhash.spanning(300, simhash.walk(fp, np.zeros(300)))
    assert len(i) == 299  # all within four bits of each other: one component, a tree


@pytest.mark.parametrize("m", [5, 7])
def test_any_number_of_blocks_finds_the_same_components(spark, m):
    assert sum(w for _, w in simhash.blocks(m)) == 64 and simhash.block_count(10**7) == 5 and simhash.block_count(10**9) == 6 and simhash.block_count(10**14) == 8
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)]
    near = [x ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(1, 7)), replace=False)) for x in base for _ in range(3)]
    nodes = sorted(set(base + near))
    found = simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp long").repartition(3), m)
    comp = {r.node: r.label for r in simhash.components(found).collect()}
    unsigned = [x & (1 << 64) - 1 for x in nodes]
    expected = brute.components(nodes, unsigned)
    assert [comp.get(n, n) for n in nodes] == expected


def test_links_span_large_groups_too(spark, monkeypatch):
    """Groups over the bound are dealt into pairs of sub-blocks; chains of links stay whole."""
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = np.random.default_rng(1)
    start = int(rng.integers(0, 1 << 62))
    chain = [start]
    for k in range(120):
        chain.append(chain[-1] ^ (1 << int(rng.integers(0, 40))) ^ (1 << int(rng.integers(0, 40))))
    far = [int(x) for x in rng.integers(0, 1 << 62, 100)]
    nodes = sorted(set(chain + far))
    df = spark.createDataFrame([(x,) for x in nodes], "fp long").repartition(5)
    comp = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    expected = brute.components(nodes, nodes)
    assert [comp.get(n, n) for n in nodes] == expected


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 200 + k) for k in range(1, 300)] + [(1000, 1001)]
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got[100] == 0 and got[499] == 200 and got[1001] == 1000 and set(got.values()) == {0, 200, 1000}


def test_one_document_of_each_group_stays(docs, rows):
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    expected = brute.components([r.doc_id for r in rows], [brute.fingerprint(r.text) for r in rows])
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(map(key, kept)) == sorted({key(c) for c in expected})


def test_hot_keys_are_dealt(spark, monkeypatch, request):
    """A component and a fingerprint beyond HOT rows: the joins deal them and give the same rows."""
    monkeypatch.setattr(common, "HOT", 8)
    name = "spark.sql.autoBroadcastJoinThreshold"
    request.addfinalizer(lambda: spark.conf.unset(name))
    spark.conf.set(name, "-1")  # else the planner broadcasts tables this small
    words = brute.PROSE.split()
    texts = [" ".join(words[:40] + [f"w{k % 9}"]) for k in range(60)] + ["" for _ in range(30)] + [f"alone {k} " * 9 for k in range(5)]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], brute.SCHEMA).repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.dedup(df).collect()}
    expected = dict(enumerate(brute.components(list(range(len(texts))), [brute.fingerprint(t) for t in texts])))
    assert got == expected
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == sorted(set(expected.values()))


def test_texts_stay_where_they_are(spark):
    """Documents without near-duplicates are not shuffled: only those in the slots of removed ones are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumnRenamed("n_chars", "a.b").withColumn("__slot", F.lit(1)).withColumn("__key", F.lit("k"))
    out = simhash.keep_first(odd)
    assert out.columns == odd.columns and out.count() == simhash.keep_first(docs).count()


# ---------------------------------------------------------------- quality rules


def test_quality_figures(docs, rows):
    got = quality_rules.assess(docs).collect()
    same([tuple(r)[:7] for r in got], [(r.doc_id, *brute.quality(r.text)) for r in rows])
    assert not any(r.kept for r in got if r.base_failed)
    kept = Counter(key(r.doc_id) for r in got if r.kept)
    out = quality_rules.filter_kept(docs)
    assert out.columns == docs.columns and Counter(key(r.doc_id) for r in out.select("doc_id").collect()) == kept
    assert quality_rules.assess(docs.where("false")).count() == 0


def test_each_rule_rejects_what_it_names(spark):
    from readtrim.llm.quality_rules import Rule, assess

    text = {1: brute.PROSE + " while two more sentences of the same kind follow it to be long enough for all the rules that there are in this small table here", 2: "# word " * 60}
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in text.items()], brute.SCHEMA)
    rules = (Rule("symbols_per_word", high=0.1), Rule("stop_ratio", low=0.1, min_words=10), Rule("mean_word_chars", low=1.0, high=3.0))
    failed = {r.doc_id: r.failed_rules for r in assess(df, rules).collect()}
    assert failed == {1: "mean_word_chars", 2: "symbols_per_word,stop_ratio"}
    assert {r.doc_id: r.failed_rules for r in assess(df, ()).collect()} == {1: "", 2: ""}


def test_quality_is_one_projection(spark):
    plan = quality_rules.assess(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_good_labels_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.assess(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * n.get((0, False), 1)


# ---------------------------------------------------------------- mixing


def test_mixing_probabilities_and_draws(docs):
    planned = mixing.plan(docs).cache()
    plan = planned.toPandas()
    cells = Counter()
    for r in docs.select("text", "source", "lang").collect():
        text = r.text or ""
        topic = brute.topic(text)
        cells[r.source or "", r.lang or "", topic] += len(brute.words(text))
    assert {(r.source, r.lang, r.topic): r.tokens for r in plan.itertuples()} == dict(cells)
    total = sum(cells.values())
    assert plan.p.between(0, 1).all() and abs((plan.p * plan.tokens).sum() - 0.6 * total) <= 0.02 * total
    p = {(r.source, r.lang, r.topic): r.p for r in plan.itertuples()}
    drawn = mixing.sample(docs, extra=True, planned=planned).select("doc_id", "source", "lang", "topic", "p").collect()
    expected = 0
    for r in mixing.labelled(docs).select("doc_id", "__source", "__lang", "__topic").collect():
        mark = hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:mix-1".encode()).hexdigest()
        expected += int(mark[:12], 16) / (1 << 48) < p[r["__source"], r["__lang"], r["__topic"]]
    assert len(drawn) == expected
    out = mixing.sample(docs, planned=planned)
    assert out.columns == docs.columns and out.count() == expected


@pytest.mark.parametrize(
    "text, topic",
    [
        ("", "none"), (brute.PROSE, "prose"), ("All rights reserved. Copyright by us.", "legal"), ("a | b | c | d", "table"), ("x = y[0]; z # {}", "markup"),
        ("Why? No! Who?", "talk"), ("mail a@b.org", "contact"), ("one\ntwo\nthree", "list"), (brute.PROSE * 15 + " Copyright", "prose"),
    ],
)
def test_topics_follow_the_form_of_a_text(spark, text, topic):
    assert brute.topic(text) == topic
    assert spark.createDataFrame([(text,)], "text string").select(mixing.topic_of(F.col("text")).alias("t")).first().t == topic


def test_mixing_of_nothing(spark):
    assert mixing.sample(brute.empty(spark)).count() == 0


def test_raking_meets_given_marginals(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{s}", f"l{lg}", f"t{t}", 1, int(rng.integers(50, 5000))) for s in range(4) for lg in range(3) for t in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, docs long, tokens long")
    goals = {"source": [0.1, 0.2, 0.3, 0.4], "lang": [0.5, 0.3, 0.2], "topic": [0.6, 0.4]}
    targets = {d: spark.createDataFrame([(f"{d[0]}{k}", x) for k, x in enumerate(v)], f"{d} string, share double") for d, v in goals.items()}
    w = mixing.rake(cells, targets, 1000.0, rounds=8).toPandas()
    for d, v in goals.items():
        assert np.allclose(w.groupby(d).w.sum().sort_index(), np.array(v) * 1000, rtol=5e-3)
    # plain iterative fitting in numpy
    x = np.zeros((4, 3, 2))
    for r in rows:
        x[int(r[0][1]), int(r[1][1]), int(r[2][1])] = r[4]
    for _ in range(8):
        for axis, d in enumerate(("source", "lang", "topic")):
            now = x.sum(axis=tuple(a for a in range(3) if a != axis))
            x *= (np.array(goals[d]) * 1000 / now).reshape([-1 if a == axis else 1 for a in range(3)])
    assert np.allclose(sorted(w.w), sorted(x.ravel()))


def test_bounded_raking_meets_marginals_that_documents_can_meet(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.plan(docs).toPandas()
    total = 0.6 * plan.tokens.sum()
    assert plan.p.between(0, 1).all() and abs((plan.p * plan.tokens).sum() / total - 1) < 1e-3
    for d in mixing.DIMS:
        have = plan.groupby(d).tokens.sum()
        goal = have**0.7 / (have**0.7).sum() * total
        for _ in range(20):  # what a value can't give goes to the others
            free = goal < have
            goal = goal.where(~free, goal * (total - goal[~free].sum()) / goal[free].sum()).clip(upper=have)
        got = (plan.p * plan.tokens).groupby(plan[d]).sum()
        assert ((got - goal).abs() / total).max() < 0.01, d


def test_target_values_without_documents_are_left_out(spark):
    docs = spark.createDataFrame([(k, "word " * 20, "en" if k % 2 else "fr", f"s{k % 3}", 100) for k in range(60)], brute.SCHEMA)
    targets = {"lang": spark.createDataFrame([("en", 0.6), ("xx", 0.4)], "lang string, share double")}
    p = {r.lang: r.p for r in mixing.plan(docs, targets, share=0.3).collect()}
    assert p["en"] == pytest.approx(0.6) and p["fr"] == 0.0


# ---------------------------------------------------------------- co-training


def test_cotraining_separates_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    out = cotrain.classify(docs, labels.where(~test)).join(labels.where(test), "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.25


def test_cotraining_of_awkward_rows(spark):
    docs = brute.documents(spark)
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (15, 0, 0), (16, 0, 0), (7, 1, 0), (99, 1, 0), (None, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    out = cotrain.classify(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and 0 <= r.p_text <= 1 and 0 <= r.p_meta <= 1 for r in rows)
    assert sorted(map(tuple, cotrain.classify(docs.repartition(5), labels).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert cotrain.classify(docs.where("false"), labels).count() == 0
    one_class = cotrain.classify(docs, labels.where("quality = 1")).collect()
    assert all(r.score == 1.0 and r.kept for r in one_class)
    assert {r.score for r in cotrain.classify(docs, labels.where("false")).collect()} == {0.5}


def test_views_teach_each_other(spark):
    """The text view alone knows the labelled half's words; sources carry the class to texts with other words."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for k in range(600):
        good = k % 2
        pool = (["calm", "river", "stone"], ["buy", "cheap", "pills"])[1 - good] if k < 200 else (["amber", "cloud", "field"], ["click", "win", "cash"])[1 - good]
        rows.append((k, " ".join(rng.choice(pool, 40)), "en", "good" if good else "bad", 200))
        if k < 100:
            labels.append((k, good))
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    p = {r.doc_id: r for r in cotrain.classify(docs, known).collect()}
    unseen = range(200, 600)
    assert np.mean([(p[k].p_text >= 0.5) == (k % 2) for k in unseen]) > 0.9  # learnt from the other view


def plain_cotraining(rows, labels, rounds, most):
    """The whole exchange in plain Python over dense rows: (p_text, p_meta, score, kept) by id."""
    import math

    views = {}
    for r in rows:
        slots, values = cotrain.text_features(r[1] or "")
        text, meta = np.zeros(cotrain.DIM), np.zeros(cotrain.META)
        text[slots] = values
        for m in cotrain.meta_features(r[2], r[3], len(r[1] or "")):
            meta[m] += 0.5
        views[r[0]] = (text, meta)
    truth = dict(labels)
    ids = sorted(truth, key=lambda i: cotrain._slot(str(i), 1 << 30))
    held, train = ids[: len(ids) // 5], ids[len(ids) // 5 :]
    taught = ({}, {})

    def scores():
        out = []
        for v in (0, 1):
            known = [(i, truth[i]) for i in train] + list(taught[v].items())
            w, b = cotrain.fit(np.stack([views[i][v] for i, _ in known]).astype(np.float32), np.array([y for _, y in known], np.float32))
            a, c = cotrain.platt(np.array([views[i][v].astype(np.float32) @ w + b for i in held]), np.array([truth[i] for i in held]))
            out.append({i: float(np.clip(x[v] @ w.astype(float) + b, -30, 30)) * a + c for i, x in views.items()})
        return out

    sure = math.log(cotrain.CONFIDENT / (1 - cotrain.CONFIDENT))
    for _ in range(rounds):
        z = scores()
        for learner, teacher in ((0, 1), (1, 0)):
            best = sorted((i for i in views if z[teacher][i] >= sure), key=lambda i: (-z[teacher][i], i))[:most]
            worst = sorted((i for i in views if z[teacher][i] <= -sure), key=lambda i: (z[teacher][i], i))[:most]
            taught[learner].update({i: y for found, y in ((best, 1), (worst, 0)) for i in found if i not in truth})
    z, share = scores(), sum(truth.values()) / len(truth)
    logistic = lambda x: 1 / (1 + math.exp(-x))
    return {i: (logistic(z[0][i]), logistic(z[1][i]), logistic(z[0][i] + z[1][i] + math.log(share / (1 - share))), z[0][i] + z[1][i] >= 0) for i in views}, taught


def test_cotraining_against_plain_python(spark, monkeypatch):
    """Sampling, exchange of pseudo-labels, calibration and scores of every document."""
    monkeypatch.setattr(cotrain, "MOST", 25)
    rng = np.random.default_rng(11)
    pools = (["buy", "cheap", "pills", "now", "win", "cash"], ["calm", "river", "stone", "amber", "cloud", "field"])
    rows, labels = [], []
    for k in range(300):
        good = int(rng.random() < 0.6)
        words = rng.choice(pools[good], 30).tolist() + rng.choice(pools[1 - good], int(rng.integers(0, 14))).tolist()
        rows.append((k, " ".join(words), "en", f"s{int(rng.integers(0, 4)) + 3 * good}", 200))
        if k % 4 == 0:
            labels.append((k, good))
    rows += [(1000, None, None, None, None), (1001, "", "de", "s1", 0)]
    want, taught = plain_cotraining(rows, labels, cotrain.ROUNDS, 25)
    assert len(taught[0]) > 20 and len(taught[1]) > 20
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(4)
    got = {r.doc_id: (r.p_text, r.p_meta, r.score, r.kept) for r in cotrain.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:3] == pytest.approx(want[i][:3], abs=2e-3) and (got[i][3] == want[i][3] or abs(want[i][2] - 0.5) < 0.01), i


def test_queries_have_contract_columns(spark):
    wanted = {
        "op2_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op3_pii_bootstrap": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op6_config_lp_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op8_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
        "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    }
    for name, columns in wanted.items():
        types = dict(queries.QUERIES[name](spark, SF).dtypes)
        assert {c: types.get(c) for c in columns} == columns, name
