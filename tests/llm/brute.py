"""Plain Python versions of the operators' contracts, and documents with every awkward case."""

import hashlib
import re
import zlib
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROSE = "The people of the town went to the market and in that street it was quiet for a long while as he sat with a book by the window"

#: (doc_id, text, lang, source, n_chars): nulls, empty and very long texts, ties, repeated rows, odd characters.
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s0", 0),
    (3, "   \n\t \n", "en", "s0", 7),
    (4, " ".join(f"{w}{k}" for k in range(4000) for w in ("alpha", "beta", "of", "the")), "en", "s0", None),
    (5, PROSE + ". " + PROSE.upper(), "en", "s1", 250),
    (6, PROSE + ". " + PROSE.upper(), "en", "s1", 250),
    (6, PROSE + ". " + PROSE.upper(), "en", "s1", 250),
    (7, PROSE.replace("book", "letter") + ". " + PROSE.upper(), "en", None, 250),
    (8, "one two three", "fr", "s1", 13),
    (9, "one two three", None, "s1", 13),
    (10, "😀 naïve ﬁne 　 wide space ▁mark <|endoftext|> </s> <s> \r\n end  double   triple ", "de", "s2", 60),
    (11, "x" * 5000, "de", "s2", 5000),
    (12, "same line\nsame line\n\nother\nsame line\r\n same line", "en", "s2", 40),
    (13, "mail me: a.b+c@example.com, x@y.z.w@q.r or 10.0.0.256 and 192.168.1.1.7, card 4111 1111 1111 1111, +1 (555) 010-9999 4111-1111-1111-1112", "en", "s3", 130),
    (14, "10.0.0.1" * 3 + " 1 2 3 4 5 6 7 8 9 0 1 2 +1234567 +12-34-56-78-9 a@b a@b.c..d @x.y ٣.٣.٣.٣", "en", "s3", 80),
    (None, PROSE + " without an id", "en", "s3", 140),
    (None, None, None, None, None),
    (15, "# * $ % & | < > " * 40, "en", "s4", 640),
    (16, "to be or not to be or not to be or not " * 30, "en", "s4", 1140),
    (-17, "negative id\x0bvertical\x0ctab a b", "es", "s4", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use themselves.
CLASHES = ("fp", "key", "least", "n", "length", "q", "p", "topic", "base", "loose", "added", "found", "text_key", "block", "kept", "status", "piece", "start", "label", "spans", "tokens", "w", "k", "url")


def documents(spark, rows=None, clashes=True):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]) if clashes else df


def empty(spark):
    return documents(spark, [])


def words(text):
    return WORDS.findall(text or "")


def luhn(s):
    digits = [int(c) for c in s if c in "0123456789"][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(digits)) % 10 == 0


def base_spans(text):
    """(start, kind number, end), in order."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            s = m.group()
            n = sum(c.isdigit() for c in s)
            if kind == "ip" and any(int(x) > 255 for x in s.split(".")) or kind == "card" and not (12 <= n <= 19 and luhn(s)) or kind == "phone" and not 9 <= n <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def fingerprint(text):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [w] if len(w) < 4 else [w[i : i + 4] for i in range(len(w) - 3)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(" ".join(s).encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(ids, prints, budget=4):
    """Smallest id (nulls last) of each row's component."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        r = root(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    lines = Counter(x for x in text.split("\n") if WORDS.search(x))
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(n - 1 for n in lines.values()), len(repeated), failed


def topic(text):
    if not text:
        return "none"
    n = lambda chars: sum(c in chars for c in text)
    scores = {
        "legal": 1500 * sum(x in text for x in ("icense", "opyright", "ights reserved", "arrant", "CC BY")), "table": 20 * n("|"), "markup": 10 * n("<>{}[]#=;*$%&"),
        "talk": 25 * n("?!"), "contact": 100 * n("@"), "list": 80 * n("\n"),
    }
    return next(t for t, x in scores.items() if x == max(scores.values())) if max(scores.values()) >= len(text) else "prose"


def payload(text):
    raw = (text or "").encode()
    padded = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])
