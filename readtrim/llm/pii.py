"""Personal data by bootstrapped contextual extraction, in DataFrame functions only (no Python on executors).

1. Seeds: the base expressions find e-mail, IP, card and phone spans (leftmost, non-overlapping per kind). The
   expressions below are the base ones made anchored and possessive, with the digit counts moved into them, so they find the same
   spans in linear time: a run of digits is matched from its first digit or not at all.
2. Candidates: identifier-like tokens that no base span touches. Loose shapes of the same four kinds
   (e-mails without a dot in the domain, IPv6, parts over 255, spaced or bracketed dots, failing cards, phones without +),
   and tokens of any other shape that hold a run of three digits: their kind is that of the pattern that trusts them.
3. Each mention (seed or candidate) has lexical patterns: its kind with the two words before it, and with the word
   before and the word after (whole words, however long; a token of any shape has them for every kind). The graph of
   patterns and instances (distinct strings) is scored in ROUNDS: a pattern's confidence is the mean score of its instances,
   held down while few instances support it; an instance's score (by kind) is one minus the product of its patterns' doubts. Seeds stay at 1.
4. Instances of confident patterns become spans at every mention with such a pattern. Base spans always stay.

Only mentions are shuffled, aggregated by distinct pattern and instance first, so a phrase that a third of all
documents share is one edge. Of the rows only those with candidates meet the table of added spans, dealt under SALTS keys.
Positions and overlaps come from running sums in blocks, so texts with very many spans take linear time.

Edge cases: a null or empty text has no spans; repeated rows each get their spans; null ids pass through; candidates
that touch a base span or an earlier candidate are dropped (of two that start together the shorter one stays, and loose
shapes of a kind go before those of any shape); texts are read whole; input columns may have any name.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, let, materialize

KINDS = ("email", "ip", "card", "phone")
#: The number of candidates of any shape, after those of KINDS.
ANY = len(KINDS)
_LOCAL = "A-Za-z0-9._%+-"
#: kind -> expression. \G lets an e-mail start where the last one ended, inside a run of local characters.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9](?=[\x20().0-9-])(?:[\x20().-]*+[0-9]){8,14}+(?![\x20().-]*+[0-9])",
}
#: Which characters a text must hold before the expression is tried.
_NEEDS = {"email": "@", "ip": "", "card": "", "phone": "+"}
#: Dots as they are written to hide an address, spaces around them included; groups of an IPv6 address.
_DOT, _GROUPS = r"\x20?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?", "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
#: Looser shapes of the same kinds. An e-mail may end a sentence; an IP has four parts of up to three digits, or is IPv6.
LOOSE = {
    "email": rf"(?<![{_LOCAL}@])[{_LOCAL}]++@[A-Za-z0-9-]++(?![A-Za-z0-9@-]|\.[A-Za-z0-9-])",
    "ip": rf"(?<![0-9])(?<![0-9]\.)[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9])"
    rf"|(?<![A-Za-z0-9_:])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|{_GROUPS}::(?:{_GROUPS})?|::{_GROUPS})(?![A-Za-z0-9_:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+(-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9-])",
}
#: Tokens of any other shape: letters, digits and what joins them, with a run of three digits.
OTHER = r"(?<![A-Za-z0-9#/_.:@+-])(?=[A-Za-z#/_.:-]*+(?:[0-9]{1,2}[A-Za-z#/_.:-]++)*+[0-9]{3})[A-Za-z0-9#]++(?:[#/_.:-]++[A-Za-z0-9]++)*+"
#: What a text must match before the looser shape is tried.
_LOOSE_NEEDS = {
    "email": "@",
    "ip": rf"[0-9]{_DOT}[0-9]{{1,3}}{_DOT}[0-9]|[0-9A-Fa-f]::|::[0-9A-Fa-f]|(?::[0-9A-Fa-f]{{1,4}}){{7}}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"[0-9][\x20.-][0-9]{3}",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
ROUNDS, SUPPORT, CONFIDENT = 3, 3, 0.8
#: Parts of the table of added spans; longest pattern that is kept as text; elements of a block of running sums.
SALTS, LONGEST, BLOCK = 16, 120, 64


def _luhn(card: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(card, "[^0-9]", "")), "", -1)
    total = F.aggregate(
        F.transform(
            F.filter(digits, lambda x: x != ""),
            lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    return _luhn(found) if kind == "card" else F.lit(True)


#: Columns of scanned and extracted rows. The input's columns are inside ROW, so none clashes with them.
ROW, BASES, LOOSES, ADDED, KEY = "__row", "__base_spans", "__loose_spans", "__added_spans", "__text_key"
_SPAN = "array<struct<start:bigint,end:bigint,kind:int,text:string,before:string,after:string>>"


def running(values: Column, op, zero: int) -> Column:
    """For each element what ``op`` makes of all before it, from ``zero``, its neutral element. Blocks keep it linear."""
    first = F.array(F.lit(zero).cast("long"))
    grow = lambda of: lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), of(x))))

    def rows_of(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(cut, lambda block: F.aggregate(block, first, grow(lambda x: x)))

    return let(
        let(values, rows_of),
        lambda rows: let(
            F.aggregate(rows, first, grow(lambda r: F.element_at(r, -1))),
            lambda before: F.flatten(F.transform(rows, lambda r, k: F.transform(F.slice(r, 1, F.size(r) - 1), lambda v: op(F.get(before, k), v)))),
        ),
    )


def _sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def _reach(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), -1)


def _before(gap: Column) -> Column:
    """The last two words of what lies before a mention; read from its end, so long gaps cost nothing more."""
    return F.lower(F.reverse(F.regexp_extract(F.reverse(gap), r"^\s*\S+(?:\s+\S+)?", 0)))


def _after(gap: Column) -> Column:
    return F.lower(F.regexp_extract(gap, r"^\s*(\S+)", 1))


def _placed(text: Column, kind: int, regex: str, test) -> Column:
    """Spans of one expression: what it finds and what lies between add up to positions (code points)."""
    parts, found = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def spans(pf: Column) -> Column:
        p, f = pf["p"], pf["f"]
        lengths = F.transform(f, lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("long"))
        return let(
            _sums(lengths),
            lambda s: F.filter(
                F.transform(
                    f,
                    lambda x, i: F.struct(
                        (F.get(s, i) + F.length(F.get(p, i))).alias("start"),
                        (F.get(s, i) + F.length(F.get(p, i)) + F.length(x)).alias("end"),
                        F.lit(kind).alias("kind"),
                        x.alias("text"),
                        _before(F.get(p, i)).alias("before"),
                        _after(F.get(p, i + 1)).alias("after"),
                    ),
                ),
                lambda x: test(x["text"]),
            ),
        )

    return let(F.struct(parts.alias("p"), found.alias("f")), spans)


def _clear(spans: Column, blocking: Column) -> Column:
    """``spans`` that touch none of ``blocking`` and no earlier one of those left; in order."""

    def apart(both: Column) -> Column:
        # both: (start, 0 for blocking or 1, end, span), sorted; a blocking span before reaches into this one, or the next begins in it
        reach = _reach(F.transform(both, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(-1).cast("long"))))
        # seen from the end, the next start is the largest negative one
        following = F.reverse(running(F.transform(F.reverse(both), lambda x: F.when(x["own"] == 0, -x["start"]).otherwise(F.lit(-(1 << 62)))), lambda a, b: F.greatest(a, b), -(1 << 62)))
        return let(
            F.struct(reach.alias("r"), following.alias("f")),
            lambda e: F.transform(
                F.filter(
                    F.transform(both, lambda x, i: F.struct(x.alias("x"), F.get(e["r"], i).alias("r"), F.get(e["f"], i).alias("f"))),
                    lambda y: (y["x"]["own"] == 1) & (y["r"] <= y["x"]["start"]) & (-y["f"] >= y["x"]["end"]),
                ),
                lambda y: y["x"]["span"],
            ),
        )

    entry = lambda own: lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x.alias("span"))
    alone = lambda s: let(_reach(F.transform(s, lambda x: x["end"])), lambda r: F.filter(s, lambda x, i: F.get(r, i) <= x["start"]))
    free = lambda s: let(F.sort_array(F.concat(F.transform(blocking, entry(0)), F.transform(s, entry(1)))), apart)
    return let(spans, lambda s: F.when(F.size(s) > 0, let(free(s), alone)).otherwise(F.array().cast(_SPAN)))


def scan(docs: DataFrame) -> DataFrame:
    """ROW (the input's columns) with the base and loose spans of its text (BASES, LOOSES), and KEY where it has loose ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digits, none = text.rlike("[0-9]"), F.array().cast(_SPAN)
    parts = []
    for k, kind in enumerate(KINDS):
        need = digits if not _NEEDS[kind] else F.contains(text, F.lit(_NEEDS[kind]))
        if kind == "card":
            need = text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
        elif kind == "ip":
            need = text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
        parts.append(F.when(need, _placed(text, k, BASE[kind], lambda x, kind=kind: _valid(kind, x))).otherwise(none))
    base = F.sort_array(F.concat(*parts))
    loose = []
    for kind, regex in LOOSE.items():
        test = (lambda x: ~_luhn(x)) if kind == "card" else (lambda x: F.lit(True))
        loose.append(F.when(text.rlike(_LOOSE_NEEDS[kind]), _placed(text, KINDS.index(kind), regex, test)).otherwise(none))
    other = F.when(text.rlike("[0-9]{3}"), _placed(text, ANY, OTHER, lambda x: F.lit(True))).otherwise(none)
    found = let(
        F.struct(base.alias("base"), F.concat(*loose).alias("loose"), other.alias("other")),
        lambda x: let(
            _clear(x["loose"], x["base"]),
            lambda kept: F.struct(x["base"].alias("base"), F.sort_array(F.concat(kept, _clear(x["other"], F.concat(x["base"], kept)))).alias("loose")),
        ),
    )
    made = docs.select(F.struct("*").alias(ROW), F.md5(text).alias(KEY), found.alias("__found"))
    return made.select(
        ROW,
        F.col("__found.base").alias(BASES),
        F.col("__found.loose").alias(LOOSES),
        F.when(F.size("__found.loose") > 0, F.col(KEY)).alias(KEY),
    )


def _patterns(m: Column) -> Column:
    """A mention's patterns: kind and the two words before; kind, the word before and the word after."""
    left = F.regexp_replace(F.regexp_extract(m["before"], r"^\s*(\S+\s+\S+)\s*$", 1), r"\s+", " ")
    one, right = F.regexp_extract(m["before"], r"(\S+)\s*$", 1), m["after"]
    short = lambda c: F.when(F.length(c) > LONGEST, F.md5(c)).otherwise(c)
    contexts = F.array_compact(
        F.array(
            F.when(left != "", F.concat_ws("\x1f", F.lit("L"), short(left))),
            F.when((one != "") & (right != ""), F.concat_ws("\x1f", F.lit("M"), short(one), short(right))),
        )
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    mine = F.when(m["kind"] < ANY, F.slice(kinds, m["kind"] + 1, F.lit(1))).otherwise(kinds)
    return F.flatten(F.transform(mine, lambda kind: F.transform(contexts, lambda c: F.concat_ws("\x1f", kind, c))))


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, confidence) of the confident patterns, from the graph of patterns and instances."""
    # an instance belongs to the kind of its pattern: a token of any shape may be trusted as one kind and not as another
    own = F.concat_ws("\x1f", F.substring_index("pattern", "\x1f", 1), "text").alias("instance")
    mention = lambda c, seed: scanned.select(F.explode(c).alias("m")).select(
        F.col("m.text").alias("text"), F.explode(_patterns(F.col("m"))).alias("pattern")
    ).select(own, "pattern", F.lit(seed).alias("seed"))
    edges = materialize(
        mention(BASES, 1.0).union(mention(LOOSES, 0.0)).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges"
    )
    # A pattern below the support has no say. One without seeds stays: instances that others find may make it confident.
    able = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support), "able")
    edges = materialize(dealt_join(edges, able, "pattern", "instance"), "graph")
    score = edges.select("pattern", "instance", "seed", F.col("seed").alias("score"))
    confidence = (F.sum("score") / (F.count("*") + 1)).alias("conf")
    for _ in range(rounds):
        conf = materialize(score.groupBy("pattern").agg(confidence, F.count("*").alias("n")), "conf")
        told = dealt_join(score.select("pattern", "instance", "seed"), conf, "pattern", "instance")
        doubt = F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.95)))))
        inst = told.groupBy("instance").agg(F.when(F.max("seed") > 0, 1.0).otherwise(1 - doubt).alias("score"), F.count("*").alias("n"))
        score = materialize(dealt_join(edges, materialize(inst, "instances"), "instance", "pattern").select("pattern", "instance", "seed", "score"), "score")
    return score.groupBy("pattern").agg(confidence).where(F.col("conf") >= confident)


def extract(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ADDED: loose spans with a confident pattern. A row's text decides, so copies agree."""
    trusted = bootstrap(scanned)
    able = scanned.where(F.size(LOOSES) > 0)
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.substring_index("pattern", "\x1f", 1)) - 1
    mention = F.struct("m.start", "m.end", F.col("found").cast("int").alias("kind"), "m.text", "m.before", "m.after")
    added = materialize(
        able.select(KEY, F.explode(LOOSES).alias("m")).distinct()
        .select(KEY, "m", F.explode(_patterns(F.col("m"))).alias("pattern")).join(trusted, "pattern", "left_semi")
        .groupBy(KEY, "m").agg(F.min(kind).alias("found"))
        .groupBy(KEY).agg(F.sort_array(F.collect_set(mention)).cast(_SPAN).alias(ADDED))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
        "added",
    )
    none = F.array().cast(_SPAN)
    # copies of one text may be a third of all rows: their key is dealt by the rest of the row
    salt = F.pmod(F.xxhash64(F.col(ROW)["doc_id"]), F.lit(SALTS)).cast("int")
    with_some = able.withColumn("__salt", salt).join(added, [KEY, "__salt"], "left").withColumn(ADDED, F.coalesce(ADDED, none)).drop("__salt")
    return with_some.unionByName(scanned.where(F.size(LOOSES) == 0).withColumn(ADDED, none))


def _joined(spans: Column) -> Column:
    kind = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _in_order(spans: Column) -> Column:
    """By start, then by kind as listed, then by end."""
    return F.transform(
        F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))),
        lambda x: x,
    )


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base counts by kind, base_sha256, all spans, n_added."""
    scanned = scan(docs.select("doc_id", "text")).withColumn(ROW, F.struct(f"{ROW}.doc_id"))
    rows = extract(materialize(scanned, "scan"))
    count = lambda k: F.size(F.filter(BASES, lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        f"{ROW}.doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined(_in_order(F.col(BASES))), 256).alias("base_sha256"),
        _joined(_in_order(F.concat(BASES, ADDED))).alias("spans"),
        F.size(ADDED).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind, as in ``[EMAIL]``; n_chars (if there) counts the new text.

    Overlapping spans become one replacement, named after the first. Texts without a span come out as they were.
    """
    rows = extract(materialize(scan(docs), "scan"))
    spans = _in_order(F.concat(BASES, ADDED))
    old = F.col(ROW).getField("text")

    def replaced(s: Column) -> Column:
        # the end of all spans before each one; a span inside that is part of the one before
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)
        names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        # pieces are cut from stretches of BLOCK spans, so no span reads the text from its beginning
        last = F.size(s) - 1

        def cut(r: Column) -> Column:
            piece = lambda text, a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
            stretches = F.transform(
                F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")),
                lambda g: piece(old, F.get(r, g * BLOCK), F.array_max(F.transform(F.slice(s, g * BLOCK + 1, F.lit(BLOCK)), lambda x: x["start"]))),
            )

            def kept(t: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    at = F.get(r, F.floor(i / BLOCK).cast("int") * BLOCK)
                    own = piece(F.get(t, F.floor(i / BLOCK).cast("int")), F.get(r, i) - at, x["start"] - at)
                    return F.when(x["start"] >= F.get(r, i), F.concat(own, F.get(names, x["kind"]))).otherwise("")

                return F.array_join(F.transform(s, one), "")

            end = F.greatest(F.get(r, last), F.get(s, last)["end"])
            return F.concat(let(stretches, kept), F.substring(old, (end + 1).cast("int"), F.lit(2147483647)))

        return let(reach, cut)

    new = F.when(F.size(BASES) + F.size(ADDED) > 0, let(spans, replaced)).otherwise(old)
    made = rows.select(ROW, new.alias("__new"))
    out = []
    for f in docs.schema.fields:
        value = F.col(ROW).getField(f.name)
        if f.name == "text":
            value = F.col("__new")
        elif f.name == "n_chars":
            value = F.when(F.col("__new").isNull(), value).otherwise(F.length("__new").cast(f.dataType))
        out.append(value.alias(f.name))
    return made.select(*out)


__all__ = ["BASE", "KINDS", "bootstrap", "extract", "find", "redact", "scan"]
