"""Quality rules: one threshold table compiled into one Spark projection (built-in functions only).

Edge cases: a null text counts as no text (no words, every figure 0, ``base_failed``); empty texts likewise;
repeated rows each get their own row; other columns are ignored, whatever their names; an empty table gives an
empty result. Texts are read whole, there is no cap on words, lines or characters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

SYMBOLS = "#*$%&|<>"
#: Function words of the languages served; bare words, lower case.
STOP_WORDS = tuple(
    "the of and to in that is was for on with as he be by at from this it are or an a de la le et les des en un une du "
    "que est pour dans qui sur au pas se der die und das den von zu mit sich auf ein ist im dem nicht eine el los las y "
    "por con del al lo su no para si".split()
)

#: As they stand in running text.
STOP_FORMS = tuple(w + end for w in STOP_WORDS for end in ("", ",", "."))


@dataclass(frozen=True)
class Rule:
    """A document is rejected if ``metric`` < ``low`` or > ``high`` and it has at least ``min_words`` words."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The threshold table. Metrics are the keys of :func:`metrics`.
RULES = (
    Rule("mean_word_chars", low=2.0, high=14.0, min_words=50),
    Rule("symbols_per_word", high=0.1),
    Rule("bangs_per_word", high=0.5, min_words=50),
    Rule("stop_ratio", low=0.04, min_words=100),
    Rule("dup_line_ratio", high=0.35, min_words=50),
)


def _base(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_stop, n_lines, n_distinct_lines, n_repeat_words, ...) of one text."""

    def windows(h: Column) -> Column:
        """Positions (sorted) of the 3-word windows that the text holds at least twice; ``h``: a hash of each window.

        Most texts repeat none: a distinct count tells, and only the others are sorted.
        """
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i")))
        twice = let(
            F.sort_array(placed),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: F.get(s, k + 1)["h"].eqNullSafe(x["h"]) | F.get(s, k - 1)["h"].eqNullSafe(x["h"])),
                    lambda x: x["i"],
                )
            ),
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<int>")).otherwise(twice)

    def covered(starts: Column) -> Column:
        """Words under windows that start at ``starts``: each adds at most 3, less where the next one begins sooner."""
        return F.aggregate(
            F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        )

    def lines(t: Column) -> Column:
        kept = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        return let(kept, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    # x, i run over words 3, 4, ...: the window is words i, i + 1 and x (a 64-bit hash stands for the three words)
    hashed = lambda w: F.transform(F.slice(w, 3, F.size(w)), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
    ln = lines(text)
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            ln["n"].cast("long").alias("n_lines"),
            (ln["n"] - ln["d"]).cast("long").alias("n_dup_lines"),
            let(let(hashed(w), windows), covered).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_FORMS))).cast("long").alias("n_stop"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
        ),
    )


def metrics(q: Column) -> dict[str, Column]:
    """The figures a rule may bound, by name."""
    words = F.greatest(q["n_words"], F.lit(1))
    return {
        "n_words": q["n_words"].cast("double"),
        "mean_word_chars": q["word_chars"] / words,
        "symbols_per_word": q["n_symbols"] / words,
        "bangs_per_word": q["n_bangs"] / words,
        "stop_ratio": q["n_stop"] / words,
        "dup_line_ratio": q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)),
        "repeat_ratio": q["n_repeat_words"] / words,
    }


def compile_rules(q: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a text fails, as one array expression."""
    m = metrics(q)
    failed = []
    for r in rules:
        out = reduce(
            lambda a, b: a | b,
            ([m[r.metric] < F.lit(float(r.low))] if r.low is not None else [])
            + ([m[r.metric] > F.lit(float(r.high))] if r.high is not None else []),
        )
        failed.append(F.when(out & (q["n_words"] >= r.min_words), F.lit(r.metric)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the figures, ``base_failed``, ``failed_rules`` and ``kept``; ``keep``: further columns to carry."""
    q = F.col("__q")
    # One let around all: the struct is computed once per row although many columns read it.
    scored = docs.select(
        F.col(id_col),
        *[F.col(c) for c in keep if c != id_col],
        let(
            _base(F.coalesce(F.col(text_col).cast("string"), F.lit(""))),
            lambda b: F.struct(b.alias("b"), compile_rules(b, rules).alias("failed")),
        ).alias("__q"),
    )
    b = q["b"]
    base_failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
    return scored.select(
        F.col(id_col),
        *[F.col(c) for c in keep if c != id_col],
        *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(q["failed"]) == 0)).alias("kept"),
        F.concat_ws(",", q["failed"]).alias("failed_rules"),
    )


def filter_kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, all columns as they came."""
    b = let(
        _base(F.coalesce(F.col("text").cast("string"), F.lit(""))),
        lambda q: (q["n_words"] >= 50)
        & (100 * q["n_repeat_words"] <= 50 * q["n_words"])
        & (F.size(compile_rules(q, rules)) == 0),
    )
    return docs.where(b)


def _rule_sql(r: Rule) -> str:
    tests = [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
    return f"CASE WHEN ({' OR '.join(tests)}) AND n_words >= {r.min_words} THEN '{r.metric}' END"


_IN = ", ".join(f"'{x}'" for x in STOP_FORMS)
#: The same over rows of windows instead of arrays: a window's count tells, its three words are marked.
SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
x AS (SELECT k, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS win FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM x) WHERE c > 1),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY k),
f AS (SELECT doc_id, len(w) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[{SYMBOLS}]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_IN}))) AS n_stop, len(regexp_extract_all(text, '!')) AS n_bangs
  FROM w LEFT JOIN c ON w.k = c.k),
m AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_bangs / greatest(n_words, 1) AS bangs_per_word,
    n_stop / greatest(n_words, 1) AS stop_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS (SELECT *, concat_ws(',', {", ".join(map(_rule_sql, RULES))}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""
