"""Mixing sources to target weights: iterative proportional fitting over source, language and topic, then sampling.

All steps are DataFrame expressions. Documents collapse (map side first) to a table of cells, one per source, language
and topic with its token weight; the raking touches cells only: in each round the weights are scaled to the targets
of one dimension after the other, no cell beyond its tokens. Targets that the documents can't meet are lowered to what is there
beforehand, the rest of the dimension takes the surplus (FILL steps of water filling). A cell's calibrated probability is its
raked weight over its own tokens. A document is kept if a uniform number made from its id lies below its cell's probability.

Token weights are word counts (runs of anything but space and U+0009 to U+000D).

Edge cases: null source or language is a value of its own (the empty string); null or empty texts weigh 0 and are kept
with their cell's probability; repeated rows and ids share their draw; a target without documents is left out and the
rest scaled up; documents of a value without a target get probability 0; empty in, empty out; other columns pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialize

DIMS = ("source", "lang", "topic")
ROUNDS, FILL, ALPHA, SHARE = 6, 4, 0.7, 0.6
SEED = "mix-1"


#: Topics by the form of a text: what counts, and for how many characters of the text one of it stands.
FORMS = (
    ("legal", 1500, ("icense", "opyright", "ights reserved", "arrant", "CC BY")),
    ("table", 20, "|"),
    ("markup", 10, "<>{}[]#=;*$%&"),
    ("talk", 25, "?"),
    ("talk", 25, "!"),
    ("contact", 100, "@"),
    ("list", 80, "\n"),
)
TOPICS = tuple(dict.fromkeys(name for name, _, _ in FORMS))


def topic_of(text: Column) -> Column:
    """A coarse topic by form: the one whose marks stand for most of the text, or prose if none does for all of it.

    Marks are terms (present or not) or characters (each one counts); all figures are whole numbers. An empty text has the topic none.
    """
    n, score = F.length(text), {}

    def found(marks: str | tuple[str, ...]) -> Column:
        if not isinstance(marks, str):
            return sum((F.contains(text, F.lit(m)).cast("int") for m in marks), F.lit(0))
        # single characters by a byte search, sets of them by one class
        if len(marks) == 1:
            return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(marks), F.lit("")))
        return F.regexp_count(text, F.lit("[" + re.escape(marks) + "]"))

    for name, weight, marks in FORMS:
        score[name] = score.get(name, F.lit(0)) + weight * found(marks)
    scores = F.struct(*[score[t].alias(t) for t in TOPICS])

    def named(s: Column) -> Column:
        best = F.greatest(*[s[t] for t in TOPICS])
        out = F.when(n == 0, "none").when(best < n, "prose")
        for t in TOPICS:
            out = out.when(s[t] == best, t)
        return out

    # never null, so that no filter on the join's key makes it a second time
    return F.coalesce(let(scores, named), F.lit("prose"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def labelled(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__source``, ``__lang``, ``__topic``."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumns({"__source": label("source"), "__lang": label("lang"), "__topic": topic_of(_text())})


def tempered(cells: DataFrame, dim: str, alpha: float = ALPHA) -> DataFrame:
    """Default targets: a value's share is its token share to the power ``alpha``, normalised."""
    by = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).where("n > 0").select(dim, F.pow(F.col("n"), alpha).alias("p"))
    return _shares(by, dim, "p")


def _shares(by: DataFrame, dim: str, col: str) -> DataFrame:
    """(dim, share): ``col`` over its sum."""
    whole = by.agg(F.sum(col)).first()[0] or 1.0
    return by.select(dim, (F.col(col) / F.lit(float(whole))).alias("share"))


def feasible(target: DataFrame, cells: DataFrame, dim: str, total: float, fill: int = FILL) -> DataFrame:
    """(dim, share): targets that the documents can meet. A value gets its tokens at most, what is over goes to the others."""
    there = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    t = target.join(there, dim).select(dim, "n", F.least(F.col("share") * F.lit(total), F.col("n")).alias("goal"))
    for _ in range(fill):
        t = materialize(t, "goals")
        free = F.col("goal") < F.col("n")
        sums = t.agg(F.sum(F.when(free, F.col("goal"))).alias("free"), F.sum(F.when(~free, F.col("goal"))).alias("full")).first()
        if not sums.free or sums.free + (sums.full or 0.0) >= total * (1 - 1e-9):
            break
        k = (total - (sums.full or 0.0)) / sums.free
        t = t.select(dim, "n", F.when(free, F.least(F.col("goal") * F.lit(k), F.col("n"))).otherwise(F.col("goal")).alias("goal"))
    return t.select(dim, (F.col("goal") / F.lit(total or 1.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], total: float, rounds: int = ROUNDS, bounded: bool = False) -> DataFrame:
    """Cells with ``w``: weights whose sums over each dimension meet its target shares of ``total``.

    ``targets``: dimension -> (value, share). Each step is one aggregation and one join on the dimension; the small
    side is as long as the dimension, and the planner alone decides whether it is short enough to broadcast.
    ``bounded``: no cell weighs more than its tokens; one that is full stays so while the others of its value grow.
    """
    w = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for dim, target in targets.items():
            full = F.col("w") >= F.col("tokens")
            now = w.groupBy(dim).agg(F.sum("w").alias("have"), F.sum(F.when(full, F.col("w")).otherwise(0.0)).alias("full")).join(target, dim)
            goal = F.col("share") * F.lit(float(total))
            shrink = F.when(F.col("have") > 0, goal / F.col("have")).otherwise(0.0)
            grow = F.when(F.col("have") > F.col("full"), (goal - F.col("full")) / (F.col("have") - F.col("full"))).otherwise(1.0)
            scale = now.select(dim, shrink.alias("k"), grow.alias("g"))
            k = F.coalesce("k", F.lit(0.0))
            new = F.col("w") * k
            if bounded:
                new = F.when(k <= 1, new).when(full, F.col("w")).otherwise(F.least(F.col("w") * F.col("g"), F.col("tokens")))
            w = w.join(scale, dim, "left").select(*cells.columns, new.alias("w"))
        # cut once a round: cells are few, and a table for each dimension took twice as long
        w = materialize(w, "raked")
    return w


def probabilities(w: DataFrame, total: float, fill: int = FILL) -> DataFrame:
    """Cells with ``p`` in [0, 1]: w / tokens; the surplus over 1 is spread over the others in proportion."""
    w = w.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") / F.col("tokens"))).otherwise(F.lit(1.0)))
    for _ in range(fill):
        sums = w.agg(
            F.sum(F.when(F.col("p") >= 1, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(F.col("p") < 1, F.col("p") * F.col("tokens")).otherwise(0)).alias("part"),
        ).first()
        if not sums.part:
            break
        k = max(1.0, (total - (sums.full or 0)) / sums.part)
        w = materialize(w.withColumn("p", F.least(F.lit(1.0), F.col("p") * F.lit(k))), "filled")
    return w


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) made from the id: 48 bits of an MD5, the same in every engine."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def cells_of(docs: DataFrame) -> DataFrame:
    tokens = F.regexp_count(_text(), F.lit(WORD)).cast("long")
    return (
        labelled(docs)
        .groupBy(*[F.col(f"__{d}").alias(d) for d in DIMS])
        .agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens"))
    )


def plan(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Cells with their raked weight ``w`` and probability ``p``; ``share``: the part of all tokens to keep."""
    cells = materialize(cells_of(docs), "cells")
    tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = targets or {d: materialize(tempered(cells, d), "target") for d in DIMS}
    # a target that no cell has is left out, the others scaled up; then what no document can meet is moved to the others
    present = {}
    for d, t in goals.items():
        there = t.join(cells.groupBy(d).agg(F.sum("tokens").alias("n")).where("n > 0").select(d), d)
        present[d] = materialize(feasible(_shares(there, d, "share"), cells, d, share * tokens), "target")
    return probabilities(rake(cells, present, share * tokens, rounds, bounded=True), share * tokens)


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, extra: bool = False, planned: DataFrame | None = None) -> DataFrame:
    """The documents drawn, all columns as they came; ``extra``: with ``topic`` and ``p`` (instead of columns of that name).

    ``planned``: what :func:`plan` gave, else it is made here.
    """
    cells = (plan(docs, targets, share) if planned is None else planned).select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("p").alias("__p"))
    drawn = labelled(docs).join(cells, [f"__{d}" for d in DIMS]).where(uniform(F.col("doc_id")) < F.col("__p"))
    if not extra:
        return drawn.select(*docs.columns)
    kept = [c for c in docs.columns if c.lower() not in ("topic", "p")]
    return drawn.select(*kept, F.col("__topic").alias("topic"), F.col("__p").alias("p"))


def _topic_sql(text: str) -> str:
    score: dict[str, str] = {}
    for name, weight, marks in FORMS:
        found = f"length({text}) - length(translate({text}, '{marks}', ''))" if isinstance(marks, str) else " + ".join(f"cast(contains({text}, '{m}') AS int)" for m in marks)
        score[name] = score.get(name, "0") + f" + {weight} * ({found})"
    best = f"greatest({', '.join(score.values())})"
    return f"CASE WHEN {text} = '' THEN 'none' WHEN {best} < length({text}) THEN 'prose' " + " ".join(f"WHEN {score[t]} = {best} THEN '{t}'" for t in TOPICS) + " END"


def sql(share: float = SHARE, rounds: int = ROUNDS, fill: int = FILL, alpha: float = ALPHA) -> str:
    """The same sample in SQL: every step of the raking is a pair of common table expressions."""
    out = [
        f"d AS (SELECT *, coalesce(source, '') AS s_, coalesce(lang, '') AS l_, {_topic_sql('t_')} AS k_ FROM (SELECT *, coalesce(text, '') AS t_ FROM documents))",
        "cells AS MATERIALIZED (SELECT s_ AS source, l_ AS lang, k_ AS topic, cast(sum(len(regexp_extract_all(t_, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
        f"total AS MATERIALIZED (SELECT {share}::double * sum(tokens) AS total FROM cells)",
    ]
    for dim in DIMS:
        out.append(f"n_{dim} AS (SELECT {dim}, cast(sum(tokens) AS DOUBLE) AS n FROM cells GROUP BY {dim} HAVING sum(tokens) > 0)")
        out.append(f"g_{dim}_0 AS MATERIALIZED (SELECT {dim}, n, least(pow(n, {alpha}) / sum(pow(n, {alpha})) OVER () * total, n) AS goal FROM n_{dim}, total)")
        for k in range(fill):
            free, full = "sum(goal) FILTER (WHERE goal < n)", "coalesce(sum(goal) FILTER (WHERE goal >= n), 0)"
            factor = f"CASE WHEN coalesce({free}, 0) = 0 OR {free} + {full} >= any_value(total) * (1 - 1e-9::double) THEN 1 ELSE (any_value(total) - {full}) / {free} END"
            out.append(f"f_{dim}_{k} AS (SELECT {factor} AS k FROM g_{dim}_{k}, total)")
            out.append(f"g_{dim}_{k + 1} AS MATERIALIZED (SELECT {dim}, n, CASE WHEN goal < n THEN least(goal * k, n) ELSE goal END AS goal FROM g_{dim}_{k}, f_{dim}_{k})")
    now = "w0"
    out.append("w0 AS MATERIALIZED (SELECT *, cast(tokens AS DOUBLE) AS w FROM cells)")
    for step in range(rounds * len(DIMS)):
        dim, new = DIMS[step % len(DIMS)], f"w{step + 1}"
        out.append(
            f"k{step} AS (SELECT {dim}, CASE WHEN have > 0 THEN goal / have ELSE 0 END AS k, CASE WHEN have > done THEN (goal - done) / (have - done) ELSE 1 END AS g FROM "
            f"(SELECT {dim}, sum(w) AS have, coalesce(sum(w) FILTER (WHERE w >= tokens), 0) AS done FROM {now} GROUP BY {dim}) JOIN g_{dim}_{fill} USING ({dim}))"
        )
        out.append(
            f"{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN coalesce(k, 0) <= 1 THEN w * coalesce(k, 0) WHEN w >= tokens THEN w ELSE least(w * g, tokens) END AS w "
            f"FROM {now} LEFT JOIN k{step} USING ({dim}))"
        )
        now = new
    out.append(f"p0 AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN least(1, w / tokens) ELSE 1 END AS p FROM {now})")
    for k in range(fill):
        full, part = "coalesce(sum(tokens) FILTER (WHERE p >= 1), 0)", "coalesce(sum(p * tokens) FILTER (WHERE p < 1), 0)"
        out.append(f"u{k} AS (SELECT CASE WHEN {part} = 0 THEN 1 ELSE greatest(1, (any_value(total) - {full}) / {part}) END AS k FROM p{k}, total)")
        out.append(f"p{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(1, p * k) AS p FROM p{k}, u{k})")
    draw = f"cast('0x' || substr(md5(concat(coalesce(cast(doc_id AS varchar), ''), ':{SEED}')), 1, 12) AS BIGINT) / {1 << 48}.0::double"
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT d.doc_id, d.source, d.lang, d.k_ AS topic, round(p, 6) AS p FROM d JOIN p{fill} c ON d.s_ = c.source AND d.l_ = c.lang AND d.k_ = c.topic WHERE {draw} < c.p"
    )


SQL = sql()
