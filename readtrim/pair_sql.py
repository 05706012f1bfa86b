"""DuckDB SQL for the steps that look at whole pairs: approximate matching, overlap decisions, consensus and detection.

Written from the rules, not from the kernels: windows and scores are lists of one row, decisions are CASE expressions.
Reads are those of ``queries.PAIRS_SQL``: letters ACGTN, at least 20 bases, and never an N of one mate over an N of the other.
"""

from __future__ import annotations


class Chain:
    """SELECTs that each add or replace columns of the one before."""

    def __init__(self, head: str, start: str):
        self.parts, self.now, self.k = [head], start, 0

    def _next(self, body: str) -> Chain:
        self.k += 1
        self.parts.append(f"st{self.k} AS ({body.format(prev=self.now)})")
        self.now = f"st{self.k}"
        return self

    def add(self, **columns: str) -> Chain:
        return self._next("SELECT *, " + ", ".join(f"{v.replace('{', '{{').replace('}', '}}')} AS {k}" for k, v in columns.items()) + " FROM {prev}")

    def put(self, **columns: str) -> Chain:
        return self._next("SELECT * REPLACE (" + ", ".join(f"{v.replace('{', '{{').replace('}', '}}')} AS {k}" for k, v in columns.items()) + ") FROM {prev}")

    def drop(self, *columns: str) -> Chain:
        return self._next(f"SELECT * EXCLUDE ({', '.join(columns)}) FROM {{prev}}")

    def where(self, test: str) -> Chain:
        return self._next(f"SELECT * FROM {{prev}} WHERE {test}")

    def sql(self, select: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + select.format(prev=self.now)


def half(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN -((-({x})) // 2) ELSE ({x}) // 2 END)"


def rc(seq: str) -> str:
    return f"translate(reverse({seq}), 'ACGTN', 'TGCAN')"


def chance_list(qual: str) -> str:
    return f"list_transform(range(1, length({qual}) + 1), lambda i: 1 - pow(10, -least(ascii(substring({qual}, cast(i AS int), 1)) - 33, 50) / 10.0))"


def mean(chances: str, first: str, last: str | None = None) -> str:
    """Mean chance of the positions first..last (16 of them) that lie in the read."""
    a, b = f"greatest({first}, 1)", f"least({last or f'({first}) + 15'}, len({chances}))"
    return f"(CASE WHEN {b} < {a} THEN 0 ELSE list_avg({chances}[{a}:{b}]) END)"


def scan(c: Chain, out: str, hay: str, needle: str, start: str = "1", tol: str = "2", until: str | None = None) -> None:
    """Adds ``{out}_i`` (1-based place, 0 none) and ``{out}_n`` (bases that fit)."""
    n = f"length({hay})"
    last, limit = f"({n} - 15) // 2", "1000000" if until is None else half(f"({until}) - 1")
    c.add(**{f"{out}_i": "cast(0 AS BIGINT)", f"{out}_n": "cast(0 AS BIGINT)", f"{out}_live": "true", f"{out}_tol": tol})

    def stage(width: int, lo: str, hi: str) -> None:
        c.add(**{f"{out}_lo": f"greatest({lo}, 0)", f"{out}_hi": f"least({hi}, ({n} + 1) // 2)"})
        windows = f"list_transform(range(2 * {out}_lo, 2 * {out}_hi + 2), lambda j: substring({hay}, cast(j + 1 - j % 2 AS int), {width}))"
        c.add(**{f"{out}_w": f"CASE WHEN {out}_live AND {out}_lo <= {out}_hi THEN {windows} ELSE [] END"})
        part = f"substring(CASE WHEN i % 2 = 1 THEN substring({needle}, 2, {width}) ELSE substring({needle}, 1, {width}) END, 1, length(w))"
        # an N of either side fits any base
        fit = f"length(w) - hamming(w, {part}) + length(w) - length(replace(w, 'N', '')) + length(w) - length(replace({part}, 'N', ''))"
        c.put(**{f"{out}_w": f"list_transform({out}_w, lambda w, i: CASE WHEN w = '' THEN 0 ELSE {fit} END)"})
        better = f"len({out}_w) > 0 AND list_max({out}_w) >= {width} - {out}_tol AND list_max({out}_w) > {out}_n"
        c.put(**{
            f"{out}_i": f"CASE WHEN {better} THEN 2 * {out}_lo + list_position({out}_w, list_max({out}_w)) - 1 ELSE {out}_i END",
            f"{out}_n": f"CASE WHEN {better} THEN list_max({out}_w) ELSE {out}_n END",
        })
        c.drop(f"{out}_lo", f"{out}_hi", f"{out}_w")

    stage(16, half(f"({start}) - 1"), f"least({last}, {limit})")
    c.put(**{f"{out}_live": f"NOT ({out}_n >= 8 OR {limit} <= {last})"})
    for width, ahead, enough in ((8, 4, 4), (4, 2, 2)):
        c.put(**{f"{out}_tol": f"({out}_tol + 1) // 2"})
        stage(width, f"{last} + 1", f"least({last} + {ahead}, {limit})")
        last = f"({last} + {ahead})"
        c.put(**{f"{out}_live": f"{out}_live AND NOT ({out}_n >= {enough} OR {limit} <= {last})"})
    c.put(**{f"{out}_tol": f"({out}_tol + 1) // 2"})
    stage(2, f"{last} + 1", f"({n} - 1) // 2")
    over = f"{out}_live AND {out}_i > {n}"
    c.put(**{f"{out}_i": f"CASE WHEN {over} THEN 0 ELSE {out}_i END", f"{out}_n": f"CASE WHEN {over} THEN 0 ELSE {out}_n END"})
    c.drop(f"{out}_live", f"{out}_tol")


def _sized(c: Chain, out: str, n: str) -> None:
    """A place in a reverse complement as the insert size it tells."""
    c.put(**{f"{out}_i": f"CASE WHEN {out}_i = 0 THEN 0 ELSE {n} - {out}_i + 1 END", f"{out}_n": f"CASE WHEN {out}_i = 0 THEN 0 ELSE {out}_n END"})


def prepare(c: Chain) -> None:
    c.add(n1="length(seq1)", n2="length(seq2)", r1=rc("seq1"), r2=rc("seq2"), c1=chance_list("qual1"), c2=chance_list("qual2"))


def decide(c: Chain, out: str, adapter1: str, adapter2: str) -> None:
    """Adds ``{out}_trim``, ``{out}_s1``, ``{out}_s2`` (where to cut) and ``{out}_score`` for one pair of adapters."""
    scan(c, "a1", "seq1", f"'{adapter1}'")
    scan(c, "a2", "seq2", f"'{adapter2}'")
    c.add(tol="2 + CASE WHEN greatest(a1_n, a2_n) < 9 THEN 1 ELSE 0 END")
    scan(c, "p1", "r1", "seq2", tol="tol")
    scan(c, "p2", "r2", "seq1", tol="tol")
    _sized(c, "p1", "n1")
    _sized(c, "p2", "n2")
    c.put(a1_i="a1_i - 1", a2_i="a2_i - 1")
    # the best of all, the later one if equal
    c.add(top="greatest(a1_n, a2_n, p1_n, p2_n)")
    c.add(place="1 + CASE top WHEN p2_n THEN p2_i WHEN p1_n THEN p1_i WHEN a2_n THEN a2_i ELSE a1_i END")
    for k, hay, needle, n in (("a1", "seq1", f"'{adapter1}'", None), ("a2", "seq2", f"'{adapter2}'", None), ("p1", "r1", "seq2", "n1"), ("p2", "r2", "seq1", "n2")):
        c.add(spot="place" if n is None else f"{n} - place + 2")
        scan(c, "x", hay, needle, "spot", "5", "spot + 1")
        size = "x_i - 1" if n is None else f"CASE WHEN x_i = 0 THEN 0 ELSE {n} - x_i + 1 END"
        new = f"top > 9 AND {k}_n < 9 AND x_n > 9"
        c.put(**{f"{k}_i": f"CASE WHEN {new} THEN {size} ELSE {k}_i END", f"{k}_n": f"CASE WHEN {new} THEN x_n ELSE {k}_n END"})
        c.drop("spot", "x_i", "x_n")
    least = lambda m: f"greatest({m}, 0.75)"
    c.add(
        sa1=f"a1_n * {least(mean('c1', 'a1_i + 1'))}", sa2=f"a2_n * {least(mean('c2', 'a2_i + 1'))}",
        sp1=f"p1_n * ({least(mean('c1', 'p1_i - 15'))} * {least(mean('c2', '1'))})", sp2=f"p2_n * ({least(mean('c2', 'p2_i - 15'))} * {least(mean('c1', '1'))})",
    )
    for m in (1, 2):
        c.add(**{f"z{m}": f"CASE WHEN a{m}_i = p{m}_i OR sa{m} > sp{m} THEN a{m}_i ELSE p{m}_i END", f"v{m}": f"CASE WHEN a{m}_i = p{m}_i THEN sa{m} + sp{m} ELSE greatest(sa{m}, sp{m}) END"})
    odd = lambda m: f"((a{m}_i > n{m} - 12 OR a{m}_i = -1) AND p{m}_i < n{m} - 12)"
    doubt = f"(NOT (n1 < greatest(a2_i, p2_i) OR n2 < greatest(a1_i, p1_i)) AND ({odd(1)} OR {odd(2)}) AND NOT (a1_i = p1_i OR a2_i = p2_i))"
    c.add(**{f"{out}_score": "CASE WHEN z1 = z2 THEN v1 + v2 ELSE greatest(v1, v2) END"})
    poor1 = f"(z1 <> z2 AND v1 > 10 AND {mean('c2', 'z1 + 1')} < 0.6)"
    poor2 = f"(z1 <> z2 AND NOT v1 > 10 AND v2 > 10 AND {mean('c1', 'z2 + 1')} < 0.6)"
    c.add(**{
        f"{out}_trim": f"{poor1} OR {poor2} OR ({out}_score > 10 AND NOT {doubt})",
        f"{out}_s1": "CASE WHEN z1 = z2 OR v1 > v2 THEN z1 ELSE z2 END", f"{out}_s2": "CASE WHEN z1 <> z2 AND v1 > v2 THEN z1 ELSE z2 END",
    })
    c.drop("a1_i", "a1_n", "a2_i", "a2_n", "p1_i", "p1_n", "p2_i", "p2_n", "tol", "top", "place", "sa1", "sa2", "sp1", "sp2", "z1", "z2", "v1", "v2")


def consensus(c: Chain, size: str, when: str) -> None:
    """Where the mates overlap by insert size ``size``, the base with the better quality overwrites the other."""
    c.add(ins=size, short=f"n2 < {size}")
    c.add(fst="CASE WHEN short THEN ins - n2 + 1 + (ins - n2 + 1 + 1) % 2 ELSE 1 END", bump="CASE WHEN short THEN (ins - n2 + 1 + 1) % 2 ELSE 0 END")
    c.add(skp="CASE WHEN short THEN bump ELSE n2 - ins END", lap="least(CASE WHEN short THEN n2 - bump ELSE ins END, n1 - fst + 1)")
    c.add(can=f"({when}) AND lap > 0 AND ins > 0")
    # all but the last block of 16 are looked at; an N of either mate is no mismatch
    base = lambda seq, at: f"substring({seq}, cast({at} AS int), 1)"
    x, y = base("seq1", "fst + k"), base("r2", "skp + k + 1")
    wrong = f"list_sum(list_transform(range(0, least(lap, 16 * (((lap + 1) // 2) // 8))), lambda k: CASE WHEN {y} <> '' AND {y} <> 'N' AND {x} <> 'N' AND {x} <> {y} THEN 1 ELSE 0 END))"
    c.add(ones=f"CASE WHEN can THEN lap - ((((lap + 1) // 2) + 7) // 8) * 16 + 16 * (((lap + 1) // 2) // 8) + coalesce({wrong}, 0) END")
    c.put(can="can AND ones <= floor((1 + 0.28::double) * lap)")
    other = lambda seq, i: f"translate(substring({seq}, cast(ins - {i} + 1 AS int), 1), 'ACGTN', 'TGCAN')"
    q = lambda qual, at: f"least(ascii(substring({qual}, cast({at} AS int), 1)), 83)"
    inside1 = "can AND i >= fst AND i <= least(n1, ins) AND ins - i + 1 BETWEEN 1 AND n2"
    inside2 = "can AND ins - i + 1 >= fst AND ins - i + 1 <= least(n1, ins) AND i <= n2"
    take1 = f"{inside1} AND {base('seq1', 'i')} <> {other('seq2', 'i')} AND {q('qual2', 'ins - i + 1')} > {q('qual1', 'i')}"
    take2 = f"{inside2} AND {base('seq2', 'i')} <> {other('seq1', 'i')} AND {q('qual1', 'ins - i + 1')} > {q('qual2', 'i')}"

    def built(m: int, take: str, new: str) -> str:
        own = "seq" if new.startswith("translate") else "qual"
        return f"array_to_string(list_transform(range(1, n{m} + 1), lambda i: CASE WHEN {take} THEN {new} ELSE substring({own}{m}, cast(i AS int), 1) END), '')"

    at = lambda qual: f"substring({qual}, cast(ins - i + 1 AS int), 1)"
    c.add(new_seq1=built(1, take1, other("seq2", "i")), new_qual1=built(1, take1, at("qual2")), new_seq2=built(2, take2, other("seq1", "i")), new_qual2=built(2, take2, at("qual1")))
    c.put(**{f"{s}{m}": f"CASE WHEN can THEN new_{s}{m} ELSE {s}{m} END" for s in ("seq", "qual") for m in (1, 2)})
    c.drop("ins", "short", "fst", "bump", "skp", "lap", "can", "ones", "new_seq1", "new_qual1", "new_seq2", "new_qual2")


def shifted(m: int, adapter: str, keep: str) -> str:
    """A cut moved by one base if the adapter's first four bases agree better there."""
    same = lambda d: "(" + " + ".join(f"cast(substring(seq{m}, cast({keep} + {d + k} AS int), 1) = '{adapter[k]}' AS int)" for k in range(4)) + ")"
    here, left, right = same(1), same(0), same(2)
    move = f"CASE WHEN {here} >= {left} THEN CASE WHEN {here} >= {right} THEN 0 ELSE 1 END ELSE CASE WHEN {left} >= {right} THEN -1 ELSE 1 END END"
    return f"greatest(CASE WHEN {keep} >= n{m} - 3 OR {keep} < 1 THEN {keep} ELSE {keep} + {move} END, 0)"


def trim_adapters(c: Chain, adapters: list[tuple[str, str]], with_consensus: bool = True) -> None:
    """The whole step: decision over all pairs of adapters, consensus, cut. Adds ``adapter_trim_r1``."""
    prepare(c)
    for k, (a1, a2) in enumerate(adapters):
        decide(c, f"d{k}", a1, a2)
    c.add(trim="false", s1="cast(-1 AS BIGINT)", s2="cast(-1 AS BIGINT)", score="cast(-1 AS DOUBLE)", which="-1")
    for k in range(len(adapters)):
        take = f"score <= 28.8 AND d{k}_trim AND (NOT trim OR score < d{k}_score)"
        c.put(trim=f"trim OR ({take})", s1=f"CASE WHEN {take} THEN d{k}_s1 ELSE s1 END", s2=f"CASE WHEN {take} THEN d{k}_s2 ELSE s2 END", score=f"CASE WHEN {take} THEN d{k}_score ELSE score END", which=f"CASE WHEN {take} THEN {k} ELSE which END")
    if with_consensus:
        scan(c, "h1", "seq1", "r2", tol="10")
        scan(c, "h2", "seq2", "r1", tol="10")
        c.add(o1="n1 - h1_i + 1", o2="n2 - h2_i + 1")
        consensus(c, "CASE WHEN trim THEN s1 ELSE n1 + n2 - o1 END", "CASE WHEN trim THEN s1 = s2 AND s1 > 0 ELSE o1 = o2 END")
        c.drop("h1_i", "h1_n", "h2_i", "h2_n", "o1", "o2")
    for m in (1, 2):
        cut = " ".join(f"WHEN {k} THEN {shifted(m, a[m - 1], f's{m}')}" for k, a in enumerate(adapters))
        c.add(**{f"keep{m}": f"CASE which {cut} ELSE n{m} END"})
    c.put(**{f"{s}{m}": f"substring({s}{m}, 1, cast(keep{m} AS int))" for s in ("seq", "qual") for m in (1, 2)})
    c.add(adapter_trim_r1="cast(trim AS int)")
    c.drop("n1", "n2", "r1", "r2", "c1", "c2", "trim", "s1", "s2", "score", "which", "keep1", "keep2", *[f"d{k}_{x}" for k in range(len(adapters)) for x in ("score", "trim", "s1", "s2")])


def quality_cut(c: Chain, m: int, score: int = 53, k: int = 5) -> None:
    """Up to the first low base of the first low window."""
    c.add(q=f"list_transform(range(1, length(qual{m}) + 1), lambda i: ascii(substring(qual{m}, cast(i AS int), 1)))", n=f"length(qual{m})")
    c.add(low=f"list_min(list_filter(range(1, n + 1), lambda i: q[i] < {score}))")
    c.add(stop=f"coalesce(list_min(list_filter(range(low, n - {k} + 2), lambda i: list_sum(q[i:i + {k} - 1]) < {score} * {k})), greatest(low, n - {k} + 2))")
    c.add(keep=f"cast(coalesce(CASE WHEN low IS NOT NULL THEN list_min(list_filter(range(stop, n + 1), lambda i: q[i] < {score})) - 1 END, n) AS int)")
    c.put(**{f"{s}{m}": f"substring({s}{m}, 1, keep)" for s in ("seq", "qual")})
    c.drop("q", "n", "low", "stop", "keep")


def poor_tail_cut(c: Chain, m: int) -> None:
    """Without the run of the two lowest qualities at the end."""
    c.add(keep=f"""cast(length(regexp_replace(qual{m}, '[!"]+$', '')) AS int)""")
    c.put(**{f"{s}{m}": f"substring({s}{m}, 1, keep)" for s in ("seq", "qual")})
    c.drop("keep")


def adapter_cut_single(c: Chain, adapter: str) -> None:
    scan(c, "h", "seq1", f"'{adapter}'")
    c.add(c1=chance_list("qual1"))
    c.add(keep=f"cast(CASE WHEN h_i > 0 AND h_n * greatest({mean('c1', 'h_i')}, 0.75) > 10 THEN h_i - 1 ELSE length(seq1) END AS int)")
    c.put(seq1="substring(seq1, 1, keep)", qual1="substring(qual1, 1, keep)")
    c.drop("h_i", "h_n", "c1", "keep")


def lossy_key(seq: str) -> str:
    """The short key: units, C-like bases, length, and the bases by pairs, odd and ambiguous pairs as CC."""
    pair = f"substring({seq}, cast(2 * i + 1 AS int), 2)"
    clean = f"array_to_string(list_transform(range(0, (length({seq}) + 1) // 2), lambda i: CASE WHEN regexp_matches({pair}, '^[ACGT][ACGT]$') THEN {pair} ELSE 'CC' END), '')"
    count = lambda c: f"len(regexp_extract_all({seq}, '[{c}]'))"
    return f"concat_ws(':', length({seq}) + 3 * {count('N')}, {count('CN')}, length({seq}), {clean})"


def behind_overlap(c: Chain) -> None:
    """Adds ``u``: what follows the overlap in each mate, as (mate, adapter, prob, start), where it is of good quality."""
    prepare(c)
    scan(c, "p1", "r1", "seq2", tol="3")
    scan(c, "p2", "r2", "seq1", tol="3")
    _sized(c, "p1", "n1")
    _sized(c, "p2", "n2")
    c.add(start="p1_i + 1")
    item = lambda m: f"{{'mate': {m}, 'fit': p{m}_n, 'adapter': substring(seq{m}, cast(start AS int), 16), 'prob': {mean(f'c{m}', 'start')}}}"
    c.add(u=f"[{item(1)}, {item(2)}]")
    c._next("SELECT start, unnest(u, recursive := true) FROM {prev}")
    c.where("fit >= 9 AND adapter <> '' AND start >= 16 AND prob > 0.75")


#: Adapters cut short give their share to longer ones, the shortest first; then the most frequent ones by rank.
def merge_and_rank(c: Chain, n_reads: str) -> None:
    c._next(f"SELECT mate, adapter, count(*) / ({n_reads}) AS occ, avg(prob) AS identity, avg(start) AS pos FROM {{prev}} GROUP BY mate, adapter")
    for k in range(1, 16):
        now = c.now
        c._next(f"""SELECT s.mate, l.adapter, s.occ / count(*) OVER (PARTITION BY s.mate, s.adapter) AS occ, s.identity, s.pos
  FROM {now} s JOIN {now} l ON s.mate = l.mate AND length(s.adapter) = {k} AND length(l.adapter) > {k} AND l.adapter LIKE translate(s.adapter, 'N', '_') || '%'""")
        gifts = c.now
        c._next(f"""SELECT mate, adapter, sum(occ) AS occ, sum(occ * identity) / sum(occ) AS identity, sum(occ * pos) / sum(occ) AS pos FROM (
    SELECT mate, adapter, occ, identity, pos FROM {now} a WHERE NOT (length(adapter) = {k} AND EXISTS (SELECT 1 FROM {now} l WHERE l.mate = a.mate AND length(l.adapter) > {k} AND l.adapter LIKE translate(a.adapter, 'N', '_') || '%'))
    UNION ALL SELECT mate, adapter, occ, identity, pos FROM {gifts}) GROUP BY mate, adapter""")
    c._next(f"SELECT *, cast(round_even(occ * ({n_reads}), 0) AS BIGINT) AS count FROM {{prev}} WHERE occ > 0.0004")
    c._next("SELECT *, cast(row_number() OVER (PARTITION BY mate ORDER BY count DESC, identity DESC, length(adapter), adapter) AS int) AS rank, max(count) OVER (PARTITION BY mate) AS best FROM {prev}")
    c.where("count > 0.3 * best")
