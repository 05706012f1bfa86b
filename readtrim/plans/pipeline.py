"""The ordered chain of trims and filters as a Spark plan.

Steps are named, ordered by the user and may repeat; disabled ones are left out when the plan is made. Neighbouring
steps form a stage: if all of them are expressible in Catalyst the stage is a projection, otherwise it is a single Arrow
pass in which every step works on whole batches. Only PCRDedup shuffles; it is a barrier between stages.

A dropped read keeps its row: ``drop_reason`` names the step, later steps leave it alone, and counters are ordinary integer
columns (``polyG_r1``, ...), so totals are one aggregate and task retries can't count twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs, kernels
from ..functions.batch import Mate
from ..operators import dedup
from .options import TrimOptions
from .store import materialize

COUNTERS = (
    "polyG", "polyT", "polyA", "polyC", "complexity_filtered", "hard_clip_after", "tail_low_qual_trim", "tail_N_trim",
    "length_filtered", "max_n_filtered", "pcr_dedup_removed", "quality_trim", "adapter_trim",
)
POLY = ("PolyG", "PolyT", "PolyA", "PolyC")
DEFAULT_ORDER = (
    "CheckIdentifier", *POLY, "LengthFilter", "AdapterTrim", "HardClipEndR1", "HardClipEndR2", "HardClipAfterR1", "HardClipAfterR2",
    "HardClipFrontR1", "HardClipFrontR2", "QualityTrim", "TailNTrim", "MaxNFilter", "LengthFilter", "ComplexityFilter", "PCRDedup",
)
GROUPS = {
    "DefaultOrder": DEFAULT_ORDER,
    "PolyX": POLY,
    "HardClipEnd": ("HardClipEndR1", "HardClipEndR2"),
    "HardClipAfter": ("HardClipAfterR1", "HardClipAfterR2"),
    "HardClipFront": ("HardClipFrontR1", "HardClipFrontR2"),
}


class Batch:
    """Reads of one Arrow batch under way: mates, who is still in, counters and why rows were dropped."""

    def __init__(self, mates: list[Mate], reasons: list[str | None]):
        self.mates = mates
        self.reason = np.array(reasons, dtype=object)
        self.live = np.array([r is None for r in reasons], bool)
        self.counts: dict[str, np.ndarray] = {}

    def count(self, counter: str, mate: int, rows: np.ndarray) -> None:
        name = f"{counter}_r{mate + 1}"
        self.counts[name] = self.counts.get(name, 0) + rows.astype(np.int32)

    def keep(self, mate: int, keep: np.ndarray) -> np.ndarray:
        """Cut live rows; which of them got shorter."""
        m = self.mates[mate]
        shorter = self.live & (keep < m.n)
        m.keep_head(np.where(shorter, keep, m.n))
        return shorter

    def drop(self, rows: np.ndarray, reason: str) -> np.ndarray:
        rows = rows & self.live
        self.reason[rows] = reason
        self.live &= ~rows
        return rows


@dataclass
class Step:
    """One step: over a batch, and (where Catalyst can say it) over a DataFrame."""

    name: str
    kernel: Callable[[Batch], None] | None = None
    expr: Callable[[DataFrame], DataFrame] | None = None
    counters: tuple[str, ...] = field(default=())


class Pipeline:
    """``order`` resolved against the options; ``apply`` turns reads into trimmed reads with reasons and counters."""

    def __init__(self, options: TrimOptions | None = None, paired: bool = True):
        self.options, self.paired = options or TrimOptions(), paired
        if paired and len(self.options.adapter1) != len(self.options.adapter2):
            raise ValueError("as many adapters for mate 2 as for mate 1 are needed")
        self.mates = (1, 2) if paired else (1,)
        names: list[str] = []
        for name in self.options.order:
            if name not in GROUPS and name not in DEFAULT_ORDER:
                raise ValueError(f"unknown step {name!r}; known: {', '.join([*GROUPS, *dict.fromkeys(DEFAULT_ORDER)])}")
            names += GROUPS.get(name, (name,))
        self.steps = [s for s in map(self._step, names) if s is not None]

    # ------------------------------------------------------------ steps

    def _step(self, name: str) -> Step | None:
        o = self.options
        if name == "CheckIdentifier":
            return Step(name, None, self._check_identifier) if o.check_identifier and self.paired else None
        if name in POLY:
            return self._poly(name[-1]) if getattr(o, "poly" + name[-1]) else None
        if name.startswith("HardClip"):
            return self._clip(name)
        make = {
            "LengthFilter": (o.length_filtration, self._length),
            "AdapterTrim": (o.adapter_trim, self._adapter),
            "QualityTrim": (o.quality_trim, self._quality),
            "TailNTrim": (o.tail_low_quality or o.tail_n_trim, self._tail),
            "MaxNFilter": (o.max_n > 0, self._max_n),
            "ComplexityFilter": (o.complexity_filtration, self._complexity),
            "PCRDedup": (o.pcr_dedup, lambda: Step("PCRDedup", None, self._pcr_dedup, ("pcr_dedup_removed_r1",))),
        }
        on, build = make[name]
        return build() if on else None

    def _check_identifier(self, df: DataFrame) -> DataFrame:
        message = F.concat(F.lit("identifiers differ: "), F.col("id1"), F.lit(" and "), F.col("id2"))
        ok = F.col("drop_reason").isNotNull() | exprs.same_identifier(F.col("id1"), F.col("id2"))
        return df.withColumn("drop_reason", F.when(ok, F.col("drop_reason")).otherwise(F.raise_error(message).cast("string")))

    def _poly(self, base: str) -> Step:
        o, counter = self.options, f"poly{base}"

        def kernel(b: Batch) -> None:
            for k, m in enumerate(b.mates):
                first, length = kernels.poly_tail(m, base, o.poly_mismatch_per_16mer, o.poly_length)
                found = b.live & (length >= o.poly_length)
                b.count(counter, k, found)
                b.keep(k, np.where(found, first - 1, m.n))

        return Step(f"Poly{base}", kernel, None, tuple(f"{counter}_r{m}" for m in self.mates))

    def _clip(self, name: str) -> Step | None:
        o, mate = self.options, int(name[-1])
        if mate not in self.mates:
            return None
        kind = name[8:-2]
        n = getattr(o, {"End": "clip3", "After": "clip_after", "Front": "clip5"}[kind] + f"_r{mate}")
        if n <= 0:
            return None
        k, counter = mate - 1, f"hard_clip_after_r{mate}"

        def kernel(b: Batch) -> None:
            m = b.mates[k]
            if kind == "End":
                b.keep(k, np.maximum(m.n - n, 0))
            elif kind == "After":
                b.count("hard_clip_after", k, b.keep(k, np.minimum(m.n, n)))
            else:
                m.drop_head(np.where(b.live, n, 0))

        def expr(df: DataFrame) -> DataFrame:
            s, q, live = F.col(f"seq{mate}"), F.col(f"qual{mate}"), F.col("drop_reason").isNull()
            if kind == "Front":
                new = {f"seq{mate}": exprs.drop_head(s, n), f"qual{mate}": exprs.drop_head(q, n)}
            else:
                keep = F.length(s) - n if kind == "End" else F.lit(n)
                new = {f"seq{mate}": exprs.keep_head(s, keep), f"qual{mate}": exprs.keep_head(q, keep)}
            out = {c: F.when(live, v).otherwise(F.col(c)) for c, v in new.items()}
            if kind == "After":
                out[counter] = F.col(counter) + (live & (F.length(s) > n)).cast("int")
            return df.withColumns(out)

        return Step(name, kernel, expr, (counter,) if kind == "After" else ())

    def _length(self) -> Step:
        low, high = self.options.lengths

        def kernel(b: Batch) -> None:
            bad = np.zeros(len(b.live), bool)
            for m in b.mates:
                bad |= (m.n < low) | (m.n > high)
            b.count("length_filtered", 0, b.drop(bad, "LengthFilter"))

        def expr(df: DataFrame) -> DataFrame:
            bad = ~_all(F.length(f"seq{m}").between(low, high) for m in self.mates)
            return self._dropped(df, bad, "LengthFilter", "length_filtered_r1")

        return Step("LengthFilter", kernel, expr, ("length_filtered_r1",))

    def _max_n(self) -> Step:
        most = self.options.max_n

        def kernel(b: Batch) -> None:
            bad = np.zeros(len(b.live), bool)
            for m in b.mates:
                bad |= kernels.count_n(m) > most
            b.count("max_n_filtered", 0, b.drop(bad, "MaxNFilter"))

        def expr(df: DataFrame) -> DataFrame:
            bad = ~_all(exprs.count_n(F.col(f"seq{m}")) <= most for m in self.mates)
            return self._dropped(df, bad, "MaxNFilter", "max_n_filtered_r1")

        return Step("MaxNFilter", kernel, expr, ("max_n_filtered_r1",))

    def _dropped(self, df: DataFrame, bad: Column, reason: str, counter: str) -> DataFrame:
        out = F.col("drop_reason").isNull() & bad
        return df.withColumns({"drop_reason": F.when(out, F.lit(reason)).otherwise(F.col("drop_reason")), counter: F.col(counter) + out.cast("int")})

    def _complexity(self) -> Step:
        least = self.options.min_complexity

        def kernel(b: Batch) -> None:
            for k, m in enumerate(b.mates):  # mate 1 first: a pair counts once
                b.count("complexity_filtered", k, b.drop(kernels.complexity(m) < least, "ComplexityFilter"))

        return Step("ComplexityFilter", kernel, None, tuple(f"complexity_filtered_r{m}" for m in self.mates))

    def _tail(self) -> Step:
        o = self.options
        counter = "tail_low_qual_trim" if o.tail_low_quality else "tail_N_trim"

        def kernel(b: Batch) -> None:
            for k, m in enumerate(b.mates):
                flag = m.qual <= o.offset + 1 if o.tail_low_quality else m.codes == 15
                b.count(counter, k, b.keep(k, kernels.tail_keep(flag, m.n)))

        def expr(df: DataFrame) -> DataFrame:
            live, out = F.col("drop_reason").isNull(), {}
            for m in self.mates:
                s, q = F.col(f"seq{m}"), F.col(f"qual{m}")
                keep = exprs.low_quality_keep(q, o.offset) if o.tail_low_quality else F.length(exprs.without_tail_n(s))
                out |= {f"seq{m}": F.when(live, exprs.keep_head(s, keep)).otherwise(s), f"qual{m}": F.when(live, exprs.keep_head(q, keep)).otherwise(q)}
                out[f"{counter}_r{m}"] = F.col(f"{counter}_r{m}") + (live & (keep < F.length(s))).cast("int")
            return df.withColumns(out)

        return Step("TailNTrim", kernel, expr, tuple(f"{counter}_r{m}" for m in self.mates))

    def _quality(self) -> Step:
        o = self.options

        def kernel(b: Batch) -> None:
            for k, m in enumerate(b.mates):
                b.count("quality_trim", k, b.keep(k, kernels.quality_keep(m.qual, m.n, o.quality_score, o.quality_kmer, o.offset)))

        return Step("QualityTrim", kernel, None, tuple(f"quality_trim_r{m}" for m in self.mates))

    def _adapter(self) -> Step:
        o = self.options

        def paired(b: Batch) -> None:
            trimmed = kernels.trim_pairs(*b.mates, b.live, list(zip(o.adapter1, o.adapter2, strict=True)), o.pair())
            b.count("adapter_trim", 0, trimmed)

        def single(b: Batch) -> None:
            m = b.mates[0]
            b.count("adapter_trim", 0, b.keep(0, kernels.adapter_keep(m, list(o.adapter1), o.kmer_tolerance, o.trim_score_se)))

        return Step("AdapterTrim", paired if self.paired else single, None, ("adapter_trim_r1",))

    def _pcr_dedup(self, df: DataFrame) -> DataFrame:
        df = materialize(df, "before-dedup")  # read twice: the kernels above must not run twice
        marked = dedup.mark(df, F.col("drop_reason").isNull())
        return self._dropped(marked, F.col("duplicate"), "PCRDedup", "pcr_dedup_removed_r1").drop("duplicate")

    # ------------------------------------------------------------ plan

    @property
    def counters(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.steps for c in s.counters))

    def stages(self) -> list[list[Step]]:
        """Neighbouring steps that run together; barriers and row checks that only Catalyst knows are alone."""
        out: list[list[Step]] = []
        for s in self.steps:
            if out and s.kernel is not None and out[-1][0].kernel is not None:
                out[-1].append(s)
            else:
                out.append([s])
        return out

    def apply(self, reads: DataFrame) -> DataFrame:
        """``reads`` (``seq1``, ``qual1``[, ``seq2``, ``qual2``], and ``idx`` for PCRDedup) with ``drop_reason`` and the counters."""
        df = reads if "drop_reason" in reads.columns else reads.withColumn("drop_reason", F.lit(None).cast("string"))
        df = df.withColumns({c: F.lit(0) for c in self.counters})
        for stage in self.stages():
            if all(s.expr is not None for s in stage):
                for s in stage:
                    df = s.expr(df)
            else:
                df = self._pass(df, stage)
        return df

    def _pass(self, df: DataFrame, stage: list[Step]) -> DataFrame:
        """All steps of a stage in one Arrow pass over whole batches."""
        names, paired, offset = df.columns, self.paired, self.options.offset
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        steps = [s.kernel for s in stage]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                col = dict(zip(names, rb.columns, strict=True))
                mates = [Mate.of(col[f"seq{m}"], col[f"qual{m}"], offset) for m in ((1, 2) if paired else (1,))]
                batch = Batch(mates, col["drop_reason"].to_pylist())
                for kernel in steps:
                    kernel(batch)
                for k, m in enumerate(batch.mates, 1):
                    col[f"seq{k}"], col[f"qual{k}"] = m.columns()
                col["drop_reason"] = pa.array(batch.reason.tolist(), pa.string())
                for name, n in batch.counts.items():
                    if name in col:
                        col[name] = pa.array(col[name].to_numpy(zero_copy_only=False) + n, pa.int32())
                yield pa.RecordBatch.from_arrays([col[n] for n in names], names=names)

        return df.mapInArrow(run, schema)

    def good(self, trimmed: DataFrame) -> DataFrame:
        """The reads that passed, with the columns they came with."""
        return trimmed.where(F.col("drop_reason").isNull()).drop("drop_reason", *self.counters)

    def report(self, trimmed: DataFrame) -> DataFrame:
        """One row (per sample if there are samples): totals and all counters of both mates.

        Pairs share the counters of whole-pair steps, so mate 2 repeats mate 1's. ``pcr_dedup_in_groups`` also counts the
        read of each group that stays.
        """
        has = set(self.counters)
        shared = {"length_filtered", "max_n_filtered", "adapter_trim", "pcr_dedup_removed"}
        figures = [F.count("*").alias("total"), F.sum(F.col("drop_reason").isNull().cast("int")).alias("good")]
        for m in self.mates:
            for c in COUNTERS:
                name = f"{c}_r{1 if c in shared else m}"
                figures.append((F.coalesce(F.sum(name), F.lit(0)) if name in has else F.lit(0)).cast("long").alias(f"{c}_r{m}"))
        by = ["sample"] if "sample" in trimmed.columns else []
        out = (trimmed.groupBy(*by) if by else trimmed).agg(*figures)
        return out.withColumn("good", F.coalesce("good", F.lit(0)))


def _all(tests: Iterable[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def explain(options: TrimOptions, paired: bool = True) -> list[str]:
    """How the chain is cut into stages, as text."""
    out = []
    for stage in Pipeline(options, paired).stages():
        kind = "shuffle" if stage[0].name == "PCRDedup" else "projection" if all(s.expr is not None for s in stage) else "arrow"
        out.append(f"{kind}: {', '.join(s.name for s in stage)}")
    return out


__all__ = ["COUNTERS", "DEFAULT_ORDER", "GROUPS", "Batch", "Pipeline", "Step", "explain"]
