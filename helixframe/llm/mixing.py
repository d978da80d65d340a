"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked to target marginals,
never above what a cell has; each document is then kept with its cell's
calibrated probability, decided by a hash of its id.  A value that has fewer
tokens than its target asks gives all it has, and the others share the rest by
their targets; what the raked weights still miss is reported.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.scratch import Scratch

#: Cells up to which raking runs in numpy on the driver (some 100 bytes each); more are raked as a table.
DRIVER_CELLS = 100_000
MARGINS = ("source", "lang", "topic")
SALT = 20240611
#: Raking turns at most, and the part of the budget by which a marginal may miss its target when raking ends.
TURNS, TABLE_TURNS, TOLERANCE = 5000, 60, 1e-9
#: A miss above this part of the budget is an infeasible set of targets, and is warned of.
WARN = 1e-3


def topic_of(text: Column) -> Column:
    """A coarse topic from the text itself; the first rule that holds decides."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(F.trim(t)) == 0, "empty")
        .when(F.lower(t).contains(" license"), "legal")
        .when(t.contains("@") | t.contains("://"), "contact")
        .when(F.length(t) >= 8000, "long")
        .when(F.length(t) < 600, "note")
        .otherwise("prose")
    )


def tempered(shares: dict, power: float) -> dict:
    """Targets that lift small groups: shares to a power, summing to one."""
    total = {k: v**power for k, v in shares.items() if v > 0}
    s = sum(total.values())
    return {k: v / s for k, v in total.items()}


def attainable(have: np.ndarray, target: np.ndarray, budget: float) -> np.ndarray:
    """Shares of ``budget`` nearest to the targets that no value is too small for: small values give all, the rest is shared out by targets."""
    target = np.where(have > 0, target, 0.0)
    full = np.zeros(len(have), bool)
    while budget > 0:
        left, rest = budget - have[full].sum(), target[~full].sum()
        want = np.where(full, have, target * (max(left, 0.0) / rest if rest > 0 else 0.0))
        more = ~full & (want > have)
        if not more.any():
            return want / budget
        full |= more
    return target


def residuals(w: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], budget: float) -> list[float]:
    """For each marginal the largest difference of a value's part of the budget from its target."""
    return [float(np.abs(np.bincount(of, w, len(t)) / budget - t).max(initial=0)) if budget > 0 else 0.0 for of, t in zip(groups, targets, strict=True)]


def rake(tokens: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], budget: float, turns: int = TURNS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights, at most ``tokens`` each, whose marginal sums approach ``budget * targets``.

    A turn scales each marginal's cells to its target and then caps cells at
    what they have; what a cap cuts off moves to the other cells in later turns.
    Turns end when every marginal is met to ``tolerance``, or nothing moves.
    """
    w = tokens * min(1.0, budget / max(tokens.sum(), 1e-300))
    for _ in range(turns):
        was = w.copy()
        for of, target in zip(groups, targets, strict=True):
            have = np.bincount(of, w, len(target))
            w = np.minimum(w * np.divide(budget * target, have, out=np.zeros(len(target)), where=have > 0)[of], tokens)
        if max(residuals(w, groups, targets, budget), default=0) <= tolerance or np.abs(w - was).max(initial=0) <= 1e-15 * budget:
            break
    return w


def attainable_table(have: DataFrame, budget: float, scratch: Scratch) -> DataFrame:
    """``attainable`` for a table (name, have, share) of any number of values: name, share."""
    rows = scratch.keep(have.withColumn("share", F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0)).withColumn("full", F.lit(False)), "targets")
    while budget > 0:
        r = rows.agg(F.sum(F.when(F.col("full"), F.col("have")).otherwise(0.0)).alias("given"), F.sum(F.when(~F.col("full"), F.col("share")).otherwise(0.0)).alias("rest")).first()
        scale = max(budget - (r["given"] or 0.0), 0.0) / r["rest"] if r["rest"] else 0.0
        want = F.when(F.col("full"), F.col("have")).otherwise(F.col("share") * scale)
        if not rows.where(~F.col("full") & (want > F.col("have"))).take(1):
            return rows.withColumn("share", want / budget).drop("full", "have")
        rows = scratch.keep(rows.withColumn("full", F.col("full") | (want > F.col("have"))), "targets")
    return rows.drop("full", "have")


def rake_table(cells: DataFrame, targets: dict[str, DataFrame], budget: float, scratch: Scratch, turns: int = TABLE_TURNS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """``rake`` for more cells than the driver should hold, one grouping and join per marginal: (cells with ``w``, residuals)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells.withColumn("w", F.col("tokens") * F.lit(min(1.0, budget / max(total, 1e-300))))
    left = [0.0] * len(targets)
    for _ in range(turns):
        for name, target in targets.items():
            have = w.groupBy(name).agg(F.sum("w").alias("__have")).join(target.withColumnRenamed("share", "__share"), name, "left")
            w = w.join(have, name).withColumn("w", F.least("tokens", F.col("w") * F.when(F.col("__have") > 0, F.coalesce("__share", F.lit(0.0)) * budget / F.col("__have")).otherwise(0.0))).drop("__have", "__share")
        w = scratch.keep(w, "rake")
        left = [w.groupBy(n).agg(F.sum("w").alias("have")).join(t, n).agg(F.max(F.abs(F.col("have") / budget - F.col("share")))).first()[0] or 0.0 for n, t in targets.items()] if budget > 0 else left
        if max(left) <= tolerance:
            break
    return w, left


@dataclass
class Calibration:
    """``odds`` (__source, __lang, __topic, probability), the tokens asked for, and the misses of each marginal.

    ``residuals`` are against what is attainable, ``adjusted`` says by how much
    the targets themselves had to give way.
    """

    odds: DataFrame
    budget: float
    residuals: dict[str, float]
    adjusted: dict[str, float]


def calibrate(spark: SparkSession, facts: DataFrame, targets: dict[str, dict] | None = None, power: float = 0.8, fraction: float = 0.9, driver_cells: int = DRIVER_CELLS) -> Calibration:
    """Sampling probabilities of cells from ``facts`` (__source, __lang, __topic, n_tokens)."""
    scratch = Scratch(spark, "mixing")
    names = [f"__{c}" for c in MARGINS]
    cells = scratch.keep(facts.groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    budget = fraction * total
    given = targets or {}
    if cells.count() <= driver_cells:
        rows = cells.orderBy(*names).collect()  # bounded by driver_cells
        tokens = np.array([r["tokens"] for r in rows], float)
        groups, shares, adjusted = [], [], {}
        for c, n in zip(MARGINS, names, strict=True):
            values, of = np.unique(np.array([r[n] for r in rows], object), return_inverse=True) if rows else (np.array([]), np.array([], int))
            have = np.bincount(of, tokens, len(values))
            want = given[c] if c in given else tempered(dict(zip(values, have, strict=True)), power)
            asked = np.array([want.get(v, 0.0) for v in values], float)
            groups.append(of)
            shares.append(attainable(have, asked, budget))
            adjusted[c] = float(np.abs(shares[-1] - asked).max(initial=0))
        w = rake(tokens, groups, shares, budget)
        left = residuals(w, groups, shares, budget)
        p = np.divide(w, tokens, out=np.ones(len(w)), where=tokens > 0)
        schema = ", ".join(f"{n} string" for n in names) + ", probability double"
        odds = F.broadcast(spark.createDataFrame([(*(r[n] for n in names), float(x)) for r, x in zip(rows, p, strict=True)], schema))
    else:
        want, adjusted = {}, {}
        for c, n in zip(MARGINS, names, strict=True):
            have = cells.groupBy(n).agg(F.sum("tokens").alias("have"))
            if c in given:
                asked = have.join(spark.createDataFrame(list(given[c].items()), f"{n} string, share double"), n, "left")
            else:
                lifted = have.withColumn("share", F.when(F.col("have") > 0, F.pow("have", F.lit(power))).otherwise(0.0))
                asked = lifted.withColumn("share", F.col("share") / F.lit(lifted.agg(F.sum("share")).first()[0] or 1.0))
            want[n] = attainable_table(asked, budget, scratch)
            adjusted[c] = want[n].join(asked.select(n, F.col("share").alias("asked")), n).agg(F.max(F.abs(F.col("share") - F.coalesce("asked", F.lit(0.0))))).first()[0] or 0.0
        w, left = rake_table(cells, want, budget, scratch)
        odds = w.select(*names, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("probability"))
    misses = dict(zip(MARGINS, left, strict=True))
    if max(left, default=0) > WARN:
        warnings.warn(f"targets can't be met together: parts of the budget by which marginals miss {misses}", stacklevel=2)
    return Calibration(odds, budget, misses, adjusted)


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, dict] | None = None, power: float = 0.8, fraction: float = 0.9, driver_cells: int = DRIVER_CELLS, topic: Column | None = None) -> DataFrame:
    """Every document with its ``topic``, ``n_tokens``, ``probability`` and ``selected``.

    ``targets`` maps any of source, lang and topic to shares by value; the
    shares of a missing marginal are the corpus's own to the power ``power``.
    The sample's expected tokens are ``fraction`` of the corpus's; a value with
    fewer tokens than its target asks is kept whole.  ``topic`` says what topic
    a row has (``topic_of`` its text if not given).  A null source, language or
    text is a value of its own (the empty string); documents without tokens have
    probability 1 where their cell has no tokens; repeated rows share one
    decision; a null doc_id is decided like any id.  An empty table gives no rows.
    """
    topic = topic_of(F.col("text")) if topic is None else topic
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MARGINS[:2]] + [topic.alias("topic")]
    names = [f"__{c}" for c in MARGINS]
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability", "selected")]
    facts = docs.select(*[k.alias(n) for k, n in zip(key, names, strict=True)], count.alias("n_tokens"))
    odds = calibrate(spark, facts, targets, power, fraction, driver_cells).odds
    lot = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SALT)), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("lot")
    out = docs.select(*own, *[k.alias(n) for k, n in zip(key, names, strict=True)], count.alias("n_tokens")).join(odds, names)
    return out.select(*own, F.col("__topic").alias("topic"), "n_tokens", "probability", (lot < F.col("probability")).alias("selected"))
