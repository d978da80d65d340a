"""Parts of a base budget: a running sum that restarts, worked out as a parallel scan.

A range of reads turns the sum it is entered with into the sum it is left with,
and ends some parts.  That map is a step function: what is entered with decides
only at which read the first part ends, and a range that ends no part adds its
bases.  Step functions are composed pairwise in rounds, up to one of the whole
table; then each range learns in as many rounds back what it is entered with.
No read and no range goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.plans.store import Store

#: Reads of a range, about.
RANGE = 1 << 18
STEPS = "block long, lo long, hi long, adds boolean, value long, parts long"


def _merged(lo, hi, adds, value, parts) -> dict[str, np.ndarray]:
    """Steps in order of ``lo``; neighbours that say the same are one."""
    new = np.ones(len(lo), bool)
    new[1:] = (adds[1:] != adds[:-1]) | (value[1:] != value[:-1]) | (parts[1:] != parts[:-1])
    at = np.flatnonzero(new)
    return {"lo": lo[at], "hi": hi[np.append(at[1:] - 1, len(lo) - 1)] if len(lo) else hi, "adds": adds[at], "value": value[at], "parts": parts[at]}


def range_steps(n: np.ndarray, bases: int) -> dict[str, np.ndarray]:
    """The step function of reads of these lengths: for sums in lo..hi-1, the sum after them (or what they add) and the parts they end."""
    total = np.concatenate([[0], np.cumsum(n)])
    m = len(n)
    # a part that begins at read i ends with the first read by which it has the budget
    end = np.searchsorted(total[1:], total[:-1] + bases, "left")
    carry, parts = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(m - 1, -1, -1):
        if end[i] >= m:
            carry[i] = total[m] - total[i]
        else:
            carry[i], parts[i] = carry[end[i] + 1], parts[end[i] + 1] + 1
    # entered with s, the first part ends at the first read whose running total reaches bases - s
    first = np.flatnonzero((total[1:] > total[:-1]) & (total[:-1] < bases))[::-1]
    lo, hi = np.maximum(bases - total[first + 1], 0), bases - total[first]
    adds, value, ended = np.zeros(len(first), bool), carry[first + 1], parts[first + 1] + 1
    if total[m] < bases:
        lo, hi = np.insert(lo, 0, 0), np.insert(hi, 0, bases - total[m])
        adds, value, ended = np.insert(adds, 0, True), np.insert(value, 0, total[m]), np.insert(ended, 0, 0)
    return _merged(lo, hi, adds, value, ended)


def composed(f: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``g`` after ``f``."""
    # the sums with which a step of f may enter g
    low = np.where(f["adds"], f["lo"] + f["value"], f["value"])
    high = np.where(f["adds"], f["hi"] + f["value"], f["value"] + 1)
    a, b = np.searchsorted(g["hi"], low, "right"), np.searchsorted(g["lo"], high, "left")
    n = b - a
    i = np.repeat(np.arange(len(n)), n)
    j = np.repeat(a, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    moves = f["adds"][i]
    lo = np.where(moves, np.maximum(f["lo"][i], g["lo"][j] - f["value"][i]), f["lo"][i])
    hi = np.where(moves, np.minimum(f["hi"][i], g["hi"][j] - f["value"][i]), f["hi"][i])
    value = np.where(g["adds"][j], f["value"][i] + g["value"][j], g["value"][j])
    return _merged(lo, hi, moves & g["adds"][j], value, f["parts"][i] + g["parts"][j])


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    pdf = pdf.sort_values("lo")
    return {c: pdf[c].to_numpy() for c in ("lo", "hi", "adds", "value", "parts")}


def split_by_budget(reads: DataFrame, bases: int, key: str = "read_id", per_range: int = RANGE) -> DataFrame:
    """``part`` from 0: reads in the order of an integer key, a new part once the running one has ``bases`` or more.

    Keys are unique; a null sequence counts as empty.
    """
    if bases < 1:
        raise ValueError("bases must be positive")
    spark, store = reads.sparkSession, Store(reads.sparkSession, "budget")
    found = reads.agg(F.count("*").alias("n"), F.min(key).alias("least"), (F.max(key) - F.min(key) + 1).alias("ids")).first()
    if not found["n"]:
        return reads.withColumn("part", F.lit(None).cast("long"))
    width = max(1, per_range * found["ids"] // found["n"])
    # ranges of keys that hold no read are no ranges: the others are numbered, from a row each
    rows = reads.select(F.expr(f"({key} - {found['least']}) div {width}").alias("bin"), F.col(key).cast("long").alias("id"), F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("n"))
    rows = store.keep(rows, "lengths")

    def steps(key_, pdf):
        return pd.DataFrame({"block": int(key_[0]), **range_steps(pdf.sort_values("id").n.to_numpy(), bases)})

    levels = [store.keep(rows.groupBy("bin").applyInPandas(steps, STEPS), "steps")]
    blocks = found["ids"] // width + 1

    def pair(key_, pdf):
        left, right = pdf[pdf.block % 2 == 0], pdf[pdf.block % 2 == 1]
        if not len(left) or not len(right):
            only = left if len(left) else right
            return pd.DataFrame({"block": int(key_[0]), **_columns(only)})
        return pd.DataFrame({"block": int(key_[0]), **composed(_columns(left), _columns(right))})

    while blocks > 1:
        levels.append(store.keep(levels[-1].groupBy(F.expr("block div 2").alias("pair")).applyInPandas(pair, STEPS), "composed"))
        blocks = (blocks + 1) // 2
    entered = spark.createDataFrame([(0, 0, 0)], "block long, state long, part long")
    for level in reversed(levels[:-1]):
        # what a pair is entered with enters its first range, and through that its second
        first = entered.select((F.col("block") * 2).alias("block"), "state", "part")
        met = first.join(level, "block").where("state >= lo and state < hi")
        through = met.select("block", F.when(F.col("adds"), F.col("state") + F.col("value")).otherwise(F.col("value")).alias("out"), (F.col("part") + F.col("parts")).alias("ended"))
        known = first.join(through, "block", "left")
        second = known.select((F.col("block") + 1).alias("block"), F.coalesce("out", "state").alias("state"), F.coalesce("ended", "part").alias("part"))
        held = level.select("block").distinct()
        entered = store.keep(first.unionByName(second).join(held, "block", "left_semi"), "entered")

    def number(key_, left, right):
        left = left.sort_values("id")
        state, part = int(right.state.iloc[0]), int(right.part.iloc[0])
        total = np.concatenate([[0], np.cumsum(left.n.to_numpy())])
        out, at = np.empty(len(left), np.int64), 0
        while at < len(left):
            end = int(np.searchsorted(total[1:], total[at] + bases - state, "left"))
            end = max(end, at)
            out[at : end + 1] = part
            at, state, part = end + 1, 0, part + 1
        return pd.DataFrame({key: left.id.to_numpy(), "part": out})

    placed = rows.groupBy("bin").cogroup(entered.groupBy("block")).applyInPandas(number, f"{key} long, part long")
    return reads.join(placed, key)
