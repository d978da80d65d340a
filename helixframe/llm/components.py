"""Connected components of link tables that no single machine could hold.

Each task first shrinks its links to a spanning forest (union-find over bounded
blocks).  Alternating large-star and small-star rounds then join what is left;
every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.scratch import Scratch

#: Links that a task holds at once.
FOREST_BLOCK = 1_000_000


def runs(batches, most: int):
    """Whole runs of equal first columns from a sorted partition, about ``most`` rows or one run at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out(table, last):
        key = table.column(0).to_numpy()
        cut = len(key) if last else int(np.searchsorted(key, key[-1], "left"))
        return table.slice(0, cut), table.slice(cut)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                done, rest = out(pa.Table.from_batches(held), False)
                if done.num_rows:
                    yield done
                held, size = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def label_min(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex it reaches) for links a-b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            return ids, ids[root]
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _forest(batches):
    """Links a > b in, an equivalent star forest out, with bounded memory."""
    held_a, held_b, size = [], [], 0

    def out():
        ids, low = label_min(np.concatenate(held_a), np.concatenate(held_b))
        keep = ids != low
        return ids[keep], low[keep]

    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        held_a.append(a)
        held_b.append(b)
        size += len(a)
        if size >= FOREST_BLOCK:
            a, b = out()
            held_a, held_b, size = [a], [b], len(a)
            if size > FOREST_BLOCK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held_a, held_b, size = [], [], 0
    if held_a:
        a, b = out()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` has two bigint columns, in any order and with repeats.

    Returns ``(id, component_id)`` for each id that has a link to another id;
    ``component_id`` is the smallest id that can be reached, itself included.
    Null ends and loops are ignored.  No link, no row.
    """
    x, y = links.columns[:2]
    e = (
        links.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y)))
        .select(F.greatest(x, y).cast("long").alias("a"), F.least(x, y).cast("long").alias("b"))
        .mapInArrow(_forest, "a long, b long")
    )
    e = scratch.keep(e, "forest")
    if e.count() < FOREST_BLOCK:
        # one bounded block: a single task finishes it
        e = scratch.keep(e.coalesce(1).mapInArrow(_forest, "a long, b long"), "stars")
        return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(e.select("b", "b").distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    was = mark(e)
    while was[0]:
        new = scratch.keep(_small(_large(e)), "stars")
        now = mark(new)
        scratch.drop(e)
        e = new
        if now == was:
            break
        was = now
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return stars.union(e.select("b", "b").distinct())
