"""Near-duplicate vectors: a small-world graph per shard, and every shard queried.

Vectors of one label and length are split into shards of bounded size, equal
vectors standing once.  A task searches one shard's graph with the vectors of
another (or its own).  The beam of a query widens while it is filled with links,
and the beam of a task until an audit against brute force passes.  Pairs are
confirmed by the cosine in double precision; a task returns counts and a
spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.components import components, label_min
from helixframe.llm.hnsw import STEP, Graph
from helixframe.llm.scratch import Scratch

#: Vectors of a shard, about.
SHARD_ROWS = 2048
#: Queries of a task that are audited, and the share of true links that must be found.
AUDIT, RECALL = 128, 0.999
#: Single-precision scores this far below the threshold are confirmed in double precision.
SLACK = 1e-4


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column, dtype=np.float64) -> np.ndarray:
    """A column of equally long lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked_pairs(graph: Graph, u: np.ndarray, v: np.ndarray, threshold: float, ef: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(row of u, row of v) with cosine >= threshold, searched in the graph over the unit vectors ``v``."""
    single = u.astype(np.float32)
    low = threshold - SLACK
    audit = np.unique(np.linspace(0, len(u) - 1, min(AUDIT, len(u))).astype(int))
    truth = (u[audit] @ v.T >= threshold).sum()
    while True:
        a, b = _search(graph, single, v, low, ef)
        good = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 16):
            good[i : i + (1 << 16)] = np.einsum("nd,nd->n", u[a[i : i + (1 << 16)]], v[b[i : i + (1 << 16)]]) >= threshold
        a, b = a[good], b[good]
        if np.isin(a, audit).sum() >= RECALL * truth or ef >= len(v):
            return a, b
        ef *= 2


def _search(graph: Graph, q: np.ndarray, v: np.ndarray, low: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
    left, rows, found = np.arange(len(q)), [], []
    v32 = None
    while len(left):
        if ef * 4 >= len(v):  # a beam as wide as the shard: all of it is looked at
            v32 = v.astype(np.float32)
            for i in range(0, len(left), STEP):
                r, c = np.nonzero(q[left[i : i + STEP]] @ v32.T >= low)
                rows.append(left[i + r])
                found.append(c)
            break
        ids, score = graph.search(q[left], ef)
        # on unit vectors the score is the cosine less a half
        hit = (ids >= 0) & (score + 0.5 >= low)
        full = hit.sum(1) * 2 > ef
        r, c = np.nonzero(hit & ~full[:, None])
        rows.append(left[r])
        found.append(ids[r, c])
        left = left[full]
        ef *= 4
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, int), np.zeros(0, int))


SHARD = "label string, dim int, shard int, shards int, ids binary, copies binary, vectors binary, graph binary"


def _build(key, table):
    table = table.sort_by("id")
    x = unit(matrix(table.column("embedding")))
    graph = Graph(x)
    label, dim, shard, shards = (k.as_py() for k in key)
    row = [label, dim, shard, shards, table.column("id").to_numpy().tobytes(), table.column("copies").to_numpy().tobytes(), x.tobytes(), graph.to_bytes()]
    return pa.table({f.split()[0]: [v] for f, v in zip(SHARD.split(", "), row, strict=True)}, schema=_SHARD_ARROW)


_SHARD_ARROW = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int32()), ("shards", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("graph", pa.binary())])


def _pairer(threshold: float):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids_u, ids_v = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["o_ids"], np.int64)
                n_u, n_v = np.frombuffer(r["copies"], np.int64), np.frombuffer(r["o_copies"], np.int64)
                u = np.frombuffer(r["vectors"], np.float64).reshape(len(ids_u), -1)
                v = np.frombuffer(r["o_vectors"], np.float64).reshape(len(ids_v), -1)
                a, b = linked_pairs(Graph.from_bytes(r["o_graph"], v), u, v, threshold)
                if r["shard"] == r["o_shard"]:
                    key = np.unique(np.minimum(a, b) * len(v) + np.maximum(a, b))
                    a, b = key // len(v), key % len(v)
                    a, b = a[a != b], b[a != b]
                if not len(a):
                    continue
                links = np.concatenate([np.bincount(a, n_v[b], len(u)), np.bincount(b, n_u[a], len(v))]).astype(np.int64)
                ids = np.concatenate([ids_u, ids_v])
                some = links > 0
                every, low = label_min(ids_u[a], ids_v[b])
                low = low[np.searchsorted(every, ids[some])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(low)], ["id", "links", "low"])

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to vec_id, n_links, component_id, kept.

    Only vectors of one label link.  A vector without a label, or that is null,
    zero or holds a null or non-finite component, links with nothing and is its
    own component.  Vectors of different lengths don't link.  Each row counts as
    a vector, so repeated rows link with each other, and rows that repeat an id
    with another vector or label are vectors of their own, in components of their
    own; a null vec_id links with nothing and has a null component.  Other columns are ignored.  An empty
    table gives no rows.
    """
    scratch = Scratch(spark, "vectors")
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v)
    rows = rows.withColumn("ok", usable(v) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    keys = {"dim": F.size(v), "k1": F.xxhash64(v), "k2": F.xxhash64(F.lit(7), v)}
    own = ["label", *keys]
    good = rows.where("ok").drop("ok").withColumns(keys)
    distinct = scratch.keep(good.groupBy(*own).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "distinct")
    repeated = bool(distinct.groupBy("id").count().where("count > 1").take(1))
    if repeated:
        # a number for each vector that rises with the ids; written once, as it isn't the same when worked out again
        order = distinct.orderBy("id", *own).withColumnRenamed("id", "vec_id").withColumn("id", F.monotonically_increasing_id())
        distinct = scratch.keep(order, "numbered")
    shards = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    placed = distinct.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    built = placed.select("label", "dim", "shard", "shards", "id", "copies", "embedding").groupBy("label", "dim", "shard", "shards").applyInArrow(_build, SHARD)
    built = scratch.keep(built, "graphs")
    # each pair of shards of a label meets once: the smaller one asks
    asks = built.drop("graph").withColumn("o_shard", F.explode(F.sequence("shard", F.col("shards") - 1)))
    other = built.select("label", "dim", F.col("shard").alias("o_shard"), *[F.col(c).alias(f"o_{c}") for c in ("ids", "copies", "vectors", "graph")])
    tasks = asks.join(other.hint("shuffle_hash"), ["label", "dim", "o_shard"]).drop("label", "dim", "shards")
    names = ["ids", "copies", "vectors", "shard", "o_shard", "o_ids", "o_copies", "o_vectors", "o_graph"]
    found = scratch.keep(tasks.select(*names).mapInArrow(_pairer(threshold), "id long, links long, low long"), "found")
    scratch.drop(built)
    groups = components(spark, found.select("id", "low"), scratch)
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = distinct.select(*own, "id", "copies").join(total, "id", "left").join(groups, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    if repeated:
        known = known.join(distinct.select(F.col("id").alias("component_id"), F.col("vec_id").alias("__least")), "component_id").withColumn("component_id", F.col("__least")).drop("__least")
    out = good.select("vec_id", *own).join(known, own).select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id",
    )
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
