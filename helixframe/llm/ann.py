"""Nearest neighbours by balanced posting lists.

Centroids are fitted to a bounded sample and held in a small-world graph.
Every vector goes to its nearest centroid's list and, when it lies near a
boundary, to a few more lists.  Lists that outgrow their bound are clustered
again into lists of their own, level after level, so their number grows with
the vectors.  A query opens its nearest lists until they are home to enough
vectors, and those whose centroid is within a distance ratio of the last of
these; within a list that was clustered again it chooses alike.  The ratios come
from an audit of queries, crowded and lonely ones, against brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.components import runs as _runs
from helixframe.llm.hnsw import Graph
from helixframe.llm.scratch import Scratch
from helixframe.llm.vectors import matrix, usable

#: Rows that fit the first level's centroids, at most about, and first-level centroids at most: both go to every executor.
SAMPLE_ROWS, MOST_CENTROIDS = 16_384, 2048
#: Vectors a centroid stands for, and rows from which a list is clustered again.
PER_LIST, SPLIT_ROWS = 128, 512
#: Sampled rows that fit the centroids of one list, and centroids of one list at most; larger lists get further levels.
FIT_ROWS, MOST_CHILDREN, LEVELS = 8192, 512, 5
#: Rows of a list that one run of a task holds.
RUN_ROWS = 16_384
#: Copies of a boundary vector, and how much farther their centroids may be.
COPIES, BOUNDARY = 3, 1.08
AUDIT, RECALL, SPARE = 64, 0.97, 1.03
#: Lists whose numbers are broadcast at most; more are joined by a shuffle.
BROADCAST_LISTS = 100_000


def fit_centroids(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Lloyd's algorithm whose oversized clusters give a member to an empty one; the same rows give the same centroids."""
    x = x[np.lexsort(x.T[::-1])].astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    c += np.random.default_rng(3).normal(0, 1e-6, c.shape) * np.abs(x).mean()
    for _ in range(turns):
        of = np.concatenate([(x[i : i + 4096] @ c.T - (c * c).sum(1) / 2).argmax(1) for i in range(0, len(x), 4096)])
        size = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        empty, large = np.flatnonzero(size == 0), np.argsort(-size)
        for e, big in zip(empty, large, strict=False):
            members = np.flatnonzero(of == big)
            c[e] = x[members[len(members) // 2]] + 1e-6
    return c


class Lists:
    """The centroids' graph and the two selections from it."""

    def __init__(self, centroids: np.ndarray):
        self.graph = Graph(centroids.astype(np.float32), m=16, ef=96)
        self.centroids = centroids

    def near(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances), nearest first; distance inf where the graph found fewer."""
        most = min(most, len(self.centroids))
        out, dist = [], []
        for i in range(0, len(x), 1024):
            ids, _ = self.graph.search(x[i : i + 1024], min(len(self.centroids), 2 * most + 16))
            d = np.sqrt(((x[i : i + 1024, None, :] - self.centroids[ids]) ** 2).sum(2))
            d[ids < 0] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :most]
            out.append(np.take_along_axis(ids, order, 1))
            dist.append(np.take_along_axis(d, order, 1))
        return np.concatenate(out), np.concatenate(dist)


def _all_near(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of a few centroids, nearest first, with their distances."""
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0))
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.take_along_axis(d, order, 1)


def _reach(ids: np.ndarray, d: np.ndarray, homes: np.ndarray, enough: int) -> np.ndarray:
    """Distance, as a column, of the list with which the nearest lists are home to ``enough`` vectors; else of the last one."""
    held = np.cumsum(np.where(np.isfinite(d), homes[ids], 0), axis=1)
    last = np.maximum(np.isfinite(d).sum(1) - 1, 0)
    return np.take_along_axis(d, np.minimum((held < enough).sum(1), last)[:, None], 1)


def _within(ids: np.ndarray, d: np.ndarray, ratio: float, homes: np.ndarray | None, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the lists that are opened: within ``ratio`` of the nearest, or of ``_reach`` where sizes are given."""
    reach = d[:, :1] if homes is None else _reach(ids, d, homes, enough)
    limit = reach * max(ratio, 1.0) if np.isfinite(ratio) else np.inf
    return np.nonzero((d <= limit) & np.isfinite(d))


OPENED = "list long, id long, embedding array<double>, home boolean"


def _exploder(shared, most: int, ratio: float, homes: np.ndarray | None = None, enough: int = 0):
    """(list, id, vector, whether it is the nearest) for each first-level list that a vector opens."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, d = shared.value.near(matrix(batch.column(1)), most)
            row, col = _within(ids, d, ratio, homes, enough)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(col == 0)], ["list", "id", "embedding", "home"])

    return run


def _nearest(q, ids, x, k):
    """(row of q, id, distance) of the k nearest rows of a block for each query."""
    out = []
    for i in range(0, len(q), 256):
        a = q[i : i + 256]
        about = (x * x).sum(1)[None, :] - 2 * a @ x.T
        # ties and rounding: a few more than k are measured exactly
        m = min(len(x), 2 * k + 8)
        cut = np.partition(about, m - 1, axis=1)[:, m - 1 : m]
        r, c = np.nonzero(about <= cut)
        d = np.sqrt(((a[r] - x[c]) ** 2).sum(1))
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.searchsorted(r, r)
        best = np.arange(len(r)) - first < k
        out.append((i + r[best], ids[c[best]], d[best]))
    return [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


HITS = "query_id long, vec_id long, score double"


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries`` (both vec_id, embedding).

    Returns query_id, rank from 1, vec_id and score, the Euclidean distance in
    double precision; ties go to the smaller vec_id; rows whose vec_id is the
    query's are left out.  Null, zero and non-finite vectors and null ids take
    no part; lengths are searched apart.  Fewer candidates than ``k`` give all of
    them.  Repeated rows count once; an id that repeats with other vectors has its
    nearest one's score, and then fewer than ``k`` ids may be left.  Other columns
    are ignored; no query, no row.
    """
    pick = lambda d: d.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dims = sorted(r[0] for r in pick(queries).select(F.size("embedding")).distinct().collect())
    parts = [_search(spark, pick(vectors).where(F.size("embedding") == d), pick(queries).where(F.size("embedding") == d), k, d) for d in dims]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """Of equal vectors the ``most`` smallest ids: no other one can be among so many nearest, as ties go to smaller ids.

    The limit holds within each task before the rows are shuffled, so a vector
    that a third of all rows hold is a few rows a task.
    """
    keyed = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(5), "embedding")}).dropDuplicates(["h1", "h2", "id"])
    w = Window.partitionBy("h1", "h2").orderBy("id")
    return keyed.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def _search(spark: SparkSession, every: DataFrame, asking: DataFrame, k: int, dim: int) -> DataFrame:
    scratch = Scratch(spark, "ann")
    base = scratch.keep(_copies(every, k + 2).select("id", "embedding"), "base")
    # equal queries are asked once, under the smallest id, and each takes its own id out of the answer
    keyed = asking.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(5), "embedding")})
    keyed = scratch.keep(keyed, "asking")
    queries = scratch.keep(_copies(keyed.drop("h1", "h2"), 1), "queries")
    hits = _hits(spark, scratch, base, queries.select("id", "embedding"), k, dim)
    own = keyed.select("h1", "h2", F.col("id").alias("own")).distinct().join(queries.select("h1", "h2", "id"), ["h1", "h2"])
    rows = own.join(hits.withColumnRenamed("query_id", "id"), "id").where("vec_id <> own")
    # an id with several vectors counts with its nearest, and as a query with the nearest of any of its vectors
    return _ranked(rows.groupBy(F.col("own").alias("query_id"), "vec_id").agg(F.min("score").alias("score")), k)


def _hits(spark: SparkSession, scratch: Scratch, base: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """The k + 1 nearest rows of each query, its own row included."""
    n = base.count()
    lot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = base.where(lot < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 30)))
    sample = matrix(chosen.select("embedding").toArrow().column(0)).reshape(-1, dim)
    lists = max(1, min(MOST_CENTROIDS, n // PER_LIST, len(sample)))
    centroids = fit_centroids(sample, lists) if len(sample) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(Lists(centroids))

    first = scratch.keep(base.mapInArrow(_exploder(shared, COPIES, BOUNDARY), OPENED), "postings")
    homes = np.zeros(len(centroids), np.int64)
    for r in first.where("home").groupBy("list").count().collect():  # one row a first-level centroid
        homes[r["list"]] = r["count"]
    levels, posted = [], first
    while len(levels) < LEVELS and (deeper := _split(scratch, posted)) is not None:
        levels.append(deeper[0])
        posted = deeper[1]

    enough = k + 2
    audited = _audited(scratch, queries, shared)
    truth = scratch.keep(_truth(base, audited, k + 1), "truth")
    recall = RECALL ** (1 / (1 + len(levels)))
    ratio, most = _first_ratio(truth, first, audited, shared, enough, homes, recall)
    asked = queries.mapInArrow(_exploder(shared, most, ratio, homes, enough), OPENED)
    trial = spark.createDataFrame([(r["id"], r["embedding"]) for r in audited], "id long, embedding array<double>") if audited else queries.limit(0)
    trial = trial.mapInArrow(_exploder(shared, most, ratio, homes, enough), OPENED)
    for deeper in levels:
        ratio = _deeper_ratio(scratch, truth, posted, trial, deeper, recall)
        trial = scratch.keep(_descend(trial, deeper, ratio, enough), "trial")
        asked = _descend(asked, deeper, ratio, enough)
    hits = scratch.keep(_meet(scratch, posted, scratch.keep(asked, "asked"), k + 1), "hits")

    full = hits.groupBy("query_id").count().where(F.col("count") >= min(k + 1, n)).select(F.col("query_id").alias("id"))
    short = scratch.keep(queries.join(full, "id", "left_anti").select("id", "embedding"), "short")
    if not short.take(1):
        return hits
    # a query that the graph led nowhere is held against all rows, in blocks
    every = posted.select("list").distinct()
    more = _meet(scratch, posted, scratch.keep(short.crossJoin(every).select("list", "id", "embedding"), "everywhere"), k + 1)
    return hits.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(*hits.columns).unionByName(more)


def _small(table: DataFrame) -> DataFrame:
    """A written table of one row a list, to be broadcast if a count of its rows allows it."""
    return F.broadcast(table) if table.count() <= BROADCAST_LISTS else table


#: Lists that were clustered again: their centroids, and how many rows of the list each is home to.
CHILDREN = "list long, centroids binary, homes binary"


def _split(scratch: Scratch, posted: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(centroids of lists above SPLIT_ROWS, postings with their rows dealt out anew); None if there is no such list."""
    big = scratch.keep(posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS), "big")
    if not big.take(1):
        return None
    rows = posted.join(_small(big), "list")
    lot = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    sample = rows.where(lot < F.least(F.lit(1.0), F.lit(float(FIT_ROWS)) / F.col("n")) * (1 << 30)).select("list", "n", "embedding")

    def fit(key, table):
        x = matrix(table.column("embedding"))
        k = max(2, min(MOST_CHILDREN, int(-(-key[1].as_py() // (SPLIT_ROWS // 3))), len(x) // 4))
        c = fit_centroids(x, k)
        return pa.table({"list": [key[0].as_py()], "centroids": [c.astype("<f8").tobytes()]}, schema=pa.schema([("list", pa.int64()), ("centroids", pa.binary())]))

    fitted = scratch.keep(sample.groupBy("list", "n").applyInArrow(fit, "list long, centroids binary"), "fitted")
    dealt = scratch.keep(_with_centroids(rows.select("list", "id", "embedding"), fitted.withColumn("homes", F.lit(None).cast("binary")), _dealer()), "dealt")

    def count(key, table):
        of, n = table.column("child").to_numpy(), table.column("n").to_numpy()
        c = np.zeros(MOST_CHILDREN, np.int64)
        c[of] = n
        return pa.table({"list": [key[0].as_py()], "homes": [c.tobytes()]}, schema=pa.schema([("list", pa.int64()), ("homes", pa.binary())]))

    homes = dealt.where("home").groupBy(F.shiftright("list", 12).alias("parent"), (F.col("list") % 4096).cast("int").alias("child")).agg(F.count("*").alias("n"))
    homes = homes.select((F.col("parent") - 1).alias("list"), "child", "n").groupBy("list").applyInArrow(count, "list long, homes binary")
    children = scratch.keep(fitted.join(homes, "list").select("list", "centroids", "homes"), "children")
    whole = posted.join(_small(big).select("list"), "list", "left_anti").select("list", "id", "embedding", "home")
    return children, scratch.keep(whole.unionByName(dealt), "postings")


def child_list(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Number of a list of the next level; numbers of different levels never meet, as a list has below 4096 children."""
    return (parent + 1) * 4096 + child


def _with_centroids(rows: DataFrame, children: DataFrame, run) -> DataFrame:
    """``rows`` (list, id, embedding) of each list meet the list's centroids once a run; large lists are salted over several runs."""
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / RUN_ROWS).cast("int").alias("parts"))
    some = rows.join(parts.join(children.select("list"), "list", "left_semi"), "list").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    none = F.lit(None).cast("binary")
    some = some.select(F.xxhash64("list", "salt").alias("key"), F.lit(1).alias("kind"), "list", "id", "embedding", none.alias("centroids"), none.alias("homes"))
    heads = children.join(parts, "list").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    heads = heads.select(F.xxhash64("list", "salt").alias("key"), F.lit(0).alias("kind"), "list", F.lit(0).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("embedding"), "centroids", "homes")
    return heads.unionByName(some).repartition("key").sortWithinPartitions("key", "list", "kind").mapInArrow(run, OPENED)


def _lists_of(batches):
    """(list, ids, embeddings, vectors, centroids, homes) of each list in a sorted partition."""
    for table in _runs(batches, RUN_ROWS):
        key, kind, lists = (table.column(i).to_numpy() for i in range(3))
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lists[1:] != lists[:-1])]))
        for a, b in zip(first.tolist(), np.append(first[1:], len(lists)).tolist(), strict=True):
            if b - a < 2 or kind[a]:
                continue
            own = table.slice(a + 1, b - a - 1)
            x = matrix(own.column(4))
            c = np.frombuffer(table.column(5)[a].as_py(), "<f8").reshape(-1, x.shape[1])
            homes = table.column(6)[a].as_py()
            yield int(lists[a]), own.column(3), own.column(4), x, c, None if homes is None else np.frombuffer(homes, np.int64)


def _opened(parent, ids, embeddings, child, row, home):
    at = pa.array(row)
    columns = [pa.array(child_list(np.int64(parent), child.astype(np.int64))), ids.take(at), embeddings.take(at), pa.array(home)]
    return pa.Table.from_arrays(columns, ["list", "id", "embedding", "home"]).combine_chunks().to_batches()


def _dealer():
    """Each row of a list to its nearest child, and to others where it lies near a boundary."""

    def run(batches):
        for parent, ids, embeddings, x, c, _ in _lists_of(batches):
            for i in range(0, len(x), 4096):
                near, d = _all_near(x[i : i + 4096], c)
                row, col = _within(near[:, :COPIES], d[:, :COPIES], BOUNDARY, None, 0)
                yield from _opened(parent, ids.slice(i, 4096), embeddings.slice(i, 4096), near[row, col], row, col == 0)

    return run


def _descend(asked: DataFrame, children: DataFrame, ratio: float, enough: int) -> DataFrame:
    """Queries that open a list that was clustered again open its children instead, as many as hold ``enough`` rows at least."""

    def run(batches):
        for parent, ids, embeddings, x, c, homes in _lists_of(batches):
            for i in range(0, len(x), 4096):
                near, d = _all_near(x[i : i + 4096], c)
                row, col = _within(near, d, ratio, homes, enough)
                yield from _opened(parent, ids.slice(i, 4096), embeddings.slice(i, 4096), near[row, col], row, col == 0)

    inner = _with_centroids(asked.select("list", "id", "embedding"), children, run)
    return asked.join(children.select("list"), "list", "left_anti").select("list", "id", "embedding", "home").unionByName(inner)


def _meet(scratch: Scratch, posted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best k of each query (list, id, embedding): postings and the queries that open them meet in one sorted pass over each list.

    A list that many queries open, or that could not be clustered further, is a
    grid of blocks.
    """
    grid = posted.groupBy("list").agg(F.ceil(F.count("*") / RUN_ROWS).cast("int").alias("parts"))
    grid = scratch.keep(grid.join(asked.groupBy("list").agg(F.ceil(F.count("*") / 4096).cast("int").alias("asks_parts")), "list"), "grid")
    grid = _small(grid)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    p = posted.join(grid, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("ask", upto("asks_parts"))
    q = asked.join(grid, "list").withColumn("ask", F.pmod(F.xxhash64("id"), F.col("asks_parts")).cast("int")).withColumn("part", upto("parts"))
    key = F.xxhash64("list", "part", "ask").alias("key")
    rows = p.select(key, F.lit(False).alias("asks"), "id", "embedding").union(q.select(key, F.lit(True).alias("asks"), "id", "embedding"))
    return _ranked(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_meeter(k), HITS), k).drop("rank")


#: Hits that a task holds before it cuts them to the best k of each query, and before it passes them on.
CUT_HITS, MOST_HITS = 200_000, 1_000_000


def _best(hits: list[np.ndarray], k: int) -> list[np.ndarray]:
    q, ids, d = hits
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (d[1:] != d[:-1])  # copies of a boundary vector have one distance
    q, ids, d = q[fresh], ids[fresh], d[fresh]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return [q[best], ids[best], d[best]]


def _meeter(k: int):
    """Rows (key, asks, id, embedding), sorted by key, to the best k hits of each query in this task."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0
        for table in _runs(batches, RUN_ROWS):
            key, asks, ids = table.column(0).to_numpy(), table.column(1).to_numpy(zero_copy_only=False), table.column(2).to_numpy()
            x = matrix(table.column(3))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for a, b in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                q = a + np.flatnonzero(asks[a:b])
                p = a + np.flatnonzero(~asks[a:b])
                if len(q) and len(p):
                    # a query stands for equal ones: its own row is a candidate of the others
                    row, found, d = _nearest(x[q], ids[p], x[p], k)
                    held.append([ids[q[row]], found, d])
                    size += len(held[-1][0])
                if size > CUT_HITS:
                    held = [_best([np.concatenate(c) for c in zip(*held, strict=True)], k)]
                    size = len(held[0][0])
                    if size > MOST_HITS:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], schema=_HITS)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best([np.concatenate(c) for c in zip(*held, strict=True)], k)], schema=_HITS)

    return run


_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each query, from the k best of each list it opened."""
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = hits.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _audited(scratch: Scratch, queries: DataFrame, shared) -> list:
    """AUDIT queries at most: half by hash, and half the lonely ones, which lie farthest from any centroid."""

    def lonely(batches):
        for batch in batches:
            if batch.num_rows:
                _, d = shared.value.near(matrix(batch.column(1)), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d[:, 0])], ["id", "away"])

    some = queries.orderBy(F.xxhash64("id"), "id").limit(AUDIT // 2)
    far = queries.mapInArrow(lonely, "id long, away double").orderBy(F.desc("away"), "id").limit(AUDIT // 2)
    return some.unionByName(queries.join(F.broadcast(far.select("id")), "id", "left_semi")).distinct().collect()


def _truth(base: DataFrame, audited: list, k: int) -> DataFrame:
    """True neighbours of the audited queries: query_id, vec_id, by brute force over all rows in blocks."""
    q_ids, q = np.array([r["id"] for r in audited], np.int64), np.array([r["embedding"] for r in audited], float)

    def brute(batches):
        for batch in batches:
            if batch.num_rows and len(q):
                row, found, d = _nearest(q, batch.column(0).to_numpy(), matrix(batch.column(1)), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(found), pa.array(d)], schema=_HITS)

    return _ranked(base.mapInArrow(brute, HITS), k).select("query_id", "vec_id")


def _quantile(costs: list, recall: float):
    costs = sorted(costs)
    return costs[: int(np.ceil(recall * len(costs)))]


def _first_ratio(truth: DataFrame, posted: DataFrame, audited: list, shared, enough: int, homes: np.ndarray, recall: float) -> tuple[float, int]:
    """(distance ratio, most lists) with which the audited queries open lists of ``recall`` of their true neighbours."""
    if not audited:
        return 1.0, 1
    q_ids, q = np.array([r["id"] for r in audited]), np.array([r["embedding"] for r in audited], float)
    where = truth.join(posted.select(F.col("id").alias("vec_id"), "list"), "vec_id").collect()  # AUDIT * k * COPIES rows at most
    lists = shared.value
    ids, d = lists.near(q, len(lists.centroids))
    reach = np.maximum(_reach(ids, d, homes, enough)[:, 0], 1e-300)
    need: dict[tuple[int, int], tuple[float, int]] = {}
    at = {int(x): i for i, x in enumerate(q_ids)}
    for r in where:
        i = at[r["query_id"]]
        place = np.flatnonzero(ids[i] == r["list"])
        cost = (d[i, place[0]] / reach[i], int(place[0]) + 1) if len(place) else (np.inf, len(lists.centroids))
        key = (r["query_id"], r["vec_id"])
        need[key] = min(need.get(key, cost), cost)
    if not need:
        return 1.0, len(lists.centroids)
    kept = _quantile(list(need.values()), recall)
    ratio, most = kept[-1][0], max(c[1] for c in kept)
    # lists that are opened for their sizes come first, whatever the ratio
    most = max(most, int((np.cumsum(np.where(np.isfinite(d), homes[ids], 0), axis=1) < enough).sum(1).max()) + 1)
    return (float("inf") if not np.isfinite(ratio) else ratio * SPARE), min(len(lists.centroids), most + most // 4 + 1)


def _deeper_ratio(scratch: Scratch, truth: DataFrame, posted: DataFrame, trial: DataFrame, children: DataFrame, recall: float) -> float:
    """The ratio with which audited queries, within lists that they open, open children of ``recall`` of the true neighbours there."""

    def costs(batches):
        for parent, ids, _, x, c, _ in _lists_of(batches):
            near, d = _all_near(x, c)
            ratio = d / np.maximum(d[:, :1], 1e-300)
            row = np.repeat(np.arange(len(x)), len(c))
            child = child_list(np.int64(parent), near.ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(child), ids.combine_chunks().take(pa.array(row)), pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32)), pa.array(ratio.ravel())), pa.array(np.ones(len(row), bool))], ["list", "id", "embedding", "home"])

    opened = _with_centroids(trial.select("list", "id", "embedding"), children, costs).select("list", F.col("id").alias("query_id"), F.col("embedding")[0].alias("cost"))
    # a list counts for those that it came from as well
    rows, near = None, posted.select(F.col("id").alias("vec_id"), "list").join(F.broadcast(truth.select("vec_id").distinct()), "vec_id", "left_semi")
    for _ in range(LEVELS):
        rows = near if rows is None else rows.unionByName(near)
        near = near.where("list >= 4096").withColumn("list", F.shiftright("list", 12) - 1)
    met = opened.join(truth.join(rows.distinct(), "vec_id"), ["query_id", "list"]).groupBy("query_id", "vec_id").agg(F.min("cost").alias("cost"))
    found = [r["cost"] for r in met.collect()]  # AUDIT * k rows at most
    return (_quantile(found, recall)[-1] if found else 1.0) * SPARE
