"""Path graphs: unbranched runs of a string graph as single edges, and the reductions of these.

A path edge is a row: path (its id), src, dst, n_edges, length, score (overlap
summed), mirror (the id of the same run on the other strand).  Reductions drop a
path with its mirror.  Every step is a join or a bounded group; passes are
written to the shared folder, and none brings the graph to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import simple_paths
from helixframe.plans.store import Store

PATHS = ("path", "src", "dst", "n_edges", "length", "score", "mirror")


def _degrees(edges: DataFrame) -> DataFrame:
    """node, ins, outs."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))


def _chains(spark: SparkSession, ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, chain, place) of every id in ``ids``; ``links`` (src, dst) joins each id to one other at most, on either side."""
    found = simple_paths(spark, links).select(F.col("node").alias("id"), F.col("path").alias("chain"), "place")
    alone = ids.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("chain"), F.lit(0).cast("long").alias("place"))
    return found.unionByName(alone)


def runs(spark: SparkSession, graph: DataFrame) -> DataFrame:
    """String edges (src, dst, ...) with their run: path and place from 0.

    A run goes on through nodes that have one way in and one way out.  It is
    named by the hash of its first edge; a ring is cut at one of its edges.
    """
    e = graph.withColumn("id", F.xxhash64("src", "dst"))
    through = _degrees(graph).where("ins = 1 and outs = 1").select("node")
    links = e.select(F.col("id").alias("a"), F.col("dst").alias("node")).join(through, "node").join(e.select(F.col("id").alias("b"), F.col("src").alias("node")), "node").where("a <> b")
    places = _chains(spark, e.select("id"), links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return e.join(places, "id").select(*graph.columns, F.col("chain").alias("path"), "place")


def path_edges(rows: DataFrame) -> DataFrame:
    """``runs`` to path edges."""
    out = rows.groupBy("path").agg(
        F.min_by("src", "place").alias("src"), F.max_by("dst", "place").alias("dst"), F.count("*").alias("n_edges"), F.sum("length").cast("long").alias("length"),
        F.sum("overlap").cast("long").alias("score"), F.max_by("src", "place").alias("__last"),
    )
    return out.withColumn("mirror", F.xxhash64(-F.col("dst"), -F.col("__last"))).select(*PATHS)


def drop_paths(paths: DataFrame, gone: DataFrame) -> DataFrame:
    """Paths without those of ``gone`` (path) and their mirrors."""
    ids = gone.select("path").distinct()
    return paths.join(ids, "path", "left_anti").join(ids.withColumnRenamed("path", "mirror"), "mirror", "left_anti").select(*PATHS)


def _key():
    """What a path and its mirror have in common."""
    return F.least("path", "mirror")


def duplicates(paths: DataFrame, most_edges: int = 2) -> DataFrame:
    """Short paths (``path``) that have the ends of another short one; of each such group one stays, with its mirror."""
    w = Window.partitionBy("src", "dst").orderBy(_key())
    return paths.where(F.col("n_edges") <= most_edges).withColumn("__r", F.dense_rank().over(w)).where("__r > 1").select("path")


def ego_nodes(spark: SparkSession, paths: DataFrame, starts: DataFrame, depth: int, most_length: int | None = None) -> DataFrame:
    """Nodes that each of ``starts`` (start) reaches in ``depth`` steps and below ``most_length``: start, node, length, steps, via.

    A node counts with the fewest steps, then the shortest way; ``via`` lists
    the paths of that way.
    """
    store = Store(spark, "ego")
    found = starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("length"), F.lit(0).alias("steps"), F.array().cast("array<bigint>").alias("via"))
    found = frontier = store.keep(found.distinct(), "start")
    for step in range(1, depth + 1):
        new = frontier.join(paths.select(F.col("src").alias("node"), F.col("dst").alias("__to"), F.col("length").alias("__l"), "path"), "node")
        new = new.select("start", F.col("__to").alias("node"), (F.col("length") + F.col("__l")).alias("length"), F.concat("via", F.array("path")).alias("via"))
        if most_length is not None:
            new = new.where(F.col("length") < most_length)
        best = new.groupBy("start", "node").agg(F.min(F.struct("length", "via")).alias("b")).select("start", "node", "b.length", F.lit(step).alias("steps"), "b.via")
        frontier = store.keep(best.join(found.select("start", "node"), ["start", "node"], "left_anti").select(*found.columns), "frontier")
        if not frontier.take(1):
            break
        found = store.keep(found.unionByName(frontier), "found")
    return found


def remove_path_spurs(spark: SparkSession, paths: DataFrame, depth: int = 10, most_length: int = 50_000, rounds: int = 10) -> DataFrame:
    """Paths without short ways from a dead start into a node that others enter.

    For each node without a way in, the nearest node counts that is also entered
    from outside what the start reaches; the way to it goes if it, or its mirror,
    is shorter than ``most_length``.  What becomes a dead start is looked at in
    the next round.
    """
    store = Store(spark, "path-spurs")
    now = store.keep(paths, "paths")
    for _ in range(rounds):
        starts = now.select(F.col("src").alias("start")).join(now.select(F.col("dst").alias("start")), "start", "left_anti").distinct()
        reach = ego_nodes(spark, now, starts, depth, 10 * most_length)
        entered = reach.where("steps > 0").select("start", "node").join(now.select(F.col("dst").alias("node"), F.col("src").alias("__from")), "node")
        outside = entered.join(reach.select("start", F.col("node").alias("__from")), ["start", "__from"], "left_anti").select("start", "node").distinct()
        ways = reach.join(outside, ["start", "node"]).select("start", "node", "length", F.explode("via").alias("path"))
        back = now.select("path", "mirror").join(now.select(F.col("path").alias("mirror"), F.col("length").alias("back")), "mirror", "left").select("path", "back")
        size = ways.join(back, "path").groupBy("start", "node", "length").agg(F.sum(F.coalesce("back", F.lit(0))).alias("back"))
        w = Window.partitionBy("start").orderBy("length", "node")
        near = size.where(F.least("length", "back") < most_length).withColumn("__r", F.row_number().over(w)).where("__r = 1").select("start", "node")
        gone = store.keep(ways.join(near, ["start", "node"]).select("path").distinct(), "gone")
        if not gone.take(1):
            return now
        now = store.keep(drop_paths(now, gone), "paths")
    return now


def repeat_bridges(paths: DataFrame, most_length: int = 60_000) -> DataFrame:
    """Paths (``path``) that lead from a fork into a merge and are short on either strand: what a repeat leaves between two ways."""
    d = _degrees(paths)
    ends = paths.join(d.select(F.col("node").alias("src"), F.col("ins").alias("i0"), F.col("outs").alias("o0")), "src").join(d.select(F.col("node").alias("dst"), F.col("ins").alias("i1"), F.col("outs").alias("o1")), "dst")
    back = paths.select(F.col("path").alias("mirror"), F.col("length").alias("back"))
    rows = ends.where("i0 = 1 and o0 >= 2 and i1 >= 2 and o1 = 1").join(back, "mirror", "left")
    return rows.where(F.least("length", F.coalesce("back", "length")) < most_length).select("path")


def bubbles(spark: SparkSession, paths: DataFrame, depth: int = 48, width: int = 16, most_length: int = 500_000, tips: int = 6) -> DataFrame:
    """Superbubbles (Onodera and others, 2013) of nodes with several ways out: start, end, size (paths inside), length, inside.

    All starts advance together.  A node is taken once all its ways in are; when
    one node is ready and none is open, it is the end.  A start leaves without a
    bubble at a dead end, on a way back to itself or to a mirrored node, and
    after a round that leaves ``tips`` nodes, has taken ``width`` paths a node
    beyond ten nodes, or has gone too far.  So at most ``tips`` nodes a start
    are ever joined with their ways out.
    """
    store = Store(spark, "bubbles")
    edges = store.keep(paths.select("src", "dst", "path", "length"), "edges")
    ins = store.keep(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins")), "ins")
    outs = edges.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select(F.col("src").alias("start"))
    # nodes reached: how far, ways in seen and in all, and the round in which it was taken
    nodes = outs.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("ins"), F.lit(None).cast("int").alias("taken"))
    nodes = store.keep(nodes, "nodes")
    used = store.keep(edges.limit(0).select(F.col("src").alias("start"), "path"), "used")
    found = []
    for round_ in range(depth):
        ready = nodes.where("seen = ins and taken is null")
        steps = store.keep(ready.select("start", F.col("node").alias("src"), "far").join(edges, "src", "left"), "steps")
        if not steps.take(1):
            break
        reached = steps.where("dst is not null").groupBy("start", F.col("dst").alias("node")).agg(F.max(F.col("far") + F.col("length")).alias("far"), F.count("*").alias("seen"))
        known = nodes.select("start", "node", "far", "seen", "ins", F.when(F.col("taken").isNull() & (F.col("seen") == F.col("ins")), round_).otherwise(F.col("taken")).alias("taken"))
        both = known.unionByName(reached.join(ins, "node").select("start", "node", "far", "seen", "ins", F.lit(None).cast("int").alias("taken")))
        after = both.groupBy("start", "node").agg(F.max("far").alias("far"), F.sum("seen").alias("seen"), F.max("ins").alias("ins"), F.max("taken").alias("taken"))
        after = store.keep(after, "nodes")
        used = store.keep(used.unionByName(steps.where("dst is not null").select("start", "path")), "used")
        dead = steps.where("dst is null or dst = start").select("start")
        folded = after.select("start", F.abs("node").alias("a")).groupBy("start", "a").count().where("count > 1").select("start")
        taken, open_ = F.count("taken"), F.count_if(F.col("taken").isNull() & (F.col("seen") < F.col("ins")))
        facts = after.groupBy("start").agg(taken.alias("taken"), open_.alias("open"), F.count_if(F.col("taken").isNull() & (F.col("seen") == F.col("ins"))).alias("ready"), F.max("far").alias("far"), F.max_by("node", F.when(F.col("taken").isNull(), F.col("far"))).alias("end"))
        facts = facts.join(used.groupBy("start").agg(F.count("*").alias("used")), "start", "left").na.fill(0, ["used"])
        facts = facts.join(dead.union(folded).distinct(), "start", "left_anti")
        wide = (F.col("open") + F.col("ready") >= tips) | (F.col("far") > most_length) | (F.col("taken") > depth * width) | ((F.col("taken") > 10) & (F.col("used") > width * F.col("taken")))
        facts = store.keep(facts.where(~wide), "facts")
        done = (F.col("ready") == 1) & (F.col("open") == 0) & (F.col("used") > 1)
        ends = facts.where(done).select("start", "end", F.col("far").alias("length"))
        inside = used.join(ends, "start").groupBy("start", "end", "length").agg(F.sort_array(F.collect_list("path")).alias("inside"))  # depth * width paths at most
        found.append(store.keep(inside.select("start", "end", F.size("inside").cast("long").alias("size"), "length", "inside"), "found"))
        going = facts.where(~done).select("start")
        nodes, used = after.join(going, "start", "left_semi"), used.join(going, "start", "left_semi")
    if not found:
        return spark.createDataFrame([], BUBBLES)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


BUBBLES = "start long, end long, size long, length long, inside array<bigint>"


def compound_paths(spark: SparkSession, paths: DataFrame, found: DataFrame) -> DataFrame:
    """Bubbles that share no path, the larger ones first (then smaller starts), each with its mirror: start, end, size, length, inside.

    The same choice as going through them one by one: round by round, those
    stay that no larger open one meets, and those that meet them go.
    """
    store = Store(spark, "compound")
    both = paths.select("path", _key().alias("key"))
    claims = found.select("start", "size", F.explode("inside").alias("path")).join(both, "path").select("start", "size", "key").distinct()
    # a bubble and its mirror claim the same paths; the one with the larger start stands for both
    open_ = store.keep(claims, "claims")
    kept = []
    while open_.take(1):
        order = F.struct((-F.col("size")).alias("s"), F.col("start").alias("i"))
        best = open_.groupBy("key").agg(F.min(order).alias("best"))
        rows = open_.join(best, "key")
        losing = rows.where(F.col("best.i") != F.col("start")).select("start").distinct()
        win = store.keep(open_.join(losing, "start", "left_anti").select("start").distinct(), "won")
        kept.append(win)
        taken = open_.join(win, "start").select("key").distinct()
        meet = open_.join(taken, "key").select("start").distinct()
        open_ = store.keep(open_.join(meet, "start", "left_anti").select("start", "size", "key"), "claims")
    if not kept:
        return found.limit(0)
    ids = kept[0]
    for k in kept[1:]:
        ids = ids.union(k)
    chosen = found.join(ids, "start").select("start", "end", "size", "length", "inside")
    turned = chosen.select("start", "end", "size", "length", F.explode("inside").alias("path")).join(paths.select("path", "mirror"), "path")
    turned = turned.groupBy((-F.col("end")).alias("start"), (-F.col("start")).alias("end"), "size", "length").agg(F.sort_array(F.collect_list("mirror")).alias("inside"))
    return chosen.unionByName(turned).dropDuplicates(["start", "end"])


def with_compounds(paths: DataFrame, compounds: DataFrame) -> DataFrame:
    """Path edges in which each compound stands for the paths inside it; its id is the hash of its ends."""
    gone = compounds.select(F.explode("inside").alias("path")).distinct()
    score = compounds.select("start", F.explode("inside").alias("path")).join(paths.select("path", "score"), "path").groupBy("start").agg(F.max("score").alias("score"))
    new = compounds.join(score, "start").select(
        F.xxhash64("start", "end").alias("path"), F.col("start").alias("src"), F.col("end").alias("dst"), F.col("size").alias("n_edges"), "length", "score",
        F.xxhash64(-F.col("end"), -F.col("start")).alias("mirror"),
    )
    return paths.join(gone, "path", "left_anti").select(*PATHS).unionByName(new)


def extend(spark: SparkSession, paths: DataFrame, method: str = "no") -> DataFrame:
    """Paths to chains: path, chain, place; one of each chain and its mirror.

    ``no`` goes on through nodes with one way in and one way out.  ``best`` also
    goes from the best scored of several ways in to the only way out, and from
    the only way in to the best of several ways out.
    """
    if method not in ("no", "best"):
        raise ValueError(f"unknown method {method!r}")
    order = [F.desc("score"), _key(), F.col("path")]
    ins = paths.withColumn("__r", F.row_number().over(Window.partitionBy("dst").orderBy(*order))).where("__r = 1").select(F.col("dst").alias("node"), F.col("path").alias("a"))
    outs = paths.withColumn("__r", F.row_number().over(Window.partitionBy("src").orderBy(*order))).where("__r = 1").select(F.col("src").alias("node"), F.col("path").alias("b"))
    through = _degrees(paths).where("ins = 1 and outs = 1" if method == "no" else "ins >= 1 and outs >= 1 and (ins = 1 or outs = 1)")
    links = through.select("node").join(ins, "node").join(outs, "node").where("a <> b")
    chains = _chains(spark, paths.select(F.col("path").alias("id")), links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = chains.select(F.col("id").alias("path"), "chain", "place")
    # the mirror of a chain holds the mirrors of its paths; of both the one stays whose first node is the larger
    other = rows.join(paths.select("path", "mirror", "src", "dst"), "path").join(rows.select(F.col("path").alias("mirror"), F.col("chain").alias("__c")), "mirror", "left")
    ends = other.groupBy("chain").agg(F.min_by("src", "place").alias("head"), (-F.max_by("dst", "place")).alias("turned"), F.coalesce(F.min("__c"), F.first("chain")).alias("other"))
    kept = ends.where("head > turned or (head = turned and chain <= other)").select("chain")
    return rows.join(kept, "chain").select("path", "chain", "place")


def chain_nodes(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """``runs`` and ``extend`` to node, path (the chain) and place: what ``graph.contigs`` takes."""
    edges = rows.select("path", F.col("place").alias("__p"), "src", "dst").join(chains.select("path", "chain", F.col("place").alias("__c")), "path")
    w = Window.partitionBy("chain").orderBy("__c", "__p")
    at = edges.withColumn("place", F.row_number().over(w).cast("long"))
    first = at.where("place = 1").select(F.col("src").alias("node"), F.col("chain").alias("path"), F.lit(0).cast("long").alias("place"))
    return first.unionByName(at.select(F.col("dst").alias("node"), F.col("chain").alias("path"), "place"))


def tiles(nodes: DataFrame, graph: DataFrame, lengths: DataFrame) -> DataFrame:
    """Where the reads of contigs lie: contig, place, node, start, end.  ``lengths``: read_id, len."""
    w = Window.partitionBy("path").orderBy("place")
    rows = nodes.withColumn("prev", F.lag("node").over(w)).join(graph.select(F.col("src").alias("prev"), F.col("dst").alias("node"), F.col("length").alias("__new")), ["prev", "node"], "left")
    rows = rows.join(lengths.select((F.col("read_id") + 1).alias("__id"), F.col("len").alias("__len")), F.abs("node") == F.col("__id"))
    end = F.sum(F.coalesce("__new", "__len")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return rows.select(F.col("path").alias("contig"), "place", "node", "__len", end.alias("end")).select("contig", "place", "node", (F.col("end") - F.col("__len")).cast("long").alias("start"), "end")
