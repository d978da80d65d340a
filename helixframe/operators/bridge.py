"""Links between contigs through reads that map to both, and the contigs that they bridge.

A contig graph has the nodes of a string graph: ``id + 1`` is a contig read
forward, ``-(id + 1)`` backward.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.overlap import aligned_length, location, overhangs_at
from helixframe.functions.sequence import reverse_complement
from helixframe.operators import intervals as I  # noqa: E741
from helixframe.operators import statistics as S
from helixframe.schema import MAD_TO_SD


def contig_read_info(overlaps: DataFrame, min_identity: float = 80.0, max_overhang: int = 500, min_aligned: int = 2000) -> DataFrame:
    """By read, over both roles of overlaps that aren't contained or abnormal: identity and score (identity times aligned length)
    of the best scored one, largest overhang (-1 without), overlaps with an overhang, all overlaps, bases aligned, length."""
    a, b = overhangs_at(0)
    rows = overlaps.withColumn("__loc", location(max_overhang)).where((F.col("identity") > min_identity) & (aligned_length() >= min_aligned) & ~F.col("__loc").isin("Abnormal", "Contained"))
    rows = rows.withColumns({"__a": a, "__b": b, "score": F.floor(F.col("identity") * aligned_length()).cast("long")})
    pick = lambda r: rows.select(F.col(f"{r}_id").alias("read_id"), "identity", "score", F.col(f"__{r}").alias("hang"), (F.col(f"{r}_end") - F.col(f"{r}_start")).alias("span"), F.col(f"{r}_len").alias("len"))
    return pick("a").unionByName(pick("b")).groupBy("read_id").agg(
        F.max_by("identity", F.struct("score", "identity")).alias("identity"), F.max("score").alias("score"), F.max("hang").cast("long").alias("overhang"),
        F.count_if(F.col("hang") >= 0).alias("hangs"), F.count("*").alias("count"), F.sum("span").alias("aligned"), F.max("len").alias("len"),
    )


def bridge_limits(info: DataFrame, identity_weight: str = "score", overhang_weight: str = "len", deviations: float = 6.0, identity_cap: float | None = None, overhang_floor: float | None = None) -> DataFrame:
    """One row, min_identity and max_overhang, from ``contig_read_info`` or ``read_info``: weighted medians and so many deviations from them."""
    mid = lambda c, w: S.weighted_mad(info.withColumn(c, F.col(c).cast("double")), c, w, [])
    cap = F.col("median") if identity_cap is None else F.least(F.lit(identity_cap), "median")
    floor_ = F.col("median") if overhang_floor is None else F.greatest(F.lit(overhang_floor), "median")
    i = mid("identity", identity_weight).select((cap - deviations * MAD_TO_SD * F.col("mad")).alias("min_identity"))
    o = mid("overhang", overhang_weight).select(F.floor(floor_ + deviations * MAD_TO_SD * F.col("mad")).cast("long").alias("max_overhang"))
    return i.crossJoin(F.broadcast(o))


def shared_reads(mappings: DataFrame) -> DataFrame:
    """``mappings`` (read_id, contig) to contig pairs c0 < c1 and how many reads map to both."""
    one = mappings.select("read_id", F.col("contig").alias("c0")).distinct()
    two = mappings.select("read_id", F.col("contig").alias("c1")).distinct()
    return one.join(two, "read_id").where("c0 < c1").groupBy("c0", "c1").agg(F.count("*").alias("n_reads"))


def projected_links(mappings: DataFrame) -> DataFrame:
    """Links through a read: where contig c0's start and end fall on c1.

    ``mappings``: read_id, r_start, r_end (on the read), contig, c_start, c_end,
    c_len, strand, score.  Outside an alignment positions shift by the same
    number of bases.
    """
    cols = ["r_start", "r_end", "c_start", "c_end", "c_len", "strand", "score"]
    one = mappings.select("read_id", F.col("contig").alias("c0"), *[F.col(c).alias(f"x_{c}") for c in cols])
    two = mappings.select("read_id", F.col("contig").alias("c1"), *[F.col(c).alias(f"y_{c}") for c in cols])
    rows = one.join(two, "read_id").where("c0 < c1")
    x_fwd, y_fwd = F.col("x_strand") == 0, F.col("y_strand") == 0
    # c0's ends on the read, then on c1
    on_read = lambda zero: F.when(x_fwd, F.col("x_r_start") - F.col("x_c_start") + (0 if zero else F.col("x_c_len"))).otherwise(F.col("x_r_end") + F.col("x_c_start") - (0 if zero else F.col("x_c_len")))
    on_c1 = lambda p: F.when(y_fwd, F.col("y_c_start") + p - F.col("y_r_start")).otherwise(F.col("y_c_end") - (p - F.col("y_r_start")))
    rows = rows.withColumns({"start": on_c1(on_read(True)), "end": on_c1(on_read(False))})
    return rows.select("c0", "c1", "read_id", F.when(x_fwd == y_fwd, 0).otherwise(1).alias("strand"), "start", "end", F.col("y_c_len").alias("c1_len"), (F.col("x_score") + F.col("y_score")).alias("score"))


def supported_links(links: DataFrame, least: int = 3, gap: int = 1000, width: int = 1000) -> DataFrame:
    """Best window of each gap-separated group of links of a pair and strand, with ``least`` links or more."""
    keys = ["c0", "c1", "strand"]
    rows = I.group_by_gap(links, keys, "start", gap)
    best = I.best_window(rows, [*keys, "grp"], "start", "score", "read_id", width)
    return best.where(F.col("n") >= least).select(*keys, F.col("end_position").alias("position"), "score", F.col("n").alias("support"))


def covered_groups(links: DataFrame, keys: list[str], max_overhang: int, min_coverage: int) -> DataFrame:
    """Groups (``keys``) of links whose reads cover what the contigs should share more than ``min_coverage`` times throughout.

    ``links``: expect_lo, expect_hi (the expected overlap) and real_lo, real_hi
    (what the read's alignments share).  Expectations are averaged, towards
    zero; ``max_overhang`` bases at both ends don't count, and groups that
    expect no more than these pass.
    """
    area = links.groupBy(*keys).agg(*[F.call_function("div", F.sum(f"expect_{e}"), F.count("*")).alias(f"__{e}") for e in ("lo", "hi")])
    size = F.col("__hi") - F.col("__lo")
    short = area.where(size <= 2 * max_overhang).select(*keys)
    rows = links.join(area.where(size > 2 * max_overhang), keys)
    lo, hi = F.greatest(F.col("real_lo") - F.col("__lo"), F.lit(max_overhang)), F.least(F.col("real_hi") - F.col("__lo"), size - max_overhang)
    # every group has an event at the beginning of what counts
    ends = F.array(F.struct(lo.alias("pos"), F.lit(1).alias("step")), F.struct(hi.alias("pos"), F.lit(-1).alias("step")))
    first = F.array(F.struct(F.lit(max_overhang).cast("long").alias("pos"), F.lit(0).alias("step")))
    moves = rows.select(*keys, (size - max_overhang).alias("__end"), F.explode(F.concat(first, F.when(hi > lo, ends).otherwise(F.array().cast("array<struct<pos:bigint,step:int>>")))).alias("e"))
    steps = moves.groupBy(*keys, "__end", F.col("e.pos").alias("pos")).agg(F.sum("e.step").alias("step"))
    depth = I.scanned(steps, [*keys, "__end"], "pos", F.col("step"), "depth")
    low = depth.where(F.col("pos") < F.col("__end")).groupBy(*keys).agg(F.min("depth").alias("low"))
    return low.where(F.col("low") > min_coverage).select(*keys).unionByName(short)


def contig_links(links: DataFrame, lengths: DataFrame, tolerance: int = 100) -> DataFrame:
    """``projected_links`` of one pair and strand as one row: c0, c1, strand, start, end (of c0 on c1, upper medians), support, loc.

    ``lengths``: contig, len.  The location is c0's seen from c1: Left before it,
    Right after it, Contained in it, Containing it, or Equal.
    """
    keys = ["c0", "c1", "strand"]
    mid = lambda c: F.sort_array(F.collect_list(c))[F.call_function("div", F.count(c), F.lit(2)).cast("int")]
    rows = links.groupBy(*keys).agg(mid(F.least("start", "end")).alias("lo"), mid(F.greatest("start", "end")).alias("hi"), F.count_distinct("read_id").alias("support"), F.max_by("read_id", F.struct("score", -F.col("read_id"))).alias("read_id"))
    rows = rows.join(lengths.select(F.col("contig").alias("c1"), F.col("len").alias("l1")), "c1")
    near = lambda x, y: F.abs(x - y) <= tolerance
    begins, ends = near(F.col("lo"), F.lit(0)), near(F.col("hi"), F.col("l1"))
    loc = F.when(begins & ends, "Equal").when((F.col("lo") >= -tolerance) & (F.col("hi") <= F.col("l1") + tolerance), "Contained").when((F.col("lo") <= tolerance) & (F.col("hi") >= F.col("l1") - tolerance), "Containing")
    return rows.withColumn("loc", F.coalesce(loc, F.when(F.col("lo") < 0, "Left").otherwise("Right")))


def contained_contigs(links: DataFrame) -> DataFrame:
    """Contigs (contig) that another contains; of equal ones the larger id."""
    inner = F.when(F.col("loc") == "Containing", F.col("c1")).when(F.col("loc") == "Contained", F.col("c0")).when(F.col("loc") == "Equal", F.greatest("c0", "c1"))
    return links.select(inner.alias("contig")).where("contig is not null").distinct()


def contig_edges(links: DataFrame) -> DataFrame:
    """Edges between contigs that no other contains: src, dst, length (bases of dst beyond src, more than it has where a gap is bridged), support, read_id."""
    gone = contained_contigs(links)
    rows = links.where(F.col("loc").isin("Left", "Right"))
    for c in ("c0", "c1"):
        rows = rows.join(gone.withColumnRenamed("contig", c), c, "left_anti")
    own, other = F.when(F.col("strand") == 0, F.col("c0") + 1).otherwise(-(F.col("c0") + 1)), F.col("c1") + 1
    left = F.col("loc") == "Left"
    ahead = F.when(left, F.col("l1") - F.col("hi")).otherwise(F.col("hi") - F.col("l1"))  # of what comes second
    back = F.when(left, -F.col("lo")).otherwise(F.col("lo"))  # of what comes first, seen from the other strand
    ways = F.array(F.struct(F.when(left, own).otherwise(other).alias("src"), F.when(left, other).otherwise(own).alias("dst"), ahead.alias("length")), F.struct((-F.when(left, other).otherwise(own)).alias("src"), (-F.when(left, own).otherwise(other)).alias("dst"), back.alias("length")))
    best = Window.partitionBy("src", "dst").orderBy(F.desc("support"), "length", "read_id")
    out = rows.select(F.inline(ways), "support", "read_id").withColumn("__r", F.row_number().over(best)).where("__r = 1")
    return out.select("src", "dst", F.col("length").cast("long").alias("length"), "support", "read_id")


def covered_edges(edges: DataFrame, gaps: DataFrame, reads: DataFrame, window: int = 1000) -> DataFrame:
    """Edges (src, dst) that belong to two steps which a direct edge replaces: same length within twice ``window``, and a read on all three.

    ``gaps``: src, dst, gap (bases between the contigs, below zero where they
    overlap) plus the middle contig's length for the second step; ``reads``: src, dst, read_id.
    """
    e = edges.select("src", "dst").join(gaps, ["src", "dst"])
    one = e.select("src", F.col("dst").alias("mid"), F.col("gap").alias("g1"))
    two = e.select(F.col("src").alias("mid"), "dst", F.col("gap").alias("g2"))
    paths = one.join(two, "mid").join(e, ["src", "dst"]).where(F.abs(F.col("g1") + F.col("g2") - F.col("gap")) <= 2 * window).where("src <> dst")
    r = lambda a, b: reads.select(F.col("src").alias(a), F.col("dst").alias(b), "read_id").distinct()
    shared = paths.select("src", "mid", "dst").join(r("src", "dst"), ["src", "dst"]).join(r("src", "mid"), ["src", "mid", "read_id"], "left_semi").join(r("mid", "dst"), ["mid", "dst", "read_id"], "left_semi")
    found = shared.select("src", "mid", "dst").distinct()
    return found.select("src", F.col("mid").alias("dst")).union(found.select("mid", "dst")).distinct()


def extend_contigs(spark: SparkSession, edges: DataFrame, method: str = "one") -> DataFrame:
    """Contig paths: node, path, place; one of each path and its mirror.

    ``no`` goes on where there is one way out and one way in; ``best`` along
    edges that have the most support at both their ends; ``one`` does both, but
    takes at most one edge a path that is not the only way, the best supported.
    """
    from helixframe.operators.graph import simple_paths
    from helixframe.operators.pathgraph import _chains, _degrees

    if method not in ("no", "best", "one"):
        raise ValueError(f"unknown method {method!r}")
    pair = [F.least(F.abs("src"), F.abs("dst")), F.greatest(F.abs("src"), F.abs("dst")), F.least(F.col("src"), -F.col("dst"))]  # alike for an edge and its mirror
    order = [F.desc("support"), *pair]
    d = _degrees(edges)
    rows = edges.join(d.select(F.col("node").alias("src"), "outs"), "src").join(d.select(F.col("node").alias("dst"), "ins"), "dst")
    only = (F.col("outs") == 1) & (F.col("ins") == 1)
    if method == "no":
        rows = rows.where(only)
    else:
        rows = rows.withColumn("__o", F.row_number().over(Window.partitionBy("src").orderBy(*order))).withColumn("__i", F.row_number().over(Window.partitionBy("dst").orderBy(*order))).where("__o = 1 and __i = 1")
    links = rows.select("src", "dst", "support", only.alias("only"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(edges.select(-F.col("src"))).union(edges.select(-F.col("dst"))).distinct()
    if method == "one":
        # paths over sure edges first; each then keeps its best other edge, if that is the best of both paths it joins
        sure = _chains(spark, nodes, links.where("only").select("src", "dst"))
        at = sure.select("id", "chain")
        bold = links.where("not only").join(at.select(F.col("id").alias("src"), F.col("chain").alias("x")), "src").join(at.select(F.col("id").alias("dst"), F.col("chain").alias("y")), "dst").where("x <> y")
        ends = bold.select("src", "dst", "support", F.explode(F.array("x", "y")).alias("n"))
        ranked = ends.withColumn("__r", F.row_number().over(Window.partitionBy("n").orderBy(*order)))
        good = ranked.groupBy("src", "dst").agg(F.max("__r").alias("m")).where("m = 1").select("src", "dst")
        links = links.where("only").select("src", "dst").unionByName(good)
    found = simple_paths(spark, links.select("src", "dst")).select("node", "path", "place")
    ends = found.groupBy("path").agg(F.max_by("node", "place").alias("last"))
    kept = ends.where(F.col("path") >= -F.col("last")).select("path")
    alone = nodes.select(F.abs("id").alias("node")).join(found.select(F.abs("node").alias("node")), "node", "left_anti").distinct()
    return found.join(kept, "path").select("node", "path", "place").unionByName(alone.select("node", F.col("node").alias("path"), F.lit(0).cast("long").alias("place")))


def gap_fills(edges: DataFrame, mappings: DataFrame, reads: DataFrame) -> DataFrame:
    """Bases between the contigs of edges that don't meet, from the edge's read: src, dst, seq.

    ``mappings`` as in ``projected_links``; ``reads``: read_id, seq.
    """
    cols = ["r_start", "r_end", "c_start", "c_end", "c_len", "strand"]
    side = lambda n: mappings.select("read_id", (F.col("contig") + 1).alias(f"__{n}"), *[F.col(c).alias(f"{n}_{c}") for c in cols])
    rows = edges.withColumns({"__s": F.abs("src"), "__d": F.abs("dst")}).join(side("s"), ["read_id", "__s"]).join(side("d"), ["read_id", "__d"])
    rows = rows.where(F.col("length") > F.col("d_c_len"))
    along = (F.col("src") > 0) == (F.col("s_strand") == 0)  # the read runs as the path does

    def outer(n: str, node: str, last: bool):
        """Where the end of a contig that comes last (or first) on the path stands on the read."""
        beyond = F.when((F.col(node) > 0) == F.lit(last), F.col(f"{n}_c_len") - F.col(f"{n}_c_end")).otherwise(F.col(f"{n}_c_start"))
        ahead = along if last else ~along
        return F.when(ahead, F.col(f"{n}_r_end") + beyond).otherwise(F.col(f"{n}_r_start") - beyond)

    rows = rows.withColumns({"a": outer("s", "src", True), "b": outer("d", "dst", False)}).join(reads.select("read_id", "seq"), "read_id")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    part = F.substring("seq", (lo + 1).cast("int"), (hi - lo).cast("int"))
    return rows.select("src", "dst", F.when(along, part).otherwise(reverse_complement(part)).alias("seq")).dropDuplicates(["src", "dst"])


def bridged_contigs(paths: DataFrame, edges: DataFrame, contigs: DataFrame, fills: DataFrame, least: int = 500) -> DataFrame:
    """Sequences of contig paths, and of contigs in no path: name, contigs (node ids in order), length, seq, the longest first by name.

    A further contig adds the bases beyond the one before; where they don't
    meet, ``fills`` (src, dst, seq) goes between.  Contained contigs should not
    be among ``contigs`` (read_id, seq).
    """
    w = Window.partitionBy("path").orderBy("place")
    rows = paths.withColumn("prev", F.lag("node").over(w)).join(edges.select(F.col("src").alias("prev"), F.col("dst").alias("node"), "length"), ["prev", "node"], "left")
    rows = rows.join(fills.select(F.col("src").alias("prev"), F.col("dst").alias("node"), F.col("seq").alias("fill")), ["prev", "node"], "left")
    rows = rows.join(contigs.select((F.col("read_id") + 1).alias("id"), "seq"), F.abs("node") == F.col("id"))
    seq = F.when(F.col("node") > 0, F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    new = F.substring(seq, (F.length(seq) - F.col("length") + 1).cast("int"), F.col("length").cast("int"))
    piece = F.when(F.col("length").isNull(), seq).when(F.col("length") <= F.length(seq), new).otherwise(F.concat(F.coalesce("fill", F.lit("")), seq))
    whole = rows.select("path", "place", "node", piece.alias("piece")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "node", "piece"))).alias("p"))
    out = whole.select(F.transform("p", lambda x: x["node"]).alias("contigs"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))
    rest = contigs.join(paths.select((F.abs("node") - 1).alias("read_id")).distinct(), "read_id", "left_anti").select(F.array((F.col("read_id") + 1)).alias("contigs"), "seq")
    out = out.unionByName(rest).withColumn("length", F.length("seq").cast("long")).where(F.col("length") >= least)
    # ranks of lengths come from a histogram, so that sequences are not sorted in one task
    longer = out.groupBy("length").agg(F.count("*").alias("n")).select("length", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("length").orderBy("contigs")) - 1
    return out.join(longer, "length").select(F.format_string("bctg%08d", place.cast("long")).alias("name"), "contigs", "length", "seq")


def best_links(links: DataFrame) -> DataFrame:
    """For each contig end the link with the most support that is also its partner's best: c0, c1, strand, position, support.

    An end of c0 is taken by where c1 lies: after it (position < 0) or before.
    """
    rows = links.distinct().withColumn("end0", F.when(F.col("position") < 0, 1).otherwise(0)).withColumn("end1", F.when((F.col("position") < 0) == (F.col("strand") == 0), 0).otherwise(1))
    order = [F.desc("support"), F.desc("score"), F.col("c0"), F.col("c1"), F.col("position"), F.col("strand")]
    for n in "01":
        rows = rows.withColumn(f"r{n}", F.row_number().over(Window.partitionBy(f"c{n}", f"end{n}").orderBy(*order)))
    return rows.where("r0 = 1 and r1 = 1").drop("r0", "r1", "end0", "end1")


def split_contigs(contigs: DataFrame, piece: int = 50_000) -> DataFrame:
    """Pieces of ``piece`` bases, a last one of up to 20 % more: read_id, part, start, seq."""
    n = F.length("seq")
    count = F.greatest(F.floor(n / piece).cast("int") + F.when(n % piece > piece * 0.2, 1).otherwise(0), F.lit(1))
    rows = contigs.select("read_id", "seq", count.alias("__n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    start = F.col("part") * piece
    size = F.when(F.col("part") == F.col("__n") - 1, F.length("seq") - start).otherwise(piece)
    return rows.select("read_id", "part", start.cast("long").alias("start"), F.substring("seq", start + 1, size).alias("seq"))


def from_pieces(hits: DataFrame, pieces: DataFrame) -> DataFrame:
    """Hits between pieces (qid, qbeg, qend, sid, sbeg, send by piece id) in contig coordinates; hits within a contig go.

    ``pieces``: piece, read_id, start.
    """
    out = hits
    for r in "qs":
        own = pieces.select(F.col("piece").alias(f"{r}id"), F.col("read_id").alias(f"__{r}"), F.col("start").alias(f"__{r}0"))
        out = out.join(own, f"{r}id").withColumns({f"{r}id": F.col(f"__{r}"), f"{r}beg": F.col(f"{r}beg") + F.col(f"__{r}0"), f"{r}end": F.col(f"{r}end") + F.col(f"__{r}0")})
    return out.where("qid <> sid").select(*hits.columns)
