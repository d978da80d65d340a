"""Contigs of a planted genome, bridged by reads that reach across."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import bridge as B
from helixframe.plans import planted

TURN = str.maketrans("ACGT", "TGCA")


def flipped(s):
    return s[::-1].translate(TURN)


def test_bridged_contigs_are_the_genome(spark):
    turned = (1,)
    text = planted.genome(6000)
    places = [(0, 2500), (2300, 4000), (4200, 6000), (300, 900)]  # overlap, gap, and one inside another
    contigs = [(i, flipped(text[a:b]) if i in turned else text[a:b]) for i, (a, b) in enumerate(places)]
    reads = planted.sample(text, 1500, 100, 0.0, True)
    rows = []
    for i, _, r0, r1, rev in reads:
        for c, (a, b) in enumerate(places):
            lo, hi = max(r0, a), min(r1, b)
            if hi - lo >= 100:
                on = lambda x, y, flip: (lo - x, hi - x) if not flip else (y - hi, y - lo)  # noqa: B023, E731
                rows.append((i, c, *on(r0, r1, rev), *on(a, b, c in turned), b - a, int(bool(rev) != (c in turned)), 100))
    m = spark.createDataFrame(rows, "read_id long, contig long, r_start long, r_end long, c_start long, c_end long, c_len long, strand int, score long")
    links = B.contig_links(B.projected_links(m), m.select("contig", F.col("c_len").alias("len")).distinct())
    assert [r.contig for r in B.contained_contigs(links).collect()] == [3]
    edges = B.contig_edges(links)
    seqs = spark.createDataFrame(contigs, "read_id long, seq string")
    fills = B.gap_fills(edges, m, spark.createDataFrame([(i, s) for i, s, *_ in reads], "read_id long, seq string"))
    for method in ("one",):
        out = B.bridged_contigs(B.extend_contigs(spark, edges, method), edges, seqs.where("read_id < 3"), fills).collect()
        assert len(out) == 1 and out[0].name == "bctg00000000" and out[0].seq in (text, flipped(text)), method


def test_extension_takes_one_doubtful_edge(spark):
    def both(rows):
        return spark.createDataFrame([(a, b, n, 1) for a, b, n in rows] + [(-b, -a, n, 1) for a, b, n in rows], "src long, dst long, support long, read_id long")

    # forks at 2 and at 4: the best edges are 2-3 and 4-5
    e = both([(1, 2, 9), (2, 3, 8), (2, 7, 1), (3, 4, 9), (4, 5, 6), (4, 8, 1)])
    got = {}
    for method in ("no", "best", "one"):
        paths = {}
        for r in B.extend_contigs(spark, e, method).collect():
            paths.setdefault(r.path, []).append((r.place, r.node))
        got[method] = sorted(sorted(abs(n) for _, n in p) for p in paths.values())
    assert got["no"] == [[1, 2], [3, 4], [5], [7], [8]]
    assert got["best"] == [[1, 2, 3, 4, 5], [7], [8]]
    assert got["one"] == [[1, 2, 3, 4], [5], [7], [8]]
    with pytest.raises(ValueError):
        B.extend_contigs(spark, e, "random")


def test_covered_contig_edges_reads_passes(spark, sf_dir):
    from helixframe.plans import layout_queries

    # the joins behind links, edges and reads are not planned again for each that reads them
    assert not [f for f in layout_queries.covered_contig_edges(spark, sf_dir).inputFiles() if "customer" in f]
