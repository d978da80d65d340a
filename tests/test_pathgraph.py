"""Path graphs: small graphs whose reductions are plain to see, and a planted genome."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import graph as G
from helixframe.operators import pathgraph as P
from helixframe.plans import planted


def string_graph(spark, edges):
    """(src, dst, length) with mirrors; node n's mirror is -n."""
    rows = [(a, b, n, 99.0, 100) for a, b, n in edges] + [(-b, -a, n, 99.0, 100) for a, b, n in edges]
    return spark.createDataFrame(rows, "src long, dst long, length long, identity double, overlap long")


def path_table(spark, edges):
    g = string_graph(spark, edges)
    rows = P.runs(spark, g).persist()
    return g, rows, P.path_edges(rows).persist()


def ends(paths):
    return sorted((r.src, r.dst, r.n_edges, r.length) for r in paths.collect())


def both(*rows):
    return sorted(set(rows) | {(-b, -a, n, length) for a, b, n, length in rows})


def test_runs_are_edges_with_mirrors(spark):
    _, rows, paths = path_table(spark, [(1, 2, 5), (2, 3, 7), (3, 4, 1), (3, 5, 2), (5, 6, 3)])
    assert rows.count() == 10 and ends(paths) == both((1, 3, 2, 12), (3, 4, 1, 1), (3, 6, 2, 5))
    ids = {r.path: r for r in paths.collect()}
    assert all(ids[ids[p].mirror].mirror == p and (ids[ids[p].mirror].src, ids[ids[p].mirror].dst) == (-ids[p].dst, -ids[p].src) for p in ids)


def test_short_duplicates_go_with_their_mirrors(spark):
    _, _, paths = path_table(spark, [(1, 2, 5), (2, 3, 1), (2, 4, 1), (4, 3, 1), (3, 5, 9)])
    gone = P.duplicates(paths)
    left = P.drop_paths(paths, gone)
    assert len(ends(paths)) == 8 and len(ends(left)) == 6 and len([e for e in ends(left) if e[:2] == (2, 3)]) == 1


def test_spurs_of_several_paths_go(spark):
    # 90 starts nowhere, forks at 91 and enters the trunk 1-2-3-4-5 at 3 after 20 bases; its other branch is long
    trunk = [(1, 2, 60_000), (2, 3, 60_000), (3, 4, 60_000), (4, 5, 60_000)]
    _, _, paths = path_table(spark, trunk + [(90, 91, 10), (91, 3, 10), (91, 92, 70_000), (92, 93, 70_000)])
    left = ends(P.remove_path_spurs(spark, paths))
    assert (90, 91, 1, 10) not in left and (91, 3, 1, 10) not in left and (91, 93, 2, 140_000) in left and (1, 3, 2, 120_000) in left
    assert left == sorted((-b, -a, n, length) for a, b, n, length in left)
    # a long branch into a node stays
    _, _, paths = path_table(spark, trunk + [(90, 3, 60_000)])
    assert ends(P.remove_path_spurs(spark, paths)) == ends(paths)


def test_repeat_bridges(spark):
    _, _, paths = path_table(spark, [(1, 2, 9), (2, 3, 9), (2, 7, 10), (6, 7, 9), (7, 8, 9)])
    gone = {(r.src, r.dst) for r in paths.join(P.repeat_bridges(paths), "path").collect()}
    assert gone == {(2, 7), (-7, -2)}
    assert P.repeat_bridges(paths, 5).count() == 0


def test_bubbles_become_compound_paths(spark):
    # 2 -> (3 | 4 -> 5) -> 6 is a bubble inside which nothing else enters; 8 -> (9 | 10) -> 11 has a dead end inside
    edges = [(1, 2, 5), (2, 3, 5), (3, 6, 5), (2, 4, 6), (4, 5, 6), (5, 6, 6), (6, 7, 5), (7, 8, 1), (8, 9, 1), (9, 11, 1), (8, 10, 1), (10, 11, 1), (10, 12, 1), (11, 13, 1)]
    _, _, paths = path_table(spark, edges)
    found = P.bubbles(spark, paths, depth=6).collect()
    assert sorted((r.start, r.end, r.size, r.length) for r in found) == [(-6, -2, 2, 18), (2, 6, 2, 18)]
    chosen = P.compound_paths(spark, paths, P.bubbles(spark, paths, depth=6))
    assert sorted((r.start, r.end) for r in chosen.collect()) == [(-6, -2), (2, 6)]
    done = P.with_compounds(paths, chosen)
    assert [e for e in ends(done) if e[:2] == (2, 6)] == [(2, 6, 2, 18)] and done.count() == paths.count() - 2
    chains = P.extend(spark, done)
    longest = chains.groupBy("chain").count().agg(F.max("count")).first()[0]
    assert longest == 3  # 1-2, the bubble, 6-8


def test_overlapping_bubbles_are_chosen_by_size(spark):
    paths = spark.createDataFrame([(i, 0, 0, 1, 1, 1, i + 100) for i in range(8)] + [(i + 100, 0, 0, 1, 1, 1, i) for i in range(8)], "path long, src long, dst long, n_edges long, length long, score long, mirror long")
    found = spark.createDataFrame([(1, 2, 3, 1, [0, 1, 2]), (5, 6, 2, 1, [2, 3]), (7, 8, 2, 1, [3, 4]), (9, 10, 1, 1, [7])], P.BUBBLES)
    got = {r.start for r in P.compound_paths(spark, paths, found).collect() if r.start > 0}
    assert got == {1, 7, 9}


@pytest.mark.parametrize(("method", "want"), [("no", 1), ("best", 2)])
def test_extension(spark, method, want):
    _, _, paths = path_table(spark, [(1, 2, 5), (2, 3, 5), (4, 3, 5), (3, 5, 5)])
    paths = paths.withColumn("score", F.when(F.abs("src") + F.abs("dst") == 7, 50).otherwise(F.col("score")))
    chains = P.extend(spark, paths, method)
    assert chains.groupBy("chain").count().agg(F.max("count")).first()[0] == want
    with pytest.raises(ValueError):
        P.extend(spark, paths, "random")


def test_planted_genome_through_the_path_graph(spark):
    text = planted.genome(5000)
    rows = planted.sample(text, 1000, 200, 0.0, True)
    g = G.reduce(G.edges(planted.true_overlaps(spark, rows, 300)), 10).persist()
    run = P.runs(spark, g).persist()
    chains = P.extend(spark, P.remove_path_spurs(spark, P.path_edges(run), most_length=300))
    nodes = P.chain_nodes(run, chains)
    reads = planted.reads(spark, rows).select("read_id", "seq")
    out = G.contigs(nodes, g, reads).orderBy(F.desc("length")).first()
    assert out.seq in (text, text[::-1].translate(str.maketrans("ACGT", "TGCA")))
    lay = P.tiles(nodes, g, reads.select("read_id", F.length("seq").alias("len"))).where(F.col("contig") == out.contig)
    seqs = {r.read_id: r.seq for r in reads.collect()}
    for t in lay.collect():
        own = seqs[abs(t.node) - 1]
        own = own if t.node > 0 else own[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert out.seq[t.start : t.end] == own


def test_reduced_graph_and_paths_are_written_once(spark, sf_dir):
    from helixframe.plans import graph_queries

    for f in (graph_queries._edges, graph_queries.placed):
        assert [x for x in f(spark, sf_dir).inputFiles() if "customer" in x]
    # what follows the reduction, and what counts paths twice, doesn't go back to the table
    for f in (graph_queries.path_edges, graph_queries.duplicate_paths):
        assert not [x for x in f(spark, sf_dir).inputFiles() if "customer" in x]
