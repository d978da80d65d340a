"""Golden cases and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import kernels as K
from helixframe.functions import overlap as X
from helixframe.functions import sequence
from helixframe.functions.sequence import cigar_identity, kmers, packed_kmers, reverse_complement
from helixframe.operators import graph, kernels, reads
from helixframe.operators import statistics as S
from helixframe.plans import planted
from helixframe.plans.config import Config
from helixframe.schema import OVERLAPS
from helixframe.sources.overlaps import read_overlaps, write_overlaps
from helixframe.sources.sequences import read_fasta, read_fastq, write_fasta


def overlap(a_start, a_end, b_start, b_end, strand=0, a_len=1000, b_len=1000):
    return (1, 2, 95.0, 0, a_start, a_end, a_len, strand, b_start, b_end, b_len)


LOCATIONS = [
    (overlap(500, 1000, 0, 500), "Left"),
    (overlap(0, 500, 500, 1000), "Right"),
    (overlap(0, 500, 0, 500, 1), "Left"),
    (overlap(500, 1000, 500, 1000, 1), "Right"),
    (overlap(0, 1000, 0, 1000), "Equal"),
    (overlap(0, 1000, 0, 1000, 1), "Equal"),
    (overlap(200, 700, 0, 500, 0, 1000, 500), "Containing"),
    (overlap(0, 500, 200, 700, 1, 500, 1000), "Contained"),
    (overlap(300, 600, 300, 600), "Abnormal"),
    (overlap(490, 990, 10, 500), "Left"),  # at the tolerance
    (overlap(490, 989, 10, 500), "Abnormal"),  # one past it
]


def test_location_cases(spark):
    df = spark.createDataFrame([r for r, _ in LOCATIONS], OVERLAPS).select(X.location(10).alias("loc"))
    assert [r[0] for r in df.collect()] == [want for _, want in LOCATIONS]


def test_mapping_there_and_back(spark):
    df = spark.createDataFrame([overlap(100, 900, 50, 870), overlap(100, 900, 50, 870, 1)], OVERLAPS)
    df = df.withColumn("p", F.explode(F.sequence(F.lit(100), F.lit(900), F.lit(50))))
    df = df.withColumn("q", X.map_position(F.col("p"), "a", "b")).withColumn("back", X.map_position(F.col("q"), "b", "a"))
    assert df.where(F.abs(F.col("back") - F.col("p")) > 1).count() == 0


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTT", "3=1X2I4="), ("AC", ""), ("", "2D")], "s string, c string")
    got = df.select(reverse_complement(F.col("s")), kmers(F.col("s"), 3, 2), cigar_identity(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("AACGT", ["ACG", "GTT"], 70.0), ("GT", [], None), ("", [], 0.0)]


def test_packed_kmers_equal_the_strings(spark):
    """Both cases, letters that are no bases, short, empty and null reads; blocks smaller than a read."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGTacgtN"), n, p=[0.23, 0.23, 0.23, 0.23, 0.02, 0.02, 0.01, 0.01, 0.02])) for n in (0, 3, 14, 15, 16, 400, 37)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string").coalesce(1)
    for k, stride in ((15, 1), (15, 10), (4, 7), (31, 3), (1, 1)):
        want = set()
        for i, t in enumerate(texts):
            for at in range(0, len(t or "") - k + 1, stride):
                word = t[at : at + k].upper()
                if "N" not in word:
                    want.add((i, at, sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(word))))
        for block in (sequence.BLOCK, 23):
            got = [tuple(r) for r in packed_kmers(df, k, stride, block).collect()]
            assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError):
        packed_kmers(df, 32)


def test_longest_by_budget_edges(spark):
    r = spark.createDataFrame([(i, "A" * n) for i, n in enumerate([5, 9, 9, 2, 7])], "read_id long, seq string")
    assert sorted(x.read_id for x in reads.longest_by_budget(r, 9).collect()) == [1, 2]  # both of the last length
    assert reads.longest_by_budget(r, 1000).count() == 5
    parts = {x.read_id: x.part for x in reads.split_by_budget(r, 14).collect()}
    assert parts == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}


def test_reads_that_are_not_bases(spark):
    r = spark.createDataFrame([(0, "ACGN"), (1, "ACGT"), (2, "")], "read_id long, seq string")
    assert [x.read_id for x in reads.legal_min_length(r, 0).orderBy("read_id").collect()] == [1, 2]
    assert [tuple(x) for x in reads.illegal_bases(r).collect()] == [(0, 3, "N")]


def test_weighted_median_of_all_rows_equals_grouped(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(rng.normal(size=3000), rng.integers(1, 50, 3000), strict=True)], "v double, w long")
    assert S.weighted_median_all(df, "v", "w").first()[0] == S.weighted_median(df, "v", "w", []).first()[0]


def test_first_trough():
    bins = {i: max(0, 200 - 20 * i) for i in range(10)} | {i: 5 * (i - 10) for i in range(10, 60)}
    assert 8 <= S.first_trough(bins) <= 14


@pytest.mark.parametrize("seed", range(5))
def test_alignment_properties(seed):
    rng = np.random.default_rng(seed)
    a = planted.genome(int(rng.integers(1, 200)), seed)
    b = planted.noisy(a, 0.2, rng)
    edits, qa, qb = K.align(a, b)
    assert K.decode(qa).replace("-", "") == a and K.decode(qb).replace("-", "") == b
    assert edits == int((qa != qb).sum())
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    table[:, 0], table[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    assert edits == table[-1, -1]


def test_consensus_of_exact_copies_is_the_template():
    seq = planted.genome(300)
    _, qa, qb = K.align(seq, seq)
    links = K.tags(qa, qb, 0)
    assert K.consensus(links, np.full(len(links), 5.0), {i: 5.0 for i in range(300)}) == (0, 300, seq)


def test_chain_follows_the_diagonal():
    q = np.array([0, 20, 40, 60, 500])
    score, path = K.chain(q, q + 100)[0]
    assert path.tolist() == [0, 1, 2, 3, 4] and score > 60


def test_error_free_reads_assemble_to_the_genome(spark):
    text = planted.genome(5000)
    rows = planted.sample(text, 1000, 200, 0.0, True)
    g = graph.reduce(graph.edges(planted.true_overlaps(spark, rows, 300)), 10)
    out = graph.contigs(graph.simple_paths(spark, g), g, planted.reads(spark, rows).select("read_id", "seq")).orderBy(F.desc("length")).first()
    assert out.seq in (text, text[::-1].translate(str.maketrans("ACGT", "TGCA")))


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">r1 some words\nACGT\nAC\n>r2\n\n>r3\nNNA\n")
    got = read_fasta(spark, str(tmp_path / "x.fa")).orderBy("read_id").collect()
    assert [(r.read_id, r.name, r.sub_head, r.seq) for r in got] == [(0, "r1", "some words", "ACGTAC"), (1, "r2", "", ""), (2, "r3", "", "NNA")]
    (tmp_path / "x.fq").write_text("@q1 z\nACG\n+\n!!!\n@q2\nA\n+\n#\n")
    assert [(r.name, r.seq, r.quality) for r in read_fastq(spark, str(tmp_path / "x.fq")).orderBy("read_id").collect()] == [("q1", "ACG", "!!!"), ("q2", "A", "#")]
    (tmp_path / "bad.fq").write_text("@q1\nACG\n+\n!!\n")
    with pytest.raises(Exception, match="bad FASTQ"):
        read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    write_fasta(read_fasta(spark, str(tmp_path / "x.fa")), f"file://{tmp_path}/out")
    assert read_fasta(spark, f"file://{tmp_path}/out").count() == 3


def test_other_overlap_formats(spark, tmp_path):
    """m4a, paf and ovl rows as the layouts say; names stay names where a format has no numbers."""
    (tmp_path / "x.ovl").write_text("0 1 -500 95.0 0 500 1000 1000 0 0 500 1000 overlap\n")
    got = read_overlaps(spark, f"file://{tmp_path}/x.ovl", "ovl").collect()
    assert [(r.a_id, r.b_id, r.identity, r.a_start, r.a_end, r.b_start, r.b_end) for r in got] == [(0, 1, 95.0, 500, 1000, 0, 500)]
    (tmp_path / "x.paf").write_text("r0\t1000\t500\t1000\t+\tr1\t1000\t0\t500\t450\t500\t255\n")
    names = spark.createDataFrame([(7, "r0"), (9, "r1")], "read_id long, name string")
    got = read_overlaps(spark, f"file://{tmp_path}/x.paf", "paf", names).collect()[0]
    assert (got.a_id, got.b_id, got.b_strand) == (7, 9, 0)
    df = spark.createDataFrame([overlap(500, 1000, 0, 500)], OVERLAPS).withColumns({"a_id": F.lit(7).cast("long"), "b_id": F.lit(9).cast("long")})
    write_overlaps(df, f"file://{tmp_path}/y.m4a", "m4a", names)
    write_overlaps(df, f"file://{tmp_path}/y.m4a", "m4a", names, "append")
    back = read_overlaps(spark, f"file://{tmp_path}/y.m4a", "m4a", names)
    assert back.count() == 2 and {tuple(r) for r in back.drop("score").collect()} == {tuple(r) for r in df.collect()}
    assert (got.identity, got.a_start, got.a_end, got.a_len, got.b_start, got.b_end, got.b_len) == (90.0, 500, 1000, 1000, 0, 500, 1000)


def test_overlap_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([overlap(500, 1000, 0, 500), overlap(0, 500, 0, 500, 1)], OVERLAPS)
    write_overlaps(df, f"file://{tmp_path}/o.m4")
    back = read_overlaps(spark, f"file://{tmp_path}/o.m4", "m4")
    assert sorted(map(tuple, back.drop("score").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "short.m4").write_text("1 2 95.0\n")
    with pytest.raises(Exception, match="short m4 row"):
        read_overlaps(spark, f"file://{tmp_path}/short.m4").collect()


def test_config():
    c = Config.parse("PROJECT=x\nONT_READ_LIST=l\nGENOME_SIZE=4600000\n# note\nPOLISH_CONTIGS=false\n")
    c.check()
    assert Config.parse(c.text()) == c and c.digest() != Config().digest()
    with pytest.raises(ValueError):
        Config.parse("NOPE=1")


def test_polishing_goes_on_after_many_reads_at_one_place(spark):
    text = planted.genome(5000)
    draft = "".join("ACGT"["ACGT".index(c) ^ 1] if i % 97 == 50 else c for i, c in enumerate(text))
    places = [(0, 1600)] * 320 + [(2000, 3500)] * 6
    reads_ = spark.createDataFrame([(i, text[a:b]) for i, (a, b) in enumerate(places)], "read_id long, seq string")
    mapped = spark.createDataFrame([(i, 0, 0, 0, b - a, a, b) for i, (a, b) in enumerate(places)], "qid long, qdir int, sid long, qbeg long, qend long, sbeg long, send long")
    out = kernels.polish(mapped, spark.createDataFrame([(0, draft)], "read_id long, seq string"), reads_).first().seq
    assert out[:1600] == text[:1600] and out[2000:3500] == text[2000:3500]
    assert out[1600:2000] == draft[1600:2000].lower() and out[3500:] == draft[3500:].lower()


def brute_weak(rows, least, hang):
    """lacking_support by looking at every neighbour of every end."""
    near = {}
    for a, b, a0, a1, al, b0, b1, bl in rows:
        near.setdefault(a, {})[b] = (a0, al - a1, b0, bl - b1)
        near.setdefault(b, {})[a] = (b0, bl - b1, a0, al - a1)
    weak = set()
    for a, b, a0, a1, al, b0, b1, bl in rows:
        a_right, b_right = al - a1, bl - b1
        if a_right == 0 and b0 == 0:
            needs = [(a, b, 1, b_right), (b, a, 0, a0)]
        else:  # the other dovetail
            needs = [(a, b, 0, b0), (b, a, 1, a_right)]
        for x, y, end, beyond in needs:
            reach = [z for z, f in near[x].items() if z != y and z in near[y] and (f[2 + end] > hang if beyond > 2000 else f[end] <= hang)]
            if len(reach) < least:
                weak.add((a, b))
    return weak


def test_support_around_a_hub(spark):
    """One read overlaps all others: the read with fewer neighbours lists them, so rows stay far below degree squared."""
    import random

    from helixframe.operators import filters
    from helixframe.schema import OVERLAPS

    rng = random.Random(4)
    n, rows, seen = 400, [], set()
    pairs = [(0, i) for i in range(1, n)] + [(i, i + k) for i in range(1, n) for k in (1, 2) if i + k < n]
    for a, b in pairs:
        if (a, b) in seen:
            continue
        seen.add((a, b))
        span, free_a, free_b = rng.randint(2500, 3000), rng.choice([100, 400, 2500]), rng.choice([100, 400, 2500])
        rows.append((a, b, free_a, free_a + span, free_a + span, 0, span, span + free_b))
    table = [(a, b, 95.0, 0, a0, a1, al, 0, b0, b1, bl) for a, b, a0, a1, al, b0, b1, bl in rows]
    df = spark.createDataFrame(table, OVERLAPS)
    for least in (1, 2):
        got = {tuple(r) for r in filters.lacking_support(df, least, 300).collect()}
        assert got == brute_weak(rows, least, 300) and 0 < len(got) < len(rows)
