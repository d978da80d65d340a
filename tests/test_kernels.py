"""Sequential kernels against brute force, and on planted reads."""

import numpy as np
import pytest

from helixframe.functions import kernels as K
from helixframe.operators import kernels as N
from helixframe.operators import kmers
from helixframe.plans import planted


def brute_matches(a, b, least):
    out = set()
    for d in range(-len(a) + 1, len(b)):
        i = max(0, -d)
        while i < len(a) and i + d < len(b):
            j = i
            while j < len(a) and j + d < len(b) and a[j] == b[j + d]:
                j += 1
            if j - i >= least:
                out.add((i, i + d, j - i))
            i = j + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_exact_matches_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    a = planted.genome(300, seed)
    b = planted.noisy(a[50:] + a[:80], 0.05, rng)
    words = {}
    for i in range(len(b) - 9):
        words.setdefault(b[i : i + 10], []).append(i)
    seeds = [(i, j) for i in range(0, len(a) - 9) for j in words.get(a[i : i + 10], [])]
    q, s = np.array(seeds).T
    got = K.exact_matches(K.encode(a), K.encode(b), q, s, 10, 12)
    assert {tuple(m) for m in got.tolist()} == brute_matches(a, b, 12) and len(got) == len({tuple(m) for m in got.tolist()})


def test_matches_chain_along_the_diagonal():
    m = np.array([[0, 100, 40], [60, 162, 30], [120, 220, 50], [90, 5000, 60]])
    score, path = K.chain_matches(m)[0]
    assert path.tolist() == [0, 1, 2] and score > 100
    assert K.chain_matches(np.zeros((0, 3), int)) == []


def test_consistency_is_symmetric_and_counts_lines():
    q, s = np.array([0, 10, 20, 30, 5]), np.array([100, 110, 121, 130, 900])
    c = K.consistent(q, s)
    assert (c == c.T).all() and c.sum(1).tolist() == [3, 3, 3, 3, 0]


@pytest.mark.parametrize("rate", [0.0, 0.1])
def test_extension_recovers_both_sequences(rate):
    rng = np.random.default_rng(3)
    a = planted.genome(3000, 5)
    b = planted.noisy(a, rate, rng)
    i, j, qa, qb = K.extend(a, b)
    assert K.decode(qa).replace("-", "") == a[:i] and K.decode(qb).replace("-", "") == b[:j]
    assert i > 2900 and K.identity(qa, qb) > 100 * (1 - 1.5 * rate) - 1e-9
    other = planted.genome(3000, 6)
    assert K.extend(a, other)[0] < 600
    q0, q1, s0, s1, qa, qb = K.extend_seed(other[:500] + a, b, 500 + 1500, int(1500 * len(b) / len(a)), 512)
    assert K.decode(qa).replace("-", "") == (other[:500] + a)[q0:q1] and K.decode(qb).replace("-", "") == b[s0:s1]


def test_candidates_with_a_long_insertion_are_rescued():
    a = planted.genome(3000, 7)
    b = a[:1500] + planted.genome(400, 8) + a[1500:]
    q0, q1, s0, s1, qa, qb = K.align_candidate(a, b, (0, 3000, 0, 3400), (200, 200), most_hang=200)
    assert (q0, q1, s0, s1) == (0, 3000, 0, 3400) and K.decode(qa).replace("-", "") == a and K.decode(qb).replace("-", "") == b


def test_similarity():
    a = planted.genome(3000, 9)
    assert K.similarity(a, a) == (1.0, 1.0)
    coverage, ident = K.similarity(a, planted.noisy(a, 0.05, np.random.default_rng(1)))
    assert coverage > 0.97 and 0.9 < ident < 0.98
    assert K.similarity(a, planted.genome(3000, 10))[0] < 0.1


def test_planted_reads_through_candidates_matches_and_trimming(spark):
    text = planted.genome(6000)
    rows = planted.sample(text, 1500, 500, 0.03, True)
    reads = planted.reads(spark, rows).select("read_id", "seq")
    queries = kmers.index(reads, 11, 2, 0).unionByName(kmers.index(reads, 11, 2, 1))
    seeds = kmers.seeds(queries, kmers.index(reads, 11), 50).where("qid > sid").persist()
    true = {(a, b, int(ra != rb)) for a, _, a0, a1, ra in rows for b, _, b0, b1, rb in rows if a > b and min(a1, b1) - max(a0, b0) >= 900}
    by_blocks = N.block_candidates(seeds, 11).persist()
    for found in (by_blocks, N.chain_matches(N.exact_matches(seeds, reads, 11))):
        pairs = {(r.qid, r.sid, r.qdir) for r in found.collect()}
        assert true <= pairs and all(abs(a - b) <= 2 for a, b, _ in pairs)
    one = N.uncontained(N.drop_contained(by_blocks))
    assert one.count() == one.select("qid", "sid", "qdir").distinct().count()
    out = N.extend_candidates(one, reads).collect()
    texts = {r.read_id: r.seq for r in reads.collect()}
    turn = str.maketrans("ACGT", "TGCA")
    for r in out:
        q = texts[r.qid][::-1].translate(turn) if r.qdir else texts[r.qid]
        assert r.q_aln.replace("-", "") == q[r.qbeg : r.qend] and r.s_aln.replace("-", "") == texts[r.sid][r.sbeg : r.send] and r.identity > 88
    assert {(r.qid, r.sid, r.qdir) for r in out} >= true


def test_trimming_by_consensus(spark):
    text = planted.genome(3000)
    rows = planted.sample(text, 1200, 150, 0.0)
    reads = planted.reads(spark, rows).select("read_id", "seq")
    overlaps = planted.true_overlaps(spark, rows, 600)
    ranges = spark.createDataFrame([(5, 100, 1100)], "read_id long, left long, right long")
    got = N.trim_by_consensus(overlaps, ranges, reads).collect()
    assert [r.template for r in got] == [5] and got[0].seq in rows[5][1] and len(got[0].seq) >= 900


def test_bubble_branches(spark):
    a = planted.genome(2500, 11)
    near = planted.noisy(a, 0.01, np.random.default_rng(2))
    rows = [(1, 0, a), (1, 1, near), (1, 2, planted.genome(2500, 12)), (2, 0, a), (2, 1, near), (3, 0, a), (3, 1, "ACGT" * 100)]
    got = N.bubble_branches(spark.createDataFrame(rows, "bubble long, rank int, seq string")).collect()
    assert sorted((r.bubble, r["rank"]) for r in got) == [(1, 0), (1, 2)]


def test_polishing_mends_a_planted_draft(spark):
    text = planted.genome(3000)
    draft = planted.noisy(text, 0.01, np.random.default_rng(9))
    reads = planted.reads(spark, planted.sample(text, 1500, 100, 0.02)).select("read_id", "seq")
    target = spark.createDataFrame([(0, draft)], "read_id long, seq string")
    mapped = N.chain_best(kmers.reference_seeds(reads, target, 15, 5, 500), least_seeds=3)
    got = N.polish(mapped, target, reads).collect()
    like = lambda x: K.identity(*K.align(x.upper(), text)[1:])
    assert [r.read_id for r in got] == [0] and like(got[0].seq) > like(draft)
