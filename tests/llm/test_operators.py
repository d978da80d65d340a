"""Each operator against a brute-force version, and on the cases its docstring defines."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import ann, components, hnsw, licenses, linededup, minhash, mixing, packing, quality, repeats, scratch, suffixsort, textkernels, vectors, warc
from helixframe.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, lang string, n_chars long, id string, keep string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, odd and empty texts, and columns whose names clash with the operators' own."""
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(20, 200)) for _ in range(60)]
    base = words(rng, 300, 10_000)
    for k in range(25):
        w = base.split()
        w[(k * 11) % 300] = f"x{k}"
        texts.append(" ".join(w))
    texts += [base] * 5 + [None, "", "  \n\t ", "one", "a b c", "ä Ö ß ĳ 字 字 字 字", "boilerplate line of the site\n" + words(rng, 30), words(rng, 5000)]
    texts += [f"boilerplate line of the site\n{words(rng, 20)}\n\nboilerplate line of the site" for _ in range(12)]
    texts += ["á   x y <|endoftext|> <|EndOfText|> it's 12.5", "same " * 400]
    return [(i * 3 % 997, t, f"s{i % 12}" if i % 13 else None, "en" if i % 5 else None, None, "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


def empty(docs):
    return docs.limit(0)


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = ["The cat  the\tCAT", None, "", "été the", "x" * 50]
    seen = {}
    for a, _, data, w in textkernels.word_blocks(pa.array(texts), textkernels.BY_SPACE):
        for s, e, h in zip(w.start, w.end, w.hash, strict=True):
            seen.setdefault(bytes(data[s:e]).lower(), set()).add(int(h))
        assert a == 0 and np.diff(w.first).tolist() == [4, 0, 0, 2, 1]
    assert all(len(v) == 1 for v in seen.values()) and len({h for v in seen.values() for h in v}) == len(seen)


def doubled(x: str, y: str, times: int = 4) -> tuple[str, str]:
    """Thue-Morse words over two blocks: polynomial sums modulo a power of two give both one value."""
    for _ in range(times):
        x, y = x + y, y + x
    return x, y


def test_words_of_all_lengths_and_patterns_are_told_apart():
    rng = random.Random(1)
    own = {"".join(rng.choice("ab") for _ in range(n)) for n in range(1, 200) for _ in range(20)} | set(doubled("3j.?", "6-,8")) | set(doubled("^@(w", "xl:[", 7))
    text = " ".join([*own, *own])
    data = np.frombuffer(text.encode(), np.uint8)
    w = textkernels.Words(np.array([0, 0, len(data), len(data)]), data, textkernels.BY_SPACE, True, 2)
    assert w.first.tolist() == [0, 0, 2 * len(own), 2 * len(own)]
    for h in (w.hash, w.hash2):
        assert len(set(h.tolist())) == len(own) and (h[: len(own)] == h[len(own) :]).all()


def test_what_polynomials_confuse_is_told_apart(spark):
    from tokenizers import Tokenizer

    x, y = doubled("3j.?", "6-,8")
    rows = packing.pack(spark, spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string"), tokenizer_path()).collect()
    t = Tokenizer.from_file(tokenizer_path())
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: zlib.crc32(np.array([*t.encode(w, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, w in ((1, x), (2, y))}
    x, y = doubled("^@(w", "xl:[")
    out = minhash.near_duplicates(spark, spark.createDataFrame([(1, x), (2, y), (3, x.upper())], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2, 3: 1}
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh") for _ in range(112))
    x, y = doubled("3j.?", "6-,8")
    out = repeats.remove_repeats(spark, spark.createDataFrame([(1, x + shared), (2, y + shared)], "doc_id long, text string"), 100).collect()
    # of what stands before the shared bytes, as much as both end alike
    alike = next(k for k in range(64) if x[63 - k] != y[63 - k])
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 112 + alike}


def test_words_that_one_lane_confuses_go_by_their_bytes(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["alpha beta alpha", "", "gamma beta alpha delta"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    own = packing.WordTokens(t.to_str())
    want = [i for x in texts for i in (*t.encode(x, add_special_tokens=False).ids, 0)]
    for bits in (64, 1, 0, 64):  # what is left of the first lane
        w = textkernels.Words(offsets, data, textkernels.BY_SPACE, False, 2)
        w.hash = w.hash & np.uint64(2**bits - 1)
        ids, ends = own.block(data, w)
        assert ids.tolist() == want and [want[a:b][-1:] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [[0]] * 3


def test_sets_agree_in_both_lanes_or_not_at_all():
    a, b = np.array([[1, 5], [2, 6]], np.uint64), np.array([[1, 5], [2, 7]], np.uint64)
    x, y = minhash.numbered([a.tobytes(), b.tobytes()])
    assert len(np.intersect1d(x, y)) == 1 and minhash.similar(x, [y, x], 50).tolist() == [False, True]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(50)], "a long, b long")
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(51)}
    got = components.components(spark, links, scratch.Scratch(spark, "t"))
    assert dict(map(tuple, got.collect())) == want
    whole, components.FOREST_BLOCK = components.FOREST_BLOCK, 3  # the star rounds too
    try:
        got = components.components(spark, links.repartition(5), scratch.Scratch(spark, "t"))
        assert dict(map(tuple, got.collect())) == want
    finally:
        components.FOREST_BLOCK = whole


@pytest.mark.parametrize("shard_rows", [2048, 40])
def test_embedding_links(spark, shard_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 16))
    x[50:90] = x[0] + rng.normal(size=(40, 16)) * 0.1
    x[90:100] = x[1]
    rows = [(i, v.tolist(), int(i % 2), "c") for i, v in enumerate(x.astype(np.float32))]
    rows += [(200, None, 0, "c"), (201, [0.0] * 16, 0, "c"), (202, [float("nan")] * 16, 0, "c"), (203, x[0].tolist(), None, "c"), (204, [], 1, "c"), (205, [1.0, None], 1, "c"), (206, [1.0, 2.0], 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, copies string")
    got = {r.vec_id: r for r in vectors.near_duplicates(spark, df, 0.93, shard_rows).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (np.arange(150)[:, None] % 2 == np.arange(150) % 2)
    np.fill_diagonal(link, False)
    low, at = components.label_min(*np.nonzero(link))
    want = dict(zip(low.tolist(), at.tolist(), strict=True))
    for i in range(150):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), want.get(i, i), want.get(i, i) == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 207))
    assert vectors.near_duplicates(spark, df.limit(0)).count() == 0


def test_embeddings_with_repeated_ids(spark):
    """Rows that repeat an id with another label or vector are vectors of their own, and tie no labels together."""
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 1e-3]
    rows = [(9, a, 0), (9, a, 1), (4, c, 0), (7, c, 1), (7, c, 1), (9, b, 0), (2, b, 0), (None, a, 0), (3, [float("inf"), 1.0], 0)]
    got = sorted((tuple(r) for r in vectors.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    want = [(9, 1, 4, False), (9, 2, 7, False), (4, 1, 4, True), (7, 2, 7, True), (7, 2, 7, True), (9, 1, 2, False), (2, 1, 2, True), (None, 0, None, True), (3, 0, 3, True)]
    assert got == sorted(want, key=str)


def test_shared_folders(spark, monkeypatch):
    s = scratch.Scratch(spark, "gone")
    kept = s.keep(spark.range(5), "x")
    assert kept.count() == 5 and scratch.clear(spark) >= 1
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|PATH_NOT_FOUND"):
        spark.read.parquet(kept._helixframe_path).count()
    assert scratch.clear(spark) == 0


def test_graph_finds_neighbours():
    x = np.random.default_rng(2).normal(size=(1500, 24)).astype(np.float32)
    g = hnsw.Graph(x)
    ids, _ = hnsw.Graph.from_bytes(g.to_bytes(), x).search(x[:100], 64)
    d = ((x[:100, None] - x[None]) ** 2).sum(2)
    assert np.mean([len(set(np.argsort(d[i])[:10]) & set(ids[i][:10])) / 10 for i in range(100)]) > 0.95


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[300:420] = x[5]  # one vector that is very common
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(spark, df, df.where("vec_id % 20 = 0"), 10).collect()
    y, hits = x.astype(float), 0
    for i in range(0, 700, 20):
        d = np.sqrt(((y - y[i]) ** 2).sum(1))
        d[i] = np.inf
        want = np.lexsort((np.arange(700), d))[:10].tolist()
        own = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        hits += len(set(want) & {r.vec_id for r in own})
    assert hits >= 0.9 * 350 and not {r.query_id for r in got} & {1000, 1001}
    assert ann.search(spark, df, df.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = (scratch.table(spark, sf_dir, n) for n in ("documents", "labels"))
    out = quality.classify(spark, docs).join(labels, "doc_id")
    n = {(r.quality, r.keep): r["count"] for r in out.groupBy("quality", "keep").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] + 1
    assert n.get((0, True), 0) <= 0.25 * n[0, False] + 2


def test_quality_edges(spark, docs):
    out = quality.classify(spark, docs)
    same = {}
    for r in out.collect():
        same.setdefault(r.text, set()).add((r.posterior, r.score, r.keep))
    assert all(len(v) == 1 for v in same.values())
    assert out.count() == docs.count() and set(docs.columns) - {"keep"} <= set(out.columns)
    assert not out.where("text is null").first().keep
    assert quality.classify(spark, empty(docs)).count() == 0


def test_label_model_recovers_rates_with_the_settings_of_production():
    """Three kinds of junk, labellers that overlap, and an eighth of the votes missing."""
    rng = np.random.default_rng(0)
    n, seen = 20_000, np.zeros((4, 10))
    seen[0, [0, 2, 5, 6]], seen[1, [1, 3, 6, 9]], seen[2, [2, 4, 7, 8]] = (0.9, 0.3, 0.8, 0.7), (0.95, 0.6, 0.8, 0.5), (0.7, 0.9, 0.6, 0.5)
    rates = np.where(seen > 0, seen, 0.02)
    rates[3] = [0.001, 0.002, 0.03, 0.01, 0.001, 0.004, 0.02, 0.05, 0.001, 0.002]
    of = rng.choice(4, n, p=[0.06, 0.03, 0.08, 0.83])
    v = np.where(rng.random((n, 10)) < rates[of], quality.BAD, quality.GOOD)
    v[rng.random((n, 10)) < 0.125] = quality.ABSTAIN
    pattern, counts = np.unique(v, axis=0, return_counts=True)
    m = quality.expectation_maximisation(pattern, counts.astype(float))
    got = np.exp(m.log)[:, :, quality.BAD]
    assert np.allclose(got[-1], rates[3], atol=0.01) and abs(np.exp(m.log_prior[-1]) - 0.83) < 0.02
    best = quality.LabelModel(np.log(np.stack([np.ones_like(rates), rates, 1 - rates], 2)), np.log([0.06, 0.03, 0.08, 0.83])).posterior(v)
    q = m.posterior(v)
    assert ((q < 0.5) == (best < 0.5)).mean() > 0.99 and ((q < 0.5) == (of < 3)).mean() > 0.98
    # marginal rates on junk, and how often a labeller is right
    bad = np.exp(m.log_prior[:-1]) @ got[:-1] / np.exp(m.log_prior[:-1]).sum()
    assert np.allclose(bad, np.array([6, 3, 8]) / 17 @ rates[:3], atol=0.05)
    right = np.array([((v[:, k] == quality.BAD) == (of < 3))[v[:, k] > 0].mean() for k in range(10)])
    assert np.allclose(m.accuracies(), right, atol=0.02)


def test_quality_trains_on_distinct_texts(spark, corpus, monkeypatch):
    """One text that stands in nearly all rows is one example of the bounded sample."""
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda rows: (seen.append(len(rows)), train(rows))[1])
    rng = random.Random(2)
    rows = [(i, "one text of many copies. " * 3) for i in range(20_000)] + [(i, None) for i in range(50)] + [(30_000 + i, words(rng, 40) + ".") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    quality.fit(spark, df, train_rows=4000)
    quality.fit(spark, df, train_rows=100)
    assert 250 <= seen[0] <= 302 and seen[1] <= 100 and seen[1] >= 60


def test_scores_are_those_of_each_text_alone(monkeypatch):
    """Against sums over each text, with parts far smaller than the texts."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["", "ab", "abc", "# " * 70, words(random.Random(1), 300), "é" * 60]
    w = rng.normal(size=quality.BUCKETS)
    want = []
    for x in texts:
        d = np.frombuffer(x.encode(), np.uint8)
        m = quality.measures(np.array([0, len(d)]), d)
        grams = quality._buckets(d)
        z = 0.3 + quality.TRIGRAM_SCALE * w[grams].sum() / (len(grams) + quality.CALM) + w[quality._flags(m)].sum()
        want.append(1 / (1 + np.exp(-z)))
    for most in (textkernels.BLOCK_BYTES, 16):
        monkeypatch.setattr(textkernels, "BLOCK_BYTES", most)
        offsets, data = textkernels.text_buffers(pa.array(texts))
        got = []
        for a, b in textkernels.blocks(offsets, most):
            o, d = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
            got += quality.scores(w, 0.3, o, d, quality.measures(o, d)).tolist()
        assert np.allclose(got, want)


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    long_ = "<p>" + "ä" * 200
    rows = [(5, "http://a\r\nX: y", long_, 1), (3, "http://b", long_, 1), (9, None, long_, 1), (1, "http://c", "short", 1), (2, "http://d", "short", 1), (4, "http://e", None, 1), (6, "u", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    got = {r.page_id: r for r in warc.round_trip(spark, df).collect()}
    for i, _, html, _ in rows:
        body = (html or "").encode()
        again = i in (5, 9)
        assert tuple(got[i]) == (i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 3 if again else None)
    where = f"file://{tmp_path}/w"
    warc.with_roles(df, scratch.Scratch(spark, "t")).write.format("warc").mode("append").save(where)
    read = spark.read.format("warc").load(where)
    assert read.where("record_type = 'revisit'").count() == 2 and read.where("target_uri like 'http://b%'").first().payload == long_.encode()
    assert spark.read.format("warc").option("payload", "false").load(where).where("payload is not null").count() == 0
    plain = b"".join(warc.build_record({"record_type": "response", "payload": p}) for p in (b"one", b"", b"three\r\n\r\n"))
    (tmp_path / "x.warc").write_bytes(plain)
    import gzip

    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(plain))
    for name in ("x.warc", "y.warc.gz"):
        assert [r.payload for r in spark.read.format("warc").load(f"{tmp_path}/{name}").collect()] == [b"one", b"", b"three\r\n\r\n"]
    lower = plain.replace(b"WARC-Type", b"warc-type").replace(b"Content-Length", b"content-LENGTH").replace(b"WARC-Date: ", b"x-tag: a\r\nX-Tag: b\r\nwarc-date: ")
    (tmp_path / "z.warc").write_bytes(lower)
    found = spark.read.format("warc").load(f"{tmp_path}/z.warc").where("record_type = 'response'").collect()
    assert [r.payload for r in found] == [b"one", b"", b"three\r\n\r\n"] and {r.headers["x-tag"] for r in found} == {"a, b"}
    # what was read is written again without a header twice
    spark.read.format("warc").load(f"{tmp_path}/z.warc").write.format("warc").mode("append").save(f"file://{tmp_path}/again")
    assert sorted((r.record_type, r.payload, r.headers["x-tag"]) for r in spark.read.format("warc").load(f"file://{tmp_path}/again").collect()) == [("response", p, "a, b") for p in (b"", b"one", b"three\r\n\r\n")]
    assert warc.round_trip(spark, df.limit(0)).count() == 0
    # an id that repeats, none, and an attempt that fails
    odd = spark.createDataFrame([(1, "u", long_), (1, "u", long_), (None, "v", long_), (None, None, None)], "page_id long, url string, html string")
    assert warc.round_trip(spark, odd).count() == 4
    with pytest.raises(Exception, match="(?i)no such|divide|zero|raise"):
        df.selectExpr("'response' as record_type", "raise_error('no such row') as payload").coalesce(1).write.format("warc").mode("append").save(f"file://{tmp_path}/failed")
    import os

    assert not os.path.isdir(tmp_path / "failed") or not os.listdir(tmp_path / "failed")


def brute_mix(corpus, power, fraction):
    """Probability by row: cells in plain Python, one-value-at-a-time limits, and raking until nothing moves."""
    def topic(t):
        t = t or ""
        return "empty" if not t.strip(" ") else "legal" if " license" in t.lower() else "contact" if "@" in t or "://" in t else "long" if len(t) >= 8000 else "note" if len(t) < 600 else "prose"

    keys = [(s or "", lang or "", topic(t)) for _, t, s, lang, *_ in corpus]
    tokens = {}
    for k, (_, t, *_) in zip(keys, corpus, strict=True):
        tokens[k] = tokens.get(k, 0) + len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))
    total = sum(tokens.values())
    goals = []
    for m in range(3):
        have = {}
        for k, n in tokens.items():
            have[k[m]] = have.get(k[m], 0) + n
        want = {v: n**power for v, n in have.items() if n}
        scale = fraction * total / sum(want.values())
        low, high = 0.0, 1e6 * scale
        for _ in range(300):  # the level at which the capped targets fill the budget
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(have[v], mid * x) for v, x in want.items()) < fraction * total else (low, mid)
        goals.append({v: min(have[v], high * x) for v, x in want.items()})
    w = {k: fraction * n for k, n in tokens.items()}
    for _ in range(5000):
        for m in range(3):
            now = {}
            for k, x in w.items():
                now[k[m]] = now.get(k[m], 0) + x
            w = {k: min(tokens[k], x * goals[m].get(k[m], 0) / now[k[m]] if now[k[m]] else 0) for k, x in w.items()}
    return [w[k] / tokens[k] if tokens[k] else 1.0 for k in keys], goals


def test_mixing(spark, docs, corpus):
    for fraction in (0.5, 0.9):
        want, goals = brute_mix(corpus, 0.8, fraction)
        out = mixing.mix(spark, docs, fraction=fraction).collect()
        got = {(r.doc_id, r.text): r for r in out}
        assert len(out) == len(corpus)
        for (i, t, *_), p in zip(corpus, want, strict=True):
            assert abs(got[i, t].probability - p) < 1e-5, (i, got[i, t].probability, p)
        mass = sum(r.probability * r.n_tokens for r in out)
        assert fraction > 0.5 or abs(mass - sum(goals[0].values())) < 1e-3 * mass
    assert mixing.mix(spark, empty(docs)).count() == 0


def test_both_forms_of_raking_agree(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing.rake, "__defaults__", (3, 1e-9))
    monkeypatch.setattr(mixing.rake_table, "__defaults__", (3, 1e-9))
    targets = {"source": {f"s{i}": (i + 1) / 78 for i in range(12)}, "lang": {"en": 0.7, "": 0.3}}
    with pytest.warns(UserWarning, match="can't be met"):
        a, b = ({(r.doc_id, r.text): r.probability for r in mixing.mix(spark, docs, targets, fraction=0.5, driver_cells=n).collect()} for n in (mixing.DRIVER_CELLS, 0))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_mixing_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "x", "en"), (1, "a b c", "x", "en"), (None, "d e", None, None), (None, "d e", None, None), (2, None, "y", "en")] * 3
    out = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), fraction=0.5).collect()
    assert len(out) == 15 and len({(r.doc_id, r.selected) for r in out}) == 3 and all(r.probability == 1 for r in out if r.doc_id == 2)


def test_small_values_give_all_they_have():
    have = np.array([10.0, 90.0, 0.0, 100.0])
    assert np.allclose(mixing.attainable(have, np.array([0.25, 0.25, 0.25, 0.25]), 100.0), [0.1, 0.45, 0, 0.45])
    assert np.allclose(mixing.attainable(have, np.array([0.05, 0.45, 0, 0.5]), 100.0), [0.05, 0.45, 0, 0.5])
    assert np.allclose(mixing.attainable(have, np.array([0.5, 0.5, 0.0, 0.0]), 180.0) * 180, [10, 90, 0, 0])


def test_rake_meets_targets():
    rng = np.random.default_rng(5)
    tokens = rng.integers(100, 1000, 24).astype(float)
    of = [np.arange(24) % 4, np.arange(24) // 12]
    want = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.6, 0.4])]
    w = mixing.rake(tokens, of, want, 2000.0, turns=200)
    assert (w <= tokens + 1e-9).all()
    for g, t in zip(of, want, strict=True):
        assert np.allclose(np.bincount(g, w) / 2000, t, atol=1e-6)


def test_boilerplate_lines(spark, docs, corpus):
    got = {(r.doc_id): r for r in linededup.remove_boilerplate(spark, docs, 4).collect()}
    sites = {}
    for _, t, s, *_ in corpus:
        for line in (t or "").split("\n"):
            sites.setdefault(line, set()).add(s)
    bad = {x for x, s in sites.items() if x.strip(" ") and len(s - {None}) >= 4}
    assert "boilerplate line of the site" in bad
    for i, t, *_ in corpus:
        kept = [x for x in (t or "").split("\n") if x not in bad]
        n = len((t or "").split("\n"))
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == (None if t is None else "\n".join(kept), n, n - len(kept))
    assert linededup.remove_boilerplate(spark, empty(docs)).count() == 0


def test_boilerplate_lines_in_lanes(spark, docs, monkeypatch):
    """Too many lines to broadcast: the same rows, and no broadcast of lines."""
    rows = lambda: sorted(map(tuple, linededup.remove_boilerplate(spark, docs, 4).select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr)
    want = rows()
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    assert rows() == want


def test_boilerplate_of_null_and_repeated_ids_and_long_texts(spark):
    long = "\n".join(f"own line {i}" for i in range(20_000))
    rows = [(None, "nav\nown a", f"s{i}") for i in range(3)] + [(7, "nav\nown b", "s9")] * 2 + [(8, f"nav\n{long}", "s8"), (9, None, None)]
    out = linededup.remove_boilerplate(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), 4).collect()
    assert sorted((r.doc_id or 0, r.n_removed, len(r.text or "")) for r in out) == [(0, 1, 5)] * 3 + [(7, 1, 5)] * 2 + [(8, 1, len(long)), (9, 0, 0)]


def test_packing(spark, docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(spark, docs, tokenizer_path(), 128, 256).collect()
    want = {}
    for i, text, *_ in corpus:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 128):
            want[i, k // 128] = (k, len(ids[k : k + 128]), zlib.crc32(ids[k : k + 128].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 128
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 128) + 2
    assert packing.pack(spark, empty(docs), tokenizer_path()).count() == 0


def test_packing_of_repeated_rows_null_ids_and_a_long_text(spark):
    long_ = " ".join(f"w{i % 5000}" for i in range(150_000))  # several parts of a block
    from tokenizers import Tokenizer

    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, long_), (3, "")]
    out = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    ids = [*Tokenizer.from_file(tokenizer_path()).encode(long_, add_special_tokens=False).ids, 0]
    own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 2)
    assert own == [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sum(r.doc_id == 1 for r in out) == 2 and sum(r.doc_id is None for r in out) == 2
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) == packing.lower_bound(np.array([r.length for r in out]), 2048)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 40))
        _, _, bins = packing.best_fit_decreasing(x, 100)
        assert -(-x.sum() // 100) <= packing.lower_bound(x, 100) <= bins
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3 and packing.lower_bound(np.array([], int), 100) == 0


def test_licences(spark):
    texts = [
        (1, "Released under the MIT License. Apache license!"), (2, "LICENSED under the GNU General-Public License, version 3, x"), (3, "mit licensed"), (4, None), (5, ""),
        (6, "Licensed under the Apache License, Version 2.0"), (7, "Licensed under CC BY-NC 4.0"), (8, "mit mit license license"),
        (9, "permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the software), to deal in the software without restriction"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache,mit,mit-notice" and (got[1].n_base, got[1].first_word, got[1].last_word, got[1].score) == (2, 3, 5, 1.0)
    assert got[2].labels == "gpl,gpl-notice" and got[6].labels == "apache,apache-2.0-notice" and got[7].labels == "cc-notice" and got[9].labels == "mit-grant"
    assert (got[3].n_base, got[3].score, got[4].n_words, got[5].labels) == (0, 0.0, 0, "") and (got[8].first_word, got[8].score) == (1, 0.5)


MIT = """Copyright (c) 2019 Jane Doe and contributors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright 2001 The Regents. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = " 3. Neither the name of the Regents nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_whole_licence_texts(spark):
    """Whole texts are accepted; one mandatory word changed or left out anywhere, and they are not."""
    rng = random.Random(0)
    rows, want = [(0, "see below\n" + MIT + "\nthe end"), (1, BSD.format(third="")), (2, BSD.format(third=THIRD))], {0: "mit-text", 1: "bsd-2-clause", 2: "bsd-3-clause"}
    body = MIT[MIT.index("Permission") :].split()
    fixed = [i for i, w in enumerate(body) if re.fullmatch(r"[A-Za-z]+", w) and w.lower() not in ("software", "files", "the", "authors", "or", "copyright", "holders")]
    for k in range(40):
        broken = list(body)
        i = rng.choice(fixed)
        broken[i : i + 1] = [] if k % 2 else ["other"]
        rows.append((100 + k, " ".join(broken)))
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in want.items():
        assert name in got[i] and not got[i] & (set(want.values()) - {name})
    assert not any("mit-text" in got[i] for i in got if i >= 100)


def test_base_columns_equal_a_regular_expression(spark, docs, corpus, sf_dir):
    """Places of the phrases, found another way: a pattern over the whole lower-cased text."""
    rows = [(r.doc_id, r.text) for r in scratch.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows += [(None, "MIT License"), (7, "MIT License"), (7, "MIT License"), (8, "mit-license\u00e9 mit\u00a0license Mit\nLicense 3mit license"), (9, "General, Public -- LICENSE general public license"), (10, None)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, labels string, n_words string")
    out = licenses.scan(df).collect()
    assert len(out) == len(rows) and licenses.scan(df.limit(0)).count() == 0
    want = []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = "[0-9a-z\u0080-\U0010ffff]"
    gap = "[^0-9a-z\u0080-\U0010ffff]+"
    for i, t in rows:
        t = (t or "").translate(lower)
        starts = [m.start() for m in re.finditer(f"(?<!{word}){word}+", t)]
        places, labels = [], set()
        for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
            for m in re.finditer(f"(?<!{word})(?={gap.join(phrase.split())}(?!{word}))", t):
                places.append(starts.index(m.start()))
                labels.add(label)
        want.append((i, len(starts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)


def brute_components(corpus, percent):
    sets = {}
    for i, t, *_ in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    a, b = [], []
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a.append(x)
                b.append(y)
    v, low = components.label_min(np.array(a), np.array(b))
    return {i: len(s) for i, s in sets.items()}, dict(zip(v.tolist(), low.tolist(), strict=True))


@pytest.mark.parametrize("tight", [False, True])
def test_near_copies(spark, docs, corpus, tight, monkeypatch):
    if tight:  # large nodes, blocks and branching on small data
        monkeypatch.setattr(minhash, "BRANCH", 2)
        monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
        monkeypatch.setattr(minhash.candidates, "__defaults__", (minhash.RECALL, 4, minhash.DEPTH))
        monkeypatch.setattr(minhash.verify, "__defaults__", (4,))
    size, low = brute_components(corpus, 85)
    got = minhash.near_duplicates(spark, docs, 85).collect()
    assert len(got) == len(corpus)
    for r in got:
        c = low.get(r.doc_id, r.doc_id)
        assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], c, c == r.doc_id)
    if not tight:
        assert minhash.near_duplicates(spark, empty(docs)).count() == 0


def test_near_copies_among_repeated_and_null_ids(spark):
    """Rows that repeat an id share the component of its smallest link; a row without an id is kept and links with nothing."""
    rng = random.Random(4)
    a, b = words(rng, 60, 10_000), words(rng, 60, 10_000)
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (None, a), (None, None), (7, ""), (7, a)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, df).collect()), key=str)
    assert got == sorted([(5, 56, 3, False), (5, 56, 5, True), (3, 56, 3, True), (9, 56, 5, False), (None, 56, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 56, 3, False)], key=str)


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_branching_keeps_the_target_recall(spark, monkeypatch, threshold):
    """Pairs at the threshold among documents that all share one node of a tree, which branches."""
    p = minhash.survival(threshold, threshold, 1)
    assert 1 - (1 - p) ** minhash.branches_for(minhash.RECALL, threshold) >= 1 - (1 - minhash.RECALL) / 10
    rng = np.random.default_rng(8)
    n, pairs = 1500, 500
    own = rng.integers(0, 2**32 - 1, (2 * n, minhash.PLACES), dtype=np.uint32)
    own[n : n + pairs] = np.where(rng.random((pairs, minhash.PLACES)) < threshold, own[:pairs], own[n : n + pairs])
    rows = [(7, i, own[i].tobytes()) for i in range(n + pairs)]
    df = spark.createDataFrame(rows, "key long, id long, signature binary")
    out = minhash.branch(df, threshold, minhash.branches_for(minhash.RECALL, threshold)).select("key", "id").collect()
    nodes = {}
    for r in out:
        nodes.setdefault(r.key, set()).add(r.id)
    met = {(a, b - n) for ids in nodes.values() for a in ids for b in ids if a < n <= b and b - n == a}
    assert len(met) >= pairs - 2 and len(out) < 12 * len(rows)


def test_suffix_arrays():
    rng = np.random.default_rng(7)
    for k in range(60):
        t = np.repeat(rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 50))), rng.integers(1, 4)).astype(np.uint16)
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        common = [0]
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            common.append(n)
        store = None
        if k % 3 == 0:
            import tempfile

            store = suffixsort.Folder("file://" + tempfile.mkdtemp())
        sa, lcp = suffixsort.suffix_array(t, budget=5 if store else 1 << 20, store=store)
        assert sa.tolist() == order and lcp.tolist() == common


def test_repeated_strings(spark, docs, corpus):
    got = {r.doc_id: r for r in repeats.remove_repeats(spark, docs, 100, text=True).collect()}
    seen = set()
    for i, t, *_ in sorted(corpus, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) > 0).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()) and got[i].kept == left
    assert repeats.remove_repeats(spark, empty(docs)).count() == 0


def test_line_query_has_no_python(spark, docs):
    plan = linededup.remove_boilerplate(spark, docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_templates_that_are_wrong():
    with pytest.raises(ValueError):
        licenses.compile_template("a <<beginOptional>> b")
    with pytest.raises(ValueError):
        licenses.compile_template("<<var;min=1;max=2>> b").first_words()


def expected_repeats(rows):
    """doc_id to (bytes removed, what is kept), for ids in order."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        out[i] = (int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_shards_sort_on_disk_with_the_settings_of_production(spark, tmp_path, monkeypatch):
    """A shard of SHARD_BYTES has more tuples than the queues hold, so they go to the shared folder and come back."""
    rng = random.Random(12)
    alphabet = "abcdefghijklmnop "
    passages = ["".join(rng.choices(alphabet, k=139)) for _ in range(repeats.SHARD_BYTES // 140 // 2)]
    texts = [p.encode() for p in passages] * 2
    doc, at = np.arange(len(texts)), np.full(len(texts), 40)
    wrote = []

    class Watched(suffixsort.Folder):
        def write(self, position, prefix):
            wrote.append(len(position))
            return super().write(position, prefix)

    assert repeats.QUEUE_TUPLES * 4 <= repeats.SHARD_BYTES
    got = repeats.shard_repeats(doc, at, texts, 100, repeats.QUEUE_TUPLES, Watched(f"file://{tmp_path}/q"))
    assert sum(wrote) > repeats.QUEUE_TUPLES
    assert got[0].tolist() == list(range(len(passages), len(texts))) and (got[1] == 40).all()
    assert suffixsort.folder("nowhere://x/y") is None


@pytest.mark.parametrize("looked", [1, 64])
def test_common_anchors_meet_by_content(spark, monkeypatch, looked):
    monkeypatch.setattr(repeats, "LOOKED_AT", looked)
    monkeypatch.setattr(repeats, "COMMON", 3)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 140 * 8)
    rng = random.Random(11)
    shared = words(rng, 80)
    rows = [(i, words(rng, rng.randrange(1, 30)) + shared[rng.randrange(60) :][: rng.randrange(100, 300)] + words(rng, 10)) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.kept) for r in repeats.remove_repeats(spark, docs, 100, text=True).collect()}
    assert got == expected_repeats(rows)


def test_repeats_of_an_anchor_with_more_segments_than_a_shard_holds(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    heads = ["".join(rng.choices("abcdefgh ", k=90)) for _ in range(repeats.SHARD_BYTES // 140 + 2500)]

    def share(passage):
        """Of some documents, those with a segment of their own under the passage's commonest anchor."""
        found = set()
        for x in heads[:100]:
            b = np.frombuffer((x + passage).encode(), np.uint8)
            found |= set(zip(*(v.tolist() for v in repeats.segments(np.array([0, len(b)]), b, 100)[3:]), strict=True))
        return max(np.unique([h for h, *_ in found], return_counts=True)[1])

    passage = max((words(rng, 30) for _ in range(150)), key=share)
    rows = [(i, x + passage) for i, x in enumerate(heads)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = []
    cut = repeats.sort_shards

    def spy(rows, *a, **b):
        sizes.append(rows.groupBy("h").count().agg({"count": "max"}).first()[0] or 0)
        return cut(rows, *a, **b)

    monkeypatch.setattr(repeats, "sort_shards", spy)
    got = {r.doc_id: (r.n_removed, r.kept) for r in repeats.remove_repeats(spark, docs, 100, text=True).collect()}
    assert got == expected_repeats(rows)
    assert share(passage) >= 90 and max(sizes) <= repeats.SHARD_BYTES // 140


@pytest.mark.parametrize(("splits", "looked"), [(0, 64), (1, 1), (3, 64)])
def test_crowded_anchors_are_split_and_texts_cut_once(spark, monkeypatch, splits, looked):
    """However many anchors are crowded, texts are shuffled for their bytes once, and few strings go by digests."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 140 * 20)
    monkeypatch.setattr(repeats, "SPLITS", splits)
    monkeypatch.setattr(repeats, "LOOKED_AT", looked)
    monkeypatch.setattr(repeats, "COMMON", 10)
    rng = random.Random(13)
    phrases = [words(rng, 5) + "é " for _ in range(3)]  # in many contexts, two of which are alike
    rows = [(i, "".join(words(rng, 12) + rng.choice(phrases) + words(rng, 12) for _ in range(3))) for i in range(150)]
    rows += [(200 + i, words(rng, 3) + rows[i][1][40:-40] + words(rng, 3)) for i in range(20)]
    passage = words(rng, 40)
    rows += [(300 + i, words(rng, 4) + passage + words(rng, 4)) for i in range(80)]
    cuts, digested = [], []
    cut_out, strings = repeats.cut_out, repeats.strings
    monkeypatch.setattr(repeats, "cut_out", lambda docs, wanted, span: cuts.append(wanted.count()) or cut_out(docs, wanted, span))
    monkeypatch.setattr(repeats, "strings", lambda rows, span: digested.append(rows.selectExpr("coalesce(sum(at & 255), 0)").first()[0]) or strings(rows, span))
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.kept) for r in repeats.remove_repeats(spark, docs, 100, text=True).collect()}
    assert got == expected_repeats(rows)
    assert len(cuts) == 1
    assert sum(digested) < {0: 9000, 1: 7500, 3: 4000}[splits]


def test_shard_sort_with_queues_smaller_than_the_shard(spark, tmp_path):
    rng = random.Random(9)
    passage = words(rng, 40)
    rows = [(1, i, (i << 8) | 40, (words(rng, 30)[: rng.randrange(10, 60)] + passage)[:139].encode()) for i in range(2000)]
    df = spark.createDataFrame(rows, "h long, doc long, at long, bytes binary").coalesce(1).sortWithinPartitions("h", "doc", "at")
    got, want = (sorted(map(tuple, repeats.sort_shards(df, 100, f"file://{tmp_path}/{q}", queue=q).collect())) for q in (20_000, 1 << 30))
    assert got == want and len(want)


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_rows_keep_what_starts_in_them_first(spark, monkeypatch, parts):
    rng = random.Random(10)
    shared = words(rng, 60)
    rows = [(i, words(rng, 30) + shared[rng.randrange(20) :] + words(rng, 30)) for i in range(20)]
    docs = spark.createDataFrame(rows[:8] + rows + rows[4:], "doc_id long, text string").repartition(parts)
    want = expected_repeats(rows)
    other = [(3, words(rng, 25) + shared), (3, shared), (17, None), (None, shared), (None, None)]  # other texts under ids that repeat, and no ids
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept) for r in repeats.remove_repeats(spark, docs.unionByName(spark.createDataFrame(other, docs.schema)), 100, text=True).collect()}
    texts = {3: sorted([rows[3][1], other[0][1], shared], key=lambda t: spark.range(1).selectExpr(f"xxhash64('{t}')").first()[0])}
    flat = [((i, j), t) for i, own in rows for j, t in enumerate(texts.get(i, [own]))]
    for (i, _), (t, w) in zip([k for k, _ in flat], [(t, expected_repeats(flat)[k]) for k, t in flat], strict=True):
        assert got[i, len(t.encode())] == w
    assert got[17, 0] == (0, b"") and got[None, len(shared)] == (0, shared.encode())
    for most in (repeats.SHARD_BYTES, 140 * 5):
        monkeypatch.setattr(repeats, "SHARD_BYTES", most)
        got = repeats.remove_repeats(spark, docs, 100, text=True).collect()
        assert len(got) == 44 and all((r.n_removed, r.kept) == want[r.doc_id] for r in got)


@pytest.mark.parametrize("first", [4, 2048])
def test_nearest_through_lists_of_lists(spark, monkeypatch, first):
    """Lists clustered again and again, ties, copies of one vector in a third of the rows, and columns whose names clash."""
    monkeypatch.setattr(ann, "MOST_CENTROIDS", first)
    monkeypatch.setattr(ann, "SPLIT_ROWS", 60)
    monkeypatch.setattr(ann, "MOST_CHILDREN", 8)
    monkeypatch.setattr(ann, "RUN_ROWS", 200)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8)) + rng.integers(0, 2, (3000, 1)) * 5
    x[2000:] = x[7]
    x[100:110] = np.round(x[100:110])
    x[110:120] = x[100:110]
    df = spark.createDataFrame([(i, v.tolist(), 5, "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, list int, part string").repartition(5)
    asked = list(range(0, 3000, 30))
    got = {}
    for r in ann.search(spark, df.unionByName(df.limit(50)), df.where("vec_id % 30 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10].tolist()
        own = sorted(got[i])
        assert [r for r, *_ in own] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len(set(want) & {v for _, v, _ in own})
        if i >= 2000:
            assert [v for _, v, _ in own] == want  # copies: the smallest ids
    assert hits >= 0.95 * 10 * len(asked)
    few = ann.search(spark, df.where("vec_id < 5"), df.where("vec_id < 2"), 10).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(q, k) for q in (0, 1) for k in range(1, 5)]


def test_nearest_of_far_off_vectors(spark):
    x = np.random.default_rng(5).normal(size=(700, 8))
    x[0] = 1000.0
    x[1:6] = -1000.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(spark, df, df.where("vec_id < 40"), 10).collect()
    for i in range(40):
        own = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)), i
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in own)
        if 0 < i < 6:
            assert [r.vec_id for r in own[:4]] == [j for j in range(1, 6) if j != i]
    few = ann.search(spark, df, df.where("vec_id < 3"), 1000).collect()
    assert len(few) == 3 * 699
