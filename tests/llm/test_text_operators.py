"""Recompression, spelling variants and the filter audit against plain Python, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import filteraudit, recompression, spelling, textkernels

DOCS = "doc_id long, text string, lang string, n long, name string, word string, doc string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows, parts=3):
    """Texts with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, 7, "clash", "clash", "clash") for i, t, lang in rows], DOCS).repartition(parts)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    shared, other = prose(rng, 90), prose(rng, 40)
    out = [prose(rng, rng.randrange(0, 120)) for _ in range(60)]
    out += [f"{prose(rng, 20)} {shared} {prose(rng, 25)}" for _ in range(8)] + [shared.replace(" ", "\n\t"), shared[:200], other + " " + other, other]
    out += ["a " * 300, "a " * 34, "a b " * 60, "b a " * 40, "x " + "a " * 36 + "y", None, "", " \n ", "ä Ö ß 字 " * 30, prose(rng, 6000), "one" * 3000]
    return out + [out[3], out[70]]


def windows_removed(texts, span):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + span]) for w in words for k in range(len(w) - span + 1))
    for w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - span + 1):
            if seen[tuple(w[k : k + span])] > 1:
                gone[k : k + span] = True
        yield len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


@pytest.mark.parametrize("span,worth", [(35, 0.1), (35, 0.0), (35, 9.0), (2, 0.1), (6, 0.0), (120, 0.1)])
def test_repeated_windows(spark, texts, span, worth, monkeypatch):
    monkeypatch.setattr(recompression, "WORTH", worth)
    rows = [(i * 7 % 1009, t, "en") for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:] for r in recompression.remove_windows(spark, frame(spark, rows), span).collect()}
    assert got == {i: want for (i, _, _), want in zip(rows, windows_removed(texts, span), strict=True)}


def test_repeated_windows_of_odd_ids(spark):
    long_ = prose(random.Random(1), 50)
    rows = [(1, long_, ""), (1, long_, ""), (None, long_ + " z", ""), (None, None, ""), (2, "short", "")]
    out = recompression.remove_windows(spark, frame(spark, rows), 35, text=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(False, 1, 50, 50), (False, 1, 50, 50), (False, 2, 1, 0), (True, 0, 0, 0), (True, 0, 51, 50)]
    assert {r.kept for r in out if r.n_words == 51} == {"z"}
    assert recompression.remove_windows(spark, frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        recompression.remove_windows(spark, frame(spark, rows), 1)


def test_symbols_of_equal_passages_agree_within_their_reach():
    """What a window decides is the same wherever the window stands."""
    rng = random.Random(4)
    passage = [f"w{rng.randrange(6)}" for _ in range(60)]
    found = []
    for _ in range(20):
        before, after = ([f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 30))] for _ in range(2))
        data = np.frombuffer(" ".join([*before, *passage, *after]).encode(), np.uint8)
        w = textkernels.Words(np.array([0, len(data)]), data, textkernels.BY_SPACE, False)
        s, own = recompression.words_as_symbols(w), set()
        for level in range(1, 9):
            s = recompression.next_level(s, level, 60)
            a, b = len(before), len(before) + len(passage)
            own |= {(level, int(n), int(x) - a, int(y) - a) for n, x, y, lo, hi in zip(s.name, s.start, s.end, s.low, s.high, strict=True) if lo >= a and hi <= b}
        found.append(own)
    assert all(f == found[0] for f in found) and max(level for level, *_ in found[0]) >= 4


def spelled(docs, every, least, often):
    low = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    near = {w: set() for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) <= 1:
            x, y = sorted((a, b), key=len)
            if any(y[:k] + y[k + 1 :] == x for k in range(len(y))) if len(x) < len(y) else sum(p != q for p, q in zip(x, y, strict=True)) == 1:
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ÀÉÎÕÜàé", "àéîõüÿþ", "q" * 5000, "q" * 4999 + "r"]
    docs = []
    for i in range(120):
        own = [rng.choice(stems) if rng.random() < 0.8 else rng.choice(stems[:4]) for _ in range(80)]
        docs.append((i, "".join((w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", "-", "1", "÷ ", "\u0101", ". "]) for w in own)))
    return [*docs, (None, "AbabAbab " * 30), (None, None), (7, ""), (7, "aaaaaaa " * 30), (7, "aaaaaaa " * 30)]


@pytest.mark.parametrize("every,least,often,block,looked", [(31, 7, 2, spelling.BLOCK, 64), (3, 3, 1, spelling.BLOCK, 64), (3, 7, 1, 4, 1)])
def test_spelling_variants(spark, letters, every, least, often, block, looked, monkeypatch):
    monkeypatch.setattr(spelling, "LOOKED_AT", looked)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    out = spelling.variants(spark, frame(spark, [(i, t, "") for i, t in letters]), every, least, often, block=block).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}
    want = spelled(letters, every, least, often)
    assert len(out) == len(got) and got == want and sum(v[3] for v in want.values()) > 50


def test_no_words(spark):
    assert spelling.variants(spark, frame(spark, [(1, "short words only", "")])).count() == 0
    assert spelling.variants(spark, frame(spark, [(1, "x", "")]).limit(0)).count() == 0


def test_merging_with_skips():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 30, rng.integers(1, 20))).tolist() for _ in range(rng.integers(1, 9))]
        begin = [int(rng.integers(0, len(x) + 1)) for x in lists]
        least = int(rng.integers(1, len(lists) + 1))
        count = Counter(v for x, b in zip(lists, begin, strict=True) for v in x[b:])
        got = list(spelling.merge_skip(lists, begin, least))
        # a number before a list's place may stand in it: what is looked up there is a bound, never too small
        assert [v for v in sorted(count) if count[v] >= least] == [v for v in got if count[v] >= least] and len(got) == len(set(got))


def audit_rows(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    seen = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        seen.append((lang or "", {k for k, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {p for p, *_ in seen}:
        shapley, own = Counter(), {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order):
                before = set(order[:step])
                here = [(g, x) for p, f, g, x in seen if p == part and letter in f and not f & before]
                own[order, step + 1] = (
                    sum(p == part and not f & (before | {letter}) for p, f, *_ in seen), len(here), sum(p == part and letter in f and bool(f & before) for p, f, *_ in seen),
                    sum(p == part and f == {letter} for p, f, *_ in seen), sum(g for g, _ in here), sum(x for _, x in here),
                )
                shapley[letter] += len(here)
        out.update({(part, o, s): (*v, shapley[o[s - 1]]) for (o, s), v in own.items()})
    return out


def test_filter_audit(spark):
    rng = random.Random(8)
    good = prose(rng, 250, 10_000)
    docs = [(1, good, "en"), (2, good, "de"), (3, good + " #", "en"), (4, good.upper(), "en"), (5, "w " * 300, None), (6, "short", ""), (7, None, "en"), (8, "", "en"), (9, "  \n", "de"), (None, "short", "en"), (None, good, "fr"), (6, "short", ""), (6, "Other", "de"), (10, prose(rng, 30_000, 10**6), "fr"), (11, "É Ü " * 150, "fr")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (4, 1, None), (6, None, 1), (None, 1, 1), (99, 1, 1)]
    df = frame(spark, docs)
    out = filteraudit.audit(spark, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in out}
    assert len(out) == len(got) == 4 * 600 and got == audit_rows(docs, labels)
    assert filteraudit.audit(spark, df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_plan_combines_before_it_shuffles(spark):
    rows = spark.range(10).select(F.lit("en").alias("part"), F.lit(3).alias("fails"), F.lit(True).alias("good"), F.lit(False).alias("toxic"))
    plan = filteraudit.replay(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_count(" in plan and "CartesianProduct" not in plan
