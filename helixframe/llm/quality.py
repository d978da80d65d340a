"""Weak-label quality classifier.

Heuristic labellers vote good, bad or nothing on each document.  Expectation-
maximisation over the table of vote patterns estimates how each labeller votes
on good and on bad documents, without gold labels.  The posterior labels of a
bounded sample train a linear scorer over hashed features, which then scores
every whole document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import textkernels
from helixframe.llm.textkernels import BY_SPACE, U64, blocks, mix, text_buffers
from helixframe.llm.textkernels import Words, shingle_hashes

#: Hash buckets of the scorer.
BUCKETS = 1 << 14
#: Documents that train the scorer: distinct texts, the ones with the least hashes, whatever the corpus's size.
TRAIN_ROWS = 4000
#: Posteriors between these are not trained on.
UNSURE = (0.2, 0.8)
TRIGRAM_SCALE = 40.0
#: Trigrams of no weight that are added to each text, so that a few words decide little.
CALM = 40
SEED = 99

LABELLERS = ("symbols", "capitals", "repetition", "sentences", "lists", "letters", "plain_words", "distinct_words", "top_word", "doubled")
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Kinds of bad documents that the label model tells apart.
KINDS = 6
#: Before any data, each class holds PRIOR_DOCS documents with these shares of bad votes.
PRIOR_BAD, PRIOR_GOOD, PRIOR_DOCS = 0.5, 0.05, 2.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#%&$*+<=>@\\^_`{|}~!"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_ALPHA = _LETTER.copy()
_ALPHA[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True


def _sums(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sum of ``flags[lo:hi]`` for each span; spans are in order and don't overlap."""
    out = np.zeros(len(lo), dtype)
    some = np.flatnonzero(hi > lo)
    if len(some):
        cuts = np.empty(2 * len(some), np.int64)
        cuts[::2], cuts[1::2] = lo[some], hi[some]
        out[some] = np.add.reduceat(np.append(flags, flags.dtype.type(0)), cuts, dtype=dtype)[::2]
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, occurrences of the commonest one) of each document; ``doc`` is sorted."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, int)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[first], np.diff(np.append(first, len(h))))
    return np.bincount(doc[first], minlength=n), most


def measures(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """Ratios that the labellers look at, for each document of a block."""
    words = Words(offsets, data, BY_SPACE)
    n_words = np.diff(words.first)
    size = np.diff(offsets)
    over = lambda flags: _sums(flags, offsets[:-1], offsets[1:])
    letters = over(_LETTER[data])
    doc, h = shingle_hashes(words, 2)
    pairs = np.bincount(doc, minlength=len(size))
    fresh, _ = _distinct(doc, h, len(size))
    kinds, top = _distinct(words.doc, words.hash, len(size))
    # a plain word is letters, and one mark after them at most
    length = words.end - words.start
    alpha = _sums(_ALPHA[data], words.start, words.end)
    plain = alpha >= np.maximum(length - 1, 1)
    ends = data[words.end - 1] if len(length) else data[:0]
    twice = (length > 2) & ~_ALPHA[ends] & (data[np.maximum(words.end - 2, 0)] == ends)
    share = lambda flags: np.bincount(words.doc[flags], minlength=len(size))
    per = lambda x, y: x / np.maximum(y, 1)
    return {
        "words": n_words,
        "symbols": per(over(_SYMBOL[data]), size),
        "capitals": per(over(_UPPER[data]), letters),
        "letters": letters,
        "alpha": per(over(_ALPHA[data]), size),
        "fresh": np.where(pairs > 0, fresh / np.maximum(pairs, 1), 1.0),
        "kinds": per(kinds, n_words),
        "top": per(top, n_words),
        "stops": per(over(_STOP[data]), n_words),
        "bars": per(over(data == ord("|")), n_words),
        "plain": per(share(plain), n_words),
        "doubled": per(share(twice), n_words),
        "word_bytes": per(size - n_words, n_words),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, labellers) of ABSTAIN, BAD or GOOD.  Each kind of junk is seen by several labellers."""
    choose = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)).astype(np.uint8)
    some, many = m["words"] >= 5, m["words"] >= 20
    return np.stack(
        [
            choose(some & (m["symbols"] > 0.04), some & (m["symbols"] < 0.01)),
            choose((m["letters"] >= 20) & (m["capitals"] > 0.5), some & (m["capitals"] < 0.15)),
            choose(many & (m["fresh"] < 0.45), many & (m["fresh"] > 0.6)),
            choose((m["words"] >= 30) & ((m["stops"] < 0.005) | (m["stops"] > 0.6)), (m["words"] >= 10) & (m["stops"] > 0.02) & (m["stops"] < 0.4)),
            choose(some & (m["bars"] > 0.1), some & (m["bars"] == 0)),
            choose((m["letters"] == 0) | (some & (m["alpha"] < 0.7)), some & (m["alpha"] > 0.75)),
            choose(some & (m["plain"] < 0.6), some & (m["plain"] > 0.8)),
            choose(many & (m["kinds"] < 0.3 * np.minimum(1, (200 / np.maximum(m["words"], 1)) ** 0.5)), many & (m["kinds"] > 0.5 * np.minimum(1, (200 / np.maximum(m["words"], 1)) ** 0.5))),
            choose(many & (m["top"] > 0.2), many & (m["top"] < 0.12)),
            choose(some & (m["doubled"] > 0.15), some & (m["doubled"] < 0.02)),
        ],
        axis=1,
    )


PLACES = 3 ** np.arange(len(LABELLERS))


@dataclass
class LabelModel:
    """``log[class, labeller, vote]`` and ``log_prior[class]``; the last class is the good one, the others are kinds of bad."""

    log: np.ndarray
    log_prior: np.ndarray

    def classes(self, v: np.ndarray) -> np.ndarray:
        """(class, document) probabilities; an abstention says nothing."""
        ll = self.log_prior[:, None] + self.log[:, np.arange(v.shape[1])[None, :], v].sum(2)
        p = np.exp(ll - ll.max(0))
        return p / p.sum(0)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        return self.classes(v)[-1]

    def accuracies(self) -> np.ndarray:
        """For each labeller, how often a vote that it casts is right."""
        p, prior = np.exp(self.log), np.exp(self.log_prior)
        return (prior[:-1, None] * p[:-1, :, BAD]).sum(0) + prior[-1] * p[-1, :, GOOD]


def _begin(patterns: np.ndarray, counts: np.ndarray, kinds: int) -> np.ndarray:
    """(class, pattern) shares to start from: patterns without a bad vote are good, others go with the nearest of ``kinds``
    centres, each the pattern that is farthest from the ones before, by its documents."""
    bad = patterns == BAD
    centres = [np.zeros(patterns.shape[1], bool)]
    away = bad.sum(1)
    for _ in range(kinds):
        far = int(np.argmax(away * counts)) if len(away) else 0
        centres.append(bad[far] if len(away) else centres[0])
        away = np.minimum(away, (bad != centres[-1]).sum(1))
    distance = np.stack([(bad != c).sum(1) for c in centres[1:]])
    share = np.full((kinds + 1, len(patterns)), 0.02 / kinds)
    share[np.where(bad.any(1), distance.argmin(0), kinds), np.arange(len(patterns))] = 0.98
    return share / share.sum(0)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, turns: int = 1000, prior_docs: float = PRIOR_DOCS, kinds: int = KINDS) -> LabelModel:
    """Fit classes to a table of vote patterns: one good, and ``kinds`` of bad, on each of which labellers have rates of their own.

    Labellers overlap: several see the same kind of junk, so votes depend on
    each other until the kind is known.  Abstentions are missing votes: they
    leave the likelihood as it is, so short texts, on which most labellers
    abstain, don't become a class.  The prior is worth ``prior_docs`` documents
    a class, whatever the corpus's size.
    """
    n = patterns.shape[1]
    share = _begin(patterns, counts, kinds)
    start = np.full(kinds + 1, PRIOR_BAD)
    start[-1] = PRIOR_GOOD
    model = None
    for _ in range(turns):
        weight = share * counts
        log = np.zeros((kinds + 1, n, 3))
        for k in range(n):
            for vote, prior in ((BAD, start), (GOOD, 1 - start)):
                log[:, k, vote] = weight[:, patterns[:, k] == vote].sum(1) + prior_docs * prior
        log[:, :, [BAD, GOOD]] = np.log(log[:, :, [BAD, GOOD]] / log[:, :, [BAD, GOOD]].sum(2, keepdims=True))
        size = weight.sum(1) + 1
        model = LabelModel(log, np.log(size / size.sum()))
        new = model.classes(patterns)
        if np.abs(new - share).max(initial=0) < 1e-7:
            break
        share = new
    return model


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte."""
    x = data.astype(np.uint64)
    return (mix((x[:-2] << U64(16)) | (x[1:-1] << U64(8)) | x[2:]) % U64(BUCKETS)).astype(np.int32) if len(x) > 2 else np.zeros(0, np.int32)


def _flags(m: dict[str, np.ndarray]) -> np.ndarray:
    """Buckets of the steps that a document's measures fall in, each hashed with the measure's place."""
    tenths = ("capitals", "fresh", "alpha", "kinds", "top", "plain", "doubled")
    steps = [np.minimum(m[k] * 40, 15).astype(np.uint64) for k in ("symbols", "stops", "bars")]
    steps += [np.minimum(m[k] * 10, 15).astype(np.uint64) for k in tenths]
    steps += [np.minimum(np.log2(m["words"] + 1), 15).astype(np.uint64), np.minimum(m["word_bytes"], 25).astype(np.uint64)]
    return np.stack([(mix((U64(1) << U64(40)) + U64(64 * i) + s) % U64(BUCKETS)).astype(np.int32) for i, s in enumerate(steps)], axis=1)


def _parts(data: np.ndarray):
    """A block in parts whose trigrams are its trigrams; only a block of one long document has several."""
    most = textkernels.BLOCK_BYTES
    for lo in range(0, max(len(data) - 2, 1), most):
        yield lo, data[lo : lo + most + 2]


def gram_counts(data: np.ndarray) -> np.ndarray:
    """Trigrams of one document by bucket."""
    return sum(np.bincount(_buckets(part), minlength=BUCKETS) for _, part in _parts(data))


def scores(w: np.ndarray, bias: float, offsets: np.ndarray, data: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Each document's sum is of its own values alone, so equal texts have equal scores."""
    own = np.maximum(np.diff(offsets) - 2, 0)
    total = np.zeros(len(own))
    for lo, part in _parts(data):
        at = np.clip(offsets[:-1] - lo, 0, max(len(part) - 2, 0))
        total += _sums(w[_buckets(part)], at, np.clip(offsets[:-1] + own - lo, at, max(len(part) - 2, 0)), np.float64)
    z = bias + TRIGRAM_SCALE * total / (own + CALM) + w[_flags(m)].sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], turns: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on (buckets, values, posterior) rows by full-batch Adam."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, bias
    index = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    start = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    row = np.repeat(np.arange(len(rows)), np.diff(start))
    y = np.array([r[2] for r in rows])
    g1, g2, b1, b2 = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1)) * len(y)
    for t in range(1, turns + 1):
        z = bias + np.bincount(row, w[index] * value, len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight / len(y)
        g, gb = np.bincount(index, e[row] * value, BUCKETS) + decay * w, e.sum()
        g1, g2, b1, b2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g, 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (g1 / c1) / (np.sqrt(g2 / c2) + 1e-8)
        bias -= rate * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-8)
    return w, bias


def _text_blocks(column):
    offsets, data = text_buffers(column)
    for a, b in blocks(offsets):
        yield a, b, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit(spark: SparkSession, docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Votes of all documents fit the label model; ``train_rows`` distinct texts, those of the least hashes, train the scorer."""
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def vote(batches):
        for batch in batches:
            counts = np.zeros(3 ** len(LABELLERS), np.int64)
            for _, _, offsets, data in _text_blocks(batch.column(0)):
                counts += np.bincount(votes(measures(offsets, data)) @ PLACES, minlength=len(counts))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pattern", "n"])

    table = text.mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # 3 ** labellers rows at most
    patterns = np.array([[r["pattern"] // p % 3 for p in PLACES] for r in table], np.int64).reshape(-1, len(LABELLERS))
    counts = np.array([r["n"] for r in table], float)
    model = expectation_maximisation(patterns, counts)

    # twice the share that gives train_rows distinct texts is looked at, and the least hashes of these are taken
    hashed = text.select("text", F.xxhash64("text", F.lit(SEED)).alias("h"), F.xxhash64(F.lit(SEED), "text").alias("h2"))
    kinds = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share = min(1.0, 2 * train_rows / max(kinds, 1))
    picked = hashed.where((F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))).groupBy(F.pmod("h", F.lit(1 << 30)).alias("lot"), "h", "h2").agg(F.first("text").alias("text"))

    def example(batches):
        for batch in batches:
            out = []
            for a, _, offsets, data in _text_blocks(batch.column(1)):
                m = measures(offsets, data)
                q, flags = model.posterior(votes(m)), _flags(m)
                for i in range(len(q)):
                    if UNSURE[0] < q[i] < UNSURE[1]:
                        continue
                    own = gram_counts(data[offsets[i] : offsets[i + 1]])
                    at = np.flatnonzero(own)
                    value = np.concatenate([own[at] * (TRIGRAM_SCALE / (max(offsets[i + 1] - offsets[i] - 2, 0) + CALM)), np.ones(flags.shape[1])]).astype("<f4")
                    out.append((batch.column(0)[a + i].as_py(), np.concatenate([at, flags[i]]).astype("<i2").tobytes(), value.tobytes(), float(q[i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["lot", "at", "value", "label"])

    examples = picked.select("lot", "text").mapInArrow(example, "lot long, at binary, value binary, label double")
    rows = examples.orderBy("lot", "at").limit(train_rows).collect()  # train_rows rows of BUCKETS numbers at most
    w, bias = train([(np.frombuffer(r["at"], "<i2").astype(np.int64), np.frombuffer(r["value"], "<f4"), r["label"]) for r in rows])
    return QualityModel(model, w, bias)


def classify(spark: SparkSession, docs: DataFrame, keep_from: float = 0.5, train_rows: int = TRAIN_ROWS, model: QualityModel | None = None) -> DataFrame:
    """All columns of ``docs`` with ``posterior`` (of the votes), ``score`` (of the scorer) and ``keep``.

    ``keep`` is ``score >= keep_from``.  Null and empty text count as a text
    without words, whose votes are bad.  Repeated rows get equal scores; null
    ids are carried; columns of these three names are replaced.  An empty table
    gives no rows.
    """
    model = model or fit(spark, docs, train_rows)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers
    own = [c for c in docs.columns if c not in ("posterior", "score", "keep")]
    place = own.index("text")

    def run(batches):
        m_ = shared.value
        for batch in batches:
            n = batch.num_rows
            posterior, score = np.zeros(n), np.zeros(n)
            for a, b, offsets, data in _text_blocks(batch.column(place)):
                m = measures(offsets, data)
                posterior[a:b] = m_.labels.posterior(votes(m))
                score[a:b] = scores(m_.weights, m_.bias, offsets, data, m)
            more = [pa.array(posterior), pa.array(score), pa.array(score >= keep_from)]
            yield pa.RecordBatch.from_arrays(batch.columns + more, own + ["posterior", "score", "keep"])

    schema = docs.select(*own).schema.add("posterior", "double").add("score", "double").add("keep", "boolean")
    return docs.select(*own).withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
