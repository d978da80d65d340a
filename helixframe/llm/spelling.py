"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Words are counted from whole texts.  A word's padded q-grams are ordered from
the rarest up, and the shortest beginning of that order that no single edit can
destroy says which parts of the index it meets: each part is keyed by gram,
length and position, so words only meet others of fitting length that hold a
rare gram in a fitting place.  Inside a part, postings of (gram, position) are
heap-merged with skips, words that reach the overlap one edit must leave are
candidates, and candidates are compared letter by letter.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.components import runs
from helixframe.llm.scratch import Scratch
from helixframe.llm.textkernels import text_buffers

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Letters are one byte each in Latin-1; the pads below are no letters.
START, END = b"\x01", b"\x02"
Q = 3
#: Symbols: a to z, U+00C0 to U+00FF and two pads; so there are fewer than BASE ** Q grams, whatever the corpus holds.
BASE = 92
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[192:256] = np.arange(27, 91)
_CODE[2] = 91
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Words of one part of the index that a task takes; a larger part is split, and its probes go to every split.
BLOCK = 8_192
#: One word in so many tells which parts are large.
LOOKED_AT = 64


def count_words(docs: DataFrame, least: int, every: int) -> DataFrame:
    """``docs`` (doc_id, text) to word, n: all words of at least ``least`` letters, partly summed in the tasks."""

    def run(batches):
        total: Counter = Counter()

        def out():
            words, n = list(total.keys()), list(total.values())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            raw = memoryview(data)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = bytes(raw[offsets[i] : offsets[i + 1]]).lower().decode()  # bytes: only A-Z are lowered
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(text)).items():
                    if len(word) >= least:
                        h = zlib.crc32(word.encode(), head)
                        if h % every == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += n
                if len(total) >= COUNTED:
                    yield out()
        if total:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, position, word) of every padded q-gram."""
    padded = b"".join(START * (Q - 1) + w.encode("latin-1") + END * (Q - 1) for w in words)
    c = _CODE[np.frombuffer(padded, np.uint8)]
    n = np.fromiter(map(len, words), np.int64, len(words)) + Q - 1
    begin = np.cumsum(n + Q - 1) - (n + Q - 1)
    word = np.repeat(np.arange(len(words)), n)
    position = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[word] + position
    return (c[at] * BASE + c[at + 1]) * BASE + c[at + 2], position, word


def gram_ranks(words: DataFrame) -> np.ndarray:
    """Place of each gram from the rarest up; the table has BASE ** Q entries (about 780,000) at any corpus size."""

    def run(batches):
        held = np.zeros(BASE**Q, np.int64)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount(grams(batch.column(0).to_pylist())[0], minlength=BASE**Q)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], ["gram", "n"])

    got = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(BASE**Q, np.int64)
    count[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    rank = np.empty(BASE**Q, np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(BASE**Q, dtype=np.int32)
    return rank


def beginnings(words: list[str], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, position, word): each word's rarest grams until two of them don't overlap, so that one edit spares one."""
    gram, position, word = grams(words)
    order = np.lexsort((position, rank[gram], word))
    gram, position, word = gram[order], position[order], word[order]
    far = int(position.max(initial=0)) + Q + 1
    high = np.maximum.accumulate(position + word * far) - word * far
    low = np.minimum.accumulate(position - word * far) + word * far
    keep = np.ones(len(word), bool)
    keep[1:] = (word[1:] != word[:-1]) | (high[:-1] - low[:-1] < Q)
    return gram[keep], position[keep], word[keep]


BOTH, SHORTER, HELD, PROBE = 0, 1, 2, 3
PARTS = "key long, role byte, word string, n long"


def _key(gram, length, position):
    """Lengths and positions wrap at 2 ** 21: longer words may meet in vain."""
    wrap = (1 << 21) - 1
    return (gram << 42) | ((length & wrap) << 21) | (position & wrap)


def dealt(words: DataFrame, rank) -> DataFrame:
    """Each word (word, n) to the parts of the index it meets: as one of a length, and as the shorter of two."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                own = part.column(0).to_pylist()
                if not own:
                    continue
                gram, position, word = beginnings(own, rank.value)
                length = np.fromiter(map(len, own), np.int64, len(own))[word]
                key = np.concatenate([_key(gram, length, position), _key(gram, length + 1, position), _key(gram, length + 1, position + 1)])
                role = np.repeat(np.array([BOTH, SHORTER, SHORTER], np.int8), len(gram))
                which = pa.array(np.tile(word, 3))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), part.column(0).take(which), part.column(1).take(which)], ["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, PARTS)


def split_large(parts: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Adds ``split``: parts of more than about ``block`` words are held in several splits, each asked by all probes."""
    looked = parts.where(F.pmod(F.xxhash64("word"), F.lit(LOOKED_AT)) == 0).groupBy("key").count()
    large = scratch.keep(looked.where(F.col("count") * LOOKED_AT > block).select("key", F.ceil(F.col("count") * LOOKED_AT / block).cast("int").alias("splits")), "large")
    n = large.count()
    if not n:
        return parts.withColumn("split", F.lit(0))
    large = F.broadcast(large) if n <= 500_000 else large
    rows = parts.join(large, "key", "left")
    one = rows.where("splits is null").select("key", "role", "word", "n", F.lit(0).alias("split"))
    many = rows.where("splits is not null")
    held = many.select("key", F.when(F.col("role") == BOTH, F.lit(HELD)).otherwise(F.col("role")).cast("byte").alias("role"), "word", "n", F.pmod(F.xxhash64("word"), F.col("splits").cast("long")).cast("int").alias("split"))
    asked = many.where(F.col("role") == BOTH).select("key", F.lit(PROBE).cast("byte").alias("role"), "word", "n", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    return one.unionByName(held).unionByName(asked)


def merge_skip(lists: list[list[int]], begin: list[int], least: int):
    """Numbers that stand in at least ``least`` of the sorted lists, each read from its place in ``begin``.

    A number may be missing in so many lists only, so it stands in one of the
    shortest few: these are heap-merged, and the long ones looked up.
    """
    spare = len(lists) - least
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]) - begin[k])
    short, long_ = order[: spare + 1], [lists[k] for k in order[spare + 1 :]]
    width, place = len(lists), list(begin)
    heap = [lists[k][place[k]] * width + k for k in short if place[k] < len(lists[k])]
    heapq.heapify(heap)
    while heap:
        low, missing = heap[0] // width, len(short)
        while heap and heap[0] // width == low:
            k = heap[0] % width
            missing -= 1
            place[k] += 1
            if place[k] < len(lists[k]):
                heapq.heapreplace(heap, lists[k][place[k]] * width + k)
            else:
                heapq.heappop(heap)
        for x in long_:
            if missing > spare:
                break
            i = bisect_left(x, low)
            missing += i == len(x) or x[i] != low
        if missing <= spare:
            yield low


def one_edit(short: str, long: str) -> bool:
    """Whether ``long`` is ``short`` with one letter replaced (equal lengths) or inserted."""
    gap = len(long) - len(short)
    i = next((k for k, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    if gap == 1:
        return short[i:] == long[i + 1 :]
    return gap == 0 and i < len(short) and short[i + 1 :] == long[i + 1 :]


def _padded(word: str) -> str:
    return "\x01" * (Q - 1) + word + "\x02" * (Q - 1)


class _Index:
    """Postings by position and gram: numbers of words, rising."""

    def __init__(self):
        self.words: list[str] = []
        self.postings: list[dict[str, list[int]]] = []

    def add(self, word: str, padded: str) -> None:
        k, n = len(self.words), len(padded) - Q + 1
        self.words.append(word)
        while len(self.postings) < n:
            self.postings.append({})
        for i in range(n):
            own, gram = self.postings[i], padded[i : i + Q]
            if gram in own:
                own[gram].append(k)
            else:
                own[gram] = [k]

    def lists(self, padded: str, shift: int = 0) -> list[list[int]]:
        """Postings of the grams of a word, moved by ``shift`` places."""
        at = self.postings[: len(padded) - Q + 1 + shift]
        return [x for i, own in enumerate(at, -shift) if i >= 0 and (x := own.get(padded[i : i + Q])) is not None]


def neighbours(rows: list[tuple[int, str]]):
    """(probe, other) of the words one edit apart among a part's (role, word), each pair once; the probe is the longer of two lengths."""
    held, short = _Index(), _Index()
    for w in {w for r, w in rows if r == SHORTER}:
        short.add(w, _padded(w))
    split = any(r in (HELD, PROBE) for r, _ in rows)
    if split:
        for w in sorted({w for r, w in rows if r == HELD}):
            held.add(w, _padded(w))
    for probe in sorted({w for r, w in rows if r in (BOTH, PROBE)}):
        own, least = _padded(probe), max(len(probe) - 1, 1)  # of the grams of a longer word, an edit changes Q at most
        lists = held.lists(own)
        if len(lists) >= least:
            # a split part holds words behind the probe as well: those ask for it themselves
            begin = [bisect_left(x, bisect_right(held.words, probe)) for x in lists] if split else [0] * len(lists)
            for k in merge_skip(lists, begin, least):
                if one_edit(probe, held.words[k]):
                    yield probe, held.words[k]
        if not split:
            held.add(probe, own)
        if short.words:
            # a deleted letter moves the grams after it one place down
            lists = short.lists(own) + short.lists(own, -1)
            if len(lists) >= least:
                for k in merge_skip(lists, [0] * len(lists), least):
                    if one_edit(short.words[k], probe):
                        yield probe, short.words[k]


LINKS = "word string, n long, other string, other_n long"


def _first_meetings(pairs: list[tuple[int, str, str]], rank: np.ndarray) -> list[bool]:
    """Whether each pair (key, longer, other) stands at the least key at which both meet; it is given there alone."""
    words = list({w for p in pairs for w in p[1:]})
    gram, position, which = beginnings(words, rank)
    cut = np.searchsorted(which, np.arange(len(words) + 1)).tolist()
    placed = list(zip(gram.tolist(), position.tolist(), strict=True))
    own = {w: placed[a:b] for w, a, b in zip(words, cut[:-1], cut[1:], strict=True)}
    out = []
    for key, a, b in pairs:
        moves = (0,) if len(a) == len(b) else (0, 1)
        out.append(key == min(_key(g, len(a), p + m) for g, p in own[b] for m in moves if (g, p + m) in own[a]))
    return out


def links(parts: DataFrame, rank) -> DataFrame:
    """Parts sorted by (key, split) to linked words, each pair once."""

    def run(batches):
        for table in runs(batches, 50_000):
            key, split = table.column(0).to_numpy(), table.column(4).to_numpy()
            change = (key[1:] != key[:-1]) | (split[1:] != split[:-1])
            heads = np.append(np.concatenate([[0], np.flatnonzero(change) + 1]), len(key))
            role, words, n = table.column(1).to_pylist(), table.column(2).to_pylist(), table.column(3).to_pylist()
            count, found = dict(zip(words, n, strict=True)), []
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                if b - a < 2 or all(r == SHORTER for r in role[a:b]):
                    continue
                found += [(int(key[a]), x, y) for x, y in neighbours(list(zip(role[a:b], words[a:b], strict=True)))]
            if found:
                out = [(x, count[x], y, count[y]) for (_, x, y), first in zip(found, _first_meetings(found, rank.value), strict=True) if first]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["word", "n", "other", "other_n"])

    # whole runs of a key go together; a large key's splits are tasks of their own by the hash of both
    dealt_ = parts.select("key", "role", "word", "n", "split").repartition("key", "split").sortWithinPartitions("key", "split")
    return dealt_.mapInArrow(run, LINKS)


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form) to (word, root); a form is ten times as frequent as its word, so chains are short and pointers double."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.alias("a").join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = scratch.keep(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return at


def variants(spark: SparkSession, docs: DataFrame, every: int = 31, least: int = 7, often: int = 2, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) to word, form, root, n, n_near, form_n.

    Words are maximal runs of letters (A to Z lowered), less one letter where
    ``every`` divides their crc32 with the document's id; those of at least
    ``least`` letters and ``often`` occurrences are kept.  A word's form is its
    near word of largest n (ties: the smaller word) where that n is ``ratio``
    times its own.  Null text holds no word; a null doc_id is the empty string
    in the hash; rows that repeat count each time.  A text is read whole,
    however long; a word of any length counts.  Other columns are ignored.  No
    word, no row.
    """
    scratch = Scratch(spark, "spelling")
    words = count_words(docs, least, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    words = scratch.keep(words, "words")
    rank = spark.sparkContext.broadcast(gram_ranks(words))
    parts = split_large(dealt(words, rank), scratch, block)
    found = scratch.keep(links(parts, rank), "links")
    both = found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    # of the largest counts the smallest word: struct order is that of code points
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = scratch.keep(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")), "near")
    ends = roots(near.where("best is not null").select("word", F.col("best.other").alias("form")), scratch)
    return near.join(ends, "word", "left").select("word", F.col("best.other").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))
