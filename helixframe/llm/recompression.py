"""Long repeats of words, found by recompression.

A text is parsed bottom-up: in every round neighbours that are equal (runs) or
that fall on the left and the right side of a coin (pairs) become one symbol.
Whether two neighbours join depends on those two alone, and a symbol's name on
what it stands for, so equal passages get equal symbols in all texts, but for
a margin that is known: a symbol carries the words it was decided by (its
reach).  Spark rounds count the names of runs and pairs over all documents.  A
name that stands once rules out every window that holds its reach; later rounds
look at what is left.  Windows that remain are told apart by their highest
symbol and by digests (128 bits, blake2b) of their words: segments of windows
that share a symbol first, single windows only where segments differ.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.scratch import Scratch, small_batches
from helixframe.llm.textkernels import BY_SPACE, U64, Words, mix, text_buffers, word_blocks

#: Levels whose names are counted in each round; those below stand for three words and less and are shared by most texts.
#: The last round goes on to the level from which nothing fits a window.
ROUNDS = ((4, 4), (5, 5), (6, 250))
#: Cuts are applied at once where they rule out this share of the windows left, else together with later ones.
WORTH = 0.1
_KEYS = np.random.default_rng(20240611).integers(1, 2**63, (256, 5), dtype=np.uint64) * U64(2) + U64(1)
_FAR = 1 << 40


class Symbols(NamedTuple):
    """Symbols of a block of texts in order; places are words, with a gap of one between texts."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray  # the reach: words that decided this symbol
    high: np.ndarray
    joined: np.ndarray  # whether the last round made it


def words_as_symbols(words: Words) -> Symbols:
    at = np.arange(len(words.hash)) + words.doc
    return Symbols(words.hash, at, at + 1, at, at + 1, np.zeros(len(at), bool))


def next_level(s: Symbols, level: int, span: int) -> Symbols:
    """One round: runs a..a and pairs of runs a..ab..b become symbols.  What reaches beyond ``span`` words is left out, as no window decides it."""
    n = len(s.name)
    if not n:
        return s
    key = _KEYS[level]
    left = (mix(s.name ^ key[0]) & U64(1)) == 0
    touch = s.start[1:] == s.end[:-1]
    join = touch & ((s.name[1:] == s.name[:-1]) | (left[:-1] & ~left[1:]))
    head = np.flatnonzero(np.concatenate([[True], ~join]))
    tail = np.append(head[1:] - 1, n - 1)
    size = tail - head + 1
    first, last = s.name[head], s.name[tail]
    of_first = np.add.reduceat((s.name == np.repeat(first, size)).astype(np.int64), head)
    name = mix(mix(first * key[1]) + mix((last ^ key[2]) * key[3]) + mix((of_first << 32 | size).view(np.uint64) * key[4]))
    name = np.where(size == 1, first, name)
    before, after = np.zeros(len(head), bool), np.zeros(len(head), bool)
    before[1:] = touch[head[1:] - 1]
    after[:-1] = touch[tail[:-1]]
    low = np.where(before, s.low[np.maximum(head - 1, 0)], -_FAR)
    high = np.where(after, s.high[np.minimum(tail + 1, n - 1)], _FAR)
    keep = high - low <= span
    return Symbols(name[keep], s.start[head][keep], s.end[tail][keep], low[keep], high[keep], (size > 1)[keep])


def _windows(words: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, number of windows) of each text of a block."""
    n = np.diff(words.first)
    return words.first[:-1] + np.arange(len(n)), np.maximum(n - span + 1, 0)


def _spread(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column; a null is an empty list."""
    lists = lists.fill_null(pa.scalar([], lists.type))
    at = lists.offsets.to_numpy()
    return at - at[0], lists.flatten().to_numpy(zero_copy_only=False)


def _pieces(batches, rows: int = 500):
    """Batches of whole texts in pieces, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


NAMES = "name long, doc long, place long"


def names(rows: DataFrame, first: int, last: int, span: int) -> DataFrame:
    """Runs and pairs that levels ``first`` to ``last`` make: name, doc, and the windows that hold their reach (first * 256 + how many more).

    ``rows`` has doc, text and, after the first round, ``live``: the windows
    left, as first and last in turn.
    """
    lives = "live" in rows.columns

    def run(batches):
        for batch in batches:
            doc = batch.column(0).to_numpy()
            if lives:
                at, live = _spread(batch.column(2))
            for a, b, _, words in word_blocks(batch.column(1), BY_SPACE, fold=False):
                s = words_as_symbols(words)
                base, n = _windows(words, span)
                own = live[at[a] : at[b]].reshape(-1, 2) + np.repeat(base, np.diff(at[a : b + 1]) // 2)[:, None] if lives else None
                for level in range(1, last + 1):
                    s = next_level(s, level, span)
                    if not len(s.name):
                        break
                    if level >= first:
                        yield _named(s, base, n, own, doc[a:b], span)

    return rows.select("doc", "text", *(["live"] if lives else [])).mapInArrow(run, NAMES)


def _named(s: Symbols, base: np.ndarray, n: np.ndarray, own: np.ndarray | None, doc: np.ndarray, span: int) -> pa.RecordBatch:
    """What the last level joined, where a window that is left (``own``) holds its reach."""
    which = np.searchsorted(base, s.start, "right") - 1
    lo = np.maximum(s.high - span, base[which])
    hi = np.minimum(s.low, base[which] + n[which] - 1)
    use = s.joined & (lo <= hi)
    if own is not None:
        use &= np.append(own[:, 0], _FAR)[np.searchsorted(own[:, 1], lo)] <= hi
    lo, hi, which = lo[use], hi[use], which[use]
    return pa.RecordBatch.from_arrays([pa.array(s.name[use].view(np.int64)), pa.array(doc[which]), pa.array(((lo - base[which]) << 8) | (hi - lo))], ["name", "doc", "place"])


def standing_once(named: DataFrame) -> DataFrame:
    """(doc, place) of the names that stand once; no task sees all rows of a name."""
    return named.groupBy("name").agg(F.count("*").alias("n"), F.first("doc").alias("doc"), F.first("place").alias("place")).where("n = 1").select("doc", "place")


def _left(n: int, live: np.ndarray | None, cuts: np.ndarray) -> np.ndarray:
    """Windows of a text that are left, as (first, last) rows."""
    depth = np.zeros(n + 1, np.int64)
    if live is None:
        depth[0] += 1
    else:
        depth[live[0::2]] += 1
        depth[live[1::2] + 1] -= 1
    inside = np.cumsum(depth[:n]) > 0
    lo = cuts >> 8
    hole = np.zeros(n + 1, np.int64)
    np.add.at(hole, lo, 1)
    np.add.at(hole, lo + (cuts & 255) + 1, -1)
    inside &= np.cumsum(hole[:n]) == 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1], 1)


LEFT = "doc_id long, doc long, n_words long, sha string, text string, live array<long>"


def leave_out(rows: DataFrame, cuts: DataFrame, span: int) -> DataFrame:
    """Texts with the windows that no cut (doc, place) covers.

    Words of a text are joined by one space from here on.  Where no window is
    left, the digest of the text is all that is kept.
    """
    lists = cuts.groupBy("doc").agg(F.collect_list("place").alias("cuts"))  # a text's own places
    again = "live" in rows.columns
    names_ = ["doc_id", "doc", "text", "cuts"] + (["n_words", "sha", "live"] if again else [])

    def run(batches):
        for batch in _pieces(batches):
            offsets, data = text_buffers(batch.column(2))
            raw = memoryview(data)
            at, cut = _spread(batch.column(3))
            if again:
                at_live, live = _spread(batch.column(6))
                known = batch.column(5).to_pylist()
            counts, shas, texts, lefts = [], [], [], []
            for i in range(batch.num_rows):
                if again and known[i] is not None:
                    counts.append(batch.column(4)[i].as_py())
                    shas.append(known[i])
                    texts.append(None)
                    lefts.append([])
                    continue
                words = bytes(raw[offsets[i] : offsets[i + 1]]).split()
                text, n = b" ".join(words), len(words) - span + 1
                own = _left(n, live[at_live[i] : at_live[i + 1]] if again else None, cut[at[i] : at[i + 1]]) if n > 0 else ()
                counts.append(len(words))
                shas.append(None if len(own) else hashlib.sha256(text).hexdigest())
                texts.append(text if len(own) else None)
                lefts.append(own.ravel() if len(own) else [])
            out = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lefts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "doc", "n_words", "sha", "text", "live"])

    return rows.join(lists, "doc", "left").select(*names_).mapInArrow(run, LEFT)


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _digests(raw: list[bytes]) -> list[pa.Array]:
    table = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(table[:, k])) for k in (0, 1)]


def highest(words: Words, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, occurrence) of the first symbol of the highest level that the windows at ``starts`` decide."""
    s = words_as_symbols(words)
    k = np.searchsorted(s.low, starts)
    name, which = s.name[k], k
    level = 0
    while len(s.name):
        level += 1
        s = next_level(s, level, span)
        if not len(s.name):
            break
        k = np.searchsorted(s.low, starts)
        has = k < len(s.low)
        has[has] = s.high[k[has]] <= starts[has] + span
        name = np.where(has, mix(s.name[np.minimum(k, len(s.low) - 1)] ^ _KEYS[level][0]), name)
        which = np.where(has, (level << 40) + k, which)
    return name, which


SEGMENTS = "h long, g1 long, g2 long, doc long, place long"


def segments(rows: DataFrame, span: int) -> DataFrame:
    """Windows left, as runs that share their highest symbol: its name h, the digest of the run's words, doc, place."""

    def run(batches):
        for batch in batches:
            doc = batch.column(0).to_numpy()
            at, live = _spread(batch.column(2))
            for a, b, data, words in word_blocks(batch.column(1), BY_SPACE, fold=False):
                base, _ = _windows(words, span)
                own = live[at[a] : at[b]].reshape(-1, 2)
                if not len(own):
                    continue
                of = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]) // 2)
                size = own[:, 1] - own[:, 0] + 1
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                text = np.repeat(of, size)
                first = np.repeat(own[:, 0], size) + step  # windows by their first word within the text
                h, which = highest(words, base[text] + first, span)
                new = np.ones(len(first), bool)
                new[1:] = (which[1:] != which[:-1]) | (first[1:] != first[:-1] + 1) | (text[1:] != text[:-1])
                heads = np.flatnonzero(new)
                count = np.diff(np.append(heads, len(first)))
                text, first = text[heads], first[heads]
                w = words.first[text] + first
                raw = data.tobytes()
                parts = [_digest(raw[x:y]) for x, y in zip(words.start[w].tolist(), words.end[w + count + span - 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[heads].view(np.int64)), *_digests(parts), pa.array(doc[a + text]), pa.array((first << 8) | (count - 1))], [c.split()[0] for c in SEGMENTS.split(", ")])

    return rows.where("sha is null").select("doc", "text", "live").mapInArrow(run, SEGMENTS)


WINDOWS = "g1 long, g2 long, times int, doc long, place long"


def windows(rows: DataFrame, chosen: DataFrame, span: int) -> DataFrame:
    """Single windows of the segments (doc, place, n) with digests; ``times`` is 2 for what is known to repeat."""
    lists = chosen.groupBy("doc").agg(F.collect_list(F.struct("place", F.least(F.col("n"), F.lit(2)).cast("long").alias("n"))).alias("own"))  # a text's own segments

    def run(batches):
        for batch in _pieces(batches):
            doc = batch.column(0).to_numpy()
            at, place = _spread(batch.column(2))
            _, n = _spread(batch.column(3))
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = text.encode()
                space = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
                start, end = np.concatenate([[0], space + 1]), np.append(space, len(raw))
                for k in range(at[i], at[i + 1], 1000):
                    own = place[k : min(k + 1000, at[i + 1])]
                    count = (own & 255) + 1
                    first = np.repeat(own >> 8, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    parts = [_digest(raw[x:y]) for x, y in zip(start[first].tolist(), end[first + span - 1].tolist(), strict=True)]
                    times = np.repeat(n[k : k + len(own)], count).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*_digests(parts), pa.array(times), pa.array(np.full(len(first), doc[i])), pa.array(first << 8)], ["g1", "g2", "times", "doc", "place"])

    chosen_rows = rows.where("sha is null").select("doc", "text").join(lists, "doc")
    return chosen_rows.select("doc", "text", "own.place", "own.n").mapInArrow(run, WINDOWS)


def not_repeated(rows: DataFrame, scratch: Scratch, span: int) -> DataFrame:
    """(doc, place) of the windows left whose words stand nowhere else."""
    counted = segments(rows, span).groupBy("h", "g1", "g2").agg(F.count("*").alias("n"), F.first("doc").alias("doc"), F.first("place").alias("place"))
    counted = scratch.keep(counted, "segments")
    # segments that stand once may still share windows with others of their symbol
    mixed = counted.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("h")
    mixed = scratch.keep(mixed, "mixed")
    lone = counted.where("n = 1").join(mixed, "h", "left_anti").select("doc", "place")
    chosen = scratch.keep(counted.join(mixed, "h", "left_semi").select("doc", "place", "n"), "chosen")
    apart = windows(rows, chosen, span).groupBy("g1", "g2").agg(F.sum("times").alias("times"), F.first("doc").alias("doc"), F.first("place").alias("place"))
    return lone.unionByName(apart.where("times = 1").select("doc", "place"))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _removed(span: int, keep: bool):
    def run(batches):
        for batch in _pieces(batches):
            count, known, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            at, live = _spread(batch.column(4))
            gone, shas, kept = [], [], []
            for i, text in enumerate(texts):
                own = live[at[i] : at[i + 1]]
                if known[i] is not None or not len(own):
                    gone.append(0)
                    kept.append(text)
                    shas.append(known[i] or hashlib.sha256(text.encode()).hexdigest())
                    continue
                cover = np.zeros(count[i] + 1, np.int64)
                cover[own[0::2]] += 1
                np.add.at(cover, own[1::2] + span, -1)
                stay = np.cumsum(cover[:-1]) == 0
                words = text.split(" ")
                rest = " ".join([words[k] for k in np.flatnonzero(stay).tolist()])
                gone.append(int((~stay).sum()))
                shas.append(hashlib.sha256(rest.encode()).hexdigest())
                kept.append(rest)
            out = [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(kept, pa.string())] if keep else []), ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept"] if keep else []))

    return run


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ``doc``, a number of its own for each row: the id, where ids are unique."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        # written once: these numbers differ when worked out again
        return scratch.keep(rows.withColumn("doc", F.monotonically_increasing_id()), "numbered")
    return rows.withColumn("doc", F.col("doc_id"))


def _live(rows: DataFrame) -> int:
    at = F.sequence(F.lit(0), F.size("live") - 2, F.lit(2))
    held = F.aggregate(at, F.lit(0).cast("long"), lambda s, k: s + F.element_at("live", (k + 2).cast("int")) - F.element_at("live", (k + 1).cast("int")) + 1)
    return rows.where("sha is null").agg(F.sum(held)).first()[0] or 0


def remove_windows(spark: SparkSession, docs: DataFrame, span: int = 35, text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_words, n_removed, kept_sha256 (and ``kept`` where asked, null where nothing went).

    A window is ``span`` words of a row.  Every word goes that a window covers
    whose words also start anywhere else; no copy is spared.  Words are what
    white space (space, controls 9 to 13) separates; kept ones are joined by
    one space.  Null text holds no word.  Each row counts as a text of its own,
    also where rows repeat or share a doc_id or have none.  A text is read
    whole by one task, however long.  Other columns are ignored.  An empty
    table gives no rows.  ``span`` is 2 to 250.
    """
    if not 2 <= span <= 250:
        raise ValueError("span must be from 2 to 250")
    scratch = Scratch(spark, "recompression")
    with small_batches(spark):
        left, cuts = _left_and_cuts(spark, docs, scratch, span)
    out = leave_out(left, cuts, span).select("doc_id", "n_words", "sha", "text", "live")
    return out.mapInArrow(_removed(span, text), OUT + (", kept string" if text else ""))


def _left_and_cuts(spark: SparkSession, docs: DataFrame, scratch: Scratch, span: int) -> tuple[DataFrame, DataFrame]:
    """Texts with the windows that rounds of names leave, and those of them that are not repeated."""
    rows = _keyed(docs, scratch)
    cuts = scratch.keep(standing_once(names(rows, *ROUNDS[0], span)), "once")
    left = scratch.keep_bucketed(leave_out(rows, cuts, span), "left", "doc")
    scratch.drop(cuts)
    pending: list[DataFrame] = []
    for first, last in ROUNDS[1:]:
        named = names(left.where("sha is null"), first, last, span)
        cuts = scratch.keep(named.groupBy("name").agg(F.count("*").alias("n"), F.first("doc").alias("doc"), F.first("place").alias("place")).select("n", "doc", "place"), "names")
        pending.append(cuts.where("n = 1").select("doc", "place"))
        ruled = pending[-1].agg(F.sum(F.col("place").bitwiseAND(255) + 1)).first()[0] or 0
        if ruled >= WORTH * max(_live(left), 1):
            new = scratch.keep_bucketed(leave_out(left, _all(pending), span), "left", "doc")
            scratch.drop(left)
            left, pending = new, []
    return left, scratch.keep(_all([*pending, not_repeated(left, scratch, span)]), "cuts")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
