"""Best-fit packing of token pieces, certified by dual-feasible bounds.

Documents are tokenised once and cut into pieces; only (document, piece,
length) rows are packed.  Each bounded partition runs best-fit decreasing and
compares its bin count with a lower bound from dual-feasible functions.  Where
the count is above the bound, the loosest bins are opened, their pieces change
partitions, and best-fit decreasing runs again on those alone.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.scratch import Scratch
from helixframe.llm.textkernels import BY_SPACE, word_blocks

#: Bytes of remembered words from which a worker forgets them all.
CACHE_BYTES = 50_000_000


class WordTokens:
    """Token ids of white-space separated words, each distinct word encoded once while it is remembered.

    The vocabulary's pre-tokeniser never joins text across white space, so a
    text's ids are its words' ids in order.  Words are known by 128 bits (both
    lanes of ``Words``): kept as sorted hashes and flat ids, some 40 bytes each.
    A block with words that agree in one lane and not in the other goes by the
    words' bytes.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys, self.keys2, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.start = np.zeros(1 << 12, self.kind), np.zeros(1 << 10, np.int64)
        self.words = 0
        self._add([[0]])  # word 0: the id 0 that ends a document

    def _add(self, encoded: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        n, used = self.words + len(encoded), int(self.start[self.words])
        total = used + int(lengths.sum())
        if len(self.start) <= n:
            self.start = np.concatenate([self.start, np.zeros(max(n + 1 - len(self.start), len(self.start) // 2), np.int64)])
        if len(self.ids) < total:
            self.ids = np.concatenate([self.ids, np.zeros(max(total - len(self.ids), len(self.ids) // 2), self.kind)])
        self.start[self.words + 1 : n + 1] = used + np.cumsum(lengths)
        self.ids[used:total] = np.fromiter((i for e in encoded for i in e), self.kind, total - used)
        self.words = n

    def block(self, data: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a block, where each document's begin and the end)."""
        if 2 * self.keys.nbytes + self.numbers.nbytes + self.ids.nbytes + self.start.nbytes > CACHE_BYTES:
            self.clear()
        distinct, first, of = np.unique(words.hash, return_index=True, return_inverse=True)
        second = words.hash2[first]
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = np.flatnonzero(at < len(self.keys))
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if (words.hash2 != second[of]).any() or (self.keys2[at[known]] != second[known]).any():
            return self._by_bytes(data, words)
        index = np.zeros(len(distinct), np.int64)
        index[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            spans = zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)
            texts = [raw[a:b].decode() for a, b in spans]
            index[new] = self.words + np.arange(len(new))
            self.keys, self.keys2 = np.insert(self.keys, at[new], distinct[new]), np.insert(self.keys2, at[new], second[new])
            self.numbers = np.insert(self.numbers, at[new], index[new].astype(np.int32))
            self._add([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        line = np.insert(index[of], words.first[1:], 0)
        size = self.start[line + 1] - self.start[line]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[line] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        last = words.first[1:] + np.arange(len(words.first) - 1)  # where each document's end stands in line
        return ids, np.concatenate([[0], ends[last]])

    def _by_bytes(self, data: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """``block`` for words that one lane can't tell apart."""
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        distinct = list(set(texts))
        ids = dict(zip(distinct, [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in distinct], add_special_tokens=False)], strict=True))
        out, ends = [], [0]
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            for t in texts[a:b]:
                out += ids[t]
            out.append(0)
            ends.append(len(out))
        return np.array(out, self.kind), np.array(ends, np.int64)


_workers: dict[int, WordTokens] = {}


def _worker(spec: str) -> WordTokens:
    """A worker keeps one vocabulary and its bounded memory of words."""
    key = zlib.crc32(spec.encode())
    if key not in _workers:
        _workers.clear()
        _workers[key] = WordTokens(spec)
    return _workers[key]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """``docs`` (doc_id, text) to one row per piece of at most ``capacity`` tokens.

    ``tokenizer`` is the path of a ``tokenizers`` JSON file whose pre-tokeniser
    splits at white space.  Null and empty text give one piece that holds the end id alone.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        own = _worker(spec.value)
        for batch in batches:
            docids = batch.column(0)
            for a, b, data, words in word_blocks(batch.column(1), BY_SPACE, fold=False, lanes=2):
                ids, first = own.block(data, words)
                view = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                lengths = np.diff(first)
                n = -(-lengths // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, lengths[doc] - start)
                low = first[:-1][doc] + start
                crc = [zlib.crc32(view[4 * x : 4 * (x + y)]) for x, y in zip(low.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docids.slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs, by two families of dual-feasible functions.

    For a cut e, pieces above ``capacity - e`` count as a whole bin and pieces
    below e as nothing; for a k, a piece x counts floor((k+1)x/C)/k of a bin,
    or x/C where (k+1)x/C is whole.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    count, mass = np.cumsum(n), np.cumsum(n * x)
    cut = np.arange(0, capacity // 2 + 1)
    inner = mass[capacity - cut] - np.where(cut > 0, mass[np.maximum(cut, 1) - 1], 0)
    best = int((count[-1] - count[capacity - cut] - (-inner // capacity)).max())
    for k in range(1, 33):
        whole = ((k + 1) * x) % capacity == 0
        # in units of 1 / (k * capacity) of a bin, so that sums stay exact
        value = np.where(whole, k * x, ((k + 1) * x // capacity) * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece and the number of bins; equal lengths in given order."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, bins = 0, 0  # spaces: bit r is set where a bin has r tokens free
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = spaces >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                spaces &= ~(1 << room)
        else:
            k, room, bins = bins, capacity, bins + 1
        where[i], offset[i] = k, capacity - room
        left = room - size
        if left:
            free[left].append(k)
            spaces |= 1 << left
    return where, offset, bins


#: One bin in so many is opened again at most in a certified partition.
SHARE = 8
PACKED = PIECES + ", sequence_id long, offset long, loose boolean"


def _packer(capacity: int, turn: int, last: bool):
    def run(batches):
        held = pa.Table.from_batches(list(batches), schema=SCHEMA)  # bounded: one partition of pieces
        if not held.num_rows:
            return
        held = held.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = held.column("length").to_numpy()
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        gap = bins - lower_bound(lengths, capacity)
        loose = np.zeros(len(lengths), bool)
        if not last and bins:
            # the loosest bins: their free space is what a better packing could save.  Bounds are rounded up for each
            # partition, so certified ones give theirs as well: as many as hold what a whole bin does, or nearly all there is
            free = capacity - np.bincount(where, weights=lengths, minlength=bins)
            order = np.argsort(-free, kind="stable")
            take = int(np.searchsorted(np.cumsum(free[order]), min(capacity, 0.9 * free.sum()))) + 1
            take = max(2 * gap + 2 if gap > 0 else 0, min(take, bins // SHARE + 1))
            loose = np.isin(where, order[:take])
        task = TaskContext.get().partitionId()
        sequence = (turn << 56) | (task << 32) | where
        out = held.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.append_column("loose", pa.array(loose)).to_batches()

    return run


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pack_pieces(spark: SparkSession, pieces: DataFrame, scratch: Scratch, capacity: int = 2048, per_partition: int = 16_384, turns: int = 8) -> DataFrame:
    """Pack pieces into as few sequences of ``capacity`` tokens as it can.

    A partition holds about ``per_partition`` pieces.  After each turn the
    loosest bins of every partition are opened and dealt out anew, so a piece
    meets pieces of other partitions; of a partition above its bound more are.
    What is open shrinks from turn to turn, until one partition holds it.
    """
    done, pool = [], pieces
    for turn in range(turns):
        n = pool.count()
        if not n:
            break
        parts = max(1, -(-n // per_partition))
        last = turn == turns - 1 or parts == 1
        packed = scratch.keep(pool.repartition(parts).mapInArrow(_packer(capacity, turn, last), PACKED), f"packed{turn}")
        done.append(packed.where("not loose").drop("loose"))
        if last:
            break
        pool = packed.where("loose").drop("sequence_id", "offset", "loose")
    if not done:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, per_partition: int = 16_384) -> DataFrame:
    """Documents to placed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty.  Repeated rows are packed once each.  A null
    doc_id is carried through.  Other columns of ``docs`` are ignored.  An empty
    table gives no rows.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.keep(tokenize_pieces(docs, tokenizer, capacity), "pieces")
    return pack_pieces(spark, pieces, scratch, capacity, per_partition)
