"""Repeated byte strings: exact, over the whole corpus, by sharded suffix arrays.

Every string of ``span`` bytes has one anchor, the least-hashed short gram in
it, so equal strings have equal anchors.  A document becomes segments, each the
strings of one anchor; segments meet by their anchor's hash.  Segments equal in
full (128 bits of blake2b over all of their bytes) keep their first copy only.  Where different segments share an anchor,
their bytes form a shard that is suffix-sorted by external induced sorting;
runs of suffixes with a common prefix of ``span`` bytes are equal strings, and
all but the first of a run are repeats.  Where more segments share an anchor
than one shard holds, each is split by anchors of another hash, and the parts
meet as segments do, up to ``SPLITS`` times.  Strings of parts that still share
an anchor with too many are told apart one by one, by digests that the cluster
aggregates; so no shard grows with the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.components import runs as _runs
from helixframe.llm.scratch import Scratch
from helixframe.llm.suffixsort import folder, sorted_buckets
from helixframe.llm.textkernels import U64, blocks, gram_values, mix, text_buffers

#: Bytes of the grams that anchor strings.
GRAM = 24
#: Bytes that are scanned at once; longer documents are scanned in overlapping pieces.
PIECE = 1_000_000
#: Bytes of a shard that are sorted together, about; a longer group of one anchor is split.
SHARD_BYTES = 2_000_000
#: Tuples that a sort's queues hold in memory; a shard of SHARD_BYTES has four times as many, and those go to disk.
QUEUE_TUPLES = 500_000
#: One segment in so many tells which anchors are common, and so many of these make one common.
LOOKED_AT, COMMON = 64, 24
#: So often a group of one anchor is split by anchors of another hash before it goes by its strings' digests.
SPLITS = 3
_PLACE_BITS = U64(24)


def _pieces(offsets: np.ndarray, span: int):
    """(first document, last, begin, end, start within the document) of what is scanned at once."""
    for a, b in blocks(offsets, PIECE):
        size = int(offsets[b] - offsets[a])
        if size <= PIECE:
            yield a, b, int(offsets[a]), int(offsets[b]), 0
        else:
            for at in range(0, size, PIECE):
                end = min(size, at + PIECE + span - 1)
                if end - at >= span:
                    yield a, b, int(offsets[a]) + at, int(offsets[a]) + end, at


def segments(offsets: np.ndarray, data: np.ndarray, span: int, level: int = 0):
    """Arrays (document, start, strings, anchor hash, two halves of a content digest) of the segments of a scanned piece.

    Each ``level`` ranks the grams by a hash of its own.
    """
    n = len(data)
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 2
    if n < span:
        return none
    grams = n - GRAM + 1
    whole = gram_values(data, GRAM)
    # the place breaks ties to the left, and tells which gram is the least
    rank = mix(whole + U64(level)) if level else whole
    value = (rank & ~((U64(1) << _PLACE_BITS) - U64(1))) | np.arange(grams, dtype=np.uint64)
    width = span - GRAM + 1
    padded = np.full(-(-grams // width) * width, U64(2**64 - 1))
    padded[:grams] = value
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - span + 1
    least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
    anchor = (least & ((U64(1) << _PLACE_BITS) - U64(1))).astype(np.int64)
    inside = np.ones(m + 1, bool)
    inside[m] = False
    ends = offsets[1:-1]
    # strings that would cross the end of a document
    over = np.zeros(m + 1, np.int32)
    np.add.at(over, np.clip(ends - span + 1, 0, m), 1)
    np.add.at(over, np.clip(ends, 0, m), -1)
    inside &= np.cumsum(over) == 0
    inside = inside[:m]
    fresh = inside.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(fresh)
    if not len(start):
        return none
    stop = np.flatnonzero(inside & np.append((anchor[1:] != anchor[:-1]) | ~inside[1:], True)) + 1
    count = stop - start
    doc = np.searchsorted(offsets, start, "right") - 1
    raw = memoryview(data)
    digests = b"".join([hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), (stop + span - 1).tolist(), strict=True)])
    content = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return [doc, start - offsets[doc], count, mix(whole[anchor[start]]), content[:, 0], content[:, 1]]


ANCHORS = "h long, g long, g2 long, doc long, at long, again boolean"


def anchors(docs: DataFrame, span: int) -> DataFrame:
    """(doc, text) to segments; ``at`` holds start * 256 + strings.

    Of equal segments that a task sees together only the first goes on to meet
    others; the rest are repeats already (``again``).  The same segment of a
    repeated row is left out.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, data = text_buffers(batch.column(1))
            for a, b, lo, hi, at in _pieces(offsets, span):
                doc, start, count, h, g, g2 = segments(offsets[a : b + 1] - lo if b - a > 1 else np.array([0, hi - lo]), data[lo:hi], span)
                if not len(doc):
                    continue
                own, place = ids[a + doc], ((start + at) << 8) | count
                order = np.lexsort((place, own, g2, g, h))
                h, g, g2, own, place = h[order], g[order], g2[order], own[order], place[order]
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (g2[1:] == g2[:-1])
                new = np.ones(len(h), bool)
                new[1:] = ~again[1:] | (own[1:] != own[:-1]) | (place[1:] != place[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (h.view(np.int64), g, g2, own, place, again)], ["h", "g", "g2", "doc", "at", "again"])

    return docs.where("doc is not null").select("doc", "text").mapInArrow(run, ANCHORS)


MET = "h long, doc long, at long, again boolean"


def meet(rows: DataFrame, lonely: bool = False) -> DataFrame:
    """Segments sorted by (h, g, g2, doc, at): later equal segments at other places are repeats; first ones whose anchor others share go on.

    With ``lonely`` all first ones go on, wherever the others of their anchor are.
    A sixth column ``bytes`` goes along.
    """
    cut = len(rows.columns) > 5

    def run(batches):
        before = None  # h, g, g2, doc, at of the last row
        open_ = None  # the last first segment, while no other shares its anchor
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, g2, doc, at = (batch.column(i).to_numpy() for i in range(5))
            texts = [batch.column(5)] if cut else []
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (g2[1:] == g2[:-1])
            again[0] = before is not None and before[:3] == (h[0], g[0], g2[0])
            first = np.flatnonzero(~again)
            keep = np.ones(len(h), bool)
            keep[1:] = ~again[1:] | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
            keep[0] = before != (h[0], g[0], g2[0], doc[0], at[0])
            rest = None
            if len(first):
                shared = np.zeros(len(first) + 1, bool)
                shared[0] = before is not None and before[0] == h[first[0]]
                shared[1:-1] = h[first][1:] == h[first][:-1]
                if open_ is not None and shared[0]:
                    rest, rest_texts = open_
                lone = ~shared[:-1] & ~shared[1:] & (not lonely)
                keep[first[lone]] = False
                last = slice(first[-1], first[-1] + 1)
                open_ = (tuple(x[last] for x in (h, doc, at, again)), [x[last] for x in texts]) if lone[-1] else None
            before = (h[-1], g[-1], g2[-1], doc[-1], at[-1])
            out = [x[keep] for x in (h, doc, at, again)]
            texts = [x.filter(pa.array(keep)) for x in texts]
            if rest is not None:
                out = [np.concatenate(x) for x in zip(rest, out, strict=True)]
                texts = [pa.concat_arrays(x) for x in zip(rest_texts, texts, strict=True)]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out] + texts, ["h", "doc", "at", "again", "bytes"][: 5 if cut else 4])

    return rows.mapInArrow(run, MET + (", bytes binary" if cut else ""))


def meet_all(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """What ``meet`` gives for segments (h, g, g2, doc, at and maybe bytes), written; common anchors are spread over tasks.  Repeats have no bytes."""
    # segments of a common anchor meet by their content as well, so they spread over tasks; none of them is alone
    looked = rows.where(F.pmod(F.xxhash64("doc", "at"), F.lit(LOOKED_AT)) == 0).groupBy("h").count()
    common = scratch.keep(looked.where(F.col("count") >= COMMON).select("h"), "common")
    order = ["h", "g", "g2", "doc", "at"]

    def keep(met: DataFrame, label: str) -> DataFrame:
        return scratch.keep(met.withColumn("bytes", F.when(~F.col("again"), F.col("bytes"))) if "bytes" in met.columns else met, label)

    met = []
    if common.take(1):
        spread = rows.join(_few(common), "h", "left_semi").select(*rows.columns).repartition("h", "g", "g2").sortWithinPartitions(*order)
        met.append(keep(meet(spread, True), "common-met"))
        rows = rows.join(_few(common), "h", "left_anti").select(*rows.columns)
    met.append(keep(meet(rows.repartition("h").sortWithinPartitions(*order)), "met"))
    return met[0] if len(met) == 1 else met[0].unionByName(met[1])


PARTS = "h long, g long, g2 long, doc long, at long, bytes binary"


def split(rows: DataFrame, span: int, level: int) -> DataFrame:
    """Segments with bytes to parts by anchors of another hash; ``h`` stands for the anchors of both."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                h, own, place = (part.column(k).to_numpy() for k in range(3))
                texts = part.column(3).to_pylist()
                raw = b"".join(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
                which, start, count, anchor, g, g2 = segments(offsets, np.frombuffer(raw, np.uint8), span, level)
                if not len(which):
                    continue
                lo = offsets[which] + start
                cut = [raw[x:y] for x, y in zip(lo.tolist(), (lo + count + span - 1).tolist(), strict=True)]
                key = mix(h[which].view(np.uint64) ^ anchor).view(np.int64)
                at = (((place[which] >> 8) + start) << 8) | count
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, g, g2, own[which], at)] + [pa.array(cut, pa.binary())], ["h", "g", "g2", "doc", "at", "bytes"])

    return rows.mapInArrow(run, PARTS)


BYTES = "h long, doc long, at long, bytes binary"


def cut_out(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of segments (h, doc, at)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("at", "h")).alias("cuts"))  # a document's own segments
    lists = lists.select("doc", F.col("cuts.at").alias("ats"), F.col("cuts.h").alias("hs"))
    chosen = docs.select("doc", "text").join(lists, "doc")

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            offsets, data = text_buffers(batch.column(1))
            raw = memoryview(data)
            n = np.diff(batch.column(2).offsets.to_numpy())
            at, h = batch.column(2).flatten().to_numpy(), batch.column(3).flatten()
            row = np.repeat(np.arange(len(n)), n)
            lo = offsets[row] + (at >> 8)
            hi = lo + (at & 255) + span - 1
            for i in range(0, len(row), 20_000):
                s = slice(i, i + 20_000)
                cut = [bytes(raw[x:y]) for x, y in zip(lo[s].tolist(), hi[s].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([h[s], ids.take(pa.array(row[s])), pa.array(at[s]), pa.array(cut, pa.binary())], ["h", "doc", "at", "bytes"])

    return chosen.select("doc", "text", "ats", "hs").mapInArrow(run, BYTES)


RANGES = "doc long, at long"


def shard_repeats(doc: np.ndarray, at: np.ndarray, texts: list[bytes], span: int, queue: int, store) -> tuple[np.ndarray, np.ndarray]:
    """Repeats (doc, start * 256 + strings) within a shard whose segments come in document order for each anchor."""
    size = np.array([len(x) for x in texts])
    begin = np.cumsum(size + 1) - (size + 1)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    t = joined.astype(np.uint16) + 1
    t[begin + size] = 0  # nothing matches across the end of a segment
    strings = np.zeros(len(t) + 1, np.int32)
    strings[begin] += 1
    strings[begin + (at & 255)] -= 1
    is_start = np.cumsum(strings[:-1]) > 0
    again = np.zeros(len(t) + 1, bool)
    for position, prefix in sorted_buckets(t, 257, span, depth=2 * span, budget=queue, store=store):
        group = np.cumsum(prefix < span)  # suffixes of different first symbols are of different groups
        kept = is_start[position]
        position, group = position[kept], group[kept]
        if not len(position):
            continue
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.repeat(np.minimum.reduceat(position, heads), np.diff(np.append(heads, len(position))))
        again[position[position > least]] = True
    edge = np.diff(np.concatenate([[False], again]).astype(np.int8))
    lo, hi = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    which = np.searchsorted(begin, lo, "right") - 1
    return doc[which], (((at[which] >> 8) + lo - begin[which]) << 8) | (hi - lo)


def sort_shards(rows: DataFrame, span: int, shared: str, shard_bytes: int = SHARD_BYTES, queue: int = QUEUE_TUPLES) -> DataFrame:
    """Segments with bytes, sorted by (h, doc, at), to repeated ranges."""

    def run(batches):
        store = folder(f"{shared}/{uuid.uuid4().hex}")
        try:
            for table in _runs(batches, shard_bytes // (span + 40)):
                key = [table.column(i).to_numpy() for i in range(3)]
                new = np.ones(table.num_rows, bool)  # a repeated row's segments were cut from each of its rows
                new[1:] = np.any([x[1:] != x[:-1] for x in key], axis=0)
                table = table.filter(pa.array(new))
                got = shard_repeats(table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(3).to_pylist(), span, queue, store)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["doc", "at"])
        finally:
            if store is not None:
                store.close()

    return rows.mapInArrow(run, RANGES)


STRINGS = "s1 long, s2 long, doc long, at long"


def strings(rows: DataFrame, span: int) -> DataFrame:
    """Segments with bytes to their strings: 128 bits of digest, and the place as start * 256 + 1."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                doc, at = part.column(1).to_numpy(), part.column(2).to_numpy()
                n = at & 255
                cuts = part.column(3).to_pylist()
                raw = b"".join(hashlib.blake2b(x[j : j + span], digest_size=16).digest() for x, m in zip(cuts, n.tolist(), strict=True) for j in range(m))
                digest = np.frombuffer(raw, "<i8").reshape(-1, 2)
                step = np.arange(len(digest)) - np.repeat(np.cumsum(n) - n, n)
                place = ((np.repeat(at >> 8, n) + step) << 8) | 1
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1)] + [pa.array(np.repeat(doc, n)), pa.array(place)], ["s1", "s2", "doc", "at"])

    return rows.mapInArrow(run, STRINGS)


def string_repeats(rows: DataFrame) -> DataFrame:
    """(doc, at) of the strings that aren't the first of their digest; no task needs all rows of a digest."""
    first = rows.groupBy("s1", "s2").agg(F.min(F.struct("doc", "at")).alias("least"), F.count("*").alias("n"))
    first = first.where("n > 1").select("s1", "s2", "least")
    return rows.join(first, ["s1", "s2"]).where(F.struct("doc", "at") != F.col("least")).select("doc", "at")


def repeated_ranges(spark: SparkSession, docs: DataFrame, scratch: Scratch, span: int = 100) -> DataFrame:
    """(doc, at) where ``at`` is start * 256 + strings: the strings of ``span`` bytes that also start earlier."""
    found = scratch.keep(anchors(docs, span), "anchors")
    known = scratch.keep(found.where("again").select("doc", "at"), "known")
    met = meet_all(found.where("not again").select("h", "g", "g2", "doc", "at"), scratch)
    scratch.drop(found)
    out = known.union(met.where("again").select("doc", "at"))
    shared = met.where("not again").select("h", "doc", "at")
    most = SHARD_BYTES // (span + 40)

    def crowded_of(rows: DataFrame) -> DataFrame:
        return scratch.keep(rows.groupBy("h").count().where(F.col("count") > most).select("h"), "crowded")

    crowded = crowded_of(shared)
    cuts = cut_out(docs, shared, span)
    few = []
    if crowded.take(1):
        cuts = scratch.keep(cuts, "cuts")  # written, so that the texts are shuffled for it once
        for level in range(1, SPLITS + 2):
            few.append(cuts.join(_few(crowded), "h", "left_anti").select("h", "doc", "at", "bytes"))
            cuts = cuts.join(_few(crowded), "h", "left_semi").select("h", "doc", "at", "bytes")
            if level > SPLITS:
                out = out.union(scratch.keep(string_repeats(scratch.keep(strings(cuts, span), "strings")), "string-repeats"))
                break
            met = meet_all(split(cuts, span, level), scratch)
            out = out.union(met.where("again").select("doc", "at"))
            cuts = met.where("not again").select("h", "doc", "at", "bytes")
            crowded = crowded_of(cuts)
            if not crowded.take(1):
                few.append(cuts)
                break
    else:
        few.append(cuts)
    bytes_ = functools.reduce(DataFrame.union, few).repartition("h").sortWithinPartitions("h", "doc", "at")
    return out.union(scratch.keep(sort_shards(bytes_, span, scratch.path("spill")), "sorted"))


def _few(anchors_: DataFrame) -> DataFrame:
    """A written list of anchors, broadcast if a count of its rows allows it."""
    return F.broadcast(anchors_) if anchors_.count() <= 500_000 else anchors_


def _with_order(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ``doc``, which orders texts as their ids do.  Texts that differ under one id stand in the order of their hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.take(1):
        return rows.withColumn("doc", F.col("doc_id"))
    hashed = rows.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    places = hashed.where("doc_id is not null").select("doc_id", "t").distinct().orderBy("doc_id", "t")
    # written once: these numbers rise along the sorted table, and are not the same when worked out again
    places = scratch.keep(places.withColumn("doc", F.monotonically_increasing_id()), "order")
    return hashed.join(places, ["doc_id", "t"], "left").select("doc_id", "text", "doc")


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(spark: SparkSession, docs: DataFrame, span: int = 100, text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes, where asked).

    Each byte goes that is covered by a string of ``span`` bytes which also
    starts earlier, in a smaller doc_id or before in the same document.  Null
    text is empty; a text below ``span`` bytes stays.  Rows that repeat a doc_id
    count as one text if equal, else as texts in the order of their hashes;
    documents without an id stay as they are.  Other columns are ignored.  An empty table gives no rows.  ``span`` is 25 to 250.
    """
    if not GRAM < span <= 250:
        raise ValueError(f"span must be from {GRAM + 1} to 250")
    scratch = Scratch(spark, "repeats")
    rows = _with_order(docs, scratch)
    ranges = repeated_ranges(spark, rows, scratch, span).groupBy("doc").agg(F.collect_list("at").alias("ats"))
    rows = rows.join(ranges, "doc", "left").select("doc_id", "text", "ats")

    def run(batches):
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            raw = memoryview(data)
            lists = batch.column(2).fill_null(pa.scalar([], pa.list_(pa.int64())))
            first, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for i in range(batch.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                at = np.sort(flat[first[i] : first[i + 1]])
                if not len(at):
                    out.append((len(own), 0, 0, own))
                    continue
                lo, hi = at >> 8, (at >> 8) + (at & 255) + span - 1
                reach = np.maximum.accumulate(hi)
                new = np.concatenate([[True], lo[1:] > reach[:-1]])
                lo, hi = lo[new], np.append(reach[:-1][new[1:]], reach[-1])
                keep = [own[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(own)], strict=True)]
                out.append((len(own), int((hi - lo).sum()), len(lo), b"".join(keep)))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            columns.append(pa.array([hashlib.sha256(r[3]).hexdigest() for r in out], pa.string()))
            if text:
                columns.append(pa.array([bytes(r[3]) for r in out], pa.binary()))
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = f"doc_id long, {OUT}" + (", kept binary" if text else "")
    return rows.mapInArrow(run, schema)
