"""Near-duplicate documents by a chosen-path set similarity join.

A document's shingle set has a signature of minwise values.  In each tree a
node's documents are dealt out by one or two signature places that the node's
key selects, so that a pair at the threshold lives on in one child on average;
a document finds its own path without seeing the others.  Small nodes are
compared exhaustively on sketches, large ones are first compared with one
member and branch on while that leaves documents over, several times
independently, so that depth costs no recall.  Independent trees repeat until
the target recall.  What the trees bring together is confirmed on full
sets.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.components import components, label_min
from helixframe.llm.components import runs as _runs
from helixframe.llm.scratch import Scratch, small_batches
from helixframe.llm.textkernels import BY_SPACE, U64, mix, shingle_hashes, word_blocks

WIDTH = 5
#: Places of a signature, and those that a sketch shows (one byte each).
PLACES, SHOWN = 128, 64
#: Levels before nodes are counted, the largest node compared exhaustively, and levels at most.
DEPTH, NODE, DEEPEST = 2, 256, 12
#: A large node branches on only while more than this many of its documents are unlike its pivot.
#: Below that they are compared with the node's other documents, in blocks of NODE.
BRANCH = 32 * NODE
RECALL = 0.9999
#: Standard errors by which a sketch may fall short of the threshold.
ERRORS = 4.0
#: Documents whose full sets one task compares with each other, and bytes of sets that count as one document.
BLOCK, DOC_BYTES = 128, 65_536
PAIRWISE = 2
#: Rows of a few numbers each that are broadcast at most (some 10 MB); more are joined by a shuffle.
BROADCAST_IDS = 150_000

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, PLACES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, PLACES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_EMPTY = np.uint32(0xFFFFFFFF)


def second_place(threshold: float) -> float:
    """How often a node selects a second place, so that 1/threshold are selected on average."""
    return min(1.0, 1.0 / threshold - 1.0)


def survival(similarity: float, threshold: float, depth: int) -> float:
    """Probability that a pair of this similarity shares a node at ``depth`` of a tree."""
    p, s = second_place(threshold), 1.0
    for _ in range(depth):
        miss = 1 - similarity * s
        s = 1 - ((1 - p) * miss + p * miss * miss)
    return s


def trees_for(recall: float, threshold: float, depth: int) -> int:
    """Trees after which a pair at the threshold is missed with probability 1 - recall at most."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, threshold, depth))))


def branches_for(recall: float, threshold: float) -> int:
    """Times that a large node branches: a level may cost a pair a tenth of what the trees may."""
    return trees_for(1 - (1 - recall) / 10, threshold, 1)


def document_sets(column, width: int):
    """For each block of documents: (first, last, document of each distinct shingle, its hashes in both lanes), sorted within documents."""
    for a, b, _, words in word_blocks(column, BY_SPACE, lanes=2):
        doc, h = shingle_hashes(words, width)
        _, g = shingle_hashes(words, width, 1)
        order = np.lexsort((h, doc))
        doc, h, g = doc[order], h[order], g[order]
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        if (same & (g[1:] != g[:-1])).any():  # unequal shingles that agree in one lane
            order = np.lexsort((g, h, doc))
            doc, h, g = doc[order], h[order], g[order]
            same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        fresh = np.ones(len(h), bool)
        fresh[1:] = ~same | (g[1:] != g[:-1])
        yield a, b, doc[fresh], h[fresh], g[fresh]


def signatures(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, PLACES) minwise values; a document without shingles has the largest everywhere."""
    out = np.full((n, PLACES), _EMPTY, np.uint32)
    if len(h):
        has, first = np.unique(doc, return_index=True)
        high = (h >> U64(32)).astype(np.uint32)
        for k in range(PLACES):
            out[has, k] = np.minimum.reduceat((high ^ _XOR[k]) * _MUL[k], first)
    return out


FEATURES = "id long, n long, k1 long, k2 long, signature binary"


def features(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, doc, h, g in document_sets(batch.column(1), width):
                n = np.bincount(doc, minlength=b - a)
                keys = []
                for lane, other, salt in ((h, g, U64(0x51ED270B)), (g, h, U64(0x2545F491))):
                    # of both lanes, so that sets are told apart by what 128 bits tell apart
                    total = np.zeros(b - a, np.uint64)
                    np.add.at(total, doc, mix(mix(lane ^ salt) + other))
                    keys.append(total.view(np.int64))
                own = signatures(doc, h, b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), pa.array([x.tobytes() for x in own], pa.binary())],
                    ["id", "n", "k1", "k2", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def _children(key: np.ndarray, own: np.ndarray, often: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child key) for rows of node keys and signatures."""
    rows = np.arange(len(key))
    a = mix(key ^ U64(0xA5A5A5A5))
    first = (a % U64(PLACES)).astype(np.int64)
    second = ((a >> U64(20)) % U64(PLACES - 1)).astype(np.int64)
    second += second >= first
    both = (a >> U64(40)).astype(np.float64) / 2.0**24 < often
    rows_ = np.concatenate([rows, rows[both]])
    place = np.concatenate([first, second[both]])
    value = own[rows_, place].astype(np.uint64)
    return rows_, mix(key[rows_] * U64(0x9E3779B97F4A7C15) + (value << U64(8)) + place.astype(np.uint64))


def _matrix(column, dtype, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


NODES = "key long, id long, sketch binary"


def _nodes(key, ids, own) -> pa.RecordBatch:
    sketch = np.ascontiguousarray((own[:, :SHOWN] >> np.uint32(11)).astype(np.uint8))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.FixedSizeBinaryArray.from_buffers(pa.binary(SHOWN), len(ids), [None, pa.py_buffer(sketch)]).cast(pa.binary())], ["key", "id", "sketch"])


def plant(distinct: DataFrame, trees: int, depth: int, threshold: float) -> DataFrame:
    """(id, signature) to the nodes at ``depth`` of every tree that a document reaches."""
    often = second_place(threshold)

    def run(batches):
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint32, PLACES)
            for tree in range(trees):
                row, key = np.arange(len(ids)), np.full(len(ids), mix(np.array([tree + 1], np.uint64))[0])
                for _ in range(depth):
                    r, key = _children(key, own[row], often)
                    row = row[r]
                if len(row):
                    yield _nodes(key, ids[row], own[row])

    return distinct.select("id", "signature").mapInArrow(run, NODES)


def branch(nodes: DataFrame, threshold: float, times: int) -> DataFrame:
    """(key, id, signature) one level deeper, ``times`` times by places of their own."""
    often = second_place(threshold)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key, ids, own = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), _matrix(batch.column(2), np.uint32, PLACES)
                for trial in range(times):
                    r, child = _children(mix(key + U64(trial)), own, often)
                    yield _nodes(child, ids[r], own[r])

    return nodes.select("key", "id", "signature").mapInArrow(run, NODES)


def _bar(threshold: float) -> int:
    """Equal sketch places from which a pair is a candidate."""
    return max(1, math.floor(SHOWN * (threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / SHOWN))))


LINKS = "a long, b long"


def _links(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["a", "b"])


def compare_nodes(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (key, id, sketch), sorted by key in each partition, to candidate forests of each node."""
    bar = _bar(threshold)

    def run(batches):
        for table in _runs(batches, 50_000):
            key, ids, sk = table.column(0).to_numpy(), table.column(1).to_numpy(), _matrix(table.column(2), np.uint8, SHOWN)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            two = first[size == 2]
            good = (sk[two] == sk[two + 1]).sum(1) >= bar
            yield _links(ids[two[good]], ids[two[good] + 1])
            a, b = [], []
            for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own, x = ids[f : f + s], sk[f : f + s]
                i, j = np.nonzero(np.triu((x[:, None, :] == x[None, :, :]).sum(2) >= bar, 1))
                if len(i):
                    v, low = label_min(own[i], own[j])
                    a.append(v[v != low])
                    b.append(low[v != low])
            if a:
                yield _links(np.concatenate(a), np.concatenate(b))

    return rows.mapInArrow(run, LINKS)


def compare_sides(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (key, id, sketch, asks), sorted by key: those that ask against all of their key."""
    bar = _bar(threshold)

    def run(batches):
        for table in _runs(batches, 50_000):
            key, ids, sk, asks = table.column(0).to_numpy(), table.column(1).to_numpy(), _matrix(table.column(2), np.uint8, SHOWN), table.column(3).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for f, e in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                i = f + np.flatnonzero(asks[f:e])
                for c in range(0, len(i), 64):
                    r, j = np.nonzero((sk[i[c : c + 64], None, :] == sk[None, f:e, :]).sum(2) >= bar)
                    if len(r):
                        v, low = label_min(ids[i[c + r]], ids[f + j])
                        yield _links(v[v != low], low[v != low])

    return rows.mapInArrow(run, LINKS)


def candidates(spark: SparkSession, distinct: DataFrame, threshold: float, scratch: Scratch, recall: float = RECALL, node: int = NODE, depth: int = DEPTH) -> DataFrame:
    """Links between ids that some tree brought together and whose sketches agree."""
    bar = _bar(threshold)
    trees = trees_for(recall, threshold, depth)
    nodes = scratch.keep(plant(distinct, trees, depth, threshold), "nodes")
    found = []
    while True:
        counts = scratch.keep(nodes.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("pivot")).where("c > 1"), "counts")
        shared = nodes.join(_counted(counts), "key")
        small = shared.where(F.col("c") <= node).select("key", "id", "sketch")
        # AQE may not split what a join feeds here: a run of one key stays whole, and holds ``node`` rows at most
        found.append(scratch.keep(compare_nodes(small.repartition("key").sortWithinPartitions("key"), threshold), "small"))
        large = counts.where(F.col("c") > node)
        if not large.limit(1).count():
            scratch.drop(nodes)
            return _union(found)
        big = shared.where(F.col("c") > node)
        pivots = big.where("id = pivot").groupBy("key").agg(F.min("sketch").alias("of_pivot"))
        big = scratch.keep(big.join(pivots, "key").select("key", "id", "pivot", "c", "sketch", _agreement("sketch", "of_pivot").alias("agree")), "large")
        found.append(scratch.keep(big.where((F.col("agree") >= bar) & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "stars"))
        open_ = scratch.keep(big.where(F.col("agree") < bar).groupBy("key").agg(F.count("*").alias("rest")), "open")
        scratch.drop(nodes)
        depth += 1
        branching = F.col("rest") > (BRANCH if depth <= DEEPEST else 1 << 62)
        found.append(scratch.keep(_unlike(big.join(open_.where(~branching), "key"), threshold, node), "unlike"))
        open_ = open_.where(branching)
        if not open_.limit(1).count():
            return _union(found)
        deeper = big.join(open_.select("key"), "key").select("key", "id").join(distinct.select("id", "signature"), "id")
        nodes = scratch.keep(branch(deeper, threshold, branches_for(recall, threshold)), "nodes")


def _agreement(one: str, other: str) -> Column:
    """Equal places of two sketches."""

    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).sum(1).astype(np.int32))

    return F.pandas_udf(equal, "int")(one, other)


def _counted(small: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if a count of its rows allows it."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small.hint("merge")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _unlike(big: DataFrame, threshold: float, node: int) -> DataFrame:
    """Documents of large nodes that are unlike the pivot against all of their node, in blocks."""
    bar = _bar(threshold)
    parts = F.ceil(F.col("c") / node).cast("int")
    ask_parts = F.ceil(F.col("rest") / node).cast("int")
    own = F.pmod(F.xxhash64("id"), parts)
    ask = F.pmod(F.xxhash64("id"), ask_parts)
    all_ = big.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), ask_parts - 1))).withColumn("asks", F.lit(False))
    rest = big.where(F.col("agree") < bar).withColumn("j", ask).withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("asks", F.lit(True))
    pick = lambda d: d.select(F.xxhash64("key", "i", "j").alias("key"), "id", "sketch", "asks")
    return compare_sides(pick(all_).union(pick(rest)).repartition("key").sortWithinPartitions("key"), threshold)


SETS = "id long, grp long, c long, shingles binary"


def full_sets(docs: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """Shingles (128 bits each, both lanes) of the documents that ``groups`` (id, grp, and the group's size c) names."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(_counted(groups), "id").select("id", "grp", "c", "text")

    def run(batches):
        for batch in batches:
            for a, b, doc, h, g in document_sets(batch.column(3), width):
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                both = np.stack([h, g], 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array([both[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["id", "grp", "c", "shingles"])

    return chosen.mapInArrow(run, SETS)


def similar(x: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have ``100 * intersection >= percent * union`` with x; all sorted."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros(len(sets), bool)
    may = np.flatnonzero(100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x)))
    if len(may) and len(x):
        y = np.concatenate([sets[i] for i in may])
        at = np.searchsorted(x, y)
        hit = x[np.minimum(at, len(x) - 1)] == y
        first = np.concatenate([[0], np.cumsum(sizes[may])[:-1]])
        both = np.add.reduceat(hit.astype(np.int64), first)
        out[may] = 100 * both >= percent * (len(x) + sizes[may] - both)
    return out


def numbered(sets: list[bytes]) -> list[np.ndarray]:
    """Sets of 128-bit shingles as sorted numbers, equal where shingles are."""
    size = np.array([len(s) // 16 for s in sets], np.int64)
    both = np.frombuffer(b"".join(sets), np.uint64).reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0]))
    both = both[order]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(np.concatenate([[False], (both[1:] != both[:-1]).any(1)])[: len(order)])
    return [np.sort(x) for x in np.split(number, np.cumsum(size)[:-1])]


def confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (grp, id, shingles, asks), sorted by grp: links on full sets, leaving out pairs that are connected already.

    Where ``asks`` is PAIRWISE every pair of the group counts; elsewhere the rows with 1 meet all others.
    """

    def run(batches):
        for table in _runs(batches, 256):
            grp, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            shingles = table.column(2)
            asks = table.column(3).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            a, b = [], []
            for f, e in zip(first.tolist(), np.append(first[1:], len(grp)).tolist(), strict=True):
                if e - f < 2:
                    continue
                own = numbered(shingles.slice(f, e - f).to_pylist())
                label = np.arange(e - f)
                pairwise = asks[f] == PAIRWISE
                for i in range(e - f) if pairwise else np.flatnonzero(asks[f:e]).tolist():
                    other = np.flatnonzero(label != label[i])
                    if pairwise:
                        other = other[other > i]
                    if len(other):
                        good = other[similar(own[i], [own[j] for j in other], percent)]
                        for j in good.tolist():
                            if label[j] != label[i]:
                                label[label == label[j]] = label[i]
                            a.append(ids[f + i])
                            b.append(ids[f + j])
            if a:
                yield _links(a, b)

    return sets.mapInArrow(run, LINKS)


def _weight(n_bytes: Column) -> Column:
    """Documents that a row counts for: one, or more where its set is large."""
    return F.sum(F.greatest(F.lit(1), F.ceil(n_bytes / DOC_BYTES))).cast("long")


def verify(spark: SparkSession, docs: DataFrame, classes: DataFrame, links: DataFrame, percent: int, width: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Candidate links to links whose full sets agree, by groups that candidates connect."""
    groups = components(spark, links, scratch).withColumnRenamed("component_id", "grp").join(classes.select("id", "n"), "id")
    groups = groups.join(groups.groupBy("grp").agg(_weight(F.col("n") * 16).alias("c")), "grp").select("id", "grp", "c")
    groups = scratch.keep(groups, "groups")
    sets = scratch.keep(full_sets(docs, groups, width), "sets")
    small = sets.where(F.col("c") <= block).select("grp", "id", "shingles", F.lit(PAIRWISE).alias("asks"))
    out = [scratch.keep(confirmed(small.repartition("grp").sortWithinPartitions("grp", "id"), percent), "linked")]
    if groups.where(F.col("c") > block).limit(1).count():
        # a large group is compared with its first document; only what is unlike it asks the rest, in blocks
        whole = sets.where(F.col("c") > block).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / block)).cast("int"))
        head = whole.where("id = grp").select("grp", F.col("id").alias("head_id"), F.col("shingles").alias("head"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / block).cast("int") - 1)).alias("part"))
        stars = whole.where("id <> grp").select("grp", "part", "id", "shingles").union(head.select("grp", "part", "head_id", "head"))
        cell = stars.select(F.xxhash64("grp", "part").alias("grp"), "id", "shingles", (F.col("id") == F.col("grp")).cast("int").alias("asks"))
        star = scratch.keep(confirmed(cell.repartition("grp").sortWithinPartitions("grp", "id"), percent), "stars")
        out.append(star)
        tied = star.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        rest = whole.where("id <> grp").join(tied, "id", "left_anti")
        counts = scratch.keep(rest.groupBy("grp").agg(_weight(F.octet_length("shingles")).alias("rest")), "rest")
        if counts.limit(1).count():
            pieces = F.ceil(F.col("rest") / block).cast("int")
            every = whole.join(counts, "grp").withColumn("j", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("asks", F.lit(0))
            asking = rest.join(counts, "grp").withColumn("j", F.pmod(F.xxhash64("id"), pieces).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / block).cast("int") - 1))).withColumn("asks", F.lit(1))
            pick = lambda d: d.select(F.xxhash64("grp", "part", "j").alias("grp"), "id", "shingles", "asks")
            out.append(scratch.keep(confirmed(pick(every).union(pick(asking)).repartition("grp").sortWithinPartitions("grp", "id"), percent), "blocks"))
    scratch.drop(sets)
    return _union(out)


def _linked(spark: SparkSession, docs: DataFrame, percent: int, width: int, recall: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: features of all documents, one row a distinct set, and components of linked sets."""
    every = scratch.keep(features(docs, width), "features")
    classes = every.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.first("signature").alias("signature"))
    classes = scratch.keep(classes, "classes")
    links = candidates(spark, classes, percent / 100, scratch, recall)
    return every, classes, components(spark, verify(spark, docs, classes, links, percent, width, scratch), scratch)


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_shingles, component_id, kept.

    Documents link where ``100 * intersection >= percent * union`` of their
    distinct ``width``-word shingles (A-Z in lower case, words between ASCII
    white space; a text of fewer words is one shingle).  A text without words,
    or null, is empty and links with nothing.  Each row goes by its own
    text: rows that repeat a doc_id with other texts may be of other components;
    a null doc_id has n_shingles, a null component and is kept.  Other columns are ignored.  An empty table gives no rows.
    """
    scratch = Scratch(spark, "minhash")
    with small_batches(spark):
        every, classes, linked = _linked(spark, docs, percent, width, recall, scratch)
    known = classes.select("k1", "k2", "n", F.col("id").alias("rep")).join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    out = every.select("id", "n", "k1", "k2").join(known, ["k1", "k2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
