"""Grouped operators around the sequential kernels; each group is bounded before it, by a top-n or by coverage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import kernels as K
from helixframe.functions.sequence import reverse_complement

#: Candidates looked at for each template, and the size of a batch between coverage checks.
EXAMINED, BATCH = 300, 50


def chain_best(seeds: DataFrame, lengths: DataFrame | None = None, k: int = 15, max_gap: int = 5000, band: int = 500, least: int = 30, least_seeds: int = 3, chains: int = 1) -> DataFrame:
    """Seeds (qid, qdir, sid, qoff, soff) to the best chains of each pair and direction, as candidates.

    A pair's seeds are bounded by the occurrence cutoff of the seed join and by
    both lengths.
    """

    def best(key, pdf):
        q, s = pdf.qoff.to_numpy(), pdf.soff.to_numpy()
        rows = []
        for score, path in K.chain(q, s, k, max_gap, band, least, least_seeds)[:chains]:
            a, z = path[0], path[-1]
            rows.append((*key, score, int(q[a]), int(q[z]) + k, int(s[a]), int(s[z]) + k, len(path)))
        return pd.DataFrame(rows, columns=["qid", "qdir", "sid", "score", "qbeg", "qend", "sbeg", "send", "seeds"])

    return seeds.groupBy("qid", "qdir", "sid").applyInPandas(best, "qid long, qdir int, sid long, score long, qbeg long, qend long, sbeg long, send long, seeds long")


CANDIDATES = "qid long, qdir int, sid long, score long, qbeg long, qend long, sbeg long, send long, qoff long, soff long"


def block_candidates(seeds: DataFrame, k: int = 15, block: int = 2000, least: int = 3, ratio: float = 0.25, span: int = 400) -> DataFrame:
    """Seeds (qid, qdir, sid, qoff, soff) to candidates by blocks of the subject, with the seed that each grew from."""

    def one(key, pdf):
        rows = K.block_candidates(pdf.qoff.to_numpy(), pdf.soff.to_numpy(), k, block, least=least, ratio=ratio, span=span)
        return pd.DataFrame([(*key, *r) for r in rows], columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return seeds.groupBy("qid", "qdir", "sid").applyInPandas(one, CANDIDATES)


MATCHES = "qid long, qdir int, sid long, qoff long, soff long, size long"


def _with_seeds(seeds: DataFrame, reads: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """One row a pair and strand: its seeds as arrays, and both sequences, the query's on its strand."""
    pairs = seeds.groupBy("qid", "qdir", "sid").agg(F.collect_list("qoff").alias("qs"), F.collect_list("soff").alias("ss"))
    return with_sequences(pairs, reads, subjects)


def exact_matches(seeds: DataFrame, reads: DataFrame, k: int = 10, least: int = 15, subjects: DataFrame | None = None) -> DataFrame:
    """Seeds grown to maximal exact matches of ``least`` bases or more, each once."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                found = K.exact_matches(K.encode(r.q_seq), K.encode(r.s_seq), np.asarray(r.qs), np.asarray(r.ss), k, least)
                rows += [(r.qid, r.qdir, r.sid, *map(int, m)) for m in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHES.split(", ")])

    rows = _with_seeds(seeds, reads, subjects)
    return rows.select("qid", "qdir", "sid", "qs", "ss", "q_seq", "s_seq").mapInPandas(run, MATCHES)


def chain_matches(matches: DataFrame, max_gap: int = 3000, band: int = 500, least: int = 100) -> DataFrame:
    """Exact matches to the best chain of each pair and strand, as candidates that grew from their longest match."""

    def one(key, pdf):
        m = pdf.sort_values(["soff", "qoff"])[["qoff", "soff", "size"]].to_numpy()
        rows = []
        for score, path in K.chain_matches(m, max_gap, band, least)[:1]:
            a, z = m[path[0]], m[path[-1]]
            seed = m[path[int(np.argmax(m[path, 2]))]]
            rows.append((*key, score, int(a[0]), int(z[0] + z[2]), int(a[1]), int(z[1] + z[2]), int(seed[0]), int(seed[1])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return matches.groupBy("qid", "qdir", "sid").applyInPandas(one, CANDIDATES)


def extend_candidates(candidates: DataFrame, reads: DataFrame, block: int = 512, most_hang: int = 200, reach: int = 300, min_span: int = 400, subjects: DataFrame | None = None) -> DataFrame:
    """Candidates (with qoff, soff) to alignments from their seeds, with the rescues of ``align_candidate``."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                a0, a1, b0, b1, qa, qb = K.align_candidate(r.q_seq, r.s_seq, (r.qbeg, r.qend, r.sbeg, r.send), (r.qoff, r.soff), block, most_hang, reach)
                if min(a1 - a0, b1 - b0) >= min_span:
                    rows.append((r.qid, r.qdir, r.sid, a0, a1, b0, b1, int((qa != qb).sum()), K.identity(qa, qb), K.decode(qa), K.decode(qb)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])

    need = ["qid", "qdir", "sid", "qbeg", "qend", "sbeg", "send", "qoff", "soff", "q_seq", "s_seq"]
    return with_sequences(candidates, reads, subjects).select(*need).mapInPandas(run, ALIGNED)


def uncontained(candidates: DataFrame, key: tuple[str, ...] = ("qid", "sid", "qdir")) -> DataFrame:
    """One candidate of each pair and strand, the best: what the assembly mapper aligns."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "qbeg", "sbeg", "qend", "send")
    return candidates.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def drop_contained(candidates: DataFrame) -> DataFrame:
    """Candidates whose seed lies in none of the spans kept before it, of the same pair and strand, by score."""

    def one(key, pdf):
        pdf = pdf.sort_values(["score", "qbeg", "sbeg", "qend", "send"], ascending=[False, True, True, True, True])
        spans, keep = [], []
        for r in pdf.itertuples(index=False):
            inside = any(a <= r.qoff <= b and c <= r.soff <= d for a, b, c, d in spans)
            keep.append(not inside)
            if not inside:
                spans.append((r.qbeg, r.qend, r.sbeg, r.send))
        return pdf[keep]

    return candidates.groupBy("qid", "qdir", "sid").applyInPandas(one, candidates.schema)


def compare_sequences(pairs: DataFrame, k: int = 11) -> DataFrame:
    """``pairs`` (id, one, other) with coverage of one by the best match with other, and that match's identity, in percent."""

    def run(frames):
        for pdf in frames:
            got = [K.similarity(a, b, k) for a, b in zip(pdf.one, pdf.other, strict=True)]
            yield pd.DataFrame({"id": pdf.id, "coverage": [100 * g[0] for g in got], "identity": [100 * g[1] for g in got]})

    return pairs.select("id", "one", "other").mapInPandas(run, "id long, coverage double, identity double")


def bubble_branches(branches: DataFrame, max_identity: float = 96.0, max_coverage: float = 97.0, least: int = 2000) -> DataFrame:
    """``branches`` (bubble, rank, seq) that say something new: each bubble's first, and others of ``least`` bases or more that are unlike it."""
    first = branches.where("rank = 0").select("bubble", F.col("seq").alias("first"))
    rows = branches.where("rank > 0").join(first, "bubble").where((F.length("seq") >= least) & (F.length("first") >= least))
    pairs = rows.select(F.xxhash64("bubble", "rank").alias("id"), "bubble", "rank", F.col("seq").alias("one"), F.col("first").alias("other"))
    unlike = pairs.join(compare_sequences(pairs), "id").where((F.col("identity") <= max_identity) | (F.col("coverage") < max_coverage))
    kept = unlike.select("bubble", "rank", "identity", "coverage")
    heads = kept.select("bubble").distinct().select("bubble", F.lit(0).cast(branches.schema["rank"].dataType).alias("rank"), F.lit(100.0).alias("identity"), F.lit(100.0).alias("coverage"))
    return branches.join(kept.unionByName(heads), ["bubble", "rank"]).select("bubble", "rank", "identity", "coverage", "seq")


def with_sequences(pairs: DataFrame, reads: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Candidates with the query (on its strand) and subject sequences: q_seq, s_seq.  Subjects are reads, if not given."""
    q = reads.select(F.col("read_id").alias("qid"), F.col("seq").alias("q_seq"))
    s = (reads if subjects is None else subjects).select(F.col("read_id").alias("sid"), F.col("seq").alias("s_seq"))
    out = pairs.join(q, "qid").join(s, "sid")
    return out.withColumn("q_seq", F.when(F.col("qdir") == 1, reverse_complement(F.col("q_seq"))).otherwise(F.col("q_seq")))


ALIGNED = "qid long, qdir int, sid long, qbeg long, qend long, sbeg long, send long, edits long, identity double, q_aln string, s_aln string"


def align_candidates(pairs: DataFrame) -> DataFrame:
    """Global alignment of each candidate's spans (``with_sequences``): edits, identity and both aligned strings."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                edits, qa, qb = K.align(r.q_seq[r.qbeg : r.qend], r.s_seq[r.sbeg : r.send])
                rows.append((r.qid, r.qdir, r.sid, r.qbeg, r.qend, r.sbeg, r.send, edits, K.identity(qa, qb), K.decode(qa), K.decode(qb)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])

    need = ["qid", "qdir", "sid", "qbeg", "qend", "sbeg", "send", "q_seq", "s_seq"]
    return pairs.select(*need).mapInPandas(run, ALIGNED)


def column_counts(aligned: DataFrame) -> DataFrame:
    """Aligned strings to summed columns by template: t_pos, delta, base, the column before, and weight.

    Plain SQL functions: the strings are exploded, positions are window sums,
    and equal columns are added up before they are shuffled.
    """
    e = (100.0 - F.col("identity")) / 200.0
    key = ["sid", "qid", "qdir"]
    rows = aligned.select(*key, "sbeg", ((1 - e) * (1 - e) + e * e / 3).alias("weight"), F.posexplode(F.arrays_zip(F.split("q_aln", "").alias("q"), F.split("s_aln", "").alias("s"))).alias("i", "c")).where("c.q <> ''")
    w = Window.partitionBy(*key).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*key, "weight", "i", F.col("c.q").alias("base"), (F.col("sbeg") - 1 + F.sum(F.when(F.col("c.s") != "-", 1).otherwise(0)).over(upto)).alias("t_pos"), (F.col("c.s") == "-").alias("ins"))
    last = F.max(F.when(~F.col("ins"), F.col("i"))).over(upto)
    rows = rows.withColumn("delta", F.when(F.col("ins"), F.col("i") - F.coalesce(last, F.lit(-1))).otherwise(0).cast("int"))
    rows = rows.withColumns({"p_t_pos": F.coalesce(F.lag("t_pos").over(w), F.lit(-1)), "p_delta": F.coalesce(F.lag("delta").over(w), F.lit(0)), "p_base": F.coalesce(F.lag("base").over(w), F.lit("-"))})
    return rows.groupBy("sid", "t_pos", "delta", "base", "p_t_pos", "p_delta", "p_base").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


CORRECTED = "template long, start long, end long, n_used int, cutoff double, seq string"


def correct(candidates: DataFrame, reads: DataFrame, min_coverage: int = 4, max_coverage: int = 12, min_identity: float = 50.0, min_span: int = 500, whole: bool = False) -> DataFrame:
    """Corrected pieces of each template (sid) from its best candidates.

    Candidates are taken by score in batches until every position is covered
    ``max_coverage`` times; a query counts once, after an alignment of it
    succeeded.  Runs with coverage ``min_coverage`` or more give a piece; with
    ``whole`` the pieces are put back into the template's other bases.
    """
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("score"), "qid", "qdir", "qbeg", "sbeg"))
    top = with_sequences(candidates.withColumn("rank", rank).where(F.col("rank") <= EXAMINED), reads)

    def one(key, pdf):
        pdf = pdf.sort_values("rank")
        template = pdf.s_seq.iloc[0]
        depth = np.zeros(len(template) + 1, np.int64)
        done, found, idents = set(), [], []
        for n, r in enumerate(pdf.itertuples(index=False)):
            if n % BATCH == 0 and n and (np.cumsum(depth)[:-1] >= max_coverage).all():
                break
            if r.qid in done or r.send - r.sbeg < min_span:
                continue
            _, qa, qb = K.align(r.q_seq[r.qbeg : r.qend], template[r.sbeg : r.send])
            ident = K.identity(qa, qb)
            if ident < min_identity:
                continue
            done.add(r.qid)
            idents.append(ident)
            found.append((ident, qa, qb, r.sbeg, r.send))
            depth[r.sbeg] += 1
            depth[r.send] -= 1
        first = sorted(idents[:15], reverse=True)
        used = first[: int(len(first) * 0.7)] if len(first) >= 8 else first
        cutoff = float(np.mean(used) - 5 * np.std(used)) if len(first) >= 5 else 0.0
        found = [f for f in found if f[0] >= cutoff]
        depth[:] = 0
        parts, weights = [], []
        for ident, qa, qb, lo, hi in found:
            t = K.tags(qa, qb, lo)
            e = (100 - ident) / 200
            parts.append(t)
            weights.append(np.full(len(t), (1 - e) ** 2 + e * e / 3))
            depth[lo] += 1
            depth[hi] -= 1
        cover = np.cumsum(depth)[:-1]
        edge = np.diff(np.concatenate([[0], (cover >= min_coverage).astype(np.int8), [0]]))
        rows, last = [], 0
        if found:
            table, inv = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
            total = np.bincount(inv.ravel(), np.concatenate(weights), len(table))
            for lo, hi in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
                if hi - lo < 0.85 * min_span:
                    continue
                mine = (table[:, 0] >= lo) & (table[:, 0] < hi)
                a, b, seq = K.consensus(table[mine], total[mine], {i: float(cover[i]) for i in range(lo, hi)})
                rows.append((a, b, seq))
        if whole:
            text = ""
            for a, b, seq in rows:
                text, last = text + template[last:a] + seq, b
            rows = [(0, len(template), text + template[last:])]
        return pd.DataFrame([(key[0], a, b, len(found), cutoff, s) for a, b, s in rows], columns=[c.split()[0] for c in CORRECTED.split(", ")])

    return top.groupBy("sid").applyInPandas(one, CORRECTED)


def trim_by_consensus(overlaps: DataFrame, ranges: DataFrame, reads: DataFrame, most: int = 300, max_coverage: int = 12, min_identity: float = 90.0, min_size: int = 500) -> DataFrame:
    """Consensus of each b read within its range (``ranges``: read_id, left, right): template, start, end, n_used, cutoff, seq.

    Overlaps go by identity, in batches, until the range is covered
    ``max_coverage`` times; the longest stretch of it that any alignment of
    ``min_identity`` covers gives the sequence.  A reversed a read's coordinates
    are those of its forward strand.
    """
    rank = F.row_number().over(Window.partitionBy("b_id").orderBy(F.desc("identity"), F.desc(F.col("b_end") - F.col("b_start")), "a_id", "a_start", "b_start"))
    rows = overlaps.join(ranges.select(F.col("read_id").alias("b_id"), "left", "right"), "b_id").where((F.col("b_end") > F.col("left")) & (F.col("b_start") < F.col("right")))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    turned = F.col("a_strand") != F.col("b_strand")
    rows = rows.select(
        F.col("a_id").alias("qid"), F.col("b_id").alias("sid"), turned.cast("int").alias("qdir"), F.when(turned, F.col("a_len") - F.col("a_end")).otherwise(F.col("a_start")).alias("qbeg"),
        F.when(turned, F.col("a_len") - F.col("a_start")).otherwise(F.col("a_end")).alias("qend"), F.col("b_start").alias("sbeg"), F.col("b_end").alias("send"), "left", "right", "rank",
    )

    def one(key, pdf):
        pdf = pdf.sort_values("rank")
        template, left, right = pdf.s_seq.iloc[0], int(pdf.left.iloc[0]), int(pdf.right.iloc[0])
        depth, parts = np.zeros(len(template), np.int64), []
        for n, r in enumerate(pdf.itertuples(index=False)):
            if n and n % BATCH == 0 and (depth[left:right] >= max_coverage).all():
                break
            if (depth[max(left, r.sbeg) : min(right, r.send)] >= max_coverage).all():
                continue
            _, qa, qb = K.align(r.q_seq[r.qbeg : r.qend], template[r.sbeg : r.send])
            if K.identity(qa, qb) >= min_identity:
                parts.append(K.tags(qa, qb, r.sbeg))
                depth[r.sbeg : r.send] += 1
        edge = np.diff(np.concatenate([[0], (depth[left:right] > 0).astype(np.int8), [0]]))
        spans = sorted(((int(a - b), int(a)) for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)))
        rows = []
        if spans and -spans[0][0] >= min_size:
            lo, hi = left + spans[0][1], left + spans[0][1] - spans[0][0]
            table, inv = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
            total = np.bincount(inv.ravel(), minlength=len(table)).astype(float)
            mine = (table[:, 0] >= lo) & (table[:, 0] < hi)
            a, b, seq = K.consensus(table[mine], total[mine], {i: float(depth[i]) for i in range(lo, hi)})
            if len(seq) >= min_size:
                rows.append((key[0], a, b, len(parts), min_identity, seq))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CORRECTED.split(", ")])

    return with_sequences(rows, reads).groupBy("sid").applyInPandas(one, CORRECTED)


CHOSEN = "sid long, part int, lo long, qid long, qdir int, qbeg long, qend long, sbeg long, send long, a long, b long"
PIECES = "sid long, part int, at long, q_aln binary, s_aln binary"
#: Columns of alignments that a segment holds before equal ones are summed.
FOLD_TAGS = 1_000_000


def _until_full(hits: DataFrame, max_coverage: int) -> DataFrame:
    """Of all mappings to a segment, longest first, those (``a`` to ``b``) that meet a base covered less than ``max_coverage`` times.

    Only coordinates are grouped; what is chosen is bounded by the coverage.
    """

    def one(key, pdf):
        pdf = pdf.iloc[np.lexsort([pdf.qbeg, pdf.sbeg, pdf.qdir, pdf.qid, pdf.sbeg - pdf.send])]
        lo = int(pdf.lo.iloc[0])
        depth, keep = np.zeros(int(pdf.b.max()) - lo, np.int32), np.zeros(len(pdf), bool)
        for i, (a, b) in enumerate(zip((pdf.a - lo).tolist(), (pdf.b - lo).tolist(), strict=True)):
            if depth[a:b].min() < max_coverage:
                keep[i] = True
                depth[a:b] += 1
        return pdf[keep]

    names = [c.split()[0] for c in CHOSEN.split(", ")]
    return hits.select(*names).groupBy("sid", "part").applyInPandas(one, CHOSEN)


def _aligned_pieces(rows: DataFrame) -> DataFrame:
    """Chosen mappings with sequences to aligned codes, from ``at`` of the segment on."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                scale = (r.qend - r.qbeg) / max(r.send - r.sbeg, 1)
                x, y = int(r.qbeg + (r.a - r.sbeg) * scale), int(r.qend - (r.send - r.b) * scale)
                _, qa, qb = K.align(r.q_seq[x:y], r.text)
                out.append((r.sid, r.part, r.a - r.lo, qa.tobytes(), qb.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return rows.mapInPandas(run, PIECES)


def _fold(tables: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and their summed weights."""
    table, inv = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
    return table, np.bincount(inv.ravel(), np.concatenate(weights), len(table))


def polish(mappings: DataFrame, contigs: DataFrame, reads: DataFrame, segment: int = 1_000_000, max_coverage: int = 10, min_coverage: int = 4, penalty: float = 0.1) -> DataFrame:
    """Contigs (read_id, seq) polished by mapped reads (qid, qdir, sid, qbeg, qend, sbeg, send), a segment at a time.

    A segment takes reads that it holds, or that reach into it by 1000 bases,
    longest first until each base is covered ``max_coverage`` times; bases covered less than ``min_coverage`` times come out in lower case.
    """
    parts = contigs.select(F.col("read_id").alias("sid"), "seq", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / segment).cast("int"))).alias("part"))
    parts = parts.select("sid", "part", (F.col("part") * segment).cast("long").alias("lo"), F.substring("seq", (F.col("part") * segment + 1).cast("int"), F.lit(segment)).alias("s_seq"))
    hits = mappings.withColumn("part", F.explode(F.sequence(F.floor(F.col("sbeg") / segment).cast("int"), F.floor((F.col("send") - 1) / segment).cast("int"))))
    q = reads.select(F.col("read_id").alias("qid"), F.col("seq").alias("q_seq"))
    hits = hits.join(parts.select("sid", "part", "lo", (F.col("lo") + F.length("s_seq")).alias("hi")), ["sid", "part"])
    hits = hits.withColumns({"a": F.greatest("sbeg", "lo"), "b": F.least("send", "hi")})
    inside = (F.col("sbeg") >= F.col("lo")) & (F.col("send") <= F.col("hi"))
    hits = _until_full(hits.where((F.col("b") > F.col("a")) & (inside | (F.col("b") - F.col("a") >= 1000))), max_coverage)
    hits = hits.join(parts.select("sid", "part", "s_seq"), ["sid", "part"]).withColumn("text", F.substring("s_seq", (F.col("a") - F.col("lo") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))).drop("s_seq")
    hits = hits.join(q, "qid").withColumn("q_seq", F.when(F.col("qdir") == 1, reverse_complement(F.col("q_seq"))).otherwise(F.col("q_seq")))
    hits = _aligned_pieces(hits)

    def one(key, seg, rows):
        if seg.empty:
            return pd.DataFrame(columns=["sid", "part", "seq"])
        text = seg.s_seq.iloc[0]
        depth, tables, weights, held, size = np.zeros(len(text) + 1, np.int64), [], [], 0, 0
        for r in rows.itertuples(index=False):
            qa, qb = np.frombuffer(r.q_aln, np.uint8), np.frombuffer(r.s_aln, np.uint8)
            t = K.tags(qa, qb, r.at)
            tables.append(t)
            weights.append(np.ones(len(t)))
            size += len(t)
            if size > FOLD_TAGS + held:
                table, total = _fold(tables, weights)
                tables, weights, held, size = [table], [total], len(table), 0
            depth[r.at] += 1
            depth[r.at + int((qb != K.GAP).sum())] -= 1
        cover = np.cumsum(depth)[:-1]
        out, last = [], 0
        if tables:
            table, total = _fold(tables, weights)
            edge = np.diff(np.concatenate([[0], (cover >= min_coverage).astype(np.int8), [0]]))
            for x, y in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
                if y - x < 1000:
                    continue
                mine = (table[:, 0] >= x) & (table[:, 0] < y)
                a, b, seq = K.consensus(table[mine], total[mine], {i: float(cover[i]) for i in range(x, y)}, penalty)
                out.append(text[last:a].lower() + seq)
                last = b
        return pd.DataFrame([(key[0], key[1], "".join(out) + text[last:].lower())], columns=["sid", "part", "seq"])

    done = parts.groupBy("sid", "part").cogroup(hits.groupBy("sid", "part")).applyInPandas(one, "sid long, part int, seq string")
    return done.groupBy(F.col("sid").alias("read_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq"))), lambda x: x["seq"]), "").alias("seq"))
