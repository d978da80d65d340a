"""Sequential numpy kernels: seed chains, banded alignment, consensus paths."""

from __future__ import annotations

import numpy as np

GAP = 4
_CODE = np.full(256, GAP, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_BASE = np.frombuffer(b"ACGT-", np.uint8)


def encode(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.encode(), np.uint8)]


def decode(code: np.ndarray) -> str:
    return _BASE[code].tobytes().decode()


def chain(q: np.ndarray, s: np.ndarray, k: int = 15, max_gap: int = 5000, band: int = 500, least: int = 30, least_seeds: int = 3) -> list[tuple[int, np.ndarray]]:
    """Colinear chains of seeds (offsets on query and subject): (score, seed numbers in order), best first.

    A link adds the new bases, at most k, less a cost for the difference of both
    gaps: 1 % of k per base and half its log2.  A seed serves one chain.
    """
    order = np.lexsort((q, s))
    q, s = q[order].astype(np.int64), s[order].astype(np.int64)
    n = len(q)
    score, back = np.full(n, k, np.int64), np.full(n, -1)
    first = 0
    for i in range(n):
        while s[i] - s[first] > max_gap:
            first += 1
        dq, ds = q[i] - q[first:i], s[i] - s[first:i]
        diff = np.abs(dq - ds)
        ok = (dq > 0) & (ds > 0) & (dq <= max_gap) & (diff <= band)
        if ok.any():
            cost = np.floor(diff * 0.01 * k).astype(np.int64) + np.where(diff > 0, np.floor(np.log2(np.maximum(diff, 1))).astype(np.int64) >> 1, 0)
            gain = np.where(ok, score[first:i] + np.minimum(np.minimum(dq, ds), k) - cost, -1)
            j = len(gain) - 1 - int(np.argmax(gain[::-1]))  # the nearest of equals
            if gain[j] > k:
                score[i], back[i] = gain[j], first + j
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable"):
        if used[i] or score[i] < least:
            continue
        path, j = [], i
        while j >= 0 and not used[j]:
            path.append(j)
            used[j] = True
            j = back[j]
        total = score[i] - (score[j] if j >= 0 else 0)
        if len(path) >= least_seeds and total >= least:
            out.append((int(total), order[np.array(path[::-1])]))
    return sorted(out, key=lambda c: (-c[0], int(c[1][0])))


def consistent(q: np.ndarray, s: np.ndarray, ratio: float = 0.25) -> np.ndarray:
    """(n, n): whether two seeds lie on one line, ``|ds / dq - 1| < ratio`` with both differences of one sign."""
    dq, ds = q[:, None] - q[None, :], s[:, None] - s[None, :]
    ok = dq * ds > 0
    return ok & (np.abs(ds / np.where(dq == 0, 1, dq) - 1) < ratio)


def block_candidates(q: np.ndarray, s: np.ndarray, k: int = 15, block: int = 2000, most: int = 40, least: int = 3, ratio: float = 0.25, support: int = 5, relevant: float = 0.4, span: int = 400) -> list[tuple[int, int, int, int, int, int, int]]:
    """Candidates of one pair and strand from its seeds: (score, q begin, q end, s begin, s end, seed on q, seed on s).

    Seeds fall into blocks of the subject, one for each query offset and ``most``
    in a block.  A block counts with ``least`` seeds, and twice that with the
    block before.  Its best supported seed, consistent with ``support`` others of
    the block or more, collects all seeds that are consistent with it; these are
    chained, and the chain that holds the seed, the longest on the query, is the
    candidate.  A block of whose seeds a collection takes the part ``relevant``
    serves no other; blocks go from most seeds to fewest, ties from the first.
    """
    order = np.lexsort((s, q))
    q, s = every_q, every_s = q[order].astype(np.int64), s[order].astype(np.int64)
    of = s // block
    fresh = np.lexsort((s, q, of))
    keep = fresh[np.concatenate([[True], (of[fresh][1:] != of[fresh][:-1]) | (q[fresh][1:] != q[fresh][:-1])])] if len(q) else fresh
    place = np.arange(len(keep)) - np.searchsorted(of[keep], of[keep])
    keep = keep[place < most]
    q, s, of = q[keep], s[keep], of[keep]
    blocks, size = np.unique(of, return_counts=True)
    count = dict(zip(blocks.tolist(), size.tolist(), strict=True))
    out, used = [], set()
    for b in sorted(count, key=lambda b: (-count[b], b)):
        if b in used or count[b] < least or count[b] + count.get(b - 1, 0) < 2 * least:
            continue
        own = np.flatnonzero(of == b)
        backing = consistent(q[own], s[own], ratio).sum(1)
        if backing.max() < max(support, 2 * least):
            continue
        seed = own[int(np.argmax(backing))]
        dq, ds = q - q[seed], s - s[seed]
        line = (dq * ds > 0) & (np.abs(ds / np.where(dq == 0, 1, dq) - 1) < ratio)
        for other, n in count.items():
            if other != b and line[of == other].sum() >= relevant * n:
                used.add(other)
        # what is chained are all seeds on the line, those beyond the bound of a block as well
        dq, ds = every_q - q[seed], every_s - s[seed]
        at = np.flatnonzero(((dq * ds > 0) & (np.abs(ds / np.where(dq == 0, 1, dq) - 1) < ratio)) | ((dq == 0) & (ds == 0)))
        x, y = every_q[at], every_s[at]
        holds = [(int(x[p[-1]] - x[p[0]]), p) for _, p in chain(x, y, k) if x[p[0]] <= q[seed] < x[p[-1]] + k and y[p[0]] <= s[seed] < y[p[-1]] + k]
        if holds:
            p = max(holds, key=lambda h: h[0])[1]
            found = (int(line.sum()), int(x[p[0]]), int(x[p[-1]]) + k, int(y[p[0]]), int(y[p[-1]]) + k, int(q[seed]), int(s[seed]))
            if max(found[2] - found[1], found[4] - found[3]) >= span:
                out.append(found)
    return out


def exact_matches(a: np.ndarray, b: np.ndarray, q: np.ndarray, s: np.ndarray, k: int, least: int = 15) -> np.ndarray:
    """Maximal exact matches (q begin, s begin, size) of at least ``least`` bases that hold a seed of size k, sorted by s."""
    out = []
    order = np.lexsort((q, s - q))
    diagonal, end = None, -1
    for i in order.tolist():
        x, y = int(q[i]), int(s[i])
        if y - x == diagonal and x < end:
            continue  # inside the match before it
        shift = min(x, y)
        head = np.flatnonzero(a[x - shift : x] != b[y - shift : y])
        back = shift - (int(head[-1]) + 1) if len(head) else shift
        room = min(len(a) - x, len(b) - y)
        tail = np.flatnonzero(a[x + k : x + room] != b[y + k : y + room])
        size = back + k + (int(tail[0]) if len(tail) else room - k)
        diagonal, end = y - x, x - back + size
        if size >= least:
            out.append((x - back, y - back, size))
    return np.array(sorted(out, key=lambda m: (m[1], m[0])), np.int64).reshape(-1, 3)


def chain_matches(m: np.ndarray, max_gap: int = 3000, band: int = 500, least: int = 100) -> list[tuple[int, np.ndarray]]:
    """Colinear chains of exact matches that don't overlap: (score, match numbers), best first; as ``chain``, with sizes of their own."""
    n = len(m)
    if not n:
        return []
    q, s, size = m.T
    mean = int(size.sum()) // n
    score, back = size.astype(np.int64).copy(), np.full(n, -1)
    for i in range(n):
        dq, ds = q[i] - q[:i], s[i] - s[:i]
        diff = np.abs(dq - ds)
        ok = (q[:i] + size[:i] < q[i]) & (s[:i] + size[:i] < s[i]) & (dq <= max_gap) & (ds <= max_gap) & (diff <= band)
        if ok.any():
            cost = np.floor(diff * 0.01 * mean).astype(np.int64) + np.where(diff > 0, np.floor(np.log2(np.maximum(diff, 1))).astype(np.int64) >> 1, 0)
            gain = np.where(ok, score[:i] + np.minimum(np.minimum(dq, ds), size[i]) - cost, -1)
            j = len(gain) - 1 - int(np.argmax(gain[::-1]))
            if gain[j] > score[i]:
                score[i], back[i] = gain[j], j
    used, out = np.zeros(n, bool), []
    for i in np.argsort(-score, kind="stable"):
        path, j = [], int(i)
        while j >= 0 and not used[j]:
            path.append(j)
            used[j] = True
            j = int(back[j])
        total = int(score[i] - (score[j] if j >= 0 else 0)) if path else 0
        if total >= least:
            out.append((total, np.array(path[::-1])))
    return sorted(out, key=lambda c: (-c[0], int(c[1][0])))


def extend(a: str, b: str, block: int = 512, match: int = 8, most_error: float = 0.5) -> tuple[int, int, np.ndarray, np.ndarray]:
    """From the first bases of both on, block by block: (bases of a, bases of b, aligned codes of a, of b).

    A block of each is aligned from their beginnings to the end of either one,
    where it costs least.  All blocks but the last are cut back to their last
    ``match`` matching columns, and the next goes on from there.  It ends where a
    block has no such run or more than ``most_error`` of its columns differ.
    """
    i = j = 0
    parts_a, parts_b = [], []
    while i < len(a) and j < len(b):
        x, y = a[i : i + block], b[j : j + block]
        qa, qb = _to_an_end(x, y)
        last = i + len(x) == len(a) or j + len(y) == len(b)
        same = qa == qb
        run = np.convolve(same, np.ones(match, np.int64), "valid") == match if len(same) >= match else np.zeros(0, bool)
        hits = np.flatnonzero(run)
        if not len(hits) or (~same).mean() > most_error:
            break
        cut = int(hits[-1]) + match
        parts_a.append(qa[:cut])
        parts_b.append(qb[:cut])
        i += int((qa[:cut] != GAP).sum())
        j += int((qb[:cut] != GAP).sum())
        if last:
            break
    none = np.zeros(0, np.uint8)
    return i, j, np.concatenate(parts_a) if parts_a else none, np.concatenate(parts_b) if parts_b else none


def _to_an_end(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Alignment from both beginnings to the end of a or of b, whichever costs less an aligned base."""
    x, y = encode(a), encode(b)
    n, m = len(x), len(y)
    width = max(16, max(n, m) // 3)
    pad = np.zeros(0, np.uint8)
    best = None
    for u, v, turned in ((x, y, False), (y, x, True)):
        # u is used up; v ends where the last row is least
        lengths = len(v)
        _, moves, lo, row = _banded(u, v, width + abs(n - m), rows=True)
        ends = len(u) + lo + np.arange(len(row))
        fits = (ends >= 0) & (ends <= lengths)
        cost = np.where(fits, row, 1 << 40)
        k = int(np.argmin(cost))
        found = (cost[k] / max(len(u) + int(ends[k]), 1), turned, u, v, moves, lo, int(ends[k]))
        if best is None or found[:2] < best[:2]:
            best = found
    _, turned, u, v, moves, lo, end = best
    qa, qb = _trace(u, v[:end], moves, lo)
    return (qb, qa) if turned else (qa, qb) if len(qa) else (pad, pad)


def extend_seed(q: str, s: str, q_off: int, s_off: int, block: int = 512) -> tuple[int, int, int, int, np.ndarray, np.ndarray]:
    """``extend`` both ways from a place on q and on s: (q begin, q end, s begin, s end, aligned codes)."""
    i, j, la, lb = extend(q[:q_off][::-1], s[:s_off][::-1], block)
    x, y, ra, rb = extend(q[q_off:], s[s_off:], block)
    return q_off - i, q_off + x, s_off - j, s_off + y, np.concatenate([la[::-1], ra]), np.concatenate([lb[::-1], rb])


def align_candidate(q: str, s: str, span: tuple[int, int, int, int], seed: tuple[int, int], block: int = 512, most_hang: int = 200, reach: int = 300, least_identity: float = 65.0) -> tuple[int, int, int, int, np.ndarray, np.ndarray]:
    """A candidate's alignment by the first way that serves: (q begin, q end, s begin, s end, aligned codes).

    Extension from the seed, if it leaves ``most_hang`` bases of the candidate's
    query span or fewer; else the whole spans against each other, if they match in
    ``least_identity`` percent of columns; else the extension as it is.  Ends that leave ``reach`` bases
    or fewer of both sequences are then carried on to the nearer end.
    """
    q0, q1, s0, s1 = span
    got = extend_seed(q, s, *seed, block)
    if max(got[0] - q0, 0) + max(q1 - got[1], 0) > most_hang:
        _, qa, qb = align(q[q0:q1], s[s0:s1])
        if identity(qa, qb) >= least_identity:
            got = (q0, q1, s0, s1, qa, qb)
    a0, a1, b0, b1, qa, qb = got
    n = min(a0, b0)
    if 0 < n <= reach:
        _, la, lb = align(q[a0 - n : a0], s[b0 - n : b0])
        if identity(la, lb) >= 50:
            a0, b0, qa, qb = a0 - n, b0 - n, np.concatenate([la, qa]), np.concatenate([lb, qb])
    n = min(len(q) - a1, len(s) - b1)
    if 0 < n <= reach:
        _, ra, rb = align(q[a1 : a1 + n], s[b1 : b1 + n])
        if identity(ra, rb) >= 50:
            a1, b1, qa, qb = a1 + n, b1 + n, np.concatenate([qa, ra]), np.concatenate([qb, rb])
    return a0, a1, b0, b1, qa, qb


def similarity(a: str, b: str, k: int = 11) -> tuple[float, float]:
    """(part of a that its best chain with b covers, identity of that span), as parts of one; what bubbles are compared by."""
    from helixframe.functions.sequence import rolling_words

    wa, fa = rolling_words(np.frombuffer(a.encode(), np.uint8), k)
    wb, fb = rolling_words(np.frombuffer(b.encode(), np.uint8), k)
    at = np.flatnonzero(fa)[:: max(k // 2, 1)]
    order = np.argsort(wb, kind="stable")
    order = order[fb[order]]
    low, high = (np.searchsorted(wb[order], wa[at], side) for side in ("left", "right"))
    few = (high > low) & (high - low <= 20)  # words of repeats say nothing about place
    n = (high - low)[few]
    q = np.repeat(at[few], n)
    s = order[np.repeat(low[few], n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
    found = chain(q, s, k, max_gap=5 * k * 10, least_seeds=2)
    if not found:
        return 0.0, 0.0
    p = found[0][1]
    q0, q1, s0, s1 = int(q[p[0]]), int(q[p[-1]]) + k, int(s[p[0]]), int(s[p[-1]]) + k
    q0, q1, s0, s1, qa, qb = align_candidate(a, b, (q0, q1, s0, s1), (q0, s0))
    return (q1 - q0) / max(len(a), 1), identity(qa, qb) / 100


def align(a: str, b: str, band: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Global alignment within a diagonal band: (edits, codes of a with gaps, codes of b with gaps).

    The band is widened until the edits fit it, so the distance is exact.
    """
    x, y = encode(a), encode(b)
    n, m = len(x), len(y)
    width = band or max(16, abs(n - m) + 16)
    while True:
        edits, moves, lo = _banded(x, y, width)
        if edits <= width or width >= max(n, m):
            break
        width *= 2
    qa, qb = _trace(x, y, moves, lo)
    return int(edits), qa, qb


def _trace(x: np.ndarray, y: np.ndarray, moves: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with gaps of x and y, from the moves that end at both their ends."""
    i, j, out = len(x), len(y), []
    while i or j:
        move = moves[i, j - i - lo]
        out.append(move)
        i -= move != 2
        j -= move != 1
    step = np.array(out[::-1], np.int8)
    qa, qb = np.full(len(step), GAP, np.uint8), np.full(len(step), GAP, np.uint8)
    qa[step != 2], qb[step != 1] = x, y
    return qa, qb


def _banded(x: np.ndarray, y: np.ndarray, width: int, rows: bool = False):
    """Edit distance over diagonals -width..width (+ length difference); moves: 0 both, 1 a only, 2 b only.

    With ``rows`` the last row comes as well: what it costs to end at each place of y.
    """
    n, m = len(x), len(y)
    lo, hi = min(0, m - n) - width, max(0, m - n) + width
    span = hi - lo + 1
    big = n + m + 1
    diagonals = np.arange(lo, hi + 1)
    moves = np.zeros((n + 1, span), np.int8)
    row = np.where((diagonals >= 0) & (diagonals <= m), diagonals, big)
    moves[0] = 2
    for i in range(1, n + 1):
        j = i + diagonals
        inside = (j >= 0) & (j <= m)
        same = np.where((j >= 1) & (j <= m), y[np.clip(j - 1, 0, max(m - 1, 0))] != x[i - 1] if m else True, True)
        both = np.where(j >= 1, row + same, big)
        up = np.append(row[1:], big) + 1
        best = np.where(inside, np.minimum(both, up), big)
        # gaps in a run along the row: least of best[k] + (j - k)
        left = np.minimum.accumulate(best - diagonals) + diagonals
        new = np.where(inside, np.minimum(best, left), big)
        moves[i] = np.where(new == both, 0, np.where(new == up, 1, 2))
        row = new
    return (int(row[m - n - lo]), moves, lo, row) if rows else (int(row[m - n - lo]), moves, lo)


def identity(qa: np.ndarray, qb: np.ndarray) -> float:
    """Percent of columns that match."""
    return 100.0 * float((qa == qb).sum()) / len(qa) if len(qa) else 0.0


def tags(qa: np.ndarray, qb: np.ndarray, start: int) -> np.ndarray:
    """Columns of an alignment of a read (qa) to a template (qb) as (t_pos, delta, base, p_t_pos, p_delta, p_base).

    ``delta`` counts inserted bases after a template position; the column before the first has position -1.
    """
    on_t = qb != GAP
    t = start - 1 + np.cumsum(on_t)
    at = np.flatnonzero(on_t)
    last = np.searchsorted(at, np.arange(len(qb)), "right") - 1
    run = np.arange(len(qb)) - np.where(last >= 0, at[np.maximum(last, 0)], -1)
    delta = np.where(on_t, 0, run)
    out = np.stack([t, delta, qa, np.append(-1, t[:-1]), np.append(0, delta[:-1]), np.append(GAP, qa[:-1])], axis=1)
    return out if not len(delta) or delta.max() < 255 else out[:0]


def consensus(links: np.ndarray, weights: np.ndarray, depth: dict[int, float], penalty: float = 0.2) -> tuple[int, int, str]:
    """Best path over summed columns: (first template position, one past the last, sequence).

    ``links`` rows are as ``tags``, distinct.  A column's score is its best
    link's weight, less ``penalty`` times the coverage, added to the score of
    the column linked; the path ends at the best column, the first of equals.
    """
    if not len(links):
        return 0, 0, ""
    order = np.lexsort((links[:, 5], links[:, 4], links[:, 3], links[:, 2], links[:, 1], links[:, 0]))
    score: dict[tuple[int, int, int], tuple[float, tuple[int, int, int] | None]] = {}
    best, top = None, -np.inf
    for r in order:
        t, d, b, pt, pd, pb = (int(v) for v in links[r])
        value = weights[r] - penalty * depth.get(t, 0.0)
        before = (pt, pd, pb) if pt >= 0 else None
        if before is not None:
            value += score[before][0] if before in score else 0.0
        node = (t, d, b)
        if node not in score or value > score[node][0]:
            score[node] = (value, before if before in score else None)
    for node, (value, _) in score.items():
        if value > top:
            best, top = node, value
    end, out, node = best[0] + 1, [], best
    while node is not None:
        first = node[0]
        if node[2] != GAP:
            out.append(node[2])
        node = score[node][1]
    return max(first, 0), end, decode(np.array(out[::-1], np.uint8)) if out else ""
