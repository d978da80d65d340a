"""Suffix arrays with common-prefix values by external induced sorting.

Suffixes are induced bucket by bucket: what a bucket holds is final when its
turn comes, so one monotone priority queue, keyed by first symbol and then by
arrival, replaces all comparisons.  Its tuples are (position, common prefix with
the entry before it); queues beyond a memory bound go to disk.  The order of the
leftmost-S suffixes that start the induction comes from the reduced string of
their names, sorted the same way one level down by doubling its ranks.
"""

from __future__ import annotations

import numpy as np

#: Common prefixes are counted up to here.
CAP = 255


class BucketQueue:
    """First-in first-out queues by symbol; beyond ``budget`` tuples the fullest queue moves to disk.

    ``store`` opens a spill file: ``store.write(arrays) -> ticket`` and ``store.read(ticket)``.
    """

    def __init__(self, symbols: int, budget: int, store=None):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.size = [0] * symbols
        self.held, self.budget, self.store = 0, budget, store

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.parts[symbol].append((position, prefix))
        self.size[symbol] += len(position)
        self.held += len(position)
        while self.store is not None and self.held > self.budget:
            full = max(range(len(self.size)), key=self.size.__getitem__)
            if not self.size[full]:
                return
            memory = [p for p in self.parts[full] if isinstance(p, tuple)]
            ticket = self.store.write(np.concatenate([p[0] for p in memory]), np.concatenate([p[1] for p in memory]))
            # what is on disk already came before
            self.parts[full] = [p for p in self.parts[full] if not isinstance(p, tuple)] + [ticket]
            self.held -= self.size[full]
            self.size[full] = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        got = [p if isinstance(p, tuple) else self.store.read(p) for p in self.parts[symbol]]
        self.parts[symbol] = []
        self.held -= self.size[symbol]
        self.size[symbol] = 0
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def folder(uri: str) -> Folder | None:
    """A spill store in the cluster's shared folder; None where only Spark opens it, and the queues stay in memory."""
    import pyarrow as pa

    try:
        return Folder(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


class Folder:
    """A spill store of numpy files in a folder that pyarrow can open (the cluster's shared one)."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.made = False
        self.count = 0

    def write(self, position: np.ndarray, prefix: np.ndarray) -> str:
        if not self.made:
            self.fs.create_dir(self.root, recursive=True)
            self.made = True
        self.count += 1
        name = f"{self.root}/{self.count}.spill"
        with self.fs.open_output_stream(name, compression=None) as f:
            f.write(len(position).to_bytes(8, "little"))
            f.write(position.astype("<i8").tobytes())
            f.write(prefix.tobytes())
        return name

    def read(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        with self.fs.open_input_file(name) as f:
            n = int.from_bytes(f.read(8), "little")
            out = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), np.uint8)
        self.fs.delete_file(name)
        return out

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.root)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; past the end stands something smaller than any symbol."""
    n = len(t)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = -1
    # equal neighbours take the type of the next unequal pair
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of suffixes a and b, up to ``cap``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    padded = np.concatenate([t.astype(np.uint16), np.arange(1, 5, dtype=np.uint16)])  # differs from any shift of itself
    word = np.ndarray(len(t) + 1, "<u8", padded, strides=(2,))  # four symbols from each place
    done = 0
    while len(live) and done < cap:
        x, y = a[live] + done, b[live] + done
        room = len(t) - np.maximum(x, y)
        differ = word[np.minimum(x, len(t))] ^ word[np.minimum(y, len(t))]
        run = np.full(len(live), 4, np.int64)
        some = np.flatnonzero(differ)
        low = differ[some] & (~differ[some] + np.uint64(1))
        run[some] = (np.frexp(low.astype(np.float64))[1] - 1) // 16
        run = np.minimum(run, np.maximum(room, 0))
        out[live] += run
        live = live[run == 4]
        done += 4
    return np.minimum(out, cap).astype(np.uint8)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both included, low <= high."""
    table = [values]
    width = 1
    longest = int((high - low).max(initial=0)) + 1
    while 2 * width <= longest:
        last = table[-1]
        table.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k, row in enumerate(table):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
    return out


class _Inducer:
    """One sweep over the buckets, upwards for L suffixes and downwards for S suffixes."""

    def __init__(self, t, wanted, symbols, cap, queue):
        self.t, self.wanted, self.symbols, self.cap, self.queue = t, wanted, symbols, cap, queue
        self.since = np.zeros(symbols, np.uint8)  # least common prefix since the last tuple that went to a symbol
        self.any = np.zeros(symbols, bool)

    def begin(self) -> None:
        self.since[:] = 0  # suffixes of different first symbols have nothing in common

    def feed(self, position: np.ndarray, prefix: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Queue what precedes these suffixes; return what belongs to the bucket in turn itself."""
        if not len(position):
            return position, prefix
        before = position - 1
        ok = before >= 0
        ok[ok] = self.wanted[before[ok]]
        at = np.flatnonzero(ok)
        later = np.minimum.accumulate(prefix[::-1])[::-1]  # least from here to the end
        mine = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        was, had = self.since.copy(), self.any.copy()
        self.since = np.minimum(self.since, later[0])
        if not len(at):
            return mine
        symbol = self.t[before[at]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        heads = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        low = np.empty(len(at), np.int64)
        low[1:] = at[:-1] + 1
        low[heads] = 0
        least = _range_min(prefix, low, at)
        first = symbol[heads]
        least[heads] = np.minimum(least[heads], was[first])
        value = np.minimum(least.astype(np.int64) + 1, self.cap).astype(np.uint8)
        value[heads[~had[first]]] = 0
        ends = np.append(heads[1:], len(at))
        pos = before[at]
        for s, a, b in zip(first.tolist(), heads.tolist(), ends.tolist(), strict=True):
            if s == own:
                mine = (pos[a:b], value[a:b])
            else:
                self.queue.push(s, pos[a:b], value[a:b])
        last = at[ends - 1]
        self.since[first] = np.where(last + 1 < len(prefix), later[np.minimum(last + 1, len(prefix) - 1)], self.cap)
        self.any[first] = True
        return mine


def _sweep(t, is_s, starts, start_prefix, symbols, cap, budget, store):
    """Induce from the ordered leftmost-S suffixes; yields (bucket, positions, common prefixes with the one before)."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
    first = t[starts]
    cut = np.searchsorted(first, np.arange(symbols + 1))
    up = _Inducer(t, ~is_s, symbols, cap, BucketQueue(symbols, budget, store))
    ordered = BucketQueue(symbols, budget, store)
    n = len(t)
    present = np.flatnonzero(np.bincount(t, minlength=symbols)).tolist()
    if not is_s[n - 1]:  # the last suffix precedes nothing: it opens its bucket
        up.queue.push(int(t[n - 1]), np.array([n - 1]), np.zeros(1, np.uint8))
        up.any[t[n - 1]] = True
        up.since[t[n - 1]] = 0
    for c in present:
        up.begin()
        position, prefix = up.queue.pop(c)
        last = None
        while len(position):
            ordered.push(c, position, prefix)
            last = position[-1:]
            position, prefix = up.feed(position, prefix, c)
        a, b = cut[c], cut[c + 1]
        if a < b:
            p = start_prefix[a:b].copy()
            p[0] = 0 if last is None else _common(t, last, starts[a : a + 1], cap)[0]
            up.feed(starts[a:b], p, -1)
    down = _Inducer(t, is_s, symbols, cap, BucketQueue(symbols, budget, store))
    for c in reversed(present):
        down.begin()
        pieces = []
        position, prefix = down.queue.pop(c)
        while len(position):
            pieces.append((position, prefix))
            position, prefix = down.feed(position, prefix, c)
        s_pos, s_pre = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else none
        l_pos, l_pre = ordered.pop(c)
        if len(l_pos):
            back = np.empty(len(l_pos), np.uint8)
            back[1:] = l_pre[1:][::-1]
            back[0] = _common(t, l_pos[-1:], s_pos[-1:], cap)[0] if len(s_pos) else 0
            down.feed(l_pos[::-1], back, -1)
        # ascending: L suffixes, then S suffixes from last to first
        pos = np.concatenate([l_pos, s_pos[::-1]])
        pre = np.zeros(len(pos), np.uint8)
        pre[1 : len(l_pos)] = l_pre[1:]
        if len(s_pos):
            if len(l_pos):
                pre[len(l_pos)] = back[0]
            pre[len(l_pos) + 1 :] = s_pre[1:][::-1]
        yield c, pos, pre


def _rank_starts(t, is_s, lms, symbols, depth, budget, store):
    """Leftmost-S positions ordered by their suffixes, as far as ``depth`` symbols decide."""
    # sort the substrings between starts by inducing from unsorted starts
    order = lms[np.argsort(t[lms], kind="stable")]
    flag = np.zeros(len(t), bool)
    flag[lms] = True
    found = [pos[flag[pos]] for _, pos, _ in _sweep(t, is_s, order, np.zeros(len(order), np.uint8), symbols, 1, budget, store)]
    by_piece = np.concatenate(found[::-1])
    # equal substrings share a name: compare lengths, then symbols
    m = len(lms)
    index = np.empty(len(t), np.int64)
    index[lms] = np.arange(m)
    length = np.append(np.diff(lms), len(t) - lms[-1] + 1)  # the last one ends past the text: its length is its own
    at = index[by_piece]
    same = np.zeros(m, bool)
    if m > 1:
        a, b = by_piece[:-1], by_piece[1:]
        la, lb = length[at[:-1]], length[at[1:]]
        may = np.flatnonzero(la == lb)
        need = np.minimum(la[may] + 1, CAP)
        same[1 + may] = _common(t, a[may], b[may], CAP) >= need
    name = np.empty(m, np.int64)
    name[at] = np.cumsum(~same) - 1
    # one level down: suffixes of the string of names, by doubling
    rank, width = name, 1
    while width < depth and (top := int(rank.max())) < m - 1:
        nxt = np.zeros(m, np.int64)
        nxt[:-width] = rank[width:] + 1
        key = rank * (top + 2) + nxt
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)])
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(fresh)
        width *= 2
    return lms[np.argsort(rank, kind="stable")]


def sorted_buckets(t: np.ndarray, symbols: int = 257, cap: int = CAP, depth: int = 256, budget: int = 1 << 24, store=None):
    """For each first symbol, downwards: (positions of its suffixes in order, common prefix with the suffix before, up to ``cap``).

    What waits to be yielded is in the queues, so beyond ``budget`` tuples it is
    on disk; one bucket is in memory at a time.
    """
    t = np.ascontiguousarray(t)
    if not len(t):
        return
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        lms = _rank_starts(t, is_s, lms, symbols, depth, budget, store)
    prefix = np.zeros(len(lms), np.uint8)
    if len(lms) > 1:
        prefix[1:] = _common(t, lms[:-1], lms[1:], cap)
    for _, position, common in _sweep(t, is_s, lms, prefix, symbols, cap, budget, store):
        yield position, common


def suffix_array(t: np.ndarray, symbols: int = 257, cap: int = CAP, depth: int = 256, budget: int = 1 << 24, store=None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all suffixes in order, common prefix with the suffix before, up to ``cap``), all in memory.

    Suffixes that agree on more than ``cap`` symbols may stand in either order
    once ``depth`` names of the reduced string don't tell them apart.
    """
    parts = list(sorted_buckets(t, symbols, cap, depth, budget, store))[::-1]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
