"""Noisy reads of a random genome with known places, for kernels that SQL can't check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def genome(size: int, seed: int = 1) -> str:
    return np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(seed).integers(0, 4, size)].tobytes().decode()


def noisy(seq: str, rate: float, rng: np.random.Generator) -> str:
    """Substitutions, insertions and deletions, a third each."""
    out, kind, base = [], rng.random(len(seq)), rng.integers(0, 4, len(seq))
    for c, k, b in zip(seq, kind, base, strict=True):
        if k < rate / 3:
            out.append("ACGT"[b])
        elif k < 2 * rate / 3:
            out.append(c + "ACGT"[b])
        elif k >= rate:
            out.append(c)
    return "".join(out)


def sample(text: str, length: int, step: int, rate: float = 0.0, strands: bool = False, seed: int = 2) -> list[tuple[int, str, int, int, int]]:
    """(read_id, seq, start, end, strand) of reads at every ``step`` bases."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, at in enumerate(range(0, max(1, len(text) - length + 1), step)):
        part = noisy(text[at : at + length], rate, rng)
        strand = int(rng.integers(0, 2)) if strands else 0
        rows.append((i, part[::-1].translate(_COMPLEMENT) if strand else part, at, at + length, strand))
    return rows


def reads(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "read_id long, seq string, start long, end long, strand int")


def true_overlaps(spark: SparkSession, rows, least: int) -> DataFrame:
    """Exact overlap rows of error-free reads, from their places."""
    out = []
    for i, (a, sa, a0, a1, ra) in enumerate(rows):
        for b, sb, b0, b1, rb in rows[i + 1 :]:
            lo, hi = max(a0, b0), min(a1, b1)
            if hi - lo >= least:
                place = lambda s, start, end, rev: (lo - start, hi - start) if not rev else (end - hi, end - lo)  # noqa: B023, E731, ARG005
                x, y = place(sa, a0, a1, ra), place(sb, b0, b1, rb)
                out.append((a, b, 100.0, 0, *x, len(sa), int(ra != rb), *y, len(sb)))
    from helixframe.schema import OVERLAPS

    return spark.createDataFrame([tuple(v if k == 2 else int(v) for k, v in enumerate(r)) for r in out], OVERLAPS)
