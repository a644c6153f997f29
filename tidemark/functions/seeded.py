"""Reproducible hashes, draws and envelopes: the same seed gives the same numbers everywhere.

Single draws are Spark expressions on longs: products are split so that none passes 63 bits.  Hashes of whole texts and
envelopes go step by step, which Spark's own folds do an element at a time; here a step is taken
for many rows of an Arrow batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.fixed import DRIFT, FNV_OFFSET, FNV_PRIME, HIGH, LOW, MASK, MIDDLE, STEP, TAPER

#: Texts hashed side by side, and the code units of theirs that are laid out at once; so few texts are hashed each on its own.
TEXTS, CELLS, FEW = 1024, 1 << 21, 16


def _hashes(units: list[np.ndarray]) -> np.ndarray:
    """FNV-1a of each array of code units."""
    sizes = np.array([len(u) for u in units], np.int64)
    out, order = np.empty(len(units), np.uint32), np.argsort(-sizes, kind="stable")
    for start in range(0, len(order), TEXTS):
        # Texts of like length, the longest first: step k takes those that have a kth unit.
        some = order[start : start + TEXTS]
        h, left, at = np.full(len(some), FNV_OFFSET, np.uint32), sizes[some], 0
        while (n := int(np.searchsorted(-left, -at, side="left"))) > FEW:
            to = min(at + max(1, CELLS // n), int(left[0]))
            table = np.zeros((to - at, n), np.uint32)
            for column, i in enumerate(some[:n]):
                part = units[i][at:to]
                table[: len(part), column] = part
            live = np.searchsorted(-left[:n], -np.arange(at, to), side="left")
            for row, m in zip(table, live):
                part = h[:m]
                part ^= row[:m]
                part *= np.uint32(FNV_PRIME)
            at = to
        for k in range(n):
            x = int(h[k])
            for a in range(at, int(left[k]), CELLS):
                for u in units[some[k]][a : a + CELLS].tolist():
                    x = (x ^ u) * FNV_PRIME & MASK
            h[k] = x
        out[some] = h
    return out


def fnv1a(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, as a long; null for null.  Beside the texts, memory is bounded, however long one of them is."""
    hashes = _hashes

    @F.arrow_udf("bigint")
    def hashed(texts: pa.Array) -> pa.Array:
        whole, there = np.zeros(len(texts), np.int64), texts.is_valid().to_numpy(zero_copy_only=False)
        whole[there] = hashes([np.frombuffer(t.as_py().encode("utf-16-le", "surrogatepass"), "<u2") for t in texts.drop_null()])
        return pa.array(whole, pa.int64(), mask=~there)

    return hashed(text)


def text_seed(copy: Column) -> Column:
    """The seed of a trimmed text; nothing at all hashes as 'empty'."""
    return fnv1a(F.coalesce(F.nullif(copy, F.lit("")), F.lit("empty")))


def name_seed(name: Column) -> Column:
    """The seed of a file's name; a missing one hashes as 'untitled'."""
    return fnv1a(F.coalesce(name, F.lit("untitled")))


def _multiplied(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(65535)) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(65535)) * 65536
    return (low + high).bitwiseAND(F.lit(MASK))


def draw(seed: Column, nth: Column | int) -> Column:
    """The nth uniform draw (from 1) in [0, 1) of a seed: a counter, so draws are independent of each other."""
    a = (seed + (F.lit(nth) if isinstance(nth, int) else nth) * F.lit(STEP).cast("bigint")).bitwiseAND(F.lit(MASK))
    t = _multiplied(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    u = t.bitwiseXOR((t + _multiplied(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)))
    return u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(4294967296.0)


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def half_up(x: Column, places: int = 0) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def envelope(seed: Column, count: int, low: float = LOW, high: float = HIGH) -> Column:
    """``count`` samples: a clamped walk from one half, tapered at both ends; null for a null seed."""
    step, mask, drift, middle, taper = STEP, MASK, DRIFT, MIDDLE, TAPER

    @F.arrow_udf("array<double>")
    def walked(seeds: pa.Array) -> pa.Array:
        there = seeds.is_valid().to_numpy(zero_copy_only=False)
        start = seeds.fill_null(0).to_numpy().astype(np.uint64)
        cut = np.uint64(mask)
        a = (start[:, None] + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(step)) & cut
        t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & cut
        u = t ^ ((t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & cut)) & cut)
        moves = ((u ^ (u >> np.uint64(14))) / 4294967296.0 - 0.5) * drift
        level, levels = np.full(len(start), middle), np.empty(moves.shape)
        for k in range(count):
            level = np.clip(level + moves[:, k], 0.0, 1.0)
            levels[:, k] = level
        bow = taper + (1 - taper) * np.sin(np.pi * (np.arange(count) + 0.5) / count)
        samples = low + (high - low) * levels * bow
        sizes = np.concatenate(([0], np.cumsum(np.where(there, count, 0)))).astype(np.int32)
        offsets = pa.array(sizes, pa.int32(), mask=np.append(~there, False))
        return pa.ListArray.from_arrays(offsets, pa.array(samples[there].ravel()))

    return walked(seed)
