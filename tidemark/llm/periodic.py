"""Periodic runs of words by recompression.

The words of some texts, numbered and separated by numbers that occur once, are compressed in alternating
steps until each text is one symbol: a block step makes one symbol of each stretch of equal symbols, a pair
step splits the alphabet in two by a hash of the symbol and makes one symbol of each left-right pair.  The
levels are a run-length grammar: equal words give equal symbols wherever they stand, but for at most one
symbol a level at either end.  So a longest common extension is one walk up and down the levels: up while both
ends stand at an edge of their parents (past at most one symbol or the shorter of two blocks), then down
along the first symbols that differ.  ``extend`` walks with all queries at once.

A run of period q that is at least 2q long holds two grid points i and i + q with i a multiple of q.  All such
points of all periods (n log n of them) are candidates; those whose words or neighbouring words differ too soon are gone
at once, and extensions forth from (i, i + q) and back from (i - 1, i + q - 1) give the exact stretch of the others.
No suffix array, no limit on periods, lengths or texts.

Defined results: null and empty texts, and texts of white space, have no words and no runs, and collapse to an
empty string.  A text is read whole in one task; memory is some 100 bytes a word of it.  Rows with the same id or
text are read each on its own, ids may be null and aren't looked at.  An empty table gives no rows.  Columns of the frame
stay as they are; a column by the name of the result is an error of the caller.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship

#: A run's length at least, in words (and twice its period).
LEAST = 12
#: Words of texts that share a grammar, about; a longer text has its own.
WORDS = 1 << 16
#: Grid points and extensions in memory at once.
POINTS = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Level(NamedTuple):
    """A level's symbols, each one's parent above, and each parent's first and last symbol."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    is_block: bool


def _joined(symbols: np.ndarray, starts: np.ndarray, is_block: bool) -> Level:
    flags = np.zeros(len(symbols), np.int32)
    flags[starts] = 1
    last = np.append(starts[1:] - 1, len(symbols) - 1)
    return Level(symbols, np.cumsum(flags, dtype=np.int32) - np.int32(1), starts.astype(np.int32), last.astype(np.int32), is_block)


def _named(keys: np.ndarray, after: int) -> tuple[np.ndarray, int]:
    names, which = np.unique(keys, return_inverse=True)
    return (which + after).astype(np.int32), after + len(names)


def grammar(symbols: np.ndarray, texts: int) -> list[Level]:
    """The levels, lowest first, of a sequence where negative symbols separate so many texts of at least a word."""
    levels, free, turn = [], int(symbols.max(initial=-1)) + 1, 0
    done = texts + int((symbols < 0).sum())
    while True:
        starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        level = _joined(symbols, starts, True)
        above, sizes = symbols[starts], level.last - level.first + 1
        long = np.flatnonzero(sizes > 1)
        if len(long):
            above[long], free = _named(above[long].astype(np.int64) << 32 | sizes[long], free)
        levels.append(level)
        symbols = above
        if len(symbols) == done:
            return levels
        # The better of left-right and right-left; a hash of the symbol says on which side it is.
        turn += 1
        mixed = symbols.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(turn * 0x85EBCA6B & 0xFFFFFFFF)
        mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        side, real = (mixed >> np.uint32(17) & np.uint32(1)).astype(bool), symbols >= 0
        both = real[:-1] & real[1:]
        pairs, others = np.flatnonzero(both & ~side[:-1] & side[1:]), np.flatnonzero(both & side[:-1] & ~side[1:])
        pairs = pairs if len(pairs) >= len(others) else others
        if not len(pairs):
            continue
        keep = np.ones(len(symbols), bool)
        keep[pairs + 1] = False
        level = _joined(symbols, np.flatnonzero(keep), False)
        names, free = _named(symbols[pairs].astype(np.int64) << 32 | symbols[pairs + 1], free)
        above = symbols[level.first]
        above[level.parent[pairs]] = names
        levels.append(level)
        symbols = above


def extend(levels: list[Level], x: np.ndarray, y: np.ndarray, step: int = 1) -> np.ndarray:
    """How many symbols from x and from y on (step 1) or back (step -1) are equal; x and y differ and end at separators."""
    at, to = x.astype(np.int32), y.astype(np.int32)
    fell = np.full(len(at), len(levels), np.int32)
    live = np.arange(len(at))
    for k, level in enumerate(levels):
        near, far = (level.first, level.last) if step > 0 else (level.last, level.first)
        a, b = at[live], to[live]
        up_a, up_b = level.parent[a], level.parent[b]
        inner = np.flatnonzero((near[up_a] != a) | (near[up_b] != b))
        if len(inner):
            ia, ib = a[inner], b[inner]
            same = level.symbols[ia] == level.symbols[ib]
            rest_a, rest_b = np.abs(far[up_a[inner]] - ia) + 1, np.abs(far[up_b[inner]] - ib) + 1
            past = np.where(same, np.minimum(rest_a, rest_b), 0).astype(np.int32) * np.int32(step)
            a[inner] += past
            b[inner] += past
            ends = ~same | (rest_a != rest_b)
            gone = live[inner[ends]]
            at[gone], to[gone], fell[gone] = a[inner[ends]], b[inner[ends]], k
            going = np.ones(len(live), bool)
            going[inner[ends]] = False
            live, a, b = live[going], a[going], b[going]
            up_a, up_b = level.parent[a], level.parent[b]
        at[live], to[live] = up_a, up_b
        if not len(live):
            break
    # Down again, each from where it fell: at every level both stand at symbols that differ.
    for k in range(len(levels) - 1, -1, -1):
        down = np.flatnonzero(fell > k)
        if not len(down):
            continue
        level = levels[k]
        near = level.first if step > 0 else level.last
        a, b = at[down], to[down]
        ia, ib = near[a], near[b]
        past = (level.symbols[ia] == level.symbols[ib]).astype(np.int32)
        if level.is_block:
            past *= np.minimum(level.last[a] - level.first[a], level.last[b] - level.first[b]) + 1
        at[down], to[down] = ia + past * np.int32(step), ib + past * np.int32(step)
    return np.abs(at - x)


def _stretches(levels: list[Level], i: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of the candidates' maximal stretches that are long enough, each stretch once."""
    found = []
    for k in range(0, len(i), POINTS):
        a, p = i[k : k + POINTS], q[k : k + POINTS]
        forth, back = extend(levels, a, a + p), extend(levels, a - 1, a + p - 1, -1)
        start, end = a - back, a + p + forth
        ok = end - start >= np.maximum(least, 2 * p)
        found.append(_once(np.stack([start[ok], end[ok], p[ok]], axis=1)))
    return _once(np.concatenate(found)) if found else np.empty((0, 3), np.int64)


def _once(rows: np.ndarray) -> np.ndarray:
    """Of the periods of one stretch the smallest; all others are its multiples."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows


def _candidates(symbols: np.ndarray, base: int, n: int, least: int):
    """(i, q) of a text's grid, in pieces, where the words and enough of their neighbours on one side are equal."""
    periods = np.arange(1, n // 2 + 1)
    counts = (n - 1) // periods
    edges = np.append(0, np.cumsum(counts))
    beside = (least + 1) // 2 // 2
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + POINTS, "right")) - 1)
        size = counts[at:to]
        q = np.repeat(periods[at:to], size)
        i = (np.arange(edges[to] - edges[at]) - np.repeat(edges[at:to] - edges[at], size)) * q + base
        hit = np.flatnonzero(symbols[i] == symbols[i + q])
        i, q = i[hit], q[hit]
        right = left = np.ones(len(i), bool)
        for k in range(1, beside + 1):
            right = right & (symbols[i + k] == symbols[i + q + k])
            left = left & (symbols[i - k] == symbols[i + q - k])
        yield i[right | left], q[right | left]
        at = to


def runs_of(texts: list[list], least: int = LEAST) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start and then period."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__  # a new word gets the next number
    pad = (least + 1) // 2 // 2
    pieces, bases, size, mark = [np.arange(-pad - 1, 0, dtype=np.int32)], [], pad + 1, -pad - 2
    for words in texts:
        bases.append(size)
        pieces += [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)), np.array([mark], np.int32)]
        size, mark = size + len(words) + 1, mark - 1
    pieces.append(np.arange(mark - pad, mark + 1, dtype=np.int32))
    symbols = np.concatenate(pieces)
    levels: list[Level] = []
    found, some_i, some_q, waiting = [], [], [], 0

    def measure() -> None:
        if not levels:
            levels.extend(grammar(symbols, sum(1 for t in texts if t)))
        found.append(_stretches(levels, np.concatenate(some_i), np.concatenate(some_q), least))
        some_i.clear()
        some_q.clear()

    for words, base in zip(texts, bases):
        if len(words) < least:
            continue
        for i, q in _candidates(symbols, base, len(words), least):
            if len(i):
                some_i.append(i)
                some_q.append(q)
                waiting += len(i)
            if waiting >= POINTS:
                measure()
                waiting = 0
    if some_i:
        measure()
    rows = _once(np.concatenate(found)) if found else np.empty((0, 3), np.int64)
    cut = np.searchsorted(rows[:, 0], [*bases, size])
    out = []
    for k, base in enumerate(bases):
        own = rows[cut[k] : cut[k + 1]]
        own = np.stack([own[:, 0] - base, own[:, 1] - own[:, 0], own[:, 2]], axis=1)
        out.append(own[np.lexsort((own[:, 2], own[:, 0]))])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without what any run has after its first period."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
    return b" ".join(words)


def with_runs(docs: DataFrame, text: str = "text", name: str = "periodic", least: int = LEAST) -> DataFrame:
    """The docs with a struct column of that name: n_words, runs (by start, then period) and the collapsed text."""
    ship(docs.sparkSession)

    @F.arrow_udf(f"struct<n_words: bigint, runs: {RUNS}, collapsed: string>")
    def measured(texts: pa.Array) -> pa.Array:
        sizes, short, runs = [], [], []
        group: list[list[bytes]] = []
        held = 0

        def close() -> None:
            for words, own in zip(group, runs_of(group, least)):
                sizes.append(len(words))
                runs.append(own)
                short.append(collapsed(words, own))
            group.clear()

        for t in texts.cast(pa.binary()):
            words = (t.as_py() or b"").split()
            if group and held + len(words) > WORDS:
                close()
                held = 0
            group.append(words)
            held += len(words)
        close()
        flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
        offsets = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
        fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k], np.int64)) for k in range(3)], names=["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array(short, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])

    return docs.withColumn(name, measured(F.col(text)))
