"""Operators over rows in an order, for tables of any size and groups of any size.

Rows are dealt by ranges of the order and sorted within each task, and written once.  Each task then is summed up in a
row or two (how many rows it has, what its last group has come to), these few rows are put in order, and what stands before a task
is added to its rows.  No task has more than its range, whatever the groups are, and nothing depends on a table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

_PLACE = (1 << 33) - 1
#: Rows of a block of ``neighbours``.
BLOCK = 1 << 16


def fresh(rows: DataFrame | list[str], *names: str) -> list[str]:
    """Column names like the given ones that clash with none of the frame's (or the list's)."""
    taken, out = {c.lower() for c in (rows if isinstance(rows, list) else rows.columns)}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def numbered(rows: DataFrame, order: list[Column | str], name: str = "seq") -> DataFrame:
    """The rows with their dense number in the order, from 1: ``row_number`` over the whole table without a task that has all of it.

    An order that leaves rows equal numbers them in any order, but the same one for all readers.
    """
    at, part, before = fresh(rows, "at", "part", "before")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    # monotonically_increasing_id is the task's number and the row's place in it.
    placed = staged(ranged, "numbered")
    counts = placed.groupBy(F.shiftright(at, 33).cast("int").alias(part)).agg(F.count("*").alias("n")).collect()  # a row a task
    offsets, total = [], 0
    for r in sorted(counts):
        offsets.append((r[0], total))
        total += r["n"]
    tasks = rows.sparkSession.createDataFrame(offsets or [(0, 0)], f"{part} int, {before} bigint")
    met = placed.withColumn(part, F.shiftright(at, 33).cast("int")).join(F.broadcast(tasks), part)
    return met.select(*rows.columns, (F.col(before) + F.col(at).bitwiseAND(F.lit(_PLACE)) + 1).alias(name))


def numbered_within(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "nth") -> DataFrame:
    """The rows with their number in their group, from 1; a group may be any part of the table."""
    seq, first, *keys = fresh(rows, "seq", "first", *by)
    all_rows = numbered(rows, [*by, *order], seq)
    firsts = all_rows.groupBy(*by).agg(F.min(seq).alias(first)).select(*(F.col(b).alias(k) for b, k in zip(by, keys)), first)
    same = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]
    return all_rows.join(firsts, same).select(*rows.columns, (F.col(seq) - F.col(first) + 1).alias(name))


def neighbours(rows: DataFrame, key: str, order: str, within: str, block: int = BLOCK) -> DataFrame:
    """The keys before and after in (order, key) within the group, null at the ends; null orders come first, as a null group is a group.

    Rows are numbered over all groups and cut into blocks of equal size.  The first and the last row of a block also
    stand, unseen, in the block beside it, so that each row meets both its neighbours there.
    """
    seq, at, own = fresh(rows, "seq", "block", "own")
    placed = numbered(rows, [within, order, key], seq)
    mine = F.floor(F.col(seq) / block)
    beside = F.when(F.col(seq) % block == 0, mine - 1).when(F.col(seq) % block == block - 1, mine + 1)
    spread = placed.select("*", F.explode(F.array_compact(F.array(mine, beside))).alias(at)).withColumn(own, F.col(at) == mine)
    w = Window.partitionBy(at).orderBy(seq)
    keep = lambda move: F.when(move(within).over(w).eqNullSafe(F.col(within)) & move(seq).over(w).isNotNull(), move(key).over(w))
    found = spread.withColumns({"previous": keep(F.lag), "next": keep(F.lead)})
    return found.where(own).drop(seq, at, own)


def scanned(rows: DataFrame, by: str, order: list[str], inputs: list[str], fields: dict[str, str], identity: tuple, step: Callable, applied: Callable[[dict[str, Column], Column], Column], start) -> DataFrame:
    """The rows with the columns of ``applied``: what their group has come to from ``start`` by steps in order, each a map of a family that composes.

    ``step(map, *inputs)`` gives the composed map's fields, ``step.apply`` the state that a map leads to, and ``applied(fields, before)`` the
    struct of the columns.  Each task composes the maps of its own rows; only its first group can have begun in tasks before, and what it had come to there
    follows from a map a task.
    """
    names = fresh(rows, "at", "open", "part", "before", "found", *fields)
    at, open_, part, before, found = names[:5]
    held = dict(zip(names[5:], fields.values()))
    ranged = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn(at, F.monotonically_increasing_id())
    to_arrow = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, is_open, group, now = True, True, None, identity
        for batch in batches:
            out, opened = [], []
            for g, *given in zip(batch.column(by).to_pylist(), *(batch.column(c).to_pylist() for c in inputs)):
                if first or g != group:
                    is_open, group, now, first = first, g, identity, False
                now = step(now, *given)
                out.append(now)
                opened.append(is_open)
            columns = [pa.array([r[k] for r in out], to_arrow[t]) for k, t in enumerate(held.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(opened, pa.bool_())], names=[*batch.schema.names, *held, open_])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields), *(f"`{n}` {t}" for n, t in held.items()), f"`{open_}` boolean"])
    maps = staged(ranged.mapInArrow(composed, kinds), "scanned")
    value = lambda x: applied({f: F.col(n) for f, n in zip(fields, held)}, x)
    # Of each task its first group, and the last map of its last group: a row a task, taken in order.
    task = F.shiftright(at, 33).cast("int")
    ends = maps.groupBy(task.alias(part)).agg(F.min_by(F.struct(by), at).alias("g"), F.max_by(F.struct(by, *held, open_), at).alias("l")).collect()
    state, group, known, carried = start, None, False, []
    spark = rows.sparkSession
    for r in sorted(ends, key=lambda r: r[part]):
        last_group, *now, is_open = r["l"]
        begun = state if known and r["g"][0] == group else start
        carried.append((r[part], begun))
        state, group, known = step.apply(tuple(now), begun if is_open else start), last_group, True
    kind = next(t for t in fields.values())
    tasks = spark.createDataFrame(carried or [(0, start)], f"`{part}` int, `{before}` {kind}")
    begun = F.when(F.col(open_), F.col(before)).otherwise(F.lit(start).cast(kind))
    met = maps.withColumn(part, task).join(F.broadcast(tasks), part).withColumn(found, value(begun))
    return met.select(*rows.columns, f"{found}.*")


class _Clamp:
    """x -> min(high, max(low, x + d)); a map is (shift, floor, ceiling)."""

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high

    def __call__(self, now: tuple, move: float | None) -> tuple:
        d = 0.0 if move is None else float(move)
        return now[0] + d, min(self.high, max(self.low, now[1] + d)), min(self.high, max(self.low, now[2] + d))

    @staticmethod
    def apply(now: tuple, x: float) -> float:
        return min(now[2], max(now[1], x + now[0]))


def clamped_levels(rows: DataFrame, by: str, order: list[str], move: str, low: float = 0.0, high: float = 1.0, start: float = 0.5) -> DataFrame:
    """The rows with ``level``: the group's level before plus the move, held between low and high, from ``start``; a null move moves nothing.

    min(high, max(low, x + d)) composes to a map of the same form, of three numbers.  Levels are those of a plain loop where the
    moves' sums are exact, and otherwise differ in the last bits.
    """
    kinds = {"shift": "double", "floor": "double", "ceiling": "double"}
    held = lambda m, x: F.struct(F.least(m["ceiling"], F.greatest(m["floor"], x + m["shift"])).alias("level"))
    return scanned(rows, by, order, [move], kinds, (0.0, float("-inf"), float("inf")), _Clamp(low, high), held, float(start))


class _Machine:
    """A map of states is the tuple of where each goes, and beside it the one before the last step."""

    def __init__(self, moves: dict[str, tuple[int, ...]], size: int):
        self.moves, self.size, self.stay = moves, size, tuple(range(size))

    def __call__(self, now: tuple, event: str | None) -> tuple:
        to = self.moves.get(event, self.stay)
        last = now[: self.size]
        return (*(to[x] for x in last), *last)

    def apply(self, now: tuple, x: int) -> int:
        return now[x]


def machine_states(rows: DataFrame, by: str, order: list[str], event: str, states: list[str], moves: dict[str, dict[str, str]]) -> DataFrame:
    """The rows with ``state``, what the group's machine is in after the row's event, and ``moved``; unknown and null events, and those that a state doesn't take, move nothing.

    Every event is a map of the few states to states; maps compose, so no task needs a whole group.  The first state is the start.
    """
    number = {s: k for k, s in enumerate(states)}
    table = {e: tuple(number[m.get(s, s)] for s in states) for e, m in moves.items()}
    fields = {f"{kind}{k}": "int" for kind in ("to", "was") for k in range(len(states))}
    names = F.array(*map(F.lit, states))

    def found(m: dict[str, Column], x: Column) -> Column:
        to, was = (F.get(F.array(*(m[f"{kind}{k}"] for k in range(len(states)))), x) for kind in ("to", "was"))
        return F.struct(F.get(names, to).alias("state"), (to != was).alias("moved"))

    return scanned(rows, by, order, [event], fields, tuple(range(len(states))) * 2, _Machine(table, len(states)), found, 0)
