"""Points in spans, both ends included, by bins whose width follows the span's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import fresh


def interval_join(spans: DataFrame, points: DataFrame, by: list[str], start: str, end: str, at: str, finest: int = 10) -> DataFrame:
    """Each pair of a span and a point with equal ``by`` and start <= at <= end (whole numbers), once; by-columns come once, first.

    A span of n units lies in one or two bins of the least width above n, each four times the one before, so long spans are no more
    rows than short ones.  Points stand in one bin of each width that spans have (at most 32), and bins join by equality, sorted by
    task: Spark's estimates leave out that points become many rows, so it may not choose to broadcast them.  Spans that end before
    they start and null bounds, points and keys meet nothing.  Other columns of the two frames must differ in name.
    """
    width, cell, s_width, s_cell, *keys = fresh([*spans.columns, *points.columns], "width", "bin", "s_width", "s_bin", *by)
    bits = F.greatest(F.lit(finest), F.length(F.bin(F.col(end) - F.col(start))))
    bits = F.least(F.lit(63), bits + (bits - finest) % 2)
    known = spans.where(F.col(end) >= F.col(start)).withColumn(s_width, bits.cast("int"))
    first, last = F.expr(f"shiftright(`{start}`, `{s_width}`)"), F.expr(f"shiftright(`{end}`, `{s_width}`)")
    known = known.withColumn(s_cell, F.explode(F.array_distinct(F.array(first, last)))).select(*(F.col(b).alias(k) for b, k in zip(by, keys)), *(c for c in spans.columns if c not in by), s_width, s_cell)
    widths = [r[0] for r in known.select(s_width).distinct().collect()]  # at most 32
    dealt = points.where(F.col(at).isNotNull()).withColumn(width, F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).withColumn(cell, F.expr(f"shiftright(`{at}`, `{width}`)"))
    same = [F.col(b) == F.col(k) for b, k in zip(by, keys)] + [F.col(width) == F.col(s_width), F.col(cell) == F.col(s_cell)]
    met = dealt.join(known.hint("merge"), [*same, F.col(at) >= F.col(start), F.col(at) <= F.col(end)])
    return met.select(*by, *(c for c in spans.columns if c not in by), *(c for c in points.columns if c not in by))
