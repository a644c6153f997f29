"""Gates that rows must pass: the rejected keep their reason, and both are counted as they are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.scan import fresh
from tidemark.sources.staging import staged


@dataclass
class Routed:
    """What passed, what didn't with its ``reason``, and how many of each: (passed, total, by reason)."""

    accepted: DataFrame
    rejected: DataFrame
    passed: int
    total: int
    reasons: dict[str, int]


def reason_of(gates: dict[str, Column]) -> Column:
    """The name of the first gate that a row doesn't pass, null if it passes all; a gate that is null isn't passed."""
    out = F.lit(None).cast("string")
    for name, test in reversed(gates.items()):
        out = F.when(F.coalesce(test, F.lit(False)), out).otherwise(F.lit(name))
    return out


def route(rows: DataFrame, gates: dict[str, Column], reason: str = "reason") -> Routed:
    """One pass: every row is written under its reason, and the numbers are observed on the way."""
    folder = fresh(rows, "gate")[0]
    seen = Observation()
    told = rows.withColumn(reason, reason_of(gates))
    counts = [F.count_if(F.col(reason) == F.lit(g)).alias(f"r{k}") for k, g in enumerate(gates)]
    told = told.observe(seen, F.count("*").alias("total"), F.count_if(F.col(reason).isNull()).alias("passed"), *counts)
    written = staged(told.withColumn(folder, F.col(reason).isNull()), "routed", [folder])
    got = seen.get
    of = {g: got[f"r{k}"] for k, g in enumerate(gates)}
    return Routed(written.where(F.col(folder)).drop(folder, reason), written.where(~F.col(folder)).drop(folder), got["passed"], got["total"], of)
