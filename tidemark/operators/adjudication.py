"""Weighted adjudication: who filed, shares that add up to one, a ruling by precedence, and the signed record.

``shares``, ``rulings`` and ``reporting`` work on tables of filings, a row each, with one shuffle by case.  ``decision`` works
on an array of desk ids in a row, with no shuffle at all: the desks that can file are a fixed few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fixed import DESKS, FILED, HEADLINE, HEADLINES, PRECEDENCE
from tidemark.functions.seeded import half_up
from tidemark.functions.text import count_word, padded


def rank_of(determination: Column) -> Column:
    """Place in the order of precedence, from 1; null for a determination that has none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, PRECEDENCE)), determination).cast("int"), F.lit(0))


def reporting(filings: DataFrame, rosters: DataFrame, case: str, desk: str) -> DataFrame:
    """The filings of each case whose desk is on the case's roster (case, desk); all of a case's filings if none is.

    The order of filings is theirs, not the roster's.  Cases without any roster row keep all filings.
    """
    on = rosters.select(F.col(case).alias("roster_case"), F.col(desk).alias("roster_desk")).distinct()
    named = filings.join(on, (F.col(case) == F.col("roster_case")) & (F.col(desk) == F.col("roster_desk")), "left")
    any_named = F.max(F.col("roster_desk").isNotNull()).over(Window.partitionBy(case))
    return named.withColumn("any_named", any_named).where(F.col("roster_desk").isNotNull() | ~F.col("any_named")).drop("roster_case", "roster_desk", "any_named")


def shares(filings: DataFrame, case: str, weight: str, seq: str) -> DataFrame:
    """Share of each filing in its case, in hundredths; the first largest takes what rounding leaves.

    One shuffle by case: both windows share its partitioning.
    """
    whole = Window.partitionBy(case)
    rough = filings.withColumn("share", half_up(F.col(weight) / F.sum(weight).over(whole), 2))
    first = F.row_number().over(whole.orderBy(F.desc("share"), seq)) == 1
    drift = half_up(F.lit(1.0) - F.sum("share").over(whole), 2)
    return rough.withColumn("share", F.when(first, half_up(F.col("share") + drift, 2)).otherwise(F.col("share")))


def rulings(filings: DataFrame, case: str, determination: str) -> DataFrame:
    """The determination of highest precedence of each case (INSUFFICIENT if none has any), with the count of filings and the confidence."""
    ranked = filings.withColumn("rank", rank_of(F.col(determination)))
    ruling = F.coalesce(F.min_by(determination, "rank"), F.lit("INSUFFICIENT"))
    counted = ranked.groupBy(case).agg(F.count("*").alias("n"), ruling.alias("ruling"), F.count_if(F.col(determination) == "SYNTHETIC").alias("synthetic"))
    return counted.withColumn("confidence", confidence(F.col("n")))


def confidence(n: Column) -> Column:
    return F.concat((F.lit(89) + n).cast("string"), F.lit("%"))


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of x, with x computed once: a lambda's argument is a value, where a column used twice is computed twice."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def filed(roster: Column) -> Column:
    """The filings (id, label, weight, determination) of the desks on a roster, in filing order; all if the roster names none of them."""
    all_filings = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(w).alias("weight"), F.lit(FILED[i]).alias("determination")) for i, label, w in DESKS))
    named = F.filter(all_filings, lambda f: F.coalesce(F.array_contains(roster, f["id"]), F.lit(False)))
    return once(named, lambda n: F.when(F.size(n) > 0, n).otherwise(all_filings))


def shares_of(filings: Column) -> Column:
    """Shares of an array of filings, as ``shares`` gives them."""

    def settled(rough: Column) -> Column:
        drift = half_up(F.lit(1.0) - F.aggregate(rough, F.lit(0.0), lambda a, s: a + s), 2)
        at = F.struct((F.array_position(rough, F.array_max(rough)) - 1).alias("first"), drift.alias("drift"))
        return once(at, lambda x: F.transform(rough, lambda s, i: F.when(i == x["first"], half_up(s + x["drift"], 2)).otherwise(s)))

    total = F.aggregate(filings, F.lit(0), lambda a, f: a + f["weight"])
    return once(once(total, lambda t: F.transform(filings, lambda f: half_up(f["weight"] / t, 2))), settled)


def ruling_of(determinations: Column) -> Column:
    """The first determination in the order of precedence that any filing has."""
    order = F.array(*map(F.lit, PRECEDENCE))
    return F.coalesce(F.get(F.filter(order, lambda d: F.array_contains(determinations, d)), F.lit(0)), F.lit("INSUFFICIENT"))


def rationale(filings: Column, ruling: Column) -> Column:
    """Our own words, under the rule's conditions; what doesn't hold is left out."""
    n = F.size(filings)
    synthetic = F.size(F.filter(filings, lambda f: f["determination"] == "SYNTHETIC"))
    return F.concat_ws(
        " ",
        F.when(n == 1, F.concat(F.get(filings, F.lit(0))["label"], F.lit(" alone could read this, and the ruling rests on it."))).otherwise(F.concat(count_word(n), F.lit(" desks reported, none against."))),
        F.when(synthetic >= 2, F.concat(count_word(synthetic), F.lit(" found synthetic media, each in its own medium."))),
        F.when(F.exists(filings, lambda f: f["id"] == "fact-check"), "Records on file contradict the claim."),
        F.when(ruling == "REQUIRES VERIFICATION", "Hold it until sources are produced.").otherwise("Publish it only as ruled."),
    )


def entries(**values: Column) -> Column:
    """A ledger: an array of (key, value), keys with spaces for underscores."""
    return F.array(*(F.struct(F.lit(k.replace("_", " ").capitalize()).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))


def decision(roster: Column) -> Column:
    """The record on the desks of a roster: contributions, annotations, ledger and verdict."""
    headlines = F.create_map(*(F.lit(x) for kv in HEADLINES.items() for x in kv))

    def record(f: Column, shares: Column, ruling: Column) -> Column:
        n, sure = F.size(f), confidence(F.size(f))
        contributions = F.zip_with(f, shares, lambda x, s: F.struct(x["label"].alias("desk"), s.alias("share"), x["determination"].alias("determination")))
        annotations = F.transform(f, lambda x, i: F.struct((i + 1).alias("ref"), x["label"].alias("quote"), x["determination"].alias("determination")))
        ledger = entries(desks_reporting=padded(n), dissenting_desks=F.lit("00"), findings_weighed=padded(n), evidence_strength=F.lit("91%"), signal_consistency=F.lit("89%"), confidence=sure)
        verdict = F.struct(ruling.alias("determination"), F.coalesce(F.try_element_at(headlines, ruling), F.lit(HEADLINE)).alias("headline"), rationale(f, ruling).alias("rationale"), sure.alias("confidence"))
        return F.struct(contributions.alias("contributions"), annotations.alias("annotations"), ledger.alias("ledger"), verdict.alias("verdict"))

    def of(f: Column) -> Column:
        weighed = F.struct(shares_of(f).alias("shares"), ruling_of(F.transform(f, lambda x: x["determination"])).alias("ruling"))
        return once(weighed, lambda w: record(f, w["shares"], w["ruling"]))

    return once(filed(roster), of)


def printed_ledger(ledger: Column) -> Column:
    return F.array_join(F.transform(ledger, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def printed_contributions(contributions: Column) -> Column:
    return F.array_join(F.transform(contributions, lambda c: F.concat(c["desk"], F.format_string(" %.2f ", c["share"]), c["determination"])), "; ")
