"""The signed records of the six kinds, each with its ledger, annotations and verdict, and one table of them all.

A record is a struct of its kind's own fields and of the base fields that all have.  ``varied`` makes it a VARIANT beside its
kind and id, so records of all kinds stand in one table and are written as one; ``base`` reads what every kind has, and a kind's own fields are
read by their paths.  What desks say in prose is in our own words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import seeded as S
from tidemark.functions import text as X
from tidemark.functions.fixed import (
    CHANNELS, CONFIDENCE, DECISION_SIGNALS, EXHIBITS, FLAGGED_FRAMES, FLAGGED_SPANS, FOOTAGE_SECONDS, FRAMES, MARKED, NOTE_DETERMINATIONS,
    RECORDING_SECONDS, REGIONS, SAMPLES, SCENES, SHIFT_WEIGHT, TEXT_SIGNALS, TRANSCRIPT, VERDICTS,
)
from tidemark.operators import adjudication
from tidemark.operators.adjudication import entries

NOTE = "struct<ref: int, quote: string, note: string, determination: string>"
SIGNAL = "struct<label: string, reading: string, weight: double>"
ENTRY = "struct<key: string, value: string>"
VERDICT = "struct<determination: string, headline: string, rationale: string, confidence: string>"
#: What a determination says of the place that it marks.
SAID = {
    "REQUIRES VERIFICATION": "no source is named", "SUPPORTED": "records on file agree", "CONTESTED": "records on file disagree", "CONTRADICTED": "records on file say otherwise",
    "ANOMALOUS": "this does not fit what is around it", "SYNTHETIC": "this was made by a machine", "CONSISTENT": "this holds throughout", "INSUFFICIENT": "this is too little to go by",
}


def note(ref: Column, quote: Column, determination: Column) -> Column:
    said = F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair))
    return F.struct(ref.cast("int").alias("ref"), quote.alias("quote"), F.try_element_at(said, determination).alias("note"), determination.alias("determination"))


def signal(label: str, reading: Column | str, weight: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(label).alias("label"), as_column(reading).alias("reading"), as_column(weight).cast("double").alias("weight"))


def verdict(kind: str) -> Column:
    determination, headline = VERDICTS[kind]
    return F.struct(F.lit(determination).alias("determination"), F.lit(headline).alias("headline"), F.lit(f"The {kind} desk rules so on what it marked: {SAID[determination]}.").alias("rationale"), F.lit(CONFIDENCE[kind]).alias("confidence"))


def _record(kind: str, ledger: Column, annotations: Column, ruling: Column, **own: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), ledger.alias("ledger"), annotations.alias("annotations"), ruling.alias("verdict"), *(c.alias(n) for n, c in own.items()))


def _marks(kind: str, quotes: list[Column | str]) -> Column:
    return F.array(*(note(F.lit(i), q if isinstance(q, Column) else F.lit(q), F.lit(d)) for i, (q, d) in enumerate(zip(quotes, MARKED[kind]), 1)))


def text_records(copies: DataFrame, copy: str) -> DataFrame:
    """The frame with ``record``: the text desk's, of a column of copy; its first four sentences are marked, its draws are seeded by the trimmed copy."""
    body = copies.withColumn("_copy", X.trimmed(F.coalesce(copy, F.lit("")))).withColumn("_quotes", F.slice(X.sentences(F.col("_copy")), 1, 4)).withColumn("_seed", S.text_seed(F.col("_copy")))
    drawn = body.withColumns({"_emotive": F.lit(0.35) + S.draw(F.col("_seed"), 1) * 0.5, "_shift": F.greatest(F.lit(1), F.floor(S.draw(F.col("_seed"), 2) * 3 + 0.5)).cast("bigint"), "_words": X.word_count(F.col("_copy"))})
    kinds, marked, emotive = F.array(*map(F.lit, NOTE_DETERMINATIONS)), F.size("_quotes"), F.col("_emotive")
    annotations = F.transform("_quotes", lambda q, i: note(i + 1, q, F.get(kinds, F.pmod(i, F.lit(len(NOTE_DETERMINATIONS))))))
    unsourced = marked - F.size(F.filter(F.slice(kinds, 1, marked), lambda d: d == "SUPPORTED"))
    (sources, sparse, a), (register, stable, b) = TEXT_SIGNALS
    signals = F.array(
        signal("Emotive language", F.when(emotive > 0.65, "HIGH").when(emotive > 0.45, "ELEVATED").otherwise("LOW"), emotive), signal("Unsourced assertions", X.padded(unsourced), F.least(F.lit(1.0), marked / 4.0)),
        signal(sources, sparse, a), signal("Narrative shift", X.padded(F.col("_shift")), SHIFT_WEIGHT), signal(register, stable, b),
    )
    ledger = entries(language=F.lit("English"), words=F.col("_words"), claims=X.padded(marked), entities=F.lit("12"), signals=F.lit("05"), confidence=F.lit(CONFIDENCE["text"]))
    record = _record("text", ledger, annotations, verdict("text"), copy=F.col("_copy"), signals=signals)
    return drawn.withColumn("record", record).drop("_copy", "_quotes", "_seed", "_emotive", "_shift", "_words")


def image_records(files: DataFrame, name: str) -> DataFrame:
    """The image desk's records of a column of file names: regions, channels, and whether metadata is present."""
    file = F.coalesce(name, F.lit("untitled"))
    regions = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("ref", "x", "y", "w", "h"), r))) for r in REGIONS))
    metadata = F.when(S.draw(S.name_seed(F.col(name)), 1) > 0.5, "Present").otherwise("Stripped")
    ledger = entries(file=X.shortened(file), generative_signal=F.lit("87%"), regions_flagged=X.padded(F.lit(len(REGIONS))), text_recovered=F.lit("14 lines"), metadata=metadata, confidence=F.lit(CONFIDENCE["image"]))
    channels = F.array(*(signal(*c) for c in CHANNELS))
    return files.withColumn("record", _record("image", ledger, _marks("image", [f"Region {r[0]}" for r in REGIONS]), verdict("image"), file_name=file, regions=regions, channels=channels))


def audio_records(files: DataFrame, name: str) -> DataFrame:
    """The audio desk's: the envelope, its flagged stretches, and the transcript's time codes."""
    file, each = F.coalesce(name, F.lit("untitled")), RECORDING_SECONDS / len(TRANSCRIPT)
    spans = F.array(*(F.struct(F.lit(r).alias("ref"), F.lit(a).alias("start"), F.lit(b).alias("end")) for r, a, b in FLAGGED_SPANS))
    lines = F.array(*(F.struct(F.lit(r).cast("int").alias("ref"), X.timecode(F.lit(each * i)).alias("timecode"), F.lit(who).alias("speaker"), F.lit(r is not None).alias("flagged")) for i, (who, r) in enumerate(TRANSCRIPT)))
    codes = [F.concat(X.timecode(F.lit(a * RECORDING_SECONDS)), F.lit(" – "), X.timecode(F.lit(b * RECORDING_SECONDS))) for _, a, b in FLAGGED_SPANS]
    ledger = entries(file=X.shortened(file), duration=X.timecode(F.lit(RECORDING_SECONDS)), words=F.lit("421"), speakers=X.padded(F.lit(len({w for w, _ in TRANSCRIPT}))), spans_flagged=X.padded(F.lit(len(FLAGGED_SPANS))), confidence=F.lit(CONFIDENCE["audio"]))
    own = {"file_name": file, "duration": X.timecode(F.lit(RECORDING_SECONDS)), "envelope": S.envelope(S.name_seed(F.col(name)), SAMPLES), "flagged_spans": spans, "transcript": lines}
    return files.withColumn("record", _record("audio", ledger, _marks("audio", [*codes, "Full recording"]), verdict("audio"), **own))


def video_records(files: DataFrame, name: str) -> DataFrame:
    """The video desk's: frames with time codes and flags, and scenes."""
    file, each = F.coalesce(name, F.lit("untitled")), FOOTAGE_SECONDS / FRAMES
    frames = F.array(*(F.struct(F.lit(i).alias("index"), X.timecode(F.lit(each * i)).alias("timecode"), F.lit(FLAGGED_FRAMES.get(i)).cast("int").alias("ref")) for i in range(FRAMES)))
    scenes = F.array(*(F.struct(F.lit(f"Scene {i}").alias("label"), F.lit(x).alias("span"), F.lit(d).alias("determination")) for i, (x, d) in enumerate(SCENES, 1)))
    quotes = [F.concat(F.lit(f"Frame {i + 1:02d} · "), X.timecode(F.lit(each * i))) for i in FLAGGED_FRAMES]
    ledger = entries(file=X.shortened(file), runtime=X.timecode(F.lit(FOOTAGE_SECONDS)), frames_read=F.lit("128"), scenes=X.padded(F.lit(len(SCENES))), frames_flagged=X.padded(F.lit(len(FLAGGED_FRAMES))), confidence=F.lit(CONFIDENCE["video"]))
    return files.withColumn("record", _record("video", ledger, _marks("video", [*quotes, "Sound, throughout"]), verdict("video"), file_name=file, runtime=X.timecode(F.lit(FOOTAGE_SECONDS)), frames=frames, scenes=scenes))


def claim_records(claims: DataFrame, claim: str) -> DataFrame:
    """The fact-check desk's: the exhibits, the first three of them as annotations."""
    fields = ("source", "published", "relevance", "reliability", "determination")
    exhibits = F.array(*(F.struct(F.lit(i).alias("ref"), *(F.lit(v).alias(k) for k, v in zip(fields, e)), F.lit(SAID[e[4]]).alias("extract")) for i, e in enumerate(EXHIBITS, 1)))
    count = lambda d: X.padded(F.lit(sum(e[4] == d for e in EXHIBITS)))
    annotations = F.transform(F.slice(exhibits, 1, 3), lambda e: note(e["ref"], e["source"], e["determination"]))
    ledger = entries(sources_searched=F.lit("17"), exhibits_returned=X.padded(F.lit(len(EXHIBITS))), supporting=count("SUPPORTED"), contradicting=count("CONTRADICTED"), strongest_reliability=F.lit("Verified"), evidence_strength=F.lit(CONFIDENCE["fact-check"]))
    return claims.withColumn("record", _record("fact-check", ledger, annotations, verdict("fact-check"), claim=X.trimmed(F.col(claim)), exhibits=exhibits))


def decision_records(cases: DataFrame, roster: str) -> DataFrame:
    """The core's, of a column of desk ids: contributions and four signals."""
    decided = cases.withColumn("_d", adjudication.decision(F.col(roster)))
    n, sure = F.size("_d.contributions"), F.col("_d.verdict.confidence")
    signals = F.array(signal("Desks in agreement", F.concat(X.padded(n), F.lit(" of "), X.padded(n)), 1.0), *(signal(*s) for s in DECISION_SIGNALS), signal("Model confidence", sure, (F.lit(89) + n) / 100.0))
    annotations = F.transform("_d.annotations", lambda a: note(a["ref"], a["quote"], a["determination"]))
    record = _record("decision", F.col("_d.ledger"), annotations, F.col("_d.verdict"), contributions=F.col("_d.contributions"), signals=signals)
    return decided.withColumn("record", record).drop("_d")


def varied(records: DataFrame, key: str) -> DataFrame:
    """(kind, id, record): the record as a VARIANT beside its kind."""
    return records.select(F.col("record.kind").alias("kind"), F.col(key).cast("bigint").alias("id"), F.to_variant_object("record").alias("record"))


def all_records(*records: DataFrame) -> DataFrame:
    """One table of records of any kinds."""
    return reduce(DataFrame.unionByName, records)


def base(records: DataFrame) -> DataFrame:
    """What every kind has, read back: ledger, annotations, verdict, and the readings: a kind's signals or channels, none for the others."""
    read = lambda path, kind: F.variant_get("record", path, kind)
    readings = F.coalesce(F.try_variant_get("record", "$.signals", f"array<{SIGNAL}>"), F.try_variant_get("record", "$.channels", f"array<{SIGNAL}>"), F.array().cast(f"array<{SIGNAL}>"))
    return records.select("kind", "id", read("$.ledger", f"array<{ENTRY}>").alias("ledger"), read("$.annotations", f"array<{NOTE}>").alias("annotations"), read("$.verdict", VERDICT).alias("verdict"), readings.alias("readings"))


def printed_notes(annotations: Column) -> Column:
    return F.array_join(F.transform(annotations, lambda a: F.concat_ws(" ", a["ref"].cast("string"), a["determination"], a["quote"])), "; ")


def printed_readings(readings: Column) -> Column:
    """Labels and readings with the weight in thousandths."""
    return F.array_join(F.transform(readings, lambda s: F.concat_ws(" ", s["label"], s["reading"], F.floor(s["weight"] * 1000 + 0.5).cast("string"))), "; ")
