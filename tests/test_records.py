"""Records of all kinds in one table, written and read back."""

from pyspark.sql import functions as F

from tidemark.operators import records as K


def test_all_kinds_through_a_file(spark, tmp_path):
    long = "A sentence that is long enough to be quoted. " * 3 + "Another one that is long enough!　And a third which is long enough? No."
    copies = spark.createDataFrame([(1, long), (2, None), (3, "  "), (4, "x" * 100_000)], "id bigint, text string")
    files = spark.createDataFrame([(5, "a_very_long_name_of_a_frame.png"), (6, None), (7, "")], "id bigint, name string")
    claims = spark.createDataFrame([(8, "  The meeting never took place at all. ")], "id bigint, claim string")
    cases = spark.createDataFrame([(9, ["image"]), (10, []), (11, ["nobody"]), (12, ["fact-check", "text"]), (13, ["text"])], "id bigint, roster array<string>")
    parts = [K.text_records(copies, "text"), K.image_records(files, "name"), K.audio_records(files, "name"), K.video_records(files, "name"), K.claim_records(claims, "claim"), K.decision_records(cases, "roster")]
    K.all_records(*(K.varied(p, "id") for p in parts)).write.parquet(str(tmp_path / "records"))
    back = spark.read.parquet(str(tmp_path / "records"))
    assert dict(back.dtypes)["record"] == "variant" and back.count() == 4 + 3 * 3 + 1 + 5
    got = {(r["kind"], r["id"]): r for r in K.base(back).collect()}
    assert all(len(r["ledger"]) == 6 and r["verdict"]["determination"] for r in got.values())
    first = got["text", 1]
    # A sentence that repeats is quoted each time; the notes are used in turn.
    assert [a["determination"] for a in first["annotations"]] == ["REQUIRES VERIFICATION", "SUPPORTED", "CONTESTED", "CONTRADICTED"]
    assert first["annotations"][3]["quote"] == "Another one that is long enough!" and [s["label"] for s in first["readings"]][1:3] == ["Unsourced assertions", "Source attribution"]
    assert first["readings"][1]["reading"] == "03" and first["readings"][1]["weight"] == 1.0
    for blank in (2, 3):
        assert not got["text", blank]["annotations"] and got["text", blank]["ledger"][1]["value"] == "0"
    assert got["text", 2]["readings"] == got["text", 3]["readings"]  # both hash as nothing
    assert got["image", 5]["ledger"][0]["value"] == "a_very_long_name_of_…" and got["image", 6]["ledger"][0]["value"] == "untitled"
    assert len(got["image", 5]["readings"]) == 4 and not got["audio", 5]["readings"] and not got["video", 5]["readings"]
    assert [a["quote"] for a in got["audio", 5]["annotations"]] == ["01:27 – 01:45", "02:11 – 02:24", "Full recording"]
    assert got["fact-check", 8]["ledger"][1]["value"] == "05" and len(got["fact-check", 8]["annotations"]) == 3
    five = got["decision", 10]
    assert five["verdict"]["determination"] == "CONTRADICTED" and five["readings"][0]["reading"] == "05 of 05" and five["readings"][3]["reading"] == "94%"
    assert [x["ledger"] for x in (five,)] == [got["decision", 11]["ledger"]]
    assert got["decision", 9]["readings"][3]["weight"] == 0.9 and got["decision", 13]["verdict"]["headline"] == "Unsupported, and not yet publishable"


def test_own_fields_by_path(spark):
    files = spark.createDataFrame([(1, "b.wav")], "id bigint, name string")
    audio, video = (K.varied(f(files, "name"), "id") for f in (K.audio_records, K.video_records))
    both = K.all_records(audio, video)
    sizes = {r["kind"]: r for r in both.select("kind", F.size(F.try_variant_get("record", "$.envelope", "array<double>")).alias("envelope"), F.try_variant_get("record", "$.transcript[2].ref", "int").alias("ref"), F.try_variant_get("record", "$.frames[6].timecode", "string").alias("code"), F.try_variant_get("record", "$.scenes", "array<struct<span: double>>").alias("scenes")).collect()}
    assert sizes["audio"]["envelope"] == 160 and sizes["audio"]["ref"] == 1 and sizes["audio"]["code"] is None
    assert sizes["video"]["code"] == "00:52" and abs(sum(s["span"] for s in sizes["video"]["scenes"]) - 1) < 1e-9 and sizes["video"]["ref"] is None
