"""Queries over the signed records of all kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import records as K
from tidemark.operators.adjudication import printed_contributions, printed_ledger
from tidemark.plans.archive import adjudicated
from tidemark.plans.desk import _CODE, _DOCUMENTS_EXAMINED, _FILE, _FNV, _KIND, _ROSTERS, _WS, _draws, _kind, _roster
from tidemark.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.text_records(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "url"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first turn is long enough to check."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("claim"))
    return K.claim_records(first.where(F.length(X.trimmed(F.col("claim"))) >= 24), "claim")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.decision_records(spread(table(spark, sf_dir, "documents").select("doc_id", _roster(_kind()).alias("roster"))), "roster")


def _printed(records: DataFrame) -> DataFrame:
    b = K.base(records)
    return b.select("kind", "id", "verdict.determination", "verdict.headline", "verdict.confidence", K.printed_notes(F.col("annotations")).alias("annotations"), K.printed_readings(F.col("readings")).alias("readings"), printed_ledger(F.col("ledger")).alias("ledger"))


_TEXT = f"""{_DOCUMENTS_EXAMINED},
 text_records AS (SELECT 'text' AS kind, doc_id AS id, 'REQUIRES VERIFICATION' AS determination, 'Two claims cannot be sourced' AS headline, '92%' AS confidence,
  array_to_string(list_transform(s, lambda q, i: i || ' ' || list_value('REQUIRES VERIFICATION','SUPPORTED','CONTESTED','CONTRADICTED')[(i - 1) % 4 + 1] || ' ' || q), '; ') AS annotations,
  'Emotive language ' || CASE WHEN emotive > 0.65 THEN 'HIGH' WHEN emotive > 0.45 THEN 'ELEVATED' ELSE 'LOW' END || ' ' || CAST(floor(emotive * 1000 + 0.5) AS BIGINT) || '; Unsourced assertions ' || printf('%02d', claims - CASE WHEN claims >= 2 THEN 1 ELSE 0 END) || ' ' || CAST(floor(least(1.0, claims / 4.0) * 1000 + 0.5) AS BIGINT)
   || '; Source attribution SPARSE 280; Narrative shift ' || printf('%02d', shift) || ' 450; Register consistency STABLE 820' AS readings,
  'Language: English; Words: ' || words || '; Claims: ' || printf('%02d', claims) || '; Entities: 12; Signals: 05; Confidence: 92%' AS ledger FROM q)"""
_COIN = _draws("SELECT page_id, url, " + _FNV.format(x="url") + " AS seed FROM pages")
_IMAGE = f"""image_records AS (SELECT 'image' AS kind, page_id AS id, 'SYNTHETIC' AS determination, 'The frame was generated, not photographed' AS headline, '87%' AS confidence, '1 ANOMALOUS Region 1; 2 CONTESTED Region 2; 3 SYNTHETIC Region 3' AS annotations,
  'Red residual 0.41 410; Green residual 0.36 360; Blue residual 0.78 780; Luminance noise UNEVEN 660' AS readings,
  'File: ' || {_FILE} || '; Generative signal: 87%; Regions flagged: 03; Text recovered: 14 lines; Metadata: ' || CASE WHEN u > 0.5 THEN 'Present' ELSE 'Stripped' END || '; Confidence: 87%' AS ledger FROM ({_COIN}))"""
_AUDIO = f"""audio_records AS (SELECT 'audio' AS kind, page_id AS id, 'SYNTHETIC' AS determination, 'Two passages were not spoken in the room' AS headline, '91%' AS confidence,
  '1 SYNTHETIC ' || {_CODE.format(x="(0.52 * 168)")} || ' – ' || {_CODE.format(x="(0.63 * 168)")} || '; 2 ANOMALOUS ' || {_CODE.format(x="(0.78 * 168)")} || ' – ' || {_CODE.format(x="(0.86 * 168)")} || '; 3 CONSISTENT Full recording' AS annotations, '' AS readings,
  'File: ' || {_FILE} || '; Duration: 02:48; Words: 421; Speakers: 02; Spans flagged: 02; Confidence: 91%' AS ledger FROM pages)"""
_VIDEO = f"""video_records AS (SELECT 'video' AS kind, page_id AS id, 'SYNTHETIC' AS determination, 'One scene carries a face substitution' AS headline, '88%' AS confidence, '1 SYNTHETIC Frame 07 · 00:52; 2 ANOMALOUS Frame 10 · 01:18; 3 CONSISTENT Sound, throughout' AS annotations, '' AS readings,
  'File: ' || {_FILE} || '; Runtime: 01:45; Frames read: 128; Scenes: 04; Frames flagged: 02; Confidence: 88%' AS ledger FROM pages)"""
_CLAIM = f"""claim_records AS (SELECT 'fact-check' AS kind, conv_id AS id, 'CONTRADICTED' AS determination, 'The central figure is wrong by a factor of three' AS headline, '94%' AS confidence,
  '1 CONTRADICTED Global Ledger DB; 2 INSUFFICIENT Primary Source Archives; 3 CONTESTED Historical Event Record' AS annotations, '' AS readings,
  'Sources searched: 17; Exhibits returned: 05; Supporting: 01; Contradicting: 02; Strongest reliability: Verified; Evidence strength: 94%' AS ledger
  FROM (SELECT conv_id, arg_min(text, row(turn, text)) AS claim FROM conversations GROUP BY conv_id) WHERE length(regexp_replace(claim, '^{_WS}+|{_WS}+$', '', 'g')) >= 24)"""
_DECISION = f"""{adjudicated(f"SELECT doc_id AS case_id, {_ROSTERS} AS ids FROM (SELECT doc_id, {_KIND} AS kind FROM documents)")},
 marked AS (SELECT case_id, string_agg(place || ' ' || det || ' ' || label, '; ' ORDER BY place) AS annotations FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS place FROM filed) GROUP BY case_id),
 decision_records AS (SELECT 'decision' AS kind, case_id AS id, ruling AS determination, headline, confidence, annotations,
  printf('Desks in agreement %02d of %02d 1000; Evidence strength 91%% 910; Signal consistency 89%% 890; Model confidence ', n, n) || confidence || ' ' || (89 + n) * 10 AS readings, ledger FROM decided JOIN marked USING (case_id))"""
_KINDS = ["text", "image", "audio", "video", "claim", "decision"]


@query(f"WITH {_TEXT}, {_IMAGE}, {_AUDIO}, {_VIDEO}, {_CLAIM}, {_DECISION} " + " UNION ALL ".join(f"SELECT * FROM {k}_records" for k in _KINDS))
def records_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six kinds in one table of VARIANTs, read back by what they share."""
    pages = _pages(spark, sf_dir)
    parts = [K.varied(_copies(spark, sf_dir), "doc_id"), *(K.varied(f(pages, "url"), "page_id") for f in (K.image_records, K.audio_records, K.video_records)), K.varied(_claims(spark, sf_dir), "conv_id"), K.varied(_decisions(spark, sf_dir), "doc_id")]
    return _printed(K.all_records(*parts))


@query(f"WITH {_TEXT} SELECT * FROM text_records")
def text_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(K.varied(_copies(spark, sf_dir), "doc_id"))


@query(f"""WITH {_IMAGE}, r(ref, x, y, w, h) AS (VALUES (1, 18, 22, 26, 30), (2, 58, 14, 22, 22), (3, 40, 62, 34, 24)), c(place, label, reading, milli) AS (VALUES (1, 'Red residual', '0.41', 410), (2, 'Green residual', '0.36', 360), (3, 'Blue residual', '0.78', 780), (4, 'Luminance noise', 'UNEVEN', 660))
 SELECT id, ledger, (SELECT string_agg(concat_ws(',', ref, x, y, w, h), ' ' ORDER BY ref) FROM r) AS regions, (SELECT string_agg(label || ' ' || reading || ' ' || milli, '; ' ORDER BY place) FROM c) AS channels FROM image_records""")
def image_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's own fields, read from the VARIANT by path."""
    v = K.varied(K.image_records(_pages(spark, sf_dir), "url"), "page_id")
    regions = F.variant_get("record", "$.regions", "array<struct<ref: int, x: int, y: int, w: int, h: int>>")
    places = F.array_join(F.transform(regions, lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("ref", "x", "y", "w", "h")))), " ")
    return v.select("id", printed_ledger(F.variant_get("record", "$.ledger", f"array<{K.ENTRY}>")).alias("ledger"), places.alias("regions"), K.printed_readings(F.variant_get("record", "$.channels", f"array<{K.SIGNAL}>")).alias("channels"))


@query("""WITH e(ref, source, published, relevance, reliability, determination) AS (VALUES (1, 'Global Ledger DB', '12 May 2024', 'HIGH', 'VERIFIED', 'CONTRADICTED'), (2, 'Primary Source Archives', '10 May 2024', 'MEDIUM', 'HIGH', 'INSUFFICIENT'),
  (3, 'Historical Event Record', '20 Nov 2023', 'HIGH', 'VERIFIED', 'CONTESTED'), (4, 'Verified Witness Statements', '14 May 2024', 'LOW', 'MEDIUM', 'SUPPORTED'), (5, 'Official Register, Second Series', '03 Jun 2024', 'MEDIUM', 'VERIFIED', 'CONTRADICTED'))
 SELECT id, e.ref, source, published, relevance, reliability, e.determination FROM (WITH """ + _CLAIM + " SELECT id FROM claim_records), e")
def claim_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exhibits of every claim, out of the VARIANT by its own table function."""
    v = K.varied(_claims(spark, sf_dir), "conv_id")
    exhibits = F.variant_get("record", "$.exhibits", "array<struct<ref: int, source: string, published: string, relevance: string, reliability: string, determination: string>>")
    return v.select("id", F.inline(exhibits))


@query(f"WITH {_DECISION} SELECT id, contributions, annotations, readings FROM decision_records JOIN (SELECT case_id AS id, contributions FROM decided) USING (id)")
def decision_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = K.varied(_decisions(spark, sf_dir), "doc_id")
    own = F.variant_get("record", "$.contributions", "array<struct<desk: string, share: double, determination: string>>")
    notes, signals = F.variant_get("record", "$.annotations", f"array<{K.NOTE}>"), F.variant_get("record", "$.signals", f"array<{K.SIGNAL}>")
    return v.select("id", printed_contributions(own).alias("contributions"), K.printed_notes(notes).alias("annotations"), K.printed_readings(signals).alias("readings"))
