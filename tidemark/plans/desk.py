"""Queries over documents, conversations, pages and parts: the desks' readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import seeded as S
from tidemark.functions import text as X
from tidemark.functions.fixed import (
    CONFIDENCE, FLAGGED_FRAMES, FLAGGED_SPANS, FOOTAGE_SECONDS, FRAMES, ISSUE, KIND_LABELS, MARKED, NOTE_DETERMINATIONS,
    RECORDING_SECONDS, REGIONS, ROSTER, SAMPLES, SCENES, TONE_TOKENS, TRANSCRIPT,
)
from tidemark.operators import adjudication
from tidemark.operators.adjudication import entries, printed_ledger
from tidemark.plans.archive import adjudicated
from tidemark.sources.tables import desks, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KIND_OF = {"en": "copy", "de": "frame", "fr": "recording", "es": "footage"}

#: White space for the other engine: Unicode's separators, the ASCII ones and the byte order mark.
_WS = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]"
_TRIM = rf"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({_TRIM}, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: length(s) > 24)"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda h, k: (xor(h, k) * 16777619) & 4294967295)"


def _imul(a: str, b: str) -> str:
    return f"((({a}) & 65535) * ({b}) + ((((({a}) >> 16) * ({b})) & 65535) * 65536)) & 4294967295"


def _draws(seed_select: str, nth: str = "1") -> str:
    """SQL with the nth draw as column u over rows with a column seed."""
    return f"""SELECT *, xor(v, v >> 14) / 4294967296.0 AS u FROM (SELECT *, xor(t, (t + ({_imul("xor(t, t >> 7)", "t | 61")})) & 4294967295) AS v
 FROM (SELECT *, {_imul("xor(a, a >> 15)", "a | 1")} AS t FROM (SELECT *, (seed + ({nth})::BIGINT * 1831565813) & 4294967295 AS a FROM ({seed_select}))))"""


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that takes long for each text."""
    return spread(_docs(spark, sf_dir))


def _toned(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    det = F.when(F.col("toxic") == 1, "CONTRADICTED").when(F.col("quality") == 1, "SUPPORTED").otherwise("REQUIRES VERIFICATION")
    return _docs(spark, sf_dir).join(labels, "doc_id", "left").select("doc_id", "lang", "source", "toxic", det.alias("determination"))


_TONED = "SELECT doc_id, lang, source, toxic, CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN 'SUPPORTED' ELSE 'REQUIRES VERIFICATION' END AS determination FROM documents LEFT JOIN labels USING (doc_id)"


@query("SELECT conv_id, turn, printf('%02d:%02d', CAST(floor(turn * 42.5 / 60) AS BIGINT), CAST(floor(turn * 42.5 % 60) AS BIGINT)) AS timecode FROM conversations")
def timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.timecode(F.col("turn") * 42.5).alias("timecode"))


@query(f"SELECT doc_id, CAST(unnest(range(1, len(s) + 1)) AS INTEGER) AS ref, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("at", "sentence")).select("doc_id", (F.col("at") + 1).alias("ref"), "sentence")


@query(rf"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> '')) AS INTEGER) AS words, length({_TRIM}) >= 80 AS long_enough FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("words"), (F.length(X.trimmed(F.col("text"))) >= 80).alias("long_enough"))


_NOTES = "list_value('REQUIRES VERIFICATION','SUPPORTED','CONTESTED','CONTRADICTED')"


def _annotations(text: Column) -> Column:
    notes = F.array(*map(F.lit, NOTE_DETERMINATIONS))
    return F.transform(F.slice(X.sentences(text), 1, 4), lambda q, i: F.struct((i + 1).alias("ref"), q.alias("quote"), F.get(notes, F.pmod(i, F.lit(len(NOTE_DETERMINATIONS)))).alias("determination")))


@query(f"SELECT doc_id, ref, quote, {_NOTES}[(ref - 1) % 4 + 1] AS determination FROM (SELECT doc_id, CAST(unnest(range(1, len(s) + 1)) AS INTEGER) AS ref, unnest(s) AS quote FROM (SELECT doc_id, {_SENTENCES}[1:4] AS s FROM documents))")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.inline(_annotations(F.col("text"))))


_LOCATED = rf"""SELECT doc_id, {_TRIM} AS body, list_sort(list_filter(list_transform({_SENTENCES}[1:4], lambda q, i: struct_pack(pos := strpos({_TRIM}, q) - 1, nth := i - 1, quote := q)), lambda s: s.pos >= 0)) AS spots FROM documents"""
# Sentences never overlap unless one repeats: a repeat is found at the first one's place and skipped.


@query(rf"""WITH l AS ({_LOCATED}), m AS (SELECT doc_id, body, list_filter(spots, lambda s, i: i = 1 OR s.pos >= spots[i - 1].pos + length(spots[i - 1].quote)) AS kept FROM l)
 SELECT doc_id, CAST(len(kept) AS INTEGER) AS marked, CAST(len(kept) + (CASE WHEN len(kept) > 0 AND kept[1].pos > 0 THEN 1 ELSE 0 END)
 + len(list_filter(kept, lambda s, i: i > 1 AND s.pos > kept[i - 1].pos + length(kept[i - 1].quote)))
 + (CASE WHEN length(body) > coalesce(kept[len(kept)].pos + length(kept[len(kept)].quote), 0) THEN 1 ELSE 0 END) AS INTEGER) AS pieces, true AS whole FROM m""")
def galley_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text cut at its first four sentences, greedily; the pieces joined are the text."""
    body = _texts(spark, sf_dir).select("doc_id", X.trimmed(F.col("text")).alias("body"), F.slice(X.sentences(F.col("text")), 1, 4).alias("quotes"))
    cut = body.withColumn("cut", X.marked_pieces(F.col("body"), F.col("quotes")))
    joined = F.array_join(F.transform("cut", lambda p: p["piece"]), "") == F.col("body")
    return cut.select("doc_id", F.size(F.filter("cut", lambda p: p["nth"].isNotNull())).alias("marked"), F.size("cut").alias("pieces"), joined.alias("whole"))


_SEED = _FNV.format(x="(CASE WHEN b = '' THEN 'empty' ELSE b END)")


#: SQL tables up to q: what the text desk measures in every document.
_DOCUMENTS_EXAMINED = rf"""e AS (SELECT doc_id, {_TRIM} AS b, {_SENTENCES}[1:4] AS s, CAST(len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents),
 z AS (SELECT *, {_SEED} AS seed FROM e), d1 AS ({_draws("SELECT * FROM z")}), d2 AS ({_draws("SELECT doc_id AS id2, seed FROM z", "2")}),
 q AS (SELECT doc_id, s, words, CAST(len(s) AS INTEGER) AS claims, 0.35 + d1.u * 0.5 AS emotive, CAST(greatest(1, floor(d2.u * 3 + 0.5)) AS BIGINT) AS shift FROM d1 JOIN d2 ON doc_id = id2)"""


@query(rf"""WITH {_DOCUMENTS_EXAMINED}
 SELECT doc_id, words, claims, round(emotive, 9) AS emotive, CASE WHEN emotive > 0.65 THEN 'HIGH' WHEN emotive > 0.45 THEN 'ELEVATED' ELSE 'LOW' END AS reading,
 printf('%02d', claims - CASE WHEN claims >= 2 THEN 1 ELSE 0 END) AS unsourced, least(1.0, claims / 4.0) AS unsourced_weight, printf('%02d', shift) AS shift,
 'Language: English; Words: ' || words || '; Claims: ' || printf('%02d', claims) || '; Entities: 12; Signals: 05; Confidence: 92%' AS ledger, 'REQUIRES VERIFICATION' AS determination FROM q""")
def text_examination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text desk's record of every document, seeded by its whole text."""
    body = _texts(spark, sf_dir).select("doc_id", X.trimmed(F.coalesce("text", F.lit(""))).alias("body"))
    d = body.select("doc_id", X.word_count(F.col("body")).alias("words"), _annotations(F.col("body")).alias("notes"), S.text_seed(F.col("body")).alias("seed"))
    # The draws are columns of their own, so that each is made once.
    d = d.select("doc_id", "words", "notes", (F.lit(0.35) + S.draw(F.col("seed"), 1) * 0.5).alias("emotive"), F.greatest(F.lit(1), F.floor(S.draw(F.col("seed"), 2) * 3 + 0.5)).cast("bigint").alias("shift"))
    emotive, claims = F.col("emotive"), F.size("notes")
    return d.select(
        "doc_id", "words", claims.alias("claims"), F.round(emotive, 9).alias("emotive"), F.when(emotive > 0.65, "HIGH").when(emotive > 0.45, "ELEVATED").otherwise("LOW").alias("reading"),
        X.padded(F.size(F.filter("notes", lambda n: n["determination"] != "SUPPORTED"))).alias("unsourced"), F.least(F.lit(1.0), claims / 4.0).alias("unsourced_weight"),
        X.padded(F.col("shift")).alias("shift"),
        printed_ledger(entries(language=F.lit("English"), words=F.col("words"), claims=X.padded(claims), entities=F.lit("12"), signals=F.lit("05"), confidence=F.lit(CONFIDENCE["text"]))).alias("ledger"),
        F.lit("REQUIRES VERIFICATION").alias("determination"),
    )


@query(f"SELECT page_id AS id, 'page' AS kind, {_FNV.format(x='url')} AS hash FROM pages UNION ALL SELECT p_partkey, 'part', {_FNV.format(x='p_name')} FROM part")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, part = table(spark, sf_dir, "pages"), table(spark, sf_dir, "part")
    return pages.select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), S.fnv1a(F.col("url")).alias("hash")).unionByName(part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), S.fnv1a(F.col("p_name")).alias("hash")))


_PART_SEED = f"SELECT p_partkey, {_FNV.format(x=chr(40) + 'p_name || ' + chr(39) + '#' + chr(39) + ' || p_partkey' + chr(41))} AS seed FROM part"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), S.fnv1a(name).alias("seed"))


@query(f"SELECT p_partkey, u AS draw FROM ({_draws(_PART_SEED, '3')})")
def mulberry_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", S.draw(F.col("seed"), 3).alias("draw"))


@query(f"SELECT page_id, CASE WHEN u > 0.5 THEN 'Present' ELSE 'Stripped' END AS metadata FROM ({_draws('SELECT page_id, ' + _FNV.format(x='url') + ' AS seed FROM pages')})")
def metadata_coin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", _coin(F.col("url")).alias("metadata"))


def _coin(name: Column) -> Column:
    return F.when(S.draw(S.name_seed(name), 1) > 0.5, "Present").otherwise("Stripped")


_LABEL = "CASE WHEN length(url) > 22 THEN left(url, 20) || '…' ELSE url END"


@query(f"""WITH m AS (SELECT page_id, url, CASE WHEN u > 0.5 THEN 'Present' ELSE 'Stripped' END AS metadata FROM ({_draws('SELECT page_id, url, ' + _FNV.format(x='url') + ' AS seed FROM pages')})),
 r(ref, x, y, w, h, mark) AS (VALUES (1, 18, 22, 26, 30, 'adverse'), (2, 58, 14, 22, 22, 'adverse'), (3, 40, 62, 34, 24, 'adverse'))
 SELECT page_id, ref, x, y, w, h, mark, 'File: ' || {_LABEL} || '; Generative signal: 87%; Regions flagged: 03; Text recovered: 14 lines; Metadata: ' || metadata || '; Confidence: 87%' AS ledger FROM m, r""")
def image_examination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for every page's address: its flagged regions, each with the tone of its annotation, and the ledger."""
    d = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("untitled")).alias("name"), _coin(F.col("url")).alias("metadata"))
    ledger = entries(file=X.shortened(F.col("name")), generative_signal=F.lit("87%"), regions_flagged=X.padded(F.lit(len(REGIONS))), text_recovered=F.lit("14 lines"), metadata=F.col("metadata"), confidence=F.lit(CONFIDENCE["image"]))
    notes = _marks("image")
    regions = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("ref", "x", "y", "w", "h"), r))) for r in REGIONS))
    mark = F.coalesce(X.tone(F.get(F.filter(notes, lambda a: a["ref"] == F.col("ref")), F.lit(0))["determination"]), F.lit("adverse"))
    return d.select("page_id", printed_ledger(ledger).alias("ledger"), F.inline(regions)).select("page_id", "ref", "x", "y", "w", "h", mark.alias("mark"), "ledger")


def _marks(desk: str) -> Column:
    """The annotations of a desk whose marks don't depend on the artifact."""
    return F.array(*(F.struct(F.lit(i).alias("ref"), F.lit(d).alias("determination")) for i, d in enumerate(MARKED[desk], 1)))


def _samples(seed: str, key: str) -> str:
    """SQL tables up to e (key, pos, sample): the envelopes of rows with a key and a seed."""
    return f"""z AS ({seed}), d AS (SELECT {key}, i, u FROM ({_draws(f"SELECT {key}, seed, unnest(range(1, {SAMPLES + 1})) AS i FROM z", "i")})),
 l({key}, i, level) AS (SELECT {key}, 0::BIGINT, 0.5::DOUBLE FROM z UNION ALL SELECT l.{key}, d.i, least(1.0, greatest(0.0, level + (u - 0.5) * 0.55)) FROM l JOIN d ON d.{key} = l.{key} AND d.i = l.i + 1),
 e AS (SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, round(0.12 + 0.88 * level * (0.35 + 0.65 * sin(pi() * (i - 0.5) / {SAMPLES})), 6) AS sample FROM l WHERE i > 0)"""


@query(f"WITH RECURSIVE {_samples(_PART_SEED, 'p_partkey')} SELECT * FROM e")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", F.posexplode(S.envelope(F.col("seed"), SAMPLES)).alias("pos", "sample")).withColumn("sample", F.round("sample", 6))


_FILE = "CASE WHEN length(url) > 22 THEN left(url, 20) || '…' ELSE url END"
_CODE = "printf('%02d:%02d', CAST(floor({x} / 60) AS BIGINT), CAST(floor({x} % 60) AS BIGINT))"
_SPAN_ROWS = ", ".join(map(str, FLAGGED_SPANS))


@query(f"""WITH RECURSIVE {_samples("SELECT page_id, " + _FNV.format(x="url") + " AS seed FROM pages", "page_id")}, s(ref, a, b) AS (VALUES {_SPAN_ROWS})
 SELECT page_id, any_value({_FILE}) AS file, '02:48' AS duration, ref, any_value({_CODE.format(x=f"(a * {RECORDING_SECONDS})")} || ' – ' || {_CODE.format(x=f"(b * {RECORDING_SECONDS})")}) AS span, round(CAST(any_value(a) AS DOUBLE) * 100, 6) AS box_left, round(CAST(any_value(b - a) AS DOUBLE) * 100, 6) AS box_width, CAST(count(*) AS INTEGER) AS samples, max(sample) AS loudest
 FROM e JOIN s ON pos / {SAMPLES} >= a AND pos / {SAMPLES} <= b JOIN pages USING (page_id) GROUP BY page_id, ref""")
def audio_examination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording for every page's address: its length, and what its envelope holds within each flagged span."""
    d = table(spark, sf_dir, "pages").select("page_id", X.shortened(F.col("url")).alias("file"), S.name_seed(F.col("url")).alias("seed"))
    spans = F.array(*(F.struct(F.lit(r).alias("ref"), F.lit(a).alias("a"), F.lit(b).alias("b")) for r, a, b in FLAGGED_SPANS))
    d = d.select("page_id", "file", S.envelope(F.col("seed"), SAMPLES).alias("envelope")).select("*", F.inline(spans))
    inside = F.filter("envelope", lambda v, i: (i / SAMPLES >= F.col("a")) & (i / SAMPLES <= F.col("b")))
    codes = F.concat(X.timecode(F.col("a") * RECORDING_SECONDS), F.lit(" – "), X.timecode(F.col("b") * RECORDING_SECONDS))
    return d.select("page_id", "file", X.timecode(F.lit(RECORDING_SECONDS)).alias("duration"), "ref", codes.alias("span"), F.round(F.col("a") * 100, 6).alias("box_left"), F.round((F.col("b") - F.col("a")) * 100, 6).alias("box_width"), F.size(inside).alias("samples"), F.round(F.array_max(inside), 6).alias("loudest"))


@query(f"""WITH t(i, speaker, ref) AS (VALUES (0, 'Speaker 01', NULL), (1, 'Speaker 02', NULL), (2, 'Speaker 01', 1), (3, 'Speaker 01', 2))
 SELECT page_id, i AS pos, printf('%02d:%02d', 42 * i // 60, 42 * i % 60) AS timecode, speaker, ref, ref IS NOT NULL AS flagged,
 'File: ' || {_FILE} || '; Duration: 02:48; Words: 421; Speakers: 02; Spans flagged: 02; Confidence: 91%' AS ledger FROM pages, t""")
def audio_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript of every recording with its evenly spaced time codes, and the ledger."""
    each = RECORDING_SECONDS / len(TRANSCRIPT)
    ledger = entries(file=X.shortened(F.coalesce("url", F.lit("untitled"))), duration=X.timecode(F.lit(RECORDING_SECONDS)), words=F.lit("421"), speakers=X.padded(F.lit(len({s for s, _ in TRANSCRIPT}))), spans_flagged=X.padded(F.lit(len(FLAGGED_SPANS))), confidence=F.lit(CONFIDENCE["audio"]))
    lines = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(s).alias("speaker"), F.lit(r).cast("int").alias("ref")) for i, (s, r) in enumerate(TRANSCRIPT)))
    d = table(spark, sf_dir, "pages").select("page_id", printed_ledger(ledger).alias("ledger")).select("*", F.inline(lines))
    return d.select("page_id", "pos", X.timecode(F.lit(each) * F.col("pos")).alias("timecode"), "speaker", "ref", F.col("ref").isNotNull().alias("flagged"), "ledger")


@query(f"""WITH t(pos, span, det, box) AS (VALUES (0, 0.34, 'CONSISTENT', 0.0), (1, 0.22, 'CONSISTENT', 0.34), (2, 0.29, 'ANOMALOUS', 0.56), (3, 0.15, 'CONSISTENT', 0.85))
 SELECT page_id, pos, round(CAST(box AS DOUBLE) * 100, 6) AS box_left, round(CAST(span AS DOUBLE) * 100, 6) AS box_width, det AS determination,
 'File: ' || {_FILE} || '; Runtime: 01:45; Frames read: 128; Scenes: 04; Frames flagged: 02; Confidence: 88%' AS ledger FROM pages, t""")
def video_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes of every piece of footage, laid side by side by their spans, and the ledger."""
    ledger = entries(file=X.shortened(F.coalesce("url", F.lit("untitled"))), runtime=X.timecode(F.lit(FOOTAGE_SECONDS)), frames_read=F.lit("128"), scenes=X.padded(F.lit(len(SCENES))), frames_flagged=X.padded(F.lit(len(FLAGGED_FRAMES))), confidence=F.lit(CONFIDENCE["video"]))
    scenes = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(sum(x for x, _ in SCENES[:i])).cast("double").alias("start"), F.lit(x).alias("span"), F.lit(d).alias("determination")) for i, (x, d) in enumerate(SCENES)))
    d = table(spark, sf_dir, "pages").select("page_id", printed_ledger(ledger).alias("ledger")).select("*", F.inline(scenes))
    return d.select("page_id", "pos", F.round(F.col("start") * 100, 6).alias("box_left"), F.round(F.col("span") * 100, 6).alias("box_width"), "determination", "ledger")


@query(f"""SELECT page_id, {_FILE} AS file, '01:45' AS runtime, i AS index, printf('%02d', i + 1) AS number, {_CODE.format(x=f"({FOOTAGE_SECONDS} / {FRAMES} * i)")} AS timecode,
 CASE i WHEN 6 THEN 1 WHEN 9 THEN 2 END AS ref FROM (SELECT page_id, url, CAST(unnest(range(0, {FRAMES})) AS INTEGER) AS i FROM pages)""")
def video_examination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footage for every page's address: evenly spaced frames, some of them flagged."""
    d = table(spark, sf_dir, "pages").select("page_id", X.shortened(F.col("url")).alias("file"), F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("index"))
    flags = F.create_map(*(F.lit(x) for kv in FLAGGED_FRAMES.items() for x in kv))
    code = X.timecode(F.lit(FOOTAGE_SECONDS / FRAMES) * F.col("index"))
    return d.select("page_id", "file", X.timecode(F.lit(FOOTAGE_SECONDS)).alias("runtime"), "index", X.padded(F.col("index") + 1).alias("number"), code.alias("timecode"), F.try_element_at(flags, F.col("index")).alias("ref"))


@query(rf"""SELECT * FROM (SELECT conv_id, regexp_replace(arg_min(text, row(turn, text)), '^{_WS}+|{_WS}+$', '', 'g') AS claim, printf('%02d', count(*)) AS exhibits, printf('%02d', count(*) FILTER (WHERE role = 'system')) AS supporting,
 printf('%02d', count(*) FILTER (WHERE role = 'user')) AS contradicting,
 'Sources searched: 17; Exhibits returned: ' || printf('%02d', count(*)) || '; Supporting: ' || printf('%02d', count(*) FILTER (WHERE role = 'system')) || '; Contradicting: ' || printf('%02d', count(*) FILTER (WHERE role = 'user')) || '; Strongest reliability: Verified; Evidence strength: 94%' AS ledger
 FROM conversations GROUP BY conv_id) WHERE length(claim) >= 24""")
def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turn as the claim, if long enough to check, and its turns as exhibits; one aggregate with map-side parts."""
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        X.trimmed(F.min_by("text", F.struct("turn", "text"))).alias("claim"), X.padded(F.count("*")).alias("exhibits"),
        X.padded(F.count_if(F.col("role") == "system")).alias("supporting"), X.padded(F.count_if(F.col("role") == "user")).alias("contradicting"),
    )
    ledger = entries(sources_searched=F.lit("17"), exhibits_returned=F.col("exhibits"), supporting=F.col("supporting"), contradicting=F.col("contradicting"), strongest_reliability=F.lit("Verified"), evidence_strength=F.lit(CONFIDENCE["fact-check"]))
    return got.where(F.length("claim") >= 24).withColumn("ledger", printed_ledger(ledger))


@query(f"SELECT doc_id, determination, CASE WHEN determination IN ('SUPPORTED','CONSISTENT','CLEAR') THEN 'clear' WHEN determination IN ('REQUIRES VERIFICATION','INSUFFICIENT') THEN 'open' ELSE 'adverse' END AS tone FROM ({_TONED})")
def tone_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toned(spark, sf_dir).select("doc_id", "determination", X.tone(F.col("determination")).alias("tone"))


@query(f"""SELECT doc_id, 'text-' || c AS text_token, 'bg-' || CASE c WHEN 'gold-ink' THEN 'gold-foil' ELSE c END AS rule_token, 'border-' || CASE c WHEN 'gold-ink' THEN 'gold-foil' ELSE c END AS border_token
 FROM (SELECT doc_id, CASE determination WHEN 'SUPPORTED' THEN 'trust-green' WHEN 'REQUIRES VERIFICATION' THEN 'gold-ink' ELSE 'secondary' END AS c FROM ({_TONED}))""")
def tone_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tone of every document is set."""
    named = F.create_map(*(x for tone, (a, b, c) in TONE_TOKENS.items() for x in (F.lit(tone), F.struct(F.lit(a).alias("text_token"), F.lit(b).alias("rule_token"), F.lit(c).alias("border_token")))))
    return _toned(spark, sf_dir).select("doc_id", F.try_element_at(named, X.tone(F.col("determination"))).alias("t")).select("doc_id", "t.*")


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS name, coalesce(CAST(l.quality AS VARCHAR), d.source) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def desk_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _docs(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("q")), "doc_id", "left")
    return joined.select("doc_id", F.coalesce("q", F.lit("")).alias("name"), F.coalesce("q", "source").alias("label"))


@query("SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN 'clear' ELSE 'adverse' END AS mark, l.toxic AS flag FROM documents d LEFT JOIN labels l USING (doc_id)")
def mark_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, "clear").alias("tone"), F.col("toxic").alias("flag"))
    return _docs(spark, sf_dir).select("doc_id").join(marks, "doc_id", "left").select("doc_id", F.coalesce("tone", F.lit("adverse")).alias("mark"), "flag")


_KIND = "CASE lang WHEN 'en' THEN 'copy' WHEN 'de' THEN 'frame' WHEN 'fr' THEN 'recording' ELSE 'footage' END"
_ROSTERS = "CASE kind WHEN 'copy' THEN ['text','fact-check'] WHEN 'frame' THEN ['image'] WHEN 'recording' THEN ['audio'] ELSE ['video','audio'] END"


def _kind() -> Column:
    return F.when(F.col("lang") == "en", "copy").when(F.col("lang") == "de", "frame").when(F.col("lang") == "fr", "recording").otherwise("footage")


def _roster(kind: Column) -> Column:
    out = None
    for k, desks in ROSTER.items():
        desks = F.array(*map(F.lit, desks))
        out = F.when(kind == k, desks) if out is None else out.when(kind == k, desks)
    return out


@query(f"""SELECT doc_id, kind, CAST(unnest(range(0, len(r))) AS INTEGER) AS pos, unnest(r) AS desk, CAST(len(r) + 4 AS INTEGER) AS stages
 FROM (SELECT doc_id, kind, {_ROSTERS} AS r FROM (SELECT doc_id, {_KIND} AS kind FROM documents))""")
def roster_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", _kind().alias("kind")).withColumn("r", _roster(F.col("kind")))
    stages = F.concat(F.array(F.lit("typing")), "r", F.array(F.lit("collecting"), F.lit("weighting"), F.lit("signing")))
    return d.select("doc_id", "kind", F.size(stages).alias("stages"), F.posexplode("r").alias("pos", "desk"))


@query(f"""WITH dim(id, number, name, reads, second, stages) AS (VALUES ('text', '01', 'Text', 'articles and statements', 'claims without sources', 3), ('image', '02', 'Image', 'photographs and stills', 'joins and repeats', 3),
  ('audio', '03', 'Audio', 'speech and calls', 'cuts and splices', 2), ('video', '04', 'Video', 'footage and its sound', 'rebuilt scenes', 3), ('fact-check', '05', 'Fact-check', 'single claims', 'records for and against', 2)),
 r AS (SELECT doc_id, CAST(unnest(range(0, len(r))) AS INTEGER) AS pos, unnest(r) AS desk FROM (SELECT doc_id, {_ROSTERS} AS r FROM (SELECT doc_id, {_KIND} AS kind FROM documents)))
 SELECT doc_id, pos, number, name, name || ' desk is reading it' AS stage, reads, second, '' AS absent, stages FROM r JOIN dim ON desk = id""")
def roster_desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The desks of every document's roster in order, from the dimension: a value by its key, by its place, and a key that isn't there."""
    value = lambda key: F.coalesce(F.get(F.filter("method", lambda m: m["key"] == key), F.lit(0))["value"], F.lit(""))
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(_roster(_kind())).alias("pos", "desk")).join(F.broadcast(desks(spark)), F.col("desk") == F.col("id"))
    return d.select("doc_id", "pos", "number", "name", F.concat("name", F.lit(" desk is reading it")).alias("stage"), value("Reads").alias("reads"), F.get("method", F.lit(1))["value"].alias("second"), value("Nothing").alias("absent"), F.size("stages").alias("stages"))


_COMMISSION = f"""c AS (SELECT doc_id, source, kind, {_ROSTERS} AS r, CAST(least(4, len(s)) AS INTEGER) AS marks FROM (SELECT doc_id, source, {_KIND} AS kind, {_SENTENCES} AS s FROM documents WHERE lang <> 'en' OR {_TRIM} <> '')),
 one AS (SELECT doc_id, pos, desk, CASE desk WHEN 'text' THEN marks ELSE 3 END AS findings, CASE desk WHEN 'text' THEN CASE WHEN marks >= 4 THEN 2 WHEN marks >= 3 THEN 1 ELSE 0 END WHEN 'image' THEN 3 ELSE 2 END AS adverse,
  CASE desk WHEN 'text' THEN 'REQUIRES VERIFICATION' WHEN 'fact-check' THEN 'CONTRADICTED' ELSE 'SYNTHETIC' END AS det FROM (SELECT doc_id, marks, unnest(range(0, len(r))) AS pos, unnest(r) AS desk FROM c)),
 read AS (SELECT doc_id, string_agg(desk || ' ' || findings || '/' || adverse || ' ' || det, '; ' ORDER BY pos) AS filings, CAST(sum(findings) AS INTEGER) AS findings, CAST(sum(adverse) AS INTEGER) AS adverse FROM one GROUP BY doc_id),
 {adjudicated("SELECT doc_id AS case_id, r AS ids FROM c")}"""


def _commission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document on the bench: its kind opens desks, each desk's reading goes with the desk by place, the core decides on that roster."""
    ready = F.length(X.trimmed(F.coalesce("text", F.lit("")))) > 0  # the bench doesn't open on blank copy
    d = _texts(spark, sf_dir).where((_kind() != "copy") | ready).select("doc_id", "source", _kind().alias("kind"), _annotations(F.coalesce("text", F.lit(""))).alias("notes")).withColumn("roster", _roster(F.col("kind")))
    of = lambda det, marks: F.struct(F.size(marks).alias("findings"), F.size(F.filter(marks, lambda n: X.tone(n["determination"]) == "adverse")).alias("adverse"), F.lit(det).alias("determination"))
    readings = {"text": of("REQUIRES VERIFICATION", F.col("notes")), "fact-check": of("CONTRADICTED", _marks("fact-check"))} | {k: of("SYNTHETIC", _marks(k)) for k in ("image", "audio", "video")}
    read = F.create_map(*(x for k, r in readings.items() for x in (F.lit(k), r)))
    return d.withColumn("read", read).withColumn("records", F.transform("roster", lambda i: F.try_element_at("read", i))).withColumn("filings", F.arrays_zip("roster", "records")).withColumn("d", adjudication.decision(F.col("roster"))).drop("read", "notes")


@query(f"""WITH {_COMMISSION} SELECT doc_id, c.kind, filings, contributions, ruling, headline, confidence,
 'Artifact: ' || upper(left(c.kind, 1)) || substring(c.kind, 2) || '; Desks opened: ' || printf('%02d', len(r)) || '; Findings marked: ' || printf('%02d', findings) || '; Adverse findings: ' || printf('%02d', adverse) || '; Filed: 22 Aug 2026; Confidence: ' || confidence AS ledger
 FROM c JOIN read USING (doc_id) JOIN decided ON doc_id = case_id""")
def commission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole commission of every document, with no shuffle."""
    c, labels = _commission(spark, sf_dir), F.create_map(*(F.lit(x) for kv in KIND_LABELS.items() for x in kv))
    count = lambda what: F.aggregate("records", F.lit(0), lambda a, r: a + r[what])
    ledger = entries(artifact=F.try_element_at(labels, F.col("kind")), desks_opened=X.padded(F.size("filings")), findings_marked=X.padded(count("findings")), adverse_findings=X.padded(count("adverse")), filed=F.lit(ISSUE), confidence=F.col("d.verdict.confidence"))
    filings = F.array_join(F.transform("filings", lambda f: F.concat_ws(" ", f["roster"], F.concat_ws("/", f["records"]["findings"], f["records"]["adverse"]), f["records"]["determination"])), "; ")
    return c.select("doc_id", "kind", filings.alias("filings"), adjudication.printed_contributions(F.col("d.contributions")).alias("contributions"), F.col("d.verdict.determination").alias("ruling"), "d.verdict.headline", "d.verdict.confidence", printed_ledger(ledger).alias("ledger"))


@query(f"""WITH {_COMMISSION} SELECT source, c.kind, count(*) AS submissions, CAST(sum(len(r)) AS BIGINT) AS desks_opened, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(adverse) AS BIGINT) AS adverse, max(confidence) AS confidence
 FROM c JOIN read USING (doc_id) JOIN decided ON doc_id = case_id GROUP BY 1, 2""")
def commission_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commissions summed by source and kind."""
    return _commission(spark, sf_dir).groupBy("source", "kind").agg(
        F.count("*").alias("submissions"), F.sum(F.size("roster")).alias("desks_opened"), F.sum(F.aggregate("records", F.lit(0), lambda a, r: a + r["findings"])).alias("findings"),
        F.sum(F.aggregate("records", F.lit(0), lambda a, r: a + r["adverse"])).alias("adverse"), F.max("d.verdict.confidence").alias("confidence"),
    )


@query("SELECT conv_id, ref, role, text AS quote FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ref FROM conversations) WHERE ref <= 3")
def exhibit_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("ref", F.row_number().over(w)).where("ref <= 3").select("conv_id", "ref", "role", F.col("text").alias("quote"))


@query("SELECT conv_id, turn, printf('%02d', turn + 1) AS two, printf('%03d', turn + 1) AS three, CASE WHEN turn = 0 THEN '01 record' ELSE printf('%02d', turn + 1) || ' records' END AS label, upper(left(role, 1)) || lower(substring(role, 2)) AS speaker FROM conversations")
def ordinal_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn") + 1
    label = F.when(F.col("turn") == 0, "01 record").otherwise(F.concat(X.padded(n), F.lit(" records")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.padded(n).alias("two"), X.padded(n, 3).alias("three"), label.alias("label"), X.capitalised(F.concat(F.upper(F.left("role", F.lit(1))), F.substring("role", 2, 1 << 30))).alias("speaker"))


@query("""SELECT page_id, CASE WHEN length(url) > 22 THEN left(url, 20) || '…' ELSE url END AS label, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(floor(n / 1024.0 + 0.5) AS BIGINT) || ' KB'
 ELSE CAST(floor(n / 1048576.0 * 10 + 0.5) / 10 AS DECIMAL(12,1)) || ' MB' END AS size, '/intel/' || lower(split_part(url, '/', 4)) AS href FROM (SELECT page_id, url, length(html) * 37 AS n FROM pages)""")
def file_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("html").cast("bigint") * 37
    return table(spark, sf_dir, "pages").select("page_id", X.shortened(F.col("url")).alias("label"), X.readable_size(n).alias("size"), F.concat(F.lit("/intel/"), F.lower(F.split_part("url", F.lit("/"), F.lit(4)))).alias("href"))


@query("SELECT 'copy' AS kind, doc_id AS id, lang AS channel, CAST(NULL AS BIGINT) AS turn FROM documents UNION ALL SELECT 'recording', conv_id, role, turn FROM conversations")
def union_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _docs(spark, sf_dir).select(F.lit("copy").alias("kind"), F.col("doc_id").alias("id"), F.col("lang").alias("channel"))
    b = table(spark, sf_dir, "conversations").select(F.lit("recording").alias("kind"), F.col("conv_id").alias("id"), F.col("role").alias("channel"), "turn")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("lang", "source").distinct()


_STORY = "lang || CASE WHEN source IS NULL OR source = '' THEN '' ELSE ' — ' || source END"


@query(f"SELECT doc_id, {_STORY} AS heading, CASE lang WHEN 'en' THEN 'Text' WHEN 'de' THEN 'Image' END AS desk FROM documents")
def story_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story's heading, and its desk where it has one."""
    story = _docs(spark, sf_dir).select("doc_id", F.concat("lang", F.when(F.col("source") != "", F.concat(F.lit(" — "), "source")).otherwise("")).alias("heading"), F.when(F.col("lang") == "en", "text").when(F.col("lang") == "de", "image").alias("of"))
    return story.join(F.broadcast(desks(spark).select("id", F.col("name").alias("desk"))), F.col("of") == F.col("id"), "left").select("doc_id", "heading", "desk")
