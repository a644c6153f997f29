"""Queries over rows in an order: dense numbers, pages, levels, states, spans, needles, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.fixed import BADGES, DESKS
from tidemark.functions.quotes import marked_pieces_of
from tidemark.operators import gates, intervals, pages, scan, substrings
from tidemark.plans.archive import R, _signed
from tidemark.plans.desk import _ROSTERS, _KIND, _SENTENCES, _TRIM, _WS, _kind, _roster
from tidemark.sources.tables import records, spread, table
from tidemark.streaming import desk_state

QUERIES: dict = {}
SQL: dict[str, str] = {}
_FILED = R.rstrip() + ", s AS (SELECT *, row_number() OVER (ORDER BY filed DESC, id DESC) AS filing_seq FROM r) "


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(_FILED + "SELECT id, filed, filing_seq, list_value('text', 'image', 'audio', 'video', 'fact-check')[(filing_seq - 1) % 5 + 1] AS reader FROM s")
def filing_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's number in filing order, newest first, and the desk whose turn that number is."""
    numbered = scan.numbered(records(spark, sf_dir).select("id", "filed"), [F.desc("filed"), F.desc("id")], "filing_seq")
    desks = F.array(*(F.lit(d) for d, _, _ in DESKS))
    return numbered.select("id", "filed", "filing_seq", F.get(desks, ((F.col("filing_seq") - 1) % len(DESKS)).cast("int")).alias("reader"))


@query(R + "SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM r WINDOW w AS (PARTITION BY desk ORDER BY filed, id)")
def filed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records filed before and after at the same desk; desks are few, so no task has one whole."""
    return scan.neighbours(records(spark, sf_dir).select("id", "filed", "desk"), "id", "filed", "desk").select("id", "previous", "next")


@query(R + """, k AS (SELECT region, filed, id, (row_number() OVER (PARTITION BY region ORDER BY filed DESC, id DESC) - 1) // 50 + 1 AS page FROM r)
 SELECT region, page, count(*) AS n, arg_max(id, row(filed, id)) AS first_id, max(filed) AS first_filed, arg_min(id, row(filed, id)) AS last_id, min(filed) AS last_filed FROM k GROUP BY 1, 2""")
def archive_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of every region with the keys they begin and end with; a page's last key is the next page's cursor."""
    index = pages.page_index(records(spark, sf_dir).select("region", "filed", "id"), ["region"], ["filed", "id"], 50)
    return index.select("region", "page", "n", F.col("first.id").alias("first_id"), F.col("first.filed").alias("first_filed"), F.col("last.id").alias("last_id"), F.col("last.filed").alias("last_filed"))


_STEPS = "WITH RECURSIVE m AS (SELECT event_id, user_id, {move} AS move, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
#: A step of a level: a whole number of sixty-fourths, so that sums are exact.
_MOVE = "(CAST(floor(value) AS BIGINT) % 17 - 8) / 64.0"


@query(_STEPS.format(move=_MOVE) + """w AS (SELECT event_id, user_id, n, least(1.0, greatest(0.0, 0.5 + move)) AS level FROM m WHERE n = 1
 UNION ALL SELECT m.event_id, m.user_id, m.n, least(1.0, greatest(0.0, w.level + m.move)) FROM w JOIN m ON m.user_id = w.user_id AND m.n = w.n + 1)
 SELECT event_id, user_id, CAST(level AS DOUBLE) AS level FROM w""")
def user_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level from one half for every event of a user in order of time, moved by the event and held between 0 and 1."""
    moved = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr("double((floor(value) % 17 - 8) / 64)").alias("move"))
    return scan.clamped_levels(moved, "user_id", ["ts", "event_id"], "move").select("event_id", "user_id", "level")


@query(_STEPS.format(move="event_type") + """w AS (SELECT event_id, user_id, n, CASE WHEN move = 'click' THEN 'working' ELSE 'bench' END AS state, move = 'click' AS moved FROM m WHERE n = 1
 UNION ALL SELECT m.event_id, m.user_id, m.n, CASE WHEN w.state = 'bench' AND move = 'click' THEN 'working' WHEN w.state = 'working' AND move = 'view' THEN 'record' WHEN w.state = 'record' AND move = 'purchase' THEN 'bench' ELSE w.state END,
  (w.state = 'bench' AND move = 'click') OR (w.state = 'working' AND move = 'view') OR (w.state = 'record' AND move = 'purchase') FROM w JOIN m ON m.user_id = w.user_id AND m.n = w.n + 1)
 SELECT event_id, user_id, state, moved FROM w""")
def desk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's desk after each event: a click commissions, a view settles, a purchase reopens; a commission at work is ignored."""
    events = desk_state.as_desk_events(table(spark, sf_dir, "events")).select("event_id", "user_id", "ts", "event")
    return scan.machine_states(events, "user_id", ["ts", "event_id"], "event", desk_state.STATES, desk_state.MOVES).select("event_id", "user_id", "state", "moved")


@query("""WITH s AS (SELECT user_id, event_id AS span_id, epoch_us(ts) AS start_at, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) * (event_id % 9) AS end_at FROM events WHERE event_type = 'error')
 SELECT e.event_id, count(*) AS n_spans, min(span_id) AS first_span, max(span_id) AS last_span FROM events e JOIN s ON s.user_id = e.user_id AND epoch_us(e.ts) BETWEEN start_at AND end_at GROUP BY 1""")
def events_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in spans that errors of the same user open, both ends included: spans of no length up to days, many of them overlapping."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("start_at"), F.expr("at + bigint(floor(value * 60000000)) * (event_id % 9)").alias("end_at"))
    met = intervals.interval_join(spans, events.select("user_id", "event_id", "at"), ["user_id"], "start_at", "end_at", "at", finest=20)
    return met.groupBy("event_id").agg(F.count("*").alias("n_spans"), F.min("span_id").alias("first_span"), F.max("span_id").alias("last_span"))


_SEVEN = ["id", "nation", "source", "region", "determination", "artifact", "desk"]


@query(R.rstrip() + """, x AS (SELECT *, CASE status WHEN 'F' THEN 'SUPPORTED' WHEN 'O' THEN 'REQUIRES VERIFICATION' WHEN 'P' THEN 'CONTESTED' ELSE 'INSUFFICIENT' END AS determination FROM r),
 needles AS (SELECT DISTINCT lower(trim(needle)) AS needle FROM (SELECT left(n_name, 5) AS needle FROM nation UNION ALL SELECT substr(r_name, 2, 2) FROM region UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 9800 UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation) WHERE trim(needle) <> '')
 SELECT needle, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM x, needles
 WHERE contains(lower(concat_ws(chr(1), CAST(id AS VARCHAR), nation, CAST(source AS VARCHAR), region, determination, artifact, desk)), needle) GROUP BY 1""")
def archive_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of needles (parts of names, short ones, customers' numbers) against all fields of all records."""
    index = substrings.build(_signed(spark, sf_dir), "id", _SEVEN)
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    needles = nation.select(F.left("n_name", F.lit(5)).alias("needle")).unionByName(region.select(F.substring("r_name", 2, 2).alias("needle")))
    needles = needles.unionByName(customer.where("c_acctbal > 9800").select(F.col("c_custkey").cast("string").alias("needle"))).unionByName(nation.select(F.col("n_nationkey").cast("string").alias("needle")))
    return substrings.met(index, needles).groupBy("needle").agg(F.count("*").alias("n"), F.min("key").alias("first_id"), F.max("key").alias("last_id"))


@query(rf"""WITH t AS (SELECT doc_id, lang, coalesce(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '') AS copy FROM documents),
 g AS (SELECT doc_id, CASE WHEN copy = '' THEN 'blank' WHEN length(copy) < 80 THEN 'short' WHEN lang NOT IN ('en', 'de') THEN 'language' END AS reason FROM t)
 SELECT doc_id, reason, reason IS NULL AS accepted, (SELECT count(*) FROM g WHERE reason IS NULL) AS passed, (SELECT count(*) FROM g) AS total FROM g""")
def gated_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy that the text desk takes, and the rest with the first gate that it failed; passed and total are counted in the same pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", X.trimmed(F.coalesce("text", F.lit(""))).alias("copy"))
    routed = gates.route(docs, {"blank": F.col("copy") != "", "short": F.length("copy") >= 80, "language": F.col("lang").isin("en", "de")})
    both = routed.accepted.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(routed.rejected.select("doc_id", "reason"))
    return both.select("doc_id", "reason", F.col("reason").isNull().alias("accepted"), F.lit(routed.passed).cast("bigint").alias("passed"), F.lit(routed.total).cast("bigint").alias("total"))


@query(f"""WITH b AS (SELECT doc_id, {_TRIM} AS body, {_SENTENCES} AS q FROM documents),
 s AS (SELECT doc_id, body, q, list_sort(list_transform(q, lambda x, i: struct_pack(pos := strpos(body, x) - 1, nth := i, size := length(x), cursor := 0::BIGINT, kept := 0::BIGINT, gaps := 0::BIGINT))) AS spots FROM b),
 f AS (SELECT doc_id, body, q, list_reduce(list_prepend(struct_pack(pos := 0::BIGINT, nth := 0::BIGINT, size := 0::BIGINT, cursor := 0::BIGINT, kept := 0::BIGINT, gaps := 0::BIGINT), spots),
  lambda a, x: CASE WHEN x.pos < a.cursor THEN a ELSE struct_pack(pos := x.pos, nth := x.nth, size := x.size, cursor := x.pos + x.size, kept := a.kept + 1, gaps := a.gaps + CASE WHEN x.pos > a.cursor THEN 1 ELSE 0 END) END) AS z FROM s)
 SELECT doc_id, CAST(len(q) AS INTEGER) AS quotes, CAST(z.kept AS INTEGER) AS marked, CAST(z.kept + z.gaps + CASE WHEN length(body) > z.cursor THEN 1 ELSE 0 END AS INTEGER) AS pieces, true AS whole FROM f""")
def galley_all_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document marked at all its sentences; the pieces joined are the text."""
    body = spread(table(spark, sf_dir, "documents")).select("doc_id", X.trimmed(F.col("text")).alias("body"), X.sentences(F.col("text")).alias("quotes"))
    cut = body.withColumn("cut", marked_pieces_of(F.col("body"), F.col("quotes")))
    joined = F.array_join(F.transform("cut", lambda p: p["piece"]), "") == F.col("body")
    return cut.select("doc_id", F.size("quotes").alias("quotes"), F.size(F.filter("cut", lambda p: p["nth"].isNotNull())).alias("marked"), F.size("cut").alias("pieces"), joined.alias("whole"))


@query(R + ", n AS (SELECT nation, count(*) AS n FROM r GROUP BY 1) SELECT nation, n, CAST(row_number() OVER (ORDER BY n DESC, lower(nation)) AS INTEGER) AS place FROM n")
def nations_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the number of their records, then by name as people order names; nations are few, so one task may number them."""
    counted = records(spark, sf_dir).groupBy("nation").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), X.by_name(F.col("nation")))))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Verified' WHEN 'O' THEN 'under Review' WHEN 'P' THEN 'CONTESTED' ELSE 'none' END AS status FROM orders)
 SELECT o_orderkey, status, coalesce(badge, 'unsettled') AS badge FROM s LEFT JOIN (VALUES ('verified', 'verified'), ('under review', 'review'), ('contested', 'contested'), ('error', 'error')) b(k, badge) ON lower(status) = k""")
def badges_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The badge of a status written in any case: the keys join by a collation, without functions of the status."""
    badges = spark.createDataFrame(list(BADGES.items()), "k string, badge string")
    status = F.when(F.col("o_orderstatus") == "F", "Verified").when(F.col("o_orderstatus") == "O", "under Review").when(F.col("o_orderstatus") == "P", "CONTESTED").otherwise("none")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))
    met = orders.join(F.broadcast(badges), X.by_name(F.col("status"), True) == X.by_name(F.col("k"), True), "left")
    return met.select("o_orderkey", "status", F.coalesce("badge", F.lit("unsettled")).alias("badge"))


@query(f"""SELECT doc_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, unnest(s) AS stage FROM (SELECT doc_id, list_concat(['Typing the artifact'], list_transform({_ROSTERS}, lambda d: upper(left(d, 1)) || substring(d, 2) || ' desk is reading it'),
 ['Collecting the filed records', 'Weighting each desk by what it could read', 'Signing one determination']) AS s FROM (SELECT doc_id, {_KIND} AS kind FROM documents))""")
def commission_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages that a commission passes, in order, for every document: before, the desks of its roster, and after."""
    names = F.create_map(*(F.lit(x) for i, name, _ in DESKS for x in (i, f"{name} desk is reading it")))
    after = ["Collecting the filed records", "Weighting each desk by what it could read", "Signing one determination"]
    stages = F.concat(F.array(F.lit("Typing the artifact")), F.transform(_roster(_kind()), lambda d: F.try_element_at(names, d)), F.array(*map(F.lit, after)))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(stages).alias("pos", "stage"))
