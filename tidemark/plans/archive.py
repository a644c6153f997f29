"""Queries over records, events and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.fixed import DESKS, FLAGGED_SPANS
from tidemark.functions.seeded import clamped, half_up
from tidemark.operators import adjudication, archive, gates, scan
from tidemark.sources.tables import records, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Records as SQL, for the other engine.
R = """WITH r AS (SELECT o_orderkey AS id, o_custkey AS source, CAST(o_orderdate AS DATE) AS filed, o_orderpriority AS desk,
 o_orderstatus AS status, c_mktsegment AS artifact, n_name AS nation, r_name AS region, o_totalprice AS price
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) """
STATUS = {"F": "SUPPORTED", "O": "REQUIRES VERIFICATION", "P": "CONTESTED"}
PRIORITY_DET = ["CONTRADICTED", "SYNTHETIC", "ANOMALOUS", "REQUIRES VERIFICATION", "CLEAR"]


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _determination(col: str = "status"):
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), F.col(col)), F.lit("INSUFFICIENT"))


_DET = "CASE {c} WHEN 'F' THEN 'SUPPORTED' WHEN 'O' THEN 'REQUIRES VERIFICATION' WHEN 'P' THEN 'CONTESTED' ELSE 'INSUFFICIENT' END"


_FIELDS = ["id", "nation", "source", "region", "determination", "artifact", "desk"]
_HIT = "(" + " OR ".join(f"contains(lower(CAST({f} AS VARCHAR)), 'urgent')" for f in ("id", "nation", "source", "region", "determination", "artifact", "desk")) + ")"
_RD = R.rstrip() + f", x AS (SELECT *, {_DET.format(c='status')} AS determination, CAST(year(filed) AS VARCHAR) AS year FROM r) "


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("determination", _determination())


@query(_RD + f"SELECT id, filed, region, desk FROM x WHERE {_HIT}")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text in any of the fields that records have."""
    return archive.search(_signed(spark, sf_dir), _FIELDS, " URGENT ").select("id", "filed", "region", "desk")


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS filed, o_orderpriority AS desk, o_orderstatus AS status FROM orders WHERE year(o_orderdate) = 1998 AND o_orderpriority = '2-HIGH'")
def archive_facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both facets are filters of the scan."""
    found = archive.facet_filter(table(spark, sf_dir, "orders"), year="1998", date="o_orderdate", o_orderpriority="2-HIGH", o_orderstatus=archive.ALL)
    return found.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderpriority").alias("desk"), F.col("o_orderstatus").alias("status"))


@query("""WITH f AS (SELECT facet, value, count(*) AS n, min(o_orderkey) AS first_seq FROM (
 SELECT 'year' AS facet, CAST(year(o_orderdate) AS VARCHAR) AS value, o_orderkey FROM orders UNION ALL
 SELECT 'desk', o_orderpriority, o_orderkey FROM orders UNION ALL SELECT 'determination', o_orderstatus, o_orderkey FROM orders) GROUP BY 1, 2)
 SELECT *, CAST(CASE facet WHEN 'year' THEN row_number() OVER (PARTITION BY facet ORDER BY value DESC) WHEN 'desk' THEN row_number() OVER (PARTITION BY facet ORDER BY first_seq)
 ELSE row_number() OVER (PARTITION BY facet ORDER BY value) END AS INTEGER) AS place FROM f""")
def archive_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years falling, desks as they first appear, determinations rising."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("desk"), F.col("o_orderstatus").alias("determination"))
    return archive.ordered_facets(archive.facet_values(o, ["year", "desk", "determination"], "o_orderkey"), {"year": ("value", "desc"), "desk": ("first_seq", "asc"), "determination": ("value", "asc")})


@query(_RD + f""", hit AS (SELECT * FROM x WHERE {_HIT} AND determination = 'SUPPORTED'), k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY filed DESC, id DESC) AS nth FROM hit),
 g AS (SELECT year, count(*) AS n, CAST(row_number() OVER (ORDER BY max(row(filed, id)) DESC) AS INTEGER) AS place FROM k GROUP BY year),
 p AS (SELECT year, (nth - 1) // 20 + 1 AS page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY nth) AS ids FROM k GROUP BY 1, 2)
 SELECT year, place, n, page, ids, (SELECT count(*) FROM hit) AS shown, (SELECT count(*) FROM orders) AS total, true AS filtered FROM p JOIN g USING (year)""")
def archive_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: search and facets together, grouped by year in filing order, all pages of 20 ids, and how many of all records are shown.

    Records are read once; what is shown and how many there are in all are counted in that pass.
    """
    query, facets = " URGENT ", {"determination": "SUPPORTED"}
    wanted = {"search": archive.matches(_FIELDS, query)} | {c: F.col(c) == v for c, v in facets.items()}
    routed = gates.route(_signed(spark, sf_dir), wanted)
    hits = routed.accepted.withColumn("year", F.year("filed").cast("string"))
    groups = archive.group_pages(hits, "year", ["filed", "id"], "id", 20)
    ids = F.array_join(F.col("keys").cast("array<string>"), ",")
    return groups.select("year", "place", "n", "page", ids.alias("ids"), F.lit(routed.passed).cast("bigint").alias("shown"), F.lit(routed.total).cast("bigint").alias("total"), F.lit(archive.is_filtered(query, *facets.values())).alias("filtered"))


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY 1")
def archive_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.substring(F.col("o_orderdate").cast("string"), 1, 4).alias("year")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS shown, count(DISTINCT year(o_orderdate)) AS years, count(DISTINCT o_orderpriority) AS desks FROM orders")
def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("shown"), F.countDistinct(F.year("o_orderdate")).alias("years"), F.countDistinct("o_orderpriority").alias("desks"))


@query(R + "SELECT region, count(*) AS n, arg_max(id, row(filed, id)) AS latest_id, arg_max(filed, row(filed, id)) AS latest_filed, arg_max(status, row(filed, id)) AS latest_status FROM r GROUP BY region")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.rollup_latest(records(spark, sf_dir), "region", ["filed", "id"], ["id", "filed", "status"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS filed_on FROM orders")
def filed_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd MMM yyyy").alias("filed_on"))


@query("""SELECT o_orderkey, CASE CASE WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderstatus = 'O' THEN 'Under review' ELSE 'unknown' END
 WHEN 'verified' THEN 'verified' WHEN 'Under review' THEN 'review' ELSE 'unsettled' END AS badge FROM orders""")
def badge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "Under review").otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.badge(status).alias("badge"))


_FILINGS = """WITH f AS (SELECT o_custkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS seq, count(*) AS weight FROM orders GROUP BY 1, 2) """


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("seq")).agg(F.count("*").alias("weight"))


@query(_FILINGS + """, s AS (SELECT *, floor(weight / sum(weight) OVER (PARTITION BY o_custkey) * 100 + 0.5) / 100 AS rough FROM f),
 d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rough DESC, seq) = 1 AS first, floor((1 - sum(rough) OVER (PARTITION BY o_custkey)) * 100 + 0.5) / 100 AS drift FROM s)
 SELECT o_custkey, seq, weight, CAST(round((CASE WHEN first THEN rough + drift ELSE rough END) * 100) AS BIGINT) AS share_hundredths FROM d""")
def shares_with_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adjudication.shares(_filings(spark, sf_dir), "o_custkey", "weight", "seq")
    return s.select("o_custkey", "seq", "weight", F.round(F.col("share") * 100).cast("bigint").alias("share_hundredths"))


@query(_FILINGS + """, s AS (SELECT *, floor(weight / sum(weight) OVER (PARTITION BY o_custkey) * 100 + 0.5) / 100 AS rough FROM f),
 d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rough DESC, seq) = 1 AS first, floor((1 - sum(rough) OVER (PARTITION BY o_custkey)) * 100 + 0.5) / 100 AS drift FROM s),
 w AS (SELECT o_custkey, seq, CAST(round((CASE WHEN first THEN rough + drift ELSE rough END) * 100) AS BIGINT) AS width FROM d)
 SELECT o_custkey, seq, CAST(coalesce(sum(width) OVER (PARTITION BY o_custkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_edge, width FROM w""")
def contribution_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares laid side by side from 0 to 100; all windows use the one shuffle by customer."""
    s = adjudication.shares(_filings(spark, sf_dir), "o_custkey", "weight", "seq").withColumn("width", F.round(F.col("share") * 100).cast("bigint"))
    before = Window.partitionBy("o_custkey").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("o_custkey", "seq", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("left_edge"), "width")


_RANKED = """, x AS (SELECT o_custkey, list_value('CONTRADICTED','SYNTHETIC','ANOMALOUS','REQUIRES VERIFICATION','CLEAR')[seq] AS det FROM f),
 k AS (SELECT *, list_position(['CONTRADICTED','SYNTHETIC','ANOMALOUS','CONTESTED','REQUIRES VERIFICATION','INSUFFICIENT','CONSISTENT','SUPPORTED','CLEAR'], det) AS rank FROM x) """


def _determined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings(spark, sf_dir).withColumn("det", F.get(F.array(*map(F.lit, PRIORITY_DET)), F.col("seq") - 1))


@query(_FILINGS + _RANKED + "SELECT o_custkey, count(*) AS n, arg_min(det, rank) AS ruling FROM k GROUP BY 1")
def ruling_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjudication.rulings(_determined(spark, sf_dir), "o_custkey", "det").select("o_custkey", "n", "ruling")


#: The filings as the reference has them, written out for the other engine.
_FIVE = """f(seq, id, label, weight, det) AS (VALUES (1, 'text', 'Text', 24, 'REQUIRES VERIFICATION'), (2, 'image', 'Image', 16, 'SYNTHETIC'), (3, 'audio', 'Audio', 18, 'SYNTHETIC'),
 (4, 'video', 'Video', 21, 'SYNTHETIC'), (5, 'fact-check', 'Fact-check', 21, 'CONTRADICTED'))"""


def adjudicated(rosters: str) -> str:
    """SQL tables up to ``decided``: (case_id, n, contributions, ruling, headline, rationale, confidence, ledger) for rosters (case_id, ids)."""
    return f"""rosters AS ({rosters}), {_FIVE}, named AS (SELECT case_id, f.* FROM rosters JOIN f ON list_contains(ids, f.id)),
 filed AS (SELECT * FROM named UNION ALL SELECT case_id, f.* FROM rosters CROSS JOIN f WHERE case_id NOT IN (SELECT case_id FROM named)),
 rough AS (SELECT *, floor(weight / sum(weight) OVER (PARTITION BY case_id) * 100 + 0.5) / 100 AS s FROM filed),
 fixed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY case_id ORDER BY s DESC, seq) = 1 THEN s + floor((1 - sum(s) OVER (PARTITION BY case_id)) * 100 + 0.5) / 100 ELSE s END AS share FROM rough),
 ruled AS (SELECT case_id, count(*) AS n, string_agg(label || ' ' || printf('%.2f', round(share, 2)) || ' ' || det, '; ' ORDER BY seq) AS contributions, count(*) FILTER (WHERE det = 'SYNTHETIC') AS synthetic, bool_or(id = 'fact-check') AS checked, min(label) AS label,
  CASE WHEN bool_or(det = 'CONTRADICTED') THEN 'CONTRADICTED' WHEN bool_or(det = 'SYNTHETIC') THEN 'SYNTHETIC' ELSE 'REQUIRES VERIFICATION' END AS ruling FROM fixed GROUP BY case_id),
 decided AS (SELECT case_id, n, contributions, ruling, CASE ruling WHEN 'CONTRADICTED' THEN 'Fabricated, and assembled deliberately' WHEN 'SYNTHETIC' THEN 'Machine-made, and presented as a record' ELSE 'Unsupported, and not yet publishable' END AS headline,
  concat_ws(' ', CASE WHEN n = 1 THEN label || ' alone could read this, and the ruling rests on it.' ELSE list_value('No','One','Two','Three','Four','Five')[n + 1] || ' desks reported, none against.' END,
   CASE WHEN synthetic >= 2 THEN list_value('No','One','Two','Three','Four','Five')[synthetic + 1] || ' found synthetic media, each in its own medium.' END,
   CASE WHEN checked THEN 'Records on file contradict the claim.' END, CASE WHEN ruling = 'REQUIRES VERIFICATION' THEN 'Hold it until sources are produced.' ELSE 'Publish it only as ruled.' END) AS rationale,
  (89 + n) || '%' AS confidence,
  'Desks reporting: 0' || n || '; Dissenting desks: 00; Findings weighed: 0' || n || '; Evidence strength: 91%; Signal consistency: 89%; Confidence: ' || (89 + n) || '%' AS ledger FROM ruled)"""


@query(f"""WITH {adjudicated("SELECT c_custkey AS case_id, list(DISTINCT list_value('text','image','audio','video','fact-check')[CAST(left(o_orderpriority, 1) AS INTEGER)]) AS ids FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")}
 SELECT case_id AS c_custkey, contributions, ruling, headline, rationale, confidence, ledger FROM decided""")
def decision_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core's record for every customer: the desks of its orders report; all five where there are none."""
    desks = F.array(*(F.lit(i) for i, _, _ in DESKS))
    desk = F.get(desks, F.left("o_orderpriority", F.lit(1)).cast("int") - 1)
    of = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(desk).alias("roster"))
    d = table(spark, sf_dir, "customer").select("c_custkey").join(of, F.col("c_custkey") == F.col("o_custkey"), "left")
    d = d.select("c_custkey", adjudication.decision(F.coalesce("roster", F.array().cast("array<string>"))).alias("d"))
    return d.select("c_custkey", adjudication.printed_contributions(F.col("d.contributions")).alias("contributions"), F.col("d.verdict.determination").alias("ruling"), "d.verdict.headline", "d.verdict.rationale", "d.verdict.confidence", adjudication.printed_ledger(F.col("d.ledger")).alias("ledger"))


@query(f"""WITH o AS (SELECT o_custkey AS case_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS seq, count(*) AS weight FROM orders GROUP BY 1, 2),
 roster AS (SELECT DISTINCT o_custkey AS case_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS seq FROM orders WHERE o_orderstatus = 'P'),
 named AS (SELECT o.* FROM o JOIN roster USING (case_id, seq)), kept AS (SELECT * FROM named UNION ALL SELECT * FROM o WHERE case_id NOT IN (SELECT case_id FROM named)) SELECT case_id AS o_custkey, seq, weight FROM kept""")
def reporting_desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's filings by the desks with a contested order; all of them where there is none."""
    filings = _filings(spark, sf_dir)
    rosters = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("seq"))
    return adjudication.reporting(filings, rosters, "o_custkey", "seq").select("o_custkey", "seq", "weight")


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS contradicting, count(*) FILTER (WHERE l_discount <= 0.02) AS supporting,
 bool_or(l_tax = 0) AS any_free, concat_ws(' ', l_returnflag, CASE WHEN count(*) FILTER (WHERE l_discount > 0.05) > 0 THEN 'contradicted' END) AS summary FROM lineitem GROUP BY l_returnflag""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contra = F.count_if(F.col("l_discount") > 0.05)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), contra.alias("contradicting"), F.count_if(F.col("l_discount") <= 0.02).alias("supporting"), F.bool_or(F.col("l_tax") == 0).alias("any_free"),
        F.concat_ws(" ", "l_returnflag", F.when(contra > 0, "contradicted")).alias("summary"),
    )


@query("""SELECT c_custkey, lag(c_custkey) OVER w AS previous, lead(c_custkey) OVER w AS next, coalesce(lag(c_custkey) OVER w, c_custkey) AS back FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return scan.neighbours(c, "c_custkey", "c_custkey", "c_nationkey").select("c_custkey", "previous", "next", F.coalesce("previous", "c_custkey").alias("back"))


_DAYS = "WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS value FROM events GROUP BY 1, 2) "


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("value"))


@query(_DAYS + "SELECT event_type, min(value) AS low, max(value) AS high, arg_min(value, day) AS first, arg_max(value, day) AS last FROM d GROUP BY 1")
def series_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", "day").alias("first"), F.max_by("value", "day").alias("last"))


@query(_DAYS + """, p AS (SELECT event_type, day, value, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, max(value) OVER (PARTITION BY event_type) AS high FROM d)
 SELECT event_type, day, printf('%.2f', floor((100.0 / n * (i + 0.5)) * 100 + 0.5) / 100) || ',' || printf('%.2f', floor((100 - CAST(value AS DOUBLE) / high * 100) * 100 + 0.5) / 100) AS point FROM p""")
def series_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type")
    p = _days(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("day")) - 1).withColumn("n", F.count("*").over(w)).withColumn("high", F.max("value").over(w))
    x, y = half_up(F.lit(100.0) / F.col("n") * (F.col("i") + 0.5), 2), half_up(F.lit(100) - F.col("value").cast("double") / F.col("high") * 100, 2)
    return p.select("event_type", "day", F.concat(F.format_string("%.2f", x), F.lit(","), F.format_string("%.2f", y)).alias("point"))


@query(_DAYS + """, p AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, CAST(value AS DOUBLE) / max(value) OVER (PARTITION BY event_type) AS part FROM d),
 q AS (SELECT event_type, day, printf('%.2f', floor((100.0 / n * (i + 0.5)) * 100 + 0.5) / 100) AS x, printf('%.2f', floor((100 - part * 100) * 100 + 0.5) / 100) AS y FROM p)
 SELECT event_type, string_agg(x || ',' || y, ' ' ORDER BY day) AS line, arg_min(x, day) || ',100 ' || string_agg(x || ',' || y, ' ' ORDER BY day) || ' ' || arg_max(x, day) || ',100' AS area FROM q GROUP BY 1""")
def series_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series as a polyline, and the area under it down to the baseline; a line has one point a day."""
    points = series_plot(spark, sf_dir).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "point"))).alias("p"))
    line = F.array_join(F.transform("p", lambda x: x["point"]), " ")
    x_of = lambda at: F.split_part(F.element_at("p", at)["point"], F.lit(","), F.lit(1))
    return points.select("event_type", line.alias("line"), F.concat(x_of(1), F.lit(",100 "), line, F.lit(" "), x_of(-1), F.lit(",100")).alias("area"))


@query("""WITH h AS (SELECT event_id, user_id, event_type, date_diff('microsecond', date_trunc('hour', ts), ts) / 3600000000.0 AS frac FROM events)
 SELECT event_id, event_type, (frac >= 0.52 AND frac <= 0.63) OR (frac >= 0.78 AND frac <= 0.86) AS flagged FROM h""")
def flagged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at a fraction of their hour, flagged if that is in a span, both ends included."""
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for _, a, b in FLAGGED_SPANS))
    at = (F.unix_micros(F.col("ts").cast("timestamp")) % 3_600_000_000) / 3_600_000_000.0
    return table(spark, sf_dir, "events").withColumn("at", at).select("event_id", "event_type", F.exists(spans, lambda s: (F.col("at") >= s["start"]) & (F.col("at") <= s["end"])).alias("flagged"))


@query("SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS level, CAST(floor(value / 10 + 0.5) AS BIGINT) AS tens, CASE WHEN value / 100 > 0.65 THEN 'HIGH' WHEN value / 100 > 0.45 THEN 'ELEVATED' ELSE 'LOW' END AS band FROM events")
def signal_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / 100
    band = F.when(v > 0.65, "HIGH").when(v > 0.45, "ELEVATED").otherwise("LOW")
    return table(spark, sf_dir, "events").select("event_id", clamped(v).alias("level"), F.floor(F.col("value") / 10 + 0.5).cast("bigint").alias("tens"), band.alias("band"))
