"""Reading the tables: Parquet with declared columns, files by their names and sizes only, dimensions of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = {"image": ["jpg", "jpeg", "png", "webp", "avif"], "audio": ["mp3", "wav", "m4a", "ogg"], "video": ["mp4", "mov", "mkv", "webm"]}
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
DESK = "id string, number string, name string, reports boolean, stages array<string>, method array<struct<key: string, value: string>>"
#: The desks in order.  Ids, numbers and names are fixed; what they read and return is said in our own words.
DESK_ROWS = [
    ("text", "01", "Text", True, ["reading", "claims", "register"], [("Reads", "articles and statements"), ("Looks for", "claims without sources"), ("Returns", "the copy, marked up")]),
    ("image", "02", "Image", True, ["noise", "edges", "light"], [("Reads", "photographs and stills"), ("Looks for", "joins and repeats"), ("Returns", "marked regions")]),
    ("audio", "03", "Audio", True, ["waveform", "transcript"], [("Reads", "speech and calls"), ("Looks for", "cuts and splices"), ("Returns", "flagged stretches")]),
    ("video", "04", "Video", True, ["frames", "scenes", "sound"], [("Reads", "footage and its sound"), ("Looks for", "rebuilt scenes"), ("Returns", "flagged frames")]),
    ("fact-check", "05", "Fact-check", True, ["search", "exhibits"], [("Reads", "single claims"), ("Looks for", "records for and against"), ("Returns", "exhibits")]),
    ("decision", "06", "Decision", False, ["weighting", "signing"], [("Reads", "what the desks filed"), ("Returns", "one determination")]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its declared columns."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer splits than there are: small files of long texts; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def desks(spark: SparkSession) -> DataFrame:
    """The dimension of desks, with their order as ``desk_seq`` from 0: six rows, which Spark broadcasts."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(DESK_ROWS)], f"{DESK}, desk_seq int")


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def media_files(spark: SparkSession, folder: str, medium: str) -> DataFrame:
    """file_name, bytes, path and modified of a medium's files, whatever the case of their extensions; contents are never read."""
    wanted = "*.{" + ",".join(map(_any_case, MEDIA[medium])) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", wanted).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"), "path", F.col("modificationTime").alias("modified"))


def picked_file(files: DataFrame, by: list[str]) -> DataFrame:
    """The one file that is taken of those dropped together, a row for each drop: the first by time and then path."""
    first = F.min_by(F.struct("file_name", "bytes", "path", "modified"), F.struct("modified", "path")).alias("f")
    return files.groupBy(*by).agg(first).select(*by, "f.*")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as signed records: id, filed, desk, status, source, artifact, nation, region; newest first is (filed, id) falling.

    Nations and regions are dimensions of fixed size; Spark broadcasts them by their measured size.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return (
        orders.join(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), F.to_date("o_orderdate").alias("filed"),
            F.col("o_orderpriority").alias("desk"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("artifact"),
            F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("o_totalprice").alias("price"),
        )
    )
