"""Queries on documents, events and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import web
from ledgerloom.session import scratch_folder, table
from ledgerloom.streaming import jobs

VOCABULARY = {
    "scaffold": ["scaffold", "scaffolds", "scaffold hire"], "tower": ["stair tower", "stair towers", "tower", "towers"],
    "formwork": ["formwork", "formwork panel", "formwork panels"], "demolition": ["demolition"], "crane": ["crane pad", "crane pads"]}


def document_emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(web.emails_in(F.col("text"))).alias("email"))


def document_phones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(web.phones_in(F.col("text"))).alias("phone"))


def document_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(web.vocabulary_hits(F.col("text"), VOCABULARY)).alias("term"))


def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with the class of its exact text: the least doc_id with the same hash."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return docs.join(least, "h").select("doc_id", "class_id", "copies")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts and sums of events by type, by a stream over the events that runs until all are read."""
    schema = table(spark, d, "events").schema
    work = scratch_folder(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet")
    timed = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    jobs.run_once(jobs.windowed_counts(timed, "ts", "event_type", "value", "1 day"), f"{work}/out", f"{work}/state", "update")
    return jobs.latest_rows(spark, f"{work}/out", "start timestamp, event_type string, n bigint, total double", ["start", "event_type"]).select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def event_windows_batch(spark: SparkSession, d: str) -> DataFrame:
    """The same windows by one batch aggregation."""
    return jobs.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 day").select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def user_event_islands(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of events without a purchase, per user: gaps and islands by two windows on one partitioning."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cut = F.sum((F.col("event_type") == "purchase").cast("int")).over(w)
    runs = table(spark, d, "events").withColumn("island", cut).where("event_type <> 'purchase'").groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


def supplier_customer_links(spark: SparkSession, d: str) -> DataFrame:
    """Joint participation in orders: per supplier and customer nation the orders, revenue and least discount."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    od = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    cu, su = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(cu, F.col("o_custkey") == F.col("c_custkey")).join(
        su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "c_nationkey").agg(
        F.countDistinct("l_orderkey").alias("orders"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("string").alias("revenue"),
        F.min("l_discount").alias("least_discount"))


def priority_by_segment(spark: SparkSession, d: str) -> DataFrame:
    od, cu = table(spark, d, "orders"), table(spark, d, "customer")
    return od.where("o_orderstatus = 'F'").join(cu, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


QUERIES = {f.__name__: f for f in (document_emails, document_phones, document_vocabulary, exact_copies, event_windows, event_windows_batch, user_event_islands, supplier_customer_links, priority_by_segment)}

_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
SQL = {
    "document_emails": rf"SELECT * FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{web.EMAIL}'))) AS email FROM documents) WHERE NOT regexp_matches(email, '{web.NO_EMAIL}')",
    "document_phones": rf"SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{web.PHONE}')), '[^0-9]', '', 'g') AS phone FROM documents",
    "document_vocabulary": " UNION ALL ".join(rf"SELECT doc_id, '{k}' AS term FROM documents WHERE regexp_matches(text, '{web.whole_words(v)}')" for k, v in VOCABULARY.items()),
    "exact_copies": "SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)",
    "event_windows": _WINDOWS, "event_windows_batch": _WINDOWS,
    "user_event_islands": """WITH i AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM i WHERE event_type <> 'purchase' GROUP BY 1, 2) GROUP BY 1""",
    "supplier_customer_links": """SELECT s_nationkey, c_nationkey, count(DISTINCT l_orderkey) AS orders, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS VARCHAR) AS revenue,
min(l_discount) AS least_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "priority_by_segment": """SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
}
