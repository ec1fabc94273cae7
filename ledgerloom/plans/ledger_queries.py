"""Queries on logs of edges, projects and jobs, each with its SQL; orders stand for projects and events for jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import facts, ledgers
from ledgerloom.plans.research_queries import _CANON
from ledgerloom.session import table

NOW = "2024-01-20 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW + "+00:00"))


def _edge_requests(spark: SparkSession, d: str) -> DataFrame:
    org = table(spark, d, "organisation").dropDuplicates(["org_id"])
    return org.where("trim(parent_organisation_id) <> ''").select(
        F.col("org_id").alias("subject"), F.col("parent_organisation_id").alias("object"), F.concat(F.lit(" Subsidiary_"), F.lit("of")).alias("relation"), F.coalesce("entity_confidence", F.lit(0.5)).alias("confidence"),
        F.when(F.col("provenance") == "ingestion", F.array("org_id")).alias("evidence_ids"), F.col("first_observed_at").alias("at"))


def edge_requests(spark: SparkSession, d: str) -> DataFrame:
    """What became of each request for a parent edge between canonical organisations."""
    canonical = facts.canonical_map(table(spark, d, "organisation"))
    return ledgers.relationship_requests(_edge_requests(spark, d), canonical).select("subject", "object", "relation", F.coalesce("problem", F.lit("accepted")).alias("outcome"))


def parent_edges(spark: SparkSession, d: str) -> DataFrame:
    """Open parent edges, closed where the child is defunct or inactive by then."""
    canonical = facts.canonical_map(table(spark, d, "organisation"))
    edges = ledgers.open_edges(_edge_requests(spark, d), canonical)
    ended = table(spark, d, "organisation").where("status in ('defunct', 'inactive')").join(canonical, "org_id").join(edges.select(F.col("subject").alias("root_id"), "object", "relation"), "root_id").select(
        F.col("root_id").alias("subject"), "object", "relation", F.when(F.col("status") == "defunct", "historical").otherwise("retracted").alias("status"), F.col("last_observed_at").alias("at"))
    out = ledgers.closed_edges(edges, ended, ["subject", "object", "relation"])
    return out.select("subject", "object", "relation", F.round("confidence", 6).alias("confidence"), F.size("evidence_ids").alias("evidence"), "status", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("valid_to"))


def order_problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders as projects: what is wrong with each; the last shipment is the end."""
    ends = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("project_id")).agg(F.max("l_shipdate").alias("end"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "awarded").otherwise("open").alias("status"),
                                            (F.col("o_totalprice") - 50000).alias("value"), F.when(F.col("o_orderpriority") != "5-LOW", "AUD").alias("currency"), F.col("o_orderdate").alias("start")).join(ends, "project_id", "left")
    return ledgers.project_problems(rows).select("project_id", F.array_join("problems", "; ").alias("problems")).where("problems <> ''")


def _part_requests(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "probable").otherwise("unconfirmed")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("project_id"), F.col("l_suppkey").cast("string").alias("org_id"), F.lit(" Supplier").alias("role"), status.alias("status"), F.round(1 - F.col("l_discount") * 8, 2).alias("confidence"),
        F.when(F.col("l_linestatus") == "F", F.array(F.col("l_linenumber").cast("string"))).alias("evidence_ids"), F.struct("l_shipdate", "l_linenumber").alias("at"))


def supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of suppliers in orders, from their line items as requests."""
    return ledgers.participations(_part_requests(spark, d)).select("project_id", "org_id", "status", "confidence", F.size("evidence_ids").alias("evidence"))


def supplier_part_changes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as changes of a supplier's part in an order: how many each order accepts."""
    changes = _part_requests(spark, d).withColumn("status", F.when(F.col("at.l_linenumber") == 6, "historical").otherwise(F.col("status")))
    start = changes.select("project_id").distinct().withColumn("status", F.lit("unconfirmed"))
    out = ledgers.status_changes(start, changes.select("project_id", "status", "at"), ["project_id"])
    return out.groupBy("project_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


def part_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts by name, the dearest first: a search report."""
    return ledgers.search(table(spark, d, "part"), "p_name", "BL_E", [F.desc("p_retailprice"), F.col("p_partkey")], 50).select("p_partkey", "p_name")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        F.col("event_id").alias("job_id"), kind.alias("job_type"), F.to_json(F.struct(F.col("user_id").alias("user"), (F.col("event_id") % 5000).alias("slot"))).alias("payload"), (F.col("user_id") % 4).alias("priority"), at.alias("run_at"), at.alias("created_at"),
        F.when(kind.isin("view", "signup"), "queued").when(kind == "click", "running").when(kind == "purchase", "succeeded").otherwise("failed").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), at.alias("heartbeat_at"), (F.col("event_id") % 7 == 0).alias("cancel_requested"))


def job_counts(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).groupBy("status").agg(F.count("*").alias("jobs"))


def job_claims(spark: SparkSession, d: str) -> DataFrame:
    """The next jobs of a hundred idle workers."""
    return ledgers.claims(_jobs(spark, d), _now(), 100).select("job_id", "priority", "attempts", "status")


def job_reaping(spark: SparkSession, d: str) -> DataFrame:
    """All jobs after the silent ones were reaped."""
    return ledgers.reaped(_jobs(spark, d), _now(), 86_400.0).select("job_id", "status", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"))


def job_cancelling(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by state after all of every fifth user were cancelled."""
    jobs = _jobs(spark, d)
    wanted = table(spark, d, "events").where("user_id % 5 = 0").select(F.col("event_id").alias("job_id"))
    return ledgers.cancelled(jobs, wanted).groupBy("status", "cancel_requested").agg(F.count("*").alias("jobs"))


def job_enqueuing(spark: SparkSession, d: str) -> DataFrame:
    """Slots for which a purchase would bring a signup job: those without a live one."""
    jobs = _jobs(spark, d)
    wanted = jobs.where("job_type = 'purchase'").select(F.lit("signup").alias("job_type"), "payload")
    return ledgers.enqueued(jobs, wanted, "$.slot").select(F.get_json_object("payload", "$.slot").cast("long").alias("slot"))


QUERIES = {f.__name__: f for f in (edge_requests, parent_edges, order_problems, supplier_parts, supplier_part_changes, part_search, job_counts, job_claims, job_reaping, job_cancelling, job_enqueuing)}

_REQUESTS = """req AS (SELECT o.org_id AS subject, o.parent_organisation_id AS object, coalesce(entity_confidence, 0.5) AS confidence, CASE WHEN provenance = 'ingestion' THEN o.org_id END AS evidence, first_observed_at AS asked
  FROM (SELECT DISTINCT * FROM organisation) o WHERE trim(parent_organisation_id) <> ''),
r AS (SELECT req.*, s.root_id AS sr, t.root_id AS tr, bool_or(evidence IS NOT NULL) OVER (PARTITION BY s.root_id, t.root_id ORDER BY asked, confidence ROWS UNBOUNDED PRECEDING) AS backed
  FROM req LEFT JOIN canon s ON req.subject = s.org_id LEFT JOIN canon t ON req.object = t.org_id),
j AS (SELECT *, CASE WHEN sr IS NULL OR tr IS NULL THEN 'unknown organisation' WHEN sr = tr THEN 'same organisation' WHEN confidence > 0.5 AND NOT backed THEN 'confidence without evidence' ELSE 'accepted' END AS outcome FROM r)"""
_JOBS = f"""jobs AS (SELECT event_id AS job_id, event_type AS job_type, user_id, user_id % 4 AS priority, ts AS run_at, CASE WHEN event_type IN ('view', 'signup') THEN 'queued' WHEN event_type = 'click' THEN 'running'
  WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'failed' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts, event_id % 7 = 0 AS stop, TIMESTAMP '{NOW}' AS now FROM events)"""
_PARTS = """req AS (SELECT CAST(l_orderkey AS VARCHAR) AS project_id, CAST(l_suppkey AS VARCHAR) AS org_id, CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'probable' ELSE 'unconfirmed' END AS status,
  round(1 - l_discount * 8, 2) AS confidence, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS evidence, struct_pack(a := l_shipdate, b := l_linenumber) AS asked FROM lineitem)"""
SQL = {
    "edge_requests": f"WITH RECURSIVE {_CANON}, {_REQUESTS} SELECT subject, object, 'subsidiary_of' AS relation, outcome FROM j",
    "parent_edges": f"""WITH RECURSIVE {_CANON}, {_REQUESTS},
e AS (SELECT sr AS subject, tr AS object, max(confidence) AS confidence, count(DISTINCT evidence) AS evidence, min(asked) AS valid_from FROM j WHERE outcome = 'accepted' GROUP BY 1, 2),
c AS (SELECT root_id AS subject, struct_pack(ended := last_observed_at, status := CASE WHEN status = 'defunct' THEN 'historical' ELSE 'retracted' END) AS f FROM organisation JOIN canon USING (org_id) WHERE status IN ('defunct', 'inactive')),
k AS (SELECT e.subject, e.object, min(f) AS f FROM e JOIN c ON e.subject = c.subject AND c.f.ended >= e.valid_from GROUP BY 1, 2)
SELECT subject, object, 'subsidiary_of' AS relation, round(confidence, 6) AS confidence, CAST(evidence AS INTEGER) AS evidence, coalesce(f.status, 'active') AS status,
strftime(f.ended AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS valid_to FROM e LEFT JOIN k USING (subject, object)""",
    "order_problems": """WITH e AS (SELECT l_orderkey, max(l_shipdate) AS ends FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey AS project_id, concat_ws('; ', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown status' END, CASE WHEN o_totalprice - 50000 < 0 THEN 'negative value' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'value without currency' END, CASE WHEN ends < o_orderdate THEN 'end before start' END) AS problems FROM orders LEFT JOIN e ON o_orderkey = l_orderkey)
SELECT project_id, problems FROM p WHERE problems <> ''""",
    "supplier_parts": f"""WITH {_PARTS}, r AS (SELECT *, bool_or(evidence IS NOT NULL) OVER (PARTITION BY project_id, org_id ORDER BY asked, status, confidence ROWS UNBOUNDED PRECEDING) AS backed FROM req),
g AS (SELECT * FROM r WHERE backed OR (status = 'unconfirmed' AND confidence <= 0.5))
SELECT project_id, org_id, coalesce(arg_max(status, struct_pack(a := asked, b := status)) FILTER (status <> 'unconfirmed'), 'unconfirmed') AS status, max(confidence) AS confidence, CAST(count(DISTINCT evidence) AS INTEGER) AS evidence
FROM g GROUP BY 1, 2""",
    "supplier_part_changes": f"""WITH {_PARTS}, c AS (SELECT project_id, asked, CASE WHEN asked.b = 6 THEN 'historical' ELSE status END AS status FROM req),
k AS (SELECT *, CASE status WHEN 'confirmed' THEN 2 WHEN 'probable' THEN 1 WHEN 'unconfirmed' THEN 0 END AS rank FROM c),
w AS (SELECT *, coalesce(max(rank) OVER o, 0) AS reached, coalesce(bool_or(status = 'historical') OVER o, false) AS ended FROM k WINDOW o AS (PARTITION BY project_id ORDER BY asked, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT project_id, count(*) FILTER (NOT ended AND (status = 'historical' OR rank >= reached)) AS accepted, count(*) FILTER (ended OR NOT (status = 'historical' OR rank >= reached)) AS refused FROM w GROUP BY 1""",
    "part_search": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BL_E%' ORDER BY p_retailprice DESC, p_partkey LIMIT 50",
    "job_counts": f"WITH {_JOBS} SELECT status, count(*) AS jobs FROM jobs GROUP BY 1",
    "job_claims": f"WITH {_JOBS} SELECT job_id, priority, attempts + 1 AS attempts, 'running' AS status FROM jobs WHERE status = 'queued' AND run_at <= now ORDER BY priority, run_at, job_id LIMIT 100",
    "job_reaping": f"""WITH {_JOBS}, s AS (SELECT *, status = 'running' AND run_at < now - INTERVAL 1 DAY AS hit FROM jobs)
SELECT job_id, CASE WHEN hit AND attempts < 3 AND NOT stop THEN 'queued' WHEN hit THEN 'failed' ELSE status END AS status,
strftime(CASE WHEN hit AND attempts < 3 AND NOT stop THEN now + to_seconds(CAST(least(5 * pow(2, greatest(attempts - 1, 0)), 300) AS BIGINT)) ELSE run_at END, '%Y-%m-%d %H:%M:%S') AS run_at FROM s""",
    "job_cancelling": f"""WITH {_JOBS} SELECT CASE WHEN user_id % 5 = 0 AND status = 'queued' THEN 'cancelled' ELSE status END AS status, stop OR (user_id % 5 = 0 AND status = 'running') AS cancel_requested, count(*) AS jobs
FROM jobs GROUP BY 1, 2""",
    "job_enqueuing": f"WITH {_JOBS} SELECT DISTINCT job_id % 5000 AS slot FROM jobs WHERE job_type = 'purchase' AND job_id % 5000 NOT IN (SELECT job_id % 5000 FROM jobs WHERE job_type = 'signup' AND status IN ('queued', 'running'))",
}
