"""Edges, projects and jobs as folds over their logs: what each request did, and the state that results.

A log row is a request with its time. All folds are windows or aggregations by the thing asked about, so a log of any length
is read once and the order of its rows does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.confidence import backoff_seconds
from ledgerloom.operators.research import bounded_confidence

# States of a part in a project, the surer later; final ones; states of a project.
PROGRESS = ("unconfirmed", "probable", "confirmed")
FINAL = ("historical", "retracted")
PROJECT_STATES = ("announced", "tendering", "awarded", "in_progress", "completed", "cancelled", "unknown")


def _ids(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


# --- relationships

def relationship_requests(requests: DataFrame, canonical: DataFrame) -> DataFrame:
    """``requests`` (subject, object, relation, confidence, evidence_ids, at) between canonical organisations, with ``problem``: blank
    relation, unknown organisation, same organisation, or a confidence above a half without evidence on the edge so far."""
    at = lambda c: canonical.select(F.col("org_id").alias(c), F.col("root_id").alias(f"{c}_root"))
    rows = requests.join(at("subject"), "subject", "left").join(at("object"), "object", "left").withColumn("relation", F.lower(F.trim("relation")))
    so_far = Window.partitionBy("subject_root", "object_root", "relation").orderBy("at", "confidence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.max(F.when(F.size(_ids("evidence_ids")) > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))).over(so_far)
    sure = bounded_confidence(F.col("confidence"), F.col("known"))
    return rows.withColumn("known", known).withColumn("problem", (
        F.when(F.coalesce(F.length("relation"), F.lit(0)) == 0, "blank relation").when(F.col("subject_root").isNull() | F.col("object_root").isNull(), "unknown organisation")
        .when(F.col("subject_root") == F.col("object_root"), "same organisation").when(sure.isNull(), "confidence without evidence"))).drop("known")


def open_edges(requests: DataFrame, canonical: DataFrame) -> DataFrame:
    """One edge per pair and relation: the best confidence, all evidence, valid from its first request."""
    good = relationship_requests(requests, canonical).where("problem is null")
    return good.groupBy(F.col("subject_root").alias("subject"), F.col("object_root").alias("object"), "relation").agg(
        F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(_ids("evidence_ids"))))).alias("evidence_ids"), F.min("at").alias("valid_from"))


def closed_edges(edges: DataFrame, closings: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` with status and valid_to after ``closings`` (keys, status historical or retracted, at): the first that does not
    precede valid_from counts, later ones change nothing, as history is immutable."""
    rows = closings.where(F.col("status").isin(*FINAL)).join(edges.select(*keys, "valid_from"), keys).where(F.col("at") >= F.col("valid_from"))
    first = rows.groupBy(*keys).agg(F.min(F.struct("at", "status")).alias("f"))
    return edges.join(first, keys, "left").withColumn("status", F.coalesce("f.status", F.lit("active"))).withColumn("valid_to", F.col("f.at")).drop("f")


# --- projects

def project_problems(projects: DataFrame) -> DataFrame:
    """``(project_id, problems)`` of projects (name, status, value, currency, start, end): all reasons against each, in order."""
    return projects.select("project_id", F.array_compact(F.array(
        F.when(F.coalesce(F.length(F.trim("name")), F.lit(0)) == 0, "blank name"), F.when(~F.coalesce(F.col("status").isin(*PROJECT_STATES), F.lit(False)), "unknown status"),
        F.when(F.col("value") < 0, "negative value"), F.when(F.col("value").isNotNull() & (F.coalesce(F.length(F.trim("currency")), F.lit(0)) == 0), "value without currency"),
        F.when(F.col("end") < F.col("start"), "end before start"))).alias("problems"))


def participations(requests: DataFrame) -> DataFrame:
    """One row per project, organisation and role: best confidence, all evidence, the latest status asked for that may stand.

    ``requests``: project_id, org_id, role, status, confidence, evidence_ids, at. A probable or confirmed part needs evidence by then;
    a request for a final status is refused, as is a confidence above a half without evidence.
    """
    key = ["project_id", "org_id", "role"]
    so_far = Window.partitionBy(*key).orderBy("at", "status", "confidence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = requests.withColumn("role", F.lower(F.trim("role"))).where("role <> ''").withColumn("backed", F.max(F.size(_ids("evidence_ids")) > 0).over(so_far))
    good = rows.where(F.col("status").isin(*PROGRESS) & F.col("confidence").between(0, 1) & (F.col("backed") | ((F.col("status") == PROGRESS[0]) & (F.col("confidence") <= 0.5))))
    last = F.max_by("status", F.when(F.col("status") != PROGRESS[0], F.struct("at", "status")))
    return good.groupBy(*key).agg(F.coalesce(last, F.lit(PROGRESS[0])).alias("status"), F.max("confidence").alias("confidence"),
                                  F.array_sort(F.array_distinct(F.flatten(F.collect_list(_ids("evidence_ids"))))).alias("evidence_ids"), F.max("at").alias("last_observed_at"))


def status_changes(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` (keys, status, at) with ``accepted``: no step back, nothing after a final status.

    A refused step back never raises what was reached, so the highest step before a row tells what it must not fall below.
    """
    rank = lambda c: F.when(c == "confirmed", 2).when(c == "probable", 1).when(c == "unconfirmed", 0)
    rows = changes.join(current.select(*keys, F.col("status").alias("from")), keys)
    before = Window.partitionBy(*keys).orderBy("at", "status").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.coalesce(rank(F.col("from")), F.lit(0)), F.coalesce(F.max(rank(F.col("status"))).over(before), F.lit(0)))
    ended = F.col("from").isin(*FINAL) | F.coalesce(F.max(F.col("status").isin(*FINAL)).over(before), F.lit(False))
    fits = F.col("status").isin(*FINAL) | (rank(F.col("status")) >= reached)
    return rows.withColumn("accepted", ~ended & F.coalesce(fits, F.lit(False))).drop("from")


def search(rows: DataFrame, column: str, query: str, order: list[Column], most: int) -> DataFrame:
    """Rows whose column contains the query, whatever its case; ``%`` and ``_`` of the query are wildcards."""
    return rows.where(F.col(column).ilike(f"%{query}%")).orderBy(*order).limit(most)


# --- jobs

def claims(jobs: DataFrame, at: Column, workers: int) -> DataFrame:
    """The next jobs for that many idle workers: queued and due, by priority, time to run and creation."""
    return jobs.where((F.col("status") == "queued") & (F.col("run_at") <= at)).orderBy("priority", "run_at", "created_at", "job_id").limit(workers).withColumn(
        "status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("heartbeat_at", at).withColumn("started_at", at)


def failed(jobs: DataFrame, at: Column, hit: Column, retryable: bool = True) -> DataFrame:
    """``jobs`` where those hit have failed at that time: queued again with a doubling delay while attempts are left, else failed."""
    again = hit & F.lit(retryable) & (F.col("attempts") < F.col("max_attempts")) & ~F.coalesce(F.col("cancel_requested"), F.lit(False))
    later = F.timestamp_micros(F.unix_micros(at) + (backoff_seconds(F.col("attempts")) * 1_000_000).cast("long"))
    return jobs.withColumn("__again", again).withColumn("__ends", hit & ~again).withColumn("run_at", F.when(F.col("__again"), later).otherwise(F.col("run_at"))).withColumn(
        "status", F.when(F.col("__again"), "queued").when(F.col("__ends"), "failed").otherwise(F.col("status"))).drop("__again", "__ends")


def reaped(jobs: DataFrame, at: Column, stale_seconds: float = 120.0) -> DataFrame:
    """Running jobs whose heartbeat went silent fail the usual way."""
    silent = (F.col("status") == "running") & (F.unix_micros("heartbeat_at") < F.unix_micros(at) - int(stale_seconds * 1_000_000))
    return failed(jobs, at, F.coalesce(silent, F.lit(False)))


def beaten(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """Heartbeats (job_id, at) of running jobs; the latest counts."""
    last = beats.groupBy("job_id").agg(F.max("at").alias("__at"))
    return jobs.join(last, "job_id", "left").withColumn("heartbeat_at", F.when(F.col("status") == "running", F.greatest("heartbeat_at", "__at")).otherwise(F.col("heartbeat_at"))).drop("__at")


def cancelled(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Queued jobs are cancelled at once, running ones asked to stop, ended ones left."""
    hit = F.coalesce("__hit", F.lit(False))
    rows = jobs.join(wanted.select("job_id", F.lit(True).alias("__hit")).distinct(), "job_id", "left")
    return rows.withColumn("cancel_requested", F.coalesce("cancel_requested", F.lit(False)) | (hit & (F.col("status") == "running"))).withColumn(
        "status", F.when(hit & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status"))).drop("__hit")


def ended(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Running jobs with an outcome (succeeded or cancelled) have it as status, with the time it came."""
    last = outcomes.where(F.col("outcome").isin("succeeded", "cancelled")).groupBy("job_id").agg(F.max(F.struct("at", "outcome")).alias("__o"))
    hit = F.col("__o").isNotNull() & (F.col("status") == "running")
    return jobs.join(last, "job_id", "left").withColumn("finished_at", F.when(hit, F.col("__o.at"))).withColumn("status", F.when(hit, F.col("__o.outcome")).otherwise(F.col("status"))).drop("__o")


def enqueued(jobs: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """``wanted`` jobs (job_type, payload) without a queued or running one of the same type and value at a path of the payload."""
    key = lambda df: df.withColumn("__k", F.get_json_object("payload", path))
    live = key(jobs.where(F.col("status").isin("queued", "running"))).select("job_type", "__k").distinct()
    return key(wanted).dropDuplicates(["job_type", "__k"]).join(live, ["job_type", "__k"], "left_anti").drop("__k")


class Handlers:
    """Functions by job type; a type can be registered once."""

    def __init__(self):
        self._by_type: dict = {}

    def register(self, job_type: str):
        def add(f):
            if job_type in self._by_type:
                raise ValueError(f"{job_type!r} is registered already")
            self._by_type[job_type] = f
            return f

        return add

    def get(self, job_type: str):
        return self._by_type.get(job_type)

    def types(self) -> list[str]:
        return sorted(self._by_type)
