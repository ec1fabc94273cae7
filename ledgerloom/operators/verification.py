"""Which website is an organisation's own: pages of candidate hosts scored by the signs of identity they show; searches and newest rows."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text, web

# What each sign on a page is worth, which of them are strong, and the score from which a page is accepted.
SIGNS = {"name": 0.55, "identifier": 0.5, "exact_name": 0.2, "geography": 0.15, "email": 0.15}
STRONG = ("identifier", "exact_name", "geography")
ACCEPTED = 0.7
SECRETS = ("api_key", "password", "token", "secret", "authorization")
MAX_ORIGINS = 20


def verified(pages: DataFrame, organisations: DataFrame) -> DataFrame:
    """``(org_id, host, score, signs, accepted)`` of pages (org_id, host, text) against their organisations (org_id, name, names,
    identifiers, places): enough signs in all, one of them strong, as a common name alone may stand on anyone's page."""
    rows = pages.join(organisations, "org_id")
    folded = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    compact = text.identifier_key(F.col("text"))
    key, page = text.name_key(F.col("name")), text.name_key(F.col("text"))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    tidy = lambda v: F.regexp_replace(F.lower(F.trim(v)), r"\s+", " ")
    shows = {
        "name": (F.length(key) > 0) & page.contains(key), "identifier": F.exists(some(F.col("identifiers")), lambda i: (i != "") & compact.contains(text.identifier_key(i))),
        "exact_name": F.exists(some(F.col("names")), lambda n: (F.length(F.trim(n)) > 0) & folded.contains(tidy(n))),
        "geography": F.exists(some(F.col("places")), lambda p: (F.length(p) >= 3) & folded.contains(F.lower(p))),
        "email": F.exists(web.emails_in(F.col("text")), lambda e: text.bare_host(F.substring_index(e, "@", -1)) == F.col("host"))}
    hit = {k: F.coalesce(v, F.lit(False)) for k, v in shows.items()}
    score = F.round(F.least(F.lit(1.0), sum((F.when(h, SIGNS[k]).otherwise(0.0) for k, h in hit.items()), F.lit(0.0))), 3)
    strong = hit[STRONG[0]] | hit[STRONG[1]] | hit[STRONG[2]]
    return rows.select("org_id", "host", score.alias("score"), F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in hit.items()])).alias("signs"), ((score >= ACCEPTED) & strong).alias("accepted"))


def discovered(candidates: DataFrame, checked: DataFrame) -> DataFrame:
    """``(org_id, host, score)``: the first of each organisation's candidate hosts (org_id, host, rank) whose page is accepted."""
    good = candidates.join(checked.where("accepted"), ["org_id", "host"])
    return good.groupBy("org_id").agg(F.min_by(F.struct("host", "score"), F.struct("rank", "host")).alias("f")).select("org_id", "f.*")


def entity_search(organisations: DataFrame, identifiers: DataFrame, domains: DataFrame, query: str, merged: bool = False, most: int | None = None) -> DataFrame:
    """Organisations whose canonical or legal name, an identifier or a domain holds the query, whatever its case; by name. ``%`` and
    ``_`` are wildcards in names and domains."""
    live = organisations if merged else organisations.where("merged_into_id is null or trim(merged_into_id) = ''")
    by = identifiers.where(text.identifier_key(F.col("value")).ilike(f"%{query}%")).select("org_id").unionByName(
        domains.where(F.col("domain").ilike(f"%{query}%")).select("org_id")).distinct().withColumn("hit", F.lit(True))
    found = live.join(by, "org_id", "left").where(F.coalesce("hit", F.lit(False)) | F.col("canonical_name").ilike(f"%{query}%") | F.coalesce(F.col("legal_name").ilike(f"%{query}%"), F.lit(False)))
    rows = found.select("org_id", "canonical_name").distinct().orderBy("canonical_name", "org_id")
    return rows.limit(most) if most else rows


def observations_for(observations: DataFrame, entities: DataFrame, predicate: str | None = None) -> DataFrame:
    """Observations of some entities, all or one predicate, in order of time."""
    rows = observations.join(entities.select("org_id").distinct(), "org_id", "left_semi")
    rows = rows.where(F.col("predicate") == predicate) if predicate else rows
    return rows.orderBy("observed_at", "observation_id")


def newest(rows: DataFrame, time: str, tie: str, most: int) -> DataFrame:
    return rows.orderBy(F.desc(time), tie).limit(most)


def newest_of_each(rows: DataFrame, key: str, time: str, tie: str, most: int) -> DataFrame:
    """The newest rows of each key with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc(time), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def collection_scope_problems(scope: dict | None) -> list[str]:
    """Why a collection scope cannot stand: secrets in it, an endpoint that is no plain address, origins that are none or too many."""
    if scope is None:
        return []
    out = [f"secret {k}" for k in sorted({str(k).strip().lower() for k in scope} & {*SECRETS})]

    def plain(value: object) -> bool:
        parts = urlsplit(value.strip()) if isinstance(value, str) else None
        return bool(parts and parts.scheme in ("http", "https") and parts.hostname and not parts.username and not parts.password)

    if scope.get("endpoint_url") is not None and not plain(scope["endpoint_url"]):
        out.append("endpoint")
    origins = scope.get("allowed_origins", [])
    if not isinstance(origins, list) or len(origins) > MAX_ORIGINS:
        return [*out, "origins"]
    return out + [f"origin {o}" for o in origins if not plain(o) or urlsplit(o.strip()).path not in ("", "/") or urlsplit(o.strip()).query or urlsplit(o.strip()).fragment]


def state_counts(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """``(step, n)`` of rows that meet each step's condition, in one pass: what a dashboard shows."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in steps.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).alias("n")) for k in steps])).alias("s")).select("s.*")


def next_step(states: DataFrame) -> DataFrame:
    """The step to show first: the first that needs attention, else the first to do. ``states``: step, place, state."""
    return states.where(F.col("state").isin("attention", "todo")).orderBy(F.when(F.col("state") == "attention", 0).otherwise(1), "place").limit(1)
