"""Bulk imports: mappings, scope, rows matched to known organisations or making new ones, their observations and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import geography as geo
from ledgerloom.functions import text
from ledgerloom.session import salted_join


def match_imports(parsed: DataFrame, runs: DataFrame, organisations: DataFrame, identifiers: DataFrame, locations: DataFrame, scheme: str = "abn") -> DataFrame:
    """``(run_id, line_no, org_id, matched_by)`` of every loadable row: ``identifier`` where its identifier belongs to one
    organisation, else ``name_place`` where one organisation has that name key in that town, else ``new`` with null id.

    Keys that belong to several organisations are no evidence. The columns of identifier and town come from the mapping of
    the run, read with the JSON functions of the engine.
    """
    how = runs.select("run_id", "field_sep", "header_line", "mapping").dropDuplicates(["run_id"])
    # the separator is a literal: quote it for the pattern split
    header = F.split("header_line", F.concat(F.lit(r"\Q"), "field_sep", F.lit(r"\E")))
    at = lambda k: F.array_position(header, F.get_json_object("mapping", f"$.columns.{k}"))
    places_at = how.select("run_id", at("identifier").alias("i_at"), at("locality").alias("l_at"))
    value = lambda c: F.when(F.col(c) > 0, F.get("fields", (F.col(c) - 1).cast("int")))
    rows = parsed.where("reason is null").join(places_at, "run_id", "left").select(
        "run_id", "line_no", text.name_key(F.col("name")).alias("name_key"), F.nullif(text.identifier_key(value("i_at")), F.lit("")).alias("ident"),
        F.lower(F.trim(value("l_at"))).alias("town"))
    ids = identifiers.where(F.col("scheme") == scheme).groupBy(text.identifier_key(F.col("value")).alias("ident")).agg(
        F.min("org_id").alias("by_id"), F.max("org_id").alias("last")).where("by_id = last").select("ident", "by_id")
    where = locations.where("locality is not null").select("org_id", F.lower(F.trim("locality")).alias("town")).distinct()
    named = organisations.select("org_id", text.name_key(F.col("canonical_name")).alias("name_key")).distinct()
    places = named.join(where, "org_id").groupBy("name_key", "town").agg(F.min("org_id").alias("by_place"), F.max("org_id").alias("last")).where(
        "by_place = last").select("name_key", "town", "by_place")
    out = rows.join(ids, "ident", "left").join(places, ["name_key", "town"], "left")
    return out.select("run_id", "line_no", F.coalesce("by_id", "by_place").alias("org_id"), (
        F.when(F.col("by_id").isNotNull(), "identifier").when(F.col("by_place").isNotNull(), "name_place").otherwise("new")).alias("matched_by"))


# Fields a mapping may bind, and those that are claims.
MAPPABLE = (
    "name", "legal_name", "identifier", "identifier_scheme", "registration_status", "domain", "street_address", "locality", "region", "postcode", "country", "email", "phone",
    "employees_band", "service_claim", "archetype_claim", "source_record_url", "source_label", "pack_id", "facebook", "instagram", "linkedin", "youtube", "tiktok", "x_profile",
    "threads", "pinterest", "reddit", "social_profile")
CLAIM_FIELDS = ("service_claim", "archetype_claim")
BANDS = ("1-4", "5-19", "20-49", "50-199", "200+")
#: Rejected rows of a run that its report shows.
SAMPLES = 20


def mapping_problems(mapping: str) -> list[str]:
    """Why a mapping (JSON of columns and constants) cannot be used; empty if it can."""
    try:
        data = json.loads(mapping)
        columns, constants = data.get("columns") or {}, data.get("constants") or {}
    except (ValueError, AttributeError):
        return ["no mapping"]
    out = [f"unknown field {k}" for k in sorted({*columns, *constants} - {*MAPPABLE})]
    if "name" not in columns:
        out.append("name is not bound to a column")
    if {*CLAIM_FIELDS} & {*columns} and not str(constants.get("pack_id", "")).strip():
        out.append("claims need a pack")
    return out


def with_fields(parsed: DataFrame, runs: DataFrame, fields: Iterable[str]) -> DataFrame:
    """``parsed`` with a column ``f_…`` per field: the cell its run's mapping binds if it is filled, else the mapping's constant."""
    how = runs.select("run_id", "field_sep", "header_line", "mapping").where("run_id is not null").dropDuplicates(["run_id"])
    header = F.split("header_line", F.concat(F.lit(r"\Q"), "field_sep", F.lit(r"\E")))
    spots = [F.array_position(header, F.get_json_object("mapping", f"$.columns.{f}")).alias(f"at_{f}") for f in fields]
    fixed = [F.get_json_object("mapping", f"$.constants.{f}").alias(f"as_{f}") for f in fields]
    rows = salted_join(parsed, how.select("run_id", *spots, *fixed), "run_id")
    filled = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    cell = lambda f: F.when(F.col(f"at_{f}") > 0, F.get("fields", (F.col(f"at_{f}") - 1).cast("int")))
    out = rows.select(*[F.col(c) for c in parsed.columns], *[F.coalesce(filled(cell(f)), filled(F.col(f"as_{f}"))).alias(f"f_{f}") for f in fields])
    return out


def scope_outcome(place: Column, pack: Column, facets: dict[str, Column], include: Iterable[str], exclude: Iterable[str], industries: Iterable[str],
                  wanted: dict[str, dict[str, Iterable[str]]], unknown: bool) -> Column:
    """Whether a row is in a research scope: not in an excluded place, in an included one, of a wanted industry, and by each wanted
    facet neither excluded nor without an included value. What a row does not tell counts as ``unknown`` says."""
    codes = lambda x: F.array(*[F.lit(c) for c in x]).cast("array<string>")
    at = F.when(place.isNull(), F.array().cast("array<string>")).otherwise(F.array(place))
    barred = F.lit(False) if not list(exclude) else (F.size(at) > 0) & geo.matches(at, codes(exclude), "overlaps", False)
    ok = ~barred & (geo.matches(at, codes(include), "overlaps", unknown) if list(include) else F.lit(True))
    if industries := [i.strip().lower() for i in industries]:
        ok = ok & F.coalesce(F.lower(F.trim(pack)).isin(*industries), F.lit(unknown))
    for name, parts in wanted.items():
        have = facets.get(name)
        inc, exc = codes([v.lower() for v in parts.get("include", ())]), codes([v.lower() for v in parts.get("exclude", ())])
        if have is None:
            ok = ok & F.lit(unknown)
            continue
        low = F.transform(F.coalesce(have, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
        ok = ok & ~F.arrays_overlap(low, exc) & F.when(F.size(inc) == 0, True).when(F.size(low) == 0, F.lit(unknown)).otherwise(F.arrays_overlap(low, inc))
    return ok


def import_outcomes(rows: DataFrame, matched: DataFrame, in_scope: Column) -> DataFrame:
    """``rows`` (with ``f_…`` fields and reason) with outcome and org_id: rejected (no readable row or name), out_of_scope, matched, or
    imported, whose new org_id follows from its identifier, else from its name and place, so that a repeat makes the same one."""
    new = F.concat(F.lit("org-"), F.left(F.sha2(F.concat_ws("|", F.coalesce(text.identifier_key(F.col("f_identifier")), text.name_key(F.col("f_name"))), F.when(
        F.col("f_identifier").isNull(), F.lower(F.coalesce("f_locality", F.lit(""))))), 256), F.lit(12)))
    both = rows.join(matched.select("run_id", "line_no", F.col("org_id").alias("known_id")), ["run_id", "line_no"], "left")
    bad = F.col("reason").isin("broken_quoting", "column_count", "missing_name", "unknown_format") | F.col("f_name").isNull()
    outcome = F.when(bad, "rejected").when(~in_scope, "out_of_scope").when(F.col("known_id").isNotNull(), "matched").otherwise("imported")
    return both.withColumn("outcome", outcome).withColumn("org_id", F.when(F.col("outcome") == "matched", F.col("known_id")).when(F.col("outcome") == "imported", new)).drop("known_id")


def import_statements(rows: DataFrame) -> DataFrame:
    """``(run_id, line_no, org_id, predicate, value, confidence, normalisation_status)``: all typed observations of the rows that
    matched or made an organisation. Cells that are not valid stay, rejected and with no confidence."""
    cell = lambda p, c, sure, ok=None: F.struct(
        F.lit(p).alias("predicate"), F.col(c).alias("value"), F.when(F.lit(True) if ok is None else F.coalesce(ok, F.lit(False)), sure).otherwise(0.0).alias("confidence"))
    place = F.to_json(F.struct(*[F.col(f"f_{c}").alias(c) for c in ("street_address", "locality", "region", "postcode", "country")]))
    rows = rows.where("outcome in ('matched', 'imported')").withColumn("__place", F.when(place != "{}", place)).withColumn("f_email", F.lower("f_email")).withColumn(
        "f_registration_status", F.lower("f_registration_status"))
    cells = [cell("canonical_name", "f_name", 0.9), cell("legal_name", "f_legal_name", 0.9), cell("registration_identifier", "f_identifier", 0.9), cell("registration_status", "f_registration_status", 0.9),
             cell("website_domain", "f_domain", 0.9, text.bare_host(F.col("f_domain")).rlike(r"^[^\s.]+(\.[^\s.]+)+$")), cell("location", "__place", 0.85),
             cell("email", "f_email", 0.85, F.col("f_email").rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$")), cell("phone", "f_phone", 0.85, text.phone_tail(F.col("f_phone")).isNotNull()),
             cell("employee_count_band", "f_employees_band", 0.85, F.col("f_employees_band").isin(*BANDS))]
    return rows.select("run_id", "line_no", "org_id", F.explode(F.array(*cells)).alias("c")).where("c.value is not null").select(
        "run_id", "line_no", "org_id", "c.*", F.when(F.col("c.confidence") > 0, "normalised").otherwise("rejected").alias("normalisation_status"))


def import_report(outcomes: DataFrame) -> DataFrame:
    """``(run_id, rows, imported, matched, out_of_scope, rejected, samples)``; samples are the first ``SAMPLES`` rejected lines."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    counts = outcomes.groupBy("run_id").agg(F.count("*").alias("rows"), *[n(o) for o in ("imported", "matched", "out_of_scope", "rejected")])
    w = Window.partitionBy("run_id").orderBy("line_no")
    first = outcomes.where("outcome = 'rejected'").select("run_id", "line_no", F.coalesce("reason", F.lit("missing_name")).alias("reason")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLES)
    shown = first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "reason"))).alias("samples"))
    return counts.join(shown, "run_id", "left")


def repeated_runs(runs: DataFrame, records: DataFrame, version: str) -> DataFrame:
    """``(run_id, first_run_id)`` of runs to refuse: an earlier run had the same records, mapping and transformation version.

    The content of a run is told by the sum of the hashes of its distinct records, so no run is brought to one task."""
    content = records.select("run_id", "line_no", "raw_record").distinct().groupBy("run_id").agg(
        F.sum(F.xxhash64("line_no", "raw_record").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    keyed = runs.select("run_id", "mapping", "created_at").dropDuplicates(["run_id"]).join(content, "run_id").withColumn("version", F.lit(version))
    first = keyed.groupBy("mapping", "h", "n", "version").agg(F.min(F.struct("created_at", "run_id")).alias("f"))
    return keyed.join(first, ["mapping", "h", "n", "version"]).where(F.col("run_id") != F.col("f.run_id")).select("run_id", F.col("f.run_id").alias("first_run_id"))


def coverage_time(value: Column) -> Column:
    """A date or an ISO time as a timestamp; without a zone it is UTC. Null if it is neither."""
    v = F.regexp_replace(F.trim(value), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?!:)", "$1:00")  # the engine wants seconds before a zone
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(v, F.lit("T00:00:00+00:00")))).when(
        v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"),
        F.try_to_timestamp(F.when(v.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), v).otherwise(F.concat(v, F.lit("+00:00")))))
