"""What is made from received content: versioned artefacts, processing runs, manual evidence, packs on disk, and an audit log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.pages import distillable
from ledgerloom.functions.web import page_text

VERSION_KEY = 12


def config_hash(config: dict) -> str:
    """SHA-256 of a configuration as JSON with sorted keys: equal settings have one hash, whatever their order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def version_key(version: str, config: dict | None = None) -> str:
    """Key of a pipeline version with its configuration, as it stands in the store's folders."""
    return hashlib.sha256(f"{version}|{config_hash(config or {})}".encode()).hexdigest()[:VERSION_KEY]


def write_artefacts(rows: DataFrame, folder: str, version: str, config: dict | None = None) -> None:
    """Store ``rows`` (content_hash and what was made from it) under their version, in partitions by version and hash. Writing a
    partition again replaces it whole and leaves the others, so a job that is run twice changes nothing."""
    keyed = rows.withColumn("version", F.lit(version_key(version, config))).withColumn("shard", F.substring("content_hash", 1, 2))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("version", "shard").parquet(folder)


def read_artefacts(spark: SparkSession, folder: str, version: str, config: dict | None = None, hashes: Iterable[str] | None = None, column: str = "text", most: int | None = None) -> DataFrame:
    """Artefacts of a version, of all or some hashes; those longer than ``most`` bytes come with a null ``column`` and ``too_large``."""
    rows = spark.read.parquet(folder).where(F.col("version") == version_key(version, config))
    if hashes is not None:
        wanted = list(hashes)
        rows = rows.where(F.col("shard").isin(sorted({h[:2] for h in wanted})) & F.col("content_hash").isin(wanted))
    large = F.octet_length(column) > most if most is not None else F.lit(False)
    return rows.withColumn("too_large", F.coalesce(large, F.lit(False))).withColumn(column, F.when(~F.col("too_large"), F.col(column)))


def stored(hashes: DataFrame, contents: DataFrame) -> DataFrame:
    """``hashes`` with whether the store has their content."""
    have = contents.select("content_hash", F.lit(True).alias("exists")).distinct()
    return hashes.join(have, "content_hash", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def distilled(documents: DataFrame) -> DataFrame:
    """``(content_hash, text)``: readable text of each distinct document (content_hash, content_type, body) of a type that has any; pages lose
    their boilerplate, other text its runs of blanks."""
    one = documents.where(distillable(F.col("content_type"))).groupBy("content_hash").agg(F.min(F.struct("content_type", "body")).alias("d")).select("content_hash", "d.*")
    page = F.col("content_type").rlike("(?i)html")
    pages = one.where(page).select("content_hash", page_text("body").alias("text"))
    return pages.unionByName(one.where(~page).select("content_hash", F.trim(F.regexp_replace("body", r"\s+", " ")).alias("text")))


def new_runs(documents: DataFrame, runs: DataFrame, version: str, config: dict) -> DataFrame:
    """``(document_id, pipeline_version, config_hash)`` still to be run; a run is known by all three."""
    key = ["document_id", "pipeline_version", "config_hash"]
    wanted = documents.select("document_id", F.lit(version).alias("pipeline_version"), F.lit(config_hash(config)).alias("config_hash")).distinct()
    return wanted.join(runs.select(*key), key, "left_anti")


def manual_evidence(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files handed in by people (source_id, filename, content) that their source does not have yet, with hash and address; of
    equal files of a source the first by name."""
    keyed = files.withColumn("content_hash", F.sha2("content", 256)).groupBy("source_id", "content_hash").agg(F.min(F.struct("filename", "content")).alias("f"))
    fresh = keyed.join(known.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
    return fresh.select("source_id", "content_hash", "f.*", F.concat(F.lit("manual://"), "content_hash", F.lit("/"), "f.filename").alias("url"))


def safe_metadata(metadata: Column, entries: int = 50, chars: int = 500) -> Column:
    """A map of strings with blank keys and values left out, values cut to ``chars``, and at most ``entries`` entries in order of
    their keys: what may be stored with a document."""
    pairs = F.filter(F.map_entries(metadata), lambda e: (F.length(F.trim(e["key"])) > 0) & (F.length(F.trim(e["value"])) > 0))
    cut = F.transform(F.slice(F.array_sort(pairs), 1, entries), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.left(F.trim(e["value"]), F.lit(chars)).alias("value")))
    return F.map_from_entries(F.filter(cut, lambda e, i: F.array_position(F.transform(cut, lambda x: x["key"]), e["key"]) == i + 1))


def packs_under(folder: str) -> list[Path]:
    """Folders of packs: those that hold a manifest, sorted."""
    root = Path(folder)
    return sorted({p.parent for name in ("manifest.json", "manifest.yaml") for p in root.glob(f"*/{name}")}) if root.is_dir() else []


def pack_hash(folder: str | Path) -> str:
    """SHA-256 over the relative paths and bytes of a pack's files in order: the same pack has the same hash anywhere."""
    root, out = Path(folder), hashlib.sha256()
    for file in sorted(p for p in root.rglob("*") if p.is_file()):
        out.update(str(file.relative_to(root).as_posix()).encode() + b"\0" + file.read_bytes() + b"\0")
    return out.hexdigest()


def record_audit(rows: DataFrame, folder: str) -> None:
    """Append actions (at, actor, action, subject_type, subject_id, detail map) to the log; it is only ever added to."""
    rows.select("at", "actor", "action", "subject_type", "subject_id", F.to_json("detail").alias("detail"), F.to_date("at").alias("day")).write.mode("append").option(
        "compression", "zstd").partitionBy("day").parquet(folder)
