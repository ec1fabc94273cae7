"""Datasets as rows, and content-addressed storage of what was received."""

from __future__ import annotations

import csv
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_MEMBER_BYTES, MAX_RATIO = 2000, 100 << 20, 100.0
ROW_SCHEMA = "path string, row_number bigint, record map<string,string>, problem string"
ENDINGS = (".csv", ".json", ".jsonl")


def unpack(name: str, content: bytes) -> tuple[str, bytes] | str:
    """(member name, bytes) of a file, or of the one dataset in a ZIP; else why it is refused."""
    if not content.startswith(b"PK\x03\x04"):
        return name, content
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return "corrupt archive"
    members = [m for m in archive.infolist() if not m.is_dir()]
    if len(members) > MAX_ENTRIES:
        return "too many entries"
    data = [m for m in members if m.filename.lower().endswith(ENDINGS)]
    if len(data) != 1:
        return f"{len(data)} datasets in the archive"
    m = data[0]
    if m.flag_bits & 1:
        return "encrypted archive"
    if m.file_size > MAX_MEMBER_BYTES or m.file_size > MAX_RATIO * max(m.compress_size, 1):
        return "archive member too large"
    if m.filename.startswith("/") or ".." in m.filename.split("/"):
        return "unsafe path in the archive"
    return m.filename, archive.read(m)


def dataset_rows(name: str, content: bytes) -> list[tuple[int, dict | None, str | None]]:
    """(row number, record, problem). CSV rows count from 2, as the header is 1; JSON and JSON lines from 1."""
    got = unpack(name, content)
    if isinstance(got, str):
        return [(0, None, got)]
    name, content = got
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return [(0, None, "not UTF-8")]
    as_text = lambda r: {str(k): None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in r.items() if k is not None}
    if name.lower().endswith(".jsonl"):
        out = []
        for n, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    row = json.loads(line)
                    out.append((n, as_text(row), None) if isinstance(row, dict) else (n, None, "not an object"))
                except ValueError:
                    out.append((n, None, "invalid JSON"))
        return out
    if name.lower().endswith(".json"):
        try:
            data = json.loads(text)
        except ValueError:
            return [(0, None, "invalid JSON")]
        rows = data.get("records", [data]) if isinstance(data, dict) else data
        return [(n, as_text(r), None) if isinstance(r, dict) else (n, None, "not an object") for n, r in enumerate(rows, 1)]
    return [(n, as_text(r), None) for n, r in enumerate(csv.DictReader(io.StringIO(text)), 2)]


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the CSV, JSON, JSON lines and one-dataset ZIP files under a path, one task per file.

    Files that cannot be read give one row with row number 0 and the problem. For single huge CSV or JSON lines files use
    ``spark.read``, which splits them; this reader keeps row numbers and problems.
    """
    def rows(frames):
        for df in frames:
            out = [(p, *r) for p, c in zip(df["path"], df["content"]) for r in dataset_rows(p.split("?")[0], bytes(c))]
            yield pd.DataFrame(out, columns=["path", "row_number", "record", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, ROW_SCHEMA)


def content_address(content) -> F.Column:
    """SHA-256 of the original bytes."""
    return F.sha2(content, 256)


def store_content(new: DataFrame, folder: str) -> int:
    """Append documents (``source_id``, ``url``, ``content``) whose (source, url, hash) the store lacks; returns how many.

    Partitioned by the first hex digits of the hash, so a lookup by hash reads one partition. The store is append-only;
    storing the same rows again changes nothing.
    """
    spark = new.sparkSession
    keyed = new.withColumn("content_hash", content_address(F.col("content"))).withColumn("shard", F.substring("content_hash", 1, 2)).dropDuplicates(["source_id", "url", "content_hash"])
    try:
        shards = [r[0] for r in keyed.select("shard").distinct().collect()]  # at most 256
        have = spark.read.parquet(folder).where(F.col("shard").isin(shards)).select("source_id", "url", "content_hash")
        keyed = keyed.join(have, ["source_id", "url", "content_hash"], "left_anti")
    except Exception as e:  # an empty store has no files yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    seen = Observation()
    keyed.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("shard").option("compression", "zstd").parquet(folder)
    return seen.get["n"]


def load_content(spark: SparkSession, folder: str, content_hash: str) -> DataFrame:
    return spark.read.parquet(folder).where((F.col("shard") == content_hash[:2]) & (F.col("content_hash") == content_hash))


def load_vocabulary(paths: list[str]) -> dict[str, list[str]]:
    """Vocabulary files (JSON, or YAML where a parser is installed): id to written variants; all problems are reported."""
    out: dict[str, list[str]] = {}
    problems = []
    for path in sorted(paths):
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError:
                    problems.append(f"{path}: no YAML parser")
                    continue
                data = yaml.safe_load(f)
            else:
                data = json.load(f)
        for entry in data if isinstance(data, list) else []:
            if not entry.get("id") or entry["id"] in out:
                problems.append(f"{path}: missing or repeated id {entry.get('id')!r}")
            else:
                out[entry["id"]] = [entry.get("label", entry["id"]), *entry.get("synonyms", [])]
    if problems:
        raise ValueError("; ".join(problems))
    return out
