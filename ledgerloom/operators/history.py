"""History of changing attributes: versions with their periods of validity, kept current by affected-chain rebuild.

A *statement* says that an attribute of an entity had a value from some start. A *chain* is one entity's versions of one
attribute. ``HistoryStore`` keeps raw statements and chains in hash buckets of the entity; late or corrected statements
touch only the chains of their entities, whose raw statements are read again, rebuilt whole, and put in place of the old
ones, as a delta, by one atomic switch of the manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["entity_id", "attribute"]
STATEMENT = "entity_id string, attribute string, value string, folded string, start timestamp, observed_at timestamp, tie string"


def fold_value(value):
    """Spelling aside: case, surrounding and repeated blanks, and the forms of a range of numbers."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")
    return F.regexp_replace(text, r"(?<=\d)\s*(?:–|—|-|to)\s*(?=\d)", "-")


def fold_identifier(value):
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def _current(statements: DataFrame) -> DataFrame:
    """One statement per start: the latest observed, then the greatest tie. Map-side combined."""
    return statements.where("entity_id is not null and attribute is not null and start is not null").groupBy(*KEY, "start").agg(
        F.max(F.struct("observed_at", "tie", "folded", "value")).alias("s")).select(*KEY, "start", "s.folded", "s.value")


def chains(statements: DataFrame, hot: int = 200_000, slices: int = 64) -> DataFrame:
    """Versions ``(entity_id, attribute, version_no, value, valid_from, valid_to)`` of every chain.

    In order of start, neighbours with the same folded value are one version; valid_to is the next version's start, null
    for the last. Rows lacking entity, attribute or start do not count; a null value is a value of its own. Chains of
    more than ``hot`` statements are cut into time slices whose borders are joined up in a second step, so that no
    task holds such a chain; the result is the same.
    """
    now = _current(statements)
    heavy = statements.groupBy(*KEY).count().where(F.col("count") > hot)
    if not heavy.limit(1).count():
        return _versions(now, KEY)
    keys = heavy.select(*KEY)
    return _versions(now.join(keys, KEY, "left_anti"), KEY).unionByName(_sliced(now.join(keys, KEY, "left_semi"), slices))


def _versions(now: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("start")
    fresh = now.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("folded").over(w)).where(
        (F.col("n") == 1) | ~F.col("folded").eqNullSafe(F.col("before")))
    return fresh.select(*key, F.row_number().over(w).alias("version_no"), "value", F.col("start").alias("valid_from"),
                        F.lead("start").over(w).alias("valid_to"))


def _sliced(now: DataFrame, slices: int) -> DataFrame:
    span = now.groupBy(*KEY).agg(F.min(F.unix_micros("start")).alias("lo"), F.max(F.unix_micros("start")).alias("hi"))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / slices), F.lit(1))
    cut = now.join(span, KEY).withColumn("slice", F.floor((F.unix_micros("start") - F.col("lo")) / width).cast("int"))
    inner = [*KEY, "slice"]
    w = Window.partitionBy(*inner).orderBy("start")
    marked = cut.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("folded").over(w))
    ends = cut.groupBy(*inner).agg(F.max_by("folded", "start").alias("last"))
    over = Window.partitionBy(*KEY).orderBy("slice")
    edge = ends.select(*inner, F.lag("last").over(over).alias("carried"), F.row_number().over(over).alias("slice_no"))
    fresh = marked.join(edge, inner).where(F.when(F.col("n") > 1, ~F.col("folded").eqNullSafe(F.col("before"))).otherwise(
        (F.col("slice_no") == 1) | ~F.col("folded").eqNullSafe(F.col("carried"))))
    local = fresh.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("start").over(w))
    head = fresh.groupBy(*inner).agg(F.count("*").alias("c"), F.min("start").alias("first"))
    before = head.select(
        *inner, F.coalesce(F.sum("c").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.lead("first").over(over).alias("following"))
    return local.join(before, inner).select(
        *KEY, (F.col("k") + F.col("offset")).cast("int").alias("version_no"), "value", F.col("start").alias("valid_from"),
        F.coalesce("next", "following").alias("valid_to"))


class StaleManifest(RuntimeError):
    """Another writer has switched the manifest since it was read; its statements are in force, these are not."""


class HistoryStore:
    """Raw statements and chains in a shared folder, in hash buckets of the entity.

    The manifest lists the folders in force. An update writes the raw statements it brings and, as a delta, the rebuilt
    chains of the entities it touches with a list of their keys; reading takes of each chain the rows of the last delta that
    lists it. Deltas are folded into a new base when there are more than ``max_deltas``. Manifests are numbered, and the next
    number is taken by creating its file, which only one writer can do: a reader sees the chains before or after an update,
    never between, a job that fails leaves the old state, and of two writers one gets ``StaleManifest`` and may try again.
    Folders that are out of force stay until ``vacuum``, so frames read before an update can still be computed.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, bucket_rows: int = 1_000_000, max_deltas: int = 8):
        """``buckets``: their number, else set by the first load so that one holds about ``bucket_rows`` statements."""
        self.spark, self.folder, self.buckets, self.bucket_rows, self.max_deltas = spark, folder.rstrip("/"), buckets, bucket_rows, max_deltas
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(x.getPath().getName()[:-5]) for x in self._fs.listStatus(at) if x.getPath().getName()[:-5].isdigit())

    def _manifest(self) -> dict:
        """``base`` and ``deltas``: folders of chains, oldest first; ``raw``: folders of statements with the buckets each holds."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "buckets": self.buckets, "raw": {}, "base": None, "deltas": []}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{numbers[-1]:020d}.json", wholetext=True).first()[0])

    def _switch(self, manifest: dict) -> None:
        """Written aside first, then renamed to its number, which fails if that is taken."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        aside, final = self._path(f"{self.folder}/manifest-{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/{manifest['version']:020d}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), hadoop)
        try:
            context.rename(aside, final, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:  # noqa: BLE001
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise StaleManifest(f"version {manifest['version']} was written by another") from e
            raise

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, what: str, buckets: int) -> str:
        """Buckets are rebalanced first: few files for small ones, and a bucket with a hot entity is split over tasks."""
        path = f"{self.folder}/{what}-{uuid.uuid4().hex}"
        df.withColumn("bucket", self._bucket(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").option(
            "compression", "zstd").parquet(path)
        return path

    RAW = STATEMENT + ", bucket int"
    CHAIN = "entity_id string, attribute string, version_no int, value string, valid_from timestamp, valid_to timestamp, bucket int"
    TOUCHED = "entity_id string, attribute string, bucket int"

    def _read(self, paths: list[str], schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all folders; an empty folder has no files but is no error."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = None
        for p in paths:
            df = self.spark.read.schema(schema).parquet(p)
            out = df if out is None else out.unionByName(df)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def raw(self) -> DataFrame:
        return self._read([*self._manifest()["raw"]], self.RAW)

    def _in_force(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """The chains of the base and of each delta that no later delta lists."""
        if m["base"] is None:
            return self.spark.createDataFrame([], self.CHAIN)
        layers = [(m["base"], None), *[(d["chains"], d["touched"]) for d in m["deltas"]]]
        out = None
        for i, (path, _) in enumerate(layers):
            rows = self._read([path], self.CHAIN, buckets)
            later = [t for _, t in layers[i + 1:]]
            if later:
                rows = rows.join(self._read(later, self.TOUCHED, buckets).select("bucket", *KEY).distinct(), ["bucket", *KEY], "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def history(self) -> DataFrame:
        return self._in_force(self._manifest()).drop("bucket")

    def append(self, statements: DataFrame) -> None:
        """Add statements and bring their chains up to date: all chains on the first call, later only those touched.

        Later calls read the raw statements of the touched buckets and write the touched chains only.
        """
        m = self._manifest()
        columns = [x.split()[0] for x in STATEMENT.split(", ")]
        new = statements.where("entity_id is not null and attribute is not null and start is not null").select(*columns)
        buckets = m["buckets"] or max(1, min(4096, -(-new.count() // self.bucket_rows)))
        added = self._write(new, "raw", buckets)
        fresh = self._read([added], self.RAW)
        held = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most the number of buckets
        raw = {**m["raw"], added: held}
        now = {"version": m["version"] + 1, "buckets": buckets, "raw": raw}
        if m["base"] is None:
            self._switch({**now, "base": self._write(chains(fresh.drop("bucket")), "chains", buckets), "deltas": []})
            return
        touched = fresh.select(*KEY).distinct()
        mine = [p for p, b in raw.items() if {*b} & {*held}]
        affected = self._read(mine, self.RAW, held).drop("bucket").join(touched, KEY, "left_semi")
        delta = {"chains": self._write(chains(affected), "chains", buckets), "touched": self._write(touched, "touched", buckets)}
        self._switch({**now, "base": m["base"], "deltas": [*m["deltas"], delta]})
        if len(m["deltas"]) + 1 > self.max_deltas:
            self.compact()

    def compact(self) -> None:
        """Fold the deltas into a new base, and the raw folders into one."""
        m = self._manifest()
        if m["deltas"]:
            raw = self._write(self._read([*m["raw"]], self.RAW).drop("bucket"), "raw", m["buckets"])
            held = sorted({b for x in m["raw"].values() for b in x})
            self._switch({**m, "version": m["version"] + 1, "raw": {raw: held}, "base": self._write(self._in_force(m).drop("bucket"), "chains", m["buckets"]), "deltas": []})

    def vacuum(self) -> None:
        """Delete what is out of force: only when no frame read before, and no writer, is at work."""
        m, numbers = self._manifest(), self._numbers()
        keep = {*m["raw"], m["base"], *[p for d in m["deltas"] for p in d.values()]}
        for x in self._fs.listStatus(self._path(self.folder)):
            name = x.getPath().getName()
            if name != "manifests" and f"{self.folder}/{name}" not in keep:
                self._fs.delete(x.getPath(), True)
        for n in numbers[:-1]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{n:020d}.json"), False)


def snapshot_statements(snapshots: DataFrame, entity: str, taken_at: str, attributes: list[str]) -> DataFrame:
    """Statements from periodic snapshots: each attribute of each snapshot row holds from the time it was taken."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]))
    rows = snapshots.select(F.col(entity).cast("string").alias("entity_id"), F.col(taken_at).alias("start"), pairs.alias("p"))
    return rows.select("entity_id", "p.attribute", "p.value", fold_value(F.col("p.value")).alias("folded"), "start",
                       F.col("start").alias("observed_at"), F.col("p.value").alias("tie"))
