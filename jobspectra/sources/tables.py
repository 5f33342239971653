"""Stored tables: versioned files under a manifest, and layouts that prune.

A write never touches files that are there: it puts new ones under ``version=<id>`` and
notes in the manifest which version holds which partition. A manifest is one small JSON
file, numbered; the highest number is the state of *all* tables. ``transaction`` collects
the writes of a run and puts its manifest in place by one rename at the end, so a run that
breaks off anywhere leaves the state before it, and readers see one state at any moment.
``vacuum`` removes versions that recent manifests do not name.

Tables with a growing number of keys are spread over buckets by linear hashing: the
number of buckets follows the number of rows, one bucket is split at a time, so a small
batch rewrites a few buckets however large the table has become.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.schema import POSTING, REJECT, RUN, SNAPSHOT, TERM
from jobspectra.session import materialize

EMPLOYER = T.StructType([
    T.StructField("employer_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType())])
SKILL = T.StructType([
    T.StructField("skill", T.StringType()), T.StructField("display_name", T.StringType())])
BLOCKED = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("run_id", T.StringType())])
PLACE = T.StructType([T.StructField("posting_id", T.LongType()), T.StructField("month", T.DateType())])

MONTH = "coalesce(trunc(published_at, 'month'), date'1970-01-01')"
# table -> (schema, partition column, expression giving the partition)
LAYOUT = {
    "postings": (POSTING, "pub_month", MONTH),
    "posting_months": (PLACE, "bucket", None),
    "employers": (EMPLOYER, "bucket", None),
    "skills": (SKILL, None, None),
    "relevance_terms": (TERM, None, None),
    "filtered_postings": (REJECT, "run_key", "run_id"),
    "blocked_pages": (BLOCKED, "run_key", "run_id"),
    "ingestion_runs": (RUN, "run_key", "run_id"),
    "snapshots": (SNAPSHOT, "metric_key", "metric_type"),
}
# Hashed tables: key, and the rows a bucket holds on average before one more is opened.
HASHED = {"posting_months": ("posting_id", 200_000), "employers": ("employer_id", 10_000)}
_KIND = {"pub_month": T.DateType(), "bucket": T.IntegerType()}
_WHOLE = ""


def bucket_of(key: str, buckets: int) -> Column:
    """Linear hashing: of the buckets of the next power of two, those not opened yet fold back."""
    top = 1 << (buckets - 1).bit_length()
    wide = F.pmod(F.xxhash64(key), F.lit(top))
    return F.when(wide < buckets, wide).otherwise(wide - top // 2).cast("int")


def fold(bucket: int, buckets: int) -> int:
    """Where the rows of a bucket were when there were fewer buckets."""
    top = 1 << (buckets - 1).bit_length()
    wide = bucket % top
    return wide if wide < buckets else wide - top // 2


class Store:
    """A folder of parquet tables on storage every executor can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._pending: dict | None = None

    # --- manifests ---------------------------------------------------------------------

    def _file(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder, fs = self._file("_manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _load(self, number: int) -> dict:
        path, _ = self._file("_manifests", f"{number:012d}.json")
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def manifest(self) -> dict:
        """What a reader sees now; inside a transaction also its own writes."""
        if self._pending is not None:
            return self._pending
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {"number": 0, "tables": {}, "rows": {}, "buckets": {}}

    def _commit(self, state: dict) -> None:
        number = state["number"] + 1
        target, fs = self._file("_manifests", f"{number:012d}.json")
        draft, _ = self._file("_manifests", f".{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state | {"number": number}).encode()))
        out.close()
        # The one step that changes what readers see. A number that is taken means another writer was first.
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"state {number} of {self.root} was written by another run")

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """All writes inside become visible together at its end, or none of them."""
        if self._pending is not None:
            yield  # part of the outer one
            return
        self._pending = self.manifest()
        try:
            yield
            self._commit(self._pending)
        finally:
            self._pending = None

    def vacuum(self, keep: int = 2) -> None:
        """Delete files that none of the last ``keep`` states names, and older manifests. No run may be writing."""
        numbers = self._numbers()
        used = {(t, v) for n in numbers[-keep:] for t, parts in self._load(n)["tables"].items() for held in parts.values() for v in held}
        for table in LAYOUT:
            folder, fs = self._file(table)
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if (table, status.getPath().getName().partition("=")[2]) not in used:
                    fs.delete(status.getPath(), True)
        for n in numbers[:-keep]:
            path, fs = self._file("_manifests", f"{n:012d}.json")
            fs.delete(path, False)

    # --- reading -----------------------------------------------------------------------

    def scan(self, table: str, values: Sequence | None = None) -> DataFrame:
        """The table, or only the partitions of some values; the partition column comes along."""
        schema, key, _ = LAYOUT[table]
        held = self.manifest()["tables"].get(table, {})
        if values is not None:
            wanted = {f"{key}={self._escaped(v)}" for v in values}
            held = {p: v for p, v in held.items() if p in wanted}
        stored = T.StructType([*schema.fields, *([T.StructField(key, _KIND.get(key, T.StringType()))] if key else [])])
        paths = [f"{self.root}/{table}/version={v}/{part}".rstrip("/") for part, versions in held.items() for v in versions]
        if not paths:
            return self.spark.createDataFrame([], stored)
        with_version = T.StructType([*stored.fields, T.StructField("version", T.StringType())])
        return self.spark.read.schema(with_version).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*stored.names)

    def read(self, table: str) -> DataFrame:
        return self.scan(table).select(*LAYOUT[table][0].names)

    def _escaped(self, value) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))

    # --- writing -----------------------------------------------------------------------

    def append(self, table: str, rows: DataFrame) -> None:
        with self.transaction():
            version, parts = self._write(table, rows)
            held = self._pending["tables"].setdefault(table, {})
            for part in parts:
                held.setdefault(part, []).append(version)

    def replace_partitions(self, table: str, rows: DataFrame) -> None:
        """Puts ``rows`` in place of exactly the partitions that they fall in."""
        with self.transaction():
            version, parts = self._write(table, rows)
            self._pending["tables"].setdefault(table, {}).update({part: [version] for part in parts})

    def drop_partition(self, table: str, value: str) -> None:
        """Removes one partition, if it is there."""
        with self.transaction():
            self._pending["tables"].get(table, {}).pop(f"{LAYOUT[table][1]}={self._escaped(value)}", None)

    def lookup(self, table: str, ids: DataFrame) -> DataFrame:
        """The rows of a hashed table with some of these keys; only the buckets that may hold them are read."""
        key = HASHED[table][0]
        hit = ids.select(bucket_of(key, self.manifest()["buckets"].get(table, 1))).distinct().collect()  # a row per bucket at most
        return self.scan(table, [r[0] for r in hit]).select(*LAYOUT[table][0].names).join(ids.select(key), key, "left_semi")

    def upsert(self, table: str, batch: DataFrame) -> None:
        """Rows of a hashed table replaced or added by key; ``batch`` has each key once.

        Only the buckets of the batch and those that are due to be split are read and written.
        """
        schema, key, _ = LAYOUT[table]
        id_col, each = HASHED[table]
        batch = materialize(batch.select(*schema.names))
        with self.transaction():
            state = self._pending
            old, rows = state["buckets"].get(table, 1), state["rows"].get(table, 0)
            hit = {r[0]: r[1] for r in batch.groupBy(bucket_of(id_col, old)).count().collect()}
            if not hit:
                return
            new = max(old, -(-(rows + sum(hit.values())) // each))
            touched = sorted(set(hit) | {fold(b, old) for b in range(old, new)})
            kept = self.scan(table, touched).select(*schema.names)
            fresh = kept.join(batch.select(id_col), id_col, "left_anti").unionByName(batch)
            seen, before = Observation(), kept.count()
            version, parts = self._write(table, fresh.withColumn(key, bucket_of(id_col, new)).observe(seen, F.count("*").alias("n")))
            held = state["tables"].setdefault(table, {})
            for bucket in touched:
                held.pop(f"{key}={bucket}", None)
            held.update({part: [version] for part in parts})
            state["buckets"][table], state["rows"][table] = new, rows + seen.get["n"] - before

    def _write(self, table: str, rows: DataFrame) -> tuple[str, list[str]]:
        """New files of a new version, and the partitions that they make up."""
        schema, key, rule = LAYOUT[table]
        version = uuid.uuid4().hex
        path = f"{self.root}/{table}/version={version}"
        plain = rows.select(*schema.names, *([key] if rule is None and key else []))
        if key is None:
            plain.write.parquet(path)
            return version, [_WHOLE]
        keyed = plain.withColumn(key, F.expr(rule)) if rule else plain
        # AQE splits a partition value that holds more than its share into several tasks.
        keyed.hint("rebalance", key).write.partitionBy(key).parquet(path)
        folder, fs = self._file(table, f"version={version}")
        names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        return version, sorted(n for n in names if n.startswith(f"{key}="))
