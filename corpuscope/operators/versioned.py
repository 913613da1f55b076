"""A keyed table that rewrites only what changes: base and delta files by bucket, a manifest per version, merge on read.

A version is one small file that lists the folders of every bucket. It appears at once, so a reader sees a version whole
or not at all, and one that holds a version goes on reading its files whatever is written meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("batch", T.LongType())])
#: The row of a manifest that names no files, but the last batch that was taken in.
_MARK = -1


class VersionedTable:
    """Rows of ``schema`` by ``key``, of which the one with the greatest ``order`` is valid; of equal ones the later written.

    One writer at a time; any number of readers. Keys are dealt to ``buckets`` by hash, so a batch touches no more buckets than it
    has keys. Null keys share a row.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, order: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.schema, self.key, self.order, self.buckets = spark, folder.rstrip("/"), schema, key, order, buckets

    # --- versions -------------------------------------------------------------------------------------------------------------

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(T.StructType([*_MANIFEST.fields, T.StructField("version", T.LongType())])).parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def versions(self) -> list[int]:
        """The finished versions, in order; each has one mark."""
        found = self._manifests()
        return [] if found is None else sorted(r["version"] for r in found.where(F.col("bucket") == _MARK).select("version").collect())

    def version(self) -> int:
        """The last finished version; 0 before the first."""
        return max(self.versions(), default=0)

    def entries(self, version: int | None = None) -> list[T.Row]:
        """The manifest of a version: a row per bucket and folder, oldest first, and the mark."""
        version = self.version() if version is None else version
        found = self._manifests()
        if found is None or not version:
            return []
        rows = found.where(F.col("version") == version).drop("version").orderBy("bucket", "seq").collect()
        if not rows:
            raise ValueError(f"there is no version {version}")
        return rows

    def _commit(self, version: int, rows: list[tuple]) -> int:
        # one file, moved to its place when it is complete
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        return version

    # --- writing ----------------------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, seq: int) -> list[tuple[int, str]]:
        """Write rows by bucket to a folder of their own; the buckets that got files."""
        path = f"{self.folder}/data/{seq}-{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket()).repartition("__bucket").sortWithinPartitions("__bucket", self.key).write.partitionBy("__bucket").parquet(path)
        try:
            held = [r[0] for r in self.spark.read.parquet(path).select("__bucket").distinct().collect()]
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            held = []
        return [(b, f"{path}/__bucket={b}") for b in sorted(held)]

    def upsert(self, changes: DataFrame, batch: int) -> int:
        """Take in a batch and return the table's version. A batch whose number is not above the last one's is a replay: nothing happens."""
        now = self.version()
        before = [tuple(r) for r in self.entries(now)]
        if any(b == _MARK and batch <= last for b, _, _, last in before):
            return now
        seq = now + 1
        latest = _latest(changes.select(*self.schema.names).withColumn("__seq", F.lit(seq).cast("long")), self.key, self.order)
        touched = self._write(latest, seq)
        rows = [r for r in before if r[0] != _MARK] + [(b, seq, path, batch) for b, path in touched]
        return self._commit(seq, [*rows, (_MARK, seq, "", batch)])

    def compact(self, most_deltas: int = 4) -> int:
        """Merge the files of the buckets that have more than ``most_deltas`` folders besides their first; the others stay as they are."""
        now = self.version()
        before = [tuple(r) for r in self.entries(now)]
        folders: dict[int, list[str]] = {}
        for b, _, path, _ in before:
            if b != _MARK:
                folders.setdefault(b, []).append(path)
        full = {b for b, paths in folders.items() if len(paths) > most_deltas + 1}
        if not full:
            return now
        merged = _latest(self._files([p for b in full for p in folders[b]]), self.key, self.order)
        seq = now + 1
        base = self._write(merged, seq)
        last = next(batch for b, _, _, batch in before if b == _MARK)
        rows = [r for r in before if r[0] not in full and r[0] != _MARK] + [(b, seq, path, last) for b, path in base]
        return self._commit(seq, [*rows, (_MARK, seq, "", last)])

    def vacuum(self, keep: int = 2) -> None:
        """Delete the manifests of all but the last ``keep`` versions, and the folders that only they list. Readers of those fail from then on."""
        gone = self.versions()[:-keep] if keep > 0 else []
        if not gone:
            return
        found = self._manifests().where(F.col("bucket") != _MARK).select("path", F.col("version").isin(gone).alias("old"))
        unused = [r["path"] for r in found.groupBy("path").agg(F.min("old").alias("old")).where("old").collect()]
        jvm = self.spark._jvm  # Spark has no call of its own that deletes files
        for path in [*unused, *[f"{self.folder}/manifest/version={v}" for v in gone]]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    # --- reading ----------------------------------------------------------------------------------------------------------------

    def _files(self, paths: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("__seq", T.LongType())])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given. Buckets without deltas are read as they are; only others are merged."""
        folders: dict[int, list[str]] = {}
        for b, _, path, _ in self.entries(version):
            if b != _MARK and (buckets is None or b in buckets):
                folders.setdefault(b, []).append(path)
        alone = self._files([p[0] for p in folders.values() if len(p) == 1])
        merged = _latest(self._files([p for paths in folders.values() if len(paths) > 1 for p in paths]), self.key, self.order)
        return alone.unionByName(merged).select(*self.schema.names)

    def lookup(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of ``keys``, from the files of their buckets alone."""
        asked = keys.select(self.key).distinct()
        held = {r[0] for r in asked.select(self._bucket()).distinct().collect()}  # at most ``buckets`` numbers
        return self.read(version, held).join(asked, self.key, "left_semi")


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the greatest by order, then by the batch that brought it, then by its values."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, "__seq", F.xxhash64(*rest))).alias("__r"))
    return picked.select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns])
