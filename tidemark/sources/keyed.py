"""Tables in buckets of their key, changed by optimistic commits.

A table is a folder of bucket folders and numbered manifests. A manifest names the folders of every
bucket and the version it was made from; it is published by a rename that fails when the number
is taken. A writer that lost reads the newer version and makes its change again, so no rows are
lost; a change reads and rewrites only the buckets its keys fall into. Readers keep the version they
started with.

The number of buckets is fixed when the table is made and bounds what the driver holds of a table:
a manifest, and the numbers of the buckets a change touches. Renames must not replace files (true of HDFS and
local disks; an object store needs a commit service of its own). Folders of replaced versions are
deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.tables import UPDATE, filesystem, upsert

BUCKETS = 64
#: Folders of one bucket that appends may leave before the bucket is rewritten.
MOST_FOLDERS = 8


class Conflict(Exception):
    """Another writer published the version first."""


@dataclass
class Manifest:
    version: int
    parent: int
    keys: list[str]
    buckets: int
    schema: dict
    folders: dict[str, list[str]]
    #: Small facts that are kept with the rows, such as the highest sequence of a log.
    facts: dict = field(default_factory=dict)


class KeyedTable:
    """One row per key (or more, for logs that are only appended to)."""

    def __init__(self, spark: SparkSession, base: str, attempts: int = 20):
        self.spark, self.base, self.attempts = spark, base.rstrip("/"), attempts

    # --- versions

    @classmethod
    def create(cls, df: DataFrame, base: str, keys: list[str], buckets: int = BUCKETS, facts: dict | None = None):
        table = cls(df.sparkSession, base)
        empty = Manifest(0, -1, keys, buckets, df.schema.jsonValue(), {}, facts or {})
        table._publish(Manifest(**{**asdict(empty), "version": 1, "parent": 0, "folders": table._write(df, empty)}))
        return table

    def version(self) -> int:
        """Number of the newest version, 0 before the first."""
        path, fs = filesystem(self.spark, f"{self.base}/versions")
        if not fs.exists(path):
            return 0
        names = [entry.getPath().getName() for entry in fs.listStatus(path)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        number = version or self.version()
        rows = self.spark.read.text(f"{self.base}/versions/v{number:08d}.json", wholetext=True)
        return Manifest(**json.loads(rows.first()["value"]))

    def _publish(self, manifest: Manifest) -> None:
        """Make the version visible, or raise ``Conflict``."""
        target, fs = filesystem(self.spark, f"{self.base}/versions/v{manifest.version:08d}.json")
        staged, _ = filesystem(self.spark, f"{self.base}/versions/.staged-{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), fs.getConf())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, target, options)
        except Exception as error:
            fs.delete(staged, False)
            if "FileAlreadyExists" in str(error) or fs.exists(target):
                raise Conflict(f"version {manifest.version} of {self.base}") from error
            raise

    # --- rows

    def bucket(self, manifest: Manifest) -> Column:
        types = {f.name: f.dataType for f in StructType.fromJson(manifest.schema)}
        # The hash of a number depends on its type.
        keys = [F.col(k).cast(types[k]) for k in manifest.keys]
        return F.pmod(F.xxhash64(*keys), F.lit(manifest.buckets)).cast("int")

    def touched(self, rows: DataFrame, manifest: Manifest) -> list[int]:
        """Buckets that the keys of ``rows`` fall into."""
        return [r["b"] for r in rows.select(self.bucket(manifest).alias("b")).distinct().collect()]

    def read(self, manifest: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version; with ``buckets`` no other bucket's files are read."""
        manifest = manifest or self.manifest()
        wanted = manifest.folders if buckets is None else [str(b) for b in buckets if str(b) in manifest.folders]
        folders = [f"{self.base}/{folder}" for b in wanted for folder in manifest.folders[b]]
        schema = StructType.fromJson(manifest.schema)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, manifest: Manifest) -> dict[str, list[str]]:
        """Folders of the buckets of ``rows``, written to a new place."""
        place = f"data/{uuid.uuid4().hex}"
        columns = [f["name"] for f in manifest.schema["fields"]]
        spread = rows.select(*columns, self.bucket(manifest).alias("_bucket")).repartition("_bucket")
        spread.write.partitionBy("_bucket").parquet(f"{self.base}/{place}")
        path, fs = filesystem(self.spark, f"{self.base}/{place}")
        names = [entry.getPath().getName() for entry in fs.listStatus(path)]
        return {n.split("=")[1]: [f"{place}/{n}"] for n in names if n.startswith("_bucket=")}

    def change(
        self,
        rows: DataFrame,
        rewrite: Callable[[DataFrame, DataFrame], DataFrame],
        facts: dict | None = None,
        done: Callable[[dict], bool] | None = None,
    ) -> int:
        """Replace the buckets of ``rows`` by ``rewrite(their rows, rows)``; the new version's number.

        ``facts`` are kept with that version. Nothing happens where ``done`` holds for the facts of the version to
        be changed, also when another writer made that version meanwhile.
        """

        def once(now: Manifest) -> Manifest | None:
            if done and done(now.facts):
                return None
            mine = self.touched(rows, now)
            made = self._write(rewrite(self.read(now, mine), rows), now)
            kept = {b: f for b, f in now.folders.items() if int(b) not in mine}
            return Manifest(**{**asdict(now), "folders": kept | made, "facts": {**now.facts, **(facts or {})}})

        return self._commit(once)

    def upsert(self, updates: DataFrame, mode: str = UPDATE, order: str | None = None) -> int:
        keys = self.manifest().keys
        return self.change(updates, lambda old, new: upsert(old, new, keys, mode, order))

    def append(self, make: Callable[[Manifest], tuple[DataFrame, dict]]) -> int:
        """Add the rows and facts that ``make`` derives from a version.

        Buckets of more than ``MOST_FOLDERS`` folders are compacted on the way.
        """

        def once(now: Manifest) -> Manifest:
            rows, facts = make(now)
            folders = dict(now.folders)
            for bucket, added in self._write(rows, now).items():
                folders[bucket] = folders.get(bucket, []) + added
            return self._compacted(Manifest(**{**asdict(now), "folders": folders, "facts": {**now.facts, **facts}}))

        return self._commit(once)

    def _compacted(self, manifest: Manifest) -> Manifest:
        many = [int(b) for b, folders in manifest.folders.items() if len(folders) > MOST_FOLDERS]
        if not many:
            return manifest
        made = self._write(self.read(manifest, many), manifest)
        return Manifest(**{**asdict(manifest), "folders": manifest.folders | made})

    def _commit(self, once: Callable[[Manifest], Manifest | None]) -> int:
        for _ in range(self.attempts):
            now = self.manifest()
            made = once(now)
            if made is None:
                return now.version
            made.version, made.parent = now.version + 1, now.version
            try:
                self._publish(made)
                return made.version
            except Conflict:
                continue  # the change is made again from the version that won
        raise Conflict(f"{self.base} after {self.attempts} attempts")

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the last ``keep`` versions names; their number."""
        last = self.version()
        alive = {
            folder
            for v in range(max(1, last - keep + 1), last + 1)
            for folders in self.manifest(v).folders.values()
            for folder in folders
        }
        path, fs = filesystem(self.spark, f"{self.base}/data")
        gone = 0
        for place in fs.listStatus(path):
            for entry in fs.listStatus(place.getPath()):
                name = f"data/{place.getPath().getName()}/{entry.getPath().getName()}"
                if entry.getPath().getName().startswith("_bucket=") and name not in alive:
                    gone += fs.delete(entry.getPath(), True)
        return gone
