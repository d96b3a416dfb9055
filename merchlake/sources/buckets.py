"""Keyed state in buckets of files, published by a manifest.

The rows of a table lie in buckets by a hash of their key. A batch reads and rewrites only the buckets that
its keys fall on; all others stay the files of earlier versions. The manifest of a version names the files of
every bucket of every table and is one small file, written last: a reader resolves one manifest, so it sees
all tables of a batch or none of them, however many are written one after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "table string, bucket int, path string"


class BucketStore:
    """Tables below ``base``; ``schemas`` has the columns of each, among them the column ``key``.

    One writer at a time. A version that was not published leaves files that nothing refers to.
    """

    def __init__(self, spark: SparkSession, base: str, key: str, schemas: dict[str, str | StructType], buckets: int = 64):
        self.spark, self.base, self.key, self.schemas, self.buckets = spark, base.rstrip("/"), key, schemas, buckets

    # --- versions ---------------------------------------------------------------------------------

    def _children(self, path: str) -> list[str]:
        """Names in a folder, on whatever file system it lies; none if it is not there."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [status.getPath().getName() for status in system.listStatus(folder)] if system.exists(folder) else []

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        return max((int(name.partition("=")[2]) for name in self._children(f"{self.base}/manifest") if name.startswith("version=")), default=0)

    def _entries(self, version: int) -> list[tuple[str, int, str]]:
        if not version:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.base}/manifest/version={version}")
        return [tuple(row) for row in rows.collect()]  # one row for each table and bucket, and each appended piece

    # --- reading ----------------------------------------------------------------------------------

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def touched(self, *frames: DataFrame) -> list[int]:
        """The buckets that the keys of these frames fall on."""
        found: set[int] = set()
        for frame in frames:
            found.update(row[0] for row in frame.select(self.bucket()).distinct().collect())
        return sorted(found)

    def read(self, table: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """A table as of a version (default: the newest), only the given buckets of it."""
        wanted = None if buckets is None else set(buckets)
        entries = self._entries(self.version() if version is None else version)
        paths = [f"{self.base}/{path}" for name, bucket, path in entries if name == table and (wanted is None or bucket in wanted)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    # --- writing ----------------------------------------------------------------------------------

    def write(self, buckets: Iterable[int], replaced: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None) -> int:
        """Publish a version: new rows of the given buckets, and rows added to tables that only grow.

        ``replaced`` has all rows of these buckets; a bucket without rows is empty from then on. All other
        buckets stay. Appended tables need no key; their pieces have no bucket (-1).
        """
        before, buckets = self.version(), set(buckets)
        entries = [entry for entry in self._entries(before) if not (entry[0] in replaced and entry[1] in buckets)]
        attempt = f"data/{before + 1}-{uuid.uuid4().hex}"
        for table, rows in replaced.items():
            dealt = rows.select(*self.spark.createDataFrame([], self.schemas[table]).columns, self.bucket().alias("_bucket")).repartition("_bucket")
            dealt.write.partitionBy("_bucket").parquet(f"{self.base}/{attempt}/{table}")
            names = [name for name in self._children(f"{self.base}/{attempt}/{table}") if name.startswith("_bucket=")]
            entries += [(table, int(name.partition("=")[2]), f"{attempt}/{table}/{name}") for name in names]
        for table, rows in (appended or {}).items():
            rows.write.parquet(f"{self.base}/{attempt}/{table}")
            entries.append((table, -1, f"{attempt}/{table}"))
        manifest = self.spark.createDataFrame(entries, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.base}/manifest/version={before + 1}")
        return before + 1

    def tidy(self, keep: int = 2) -> None:
        """Delete manifests older than the newest ``keep`` versions, and files that none of those names."""
        newest = self.version()
        oldest = max(1, newest - keep + 1)
        used = {path.split("/")[1] for version in range(oldest, newest + 1) for _, _, path in self._entries(version)}
        stale = [f"manifest/{name}" for name in self._children(f"{self.base}/manifest") if name.startswith("version=") and int(name.partition("=")[2]) < oldest]
        stale += [f"data/{name}" for name in self._children(f"{self.base}/data") if name not in used]
        for name in stale:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
