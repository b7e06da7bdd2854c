"""A stored table whose rows are replaced by key: hash buckets, one manifest per version.

A version's manifest names, for every bucket, the version whose files hold it. A change reads and writes only the buckets of the
keys it touches, all others keep their files. The manifest is written last, so a change that fails leaves nothing visible; a
change that is made again under the same number starts from the version before it and leaves the same table. Readers hold on
to the version they began with until ``vacuum`` drops it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.session import cut, folders, remove, shuffled

#: Rows of a file, at most.
FILE_ROWS = 2_000_000
_BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """``schema`` as a type or in DDL form, without the bucket; ``keys`` are never null in a row that is stored."""

    spark: SparkSession
    path: str
    schema: StructType | str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Versions with a complete manifest, oldest first."""
        found = folders(self.spark, f"{self.path}/manifest", complete=True)
        return sorted(int(name.removeprefix("v=")) for name in found if name.startswith("v="))

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket to the version that holds its rows; buckets without rows are missing. One row a bucket at most."""
        rows = self.spark.read.schema("bucket int, held_by long").json(f"{self.path}/manifest/v={version}").collect()
        return {r["bucket"]: r["held_by"] for r in rows}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table at a version, the newest if none is given; of some buckets alone, if these are given."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else None)
        held = self.manifest(version) if version is not None else {}
        paths = [f"{self.path}/data/v={v}/{_BUCKET}={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> set[int]:
        """Buckets of the keys of rows, one number a bucket."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def change(self, version: int, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
               removed: DataFrame | None = None) -> None:
        """Make ``version`` from the newest one before it: rows replace those of their key, keys of ``removed`` go.

        ``merge`` (rows held in the touched buckets, new rows) gives what these buckets hold from now on instead.
        """
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        earlier = [v for v in self.versions() if v < version]
        rows = cut(rows.select(*columns))
        gone = cut(removed.select(*self.keys).distinct()) if removed is not None else None
        touched = self.touched(rows) | (self.touched(gone) if gone is not None else set())
        held = self.manifest(earlier[-1]) if earlier else {}
        if touched:
            old = self.read(earlier[-1], touched) if earlier else self.spark.createDataFrame([], self.schema)
            if gone is not None:
                old = old.join(shuffled(gone), list(self.keys), "left_anti")
            if merge is None and not earlier:
                new = rows
            elif merge is None:
                new = old.join(shuffled(rows.select(*self.keys)), list(self.keys), "left_anti").unionByName(rows)
            else:
                new = merge(old, rows)
            data = f"{self.path}/data/v={version}"
            placed = new.select(*columns, self.bucket().alias(_BUCKET))
            (placed.repartition(_BUCKET).write.partitionBy(_BUCKET).mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(data))
            kept = {int(name.removeprefix(f"{_BUCKET}=")) for name in folders(self.spark, data) if name.startswith(f"{_BUCKET}=")}
            held = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(kept, version)
        entries = self.spark.createDataFrame(sorted(held.items()), "bucket int, held_by long")
        entries.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v={version}")

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the newest ``keep`` versions, and the files that none of these names."""
        known = self.versions()
        kept = known[-keep:]
        named = {(v, b) for version in kept for b, v in self.manifest(version).items()}
        for version in known[:-keep]:
            remove(self.spark, f"{self.path}/manifest/v={version}")
        for folder in folders(self.spark, f"{self.path}/data"):
            version = int(folder.removeprefix("v="))
            if kept and version > kept[-1]:
                continue  # being written
            for inner in folders(self.spark, f"{self.path}/data/{folder}"):
                if inner.startswith(f"{_BUCKET}=") and (version, int(inner.removeprefix(f"{_BUCKET}="))) not in named:
                    remove(self.spark, f"{self.path}/data/{folder}/{inner}")
