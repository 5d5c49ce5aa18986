"""A table of Parquet files with a log: versions, updates that rewrite only the files they touch, commits that don't overwrite.

Each version is one log entry that names the files added, with the least and greatest value of each stated column, and the
files removed.  An update first leaves out files whose values can't match, then those in which no row matches, and
rewrites the rest.  A commit creates the next entry; if another writer was first, it fails and nothing has changed.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "version long, schema string, stats array<string>, added array<struct<file:string,rows:long,least:map<string,string>,greatest:map<string,string>,nulls:map<string,long>>>, removed array<string>"


class Conflict(Exception):
    """Another writer has committed the version that this one was to become."""


class TableLog:
    """The table at a path that all executors share.  ``stats``: columns whose least and greatest values are kept for each file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _entry(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def latest(self) -> int:
        """The last version; -1 if there is none."""
        fs, folder = self._fs(f"{self.path}/_log")
        if not fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=-1)

    def _create(self, version: int, text: str) -> None:
        """The entry appears whole or not at all, and never in place of another."""
        target = self._entry(version)
        fs, folder = self._fs(f"{self.path}/_log")
        fs.mkdirs(folder)
        draft = f"{self.path}/_log/.{uuid.uuid4().hex}"
        _, at = self._fs(draft)
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.getUri().getScheme() == "file":
            try:  # a link to a name that exists fails, also between two writers at once
                os.link(urlparse(draft).path, urlparse(target).path)
            except FileExistsError:
                raise Conflict(f"version {version} exists") from None
            finally:
                fs.delete(at, False)
            return
        try:  # other stores: a rename to a name that exists fails
            done = fs.rename(at, self._fs(target)[1])
        except Exception as e:
            if not fs.exists(self._fs(target)[1]):
                raise
            raise Conflict(f"version {version} exists") from e
        if not done:
            fs.delete(at, False)
            raise Conflict(f"version {version} exists")

    def _entries(self, version: int | None) -> DataFrame:
        last = self.latest() if version is None else version
        if last < 0 or last > self.latest():
            raise ValueError(f"no version {last} of {self.path}")
        return self.spark.read.schema(ENTRY).json([self._entry(v) for v in range(last + 1)])

    def files(self, version: int | None = None) -> DataFrame:
        """(file, rows, least, greatest, nulls) of a version's files."""
        entries = self._entries(version)
        gone = entries.select(F.explode("removed").alias("file"))
        return entries.select(F.explode("added").alias("a")).select("a.*").join(gone, "file", "left_anti")

    def _head(self) -> tuple[T.StructType, list[str]]:
        r = self.spark.read.schema(ENTRY).json(self._entry(0)).first()
        return T.StructType.fromJson(json.loads(r.schema)), list(r.stats)

    def _read(self, files: DataFrame) -> DataFrame:
        names, schema = [r.file for r in files.select("file").collect()], self._head()[0]  # one name a file, as any table's listing
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.files(version))

    def _written(self, df: DataFrame, stats: list[str]) -> list[dict]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}").withColumn("_file", F.col("_metadata.file_name"))
        values = lambda f: F.map_from_arrays(F.array(*[F.lit(c) for c in stats]), F.array(*[f(c) for c in stats]))
        told = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"), *[g(c).cast("string").alias(f"{n}_{c}") for c in stats for n, g in (("lo", F.min), ("hi", F.max))], *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in stats])
        if not stats:
            empty = F.lit(None)
            return [{"file": f"{folder}/{r['_file']}", "rows": r["rows"], "least": {}, "greatest": {}, "nulls": {}} for r in told.withColumn("_", empty).collect()]
        shown = told.select(F.concat(F.lit(f"{folder}/"), "_file").alias("file"), "rows", values(lambda c: F.col(f"lo_{c}")).alias("least"), values(lambda c: F.col(f"hi_{c}")).alias("greatest"), values(lambda c: F.col(f"no_{c}")).alias("nulls"))
        return [json.loads(r[0]) for r in shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]

    def _commit(self, version: int, schema: T.StructType, stats: list[str], added: list[dict], removed: list[str]) -> int:
        self._create(version, json.dumps({"version": version, "schema": schema.json(), "stats": stats, "added": added, "removed": removed}))
        return version

    def create(self, df: DataFrame, stats: list[str], cluster_by: list[str] | None = None) -> int:
        """Version 0 of the table; with ``cluster_by`` its files hold ranges of those columns."""
        if cluster_by:
            df = df.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *cluster_by).sortWithinPartitions(*cluster_by)
        return self._commit(0, df.schema, stats, self._written(df, stats), [])

    def append(self, df: DataFrame, base: int | None = None) -> int:
        """Rows more, as the version after ``base`` (the latest)."""
        (schema, stats), base = self._head(), self.latest() if base is None else base
        same = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        return self._commit(base + 1, schema, stats, self._written(same, stats), [])

    def candidates(self, bounds: dict[str, tuple], base: int | None = None) -> DataFrame:
        """files() that can hold a row with each stated column within (least, greatest), either of them None for no limit.

        Values of a column without kept values, or null ones, are not ruled out by bounds of that column.
        """
        schema, stats = self._head()
        keep = F.lit(True)
        for name, (low, high) in bounds.items():
            if name not in stats:
                continue
            kind = schema[name].dataType
            least, greatest = F.col("least")[name].cast(kind), F.col("greatest")[name].cast(kind)
            inside = (F.lit(True) if low is None else greatest >= F.lit(low).cast(kind)) & (F.lit(True) if high is None else least <= F.lit(high).cast(kind))
            keep = keep & F.coalesce(inside, F.lit(False))
        return self.files(base).where(keep)

    def _matching(self, bounds: dict[str, tuple], where: Column | None, base: int) -> tuple[DataFrame, Column]:
        """The candidates in which a row matches, and the whole condition; null counts as no match."""
        match = F.lit(True) if where is None else where
        for name, (low, high) in bounds.items():
            match = match & (F.lit(True) if low is None else F.col(name) >= F.lit(low)) & (F.lit(True) if high is None else F.col(name) <= F.lit(high))
        match = F.coalesce(match, F.lit(False))
        possible = self.candidates(bounds, base)
        hit = self._read(possible).where(match).select(F.col("_metadata.file_name").alias("name")).distinct() if not possible.isEmpty() else None
        return (possible.where("false") if hit is None else possible.join(hit, F.element_at(F.split("file", "/"), -1) == F.col("name"), "left_semi")), match

    def update(self, bounds: dict[str, tuple], assign: dict[str, Column], where: Column | None = None, base: int | None = None) -> int:
        """Rows within the bounds for which ``where`` holds get the assigned values; the version that this makes.

        The update is of version ``base`` (the latest).  If nothing matches, no version is made.
        """
        return self._rewrite(bounds, where, base, lambda df, match: df.withColumns({c: F.when(match, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in assign.items()}))

    def delete(self, bounds: dict[str, tuple], where: Column | None = None, base: int | None = None) -> int:
        return self._rewrite(bounds, where, base, lambda df, match: df.where(~match))

    def _rewrite(self, bounds: dict[str, tuple], where: Column | None, base: int | None, change) -> int:
        base = self.latest() if base is None else base
        schema, stats = self._head()
        touched, match = self._matching(bounds, where, base)
        names = [r.file for r in touched.select("file").collect()]
        if not names:
            return base
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])
        return self._commit(base + 1, schema, stats, self._written(change(rows, match), stats), names)
