"""Tables as numbered versions of Parquet files, for writes that return rows.

Spark has no RETURNING, so a write is made of two frames: the rows it returns, and the table after it. Both are computed
from the version that was current when the write was made, which stays in place: relations joined to a write see the
tables as they were before. Who writes a version first claims its number by creating a file, which only one can; a version counts
when it was written completely. Commits of several tables are not atomic together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.errors import EngineError


class Write:
    """One write on one table: what it returns, and the table after it."""

    def __init__(self, table: VersionedTable, returning: DataFrame, after: DataFrame):
        self.table, self.after, self.started = table, after, table.version()
        self.returning, self.done = returning, False

    def commit(self) -> None:
        if self.done:
            return
        self.table.save(self.after, self.started + 1)
        self.done = True

    def finish(self, result: DataFrame) -> DataFrame:
        """Commit; the result reads the versions from before, which stay."""
        self.commit()
        return result


class Writes:
    """Several writes under names, committed in order."""

    def __init__(self, **writes: Write):
        self.writes = writes
        self.returned = {name: w.returning for name, w in writes.items()}

    def finish(self, result: DataFrame) -> DataFrame:
        for w in self.writes.values():
            w.commit()
        return result


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, id_column: str | None = "id"):
        self.spark, self.path, self.id_column = spark, path.rstrip("/"), id_column
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.version() < 0:
            if schema is None:
                raise EngineError(f"{path} has no version, and no schema was given")
            self.save(spark.createDataFrame([], schema))

    def version(self) -> int:
        """The newest version that was written completely; -1 if there is none."""
        root = self._Path(self.path)
        if not self._fs.exists(root):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return max((int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._Path(f"{self.path}/{n}/_SUCCESS"))), default=-1)

    def current(self) -> DataFrame:
        return self.at(self.version())

    def at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def save(self, df: DataFrame, version: int | None = None) -> None:
        """Write the next version, or the one given, which must be the next."""
        number = self.version() + 1 if version is None else version
        claim = self._Path(f"{self.path}/_claims/v{number}")
        if number != self.version() + 1 or not self._claimed(claim):
            raise EngineError(f"{self.path} was written since this write was made, or is being written")
        try:
            df.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        except BaseException:
            self._fs.delete(claim, False)
            raise

    def _claimed(self, claim: Any) -> bool:
        """Whether the file is now there and wasn't before."""
        self._fs.mkdirs(claim.getParent())
        try:
            return bool(self._fs.createNewFile(claim))
        except Exception:  # some file systems raise where it is there already
            if self._fs.exists(claim):
                return False
            raise

    def _numbered(self, rows: DataFrame, old: DataFrame) -> DataFrame:
        """Rows with ids after the table's largest, in their order, without a global sort; they are computed once."""
        start = old.agg(F.max(self.id_column)).first()[0] or 0
        path = f"{self.path}/_rows-{uuid.uuid4().hex}"
        rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()).write.parquet(path)
        placed = self.spark.read.parquet(path)
        # A row for each partition that the rows had.
        before = F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
        offsets = placed.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
        within = F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)
        number = F.lit(start) + 1 + F.col("__before") + within
        return placed.join(offsets, "__p").withColumn(self.id_column, number.cast(old.schema[self.id_column].dataType)).drop("__p", "__i", "__before")

    def insert(self, rows: DataFrame | Iterable[dict[str, Any]]) -> Write:
        """Missing columns are null, a missing id is the next number; returns the new rows."""
        old = self.current()
        if not isinstance(rows, DataFrame):
            rows = list(rows)
            kept = [f for f in old.schema.fields if rows and any(f.name in r for r in rows)]
            schema = type(old.schema)(kept)
            rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in kept) for r in rows], schema)
        if self.id_column and self.id_column not in rows.columns:
            rows = self._numbered(rows, old)
        new = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old.schema.fields])
        return Write(self, new, old.unionByName(new))

    def update(self, values: dict[str, Any], where: Column | str | Callable | None = None) -> Write:
        """Sets columns (to values, columns, or functions of the frame) of the rows that match; returns their new values."""
        old = self.current()
        hit = self._matches(old, where)
        changes = {k: v(old) if callable(v) and not isinstance(v, Column) else v for k, v in values.items()}
        pick = lambda c: changes[c] if isinstance(changes[c], Column) else F.lit(changes[c])
        kinds = {f.name: f.dataType for f in old.schema.fields}
        after = old.select(*[F.when(hit, pick(c).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in old.columns])
        new = old.where(hit).select(*[pick(c).cast(kinds[c]).alias(c) if c in changes else F.col(c) for c in old.columns])
        return Write(self, new, after)

    def delete(self, where: Column | str | Callable | None = None) -> Write:
        """Returns the rows as they were."""
        old = self.current()
        hit = self._matches(old, where)
        return Write(self, old.where(hit), old.where(~hit))

    @staticmethod
    def _matches(df: DataFrame, where: Any) -> Column:
        if where is None:
            return F.lit(True)
        if isinstance(where, str):
            where = F.expr(where)
        elif callable(where) and not isinstance(where, Column):
            where = where(df)
        return F.coalesce(where, F.lit(False))
