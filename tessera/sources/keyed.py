"""A table by key that can be written again: batches in folders, one row a key when read, and a cache over it that fills its misses.

A batch counts once its folder is complete. A run that was killed leaves an incomplete folder, which no reader sees and the next
write replaces; a run repeated writes nothing, as it has nothing new. One writer at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    key: str
    schema: str  # all columns, the key among them

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def batches(self) -> list[int]:
        """Numbers of the complete batches."""
        fs, root = self._folder(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
        return [n for n in found if fs.exists(self._folder(f"{self._at(n)}/_SUCCESS")[1])]

    def _at(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def read(self, batch: bool = False) -> DataFrame:
        """One row a key, the latest written; with its batch where asked."""
        have, fields = self.batches(), StructType.fromDDL(self.schema)
        names = fields.fieldNames()
        if not have:
            empty = self.spark.createDataFrame([], fields)
            return empty.withColumn("batch", F.lit(0)) if batch else empty
        rows = self.spark.read.schema(StructType([*fields.fields]).add("batch", IntegerType())).option("basePath", self.path).parquet(*map(self._at, have))
        if len(have) > 1:
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in [*names, "batch"] if c != self.key]), "batch").alias("_v")).select(self.key, "_v.*")
        return rows.select(*names, *(["batch"] if batch else []))

    def upsert(self, rows: DataFrame) -> bool:
        """Writes what is new or different; tells whether anything was. Of rows with one key the greatest counts; rows without a key are passed over."""
        names = StructType.fromDDL(self.schema).fieldNames()
        values = [c for c in names if c != self.key]
        given = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*values)).alias("_v"))
        kept = self.read().select(F.col(self.key), F.struct(*values).alias("_old"))
        new = given.join(kept, self.key, "left").where(~F.col("_v").eqNullSafe(F.col("_old"))).select(self.key, "_v.*").select(*names)
        have = self.batches()
        if have and new.isEmpty():
            return False
        new.write.mode("overwrite").parquet(self._at(have[-1] + 1 if have else 1))
        return True

    def compact(self) -> None:
        """All rows in one new batch; the older ones go once it is complete, and tell nothing else until then."""
        have = self.batches()
        if len(have) < 2:
            return
        self.read().write.mode("overwrite").parquet(self._at(have[-1] + 1))
        for n in have:
            fs, where = self._folder(self._at(n))
            fs.delete(where, True)


def read_through(requests: DataFrame, kept: KeyedTable, fill: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests with what is kept under their keys, and cached: whether it was there before. fill() makes the rows of distinct
    missing keys, which are kept, so that the same requests never fill twice; keys that it leaves out stay null."""
    key = kept.key
    missing = requests.where(F.col(key).isNotNull()).select(key).distinct().join(kept.read().select(key), key, "left_anti")
    before = kept.batches()
    if not missing.isEmpty():
        kept.upsert(fill(missing))
    fresh = kept.read(batch=True)
    last = max(before, default=0)
    out = requests.join(fresh, key, "left").withColumn("cached", F.coalesce(F.col("batch") <= last, F.lit(False)))
    return out.drop("batch")
