"""The ledger as a stream: running totals by step, kept in a table that each batch replaces."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The declared steps, shown whether they ran or not.
STEPS = ("click", "view", "purchase", "signup", "error", "never run")


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
    return path


def totals(ledger: DataFrame) -> DataFrame:
    """step, calls, tokens: the same plan for a table and for a stream."""
    return ledger.groupBy("step").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """The totals after all that the stream holds now; state and offsets are in the shared folder, so a lost executor is made good.

    A batch that runs again writes the same table again, as its number names it."""
    base, last = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", {}

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        last["path"] = path

    asked = totals(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    asked.awaitTermination()
    if "path" not in last:
        return spark.createDataFrame([], "step string, calls bigint, tokens bigint")
    return spark.read.schema("step string, calls bigint, tokens bigint").parquet(last["path"])


def live_steps(done: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """Every declared step, then others that came: state is run or skipped."""
    declared = done.sparkSession.createDataFrame([(s,) for s in steps], "step string")
    return declared.join(done, "step", "full").select("step", F.when(F.col("calls").isNull(), "skipped").otherwise("run").alias("state"),
                                                      F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
