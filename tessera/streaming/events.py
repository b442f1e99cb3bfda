"""Steps of sessions as a stream: told in order, each once, whatever order they arrive in.

A session's state is the number that comes next, its running total and the steps that arrived early. Steps are told when all
before them were. A session from which nothing came for `timeout` of event time tells what it holds, marked as after a gap, then
that it timed out; later rows of it start anew. Rows behind the watermark are late and dropped."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.streaming.ledger import shared_dir

TOLD = "session bigint, cursor int, seq int, step string, total bigint, kind string"
STATE = "next int, cursor int, total bigint, seen bigint, held string"


def ordered(events: DataFrame, delay: str = "1 hour", timeout_s: int = 1800) -> DataFrame:
    """events (session, seq from 1, step, tokens, ts) as told rows; needs a stream."""

    def tell(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        following, cursor, total, seen, held = (*state.get[:4], json.loads(state.get[4])) if state.exists else (1, 0, 0, 0, {})
        out: list[tuple] = []

        def say(seq: int, step: str, tokens: int, kind: str) -> None:
            nonlocal cursor, total
            cursor, total = cursor + 1, total + tokens
            out.append((key[0], cursor, seq, step, total, kind))

        if state.hasTimedOut:
            for seq in sorted(map(int, held)):
                say(seq, *held[str(seq)], "gap")
            say(-1, "", 0, "timeout")
            state.remove()
        else:
            mark, fresh = state.getCurrentWatermarkMs(), state.exists
            for frame in frames:
                for seq, step, tokens, ts in zip(frame["seq"], frame["step"], frame["tokens"], frame["ts"]):
                    # the engine drops rows behind the mark of the batch before; here this batch's counts
                    if (at := int(ts.timestamp() * 1000)) < mark:
                        continue
                    seen, fresh = max(seen, at), True
                    # a step told or held before is the same one sent again
                    if seq >= following:
                        held.setdefault(str(int(seq)), [step, int(tokens)])
            while str(following) in held:
                say(following, *held.pop(str(following)), "step")
                following += 1
            if fresh:
                state.update((following, cursor, total, seen, json.dumps(held)))
                state.setTimeoutTimestamp(max(seen + timeout_s * 1000, mark + 1))
        yield pd.DataFrame(out, columns=["session", "cursor", "seq", "step", "total", "kind"])

    return events.withWatermark("ts", delay).groupBy("session").applyInPandasWithState(tell, TOLD, STATE, "append", "EventTimeTimeout")


def drain(told: DataFrame, spark: SparkSession) -> DataFrame:
    """All that the stream tells of what it holds now. A batch that runs again writes its folder again, as its number names it."""
    base = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
    paths: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        paths.append(path) if path not in paths else None

    asked = told.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    asked.awaitTermination()
    return spark.read.schema(TOLD).parquet(*paths) if paths else spark.createDataFrame([], TOLD)
