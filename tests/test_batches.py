"""What a Python worker holds of the plans that are stored."""

import pyarrow as pa

from tessera.plans import registry


def test_batches_of_stored_plans_are_bounded_by_bytes(spark):
    """A partition of long texts went to its worker as one batch, whatever its size."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["size", "n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    texts = spark.range(0, 400, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 100000) text")
    got = registry.stored(texts.mapInArrow(sizes, "size long, n long"), "sizes").collect()
    assert sum(r.n for r in got) == 400
    assert max(r["size"] for r in got) <= registry.BATCH + 200_000
    assert spark.conf.get(key, None) == was
