"""Bounds of what goes to Python workers at once."""

import pyarrow as pa
import pytest

from ruleframe.llm.common import BATCH_BYTES, BATCH_ROWS, bound_batches

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def own_bounds(spark):
    before = {name: spark.conf.get(name) for name in (ROWS, BYTES)}
    for name in before:
        spark.conf.unset(name)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])


def test_batches_of_long_texts_are_bounded_by_bytes_and_short_ones_by_rows(spark, own_bounds):
    bound_batches(spark)
    each = 50_000
    long, short = (spark.range(n, numPartitions=1).selectExpr(f"repeat('x', {size}) AS text") for n, size in ((400, each), (5_000, 5)))
    found = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 400
    assert max(r["size"] for r in found) <= BATCH_BYTES + 2 * each
    found = short.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 5_000
    assert max(r["n"] for r in found) <= BATCH_ROWS


def test_a_text_beyond_the_bound_goes_alone(spark, own_bounds):
    bound_batches(spark)
    texts = spark.range(3, numPartitions=1).selectExpr(f"repeat('x', {BATCH_BYTES + 1}) AS text")
    assert [r["n"] for r in texts.mapInArrow(sizes, "n long, size long").collect()] == [1, 1, 1]


def test_smaller_settings_stay(spark, own_bounds):
    spark.conf.set(ROWS, "100")
    spark.conf.set(BYTES, "1m")
    bound_batches(spark)
    assert (spark.conf.get(ROWS), spark.conf.get(BYTES)) == ("100", "1m")
