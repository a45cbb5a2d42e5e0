"""Wrapped tasks give the same rows, and free memory goes back to the system."""

import pyarrow as pa
import pytest

from ragscope.llm.memory import after_group, after_task


def test_results_and_errors_pass_through():
    batches = [pa.record_batch({"a": [1, 2]}), pa.record_batch({"a": [3]})]
    assert list(after_task(lambda bs: (b for b in bs))(iter(batches))) == batches
    assert after_group(lambda t: t.slice(1))(pa.table({"a": [1, 2]})).to_pydict() == {"a": [2]}

    def fails(bs):
        yield next(bs)
        raise ValueError("inside")

    with pytest.raises(ValueError, match="inside"):
        list(after_task(fails)(iter(batches)))


def test_in_spark(spark):
    df = spark.range(20).repartition(3)
    assert df.mapInArrow(after_task(lambda bs: bs), "id long").count() == 20
    groups = df.selectExpr("id % 2 AS g", "id").groupBy("g").applyInArrow(after_group(lambda t: t.slice(0, 1)), "g long, id long")
    assert groups.count() == 2
