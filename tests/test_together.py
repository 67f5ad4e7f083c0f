"""Independent frames built side by side."""

import threading

import pytest

from farmspark.plans.together import together


def test_results_in_order_and_side_by_side(spark):
    both = threading.Barrier(2, timeout=30)

    def build(n):
        def run():
            both.wait()  # neither ends before the other has begun
            return spark.range(n).count()
        return run
    assert together(spark, build(3), build(5)) == [3, 5]
    assert together(spark) == [] and together(spark, lambda: 1) == [1]


def test_an_error_is_raised_after_the_others_ended(spark):
    done = []

    def fails():
        raise ValueError("rule")

    with pytest.raises(ValueError, match="rule"):
        together(spark, fails, lambda: done.append(spark.range(2).count()))
    assert done == [2]


def test_threads_take_over_local_properties(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("farmspark.test", "outer")
    try:
        assert together(spark, *[lambda: sc.getLocalProperty("farmspark.test")] * 3) == ["outer"] * 3
    finally:
        sc.setLocalProperty("farmspark.test", None)
