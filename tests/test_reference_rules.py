"""Boundary cases of the conformance rules and the complete in-group rank."""

import pytest
from pyspark.sql import functions as F

from ordertide.operators import detectors, process


@pytest.mark.parametrize(("fitness", "band", "severity"), [
    (1.0, "1.0", "Normal"), (0.99, "0.8-<1.0", "Mild"), (0.8, "0.8-<1.0", "Mild"), (0.79, "0.5-<0.8", "Significant"),
    (0.5, "0.5-<0.8", "Significant"), (0.49, "<0.5", "Severe")])
def test_bands_and_severity(spark, fitness, band, severity):
    row = spark.range(1).select(process.fitness_band(F.lit(fitness)).alias("b"), detectors.severity_of_deviation(F.lit(fitness), F.lit(False)).alias("s"),
                                detectors.severity_of_deviation(F.lit(fitness), F.lit(True)).alias("r")).first()
    assert (row.b, row.s, row.r) == (band, severity, "Severe")


def test_reversal_looks_at_adjacent_milestones_only(spark):
    names = ["purchased", "approved", "shipped", "delivered"]
    cases = {"apart": ["purchased", "delivered", "approved"], "adjacent": ["approved", "purchased"], "in order": names}
    rows = [(case, a, f"2020-01-01 00:00:0{k}", names.index(a)) for case, trace in cases.items() for k, a in enumerate(trace)]
    log = spark.createDataFrame(rows, "case_id string, activity string, ts string, rank int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.case_id: r.reversed_flag for r in process.conformance(log, names).collect()}
    assert got == {"apart": False, "adjacent": True, "in order": False}
