"""Writing readings, and writing them again."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skysense.session import new_path
from skysense.sources.sinks import read_back, write_readings
from tests.conftest import at


def test_a_day_written_again_replaces_only_itself(spark):
    first = spark.createDataFrame([("a", at(i), float(i)) for i in range(48)], "station string, datetime timestamp_ntz, pm2_5 double")
    path = write_readings(first, new_path(spark, "days"))
    again = first.filter(F.col("datetime") >= at(24)).withColumn("pm2_5", F.col("pm2_5") + 1000)
    for _ in range(2):
        write_readings(again, path, replace=True)
    back = {r.datetime: r.pm2_5 for r in read_back(spark, path, first).collect()}
    assert read_back(spark, path, first).count() == 48
    assert back == {at(i): float(i) + (1000 if i >= 24 else 0) for i in range(48)}
    with pytest.raises(AnalysisException):
        write_readings(again, path)
    with pytest.raises(ValueError, match="by day"):
        write_readings(again, path, partitioned=False, replace=True)
