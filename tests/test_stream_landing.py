"""Scans landed for the streams: built once, in files whose number grows with cores or rows, none lost."""

import datetime as dt
from collections import Counter

from depotflow.plans import io_queries
from depotflow.schema import SCAN


class Inputs:
    def __init__(self, spark, rows):
        self.spark, self.built = spark, 0
        self._rows = spark.createDataFrame(rows, SCAN)

    @property
    def scans(self):
        self.built += 1
        return self._rows


ROWS = [(n, 1, n % 3, None if n % 50 == 0 else dt.datetime(1993 + n % 11, 5, 1 + n % 20), None if n % 7 == 0 else f"X{n}") for n in range(900)]
ROWS += ROWS[:40]


def test_years_are_built_once_and_their_files_grow(spark, monkeypatch):
    monkeypatch.setattr(io_queries, "FILE_SCANS", 20, raising=False)
    t, years = Inputs(spark, ROWS), [1995, 1996, 1998, 1999, 1997, 2000, 2001]
    path, stream = io_queries._scans_by_year(t, years)
    assert t.built == 1 and stream.isStreaming
    landed = spark.read.schema(SCAN).parquet(path)
    assert Counter(map(tuple, landed.collect())) == Counter(ROWS)
    assert len(landed.inputFiles()) == 7 * (len(ROWS) // (7 * 20))


def test_a_micro_batch_has_a_file_for_each_core(spark):
    stream = io_queries._scan_stream(Inputs(spark, ROWS))
    out = io_queries.fresh_path(spark, "copied")
    run = stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", io_queries.fresh_path(spark, "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert Counter(map(tuple, spark.read.schema(SCAN).parquet(out).collect())) == Counter(ROWS)
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == io_queries.BATCHES
    assert len(spark.read.parquet(out).inputFiles()) == io_queries.BATCHES * spark.sparkContext.defaultParallelism
