"""Reads over time as a streaming query, and progress of running queries."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from readqc.config import TIME_BUCKET
from readqc.functions import reads as R

log = logging.getLogger(__name__)


def reads_per_bucket(reads: DataFrame, bucket: int = TIME_BUCKET, late: str = "10 minutes") -> DataFrame:
    """Nanopore reads in tumbling windows of their start time: start, n. Reads later than ``late`` are left out; running
    totals are taken over the sink's table, whose windows are final once written in append mode."""
    times = reads.select(F.timestamp_seconds(R.ont_start("id")).alias("t")).where("t IS NOT NULL").withWatermark("t", late)
    return times.groupBy(F.window("t", f"{bucket} seconds")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


class Progress(StreamingQueryListener):
    """Logs rows and rate of each micro-batch, and keeps the totals."""

    def __init__(self):
        self.rows = 0

    def onQueryStarted(self, event):
        log.info("started %s", event.id)

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        log.info("%d rows, %.0f rows/s", self.rows, event.progress.processedRowsPerSecond or 0)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        log.info("ended %s", event.id)
