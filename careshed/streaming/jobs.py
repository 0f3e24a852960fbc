"""The weekly operations as Structured Streaming jobs: counts, visit deduplication, drift."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from careshed.core.work import send_package
from careshed.operators.models import errors


def weekly_counts(events: DataFrame, area: str, time: str, late: str = "14 days") -> DataFrame:
    """Counts in Monday weeks; a week is put out once the watermark has passed it."""
    weeks = events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    counts = weeks.groupBy(F.col(area), F.window("__ts", "7 days", "7 days", "4 days")).agg(F.count("*").alias("cases"))
    return counts.select(area, F.to_date("window.start").alias("week_start"), "cases")


KEPT = ("patientid", "diagnosis_group", "event_id", "visit_time", "facility_level")


def visit_state(days: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of a patient and group: the state is the time and level of the last raw visit, dropped once the watermark
    has left it behind. States come and go with the rows, many groups in one Arrow batch."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(rows)
        visits = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in KEPT[2:]}
        us = visits["visit_time"].astype("datetime64[us]").astype("int64")
        order = np.lexsort((visits["event_id"], -visits["facility_level"].astype("int64"), us))
        last = state.get if state.exists else (None, None)
        keep, last = first_visits(us[order], visits["facility_level"][order].astype("int64"), *last, days)
        state.update(last)
        state.setTimeoutTimestamp(max(last[0] // 1000 + (days + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        kept = order[keep]
        if len(kept):
            yield pd.DataFrame({KEPT[0]: key[0], KEPT[1]: key[1], **{c: v[kept] for c, v in visits.items()}})

    return step


def first_visits(us: np.ndarray, level: np.ndarray, last_us: int | None, last_level: int | None, days: int) -> tuple[np.ndarray, tuple[int, int]]:
    """Which visits, in order of time, are no repeats, and the last raw visit after them.

    A visit is held against the one before it, or if it is older than the last visit known, against that.
    """
    before_us, before_level = np.concatenate((us[:1], us[:-1])), np.concatenate((level[:1], level[:-1]))
    keep = ~((np.abs(us - before_us) // 86_400_000_000 <= days) & (level <= before_level))
    keep[:1] = True
    if last_us is not None:
        late = int(np.searchsorted(us, last_us))  # so many are older
        held = slice(0, late + 1)
        keep[held] = ~((np.abs(us[held] - last_us) // 86_400_000_000 <= days) & (level[held] <= last_level))
        if late == len(us):
            return keep, (last_us, last_level)
    return keep, (int(us[-1]), int(level[-1]))


def deduplicate_visits(visits: DataFrame, days: int = 3, late: str = "30 days") -> DataFrame:
    """Visits (patientid, diagnosis_group, event_id, visit_time, facility_level) that are not repeats.

    The state of a patient and group is the time and level of the last raw visit, kept until the watermark is
    ``days`` past it. Input in order of time gives what the batch operator gives. A row of a later batch that is older
    than the last visit is a repeat of it if it lies within ``days`` before it and its level is no higher; the state stays.
    With the RocksDB state store states need not fit the heap, see ``with_rocksdb``.
    """
    send_package(visits.sparkSession)
    schema = "patientid long, diagnosis_group string, event_id long, visit_time timestamp, facility_level int"
    rows = visits.where("patientid IS NOT NULL AND diagnosis_group IS NOT NULL AND visit_time IS NOT NULL")
    rows = rows.withColumn("visit_time", F.col("visit_time").cast("timestamp")).withWatermark("visit_time", late)
    return rows.groupBy("patientid", "diagnosis_group").applyInPandasWithState(visit_state(days), schema, "us long, level int", "append", GroupStateTimeout.EventTimeTimeout)


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session with the state store whose states need not fit the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def drift_monitor(predictions: DataFrame, alert: Callable[[float, int], None], limit: float = 15.0, scores: str | None = None):
    """A stream writer that scores each arrived batch (y, prediction) and calls ``alert`` beyond the limit; with a folder
    ``scores`` it keeps each batch's n and rmse there."""

    def check(batch: DataFrame, batch_id: int) -> None:
        found = errors(batch, F.col("y"), F.col("prediction"))
        r = found.first()
        if scores and r is not None:
            found.select("n", "rmse").write.mode("append").parquet(scores)
        if r is not None and r.rmse is not None and r.rmse > limit:
            alert(r.rmse, batch_id)

    return predictions.writeStream.foreachBatch(check)


def observed_errors(predictions: DataFrame, name: str = "drift") -> DataFrame:
    """The stream itself, whose n and sum of squared errors are observed as it passes: no batch is read for them again."""
    error = F.col("y").cast("double") - F.col("prediction").cast("double")
    return predictions.observe(name, F.count(error).alias("n"), F.coalesce(F.sum(error * error), F.lit(0.0)).alias("squares"))


class DriftListener(StreamingQueryListener):
    """Calls ``alert(rmse, batch_id)`` for each batch of ``observed_errors`` beyond the limit; ``seen`` has (batch_id, n, rmse).

    Register it with ``spark.streams.addListener``; a restarted query goes on with its own batch ids.
    """

    def __init__(self, alert: Callable[[float, int], None], limit: float = 15.0, name: str = "drift"):
        self.alert, self.limit, self.name, self.seen = alert, limit, name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None or not row.n:
            return
        rmse = math.sqrt(row.squares / row.n)
        self.seen.append((event.progress.batchId, row.n, rmse))
        if rmse > self.limit:
            self.alert(rmse, event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
