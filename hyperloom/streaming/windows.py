"""Hyperedges from events: the users of each window of time, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.operators.incidence import incidence


def window_incidence(events: DataFrame, ts: str = "ts", member: str = "user_id", length: str = "1 hour") -> DataFrame:
    """(e, v): e is the window's start in seconds, v a member with an event in it."""
    start = F.unix_timestamp(F.window(F.col(ts), length)["start"])
    return incidence(events.select(start.alias("e"), F.col(member).alias("v")), "e", "v")


def window_incidence_stream(events: DataFrame, ts: str = "ts", member: str = "user_id", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same of a streaming table: each (e, v) once, as long as events come no later than `late`."""
    rows = events.withWatermark(ts, late).withColumn("w", F.window(F.col(ts), length))
    once = rows.select(F.col("w"), F.col(member).cast("long").alias("v"), F.col(ts)).where("v is not null").groupBy("w", "v").agg(F.count("*").alias("n"))
    return once.select(F.unix_timestamp(F.col("w")["start"]).alias("e"), "v")
