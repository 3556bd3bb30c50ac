"""Event-time queries, as batches of what quire.streaming runs on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.sources import tables as S
from quire.streaming import counts as C

from .base import query


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def windowed_events(spark, d):
    out = C.windowed(S.table(spark, d, "events"), "ts", "1 day", "1 hour", "event_type")
    return out.select(F.col("start"), "event_type", "n")
