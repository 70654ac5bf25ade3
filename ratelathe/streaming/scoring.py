"""Streams of pairs scored against fixed parameters, and of events grouped into sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelathe.models import scoring
from ratelathe.models.fit import Model
from ratelathe.session import cut


def score_stream(model: Model, pairs: DataFrame, clip: bool = True) -> DataFrame:
    """A stream with ``user_idx, item_idx``, with ``prediction``: a join with stored contexts. Unknown ids give null."""
    return scoring.predict(model, pairs, clip, cut(scoring.contexts(model)))


def session_stream(events: DataFrame, entity: str, time: str, gap: str, late: str) -> DataFrame:
    """``entity, session_start, session_end, events`` of a stream with a timestamp column. A session is given out once
    the watermark has passed its end; events later than ``late`` are left out. The end is that of the last event, and
    two events exactly ``gap`` apart are in one session, as in ``sessions.cut_sessions``."""
    held = events.select(F.col(entity).alias("entity"), F.col(time).alias("time")).dropna().withWatermark("time", late)
    # Spark's session windows are open at the end, so that theirs is a unit wider.
    found = held.groupBy("entity", F.session_window("time", f"{gap} 1 microsecond").alias("w")).agg(F.max("time").alias("session_end"), F.count("*").alias("events"))
    return found.select("entity", F.col("w.start").alias("session_start"), "session_end", "events")
