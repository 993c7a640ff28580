"""Captures written and read again: events become frames of format-B files in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import frames, joins
from ..sources import decode, ranges, records, segments
from .catalog import query
from .time_queries import BLOCK, events

BINS = 64
_FRAMES = """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events)"""


def captured(spark, root):
    """Frames of captures by user: two chains of 64 subcarriers whose samples are a rule of the event's id."""
    e = events(spark, root).select(F.col("user_id").cast("string").alias("source"), "event_id", "t")
    e = frames.numbered(e, "source", ["t", "event_id"], F.floor(F.col("t") / BLOCK)).withColumnRenamed("i", "seq")
    # In order before samples are made: records stay where they are written, in more tasks than these small rows would need.
    e = e.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", "seq").sortWithinPartitions("source", "seq")
    plane = lambda a, b: F.transform(F.sequence(F.col("event_id") * a, F.col("event_id") * a + (BINS - 1) * b, F.lit(b).cast("bigint")), lambda x: x % 4001 - 2000)
    rows = e.select("source", "seq", F.floor(F.round(F.col("t") * 1_000_000).cast("bigint") / 1000).cast("bigint").alias("tick"), (-30 - F.col("event_id") % 60).cast("int").alias("rssi"), F.lit("08:bf:b8:95:80:04").alias("mac"), plane(7, 13).alias("re0"), plane(11, 5).alias("im0"), plane(3, 17).alias("re1"), plane(5, 29).alias("im1"))
    folder = f"{joins.shared(spark)}/captures-{uuid.uuid4().hex}"
    spark.dataSource.register(segments.SegmentSink)
    records.encode(rows).write.format("wavemill.segments").option("segmentBytes", 1 << 20).mode("append").save(folder.removeprefix("file://").removeprefix("file:"))
    return ranges.read_captures(spark, folder).withColumn("user_id", F.split("capture", "/")[0].cast("bigint"))


@query(_FRAMES + f""", s AS (SELECT *, unnest(range({BINS})) AS k FROM e)
SELECT user_id, ms AS tick, (-30 - event_id % 60)::INTEGER AS rssi, '08:bf:b8:95:80:04' AS source, 2 AS num_rx, {BINS} AS num_sc, sum(((event_id * 7 + k * 13) % 4001 - 2000) * (k + 1))::BIGINT AS re0, sum(((event_id * 5 + k * 29) % 4001 - 2000) * (k + 1))::BIGINT AS im1
FROM s GROUP BY user_id, event_id, ms""")
def captured_frames(spark, root):
    """Each event's frame as the capture reader gives it back, its samples weighted by their place."""
    weighed = lambda c: F.aggregate(F.transform(c, lambda x, k: x.cast("bigint") * (k + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias(c)
    return captured(spark, root).select("user_id", "tick", "rssi", "source", "num_rx", "num_sc", weighed("re0"), weighed("im1"))


@query(_FRAMES + f""", s AS (SELECT *, unnest(range({BINS})) AS k FROM e),
z AS (SELECT *, (event_id * 7 + k * 13) % 4001 - 2000 AS a, (event_id * 11 + k * 5) % 4001 - 2000 AS b, (event_id * 3 + k * 17) % 4001 - 2000 AS c, (event_id * 5 + k * 29) % 4001 - 2000 AS d FROM s)
SELECT user_id, k::INTEGER AS sc, count(*) AS n, round(avg(10 * log10((c * c + d * d) / (a * a + b * b))), 4) + 0.0 AS ratio_db FROM z WHERE (a <> 0 OR b <> 0) AND (c <> 0 OR d <> 0) GROUP BY 1, 2""")
def captured_ratio(spark, root):
    """The mean ratio of both chains in decibels, by user and subcarrier, where both have samples."""
    cells = decode.ratio_cells(captured(spark, root), "user_id")
    return cells.groupBy("user_id", "sc").agg(F.count("*").alias("n"), (F.round(F.avg("ratio_amp"), 4) + 0.0).alias("ratio_db"))
