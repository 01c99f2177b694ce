"""Islands of a flag, and nearness in time, as streams: rows may come in any order within the watermark's delay.

Every function's rows equal those of its batch counterpart once the watermark has passed them (`segments.islands` with
`island_peaks`, `nearest.without_near`, `nearest.nearest_deltas`); rows later than the watermark are dropped, as Spark does. All states
are bounded by what the delay and the radius or gap can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tactus.streaming.guard import use_stateful

ISLAND = "track string, island long, start long, end long, peak long"
OPEN = "number long, start long, last long, last_ms long, peak long, height double"
SEEN = "ms long, frame long, flag boolean, height double"


class Islands(StatefulProcessor):
    """Keeps rows that the watermark hasn't passed, and the open island. One timer a track: at its earliest kept row, else where its island ends.

    Every question to the state is a message to Spark, so rows are kept and taken as lists: a few questions for each track and batch,
    not for each row.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("kept", SEEN)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r["ms"], r["frame"], bool(r["flag"]), r["height"]) for r in rows]
        if not fresh:
            return iter(())
        self.waiting.appendList(fresh)
        first = min(x[0] for x in fresh)
        timers = list(self.handle.listTimers())
        if not timers or first < min(timers):
            self._wake(first, timers)
        return iter(())

    def _wake(self, at: int, timers: list[int]) -> None:
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        number, start, last, last_ms, peak, height = self.open.get() or (0, None, None, None, None, None)

        def closed() -> Row:
            return Row(track=key[0], island=number, start=start, end=last + 1, peak=peak)

        kept = {tuple(r)[:2]: tuple(r)[2:] for r in self.waiting.get()}  # of rows of one time and frame, the one that came last
        ahead = [(*k, *v) for k, v in kept.items() if k[0] > now]
        for (ms, frame), (flag, value) in sorted(x for x in kept.items() if x[0][0] <= now):
            if start is not None and (not flag or ms - last_ms > self.gap_ms):
                yield closed()
                start = None
            if flag and start is None:
                number, start, peak, height = number + 1, frame, frame, value
            if flag:
                last, last_ms = frame, ms
                if value is not None and (height is None or value > height):
                    peak, height = frame, value
        if start is not None and last_ms + self.gap_ms < now:
            yield closed()
            start = None
        self.open.update((number, start, last, last_ms, peak, height))
        if ahead:
            self.waiting.put(ahead)
        elif kept:
            self.waiting.clear()
        left = [x[0] for x in ahead] + ([last_ms + self.gap_ms + 1] if start is not None else [])
        if left:
            self._wake(min(left), [t for t in self.handle.listTimers() if t != expiredTimerInfo.getExpiryTimeInMs()])

    def close(self) -> None:
        pass


def islands(rows: DataFrame, delay: str, gap_seconds: float) -> DataFrame:
    """A stream of (track, time, frame, flag, height) -> ISLAND: the runs of rows whose flag holds, numbered in their track from 1.

    A run ends with a row whose flag doesn't hold, or when no row follows for gap_seconds; its row comes when the watermark has
    passed that. end is the last frame plus one, peak the first frame of the greatest height. Null flags don't hold. Rows of one
    time and frame are one.
    """
    use_stateful(rows.sparkSession)
    timed = rows.withWatermark("time", delay)
    ms = F.ceil(F.unix_micros(F.col("time").cast("timestamp")) / 1000)  # not before the time itself, so what the watermark has passed is whole
    taken = timed.select(F.col("track").cast("string").alias("track"), "time", ms.alias("ms"), F.col("frame").cast("long").alias("frame"), F.coalesce("flag", F.lit(False)).alias("flag"), F.col("height").cast("double").alias("height"))
    return taken.groupBy("track").transformWithState(Islands(round(gap_seconds * 1000)), ISLAND, "Append", "EventTime")


def _near(times: DataFrame, others: DataFrame, delay: str, radius: str, keys: list[str]) -> DataFrame:
    """Each row of times beside the others of its track within the radius, or beside nulls once the watermark shows that there are none."""
    a = times.select("track", "time", *keys).withWatermark("time", delay)
    b = others.select(F.col("track").alias("_track"), F.col("time").alias("_time")).withWatermark("_time", delay)
    reach = F.expr(f"interval {radius}")
    return a.join(b, (a["track"] == b["_track"]) & (b["_time"] >= a["time"] - reach) & (b["_time"] <= a["time"] + reach), "left_outer")


def without_near(times: DataFrame, others: DataFrame, delay: str, radius: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Streams of (track, time): rows of times (with keys) that are more than radius from every row of others in the track."""
    return _near(times, others, delay, radius, keys).where("_time is null").select("track", "time", *keys)


def nearest_deltas(times: DataFrame, others: DataFrame, delay: str, radius: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Streams of (track, time) -> (track, time, keys, delta): microseconds to the nearest of others within the radius, the later one on ties.

    Null where there is none. Rows of one track, time and keys are one.
    """
    delta = F.timestamp_diff("MICROSECOND", F.col("time"), F.col("_time"))
    near = F.min(F.when(F.col("_time").isNotNull(), F.struct(F.abs(delta).alias("far"), (-delta).alias("back"))))
    met = _near(times, others, delay, radius, keys).groupBy("track", "time", *keys).agg(near.alias("_near"))
    return met.select("track", "time", *keys, (-F.col("_near.back")).alias("delta"))
