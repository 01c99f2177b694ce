"""The sticky guard: once a backend's result is too far off, that backend stays replaced, until it is reset.

The state of each backend is kept by the stream (`guarded_stream`), changed by two events: a check with its differences, and a
reset. It can be read at any time as a table (`guard_state`), also while no stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tactus.operators.parity import MOST_MAX, MOST_MEAN

#: What the stream keeps of a backend, under the name below.
STATE = "triggered boolean, checked long, max_abs double, mean_abs double"
VARIABLE = "guard"
GUARDED = f"backend string, effective string, {STATE}"
CHECK, RESET = "check", "reset"

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_stateful(spark: SparkSession) -> None:
    """Streams with states of their own need this store; set for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Guard(StatefulProcessor):
    def __init__(self, fallback: str, most_max: float, most_mean: float):
        self.fallback, self.most_max, self.most_mean = fallback, most_max, most_mean

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(VARIABLE, STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        triggered, checked, top, mean = self.state.get() if self.state.exists() else (False, 0, 0.0, 0.0)
        for r in sorted(rows, key=lambda r: r["ordinal"]):
            if r["event"] == RESET:
                triggered, checked, top, mean = False, 0, 0.0, 0.0
            elif r["event"] == CHECK:
                top, mean, checked = max(top, r["max_abs"] or 0.0), max(mean, r["mean_abs"] or 0.0), checked + 1
                triggered = triggered or top > self.most_max or mean > self.most_mean
        self.state.update((triggered, checked, top, mean))
        yield Row(backend=key[0], effective=self.fallback if triggered else key[0], triggered=triggered, checked=checked, max_abs=top, mean_abs=mean)

    def close(self) -> None:
        pass


def guarded_stream(events: DataFrame, fallback: str, most_max: float = MOST_MAX, most_mean: float = MOST_MEAN) -> DataFrame:
    """A stream of (backend, ordinal, event, max_abs, mean_abs) -> after each batch a row for each backend in it: GUARDED.

    event: check or reset; those of a batch are taken by ordinal. Null differences count as none, unknown events are passed over.
    """
    use_stateful(events.sparkSession)
    taken = events.select("backend", F.col("ordinal").cast("long").alias("ordinal"), "event", F.col("max_abs").cast("double").alias("max_abs"), F.col("mean_abs").cast("double").alias("mean_abs"))
    return taken.groupBy("backend").transformWithState(Guard(fallback, most_max, most_mean), GUARDED, "Update", "None")


def guard_state(spark: SparkSession, checkpoint: str, fallback: str, batch: int | None = None) -> DataFrame:
    """GUARDED as a stream with this checkpoint left it (after a certain batch, if named)."""
    use_stateful(spark)
    reader = spark.read.format("statestore").option("stateVarName", VARIABLE)
    kept = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    effective = F.when(F.col("value.triggered"), F.lit(fallback)).otherwise(F.col("key.backend"))
    return kept.select("key.backend", effective.alias("effective"), *(f"value.{c.split()[0]}" for c in STATE.split(", ")))


def guarded(metrics: DataFrame, order: str, fallback: str, most_max: float = MOST_MAX, most_mean: float = MOST_MEAN, event: str | None = None) -> DataFrame:
    """The same over a table: for each check the backend that is used from then on. event: the column that says check or reset, if there are resets."""
    over = (F.col("max_abs") > most_max) | (F.col("mean_abs") > most_mean)
    so_far = W.partitionBy("backend").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = metrics.withColumn("_life", F.lit(0) if event is None else F.count_if(F.col(event) == RESET).over(so_far))
    over = over if event is None else over & (F.col(event) == CHECK)
    lived = W.partitionBy("backend", "_life").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = marked.withColumn("triggered", F.max(F.coalesce(over, F.lit(False))).over(lived)).drop("_life")
    return marked.withColumn("effective", F.when(F.col("triggered"), F.lit(fallback)).otherwise(F.col("backend")))
