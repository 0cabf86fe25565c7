"""Incoming transactions as keyed state with timers.

The counters of a transaction follow its rows in order of arrival: each row counts one up and caps at the total that row names, so totals
may change in both directions; a repeated sequence number replaces its member.  A transaction in process that does not move for
``timeout_ms`` of event time goes back to waiting, by a timer.  A value state holds the counters of a transaction; a map state
holds two bitmaps for each block of sequence numbers (seen, has an image), so neither grows with repeated rows and a row touches one block.

Rows of one trigger are put in order by (``ts_ms``, ``sequence``), those of later triggers come after them.  Memory of a task is that of one
transaction's rows in one trigger (25 bytes each), which the source bounds (files per trigger).  State lives in RocksDB and is
restored from the checkpoint, so a restarted query goes on exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tierbook.operators.transfer import TIMEOUT_MS
from tierbook.streaming import jobs as J

KEY = ["box_id", "transaction_id"]
STATE = "received long, added long, total long, sequences long, members long, status string, updated_ms long, version long"
COUNTERS = "box_id long, transaction_id long, " + STATE
#: Sequence numbers of one entry of the map state.
BLOCK = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def capped(before: int, totals: np.ndarray) -> int:
    """The count after one row for each total, each counting one up and capping at its total."""
    n = len(totals)
    return int(min(before + n, (totals + n - 1 - np.arange(n)).min())) if n else before


def marked(seen: bytes, held: bytes, places: np.ndarray, member: np.ndarray) -> tuple[bytes, bytes, int, int]:
    """Both bitmaps of a block after the members at these places, and by how much their bits grew; of equal places the last counts."""
    new, kept = (np.unpackbits(np.frombuffer(x, np.uint8)) if x else np.zeros(BLOCK, np.uint8) for x in (seen, held))
    before = int(new.sum()), int(kept.sum())
    last = len(places) - 1 - np.unique(places[::-1], return_index=True)[1]
    new[places[last]], kept[places[last]] = 1, member[last]
    return np.packbits(new).tobytes(), np.packbits(kept).tobytes(), int(new.sum()) - before[0], int(kept.sum()) - before[1]


class Counters(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", STATE)
        self.blocks = handle.getMapState("blocks", "block long", "seen binary, held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns = ["ts_ms", "sequence", "total", "added", "has_image"]
        parts = [[part[c].to_numpy() for c in columns] for part in rows]
        ts, sequence, total, added, member = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((sequence, ts))
        ts, sequence, total, added, member = (x[order] for x in (ts, sequence, total, added.astype(bool), member.astype(bool)))
        received, new, _, sequences, members, _, _, version = self.counters.get() or (0, 0, 0, 0, 0, "", 0, 0)
        for block in np.unique(sequence // BLOCK).tolist():
            here = sequence // BLOCK == block
            seen, held = self.blocks.getValue((block,)) or (b"", b"")
            seen, held, more, kept = marked(bytes(seen), bytes(held), sequence[here] % BLOCK, member[here])
            self.blocks.updateValue((block,), (seen, held))
            sequences, members = sequences + more, members + kept
        received, new = capped(received, total), capped(new, total[added])
        status = "FINISHED" if received >= total[-1] else "PROCESSING"
        state = (received, new, int(total[-1]), sequences, members, status, int(ts[-1]), version + 1)
        self.counters.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if status == "PROCESSING":
            self.handle.registerTimer(int(ts[-1]) + 2 + self.timeout_ms)  # fires when the watermark has reached it
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *counters, status, updated, version = self.counters.get()
        if status == "PROCESSING":
            state = (*counters, "WAITING", updated, version + 1)
            self.counters.update(state)
            yield self._row(key, state)

    @staticmethod
    def _row(key, state: tuple) -> pd.DataFrame:
        names = [field.split()[0] for field in COUNTERS.split(", ")]
        return pd.DataFrame([(*key, *state)], columns=names)

    def close(self) -> None:
        pass


def prepared(spark: SparkSession) -> SparkSession:
    """Timers and map state need the RocksDB store; a query that already has a checkpoint keeps the store it began with."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def counted(stream: DataFrame, timeout_ms: int = TIMEOUT_MS, delay: str = "0 seconds") -> DataFrame:
    """A row for every change of a transaction, with the ``version`` it makes.

    ``stream`` is (box_id, transaction_id, sequence, image_id, added, total, ts_ms); rows without a key are left out, and so are
    those that come ``delay`` after the latest arrival.  Event time is counted from 1, as the first watermark lies at 0.
    """
    timed = stream.where("box_id is not null and transaction_id is not null").select(
        *KEY, F.col("sequence").cast("long").alias("sequence"), F.col("total").cast("long").alias("total"), F.coalesce("added", F.lit(False)).alias("added"),
        F.col("image_id").isNotNull().alias("has_image"), "ts_ms", F.timestamp_millis(F.col("ts_ms") + 1).alias("ts"))
    return timed.withWatermark("ts", delay).groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=Counters(timeout_ms), outputStructType=COUNTERS, outputMode="Update", timeMode="EventTime")


def run(stream: DataFrame, work: str, timeout_ms: int = TIMEOUT_MS, delay: str = "0 seconds") -> None:
    """Counters of everything available, as deltas of the changed transactions."""
    prepared(stream.sparkSession)
    J.run_batches(counted(stream, timeout_ms, delay), work, J.delta_writer(work, lambda batch: batch), mode="update")


def current(deltas: DataFrame) -> DataFrame:
    """The latest version of every transaction."""
    fields = [field.split()[0] for field in STATE.split(", ")]
    newest = deltas.groupBy(*KEY).agg(F.max_by(F.struct(*fields), "version").alias("s"))
    return newest.select(*KEY, *[F.col(f"s.{c}").alias(c) for c in fields if c != "version"])
