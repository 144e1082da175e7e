"""Keyed state with event-time timers, for jobs whose result must not depend on how their input arrives.

The processors keep rows of a key by time slot; a slot's timer fires once the
watermark has passed its end, slots of a key in order of time. State lives in
RocksDB, so a key may hold more rows than fit in memory; a task looks at one
slot of a key, or of a group of keys, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..functions.times import hours_after

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOTS_PER_LIFE = 60
KEY_GROUPS = 64
HELD_ROWS = 200_000
SEND_ROWS = 10_000


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and map state need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def clocked(stream: DataFrame, at: Column, late: str) -> DataFrame:
    """Let the event time ``at`` drive the watermark; rows behind it stay in.

    Spark drops late rows before a stateful operator where it sees the time
    column that carries the watermark. It is left out here, and a row's time goes on as a
    plain number in ``__us``, so the processor decides about late rows.
    """
    timed = stream.withColumn("__et", at.cast("timestamp")).withWatermark("__et", late)
    return timed.withColumn("__us", F.unix_micros("__et")).drop("__et")


class FirstRequests(StatefulProcessor):
    """Judges the requests of a group of keys in order of time: which ones no live earlier result of their key answers.

    Rows come as ``g`` (the group), ``k`` (the key), ``row`` (the id), ``us``, ``beat`` (no request). State has an entry
    for each slot of a group, not of a key, and is read and written once a batch for a slot.
    """

    def __init__(self, id_type: str, ttl_us: int, slot_us: int):
        self.id_type, self.ttl_us, self.slot_us = id_type, ttl_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint", f"us array<bigint>, id array<{self.id_type}>, k array<string>")
        self.live = handle.getValueState("live", "k array<string>, us array<bigint>")
        self.next = handle.getValueState("next", "slot bigint")

    def _end_ms(self, slot: int) -> int:
        return (slot + 1) * self.slot_us // 1000

    def _keep(self, new: dict[int, list[list]]) -> None:
        """Add waiting rows to the state; a timer stands at the end of the first slot."""
        for slot, rows in new.items():
            if self.waiting.containsKey((slot,)):
                rows = [list(old) + own for old, own in zip(self.waiting.getValue((slot,)), rows)]
            self.waiting.updateValue((slot,), tuple(rows))
        if new and (not self.next.exists() or min(new) < self.next.get()[0]):
            self._wake(min(new))

    def _wake(self, slot: int) -> None:
        self.next.update((slot,))
        self.handle.registerTimer(self._end_ms(slot))

    def _rows(self, made: list[tuple], late: bool) -> pd.DataFrame:
        k, row, us = zip(*made)
        return pd.DataFrame({"k": k, "row": row, "anchor_us": pd.array(us, dtype="Int64"), "late": late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new, n = {}, 0
        for frame in rows:
            frame = frame[~frame["beat"]]
            frame = frame.assign(slot=frame["us"] // self.slot_us).sort_values("slot", kind="stable")
            behind = self._end_ms(frame["slot"]) <= watermark
            if behind.any():
                own = frame[behind]
                yield self._rows([(k, row, None) for k, row in zip(own["k"].tolist(), own["row"].tolist())], True)
                frame = frame[~behind]
            columns = [frame[c].tolist() for c in ("us", "row", "k")]
            slots, starts = np.unique(frame["slot"].to_numpy(), return_index=True)
            for slot, a, b in zip(slots.tolist(), starts.tolist(), [*starts.tolist()[1:], len(frame)]):
                held = new.setdefault(slot, [[], [], []])
                for mine, column in zip(held, columns):
                    mine += column[a:b]
            n += len(frame)
            if n >= HELD_ROWS:
                self._keep(new)
                new, n = {}, 0
        self._keep(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Judges every slot that the watermark has passed, one after the other."""
        if not self.next.exists() or self._end_ms(self.next.get()[0]) > expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier timer has judged the slot
        watermark = timerValues.getCurrentWatermarkInMs()
        slots = sorted(slot for (slot,) in self.waiting.keys())
        due = [slot for slot in slots if self._end_ms(slot) <= watermark]
        live = dict(zip(*self.live.get())) if self.live.exists() else {}
        made = []
        for slot in due:
            for at, row, k in sorted(zip(*self.waiting.getValue((slot,))), key=lambda r: r[:2]):
                anchor = live.get(k)
                if anchor is None or at > anchor + self.ttl_us:
                    live[k] = at
                    made.append((k, row, at))
            self.waiting.removeKey((slot,))
            if len(made) >= SEND_ROWS:
                yield self._rows(made, False)
                made = []
                # results that no later slot can meet
                live = {k: us for k, us in live.items() if us + self.ttl_us >= (slot + 1) * self.slot_us}
        if made:
            yield self._rows(made, False)
        first = watermark * 1000 // self.slot_us * self.slot_us  # rows before it are late
        live = {k: us for k, us in live.items() if us + self.ttl_us >= first}
        if live:
            self.live.update((list(live), list(live.values())))
        elif self.live.exists():
            self.live.clear()
        if len(due) < len(slots):
            self._wake(slots[len(due)])
        elif live:  # to forget the last results
            self._wake((max(live.values()) + self.ttl_us) // self.slot_us + 1)
        else:
            self.next.clear()

    def close(self) -> None:
        pass


def ttl_requests(
    stream: DataFrame, key: Sequence[str], ts: str, row_id: str, ttl: int = S.CACHE_TTL_SECONDS, late: str = "1 hour",
    slot_seconds: int | None = None, groups: int = KEY_GROUPS,
) -> DataFrame:
    """``key, row_id, anchor_us, late``: the requests that no live earlier result answers, and late ones.

    A request waits until the watermark (newest time less ``late``) has passed its
    slot and is then judged in order of time, ties by id: batches may be cut
    anywhere and rows may come in any order within ``late``. A row of a slot
    that was judged already comes out with ``late`` true and is judged by nobody. A
    row with a null id is a heartbeat: it moves the watermark and is no request.
    The last result of a key is forgotten after its lifetime. A slot takes a sixtieth of a lifetime by default.
    Keys are dealt into ``groups`` that share their state; a checkpoint keeps the number it began with.
    """
    key, slot_seconds = list(key), slot_seconds or max(1, ttl // SLOTS_PER_LIFE)
    use_rocksdb(stream.sparkSession)
    id_type = dict(stream.dtypes)[row_id]
    of_key = stream.select(*key).schema
    # the key as one text: null parts stay apart from others, and numbers stay whole beside them
    # (heartbeats are left to the processor: Spark would take a filter to the rows before the watermark sees them)
    text = F.to_json(F.struct(*key))
    rows = clocked(stream, F.col(ts), late).select(
        F.pmod(F.xxhash64(text), F.lit(groups)).cast("int").alias("g"), text.alias("k"), F.coalesce(F.col(row_id), F.lit("0").cast(id_type)).alias("row"),
        F.col("__us").alias("us"), F.col(row_id).isNull().alias("beat"),
    )
    judged = rows.groupBy("g").transformWithStateInPandas(
        statefulProcessor=FirstRequests(id_type, ttl * 1_000_000, slot_seconds * 1_000_000),
        outputStructType=f"k string, row {id_type}, anchor_us bigint, late boolean", outputMode="Append", timeMode="EventTime",
    )
    return judged.select(F.from_json("k", of_key).alias("k"), "row", "anchor_us", "late").select(
        "k.*", F.col("row").alias(row_id), "anchor_us", "late"
    )


class DuePredictions(StatefulProcessor):
    """Holds each prediction until the clock has passed its due time, then lets it out once.

    Rows come as ``k`` (``p`` and the id, or empty for a tick of the clock), ``due_us``, ``now_us``; a tick goes on at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if not key[0]:
                yield pd.DataFrame({"id": pd.array([None], dtype="string"), "due_us": pd.array([None], dtype="Int64"), "now_us": [int(frame["now_us"].max())]})
            elif not self.due.exists():
                due = int(frame["due_us"].min())
                self.due.update((due,))
                self.handle.registerTimer(due // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (due,) = self.due.get()
        self.due.clear()
        yield pd.DataFrame({"id": [key[0][1:]], "due_us": pd.array([due], dtype="Int64"), "now_us": [timerValues.getCurrentWatermarkInMs() * 1000]})

    def close(self) -> None:
        pass


def due_predictions(predictions: DataFrame, ticks: DataFrame) -> DataFrame:
    """``id due_us now_us``: each prediction when a tick (``now``) has passed its due time, and every tick (null id).

    Streams both: ``predictions`` (``id reference_date horizon``) are read once and wait in
    state with a timer at reference plus horizon, so a tick costs what is due at it.
    """
    use_rocksdb(predictions.sparkSession)
    due = F.unix_micros(hours_after(F.col("reference_date"), F.col("horizon")).cast("timestamp"))
    zero = F.lit(0).cast("bigint")
    waits = predictions.select(F.concat(F.lit("p"), F.col("id")).alias("k"), due.alias("due_us"), zero.alias("now_us"))
    clock = ticks.select(F.lit("").alias("k"), zero.alias("due_us"), F.unix_micros(F.col("now").cast("timestamp")).alias("now_us"))
    both = waits.unionByName(clock).where("k IS NOT NULL AND due_us IS NOT NULL AND now_us IS NOT NULL")
    rows = clocked(both, F.timestamp_micros("now_us"), "0 seconds").select("k", "due_us", "now_us")
    return rows.groupBy("k").transformWithStateInPandas(
        statefulProcessor=DuePredictions(), outputStructType="id string, due_us bigint, now_us bigint", outputMode="Append", timeMode="EventTime"
    )
