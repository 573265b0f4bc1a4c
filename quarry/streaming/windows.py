"""Count windows — emit every ``size`` messages, never a partial window.

Stream form: ``applyInPandasWithState`` keyed by a shard column. The state of
a key is its buffer of not-yet-emitted messages plus the next window number;
each trigger appends the key's new rows (in order-column order), emits full
windows and keeps the remainder. With one shard (a constant key) this is the
global window of the reference — one task; choose a shard key (e.g. a hash of
the message id into ``shards`` buckets) to spread the work, with windows then
counted per shard.

``count_windows_state`` is the same on the arbitrary-state API, with list state,
a timer that empties idle shards, and a way to deal what they held anew.

Batch form: a global ordinal over the order key (range partitions, no
single-partition window), ``window = (ordinal - 1) // size``, incomplete last
window dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quarry.operators.corpus import global_ordinal


def count_windows(df: DataFrame, size: int, order_cols, shard_col: str | None = None) -> DataFrame:
    """Batch twin: ``df`` plus ``window_id`` and ``pos`` (0-based) for rows of
    full windows only; per shard when ``shard_col`` is given."""
    order_cols = list(order_cols)
    if shard_col is None:
        o = global_ordinal(df, [F.col(c) for c in order_cols], out="_o")
        n = o.count()
        full = (n // size) * size
        return (o.filter(F.col("_o") <= full)
                .withColumn("window_id", F.floor((F.col("_o") - 1) / size).cast("long"))
                .withColumn("pos", ((F.col("_o") - 1) % size).cast("int")).drop("_o"))
    from pyspark.sql import Window
    w = Window.partitionBy(shard_col).orderBy(*order_cols)
    o = df.withColumn("_o", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(shard_col)))
    return (o.filter(F.col("_o") <= F.floor(F.col("_n") / size) * size)
            .withColumn("window_id", F.floor((F.col("_o") - 1) / size).cast("long"))
            .withColumn("pos", ((F.col("_o") - 1) % size).cast("int")).drop("_o", "_n"))


OUT = "shard string, window_id long, pos int, id string, text string"
#: ``window_id`` of rows that an idle shard gives up, to be dealt to other shards.
HANDED_BACK = -1
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class CountWindows(StatefulProcessor):
    """State of a shard: the messages of its open window, at most ``size - 1``, and the number of the next window."""

    def __init__(self, size: int, order_col: str, id_col: str, text_col: str, idle_ms: int | None):
        self.size, self.order_col, self.id_col, self.text_col = size, order_col, id_col, text_col
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id string, text string")
        self.next = handle.getValueState("next", "window long")

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        window = self.next.get()[0] if self.next.exists() else 0
        batch = pd.concat(list(rows)).sort_values(self.order_col, kind="stable")
        held += list(zip(batch[self.id_col].astype(str), batch[self.text_col], strict=True))
        full = len(held) // self.size * self.size
        self.open.clear()
        if held[full:]:
            self.open.put(held[full:])
        self.next.update((window + full // self.size,))
        if self.idle_ms is not None:  # one timer, moved on by every arrival
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame([(key[0], window + i // self.size, i % self.size, *held[i]) for i in range(full)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """An idle shard gives its open messages back and forgets them; its windows go on counting."""
        held = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        self.open.clear()
        yield self._frame([(key[0], HANDED_BACK, i, *m) for i, m in enumerate(held)])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows):
        return pd.DataFrame(rows, columns=["shard", "window_id", "pos", "id", "text"]).astype(
            {"window_id": "int64", "pos": "int32"})


def count_windows_state(stream: DataFrame, size: int, order_col: str, id_col: str, text_col: str, shard_col: str,
                        idle_ms: int | None = None) -> DataFrame:
    """W3 on the arbitrary-state API: ``(shard, window_id, pos, id, text)`` rows of full windows.

    A shard that gets nothing for ``idle_ms`` hands its open messages back as rows of window ``HANDED_BACK``; see
    :func:`reshard`. The session needs the state store of :data:`STATE_STORE`.
    """
    rows = stream.select(F.col(shard_col).cast("string").alias("_shard"), order_col, id_col, text_col)
    return rows.groupBy("_shard").transformWithStateInPandas(
        CountWindows(size, order_col, id_col, text_col, idle_ms), outputStructType=OUT, outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime")


def reshard(handed_back: DataFrame, shards: int) -> DataFrame:
    """Messages that idle shards gave back, dealt to fewer shards by a hash of their id: ``shard, id, text``."""
    return handed_back.filter(F.col("window_id") == HANDED_BACK).select(
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("string").alias("shard"), "id", "text")


def count_windows_stream(stream: DataFrame, size: int, order_col: str, id_col: str, text_col: str,
                         shard_col: str) -> DataFrame:
    """Stream form: ``(shard, window_id, pos, id, text)`` rows of full windows."""
    out_schema = f"shard string, window_id long, pos int, id string, text string"
    state_schema = "ids array<string>, texts array<string>, next_window long"

    def step(key, pdfs, state):
        if state.exists:
            ids, texts, nxt = state.get
            ids, texts = list(ids), list(texts)
        else:
            ids, texts, nxt = [], [], 0
        new = [p for p in pdfs]
        if new:
            batch = pd.concat(new).sort_values(order_col, kind="stable")
            ids += batch[id_col].astype(str).tolist()
            texts += batch[text_col].tolist()
        full = len(ids) // size * size
        rows = [(str(key[0]), nxt + i // size, i % size, ids[i], texts[i]) for i in range(full)]
        state.update((ids[full:], texts[full:], nxt + full // size))
        yield pd.DataFrame(rows, columns=["shard", "window_id", "pos", "id", "text"])

    s = stream.select(F.col(shard_col).cast("string").alias("_shard"), order_col, id_col, text_col)
    return s.groupBy("_shard").applyInPandasWithState(step, out_schema, state_schema, "append",
                                                      GroupStateTimeout.NoTimeout)
