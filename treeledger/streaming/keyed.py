"""Arrival streams with state per key: outcomes and counters, bursts, settling, silence.

State lives in Spark's state store, so a micro-batch reads the keys it touches and no history.
``outcomes`` keeps a counter per archive and the trees of an artifact, entry by entry;
``counters`` reads the counters out of the store as they are, with nothing to merge.

Bursts, settling and silence must see a key's rows in order of event time. They hold rows back until
the watermark has passed them (``InOrder``), then apply the rule of their batch twin in
``operators.arrivals``, and set timers for what happens when nothing more arrives. Timers follow the
watermark, which stands still when all sources do; ``ticking`` lets a clock stream move it on.

A micro-batch's rows of one key are held in memory; bound micro-batches by the source's
``maxFilesPerTrigger`` or the like. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..options import ArrivalOptions

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTER = "first_seen timestamp, last_seen timestamp, times_seen bigint, source_name string"


def with_store(spark: SparkSession) -> None:
    """Chooses the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Counted(StatefulProcessor):
    """Per archive: how often and when it came. Rows pass on with ``is_duplicate``."""

    def __init__(self, source: str, order: tuple[str, str]):
        self.source, self.order = source, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", COUNTER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        known = self.counter.get() if self.counter.exists() else None
        ts = batch[self.order[0]]
        first, last, source = ts.min(), ts.max(), batch[self.source].iloc[0]
        if known:
            first, last, source = min(first, pd.Timestamp(known[0])), max(last, pd.Timestamp(known[1])), known[3]
        self.counter.update((first.to_pydatetime(), last.to_pydatetime(), (known[2] if known else 0) + len(batch), source))
        yield batch.assign(is_duplicate=[known is not None] + [True] * (len(batch) - 1))

    def close(self) -> None:
        pass


class Numbered(StatefulProcessor):
    """Per artifact: the trees it has had and their numbers. Rows get ``status`` and ``seq``."""

    def __init__(self, order: tuple[str, str]):
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trees = handle.getMapState("trees", "tree_key string", "seq bigint")
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last = self.last.get()[0] if self.last.exists() else 0
        before, found, status, seq = last, {}, [], []
        for tree, duplicate in zip(batch["tree_key"].astype(str), batch["is_duplicate"], strict=True):
            if duplicate:
                status.append("duplicate-download")
                seq.append(None)
                continue
            if tree not in found:
                found[tree] = self.trees.getValue((tree,))[0] if self.trees.containsKey((tree,)) else None
            status.append("unchanged" if found[tree] else "new")
            if not found[tree]:
                last += 1
                found[tree] = last
                self.trees.updateValue((tree,), (last,))
            seq.append(found[tree])
        if last != before:
            self.last.update((last,))
        yield batch.drop(columns="is_duplicate").assign(status=status, seq=pd.array(seq, "Int64"))

    def close(self) -> None:
        pass


def outcomes(arrivals: DataFrame, source: str = "kind", order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """``arrivals`` (artifact, archive_key, tree_key, ...) with status and seq, as ``history.ingest_outcomes`` gives them.

    Rows of later micro-batches count as later, whatever their times.
    """
    with_store(arrivals.sparkSession)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrivals.schema)
    counted = arrivals.groupBy("archive_key").transformWithStateInPandas(Counted(source, order), f"{columns}, is_duplicate boolean", "Append", "None")
    return counted.groupBy("artifact").transformWithStateInPandas(Numbered(order), f"{columns}, status string, seq bigint", "Append", "None")


def counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """archive_key, first_seen, last_seen, times_seen, source_name as of the last micro-batch of ``outcomes``."""
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorProperties").collect()
    (operator,) = [r.operatorId for r in operators if '"counter"' in (r.operatorProperties or "")]
    stored = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "counter").load(checkpoint)
    return stored.select("key.archive_key", "value.*")


class InOrder(StatefulProcessor):
    """Rows of a key in order of event time, once the watermark has passed them.

    A subclass gives ``step`` (what a row yields and does to the memory), ``deadline`` (when, in milliseconds of
    event time, something is due without a row) and ``expire`` (what is then yielded). Memory is a dictionary.
    Times are kept in microseconds.
    """

    def __init__(self, keys: list[str], types: dict[str, str], out: dict[str, str], ts: str, tie: str):
        self.keys, self.types, self.out, self.ts, self.tie = keys, types, out, ts, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", ", ".join(f"{c} {'bigint' if t.startswith('timestamp') else t}" for c, t in self.types.items()))
        self.memory = handle.getValueState("memory", StructType([StructField("json", StringType())]))

    def step(self, memory: dict, at: int, row: dict) -> Iterator[dict]:
        raise NotImplementedError

    def deadline(self, memory: dict) -> int | None:
        return None

    def expire(self, memory: dict, now: int) -> Iterator[dict]:
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        columns = [[None if pd.isna(v) else v.value // 1000 if isinstance(v, pd.Timestamp) else v for v in batch[c].tolist()] for c in self.types]
        self.pending.appendList(list(zip(*columns, strict=True)))
        self.handle.registerTimer(min(columns[list(self.types).index(self.ts)]) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentWatermarkInMs(), lambda r: r[self.ts]
        rows = [dict(zip(self.types, r, strict=True)) for r in (self.pending.get() if self.pending.exists() else ())]
        due = sorted((r for r in rows if at(r) // 1000 < now), key=lambda r: (at(r), r[self.tie] is not None, r[self.tie]))
        wait = [r for r in rows if at(r) // 1000 >= now]
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        found = []
        for row in due:
            limit = self.deadline(memory)
            if limit is not None and limit * 1000 < at(row):
                found += self.expire(memory, at(row) // 1000)
            found += self.step(memory, at(row), row)
        limit = self.deadline(memory)
        if limit is not None and limit < now:
            found += self.expire(memory, now)
            limit = self.deadline(memory)
        if rows:
            self.pending.put([tuple(r.values()) for r in wait]) if wait else self.pending.clear()
        self.memory.update((json.dumps(memory),))
        if wait:
            self.handle.registerTimer(min(at(r) for r in wait) // 1000 + 1)
        if limit is not None:
            self.handle.registerTimer(limit + 1)
        if found:
            values = [[*key, *(moment(r[c]) if t.startswith("timestamp") else r[c] for c, t in self.out.items())] for r in found]
            frame = pd.DataFrame(values, columns=[*self.keys, *self.out], dtype=object)
            yield frame.astype({c: "datetime64[us]" for c, t in self.out.items() if t.startswith("timestamp")})

    def close(self) -> None:
        pass


def moment(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None else pd.Timestamp(micros, unit="us")


class Burst(InOrder):
    """Rows that follow no other of their key within ``gap`` seconds."""

    gap = 0.0

    def step(self, memory, at, row):
        if "last" not in memory or (at - memory["last"]) / 1e6 >= self.gap:
            yield row
        memory["last"] = at


class Settling(InOrder):
    """The first signature that held for ``stable`` seconds, or that none did within ``give_up``."""

    signature: list[str] = []
    stable = give_up = 0.0

    def verdict(self, memory, accepted):
        memory["done"] = True
        out = {"begun": memory["begun"], "settled_from": memory["from"] if accepted else None}
        return out | {s: memory["signature"][k] if accepted else None for k, s in enumerate(self.signature)}

    def late(self, memory):
        """Whether the run at hand began too late to be accepted."""
        return (memory["from"] - memory["begun"]) / 1e6 + self.stable > self.give_up

    def step(self, memory, at, row):
        if memory.get("done"):
            return
        now = [row[s] for s in self.signature]
        memory.setdefault("begun", at)
        if memory.get("signature") != now:
            memory |= {"signature": now, "from": at}
        memory["last"] = at
        if self.late(memory):
            yield self.verdict(memory, False)
        elif (at - memory["from"]) / 1e6 >= self.stable:
            yield self.verdict(memory, True)

    def deadline(self, memory):
        return None if memory.get("done") or "last" not in memory else int(memory["last"] // 1000 + self.give_up * 1000) + 1

    def expire(self, memory, now):
        yield self.verdict(memory, False)


class Quiet(InOrder):
    """Beats that no other followed within ``stale`` seconds, unless the source had said that it stops."""

    stale = 0.0

    def step(self, memory, at, row):
        memory |= {"last": at, "told": bool(row["stopped"])}
        return iter(())

    def deadline(self, memory):
        return None if "last" not in memory or memory["told"] else int(memory["last"] // 1000 + self.stale * 1000)

    def expire(self, memory, now):
        memory["told"] = True
        yield {"last_beat": memory["last"]}


def _applied(rows: DataFrame, keys: list[str], kind: type[InOrder], read: list[str], out: dict[str, str], ts: str, tie: str, **settings) -> DataFrame:
    with_store(rows.sparkSession)
    types = dict(rows.dtypes)
    processor = kind(keys, {c: types[c] for c in read}, out, ts, tie)
    for name, value in settings.items():
        setattr(processor, name, value)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{c} {t}" for c, t in out.items())])
    return rows.select(*keys, *[F.col(c) for c in read if c not in keys]).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def ticking(rows: DataFrame, ticks: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """Watermarked ``rows`` whose watermark a clock stream (``ts``, say of a rate source) moves on too."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != ts]
    both = rows.withColumn("is_tick_", F.lit(False)).unionByName(ticks.select(F.col(ts), *none).withColumn("is_tick_", F.lit(True)))
    # The second half never holds: a filter that reads the event time stays above the watermark.
    return both.withWatermark(ts, delay).where(~F.col("is_tick_") | (F.col(ts) < F.to_timestamp(F.lit("0001-01-02")))).drop("is_tick_")


def burst_dedup(rows: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id", gap_seconds: float = 300.0) -> DataFrame:
    """``arrivals.burst_dedup`` on a watermarked stream: keys, then all other columns."""
    others = {c: t for c, t in rows.dtypes if c not in keys}
    return _applied(rows, keys, Burst, list(others), others, ts, tie, gap=gap_seconds)


def stable_signatures(rows: DataFrame, keys: list[str], signature: list[str], options: ArrivalOptions = ArrivalOptions(), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``arrivals.stable_signatures`` on a watermarked stream; a key unheard of for ``give_up_seconds`` is given up."""
    types = dict(rows.dtypes)
    out = {"begun": "timestamp", "settled_from": "timestamp"} | {s: types[s] for s in signature}
    return _applied(rows, keys, Settling, [ts, tie, *signature], out, ts, tie, signature=signature, stable=options.stable_seconds, give_up=options.give_up_seconds)


def silences(beats: DataFrame, keys: list[str], stale_seconds: float, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Keys and last_beat of every silence above ``stale_seconds``, the last one included; needs a column ``stopped``."""
    return _applied(beats, keys, Quiet, [ts, tie, "stopped"], {"last_beat": "timestamp"}, ts, tie, stale=stale_seconds)
