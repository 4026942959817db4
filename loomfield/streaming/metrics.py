"""Structured Streaming: watermarked windows, deduplication, stateful detectors, chunked sinks.

Inputs are streaming DataFrames with an event-time column; every operator also takes a batch DataFrame where Spark's
semantics are the same, so a stream's final result can be held against the batch one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet directory as a stream; files_per_trigger bounds a micro-batch, as a memory guard does."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means per key and tumbling window; rows later than `late` behind the watermark are left out."""
    rows = events.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return rows.select(key, F.col("w.start").alias("start"), "n", "mean")


def sliding_counts(events: DataFrame, key: str, ts: str, width: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(ts, late).groupBy(key, F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each id once, as long as its repeats come within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def _stateful(events: DataFrame, key: str, run: Callable, schema: str, state: str, idle: int | None) -> DataFrame:
    """run by key; with idle, the state of a key that has had no event for so many milliseconds (by the clock) goes, and its next event
    starts anew. That is for streams that run on: one with such timeouts never ends by itself under an availableNow trigger."""
    def timed(name, batches: Iterator[pd.DataFrame], held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        yield from run(name, batches, held)
        held.setTimeoutDuration(idle)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy(key).applyInPandasWithState(run if idle is None else timed, schema, state, "append", timeout)


def in_order(rows: DataFrame, key: str, order: str, more: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """A state machine over each key's rows by `order`: step(state, order's value, ...) gives the next state and a row or None.

    Rows come sorted, batch by batch, so that a task holds one batch and one state whatever a key has; a key's rows
    are one task's, as each depends on the one before.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, begun = None, None, False
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            out = []
            for name, *values in zip(*(pdf[c] for c in (key, order, *more)), strict=True):
                same = name == current or (name != name and current != current) or (name is None and current is None)
                if not begun or not same:
                    current, state, begun = name, start(), True
                state, found = step(state, *values)
                if found is not None:
                    out.append((name, *found))
            yield pd.DataFrame(out, columns=names)

    sorted_rows = rows.select(key, order, *more).repartition(key).sortWithinPartitions(key, order, *more)
    return sorted_rows.mapInPandas(run, schema)


def ema_stream(events: DataFrame, key: str, order: str, value: str, span: int = 10, idle: int | None = None) -> DataFrame:
    """(key, order, ema) for every row; the state of a key is its last average, dropped after `idle` milliseconds if given."""
    alpha = 2 / (span + 1)

    def run(name, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value], strict=True):
            last = float(v) if last is None else alpha * float(v) + (1 - alpha) * last
            out.append((name[0], o, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, "ema"])

    kinds = dict(events.dtypes)
    return _stateful(events, key, run, f"{key} {kinds[key]}, {order} {kinds[order]}, ema double", "ema double", idle)


def zscore_stream(events: DataFrame, key: str, order: str, value: str, size: int = 100, least: int = 10, limit: float = 2.5, idle: int | None = None) -> DataFrame:
    """(key, order, z, anomaly) for every row against the last `size` values, itself included; the state is those values, dropped
    after `idle` milliseconds if given."""
    import numpy as np

    def run(name, batches: Iterator[pd.DataFrame], state: GroupState):
        window = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value], strict=True):
            window = [*window[-(size - 1) :], float(v)]
            dev = float(np.std(window))
            z = (float(v) - float(np.mean(window))) / dev if len(window) >= least and dev > 0 else 0.0
            out.append((name[0], o, z, abs(z) >= limit))
        state.update((window,))
        yield pd.DataFrame(out, columns=[key, order, "z", "anomaly"])

    kinds = dict(events.dtypes)
    return _stateful(events, key, run, f"{key} {kinds[key]}, {order} {kinds[order]}, z double, anomaly boolean", "window array<double>", idle)


def price_change_stream(snapshots: DataFrame, item: str, order: str, price: str, idle: int | None = None) -> DataFrame:
    """(item, order, before, after) whenever a price differs from the last one; the state is the last price, dropped after
    `idle` milliseconds if given."""

    def run(name, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, p in zip(rows[order], rows[price], strict=True):
            if last is not None and p != last:
                out.append((name[0], o, last, float(p)))
            last = float(p)
        state.update((last,))
        yield pd.DataFrame(out, columns=[item, order, "before", "after"])

    kinds = dict(snapshots.dtypes)
    return _stateful(snapshots, item, run, f"{item} {kinds[item]}, {order} {kinds[order]}, before double, after double", "price double", idle)


def _alerts(name, rows: pd.DataFrame, sent: list[float], key: str, seconds: str, cooldown: float, hourly: int):
    out = []
    for t in sorted(rows[seconds]):
        recent = [s for s in sent if t - s < 3600]
        if (not sent or t - sent[-1] >= cooldown) and len(recent) < hourly:
            sent = [*recent, t]
            out.append((name[0], t))
    return sent, pd.DataFrame(out, columns=[key, seconds])


def alerts(events: DataFrame, key: str, seconds: str, cooldown: float = 300, hourly: int = 10, idle: int | None = None) -> DataFrame:
    """(key, seconds) of the events that raise an alert: not within the cooldown of the last one, nor over the hourly number.

    Streaming or batch; a key's state is the times of its last hour of alerts.
    """
    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {seconds} double"
    if events.isStreaming:
        def run(name, batches: Iterator[pd.DataFrame], state: GroupState):
            sent, out = _alerts(name, pd.concat(list(batches)), list(state.get[0]) if state.exists else [], key, seconds, cooldown, hourly)
            state.update((sent,))
            yield out

        return _stateful(events, key, run, schema, "sent array<double>", idle)

    def step(sent: list[float], t: float):
        recent = [x for x in sent if t - x < 3600]
        if (not sent or t - sent[-1] >= cooldown) and len(recent) < hourly:
            return [*recent, t], (t,)
        return sent, None

    return in_order(events.withColumn(seconds, F.col(seconds).cast("double")), key, seconds, [], list, step, schema)


def circuit_breaker(calls: DataFrame, key: str, order: str, ok: str, failures: int = 5, wait: float = 60.0) -> DataFrame:
    """(key, order, state) after each call: closed, open after so many failures in a row, half_open once `wait` has passed."""
    kinds = dict(calls.dtypes)

    def step(held: tuple, t: float, good: bool):
        state, bad, since = held
        if state == "open" and t - since >= wait:
            state = "half_open"
        if state != "open":
            bad = 0 if good else bad + 1
            if good:
                state = "closed"
            elif state == "half_open" or bad >= failures:
                state, since = "open", t
        return (state, bad, since), (t, state)

    return in_order(calls, key, order, [ok], lambda: ("closed", 0, 0.0), step, f"{key} {kinds[key]}, {order} {kinds[order]}, state string")


def token_bucket(requests: DataFrame, key: str, seconds: str, rate: float = 1.0, capacity: float = 10.0) -> DataFrame:
    """(key, seconds, allowed) of requests in order against a bucket that fills at `rate` a second."""
    kinds = dict(requests.dtypes)

    def step(held: tuple, t: float):
        level, last = held
        level = min(capacity, level + (t - last) * rate) if last is not None else level
        allowed = level >= 1
        return (level - allowed, t), (t, bool(allowed))

    return in_order(requests, key, seconds, [], lambda: (capacity, None), step, f"{key} {kinds[key]}, {seconds} {kinds[seconds]}, allowed boolean")


def sliding_limit(requests: DataFrame, key: str, seconds: str, most: int = 60, window: float = 60.0) -> DataFrame:
    """(key, seconds, allowed) of requests in order: refused while `most` have been allowed within the window before; the state is
    the times of these."""
    from collections import deque

    kinds = dict(requests.dtypes)

    def step(held: deque, t: float):
        while held and t - held[0] >= window:
            held.popleft()
        allowed = len(held) < most
        if allowed:
            held.append(t)
        return held, (t, allowed)

    return in_order(requests, key, seconds, [], deque, step, f"{key} {kinds[key]}, {seconds} {kinds[seconds]}, allowed boolean")


def filtered_sink(stream: DataFrame, tests: list[Column], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands every micro-batch's rows that pass all tests to write(batch, id), resuming from checkpoint."""
    from functools import reduce

    kept = stream.filter(reduce(lambda a, b: a & b, tests)) if tests else stream
    return kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and returns its rows; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
