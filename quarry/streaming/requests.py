"""Request-log analytics, batch and Structured Streaming.

A request log is ``(ts TIMESTAMP, client, status INT, latency_ms DOUBLE,
...)``. Every operator has a batch form (plain DataFrame) and, where it
makes sense, a streaming form over ``readStream`` that produces the same
rows on the same input (watermark + windowed aggregation, or keyed state).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.config import DEFAULTS
from quarry.functions.text import query_hash
from quarry.session import cut_lineage
from quarry.streaming import bucket

# fixed values: latency histogram bucket bounds in seconds
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def _micros(ts: Column) -> Column:
    """Event time as integer microseconds: gaps are exact integers and only
    the gap is converted to seconds (epoch seconds in a double lose ~1e-7 s)."""
    return F.unix_micros(ts.cast("timestamp"))


# ------------------------------------------------------------ R1 / R2 / R7

TOKEN_SCHEMA = ("client bigint, event_id bigint, ts timestamp, allowed boolean, "
                "tokens double, retry_after double")


def token_bucket(events: DataFrame, rpm: float = DEFAULTS.requests_per_minute, burst: int = DEFAULTS.burst,
                 idle_seconds: float | None = DEFAULTS.bucket_idle_seconds, client_col: str = "client",
                 ts_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """R1 (+R2) batch form: per request, whether the client's token bucket
    allows it, the tokens left and the retry delay when refused.

    A bucket starts full (``burst``), refills ``rpm/60`` tokens per second up
    to ``burst`` and each request takes one. An idle bucket (no request for
    more than ``idle_seconds``) is dropped, so the next request starts full
    (state TTL replaces the reference's bucket-count cap). Requests without a client
    share a bucket; those without a time come first, at time 0.

    The log is range-partitioned and sorted on (client, time, id) and written
    once, so a client, however busy, spans many tasks. Each partition first
    sums up what it does to the tokens that its first request finds (see
    ``bucket``); the driver composes one such row per partition, and each
    partition then decides its requests from the tokens it starts with. Nothing
    is sequential but that prefix, and all arithmetic is exact.
    """
    spark = events.sparkSession
    r = bucket.rules(rpm, burst, idle_seconds)
    us = F.coalesce(_micros(F.col(ts_col)), F.lit(0).cast("long"))
    e = events.select(F.col(client_col).cast("bigint").alias("client"), us.alias("us"), F.col(id_col).cast("bigint").alias("event_id"))
    # null clients and ids are set apart by a column of their own, so that the arrays hold whole numbers
    e = e.select((F.coalesce("client", F.lit(0)) * 1).alias("client"), F.col("client").isNull().alias("no_client"), "us", "event_id")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["no_client", "client", "us", "event_id"]
    log = e.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    log = cut_lineage(log.withColumn("part", F.spark_partition_id()))

    def columns(block):
        no_client, client, us = block[:3]
        # one number a client: changes of no_client are changes of client
        return np.where(no_client, np.iinfo(np.int64).min, client), us

    def sum_up(batches):
        first = last = f = part = None
        for block in bucket.blocks(batches, ["no_client", "client", "us", "part"]):
            client, us = columns(block)
            f = bucket.through(client, us, last, f, r)
            first = (int(client[0]), int(us[0])) if first is None else first
            last, part = (int(client[-1]), int(us[-1])), int(block[3][0])
        if f is not None:
            lo, left, same = zip(*f)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x], pa.int64()) for x in (*first, *last)],
                                              pa.array([list(lo)], pa.list_(pa.int64())), pa.array([list(left)], pa.list_(pa.int64())), pa.array([list(same)], pa.list_(pa.bool_()))],
                                             names=["part", "client", "us", "last_client", "last_us", "lo", "left", "same"])

    sums = log.mapInArrow(sum_up, "part int, client long, us long, last_client long, last_us long, lo array<long>, left array<long>, same array<boolean>").collect()
    start, before, x = {}, None, r.cap
    for s in sorted(sums, key=lambda s: s["part"]):  # one row a partition
        start[s["part"]] = (before, x)
        at_hand = r.cap
        if before is not None and before[0] == s["client"] and not r.resets(s["us"] - before[1]):
            at_hand = min(r.cap, x + (s["us"] - before[1]) * r.step)
        x = bucket.value(list(zip(s["lo"], s["left"], s["same"])), at_hand)
        before = (s["last_client"], s["last_us"])
    shared = spark.sparkContext.broadcast(start)

    def decide(batches):
        state = None
        for block in bucket.blocks(batches, ["no_client", "client", "us", "part", "event_id", "no_id"]):
            client, us = columns(block)
            before, x = shared.value[int(block[3][0])] if state is None else state
            passed, left = bucket.decide(client, us, before, x, r)
            state = (int(client[-1]), int(us[-1])), int(left[-1])
            retry = np.where(passed, np.nan, (r.unit - left) / r.step / 1e6)
            yield pa.RecordBatch.from_arrays([pa.array(block[1], pa.int64(), mask=block[0]), pa.array(block[4], pa.int64(), mask=block[5]), pa.array(us, pa.timestamp("us", "UTC")),
                                              pa.array(passed), pa.array(left / r.unit), pa.array(retry, mask=passed)],
                                             names=["client", "event_id", "ts", "allowed", "tokens", "retry_after"])

    return (log.select("no_client", "client", "us", "part", F.coalesce("event_id", F.lit(0)).alias("event_id"), F.col("event_id").isNull().alias("no_id"))
            .mapInArrow(decide, TOKEN_SCHEMA))


class _BucketOfClient(StatefulProcessor):
    """One client's bucket: units left, time of its last request, and the timer that drops it."""

    def __init__(self, r: bucket.Rules, evictions: bool):
        self.r, self.evictions = r, evictions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", T.StructType([T.StructField(c, T.LongType()) for c in ("units", "last", "timer")]))

    def dropped(self, client, last: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"client": pd.array([client] * len(last), "Int64"), "event_id": pd.array([None] * len(last), "Int64"),
                             "ts": pd.to_datetime([x + self.r.idle for x in last], unit="us"), "allowed": pd.array([None] * len(last), "boolean"),
                             "tokens": np.nan, "retry_after": np.nan})

    def handleInputRows(self, key, rows, timerValues):
        held = [p for p in rows if len(p)]  # a client's rows of one micro-batch
        if not held:
            return
        p = pd.concat(held).sort_values(["us", "event_id"], kind="stable")
        us, client = p["us"].to_numpy(np.int64), np.zeros(len(p), np.int64)
        units, last, timer = self.state.get() if self.state.exists() else (self.r.cap, None, None)
        before = None if last is None else (0, last)
        if last is not None:
            us = np.maximum(us, last)  # a late one is decided when it comes
        passed, left = bucket.decide(client, us, before, units, self.r)
        yield pd.DataFrame({"client": key[0], "event_id": p["event_id"], "ts": p["ts"], "allowed": passed, "tokens": left / self.r.unit,
                            "retry_after": np.where(passed, np.nan, (self.r.unit - left) / self.r.step / 1e6)})
        if self.r.idle is not None:
            times = us if last is None else np.append(last, us)
            gone = times[:-1][np.diff(times) > self.r.idle]
            if self.evictions and len(gone):
                yield self.dropped(key[0], gone.tolist())
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = int(us[-1] + self.r.idle) // 1000 + 1
            self.handle.registerTimer(timer)
        self.state.update((int(left[-1]), int(us[-1]), timer or 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, last, _ = self.state.get()
        self.state.clear()
        if self.evictions:
            yield self.dropped(key[0], [last])

    def close(self) -> None:
        pass


def token_bucket_stream(events: DataFrame, rpm: float = 100.0, burst: int = 20,
                        idle_seconds: float | None = 600.0, watermark: str = "10 minutes",
                        client_col: str = "client", ts_col: str = "ts", id_col: str = "event_id",
                        evictions: bool = False) -> DataFrame:
    """R1/R2 streaming form: ``transformWithStateInPandas`` keyed by client.

    State is the bucket (whole units, as in ``bucket``), the last event time and a
    timer. Rows of a micro-batch are decided in event-time order, all at once. The
    timer fires when the watermark passes the last request by more than ``idle_seconds``
    and drops the bucket (R2); a request that comes after such a pause, but before
    the watermark has passed it, finds the bucket full as well. With ``evictions``, each
    bucket that goes, either way, gives a row without event_id, at the time it was due.
    A client's rows of one micro-batch are held at once: bound it with ``maxFilesPerTrigger``.

    Needs the RocksDB state store, which is set for the session.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = events.select(F.col(client_col).cast("bigint").alias("client"), F.col(id_col).cast("bigint").alias("event_id"),
                      F.col(ts_col).cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    e = e.withColumn("us", _micros(F.col("ts")))
    return e.groupBy("client").transformWithStateInPandas(
        _BucketOfClient(bucket.rules(rpm, burst, idle_seconds), evictions), T.StructType.fromDDL(TOKEN_SCHEMA), "Append", "eventTime")


def on_time(log: DataFrame, watermark: str, keys: Sequence[str] = ("event_id",), ts_col: str = "ts") -> DataFrame:
    """The rows of a stream that aren't later than its watermark, one for each of ``keys``
    and time. What is later is dropped by Spark and counted in the query's progress."""
    return log.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark).dropDuplicates([*keys, ts_col])


def dropped_by_watermark(query) -> dict[int, int]:
    """Rows that each micro-batch of a query dropped as late, from its progress."""
    progress = {p["batchId"]: p for p in query.recentProgress}
    if progress and (min(progress) > 0 or len(progress) <= max(progress)):
        raise ValueError("the session keeps too few progress updates (spark.sql.streaming.numRecentProgressUpdates)")
    return {k: sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]) for k, p in progress.items()}


def limit_hits(decisions: DataFrame, window: str = "1 hour") -> DataFrame:
    """Refused requests per client per window."""
    return (decisions.filter(~F.col("allowed"))
                     .groupBy(F.window("ts", window).alias("w"), "client")
                     .agg(F.count("*").alias("hits"))
                     .select(F.col("w.start").alias("window_start"), "client", "hits"))


# ------------------------------------------------------------ R3 / R4 / R5

def error_rate(log: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
               watermark: str | None = None) -> DataFrame:
    """Requests, 4xx+5xx ratio and 5xx ratio per sliding window.

    Streaming: pass ``watermark`` (R10: rows later than it are dropped;
    windows are emitted in append mode once the watermark passes them).
    """
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need TIMESTAMP
    src = log.withWatermark("ts", watermark) if watermark else log
    g = src.groupBy(F.window("ts", window, slide).alias("w")).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.count_if(F.col("status") >= 500).alias("server_errors"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "requests", (F.col("errors") / F.col("requests")).alias("error_ratio"),
                    (F.col("server_errors") / F.col("requests")).alias("server_error_ratio"))


def latency_quantiles(log: DataFrame, window: str = "5 minutes", by: Sequence[str] = (),
                      qs: Sequence[float] = (0.5, 0.95, 0.99), exact: bool = True,
                      watermark: str | None = None) -> DataFrame:
    """p50/p95/p99 latency per window: exact ``percentile`` (linear
    interpolation) in batch, ``percentile_approx`` when ``exact=False``
    (streams, where exact percentiles keep every value in state)."""
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    names = [f"p{int(round(q * 100))}" for q in qs]
    if exact and not watermark:
        # batch: exact quantiles by rank positions (sort-based, spills), not
        # an aggregation buffer holding every latency of a window
        from quarry.operators.relational import exact_quantiles
        keyed = log.withColumn("w", F.window("ts", window))
        qv = exact_quantiles(keyed, "latency_ms", ["w", *by], qs, names)
        cnt = keyed.groupBy("w", *by).agg(F.count("*").alias("requests"))
        g = cnt.join(qv, ["w", *by], "left")
        return g.select(F.col("w.start").alias("window_start"), *by, *names, "requests")
    src = log.withWatermark("ts", watermark) if watermark else log
    agg = []
    for q, name in zip(qs, names):
        f = F.percentile("latency_ms", q) if exact else F.percentile_approx("latency_ms", q, 10000)
        agg.append(f.alias(name))
    g = src.groupBy(F.window("ts", window).alias("w"), *by).agg(*agg, F.count("*").alias("requests"))
    return g.select(F.col("w.start").alias("window_start"), *by, *[f"p{int(round(q * 100))}" for q in qs],
                    "requests")


def latency_histogram(log: DataFrame, by: Sequence[str] = (), window: str | None = None,
                      bounds: Sequence[float] = LATENCY_BOUNDS, unit: float = 1000.0,
                      watermark: str | None = None) -> DataFrame:
    """Cumulative ``le`` bucket counts (plus +Inf) of latency in seconds.

    One aggregation with a conditional count per bound (no explode of the
    log), then unpivoted into ``(…, le, count)``.
    """
    lat = F.col("latency_ms") / F.lit(unit)
    if window:
        log = log.withColumn("ts", F.col("ts").cast("timestamp"))
        if watermark:
            log = log.withWatermark("ts", watermark)
    keys = list(by) + ([F.window("ts", window).alias("w")] if window else [])
    aggs = [F.count_if(lat <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count("*").alias("binf")]
    g = log.groupBy(*keys).agg(*aggs)
    pairs = ", ".join([f"{float(b)!r}D, b{i}" for i, b in enumerate(bounds)] + ["double('Infinity'), binf"])
    keep = list(by) + (["w"] if window else [])
    out = g.selectExpr(*keep, f"stack({len(bounds) + 1}, {pairs}) as (le, count)")
    if window:
        out = out.select(F.col("w.start").alias("window_start"), *by, "le", "count")
    return out


def histogram_quantile(hist: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative buckets with linear interpolation inside
    the bucket (Prometheus semantics: the first bucket starts at 0; a rank
    in the +Inf bucket returns the largest finite bound)."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("le")  # one group = a dozen bucket rows
    h = (hist.withColumn("__prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
             .withColumn("__prev_c", F.coalesce(F.lag("count").over(w), F.lit(0)))
             .withColumn("__total", F.max("count").over(Window.partitionBy(*by))))
    h = h.withColumn("__rank", F.lit(q) * F.col("__total"))
    first = (h.filter(F.col("count") >= F.col("__rank"))
              .groupBy(*by).agg(F.min_by(F.struct("le", "__prev_le", "__prev_c", "count", "__rank"), F.col("le")).alias("b")))
    b = F.col("b")
    val = (F.when(b["le"] == float("inf"), b["__prev_le"])
            .when(b["count"] - b["__prev_c"] == 0, b["le"])
            .otherwise(b["__prev_le"] + (b["le"] - b["__prev_le"]) * (b["__rank"] - b["__prev_c"]) / (b["count"] - b["__prev_c"])))
    return first.select(*by, val.alias("value"))


# ---------------------------------------------------------------- R8 / R9

def alerts(metric: DataFrame, threshold: float, hold: int, time_col: str = "window_start",
           value_col: str = "value", by: Sequence[str] = (), above: bool = True) -> DataFrame:
    """An alert fires when the condition holds for ``hold`` consecutive
    evaluation windows (the "for" duration). Gaps-and-islands: a running
    count of non-matching rows identifies each run of matching rows."""
    by = list(by)
    cond = (F.col(value_col) > threshold) if above else (F.col(value_col) < threshold)
    w = Window.partitionBy(*by).orderBy(time_col)
    m = metric.withColumn("__c", cond.cast("int"))
    m = m.withColumn("__island", F.sum(1 - F.col("__c")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hits = m.filter(F.col("__c") == 1)
    # position inside the run: no per-run list is gathered, however long the incident
    hits = hits.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__island").orderBy(time_col)))
    runs = (hits.groupBy(*by, "__island")
                .agg(F.min(time_col).alias("start"), F.max(time_col).alias("end"), F.count("*").alias("length"),
                     F.min(F.when(F.col("__n") == hold, F.col(time_col))).alias("fired_at")))
    return runs.filter(F.col("length") >= hold).select(*by, "start", "fired_at", "end", "length")


def enrich_log(log: DataFrame, query_col: str | None = "query") -> DataFrame:
    """Severity from status (>= 500 error, >= 400 warning, else info),
    hashed query (first 12 hex of SHA-256) and latency."""
    sev = (F.when(F.col("status") >= 500, "error").when(F.col("status") >= 400, "warning").otherwise("info"))
    out = log.withColumn("severity", sev)
    if query_col is not None:
        out = out.withColumn("query_hash", query_hash(query_col))
    return out


def rerank_triggers(gated: DataFrame) -> DataFrame:
    """Rerank-trigger counts by reason (one row per query's decision)."""
    return gated.select("query_id", "reason").distinct().groupBy("reason").agg(F.count("*").alias("queries"))


def alerts_stream(metric: DataFrame, threshold: float, hold: int, time_col: str = "window_start",
                  value_col: str = "value", key_col: str = "series", above: bool = True,
                  watermark: str = "1 hour") -> DataFrame:
    """R8 streaming form: keyed state per series holds the open run (start,
    length); an alert row is emitted once, when the run reaches ``hold``
    consecutive evaluation windows. Rows of a micro-batch are processed in
    time order; the watermark bounds how late a window may arrive."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    m = (metric.withColumn(time_col, F.col(time_col).cast("timestamp"))
               .withWatermark(time_col, watermark)
               .select(F.col(key_col).cast("string").alias("series"), F.col(time_col).alias("t"),
                       F.col(value_col).cast("double").alias("v")))
    out_schema = T.StructType.fromDDL("series string, start timestamp, fired_at timestamp")
    state_schema = T.StructType.fromDDL("start timestamp, length long, fired boolean")

    def fn(key, pdfs, state):
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values("t", kind="stable")
        start, length, fired = state.get if state.exists else (None, 0, False)
        rows = []
        for t, v in zip(pdf["t"], pdf["v"]):
            cond = (v > threshold) if above else (v < threshold)
            if cond:
                if length == 0:
                    start, fired = t, False
                length += 1
                if length >= hold and not fired:
                    rows.append((key[0], start, t))
                    fired = True
            else:
                start, length, fired = None, 0, False
        state.update((start, length, fired))
        if rows:
            yield pd.DataFrame(rows, columns=["series", "start", "fired_at"])

    return m.groupBy("series").applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                      GroupStateTimeout.NoTimeout)
