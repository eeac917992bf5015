"""Streaming forms of the batch operators: sessions by time gap, throughput windows, incremental annotation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def _watermarked(items: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, which takes times with a zone only: others are read in the session's."""
    return items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if items.isStreaming else items


def sessions(items: DataFrame, gap: str = "6 hours", late: str = "1 hour", by: str = "person") -> DataFrame:
    """by, start, end, n: sessions with no gap above gap; rows later than the watermark are dropped. Works on streams and on tables."""
    s = _watermarked(items, late)
    return s.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def throughput(items: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, n, latest for each tumbling window."""
    s = _watermarked(items, late)
    return s.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("latest")).select(F.col("w.start").alias("start"), "n", "latest")


def annotate(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs step over what is new and stops; each micro-batch is written under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_sessions(items: DataFrame, gap_s: float = 21_600, late: str = "1 hour", by: str = "person") -> DataFrame:
    """by, start, end, n of a stream (by, ts), with the open sessions of each by as state: a session comes out once, when the watermark has passed its end by more than the gap.

    Rows at or behind the watermark are late and dropped. A by's open sessions are held as starts, ends and counts, never
    as rows. Null keys are a key, null times are dropped. A query that is started again on its checkpoint goes on with the open sessions.
    """
    kind, gap = dict(items.dtypes)[by], int(gap_s * 1000)
    rows = items.select(by, F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)

    def step(key, frames, state):
        starts, ends, counts = (list(x) for x in state.get) if state.exists else ([], [], [])
        now = state.getCurrentWatermarkMs()
        for frame in frames:
            ts = np.sort(frame["ms"].to_numpy(np.int64))
            ts = ts[ts > now]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(ts) > gap) + 1, [len(ts)]))
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if z > a:
                    starts.append(int(ts[a]))
                    ends.append(int(ts[z - 1]))
                    counts.append(int(z - a))
        order, merged = sorted(range(len(starts)), key=lambda i: starts[i]), []
        for i in order:
            if merged and starts[i] - merged[-1][1] <= gap:
                merged[-1] = [merged[-1][0], max(merged[-1][1], ends[i]), merged[-1][2] + counts[i]]
            else:
                merged.append([starts[i], ends[i], counts[i]])
        closed = [m for m in merged if m[1] + gap < now]
        still = [m for m in merged if m[1] + gap >= now]
        if still:
            state.update(tuple([m[k] for m in still] for k in range(3)))
            state.setTimeoutTimestamp(max(min(m[1] for m in still) + gap, now + 1))
        else:
            state.remove()
        if closed:
            yield pd.DataFrame({by: [key[0]] * len(closed), "start": pd.to_datetime([m[0] for m in closed], unit="ms", utc=True), "end": pd.to_datetime([m[1] for m in closed], unit="ms", utc=True), "n": np.array([m[2] for m in closed], np.int64)})

    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, start timestamp, end timestamp, n long", "starts array<long>, ends array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


#: Buckets of assets that finalised_assets keeps one state each for.
BUCKETS = 1024


def _merged(ids: pd.Series, first: np.ndarray, *tiers: np.ndarray) -> tuple:
    """One entry for each id: the least first, all bits of tiers."""
    code, names = pd.factorize(ids)
    order = np.argsort(code, kind="stable")
    start = np.searchsorted(code[order], np.arange(len(names)))
    if not len(names):
        return (ids, first, *tiers)
    return (pd.Series(names), np.minimum.reduceat(first[order], start), *(np.bitwise_or.reduceat(t[order], start) for t in tiers))


def finalised_assets(status: DataFrame, tiers: tuple[str, ...], wait_s: float = 86_400, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """id, outcome, missing of a stream of tier reports (id, tier, ok, ts): done or failed once every tier has reported, incomplete once the watermark has passed the first report by more than wait_s.

    A tier that failed counts as failed even if it reports again. Each asset comes out once: reports after that open it anew. Other tiers, null ids and times are dropped.
    Assets are dealt to buckets by hash, and the open ones of a bucket are one state, worked on together: a call for each asset
    costs far more than its rows. The number of buckets belongs to a query's checkpoint. There can be up to 62 tiers.
    """
    kind, wait, everything = dict(status.dtypes)["id"], int(wait_s * 1000), (1 << len(tiers)) - 1
    bits = {t: 1 << i for i, t in enumerate(tiers)}
    rows = status.select("id", "tier", "ok", F.col("ts").cast("timestamp").alias("ts")).where(F.col("tier").isin(*tiers) & F.col("id").isNotNull() & F.col("ts").isNotNull()).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)

    def step(key, frames, state):
        now = state.getCurrentWatermarkMs()
        held = tuple(pd.Series(x) if i == 0 else np.array(x, np.int64) for i, x in enumerate(state.get)) if state.exists else None
        for frame in frames:
            frame = frame[frame["ms"].to_numpy(np.int64) > now]
            if len(frame):
                bit, ok = frame["tier"].map(bits).to_numpy(np.int64), frame["ok"].eq(True).to_numpy(bool)
                new = frame["id"], frame["ms"].to_numpy(np.int64), np.where(ok, bit, 0), np.where(ok, 0, bit)
                held = _merged(*(new if held is None else (pd.concat([held[0], new[0]]), *map(np.concatenate, zip(held[1:], new[1:], strict=True)))))
        if held is None:
            return
        ids, first, good, bad = held
        ids, got = ids.to_numpy(), good | bad
        out = (got == everything) | (first + wait < now)
        if out.all():
            if state.exists:
                state.remove()
        else:
            still = ~out
            state.update((ids[still].tolist(), *(x[still].tolist() for x in (first, good, bad))))
            state.setTimeoutTimestamp(max(int(first[still].min()) + wait, now + 1))
        if out.any():
            lacking, which = np.unique(everything & ~got[out], return_inverse=True)
            missing = np.array([",".join(t for t in tiers if m & bits[t]) for m in lacking.tolist()], object)[which]
            yield pd.DataFrame({"id": ids[out], "outcome": np.where(missing != "", "incomplete", np.where(bad[out] != 0, "failed", "done")), "missing": missing})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInPandasWithState(step, f"id {kind}, outcome string, missing string", f"ids array<{kind}>, first array<long>, good array<long>, bad array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def to_folder(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over what is there and stops; rows are appended to Parquet, each once, however often it is started on its checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
