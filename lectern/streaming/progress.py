"""Structured Streaming twins of the progress and rate operators."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.progress import admit, settled_tokens
from lectern.sources.store import KeyedStore


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rate_windows(events: DataFrame, late: str = "2 minutes", length: str = "60 seconds", slide: str = "30 seconds") -> DataFrame:
    """(user_id, start, requests, tokens) of sliding windows; rows later than the watermark are dropped by the engine."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length, slide).alias("w"))
    return own.agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens")).select("user_id", F.col("w.start").alias("start"), "requests", "tokens")


def daily_quota(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(user_id, day, used): the state of a day is dropped once the watermark has passed it."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("w"))
    return own.agg(F.sum("tokens").alias("used")).select("user_id", F.to_date("w.start").alias("day"), "used")


def latest_progress(events: DataFrame) -> DataFrame:
    """(session_id, key, value, deleted): the last value of each key so far, for update or complete mode."""
    at = F.struct("ts", "ord")
    return events.groupBy("session_id", "key").agg(F.max_by("value", at).alias("value"), F.max_by("deleted", at).alias("deleted"))


def session_progress(events: DataFrame) -> DataFrame:
    """(session_id, entries, status, bookmark) of each session that a batch of ``operators.progress`` events touches, in update mode.

    A session's state is a map of its keys to the event of the largest (ts, ord), deletes included, so late rows and repeated ones
    change nothing and a delete holds against older values. entries (map) are the values that are left; completion wins
    and clears the bookmark, 0 is a bookmark.
    """

    def run(key, batches, state):
        held = json.loads(state.get[0]) if state.exists else {}
        for pdf in batches:
            for k, value, deleted, at, order in zip(pdf["key"], pdf["value"], pdf["deleted"], pdf["at"], pdf["ord"], strict=True):
                k = "bookmark" if k == "bookmark_word_index" else k
                if k not in held or [int(at), int(order)] > held[k][:2]:
                    held[k] = [int(at), int(order), None if value is None or value != value else value, bool(deleted)]
        state.update((json.dumps(held),))
        left = {k: v for k, (_, _, v, deleted) in sorted(held.items()) if not deleted}
        yield pd.DataFrame({"session_id": [key[0]], "entries": [json.dumps(left)]})

    rows = events.select("session_id", "key", "value", "deleted", "ord", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    held = rows.groupBy("session_id").applyInPandasWithState(run, "session_id string, entries string", "held string", "update", "NoTimeout")
    entries = F.from_json("entries", "map<string, string>")
    done = F.coalesce(F.try_element_at(entries, F.lit("completed")) == "true", F.lit(False))
    mark = F.try_element_at(entries, F.lit("bookmark")).try_cast("int")
    status = F.when(done, "complete").when(mark.isNotNull(), "in-progress").otherwise("none")
    return held.select("session_id", entries.alias("entries"), status.alias("status"), F.when(~done, mark).alias("bookmark"))


def keep_progress(events: DataFrame, store: KeyedStore, checkpoint: str) -> StreamingQuery:
    """Runs ``session_progress`` over what is there and keeps each session's last row in ``store`` (keyed by session_id).

    A batch is a whole state of its sessions, so one that is written again after a restart changes nothing.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            store.upsert(rows)

    return session_progress(events).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dwell(events: DataFrame, seconds: float = 3.0, late: str = "10 seconds") -> DataFrame:
    """(user_id, ord, ts, done) of a stream of views (user_id, ts, ord): whether a view lasted ``seconds`` or more before the user's next one.

    A view is decided as soon as the next one is known to be too near, or by a timer once the watermark (``late`` behind the newest
    view) has passed its time, so the last view of a user completes too. Until then views are held, so rows that come out of order within
    ``late`` are judged as a batch would; what comes later is dropped. Rows of one time follow each other by ord.
    """
    need = int(seconds * 1_000_000)

    def run(key, batches, state):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            held += list(zip(pdf["at"].tolist(), pdf["ord"].tolist(), strict=True))
        held.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        out, rest = [], []
        for i, (at, order) in enumerate(held):
            following = held[i + 1][0] if i + 1 < len(held) else None
            if following is not None and following - at < need:
                out.append((order, at, False))
            elif passed >= at + need:
                out.append((order, at, True))
            else:
                rest.append((at, order))
        if rest:
            state.update(([a for a, _ in rest], [o for _, o in rest]))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (rest[0][0] + need) // 1000))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"user_id": [key[0]] * len(out), "ord": [o for o, _, _ in out], "at": [a for _, a, _ in out], "done": [d for _, _, d in out]})

    kind = events.schema["user_id"].dataType.simpleString()
    rows = events.withWatermark("ts", late).select("user_id", "ts", F.col("ord").cast("long").alias("ord"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = rows.groupBy("user_id").applyInPandasWithState(run, f"user_id {kind}, ord long, at long, done boolean", "times array<long>, orders array<long>", "append", "EventTimeTimeout")
    return out.select("user_id", "ord", F.timestamp_micros("at").alias("ts"), "done")


def settled(requests: DataFrame, reports: DataFrame, within: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """``operators.progress.settled`` over two streams: a request waits for its report until the watermarks have passed its time, then counts as estimated.

    Both sides' state goes with the watermark: requests after ``within``, reports that no request can meet any more.
    """
    return settled_tokens(requests.withWatermark("ts", late), reports.withWatermark("reported", late), within)


def admissions(events: DataFrame, rpm: int, tpm: int, seconds: float = 60) -> DataFrame:
    """(key_id, ord, admitted) of a stream of (key_id, ord, ts, tokens): each key keeps its requests of the last minute as state."""
    def run(key, batches, state):
        recent = list(zip(*state.get, strict=True)) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["at", "ord"])
        out = []
        for at, n in zip(pdf["at"], pdf["tokens"], strict=True):
            ok, recent = admit(recent, float(at), int(n), rpm, tpm, seconds)
            out.append(ok)
        state.update(([t for t, _ in recent], [n for _, n in recent]))
        yield pd.DataFrame({"key_id": key[0], "ord": pdf["ord"], "admitted": out})

    rows = events.select("key_id", "ord", "tokens", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return rows.groupBy("key_id").applyInPandasWithState(run, "key_id string, ord long, admitted boolean", "times array<double>, tokens array<long>", "append", "NoTimeout")


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result; for tests and backfills."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
