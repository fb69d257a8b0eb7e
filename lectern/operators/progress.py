"""Reading progress, feed status, rate windows and quotas over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from lectern.sources.store import kept


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def latest(events: DataFrame) -> DataFrame:
    """(session_id, key, value): the last value of each key; a deleted one is gone. Events have ts, ord, deleted."""
    at = F.struct("ts", "ord")
    last = events.groupBy("session_id", F.when(F.col("key") == "bookmark_word_index", "bookmark").otherwise(F.col("key")).alias("key")).agg(
        F.max_by("value", at).alias("value"), F.max_by("deleted", at).alias("deleted")
    )
    return last.filter(~F.col("deleted")).select("session_id", "key", "value")


def feed_status(progress: DataFrame) -> DataFrame:
    """(session_id, status, bookmark): complete wins and clears the bookmark; 0 is a valid bookmark."""
    wide = progress.groupBy("session_id").agg(
        F.max(F.when(F.col("key") == "completed", F.col("value") == "true")).alias("completed"), F.max(F.when(F.col("key") == "bookmark", F.col("value").cast("int"))).alias("bookmark")
    )
    done = F.coalesce("completed", F.lit(False))
    return wide.select(
        "session_id", F.when(done, "complete").when(F.col("bookmark").isNotNull(), "in-progress").otherwise("none").alias("status"), F.when(~done, F.col("bookmark")).alias("bookmark")
    )


def completed_count(status: DataFrame) -> DataFrame:
    return status.agg(F.count_if(F.col("status") == "complete").alias("completed"), F.count(F.lit(1)).alias("total"))


def dwell(events: DataFrame, seconds: float = 3.0, until: Column | None = None) -> DataFrame:
    """``events`` (user_id, ts, ord) with done: the user stayed three seconds or more before the next event.

    The last event has none; it lasts until ``until``, the time up to which is known that nothing followed, or without one is not done.
    """
    nxt = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "ord"))
    nxt = nxt if until is None else F.coalesce(nxt, until)
    return events.withColumn("done", F.coalesce(_micros(nxt) - _micros(F.col("ts")) >= int(seconds * 1_000_000), F.lit(False)))


def rate_window(log: DataFrame, per: list[str], seconds: int = 60) -> DataFrame:
    """``log`` with requests and tokens of the 60 seconds up to each row, both ends included."""
    micros = _micros(F.col("ts"))
    w = W.partitionBy(*per).orderBy("micros").rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("micros", micros).withColumn("requests", F.count(F.lit(1)).over(w)).withColumn("tokens_in_window", F.sum("tokens").over(w)).drop("micros")


def admitted(requests: Column, tokens: Column, rpm: int, tpm: int) -> Column:
    """Whether the row fits its window; a first request always does."""
    return (requests == 1) | ((requests <= rpm) & (tokens <= tpm))


def corrected(log: DataFrame) -> DataFrame:
    """``log`` with the last row of each key set to the tokens that were really used, where known (column actual)."""
    last = F.row_number().over(W.partitionBy("key_id").orderBy(F.desc("ts"), F.desc("ord"))) == 1
    return log.withColumn("last", last).withColumn("tokens", F.when(F.col("last") & F.col("actual").isNotNull(), F.col("actual")).otherwise(F.col("tokens"))).drop("last")


def settled_tokens(requests: DataFrame, reports: DataFrame, within: str = "10 minutes") -> DataFrame:
    """(key_id, request_id, ts, tokens, settled) of requests (key_id, request_id, ts, tokens): the tokens of the request's report (request_id, reported,
    actual) that came at most ``within`` after it, else the estimate. A request has at most one such report."""
    own = reports.select(F.col("request_id").alias("report_id"), "reported", "actual")
    met = (F.col("request_id") == F.col("report_id")) & (F.col("reported") >= F.col("ts")) & (F.col("reported") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return requests.join(own, met, "left_outer").select("key_id", "request_id", "ts", F.coalesce("actual", "tokens").cast("long").alias("tokens"), F.col("report_id").isNotNull().alias("settled"))


def daily_quota(log: DataFrame, limit: int, estimate: int) -> DataFrame:
    """(key_id, day, used, would_exceed) by calendar day."""
    return log.groupBy("key_id", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("used")).withColumn("would_exceed", F.col("used") + estimate > limit)


def _in_turn(n_keys: int, limit: int):
    """Rows (day, ts, ord, tokens) in order, with key and whether the row made another key the current one; only a day's use is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, used, now = object(), [0] * n_keys, 0
        for batch in batches:
            keys, turned = [], []
            for own, tokens in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != day:
                    day, used, now = own, [0] * n_keys, 0
                key = None if tokens is None else next((k for k in (*range(now, n_keys), *range(now)) if used[k] + tokens <= limit), None)
                keys.append(key)
                turned.append(key is not None and key != now)
                if key is not None:
                    used[key] += tokens
                    now = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int32()), pa.array(turned, pa.bool_())], names=["day", "ts", "ord", "tokens", "key", "turned"])

    return run


def assign_keys(log: DataFrame, n_keys: int, limit: int) -> DataFrame:
    """(day, ord, tokens, key): which key takes each request of a day, null where none can.

    The current key takes a request that fits its day's limit; else the next key in turn that can becomes the
    current one. Every day starts anew with key 0 and no use. Requests of equal time and ord go by tokens; one without tokens gets no key.

    Use only grows, so once a request is refused, so are all later ones of its day with as many tokens. Of a day's requests of
    ``t`` tokens each key takes limit / t at most, so only the first ``n_keys * floor(limit / t)`` can get a key: these alone,
    whose number does not grow with the log, go through a fold in order, one task a day. Requests of no tokens use nothing and take the key
    that is the current one at their time. A day in which tokens are given back (negative ones) is folded whole, in a stream.
    """
    spark = log.sparkSession
    rows = log.select(F.to_date("ts").alias("day"), "ts", F.col("ord").cast("bigint").alias("ord"), F.col("tokens").cast("bigint").alias("tokens"))
    back = rows.filter("tokens < 0").select(F.col("day").alias("back_day"), F.lit(True).alias("back")).distinct()
    rows = rows.join(F.broadcast(back), F.col("day").eqNullSafe(F.col("back_day")), "left").drop("back_day").withColumn("back", F.coalesce("back", F.lit(False)))
    most = F.expr(f"{n_keys} * (bigint({limit}) div nullif(tokens, 0))")
    fits = F.coalesce((F.col("tokens") > 0) & (F.col("tokens") <= limit), F.lit(False))
    free = F.coalesce((F.col("tokens") == 0) & F.lit(limit >= 0), F.lit(False))
    kind = F.when(F.col("back"), "fold").when(fits, "rank").when(free, "free").otherwise("none")
    # Ranked in shares first, so that no task takes all requests of a day with as many tokens.
    share = F.pmod(F.xxhash64("ts", "ord"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    rows = rows.withColumns({"kind": kind, "share": share}).drop("back")
    ranked = rows.filter("kind = 'rank'")
    ranked = ranked.withColumn("early", F.row_number().over(W.partitionBy("day", "tokens", "share").orderBy("ts", "ord")) <= most)
    ranked = ranked.withColumn("share", F.when(~F.col("early"), F.col("share")))
    early = F.col("early") & (F.row_number().over(W.partitionBy("day", "tokens", "share").orderBy("ts", "ord")) <= most)
    ranked = kept(ranked.select("day", "ts", "ord", "tokens", early.alias("early")), "ranked-requests")

    own = ["day", "ts", "ord", "tokens"]
    held = ranked.filter("early").select(*own).unionByName(rows.filter("kind = 'fold'").select(*own))
    schema = StructType([*held.schema.fields, StructField("key", IntegerType()), StructField("turned", BooleanType())])
    held = held.repartition("day").sortWithinPartitions(*own).mapInArrow(_in_turn(n_keys, limit), schema)
    held = kept(held, "assigned-requests")
    turns = held.filter("turned").groupBy(F.col("day").alias("turn_day")).agg(F.array_sort(F.collect_list(F.struct("ts", "ord", "tokens", "key"))).alias("turns"))
    freed = rows.filter("kind = 'free'").join(turns, F.col("day").eqNullSafe(F.col("turn_day")), "left")
    here = F.struct("ts", "ord", "tokens")
    before = F.filter("turns", lambda t: F.struct(t["ts"].alias("ts"), t["ord"].alias("ord"), t["tokens"].alias("tokens")) < here)
    freed = freed.withColumn("key", F.coalesce(F.try_element_at(before, F.lit(-1))["key"], F.lit(0)))
    refused = ranked.filter(~F.col("early")).select(*own).unionByName(rows.filter("kind = 'none'").select(*own)).withColumn("key", F.lit(None).cast("int"))
    out = ["day", "ord", "tokens", "key"]
    return held.select(*out).unionByName(freed.select(*out)).unionByName(refused.select(*out))


def progress_events(posts: DataFrame) -> DataFrame:
    """(session_id, key, value, ts, ord, deleted) of posted JSON objects (body, ts, ord), flat or as an envelope of updates.

    In an envelope all keys are set, nulls too; in a flat object a null deletes its key, and bookmark_word_index
    is the bookmark. Posts without a session are refused: they give no row.
    """
    v = posts.withColumns({"session_id": F.get_json_object("body", "$.session_id"), "updates": F.get_json_object("body", "$.updates")})
    v = v.filter("session_id IS NOT NULL AND session_id <> ''").withColumn("flat", F.col("updates").isNull())
    entries = F.map_entries(F.from_json(F.coalesce("updates", "body"), "map<string, string>"))
    rows = v.select("session_id", "ts", "ord", "flat", F.explode(entries).alias("e")).filter(~F.col("flat") | (F.col("e.key") != "session_id"))
    key = F.when(F.col("flat") & (F.col("e.key") == "bookmark_word_index"), "bookmark").otherwise(F.col("e.key"))
    return rows.select("session_id", key.alias("key"), F.col("e.value").alias("value"), "ts", "ord", (F.col("flat") & F.col("e.value").isNull()).alias("deleted"))


def bookmark_events(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bookmark events of posts (body, ts, ord), and the posts that are refused for want of a session or a word index; 0 is an index."""
    v = posts.withColumns({"session_id": F.get_json_object("body", "$.session_id"), "value": F.get_json_object("body", "$.word_index")})
    fine = F.coalesce((F.col("session_id") != "") & F.col("value").isNotNull(), F.lit(False))
    events = v.filter(fine).select("session_id", F.lit("bookmark").alias("key"), "value", "ts", "ord", F.lit(False).alias("deleted"))
    return events, v.filter(~fine).select(*posts.columns)


Recent = list[tuple[float, int]]


def admit(recent: Recent, at: float, tokens: int, rpm: int, tpm: int, seconds: float = 60) -> tuple[bool, Recent]:
    """Whether a request fits the requests still within ``seconds``, and the list after it; one that meets none always does.

    An entry exactly ``seconds`` old still counts.
    """
    recent = [r for r in recent if r[0] >= at - seconds]
    ok = not recent or (len(recent) < rpm and sum(t for _, t in recent) + tokens <= tpm)
    return ok, [*recent, (at, tokens)] if ok else recent


def schedule(times: list[float], tokens: list[int], rpm: int, tpm: int, seconds: float = 60) -> list[float]:
    """When each request goes out if it waits, in order, until it fits."""
    recent: Recent = []
    out: list[float] = []
    for at, n in zip(times, tokens, strict=True):
        at = max(at, out[-1] if out else at)
        while True:
            ok, recent = admit(recent, at, n, rpm, tpm, seconds)
            if ok:
                break
            at = recent[0][0] + seconds + 1e-6
        out.append(at)
    return out


def waits(log: DataFrame, rpm: int, tpm: int, seconds: float = 60) -> DataFrame:
    """(key_id, ord, wait_s): each request's wait; a key's requests follow each other, so one worker takes a key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "ord"])
        sent = schedule(pdf["at"].tolist(), pdf["tokens"].tolist(), rpm, tpm, seconds)
        return pd.DataFrame({"key_id": pdf["key_id"], "ord": pdf["ord"], "wait_s": [round(b - a, 3) for a, b in zip(pdf["at"], sent, strict=True)]})

    rows = log.select("key_id", "ord", "tokens", (_micros(F.col("ts")) / 1_000_000).alias("at"))
    return rows.groupBy("key_id").applyInPandas(run, "key_id string, ord long, wait_s double")
