"""Sources and sinks: stage checkpoints, session exports, static bundles, configuration.

Tables go to any place that Spark can write; a stage counts from the moment that a state file names it.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stages in order.
STAGES = ("Ingest", "Pass1", "Cluster", "Pass2", "GraphBuild", "IndexGen", "AwaitApproval", "SessionGen", "Complete")

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


class QuotaExhausted(Exception):
    """No key has quota left for a request today; a run stops at once."""


class PipelineError(Exception):
    """An error of a stage; ``recoverable`` tells whether the run may go on."""

    def __init__(self, message: str, stage: str = "", recoverable: bool = False):
        super().__init__(f"[{stage}] {message}" if stage else message)
        self.stage, self.recoverable = stage, recoverable


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm.getFileSystem(spark._jsc.hadoopConfiguration()), jvm


def _remove(spark: SparkSession, path: str) -> None:
    fs, jvm = _fs(spark, path)
    fs.delete(jvm, True)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jvm = _fs(spark, path)
    return fs.exists(jvm)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, jvm = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(jvm)) if fs.exists(jvm) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and gives it its own, so that it is there whole or not at all; a file that is there stays.

    Of several writers of one name one succeeds: a local name is linked, elsewhere the file system's rename must not replace.
    """
    fs, final = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(part)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(part.toUri().getPath(), final.toUri().getPath())
        elif fs.exists(final) or not fs.rename(part, final):
            raise FileExistsError(path)
    finally:
        fs.delete(part, False)


def _get(spark: SparkSession, path: str) -> str:
    fs, jvm = _fs(spark, path)
    stream = fs.open(jvm)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def drop_work(since: int = 0) -> None:
    """Removes the work folders that were made after the first ``since``."""
    while len(_made) > since:
        with contextlib.suppress(Exception):
            _remove(*_made.pop())


@contextlib.contextmanager
def spent() -> Iterator[None]:
    """Removes at its end the work folders that were made within."""
    before = len(_made)
    yield
    drop_work(before)


atexit.register(drop_work)


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared one (spark.checkpoint.dir); it is removed when the driver process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    path = f"{base.rstrip('/')}/lectern-{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once in the shared folder and read back, for loops and reuse."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class StateLog:
    """A small JSON state in numbered files below ``base``; the last one counts.

    A change is computed from the last state and written under the next number. If another writer was there first,
    the change is computed anew from what that one wrote, so no change of several writers is lost.
    """

    spark: SparkSession
    base: str
    empty: dict
    #: Former states that stay, for writers that are that far behind; attempts of a change.
    KEPT, TRIES = 32, 100

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in _names(self.spark, self.base) if n.endswith(".json") and n[:-5].isdigit()]

    def last(self) -> tuple[int, dict]:
        while True:
            numbers = self._numbers()
            if not numbers:
                return 0, self.empty
            try:
                return numbers[-1], json.loads(_get(self.spark, f"{self.base}/{numbers[-1]:08d}.json"))
            except Exception:
                if numbers[-1] in self._numbers():  # else it went meanwhile, as newer ones came
                    raise

    def change(self, change: Callable[[dict], dict]) -> tuple[dict, dict]:
        """The state before and the state after ``change``."""
        for _ in range(self.TRIES):
            number, old = self.last()
            new = change(old)
            try:
                _put(self.spark, f"{self.base}/{number + 1:08d}.json", json.dumps(new))
            except FileExistsError:
                continue
            numbers = self._numbers()
            if number and number not in numbers:  # so far behind that the name was free again
                _remove(self.spark, f"{self.base}/{number + 1:08d}.json")
                continue
            for n in numbers:
                if n <= number - self.KEPT:
                    _remove(self.spark, f"{self.base}/{n:08d}.json")
            return old, new
        raise OSError(f"{self.base} is changed too often")


@dataclass
class KeyedStore:
    """Rows by key below ``base``, in delta tables: an upsert writes its own rows alone, reads take the last row of each key.

    Several writers may upsert, delete and compact at once (see ``StateLog``). Deltas count in the order in which they
    were committed. Beyond ``COMPACT_AT`` of them an upsert merges them into one.
    """

    spark: SparkSession
    base: str
    keys: tuple[str, ...]
    COMPACT_AT = 16

    @property
    def _log(self) -> StateLog:
        return StateLog(self.spark, f"{self.base}/_state", {"deltas": [], "schema": None})

    def _add(self, rows: DataFrame, gone: bool) -> None:
        path = f"delta/{uuid.uuid4().hex[:12]}"
        rows.withColumn("gone_", F.lit(gone)).write.parquet(f"{self.base}/{path}")
        _, now = self._log.change(lambda s: {"deltas": [*s["deltas"], path], "schema": s["schema"] or rows.schema.json()})
        if len(now["deltas"]) > self.COMPACT_AT:
            self.compact()

    def upsert(self, rows: DataFrame) -> None:
        """Keeps ``rows``, one of each key, in place of those of the same keys. All upserts have the columns of the first one."""
        self._add(rows.dropDuplicates(list(self.keys)), False)

    def delete(self, keys: DataFrame) -> None:
        """Takes the rows of ``keys`` away; keys that are not there change nothing."""
        schema = self._log.last()[1]["schema"]
        if schema:
            wanted = T.StructType.fromJson(json.loads(schema))
            rows = keys.select(*self.keys).distinct()
            self._add(rows.select(*[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]), True)

    def _merged(self, deltas: list[str], schema: str) -> DataFrame:
        with_gone = T.StructType.fromJson(json.loads(schema)).add("gone_", "boolean")
        rows = None
        for at, path in enumerate(deltas):
            own = self.spark.read.schema(with_gone).parquet(f"{self.base}/{path}").withColumn("at_", F.lit(at))
            rows = own if rows is None else rows.unionAll(own)
        if len(deltas) > 1:
            rank = F.row_number().over(W.partitionBy(*self.keys).orderBy(F.desc("at_")))
            rows = rows.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")
        return rows.filter("NOT gone_").drop("at_", "gone_")

    def read(self) -> DataFrame | None:
        """The rows that count now, or None before the first upsert."""
        state = self._log.last()[1]
        return self._merged(state["deltas"], state["schema"]) if state["deltas"] else None

    def compact(self) -> None:
        """Merges the deltas that are there into one; those that others commit meanwhile stay behind it."""
        state = self._log.last()[1]
        old, path = state["deltas"], f"delta/{uuid.uuid4().hex[:12]}"
        if len(old) < 2:
            return
        self._merged(old, state["schema"]).withColumn("gone_", F.lit(False)).write.parquet(f"{self.base}/{path}")
        merged = lambda s: s | {"deltas": [path, *s["deltas"][len(old) :]]} if s["deltas"][: len(old)] == old else s
        _, now = self._log.change(merged)
        for x in old if now["deltas"][0] == path else [path]:  # another writer may have merged them first
            _remove(self.spark, f"{self.base}/{x}")

    def clear(self) -> None:
        _remove(self.spark, self.base)


@dataclass
class StageStore:
    """Parquet tables of a book's stages below ``base``, and small numbered state files that name the whole ones.

    A stage is written to a folder of its own and counts from the moment that the next state file names it;
    what a broken write leaves is never read, and an older version goes after the newer one counts.
    """

    spark: SparkSession
    base: str

    @property
    def _log(self) -> StateLog:
        return StateLog(self.spark, f"{self.base}/_state", {"current": None, "stages": {}})

    def _state(self) -> dict:
        return self._log.last()[1]

    def _change(self, change: Callable[[dict], dict]) -> None:
        old, new = self._log.change(change)
        for path in set(old["stages"].values()) - set(new["stages"].values()):
            _remove(self.spark, f"{self.base}/{path}")

    def save(self, stage: str, df: DataFrame) -> None:
        path = f"{stage}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.base}/{path}")
        self._change(lambda s: {"current": stage if stage in STAGES else s["current"], "stages": s["stages"] | {stage: path}})

    def results(self) -> KeyedStore:
        """The sessions that are written so far, of the index that counts now; another index starts with none."""
        path = self._state()["stages"].get("IndexGen", "IndexGen/none")
        return KeyedStore(self.spark, f"{self.base}/Results/{path.rpartition('/')[2]}", ("book", "number"))

    def load(self, stage: str) -> DataFrame | None:
        path = self._state()["stages"].get(stage)
        return self.spark.read.parquet(f"{self.base}/{path}") if path else None

    def current(self) -> str | None:
        return self._state()["current"]

    def is_complete(self, stage: str) -> bool:
        return stage in self._state()["stages"]

    def reset(self, stage: str | None = None) -> None:
        """One stage (the current stage is forgotten only if it is that one), or everything."""
        if stage is None:
            _remove(self.spark, self.base)
            return
        if stage == "SessionGen":
            self.results().clear()
        self._change(lambda s: {"current": None if s["current"] == stage else s["current"], "stages": {k: v for k, v in s["stages"].items() if k != stage}})

    def progress(self) -> dict:
        done = [s for s in STAGES if self.is_complete(s)]
        index, results = self.load("IndexGen"), self.load("SessionGen")
        results = self.results().read() if results is None else results
        written = 0 if results is None else results.filter("content IS NOT NULL").count() if "content" in results.columns else results.count()
        return {"current_stage": self.current(), "completed": done, "sessions": written, "total": 0 if index is None else index.count()}


@dataclass
class QuotaFile:
    """Tokens that each key has used today, in a JSON file; another day starts from nothing, and so does a broken file.

    Workers share the file, so it lies where all of them see it; changes are made under a lock beside it.
    """

    path: str
    limit: int = 900_000

    def _load(self) -> dict:
        try:
            return json.loads(Path(self.path).read_text())
        except (OSError, ValueError):
            return {}

    def used(self, key_id: str, today: date) -> int:
        entry = self._load().get(key_id, {})
        return entry["tokens_used"] if entry.get("date") == str(today) else 0

    def would_exceed(self, key_id: str, tokens: int, today: date) -> bool:
        return self.used(key_id, today) + tokens > self.limit

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        import fcntl

        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield

    def record(self, key_id: str, tokens: int, today: date) -> None:
        with self._locked():
            self._record(key_id, tokens, today)

    def reserve(self, key_ids: list[str], current: int, tokens: int, today: date) -> int:
        """``pick``, and the tokens are recorded for that key at once, so that no two callers spend the same rest."""
        with self._locked():
            at = self.pick(key_ids, current, tokens, today)
            self._record(key_ids[at], tokens, today)
        return at

    def _record(self, key_id: str, tokens: int, today: date) -> None:
        entries = self._load() | {key_id: {"date": str(today), "tokens_used": self.used(key_id, today) + tokens}}
        part = Path(f"{self.path}.{uuid.uuid4().hex}")
        part.write_text(json.dumps(entries, indent=1))
        part.replace(self.path)

    def pick(self, key_ids: list[str], current: int, tokens: int, today: date) -> int:
        """The place of the first key, from the current one on, that has quota for ``tokens``."""
        for i in range(len(key_ids)):
            at = (current + i) % len(key_ids)
            if not self.would_exceed(key_ids[at], tokens, today):
                return at
        raise QuotaExhausted(f"no quota left today on {len(key_ids)} keys of {self.limit} tokens")


def pending_stages(current: str | None) -> list[str]:
    return list(STAGES[STAGES.index(current) + 1 :]) if current in STAGES else list(STAGES)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key by ``order``; both tables have the same columns."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return base.unionByName(updates).withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def pending_sessions(index: DataFrame, results: DataFrame) -> DataFrame:
    """Sessions of the index without generated content."""
    return index.join(results.filter("content IS NOT NULL AND content <> ''"), ["book", "number"], "left_anti")


def list_books(results: DataFrame) -> DataFrame:
    """(book, n_sessions, stage): sessions with content and the furthest stage of each book, the legacy book (no name) first, then by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0))
    books = results.groupBy("book").agg(F.count_if((F.col("content").isNotNull()) & (F.col("content") != "")).alias("n_sessions"), F.max_by("stage", rank).alias("stage"))
    return books.orderBy(F.coalesce(F.col("book").cast("string"), F.lit("")) != "", "book")


def first_book(results: DataFrame) -> str | None:
    """The first book, in order of name, that has sessions."""
    row = list_books(results).filter("n_sessions > 0").orderBy("book").first()
    return None if row is None else row["book"]


def export_rows(results: DataFrame) -> DataFrame:
    """Sessions with content, and what their checks said where ``results`` has it (evaluation)."""
    rows = results.filter("content IS NOT NULL AND content <> ''")
    more = ["evaluation"] if "evaluation" in results.columns else []
    return rows.select("book", "number", "title", "content", F.coalesce("needs_review", F.lit(False)).alias("needs_review"), *more)


def bundle_json(results: DataFrame) -> DataFrame:
    """(book, number, json): rows for a static site, without audit columns."""
    lean = [c for c in results.columns if c not in ("evaluation", "needs_review", "tension_excerpt")]
    return results.select("book", "number", F.to_json(F.struct(*sorted(lean))).alias("json"))


def write_export(sessions: DataFrame, progress: DataFrame, path: str, now: datetime) -> str:
    """An export below ``path``: sessions and progress as JSON lines, and an envelope written last; returns its folder.

    Progress rows (session_id, key, value) become a map of their keys for each session. Nothing is gathered in one task.
    """
    out = f"{path}/curriculum_export_{now:%Y%m%d_%H%M%S}"
    spark = sessions.sparkSession
    sessions.write.mode("overwrite").json(f"{out}/sessions")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    progress.groupBy("session_id").agg(entries.alias("values")).write.mode("overwrite").json(f"{out}/progress")
    if _exists(spark, f"{out}/envelope.json"):
        _remove(spark, f"{out}/envelope.json")
    _put(spark, f"{out}/envelope.json", json.dumps({"timestamp": now.isoformat(), "sessions": "sessions", "progress": "progress"}))
    return out


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The sessions of an export: a folder as ``write_export`` makes, or a JSON file {timestamp, sessions, progress}.

    In a file the sessions are an array, or an object by session number. Anything without sessions is refused.
    """
    if _exists(spark, f"{path}/envelope.json"):
        return spark.read.json(f"{path}/sessions")
    df = spark.read.json(path, multiLine=True)
    if "sessions" not in df.columns:
        raise PipelineError("no sessions in the export", "Import")
    if df.schema["sessions"].dataType.typeName() == "array":
        return df.select(F.explode("sessions").alias("s")).select("s.*")
    names = df.schema["sessions"].dataType.names
    rows = [F.struct(F.lit(n).alias("session_number"), F.to_json(F.col(f"sessions.`{n}`")).alias("body")) for n in names]
    listed = df.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    kind = F.schema_of_json(F.lit(listed.first()["body"])) if names else F.lit("struct<content: string>")
    return listed.select("session_number", F.from_json("body", kind).alias("v")).select(F.col("session_number").cast("int").alias("number"), "v.*")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, key, value) of an export's folder."""
    rows = spark.read.schema("session_id string, values map<string, string>").json(f"{path}/progress")
    return rows.select("session_id", F.explode("values").alias("key", "value"))


def read_blocks(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Pre-parsed block rows from Parquet or JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


SPAN = "struct<text: string, font: string, size: double, flags: int, origin: struct<x: double, y: double>>"
PDF_DDL = f"doc_id long, page int, ord int, page_width double, x0 double, y0 double, x1 double, lines array<struct<spans: array<{SPAN}>>>"


def read_pdf(spark: SparkSession, path: str, parser=None, ddl: str = PDF_DDL) -> DataFrame:
    """Blocks of PDF files: ``parser(path, bytes)`` yields tuples of ``ddl``; files are read as binary rows.

    The default parser is ``sources.pdf.blocks``; its rows go through ``operators.blocks.from_spans``.
    """
    from lectern.sources import pdf

    parse = parser or pdf.blocks

    def run(batches):
        import pandas as pd

        names = [f.name for f in wanted]
        for rows in batches:
            yield pd.DataFrame([r for p, c in zip(rows["path"], rows["content"], strict=True) for r in parse(p, c)], columns=names)

    wanted = spark.createDataFrame([], ddl).schema
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, wanted)


def index_text(index: DataFrame) -> DataFrame:
    """(book, text): "Session NN: title (m min)", concepts, revisit, and an empty line for each session."""
    concepts = F.transform("concepts", lambda c: F.concat(F.lit("  -> "), c["name"], F.lit(": "), c["description"]))
    revisit = F.when(F.col("revisit").isNotNull(), F.array(F.concat(F.lit("  <- "), F.col("revisit.name"), F.lit(": "), F.col("revisit.reason")))).otherwise(F.array())
    head = F.format_string("Session %02d: %s (%d min)", "number", "title", "estimated_minutes")
    rows = index.select("book", "number", F.array_join(F.concat(F.array(head), concepts, revisit, F.array(F.lit(""))), "\n").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("number", "line")))
    return rows.groupBy("book").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("text"))


def index_valid(index: DataFrame) -> DataFrame:
    full = F.col("number").isNotNull() & F.col("title").isNotNull() & F.col("estimated_minutes").isNotNull() & (F.coalesce(F.size("concepts"), F.lit(0)) > 0)
    return index.groupBy("book").agg((F.bool_and(full) & (F.count(F.lit(1)) > 0)).alias("valid"))


def session_count_ok(n: Column) -> Column:
    return n.between(1, 500)


@dataclass
class Config:
    provider: str = "offline"
    host: str = "http://localhost:11434"
    keys: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        """Defaults filled in; a host must start with http, a hosted provider needs a key."""
        given = json.loads(Path(path).read_text()) if Path(path).exists() else {}
        out = cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})
        if not out.host.startswith("http"):
            raise PipelineError("the host must start with http", "Config")
        if out.provider != "offline" and not out.keys:
            raise PipelineError("a key is needed", "Config")
        return out

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.__dict__, indent=1))


def pdf_path(path: str) -> str:
    p = Path(path)
    if not p.is_file() or p.suffix.lower() != ".pdf":
        raise PipelineError(f"{path} is not a PDF file", "Ingest")
    return str(p.resolve())
