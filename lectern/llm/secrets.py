"""Secret scans: candidate spans by pattern, told apart by how many owners share a value.

Positions come from the built-in functions alone: the text is split at the matches, and the lengths
of the pieces and of the matches before one add up to its start. Values leave the rows only as SHA-256
hashes; distinct (hash, owner, repository) triples are formed first, then summed by owner and by hash,
so that a value copied into most documents is pre-aggregated before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, text_or_empty, written

#: Fixed by the query's contract: kind, pattern, group of the value, least characters of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
#: What the ownership frequency adds, in the order of spans that start together.
VERDICTS = ("live", "example")
NAMES = [k[0] for k in KINDS] + list(VERDICTS)
#: A value of so many owners or more is a widely copied example.
EXAMPLE_OWNERS = 3
#: Matches of a text that are folded at once.
CHUNK = 256
#: A live-looking value has so many different characters or more.
LIVE_CHARACTERS = 5

SPAN = "struct<start: int, rank: int, stop: int, value_start: int, hash: string, varied: boolean>"


def _matches(text: Column, rank: int) -> Column:
    """The spans of one kind, as array<SPAN>; texts without a match never reach the array functions."""
    _, pattern, group, least = KINDS[rank]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    triples = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    items = F.transform(triples, lambda x: F.struct(F.length(x.getField("gap")).alias("gap"), F.length(x.getField("hit")).alias("hit"), x.getField("value").alias("value")))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + x["hit"]
        value = x.getField("value")
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), (stop - F.length(value)).alias("value_start"),
            F.sha2(value, 256).alias("hash"), (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS).alias("varied"),
        )
        kept = F.when(F.length(value) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(stop.alias("at"), kept.alias("spans"))

    # An array that grows by one is copied each time, so the fold runs over chunks, each from its own start.
    last = F.ceil(F.size(items) / CHUNK).cast("int") - 1
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))
    lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["hit"]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(lengths, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
    empty = lambda start: F.struct(start.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    spans = F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), starts.alias("start")), lambda z: F.aggregate(z["chunk"], empty(z["start"]), add, lambda s: s["spans"])))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, text: Column, owner: Column, repository: Column, row: str, spans: str, own: str, repo: str) -> DataFrame:
    """``docs`` with a row number, the candidate spans in order and the owner and repository as text."""
    text = text_or_empty(text)
    found = F.array_sort(F.concat(*[_matches(text, k) for k in range(len(KINDS))]))
    return docs.withColumns(
        {
            row: F.monotonically_increasing_id(),
            spans: found,
            own: F.coalesce(F.concat(F.lit("="), owner.cast("string")), F.lit("")),
            repo: F.coalesce(F.concat(F.lit("="), repository.cast("string")), F.lit("")),
        }
    )


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with ``findings``: array<struct<kind, start, stop, owners, repositories>> in order of start, then kind.

    Kinds assign, access and hex are the pattern matches. A value's span is added as ``example`` if its
    value occurs with three owners or more, else as ``live`` if it looks like a credential in use (five
    different characters or more); these two carry in how many owners, and repositories of owners, the value
    occurs, so that a value kept in one place can be told from one that its owner has spread. Offsets are
    code points, the end is exclusive. A null owner counts as one owner, a null repository as one of its owner. Null and empty texts have no findings.
    Repeated rows are kept; an empty table stays empty; an existing column findings is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "findings"]
    row, spans, own, repo = fresh(docs, "row", "spans", "owner", "repository")
    table = candidates(docs, F.col(text_col), F.col(owner_col), F.col(repository_col), row, spans, own, repo)
    table = table.select(*keep, row, spans, own, repo)
    if text_col in keep:
        # Rows without a candidate are scanned again rather than written with their texts.
        clean, table = table.filter(F.size(spans) == 0), written(table.filter(F.size(spans) > 0), "secret-candidates")
    else:
        table = written(table, "secret-candidates")
        clean, table = table.filter(F.size(spans) == 0), table.filter(F.size(spans) > 0)
    one = table.select(F.col(row).alias("row"), F.col(own).alias("owner"), F.col(repo).alias("repository"), F.explode(spans).alias("s"))
    triples = one.select("s.hash", "owner", "repository").distinct()
    owners = triples.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    shared = written(owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")), "secret-owners")
    judged = one.join(shared.withColumnRenamed("hash", "hash_"), F.col("s.hash") == F.col("hash_"))
    verdict = F.when(F.col("owners") >= EXAMPLE_OWNERS, NAMES.index("example")).when(F.col("s.varied"), NAMES.index("live"))
    added = judged.withColumn("verdict", verdict).groupBy("row").agg(
        F.collect_set(F.when(F.col("verdict").isNotNull(), F.struct(F.col("s.value_start").alias("start"), F.col("verdict").alias("rank"), F.col("s.stop").alias("stop"), "owners", "repositories"))).alias("more")
    )
    named = lambda a: F.transform(a, lambda s: F.struct(F.array(*map(F.lit, NAMES))[s["rank"]].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["owners"].alias("owners"), s["repositories"].alias("repositories")))
    none = F.lit(None).cast("long")
    base = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), none.alias("owners"), none.alias("repositories")))
    clean = clean.select(*keep, named(base).alias("findings"))
    marked = table.join(added.withColumnRenamed("row", "row_"), F.col(row) == F.col("row_"))
    return clean.unionAll(marked.select(*keep, named(F.array_sort(F.concat(base, "more"))).alias("findings")))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The columns of ``docs`` with each live value of a text replaced wherever it stands in that text.

    Null and empty texts, and texts without a live value, stay as they are; repeated rows are redacted alike, an empty table stays empty.
    """
    found = scan(docs, text_col)
    text = F.col(text_col)
    live = F.transform(F.filter("findings", lambda s: s["kind"] == "live"), lambda s: F.substr(text, s["start"] + 1, s["stop"] - s["start"]))
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(live), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    clean = F.when(F.exists("findings", lambda s: s["kind"] == "live"), F.aggregate(longest, text, lambda t, v: F.replace(t, v, F.lit(mark)))).otherwise(text)
    return found.withColumn(text_col, clean).select(*docs.columns)


def _joined(spans: Column, *more: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], *[s[c].cast("string") for c in ("start", "stop", *more)])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: counts, digest and spans of every document; its source is the owner, the document the repository.

    ``ownership`` has the spans live and example with the owners and repositories of their values.
    """
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    base, judged = F.filter("findings", lambda s: ~s["kind"].isin(*VERDICTS)), F.filter("findings", lambda s: s["kind"].isin(*VERDICTS))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind, *_ in KINDS]
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"), _joined(judged, "owners", "repositories").alias("ownership"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT rid, owner, repo, {k} AS rank, string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS hits, regexp_extract_all(t, {quoted(p)}, {g}) AS vals, {least} AS least FROM d"
        for k, (_, p, g, least) in enumerate(KINDS)
    )
    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS owner, coalesce('=' || doc_id, '') AS repo, coalesce(text, '') AS t FROM documents),
h AS ({found}),
i AS (SELECT *, unnest(generate_series(1, len(hits))) AS n FROM h),
s AS (SELECT rid, owner, repo, rank, vals[n] AS v, least,
  list_sum(list_transform(gaps[1:n], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:n-1], lambda x: length(x))), 0)::BIGINT AS a, length(hits[n]) AS w FROM i),
c AS (SELECT rid, owner, repo, rank, a, a + w AS z, v FROM s WHERE length(v) >= least),
o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM c GROUP BY v),
e AS (SELECT DISTINCT rid, CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 4 WHEN len(list_distinct(string_split(v, ''))) >= {LIVE_CHARACTERS} THEN 3 END AS rank, z - length(v) AS a, z, owners, repos FROM c JOIN o USING (v)),
x AS (SELECT rid, rank, a, z, NULL AS owners, NULL AS repos FROM c UNION ALL SELECT rid, rank, a, z, owners, repos FROM e WHERE rank IS NOT NULL),
f AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg({names}[rank + 1] || ':' || a || ':' || z, ',' ORDER BY a, rank, z) FILTER (rank < 3), '') AS base,
  string_agg({names}[rank + 1] || ':' || a || ':' || z, ',' ORDER BY a, rank, z) AS spans,
  string_agg({names}[rank + 1] || ':' || a || ':' || z || ':' || owners || ':' || repos, ',' ORDER BY a, rank, z) FILTER (rank >= 3) AS ownership FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(ownership, '') AS ownership FROM d LEFT JOIN f USING (rid)"""


ORACLE = _oracle()
