"""Entities of a curriculum derived from the driver tables, in the SQL of either engine.

The tables hold no questions, empty lines or markers, so those are added by rule, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SPARK, DUCK = "spark", "duck"


def cut(e: str, x: str, n: int) -> str:
    """The first n elements of an array."""
    return f"slice({x}, 1, {n})" if e == SPARK else f"({x})[1:{n}]"


def sessions(e: str) -> str:
    body = "replace(text, chr(10), concat(chr(10), chr(10)))"
    caps = cut(e, "regexp_extract_all(text, '([A-Z][a-z]{3,})', 1)", 4)
    return f"""SELECT CAST(floor(doc_id / 50.0) AS INT) AS book, CAST(doc_id % 50 + 1 AS INT) AS number, doc_id,
 CASE WHEN doc_id % 7 = 0 THEN 'The limits of Memory' WHEN doc_id % 5 = 0 THEN 'the limits of memory' ELSE substring(text, 1, 24) END AS title, {caps} AS concepts,
 CASE WHEN doc_id % 3 = 0 THEN concat({body}, chr(10), chr(10), 'As we saw earlier, what breaks first when this limit meets real scale?')
  WHEN doc_id % 3 = 1 THEN concat({body}, chr(10), chr(10), 'Why? It holds. ', substring(text, 1, 400)) ELSE text END AS content FROM documents"""


def concepts(e: str) -> str:
    return """SELECT CAST(floor((p_partkey - 1) / 40.0) AS INT) AS book, p_partkey AS position, p_partkey AS ord, concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS concept,
 CASE WHEN p_size % 5 = 0 THEN 'heavy' WHEN p_size % 2 = 0 THEN 'medium' ELSE 'light' END AS weight, p_brand AS cluster, p_type AS description FROM part"""


def edges(e: str) -> str:
    """Edges within a book from a lower to a higher concept, so without cycles."""
    name = lambda t: f"concat({t}.p_name, ' ', CAST({t}.p_partkey AS VARCHAR(20)))"
    return f"""SELECT DISTINCT CAST(floor((a.p_partkey - 1) / 40.0) AS INT) AS book, {name("a")} AS src, {name("b")} AS dst,
 CASE WHEN a.p_partkey % 4 = 0 THEN 'explicit' WHEN a.p_partkey % 4 = 1 THEN 'implicit' WHEN a.p_partkey % 4 = 2 THEN 'cross_theme' ELSE 'inferred' END AS source
 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 + (a.p_partkey * 7) % 5
 WHERE floor((a.p_partkey - 1) / 40.0) = floor((b.p_partkey - 1) / 40.0) AND a.p_partkey % 6 <> 0"""


def loops(e: str) -> str:
    """The edges and, for those from names of some lengths, their way back."""
    return f"SELECT book, src, dst, source FROM ({edges(e)}) f UNION ALL SELECT book, dst AS src, src AS dst, source FROM ({edges(e)}) g WHERE length(src) % 5 = 1"


def rings(e: str) -> str:
    """Concepts in pairs that need each other, five for each book at least, and some edges between names that are far apart."""
    name = lambda t: f"concat({t}.p_name, ' ', CAST({t}.p_partkey AS VARCHAR(20)))"
    book = "CAST(floor((a.p_partkey - 1) / 40.0) AS INT)"
    pair = "FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 4 = 1"
    return f"SELECT {book} AS book, {name('a')} AS src, {name('b')} AS dst, 'explicit' AS source {pair} UNION ALL SELECT {book}, {name('b')}, {name('a')}, 'implicit' {pair}"


def furnished(e: str) -> str:
    """Blocks with page furniture: a short line at one place of every page."""
    return f"""SELECT doc_id, page, ord, CASE WHEN ord % 3 = 0 THEN concat('Part ', CAST(doc_id % 9 AS VARCHAR(9))) ELSE text END AS text, font, size, flags,
 CASE WHEN ord % 3 = 0 THEN 55.0E0 ELSE x0 END AS x0, CASE WHEN ord % 3 = 0 THEN 22.0E0 ELSE y0 + ord END AS y0, x1, page_width FROM ({blocks(e)}) b"""


def lines(e: str) -> str:
    split = "posexplode(split(text, '\n')) AS (k, t)" if e == SPARK else "unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k"
    return f"SELECT doc_id, {split} FROM documents"


def blocks(e: str) -> str:
    """One block a line; some become page numbers, captions, notes, code, steps, tables and headings."""
    return f"""SELECT doc_id, CAST(floor(k / 3.0) AS INT) + 1 AS page, CAST(k AS INT) AS ord,
 CASE k % 11 WHEN 3 THEN '42' WHEN 4 THEN concat('Figure 7: ', t) WHEN 5 THEN concat('* ', t) WHEN 6 THEN concat('x = ', t) WHEN 7 THEN concat('Input: ', t)
  WHEN 8 THEN concat('Model', chr(9), 'Time', chr(9), 'Size', chr(10), 'A1', chr(9), 'two', chr(9), substring(t, 1, 5)) WHEN 9 THEN concat(t, '  ∑ con-', chr(10), 'nection') ELSE t END AS text,
 CASE WHEN k % 13 = 2 THEN 'Courier New' ELSE 'Serif' END AS font, CASE WHEN k % 5 = 0 THEN 18.0E0 WHEN k % 5 = 1 THEN 14.0E0 ELSE 11.0E0 END AS size,
 CASE WHEN k % 2 = 0 THEN 16 ELSE 0 END AS flags, CASE WHEN k % 2 = 0 THEN 50.0E0 ELSE 330.0E0 END AS x0, CAST(20 + (k % 3) * 30 + (k * 7) % 5 AS DOUBLE) AS y0,
 CASE WHEN k % 2 = 0 THEN 290.0E0 ELSE 560.0E0 END AS x1, 600.0E0 AS page_width FROM ({lines(e)}) l"""


def spans(e: str) -> str:
    """Page furniture: the same short line at one place of every page of a document."""
    return f"SELECT doc_id, page, ord, CASE WHEN ord % 3 = 0 THEN concat('Part ', CAST(doc_id % 9 AS VARCHAR(9))) ELSE text END AS text, CASE WHEN ord % 3 = 0 THEN 55.0E0 ELSE x0 END AS x, CASE WHEN ord % 3 = 0 THEN 22.0E0 ELSE y0 + ord END AS y FROM ({blocks(e)}) b"


def progress(e: str) -> str:
    return """SELECT ts, event_id AS ord, concat('s', CAST(user_id AS VARCHAR(20))) AS session_id, CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_id % 3 = 0 THEN 'bookmark_word_index' ELSE 'bookmark' END AS key,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE CAST(event_id % 900 AS VARCHAR(20)) END AS value, event_id % 11 = 0 AS deleted FROM events"""


def rate_log(e: str) -> str:
    return "SELECT ts, event_id AS ord, concat('k', CAST(user_id % 5 AS VARCHAR(20))) AS key_id, CAST(event_id % 700 AS BIGINT) AS tokens FROM events"


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A Spark query over the tables of ``sf_dir`` that it names."""
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def fixture(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return load(spark, sf_dir, make(SPARK))
