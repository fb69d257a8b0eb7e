"""Line dedup: lines that many documents share, found by range-partitioned hashes, as compressed keep bitmaps.

A line's key is hashed to 128 bits and only hashes travel, never texts. Hashes are range-partitioned by
(hash, document), so a line that is in a third of all documents is cut across many partitions, and sorted
by position within; the sort is streamed, and the first occurrence of a hash in a document counts for one
document. Counts are summed within each task before their shuffle. What is dropped comes back as a
bitmap of each document's lines, compressed to run lengths: lines kept, lines dropped, lines kept, and so on.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import fresh, text_or_empty, written

#: Fixed by the query's contract: least documents of a key whose lines go, least code points of such a key.
MIN_DOCUMENTS, MIN_LENGTH = 10, 1
#: ASCII white space, which is stripped from keys.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(text_or_empty(text), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH, keep_first: bool = False) -> DataFrame:
    """(id, text_hash, n_dropped, keep_bitmap) of the documents that lose lines.

    A key of ``min_length`` code points or more that is in ``min_documents`` documents or more loses all its
    lines, or with ``keep_first`` all but the first one, in order of id (null first), then text hash, then
    position. keep_bitmap (array<int>) has the lengths of alternating runs of kept and dropped lines up to the last dropped
    one, kept first (0 if the first line goes); what follows is kept. A document is told by its id and
    text: repeated rows of both are one document, rows of one id and other texts are others. Null and empty
    texts, and an empty table, lose nothing. Other columns are never read.
    """
    ways = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), lines(F.col(text_col)).alias("lines"))
    keyed = texts.select("id", "text_hash", F.posexplode("lines").alias("pos", "line")).select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    hashed = keyed.filter(F.length("key") >= min_length).select(F.xxhash64(F.lit(0), "key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "text_hash", "pos")
    # The window needs the rows of (h1, h2, id, text_hash) together, which the range partitions give without another shuffle.
    dealt = hashed.repartitionByRange(ways, "h1", "h2", "id", "text_hash")
    nth = F.row_number().over(W.partitionBy("h1", "h2", "id", "text_hash").orderBy("pos"))
    dealt = written(dealt.withColumn("first", (nth == 1).cast("int")), "line-hashes")

    counted = dealt.groupBy("h1", "h2").agg(F.sum("first").alias("documents"), F.min(F.struct("id", "text_hash", "pos")).alias("earliest"))
    common = counted.filter(F.col("documents") >= min_documents).select("h1", "h2", *(["earliest"] if keep_first else []))
    dropped = dealt.join(written(common, "common-lines"), ["h1", "h2"])
    if keep_first:
        dropped = dropped.filter(~F.struct("id", "text_hash", "pos").eqNullSafe(F.col("earliest")))

    document = ["id", "text_hash"]
    run = F.col("pos") - F.dense_rank().over(W.partitionBy(*document).orderBy("pos"))  # equal along a run; repeated rows share positions
    runs = dropped.select(*document, "pos", run.alias("run")).groupBy(*document, "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    gap = F.col("start") - F.coalesce(F.lag("stop").over(W.partitionBy(*document).orderBy("start")), F.lit(0))
    runs = runs.select(*document, F.struct("start", gap.alias("kept"), (F.col("stop") - F.col("start")).alias("gone")).alias("r"))
    whole = runs.groupBy(*document).agg(F.sum("r.gone").alias("n_dropped"), F.sort_array(F.collect_list("r")).alias("runs"))
    return whole.select(*document, "n_dropped", F.flatten(F.transform("runs", lambda r: F.array(r["kept"], r["gone"]))).alias("keep_bitmap"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines of ``text`` that a bitmap of ``keep_bitmaps`` keeps, joined by line feeds; a null bitmap keeps the whole text (null: empty)."""
    flags = F.flatten(F.transform(bitmap, lambda n, i: F.array_repeat(i % 2 == 1, n)))
    marked = F.arrays_zip(lines(text).alias("line"), flags.alias("gone"))
    left = F.transform(F.filter(marked, lambda z: ~F.coalesce(z["gone"], F.lit(False))), lambda z: z["line"])
    return F.when(bitmap.isNull(), text_or_empty(text)).otherwise(F.array_join(left, "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH, keep_first: bool = False) -> DataFrame:
    """``docs`` with n_lines, n_dropped (longs) and keep_bitmap (null where nothing is dropped); see ``keep_bitmaps``.

    Every row is kept, repeated ones and those of null ids too. Columns of ``docs`` of these three names are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "keep_bitmap")])
    own_id, own_hash, gone, runs = fresh(docs, "own_id", "own_hash", "gone", "runs")
    found = keep_bitmaps(docs, id_col, text_col, min_documents, min_length, keep_first).toDF(own_id, own_hash, gone, runs)
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_or_empty(text_col)) == F.col(own_hash))
    n_lines = F.size(lines(F.col(text_col))).cast("long")
    return docs.join(found, same, "left").select(*docs.columns, n_lines.alias("n_lines"), F.coalesce(F.col(gone), F.lit(0)).cast("long").alias("n_dropped"), F.col(runs).alias("keep_bitmap"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: lines, dropped lines and a digest of the kept text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep_bitmap")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT *, min(rid) OVER (PARTITION BY doc_id, t) AS document FROM d),
l AS (SELECT rid, document, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM g),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
c AS (SELECT key AS common FROM k WHERE length(key) >= {MIN_LENGTH} GROUP BY key HAVING count(DISTINCT document) >= {MIN_DOCUMENTS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(common) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON key = common GROUP BY rid"""
