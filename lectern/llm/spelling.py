"""Spelling variant grouping by a symmetric-delete join.

Every word emits itself and its single deletions. Words one inserted or deleted code point apart share the shorter
word itself; words one replaced code point apart share a deletion at the same place. So the equi-join on the
shared key takes the place along: a key then has at most as many words as the alphabet has letters, however large the vocabulary, and no
pair of words that merely share a key is met. The exact distance is verified on what is met. A word's form is the
most frequent near word that is frequent enough; roots follow by pointer jumping over the forms, whose
frequency at least doubles at each step, so rounds are few.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, text_or_empty, trimmed, written

#: Fixed by the query's contract: one in so many (document, word) pairs is misspelt, least code points and occurrences of a word, how many times as frequent a form is.
MISSPELT, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
#: Letters of a word, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Code points of a text that are cut into words at once; different words that a task holds before it hands their counts on.
WINDOW, HELD = 1 << 20, 1 << 17
COUNT_SCHEMA = pa.schema([("word", pa.string()), ("n", pa.int64())])


def text_words(text: str) -> Iterator[list[str]]:
    """The words of a text, A-Z lower-cased, a list for every ``WINDOW`` code points or so; windows end between words."""
    text = text.encode().lower().decode()  # of bytes: ASCII letters only
    word, other = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
    at = 0
    while at < len(text):
        cut = other.search(text, at + WINDOW)
        stop = cut.start() if cut else len(text)
        yield word.findall(text, at, stop)
        at = stop


def misspelt(name: str, word: str, one_in: int) -> str:
    """``word``, but for one in ``one_in`` names (``<doc_id>:<word>``, by their crc32) without one of its code points."""
    h = zlib.crc32(f"{name}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(one_in: int | None, min_length: int):
    def batch_of(sums: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], schema=COUNT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for words in text_words(text):
                    for word, n in Counter(words).items():
                        word = misspelt(name, word, one_in) if one_in else word
                        if len(word) >= min_length:
                            sums[word] += n
                    if len(sums) >= HELD:
                        yield batch_of(sums)
                        sums.clear()
        if sums:
            yield batch_of(sums)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``min_length`` code points and ``min_count`` occurrences or more over all rows.

    Words are runs of letters (A-Z lower-cased, others as they are). With ``one_in`` words are misspelt first, see ``misspelt``;
    a null id counts as the text "null". Null and empty texts have no words; repeated rows count each.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), text_or_empty(text_col).alias("text"))
    counted = small_batches(rows).mapInArrow(lambda it: trimmed(_counted(one_in, min_length)(it)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n_other) for all different words (word, n) exactly one inserted, deleted or replaced code point apart; both ways round."""
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)).alias("key"), i.alias("place")))
    emitted = words.select("word", "n", F.explode(cut).alias("k")).select("k.key", "k.place", "word", "n")
    emitted = written(emitted, "deletions")
    a, b = emitted.alias("a"), emitted.alias("b")
    same_place = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.word") != F.col("b.word")))
    replaced = same_place.select(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.n").alias("n_other"))

    itself = words.select(F.col("word").alias("key"), F.col("n").alias("n_short"))
    shorter = emitted.select("key", "word", "n").distinct().join(itself, "key")
    ways = F.array(F.struct(F.col("word").alias("word"), F.col("key").alias("other"), F.col("n_short").alias("n_other")), F.struct(F.col("key").alias("word"), F.col("word").alias("other"), F.col("n").alias("n_other")))
    inserted = shorter.select(F.explode(ways).alias("w")).select("w.*")
    return replaced.unionByName(inserted).filter(F.levenshtein("word", "other", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form, none null): the last word that is reached over forms. Forms make no circles."""
    tree = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        up = tree.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = tree.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = written(jumped, "roots")
        if jumped.filter("moved").isEmpty():
            return tree
        tree = jumped.drop("moved")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of ``words`` (word, n; words distinct, none null).

    Near words differ by exactly one code point inserted, deleted or replaced. The form is the near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``ratio`` (over 1) times the word's own, else null. The root
    is the last word over forms, the word itself without one. An empty table stays empty.
    """
    words = written(words.select("word", "n"), "words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("other"))).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"))
    formed = written(formed, "word-forms")
    tree = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(tree, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``group_variants`` of the ``vocabulary`` of ``docs``, whose notes hold; other columns are never read, so no name can clash."""
    return group_variants(vocabulary(docs, id_col, text_col, one_in, min_length, min_count), ratio)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the variants of all words of the documents."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), one_in=MISSPELT)
