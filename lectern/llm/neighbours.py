"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are its words, its character trigrams and, for each word, how many words ago it
stood last; each kind is hashed into its own share of the terms. Their counts are damped, weighted by
inverse document frequency over all documents, and projected on the leading singular vectors of a
bounded, documented sample of labelled documents (``PER_CLASS`` of each label). The sample's vectors
are broadcast; each document's cosine with every one of them is an exact blocked matrix product, and
the labels of the nearest vote by similarity. Labels, language, source and id are never part of a vector.

Weighted terms, axes and unit vectors are whole numbers of a fixed grid, small enough that every
product and sum of them is exact. So a score is a function of its text and the model alone, whatever
the batches or partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_fold, fresh, release, small_batches, text_or_empty, trimmed, written

#: Labelled documents of each class at most: the bound of what is sampled, collected and broadcast.
PER_CLASS = 2048
#: Latent dimensions, neighbours that vote, and the power of their similarity (two squarings).
LATENT, NEAREST, POWER = 48, 15, 4
FOLDS, HELD_OUT, ACCEPT = 5, 0, 0.3
#: Score where nothing was learned.
UNKNOWN = 0.5
#: Documents whose vectors and products are held at once, and characters whose trigrams are.
BLOCK, SLICE = 256, 1 << 20

#: Terms of character trigrams, of words and of distances between equal words.
N_GRAMS, N_WORDS, N_BACK = 2560, 1520, 16
N_TERMS = N_GRAMS + N_WORDS + N_BACK
#: Steps of a unit in weighted terms, axes, latent and unit vectors. Weights are below 64 and N_TERMS is 2**12, so sums stay below 2**53.
TERM_GRID, AXIS_GRID, UNIT_GRID = 1 << 10, 1 << 14, 1 << 20


def _grams(text: str) -> np.ndarray:
    """How many of a text's character trigrams fall to each of their terms."""
    out = np.zeros(N_GRAMS, np.int64)
    for at in range(0, max(0, len(text) - 2), SLICE):
        c = np.frombuffer(text[at : at + SLICE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out += np.bincount(((h >> np.uint64(33)) % np.uint64(N_GRAMS)).astype(np.int64), minlength=N_GRAMS)
    return out


def _word_terms(texts: list[str]) -> np.ndarray:
    """Damped counts of the words and of the distances between equal words, one row a text; all texts' words are numbered at once."""
    import pandas as pd
    from xxhash import xxh32_intdigest

    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    out = np.zeros((len(texts), N_WORDS + N_BACK), np.float32)
    codes, words = pd.factorize(np.array([w for ws in split for w in ws], object))
    if not len(words):
        return out
    row = np.repeat(np.arange(len(texts)), n)
    place = np.array([xxh32_intdigest(w) % N_WORDS for w in words], np.int64)
    sums = np.bincount(row * N_WORDS + place[codes], minlength=len(texts) * N_WORDS).reshape(len(texts), N_WORDS)
    # Equal words of a text side by side, in the order of the text.
    key = row * len(words) + codes
    order = np.argsort(key, kind="stable")
    again = np.diff(key[order], prepend=-1) == 0
    gap = np.diff(order, prepend=0)
    step = np.where(again, np.minimum(N_BACK - 1, np.frexp(gap)[1]), 0)  # 1, 2 to 3, 4 to 7 words ago, and so on; 0 if never
    back = np.bincount(row[order] * N_BACK + step, minlength=len(texts) * N_BACK).reshape(len(texts), N_BACK)
    # Relative to the length, so that a text and a longer one of its kind lie near each other; little is known of a few words.
    out[:, :N_WORDS] = np.sqrt(sums / np.maximum(n, 1)[:, None])
    out[:, N_WORDS:] = np.sqrt(back / (n + 4)[:, None])
    return out


def terms_of(texts: list[str]) -> np.ndarray:
    """Damped term counts, one row a text; all zero for one of fewer than three characters without words."""
    out = np.zeros((len(texts), N_TERMS), np.float32)
    at = 0
    while at < len(texts):  # words of about SLICE characters are held at once, or those of one text
        end, size = at + 1, len(texts[at])
        while end < len(texts) and end - at < BLOCK and size + len(texts[end]) <= SLICE:
            size += len(texts[end])
            end += 1
        out[at:end, N_GRAMS:] = _word_terms(texts[at:end])
        at = end
    for row, text in zip(out, texts, strict=True):
        grams = _grams(text)
        row[:N_GRAMS] = np.sqrt(grams / max(1, grams.sum()))
    return out


def terms(text: str) -> np.ndarray:
    """Damped term counts of one text."""
    return terms_of([text])[0]


def _blocks(texts: list[str]) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), BLOCK):
        yield terms_of(texts[at : at + BLOCK])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: documents, and for each term those that have it."""
    n, df = 0, np.zeros(N_TERMS, np.int64)
    for batch in batches:
        n += batch.num_rows
        for x in _blocks(batch.column(0).to_pylist()):
            df += (x > 0).sum(axis=0)
    yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.tolist()]}, schema=pa.schema([("n", pa.int64()), ("df", pa.list_(pa.int64()))]))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms that a text has, as places and counts, which are far fewer than all."""
    schema = pa.schema([("id", pa.string()), ("label", pa.int32()), ("places", pa.binary()), ("terms", pa.binary())])
    for batch in batches:
        rows = [x for block in _blocks(batch.column(2).to_pylist()) for x in block]
        places = [np.flatnonzero(x).astype("<u2") for x in rows]
        values = [x[p].astype("<f4").tobytes() for x, p in zip(rows, places, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in places], pa.binary()), pa.array(values, pa.binary())], schema=schema)


def _leading_axes(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The LATENT leading right singular vectors of x weighted by idf, by subspace iteration from a fixed start; x is not copied."""
    q = np.random.default_rng(6).standard_normal((N_TERMS, LATENT + 16))
    weigh = lambda q: (q * idf[:, None]).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr((x.T @ (x @ weigh(q))) * idf[:, None] if len(x) else q)
    _, _, v = np.linalg.svd((x @ weigh(q)).astype(float) if len(x) else np.eye(q.shape[1]), full_matrices=False)
    v = np.vstack([v, np.zeros((max(0, LATENT - len(v)), v.shape[1]))])[:LATENT]
    return q @ v.T


class Model:
    """Term weights, the projection, and the labelled vectors with their labels; about 4 MB."""

    def __init__(self, idf: np.ndarray, x: np.ndarray, labels: np.ndarray):
        self.idf, self.labels = idf.astype(float), labels.astype(float)
        self.axes = np.rint(_leading_axes(x, self.idf) * AXIS_GRID) / AXIS_GRID
        self.known = np.vstack([np.empty((0, LATENT)), *(self.latent(x[at : at + BLOCK]) for at in range(0, len(x), BLOCK))])

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors on the grid; zero for a text without a direction."""
        y = np.rint(x * self.idf * TERM_GRID) @ (self.axes * AXIS_GRID)
        y = np.rint(y / (TERM_GRID * AXIS_GRID // UNIT_GRID))  # squares and their sums are exact
        return np.rint(y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1) * UNIT_GRID) / UNIT_GRID

    def scores(self, texts: list[str]) -> np.ndarray:
        """Share of label 1 in the similarity-weighted votes of the nearest labelled vectors; those equally near as the last share its votes."""
        if not len(self.labels):
            return np.full(len(texts), UNKNOWN)
        out = np.empty(len(texts))
        k = min(NEAREST, len(self.labels))
        known = np.ascontiguousarray((self.known * UNIT_GRID).T)
        for at in range(0, len(texts), BLOCK):
            cosine = ((self.latent(terms_of(texts[at : at + BLOCK])) * UNIT_GRID) @ known) / UNIT_GRID**2
            last = np.partition(cosine, len(self.labels) - k, axis=1)[:, -k:].min(axis=1, keepdims=True)
            above, equal = cosine > last, cosine == last
            share = (k - above.sum(axis=1, keepdims=True)) / equal.sum(axis=1, keepdims=True)
            weight = np.where(above, 1.0, np.where(equal, share, 0.0)) * np.square(np.square(np.maximum(cosine, 1e-6)))
            out[at : at + BLOCK] = (weight * self.labels).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Document frequencies over all of ``docs``; labels of 0 and 1 from the rows of ``labels`` outside the held-out fold.

    Of each class the PER_CLASS ids with the smallest hashes are taken. Null and other labels, and null
    ids, teach nothing; of several labels for an id the smallest holds. Without labelled documents, or without any
    documents, the model knows nothing and scores every text as UNKNOWN. A null text counts as an empty one.
    """
    narrow = small_batches(docs).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    counted = narrow.select("text").mapInArrow(lambda it: trimmed(_frequencies(it)), "n long, df array<long>")
    total = counted.select("n", F.posexplode("df")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("df")).collect()
    n, df = max((r.n for r in total), default=0), np.zeros(N_TERMS)
    for r in total:
        df[r.pos] = r.df
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    usable = usable.filter(crc_fold(F.col("id"), FOLDS) != HELD_OUT).groupBy("id").agg(F.min("label").alias("label"))
    some = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for k in (0, 1)]
    sample = written(some[0].unionAll(some[1]), "labelled-sample")
    found = narrow.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = found.select(F.col("id").cast("string"), "label", "text").mapInArrow(lambda it: trimmed(_vectors(it)), "id string, label int, places binary, terms binary").toArrow().sort_by("id")
    x, label = np.zeros((rows.num_rows, N_TERMS), np.float32), rows["label"].to_numpy()
    for i, (p, t) in enumerate(zip(rows["places"], rows["terms"], strict=True)):
        x[i, np.frombuffer(p.as_buffer(), "<u2")] = np.frombuffer(t.as_buffer(), "<f4")
    del rows
    release()
    return Model(np.log1p(n / (1 + df)), x, label)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted; a null text is scored as an empty one, which has no direction and gets the plain share of its votes.

    Repeated rows are scored each for itself, an empty table stays empty, and columns that have these
    names already are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, value = fresh(docs, "scored_text", "score_value")

    @F.pandas_udf("double")
    def judged(texts):
        import pandas as pd

        return pd.Series(shared.value.scores(texts.tolist()))

    out = small_batches(docs).withColumn(text, text_or_empty(text_col)).withColumn(value, judged(F.col(text)))
    return out.select(
        *docs.columns, (crc_fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.col(value).alias("score"), F.when(F.col(value) >= ACCEPT, 1).otherwise(0).alias("predicted")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")
