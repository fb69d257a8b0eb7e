"""Model-backed extraction: inventories of chunks, their union and size, clusters, deep extraction, revisit reasons.

Each step is a table of questions, one row a chunk, book or cluster, and a typed table of answers. A failed
call keeps its row with its error; which steps go on without an answer is said with each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import inventory as I  # noqa: E741
from lectern.operators import model as M
from lectern.operators import planner as P
from lectern.sources.store import kept

Make = Callable[[], M.ModelProvider]
#: The four lists of an inventory.
LISTS = {
    "concepts": "array<struct<name: string, description: string, location: string, recurring: boolean>>",
    "explicit_dependencies": "array<struct<signal: string, location: string, refers_to: string>>",
    "implicit_assumptions": "array<struct<term: string, context: string, location: string>>",
    "author_anchors": "array<struct<anchor: string, location: string>>",
}
INVENTORY = "struct<" + ", ".join(f"{k}: {v}" for k, v in LISTS.items()) + ">"
CLUSTERS = "struct<clusters: array<struct<name: string, description: string, concepts: array<string>>>>"
EXTRACTION = (
    "struct<concepts: array<struct<original_name: string, canonical_name: string, description: string, primary_passage: string, secondary_passages: array<string>, "
    "dependency_signals: array<struct<signal: string, location: string, refers_to: string>>, implicit_prerequisites: array<string>, author_anchor: string, "
    "enrichment_flag: boolean, concept_weight: string, cross_theme_deps: array<struct<concept: string, relationship: string>>>>>"
)
# Characters of JSON that fit a model's context, for providers that need the cut, and the score below which a reason is asked for.
MERGE_LIMITS = {"concepts": 30_000, "explicit_dependencies": 5_000, "implicit_assumptions": 5_000, "author_anchors": 5_000}
ADJUST_LIMIT = 20_000
WEAK_REVISIT = 0.3


def _lists(found: Column) -> list[Column]:
    return [F.coalesce(found[k], F.array().cast(kind)).alias(k) for k, kind in LISTS.items()]


def extract(chunks: DataFrame, make: Make = M.OfflineProvider) -> DataFrame:
    """(doc_id, chunk_no, the four lists, error) of every chunk; a failed chunk has empty lists and its error."""
    said = kept(chunks.select("doc_id", "chunk_no", M.ask_json("inventory", F.col("chunk"), INVENTORY, make).alias("a")), "inventories")
    return said.select("doc_id", "chunk_no", *_lists(F.col("a.found")), F.col("a.error").alias("error"))


def _fitting(lists: dict[str, int] | None) -> Column:
    """The four lists as one JSON object; with limits each list keeps the elements that fit so many characters."""

    def fits(name: str, limit: int) -> Column:
        sizes = F.transform(name, lambda x: F.length(F.to_json(F.struct(x.alias("x")))))
        return F.filter(name, lambda x, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda s, n: s + n) <= limit)

    return F.to_json(F.struct(*[(F.col(k) if lists is None else fits(k, lists[k])).alias(k) for k in LISTS]))


def merge(inventories: DataFrame, make: Make = M.OfflineProvider, limits: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, the four lists, error): all chunks of a document as one inventory, in order of chunk.

    A document of one chunk is taken as it is. If the call fails, the plain union stays, with the error;
    errors of chunks are kept too. ``limits``: characters of each list that the model is shown.
    """
    rows = F.array_sort(F.collect_list(F.struct("chunk_no", *LISTS)))
    said = F.array_join(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.format_string("chunk %d: %s", "chunk_no", "error")))), "; ")
    whole = inventories.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), rows.alias("rows"), F.nullif(said, F.lit("")).alias("error"))
    whole = kept(whole.select("doc_id", "n", "error", *[F.flatten(F.col("rows")[k]).alias(k) for k in LISTS]), "unions")
    asked = kept(whole.filter("n > 1").withColumn("a", M.ask_json("merge", _fitting(limits), INVENTORY, make)), "merged")
    found = F.col("a.found")
    lists = [F.coalesce(found[k], F.when(F.col("a.error").isNotNull() | found["concepts"].isNull(), F.col(k)), F.array().cast(kind)).alias(k) for k, kind in LISTS.items()]
    merged = asked.select("doc_id", *lists, F.nullif(F.concat_ws("; ", "error", "a.error"), F.lit("")).alias("error"))
    return whole.filter("n = 1").select("doc_id", *LISTS, "error").unionByName(merged)


def adjust(merged: DataFrame, make: Make = M.OfflineProvider, limit: int | None = None) -> DataFrame:
    """``merged`` with too few concepts split and too many united, in one call and without a second look; a failed call changes nothing."""
    judged = kept(merged.withColumn("verdict", I.volume(F.size("concepts"))), "volumes")
    listing = F.to_json(F.struct("concepts"))
    prompt = F.concat_ws("\n", "verdict", listing if limit is None else F.substring(listing, 1, limit))
    asked = judged.filter("verdict <> 'ok'").withColumn("a", M.ask_json("adjust", prompt, INVENTORY, make))
    asked = asked.withColumn("concepts", F.coalesce("a.found.concepts", "concepts")).withColumn("error", F.nullif(F.concat_ws("; ", "error", "a.error"), F.lit("")))
    return judged.filter("verdict = 'ok'").drop("verdict").unionByName(asked.drop("verdict", "a"))


def concept_rows(merged: DataFrame) -> DataFrame:
    """(book, concept, description, location, recurring, ord): a row for each concept; of equal names the first."""
    rows = merged.select(F.col("doc_id").cast("string").alias("book"), F.posexplode("concepts").alias("ord", "c"))
    rows = rows.select("book", F.col("c.name").alias("concept"), F.coalesce("c.description", F.lit("")).alias("description"), "c.location", "c.recurring", "ord")
    return I.merge_concepts(rows.filter("concept IS NOT NULL AND concept <> ''"))


def cluster(concepts: DataFrame, make: Make = M.OfflineProvider) -> DataFrame:
    """(book, clusters, error): five to eight clusters of a book's concepts; another count is adjusted once.

    An answer without clusters is an error, for which a run must stop; a failed adjustment leaves the first answer.
    """
    line = F.concat(F.lit("- "), F.concat_ws(": ", "concept", "description"))
    listing = concepts.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda r: r["line"]), "\n").alias("listing"))
    said = kept(listing.select("book", M.ask_json("cluster", F.col("listing"), CLUSTERS, make).alias("a")), "clusters")
    n = F.size("a.found.clusters")
    error = F.coalesce("a.error", F.when(F.col("a.found.clusters").isNull(), F.lit("no clusters in the answer")))
    fine = said.filter(F.col("a.found.clusters").isNull() | n.between(I.LEAST_CLUSTERS, I.MOST_CLUSTERS)).select("book", "a.found.clusters", error.alias("error"))
    odd = said.filter(F.col("a.found.clusters").isNotNull() & ~n.between(I.LEAST_CLUSTERS, I.MOST_CLUSTERS))
    prompt = F.concat_ws("\n", F.when(n < I.LEAST_CLUSTERS, "merge").otherwise("split"), F.to_json("a.found"))
    again = odd.withColumn("b", M.ask_json("recluster", prompt, CLUSTERS, make))
    return fine.unionByName(again.select("book", F.coalesce("b.found.clusters", "a.found.clusters").alias("clusters"), F.lit(None).cast("string").alias("error")))


def members(clustered: DataFrame, concepts: DataFrame) -> DataFrame:
    """(book, cluster, about, place, concept): known concepts of each cluster; what has none joins its book's first cluster."""
    rows = clustered.select("book", F.posexplode("clusters").alias("place", "c")).select("book", "place", F.col("c.name").alias("cluster"), F.col("c.description").alias("about"), F.explode("c.concepts").alias("concept"))
    known = rows.join(concepts.select("book", "concept").distinct(), ["book", "concept"], "left_semi").dropDuplicates(["book", "cluster", "concept"])
    heads = kept(clustered.select("book", F.posexplode("clusters").alias("place", "c")).select("book", "place", F.col("c.name").alias("cluster"), F.col("c.description").alias("about")), "cluster-heads")
    full = I.assign_missing(concepts, known, heads.withColumnRenamed("place", "ord"))
    return full.join(heads.dropDuplicates(["book", "cluster"]), ["book", "cluster"]).select("book", "cluster", "about", "place", "concept")


def deep_answers(membership: DataFrame, concepts: DataFrame, make: Make = M.OfflineProvider) -> DataFrame:
    """(book, cluster, found, error): one call for each cluster, which is shown all concepts of its book."""
    ranked = membership.select("book", "cluster", "about", "concept").join(concepts.select("book", "concept", "ord"), ["book", "concept"])
    names = lambda by: F.transform(F.array_sort(F.collect_list(F.struct(by, "concept"))), lambda r: r["concept"])
    own = ranked.groupBy("book", "cluster").agg(F.first("about").alias("description"), names("ord").alias("concepts"))
    every = concepts.groupBy("book").agg(names("ord").alias("all"))
    prompt = F.to_json(F.struct("cluster", "description", "concepts", "all"))
    said = own.join(every, "book").select("book", "cluster", M.ask_json("deep", prompt, EXTRACTION, make).alias("a"))
    error = F.coalesce("a.error", F.when(F.col("a.found.concepts").isNull(), F.lit("no concepts in the answer")))
    return kept(said.select("book", "cluster", F.col("a.found.concepts").alias("found"), error.alias("error")), "extractions")


def deep_extract(answers: DataFrame, membership: DataFrame) -> DataFrame:
    """(book, cluster, concept, ..., weight, placeholder) of each concept; what an answer leaves out gets a placeholder of medium weight.

    A cluster whose call failed has no concepts here; ``answers`` holds its error.
    """
    rows = answers.filter("error IS NULL").select("book", "cluster", F.explode("found").alias("c")).select("book", "cluster", "c.*")
    asked = membership.join(answers.filter("error IS NULL").select("book", "cluster"), ["book", "cluster"], "left_semi")
    rows = rows.withColumnRenamed("original_name", "concept").join(asked.select("book", "cluster", "concept").distinct(), ["book", "cluster", "concept"], "left_semi")
    rows = rows.dropDuplicates(["book", "cluster", "concept"]).withColumn("weight", F.when(F.col("concept_weight").isin(*P.WEIGHTS), F.col("concept_weight")).otherwise("medium")).drop("concept_weight")
    narrow = rows.withColumn("description", F.coalesce("description", F.lit("")))
    full = I.fill_extractions(asked, narrow)
    return full.join(rows.drop("description", "weight"), ["book", "cluster", "concept"], "left").withColumn("canonical_name", F.coalesce("canonical_name", "concept"))


def graph_inputs(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals (book, concept, refers_to), prerequisites (book, concept, term) and related (book, concept, other) of the extraction."""
    signals = extracted.select("book", "concept", F.explode("dependency_signals").alias("s")).select("book", "concept", F.col("s.refers_to").alias("refers_to")).filter("refers_to IS NOT NULL")
    prerequisites = extracted.select("book", "concept", F.explode("implicit_prerequisites").alias("term")).filter("term IS NOT NULL AND term <> ''")
    related = extracted.select("book", "concept", F.explode("cross_theme_deps").alias("d")).select("book", "concept", F.col("d.concept").alias("other"), F.col("d.relationship").alias("relation")).filter("other IS NOT NULL")
    return signals, prerequisites, related


def revisit_reasons(best: DataFrame, scored: DataFrame, sessions: DataFrame, related: DataFrame, make: Make = M.OfflineProvider) -> DataFrame:
    """(book, number, concept, score, reason): the reason by rule, or where the best score is weak the one that a model gives.

    The model sees the session's concepts and the three best candidates; it changes the reason, never the
    concept, and no answer, a null choice or an empty reason leaves the rule's. ``sessions`` has book, number
    and concepts (names in order); ``related`` has book, concept, other and relation.
    """
    first = F.get("concepts", 0)
    met = related.join(sessions.select("book", "number", F.explode("concepts").alias("other")), ["book", "other"]).groupBy("book", "number", "concept").agg(F.min(F.struct("other", "relation")).alias("tie"))
    rows = best.join(sessions.select("book", "number", "concepts"), ["book", "number"]).join(met, ["book", "number", "concept"], "left")
    rows = kept(rows.withColumn("reason", P.revisit_reason(F.col("concept"), F.col("tie.relation"), F.col("tie.other"), first)), "revisits")
    top = P.top_revisits(scored.join(rows.filter(F.col("score") < WEAK_REVISIT).select("book", "number"), ["book", "number"], "left_semi"), 3)
    top = top.groupBy("book", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda r: r["concept"]).alias("candidates"))
    prompt = F.to_json(F.struct(F.col("concepts").alias("current"), "candidates"))
    asked = rows.join(top, ["book", "number"]).select("book", "number", M.ask_json("revisit", prompt, "struct<choice: string, reason: string>", make)["found"].alias("a"))
    usable = F.col("a.choice").isNotNull() & ~F.col("a.choice").isin("", "null") & (F.coalesce("a.reason", F.lit("")) != "")
    out = rows.join(asked, ["book", "number"], "left")
    return out.select("book", "number", "concept", "score", F.when(usable, F.col("a.reason")).otherwise(F.col("reason")).alias("reason"))


def numbered(concepts: DataFrame) -> DataFrame:
    """``concepts`` with ord from 1 without gaps in each book."""
    return concepts.withColumn("ord", F.row_number().over(W.partitionBy("book").orderBy("ord", "concept")))
