"""The nine-stage run: blocks to sessions, each stage a written table; a rerun starts after the last one.

Everything that a model is asked goes through one provider. A failed chunk, cluster or session keeps its row
with its error; an answer without clusters and used-up quotas end the run, which can be taken up again. Within
the writing of sessions it goes on after the last front that was committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import checks as C
from lectern.operators import extraction as E
from lectern.operators import generation as N
from lectern.operators import graph as G
from lectern.operators import inventory as I  # noqa: E741
from lectern.operators import model as M
from lectern.operators import planner as P
from lectern.sources.store import PipelineError, QuotaExhausted, StageStore, kept, pending_stages, spent


def run(store: StageStore, blocks: DataFrame, approve: Callable[[DataFrame], bool] = lambda index: True, make=M.OfflineProvider) -> list[str]:
    """Runs what is pending over block rows (see ``operators.blocks``) and returns the stages that ran."""
    done = []
    for stage in pending_stages(store.current()):
        try:
            with spent():  # what a stage wrote for itself goes when its table is whole
                out = STEPS[stage](store, blocks, approve, make)
                if out is None:
                    break
                store.save(stage, out)
                done.append(stage)
        except Exception as e:
            if "QuotaExhausted" in str(e) and not isinstance(e, QuotaExhausted):  # raised in a worker, whose job hands on its name alone
                raise QuotaExhausted(f"no quota left in {stage}") from e
            raise
    return done


def ingest(store, blocks, approve, make) -> DataFrame:
    return B.ingest(blocks)


def first_pass(store, blocks, approve, make) -> DataFrame:
    """(doc_id, the four lists, error): a document's inventory, merged over its chunks and brought to size."""
    return E.adjust(E.merge(E.extract(I.paragraph_chunks(store.load("Ingest")), make), make), make)


def clustering(store, blocks, approve, make) -> DataFrame:
    """(book, cluster, about, place, concept, description, ord)."""
    concepts = E.numbered(E.concept_rows(store.load("Pass1")))
    clustered = kept(E.cluster(concepts, make), "clustered")
    if bad := clustered.filter("error IS NOT NULL").first():
        raise PipelineError(f"{bad['book']}: {bad['error']}", "Cluster", recoverable=True)
    return E.members(clustered, concepts).join(concepts.select("book", "concept", "description", "ord"), ["book", "concept"])


def second_pass(store, blocks, approve, make) -> DataFrame:
    """The deep extraction of each concept, and a row of null concept with the error of each cluster that failed."""
    members = store.load("Cluster")
    answers = E.deep_answers(members, members.select("book", "concept", "description", "ord"), make)
    rows = E.deep_extract(answers, members).withColumn("error", F.lit(None).cast("string"))
    failed = answers.filter("error IS NOT NULL").select("book", "cluster", "error")
    return rows.join(members.select("book", "concept", "ord"), ["book", "concept"]).unionByName(failed, allowMissingColumns=True)


def graph(store, blocks, approve, make) -> DataFrame:
    """Concepts in reading order: (book, concept, cluster, description, weight, ord, what prompts show of them, position, needs, related, orphan)."""
    extracted = store.load("Pass2").filter("concept IS NOT NULL").dropDuplicates(["book", "concept"])
    concepts = kept(N.drop_duplicates(extracted, make), "concepts")
    signals, prerequisites, related = E.graph_inputs(concepts)
    edges = G.break_cycles(kept(N.derive_edges(concepts, signals, prerequisites, related.select("book", "concept", "other"), N.infer_edges(concepts, make)), "derived-edges"))
    edges = kept(edges, "edges")
    needs = edges.groupBy("book", F.col("dst").alias("concept")).agg(F.array_sort(F.collect_list(F.struct("src", "source"))).alias("needs"))
    ties = related.groupBy("book", "concept").agg(F.array_sort(F.collect_set(F.struct("other", "relation"))).alias("related"))
    lost = G.orphans(concepts, edges).withColumn("orphan", F.lit(True))
    contrasts = F.array_compact(F.transform("cross_theme_deps", lambda d: F.when(d["relationship"].isin(*N.CONTRASTS) & (d["concept"] != ""), d["concept"])))
    shown = [F.col("primary_passage").alias("passage"), F.col("secondary_passages").alias("passages"), F.col("author_anchor").alias("anchor"), F.col("implicit_prerequisites").alias("assumed"), contrasts.alias("contrasts"), F.col("enrichment_flag").alias("enrich")]
    told = store.load("Cluster").select("book", "cluster", "about").dropDuplicates(["book", "cluster"])
    out = concepts.select("book", "concept", "cluster", "description", "weight", "ord", *shown).join(told, ["book", "cluster"], "left").join(G.grouped_order(concepts, edges), ["book", "concept"])
    for more in (needs, ties, lost):
        out = out.join(more, ["book", "concept"], "left")
    return out.withColumn("orphan", F.coalesce("orphan", F.lit(False)))


def index(store, blocks, approve, make) -> DataFrame:
    """(book, number, title, concepts, concept_count, total_weight, estimated_minutes, cluster, revisit)."""
    concepts = store.load("GraphBuild")
    edges = concepts.select("book", F.explode("needs").alias("n"), F.col("concept").alias("dst")).select("book", F.col("n.src").alias("src"), "dst")
    packed = kept(P.pack(concepts), "packed")
    for reorder in (lambda p: P.tier_order(p, G.tiers(concepts, edges, "position")), lambda p: P.repair_order(p, edges)):
        numbers = reorder(packed).select("book", "number", "new_number")
        packed = kept(packed.join(numbers, ["book", "number"]).drop("number").withColumnRenamed("new_number", "number").withColumn("number", F.col("number").cast("int")), "packed")
    members = kept(packed.join(concepts.select("book", "concept", "description", "weight", "cluster"), ["book", "concept"]), "members")
    listed = F.array_sort(F.collect_list(F.struct("position", F.col("concept").alias("name"), "description", "weight")))
    sessions = kept(members.groupBy("book", "number").agg(F.transform(listed, lambda c: c.dropFields("position")).alias("concepts")), "sessions")
    names = sessions.withColumn("concepts", F.transform("concepts", lambda c: c["name"]))

    related = concepts.select("book", "concept", F.explode("related").alias("r")).select("book", "concept", F.col("r.other").alias("other"), F.col("r.relation").alias("relation"))
    tied = edges.select("book", F.col("src").alias("concept"), F.col("dst").alias("other")).union(related.select("book", "concept", "other"))
    scored = kept(P.revisit_scores(P.revisit_candidates(members), members, tied.distinct()), "revisit-scores")
    reasons = E.revisit_reasons(P.revisit_once(scored), scored, names, related, make)
    revisits = reasons.select("book", "number", F.struct(F.col("concept").alias("name"), "reason").alias("revisit"))
    titles = N.with_titles(names, make).select("book", "number", "title")
    out = sessions.join(titles, ["book", "number"]).join(P.session_totals(members), ["book", "number"])
    return out.join(P.dominant_cluster(members), ["book", "number"], "left").join(revisits, ["book", "number"], "left")


def approval(store, blocks, approve, make) -> DataFrame | None:
    planned = store.load("IndexGen")
    return planned.select("book").distinct().withColumn("approved", F.lit(True)) if approve(planned) else None


def sessions(store, blocks, approve, make) -> DataFrame:
    """(book, number, title, content, tension_excerpt, card, error, evaluation, needs_review) of approved books."""
    plan = store.load("IndexGen").join(store.load("AwaitApproval").filter("approved"), "book", "left_semi")
    concepts = store.load("GraphBuild")
    edges = concepts.select("book", F.explode("needs").alias("n"), F.col("concept").alias("dst")).select("book", F.col("n.src").alias("src"), "dst")
    written = kept(N.generate_sessions(plan, N.section_context(plan, concepts, edges), store.results(), make), "written")
    known = plan.select("book", "number", F.transform("concepts", lambda c: c["name"]).alias("concepts"), F.col("revisit.name").alias("revisit"), F.col("revisit.reason").alias("revisit_reason"))
    whole = kept(N.repair_truncated(written.filter("content IS NOT NULL"), make), "repaired")
    checks = kept(N.evaluate(whole.join(known, ["book", "number"]), make), "checks")
    said = checks.groupBy("book", "number").agg(F.array_sort(F.collect_list(F.struct("check", "passed", "evidence", "retry_count", "needs_review"))).alias("evaluation"))
    said = said.join(C.needs_review(checks).select("book", "number", "needs_review"), ["book", "number"])
    return whole.unionByName(written.filter("content IS NULL")).join(said, ["book", "number"], "left").withColumn("needs_review", F.coalesce("needs_review", F.lit(True)))


def complete(store, blocks, approve, make) -> DataFrame:
    """(book, n_sessions, n_review, n_failed)."""
    done = store.load("SessionGen")
    return done.groupBy("book").agg(F.count("content").alias("n_sessions"), F.count_if("needs_review").alias("n_review"), F.count("error").alias("n_failed"))


#: A function for each of ``store.STAGES``.
STEPS = {
    "Ingest": ingest, "Pass1": first_pass, "Cluster": clustering, "Pass2": second_pass, "GraphBuild": graph, "IndexGen": index, "AwaitApproval": approval,
    "SessionGen": sessions, "Complete": complete,
}
