"""Registered queries of the model-backed operators over the offline provider, and of storage and limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import checks as C
from lectern.operators import extraction as E
from lectern.operators import generation as N
from lectern.operators import inventory as V
from lectern.operators import model as M
from lectern.operators import planner as P
from lectern.operators import progress as R
from lectern.plans import fixtures as X
from lectern.plans.catalog import _AUDIT, _CHECKS
from lectern.plans.catalog import _TAIL as _TAIL_SQL
from lectern.plans.catalog import docs, query, with_
from lectern.plans.catalog_graph import _CAND, _PACKED, _SCORE, evaluated, results, scores
from lectern.plans.fixtures import fixture
from lectern.sources import store as S

# --- inventories ------------------------------------------------------------------------------------------------------
_CHUNKS = "k AS (SELECT doc_id, unnest(generate_series(1, (length(text) + 3999) // 4000))::INT AS chunk_no, substring(text, (unnest(generate_series(1, (length(text) + 3999) // 4000)) - 1) * 4000 + 1, 4000) AS chunk FROM documents)"
_FOUND = r"f AS (SELECT doc_id, chunk_no, unnest(regexp_extract_all(chunk, '\b[A-Z][a-z]{3,}\b')) AS name, generate_subscripts(regexp_extract_all(chunk, '\b[A-Z][a-z]{3,}\b'), 1) AS pos FROM k), i AS (SELECT doc_id, chunk_no, name, min(pos) AS pos, count(*) > 1 AS recurring FROM f GROUP BY ALL)"
_MERGED = "m AS (SELECT doc_id, name, recurring, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, pos) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY chunk_no, pos) AS k FROM i) WHERE k = 1)"


def inventories(spark, d):
    return E.extract(V.fixed_chunks(docs(spark, d), 4000))


@query("extract_inventory", f"WITH {_CHUNKS}, {_FOUND} SELECT doc_id, chunk_no, name, 'What the text says on ' || name AS description, '' AS location, recurring FROM i")
def _(spark, d):
    return inventories(spark, d).select("doc_id", "chunk_no", F.explode("concepts").alias("c")).select("doc_id", "chunk_no", "c.*")


_SIGNS = "s AS (SELECT doc_id, 1 AS chunk_no, n_chars % 3 AS k FROM documents)"


@query("inventory_lists", f"WITH {_SIGNS} SELECT doc_id, CASE WHEN k = 0 THEN 'recall that' END AS signal, CASE WHEN k = 0 THEN 'Memory' END AS refers_to, CASE WHEN k = 1 THEN 'GPU,RAM' ELSE '' END AS terms, CASE WHEN k = 2 THEN 'caches hide latency well' END AS anchor, 0 AS n_errors FROM s")
def _(spark, d):
    k = F.col("n_chars") % 3
    text = F.when(k == 0, "now recall that Memory is slow").when(k == 1, "the GPU and RAM of a GPU").otherwise('they say "caches hide latency well" here')
    found = E.extract(docs(spark, d).select("doc_id", F.lit(1).alias("chunk_no"), text.alias("chunk")))
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return found.select(
        "doc_id", first("explicit_dependencies")["signal"].alias("signal"), first("explicit_dependencies")["refers_to"].alias("refers_to"),
        F.array_join(F.transform("implicit_assumptions", lambda x: x["term"]), ",").alias("terms"), first("author_anchors")["anchor"].alias("anchor"), F.when(F.col("error").isNull(), 0).otherwise(1).alias("n_errors"),
    )


@query("merge_inventories", f"WITH {_CHUNKS}, {_FOUND}, {_MERGED} SELECT doc_id, place::INT AS place, name, recurring FROM m")
def _(spark, d):
    return E.merge(inventories(spark, d)).select("doc_id", F.posexplode("concepts").alias("place", "c")).select("doc_id", "place", "c.name", "c.recurring")


@query("adjust_volume", f"WITH {_CHUNKS}, {_FOUND}, {_MERGED}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, substring(name, 1, 4) ORDER BY place) AS first FROM m)"
    " SELECT doc_id, name || part AS name FROM n, (VALUES (' idea'), (' use')) v(part) WHERE n < 40 UNION ALL SELECT doc_id, name FROM n WHERE n BETWEEN 40 AND 250 OR (n > 250 AND first = 1)")
def _(spark, d):
    return E.adjust(E.merge(inventories(spark, d))).select("doc_id", F.explode("concepts").alias("c")).select("doc_id", "c.name")


# --- clusters ---------------------------------------------------------------------------------------------------------
_THEMES = """t AS (SELECT book, concept, ord, ascii(concept) % 6 AS theme FROM c), n AS (SELECT *, (SELECT count(DISTINCT theme) FROM t u WHERE u.book = t.book) AS n, dense_rank() OVER (PARTITION BY book ORDER BY theme) - 1 AS place, row_number() OVER (PARTITION BY book ORDER BY theme, ord) - 1 AS turn FROM t),
 z AS (SELECT book, concept, ord, CASE WHEN n BETWEEN 5 AND 8 THEN 'Theme ' || theme ELSE 'Part ' || (turn % 5) END AS cluster, (CASE WHEN n BETWEEN 5 AND 8 THEN place ELSE turn % 5 END)::INT AS place FROM n)"""


@query("cluster_concepts", with_(c=X.concepts) + f", {_THEMES} SELECT book, cluster, count(*) OVER (PARTITION BY book, cluster) || ' concepts' AS about, place, concept FROM z")
def _(spark, d):
    c = fixture(spark, d, X.concepts).select("book", "concept", "description", "ord")
    return E.members(E.cluster(c), c)


@query("deep_extraction", with_(c=X.concepts, x="SELECT book, cluster, concept, ord, row_number() OVER (PARTITION BY book, cluster ORDER BY ord) - 1 AS i, lag(concept) OVER (PARTITION BY book, cluster ORDER BY ord) AS before, lag(concept) OVER (PARTITION BY book ORDER BY concept) AS earlier, lag(cluster) OVER (PARTITION BY book ORDER BY concept) AS theirs FROM c")
    + """SELECT book, cluster, concept, concept AS canonical_name, concept || ' in ' || cluster AS description, CASE length(concept) % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'medium' ELSE 'heavy' END AS weight, CASE WHEN i % 3 = 1 THEN before END AS refers_to,
 CASE WHEN i % 3 = 2 THEN before END AS prerequisite, CASE WHEN theirs <> cluster THEN earlier END AS other, false AS placeholder FROM x""")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    members = c.select("book", "cluster", F.lit("").alias("about"), F.lit(0).alias("place"), "concept")
    out = E.deep_extract(E.deep_answers(members, c.select("book", "concept", "description", "ord")), members)
    first = lambda x: F.try_element_at(F.col(x), F.lit(1))
    return out.select("book", "cluster", "concept", "canonical_name", "description", "weight", first("dependency_signals")["refers_to"].alias("refers_to"), first("implicit_prerequisites").alias("prerequisite"), first("cross_theme_deps")["concept"].alias("other"), "placeholder")


# --- revisits -----------------------------------------------------------------------------------------------------------
_REASONS = """best AS (SELECT book, number, concept, score FROM (SELECT *, row_number() OVER (PARTITION BY book, number ORDER BY score DESC, concept DESC) AS k FROM score) WHERE k = 1),
 lead AS (SELECT book, number, min_by(concept, position) AS head FROM packed GROUP BY ALL),
 tie AS (SELECT b.book, b.number, min(e.dst) AS other FROM best b JOIN e ON e.book = b.book AND e.src = b.concept JOIN packed p ON p.book = b.book AND p.number = b.number AND p.concept = e.dst GROUP BY ALL)"""


@query("revisit_reasons", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", " + _CAND + ", " + _SCORE + ", " + _REASONS + """ SELECT book, number, concept, score, CASE WHEN score < 0.3::DOUBLE THEN concept || ' reappears here because ' || head || ' leans on it'
 WHEN other IS NOT NULL THEN concept || ' shapes ' || other || ', now visible from this session''s vantage point' ELSE concept || ' shaped the constraints that make ' || head || ' necessary — the earlier design decision becomes visible from this vantage point' END AS reason
 FROM best JOIN lead USING (book, number) LEFT JOIN tie USING (book, number)""")
def _(spark, d):
    scored, packed = scores(spark, d), P.pack(fixture(spark, d, X.concepts))
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "concept"))), lambda c: c["concept"])
    ties = fixture(spark, d, X.edges).select("book", F.col("src").alias("concept"), F.col("dst").alias("other"), F.lit("shapes").alias("relation"))
    return E.revisit_reasons(P.best_revisit(scored), scored, packed.groupBy("book", "number").agg(names.alias("concepts")), ties)


# --- checks -------------------------------------------------------------------------------------------------------------
_M = "[" + ", ".join(f"'{m}'" for m in C.REVISIT_ONLINE) + "]"
_PS = "list_filter(string_split(content, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(10)) <> '')"
_ASKED = rf"""g0 AS (SELECT book, number, q >= 0 AND len(regexp_extract_all(question, '\S+')) >= 5 AND len(regexp_extract_all(substring(tail, q + 2), '\S+')) <= 20 AS tension FROM g),
 w AS (SELECT a.book, a.number, a.content, a.concepts, CASE WHEN a.number > 3 THEN a.concepts[1] END AS revisit, {_PS.replace('content', 'a.content')} AS ps, b.content AS ending, regexp_extract_all(a.content, '\S+') AS cw, regexp_extract_all(b.content, '\S+') AS ew FROM s a LEFT JOIN s b ON b.book = a.book AND b.number = a.number - 1),
 o AS (SELECT *, regexp_extract_all(lower(right(ending, 300)), '\S+') AS tw, regexp_extract_all(lower(substring(content, 1, 300)), '\S+') AS hw, list_filter({_M}, lambda m: contains(lower(content), m)) AS ms FROM w),
 u AS (SELECT *, coalesce(len(list_intersect(list_distinct(tw[-30:]), list_distinct(hw[1:30]))) / nullif(least(30, len(tw), len(hw)), 0) > 0.65 AND len(tw) > 10 AND len(hw) > 10, false) AS copied,
  list_transform(ps, lambda p: len(list_filter(ms, lambda m: contains(lower(p), m)))) AS ns FROM o),
 v AS (SELECT *, coalesce(list_filter(ps, lambda p, i: ns[i] > 0 AND contains(lower(p), substring(lower(revisit), 1, 10)))[1], list_filter(ps, lambda p, i: ns[i] = list_max(ns))[1], '') AS part,
  list_filter(ps, lambda p: len(list_filter({_M}, lambda m: contains(lower(p), m))) > 0)[1] AS marked FROM u),
 y AS (SELECT book, number, ps, concepts, unnest(generate_series(0, len(concepts) - 2)) AS i FROM v WHERE len(ps) >= 3 AND len(concepts) >= 2),
 y1 AS (SELECT *, greatest(1, least(floor(len(ps) * (i + 1) / len(concepts))::INT, len(ps) - 2)) AS k FROM y),
 y2 AS (SELECT book, number, regexp_extract_all(ps[k], '\S+') AS aw, regexp_extract_all(ps[k + 1], '\S+') AS bw FROM y1),
 x AS (SELECT book, number, bool_and(contains(array_to_string(aw[-80:], ' '), '?') OR contains(array_to_string(bw[1:80], ' '), '?')) AS bridged FROM y2 GROUP BY ALL)"""


@query("evaluate_sessions", with_(s=X.sessions) + ", " + _TAIL_SQL + ", " + _ASKED + r""" SELECT book, number, 'TENSION' AS "check", tension AS passed, 0 AS retry_count, NOT tension AS needs_review FROM g0
 UNION ALL SELECT book, number, 'ANCHOR', ok, CASE WHEN ok OR copied THEN 0 ELSE 2 END, NOT ok FROM (SELECT *, ending IS NULL OR (NOT copied AND (contains(CASE WHEN len(ew) < 80 THEN ending ELSE array_to_string(ew[-80:], ' ') END, '?') OR contains(array_to_string(cw[1:200], ' '), '?'))) AS ok FROM v)
 UNION ALL SELECT book, number, 'COHERENCE', contains(content, '?'), CASE WHEN contains(content, '?') THEN 0 ELSE 2 END, NOT contains(content, '?') FROM v
 UNION ALL SELECT book, number, 'REVISIT', revisit IS NULL OR ok, CASE WHEN revisit IS NULL OR len(ms) = 0 OR contains(part, '?') THEN 0 WHEN ok THEN 1 ELSE 2 END, NOT (revisit IS NULL OR ok) FROM (SELECT *, len(ms) > 0 AND (contains(part, '?') OR contains(coalesce(marked, ''), '?')) AS ok FROM v)
 UNION ALL SELECT book, number, 'TRANSITIONS', coalesce(bridged, true), 0, NOT coalesce(bridged, true) FROM v LEFT JOIN x USING (book, number)
 UNION ALL SELECT book, number, 'LENGTH', ok, 0, NOT ok FROM (SELECT *, len(cw) BETWEEN 1500 AND 2600 AND right(regexp_replace(content, '\s+$', ''), 1) IN ('.', '?', '!') AS ok FROM v)""")
def _(spark, d):
    return N.evaluate(evaluated(spark, d)).select("book", "number", "check", "passed", "retry_count", "needs_review")


@query("evaluate_offline", with_(s=X.sessions) + r"""SELECT book, number, k AS "check", k <> 'LENGTH' OR n BETWEEN 1800 AND 2600 AS passed, CASE WHEN k = 'LENGTH' THEN n || ' words' ELSE 'no model: assumed' END AS evidence, 0 AS retry_count, k = 'LENGTH' AND n NOT BETWEEN 1800 AND 2600 AS needs_review
 FROM (SELECT book, number, len(regexp_extract_all(content, '\S+')) AS n FROM s) x, (VALUES ('TENSION'), ('ANCHOR'), ('COHERENCE'), ('TRANSITIONS'), ('LENGTH'), ('REVISIT')) v(k)""")
def _(spark, d):
    return N.evaluate_offline(fixture(spark, d, X.sessions))


@query("length_failures", with_(s=X.sessions, w=r"SELECT book, number, len(regexp_extract_all(content, '\S+')) AS n FROM s") + "SELECT book, coalesce(string_agg(number || ':' || n, ',' ORDER BY number) FILTER (n < 1500), '') AS short, coalesce(string_agg(number || ':' || n, ',' ORDER BY number) FILTER (n > 2600), '') AS long FROM w GROUP BY book")
def _(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["number"].cast("string"), x["words"].cast("string"))), ",").alias(c)
    return C.length_failures(fixture(spark, d, X.sessions)).select("book", text("short"), text("long"))


@query("session_ratings", with_(s=X.sessions) + r"SELECT book, number, least(10, 5 + len(regexp_extract_all(content, '\S+')) // 200)::DOUBLE AS depth, 'by length' AS remark FROM s")
def _(spark, d):
    from lectern.functions.jsonx import rating, remark

    a = F.col("answer")
    return M.rate(fixture(spark, d, X.sessions)).select("book", "number", rating(a, "CONCEPT_DEPTH").alias("depth"), remark(a).alias("remark"))


@query("audit_report", with_(s=X.sessions) + ", " + _CHECKS + ", " + _AUDIT + """, t AS (SELECT book, round(sum(n_pass / n_total * 10 * CASE "check" WHEN 'tension' THEN 0.30::DOUBLE WHEN 'length' THEN 0.20::DOUBLE ELSE 0.25::DOUBLE END), 2) AS structure,
 round(max(CASE WHEN "check" = 'length' THEN n_pass / n_total * 10 END), 2) AS length,
 string_agg('| ' || "check" || ' | ' || n_pass || ' | ' || n_total || ' | ' || CASE WHEN len(failed) > 0 THEN array_to_string(failed, ', ') ELSE '-' END || ' |', chr(10) ORDER BY "check") AS lines FROM a GROUP BY book),
 d AS (SELECT book, round(avg(number % 9 + 1.5::DOUBLE), 2) AS depth, round(avg(number % 4 + 6.0::DOUBLE), 2) AS prose FROM s GROUP BY book)
 SELECT book, '# Quality of ' || book || chr(10) || chr(10) || '| check | passed | of | failing sessions |' || chr(10) || '|-|-|-|-|' || chr(10) || lines || chr(10) || chr(10)
 || printf('Structure %.2f, length %.2f, coherence %.4f of 10.', structure, length, round(least(10.0::DOUBLE, structure * 1.1::DOUBLE), 4)) || chr(10)
 || printf('concept_depth: %.2f', depth) || chr(10) || printf('prose_quality: %.2f', prose) || chr(10) AS report FROM t JOIN d USING (book)""")
def _(spark, d):
    s = fixture(spark, d, X.sessions)
    n = F.col("number")
    answers = s.select("book", F.concat(F.lit("CONCEPT_DEPTH: "), n % 9 + 1, F.lit(".5\nPROSE_QUALITY: "), n % 4 + 6).alias("answer"))
    return C.reports(C.structural_audit(C.structural_checks(s)), C.dimension_averages(answers, ["CONCEPT_DEPTH", "PROSE_QUALITY"], ("book",)))


# --- index --------------------------------------------------------------------------------------------------------------
def entries(spark, d):
    from lectern.plans.catalog_graph import planned

    return planned(spark, d).withColumn("estimated_minutes", F.lit(12))


_ENTRY = "g AS (SELECT book, number, string_agg(concept, ',' ORDER BY position) AS names, count(*) AS n, min_by(concept, position) AS head FROM packed GROUP BY ALL)"


@query("index_entries", with_(c=X.concepts) + ", " + _PACKED + ", " + _ENTRY + " SELECT book, printf('%02d', number) AS session_number, 'Part ' || number AS title, names, CASE WHEN number > 2 THEN 'cache' END AS revisit, 12 AS estimated_minutes, n::INT AS concept_count, coalesce(lead(head) OVER (PARTITION BY book ORDER BY number), '') AS next_session_first_concept FROM g")
def _(spark, d):
    out = N.index_entries(entries(spark, d))
    return out.withColumn("names", F.array_join(F.transform("concepts", lambda c: c["name"]), ",")).withColumn("revisit", F.col("revisit.name")).drop("concepts")


@query("revise_index", with_(s=X.sessions) + "SELECT book, number, title FROM s")
def _(spark, d):
    return N.revise_index(fixture(spark, d, X.sessions).select("book", "number", "title"), "keep them all")


@query("shown_context", with_(s=X.sessions) + "SELECT book, number, substring(content, 1, 300) AS passage, substring(content, 1, 400) AS description, array_to_string(concepts[1:2], ',') AS prerequisites, array_to_string(concepts[1:3], ',') AS contrasts FROM s")
def _(spark, d):
    s = fixture(spark, d, X.sessions).select("book", "number", F.col("content").alias("passage"), F.col("content").alias("description"), F.col("concepts").alias("prerequisites"), F.col("concepts").alias("contrasts"))
    return N.shown_context(s).withColumns({c: F.array_join(c, ",") for c in ("prerequisites", "contrasts")})


@query("session_count", with_(s=X.sessions) + "SELECT book, count(*) * (book % 4) BETWEEN 1 AND 500 AS fine FROM s GROUP BY book")
def _(spark, d):
    return fixture(spark, d, X.sessions).groupBy("book").agg(F.count(F.lit(1)).alias("n")).select("book", S.session_count_ok(F.col("n") * (F.col("book") % 4)).alias("fine"))


@query("repair_truncated", with_(s=X.sessions, c=r"SELECT book, number, content, right(regexp_replace(content, '\s+$', ''), 1) NOT IN ('.', '?', '!') AS open, regexp_extract(regexp_replace(content, '\s+$', ''), '(?s)^(.*\S[.!?])(\s|$)', 1) AS part FROM s",
    t=r"SELECT *, part || chr(10) || chr(10) || 'What breaks first when ' || coalesce(nullif(regexp_extract(part, '\b[A-Z][a-z]{3,}\b'), ''), 'this') || ' meets real scale?' AS tried FROM c")
    + r"SELECT book, number, CASE WHEN open AND part <> '' AND len(regexp_extract_all(tried, '\S+')) BETWEEN 1500 AND 2600 THEN tried ELSE content END AS content FROM t")
def _(spark, d):
    return N.repair_truncated(fixture(spark, d, X.sessions).select("book", "number", "content"))


# --- sources and stores -------------------------------------------------------------------------------------------------
@query("from_spans", "SELECT doc_id, substring(text, 1, 9) || ' tail' || chr(10) || lang AS text, 9.5::DOUBLE AS size, 'Mono' AS font, 16 AS flags, 50.0::DOUBLE AS x FROM documents")
def _(spark, d):
    span = lambda t, font, size: F.struct(t.alias("text"), F.lit(font).alias("font"), F.lit(size).alias("size"), F.lit(16).alias("flags"), F.struct(F.lit(50.0).alias("x"), F.lit(20.0).alias("y")).alias("origin"))
    lines = F.array(F.struct(F.array(span(F.substring("text", 1, 9), "Mono", 9.5), span(F.lit("tail"), "Serif", 8.0)).alias("spans")), F.struct(F.array(span(F.col("lang"), "Serif", 8.0)).alias("spans")))
    return B.from_spans(docs(spark, d).select("doc_id", lines.alias("lines"))).select("doc_id", "text", "size", "font", "flags", "x")


def _folder(spark, label: str) -> str:
    """A fresh folder of the shared place, removed at the end of the process."""
    return S.work_folder(spark, label)


@query("stage_store", "SELECT * FROM (VALUES ('Ingest', true, 2::BIGINT, 'Cluster'), ('Pass1', false, NULL, 'Cluster'), ('Cluster', true, 3, 'Cluster'), ('Pass2', false, NULL, 'Cluster')) v(stage, complete, n_rows, current)")
def _(spark, d):
    store = S.StageStore(spark, _folder(spark, "store"))
    for stage, n in (("Ingest", 5), ("Pass1", 4), ("Cluster", 3), ("Ingest", 2), ("Cluster", 3)):
        store.save(stage, spark.range(n))
    store.reset("Pass1")
    counts = {s: store.load(s) for s in S.STAGES[:4]}
    rows = [(s, store.is_complete(s), None if t is None else t.count(), store.current()) for s, t in counts.items()]
    return spark.createDataFrame(rows, "stage string, complete boolean, n_rows long, current string")


@query("pending_stages", "SELECT * FROM (VALUES ('', 9, 'Ingest'), ('Pass2', 5, 'GraphBuild'), ('SessionGen', 1, 'Complete'), ('Complete', 0, '')) v(current, n, next)")
def _(spark, d):
    rows = [(c, S.pending_stages(c or None)) for c in ("", "Pass2", "SessionGen", "Complete")]
    return spark.createDataFrame([(c, len(p), p[0] if p else "") for c, p in rows], "current string, n int, next string")


@query("export_round_trip", with_(s=X.sessions) + "SELECT book, number, title, content, number % 3 = 0 AS needs_review FROM s WHERE number % 4 <> 0 AND number % 8 <> 0 UNION ALL SELECT book, number, title, content, false FROM s WHERE number % 4 = 0 AND number % 8 <> 0")
def _(spark, d):
    progress = spark.createDataFrame([("s1", "bookmark", "4"), ("s1", "completed", "true"), ("s2", "bookmark", "0")], "session_id string, key string, value string")
    out = S.write_export(S.export_rows(results(spark, d)), progress, _folder(spark, "export"), datetime(2026, 1, 2))
    if S.read_progress(spark, out).count() != 3:
        raise ValueError("the progress came back short")
    return S.read_export(spark, out).select(F.col("book").cast("int").alias("book"), F.col("number").cast("int").alias("number"), "title", "content", "needs_review")


@query("first_book", with_(s=X.sessions) + "SELECT min(book) AS book FROM s WHERE number % 8 <> 0")
def _(spark, d):
    return spark.createDataFrame([(S.first_book(results(spark, d)),)], "book int")


# --- limits and progress ------------------------------------------------------------------------------------------------
@query("assign_keys", with_(r=X.rate_log, i="SELECT ts::DATE AS day, ord, tokens, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, ord) AS k FROM r",
    z="""SELECT day, 0::BIGINT AS k, 0::BIGINT AS ord, 0::BIGINT AS tokens, [0, 0, 0]::BIGINT[] AS used, 0 AS now, NULL::INT AS key FROM i WHERE k = 1
 UNION ALL SELECT day, k, ord, tokens, list_transform(used, lambda u, j: CASE WHEN j - 1 = pick THEN u + tokens ELSE u END), coalesce(pick, now), pick FROM (SELECT i.day, i.k, i.ord, i.tokens, z.used, z.now, list_filter(list_transform([0, 1, 2], lambda t: (z.now + t) % 3), lambda t: z.used[t + 1] + i.tokens <= 3000)[1]::INT AS pick FROM z JOIN i ON i.day = z.day AND i.k = z.k + 1) q""")
    + "SELECT day, ord, tokens, key FROM z WHERE k > 0")
def _(spark, d):
    return R.assign_keys(fixture(spark, d, X.rate_log), 3, 3000)


_BODY = """CASE event_id % 5 WHEN 0 THEN '{"session_id": "s' || user_id || '", "updates": {"completed": true, "bookmark": ' || event_id || '}}' WHEN 1 THEN '{"session_id": "s' || user_id || '", "bookmark_word_index": ' || event_id || '}'
 WHEN 2 THEN '{"session_id": "s' || user_id || '", "bookmark_word_index": null}' WHEN 3 THEN '{"session_id": "s' || user_id || '", "note": "n", "completed": false}' ELSE '{"completed": true}' END"""


def posts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.expr(_BODY).alias("body"), "ts", F.col("event_id").alias("ord"))


@query("progress_posts", """SELECT 's' || user_id AS session_id, k AS key, CASE WHEN event_id % 5 = 0 AND k = 'completed' THEN 'true' WHEN event_id % 5 = 3 AND k = 'completed' THEN 'false' WHEN k = 'note' THEN 'n' WHEN event_id % 5 = 2 THEN NULL ELSE event_id::VARCHAR END AS value, event_id AS ord, event_id % 5 = 2 AS deleted
 FROM events, (VALUES ('completed'), ('bookmark'), ('note')) v(k) WHERE (event_id % 5 = 0 AND k <> 'note') OR (event_id % 5 IN (1, 2) AND k = 'bookmark') OR (event_id % 5 = 3 AND k <> 'bookmark')""")
def _(spark, d):
    return R.progress_events(posts(spark, d)).select("session_id", "key", "value", "ord", "deleted")


@query("bookmark_posts", "SELECT 's' || user_id AS session_id, 'bookmark' AS key, CASE WHEN event_id % 3 = 0 THEN '0' ELSE event_id::VARCHAR END AS value, event_id AS ord FROM events WHERE event_id % 3 < 2")
def _(spark, d):
    i = F.col("event_id")
    index = F.when(i % 3 == 0, ', "word_index": 0').when(i % 3 == 1, F.concat(F.lit(', "word_index": '), i)).otherwise("")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit('{"session_id": "s'), "user_id", F.lit('"'), index, F.lit("}")).alias("body"), "ts", i.alias("ord"))
    events, refused = R.bookmark_events(e)
    return events.select("session_id", "key", "value", "ord")
