"""Registered queries of the graph, planning, progress and storage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import checks as C
from lectern.operators import generation as N
from lectern.operators import graph as G
from lectern.operators import model as M
from lectern.operators import planner as P
from lectern.operators import progress as R
from lectern.plans import fixtures as X
from lectern.plans.catalog import docs, query, with_
from lectern.plans.fixtures import fixture
from lectern.sources import store as S

# --- graph ----------------------------------------------------------------------------------------------------------
_DUP = "SELECT book, src, dst, source, 2 AS ord FROM e UNION ALL SELECT book, src, dst, 'inferred', 1 FROM e UNION ALL SELECT book, src, src, 'explicit', 0 FROM e"


@query("edges_dedup", with_(e=X.edges, u=_DUP) + "SELECT book, src, dst, source FROM (SELECT *, row_number() OVER (PARTITION BY book, src, dst ORDER BY CASE source WHEN 'explicit' THEN 1 WHEN 'implicit' THEN 2 WHEN 'cross_theme' THEN 3 ELSE 4 END, ord) AS k FROM u WHERE src <> dst) WHERE k = 1")
def _(spark, d):
    e = fixture(spark, d, X.edges)
    rows = e.withColumn("ord", F.lit(2)).unionByName(e.withColumns({"source": F.lit("inferred"), "ord": F.lit(1)})).unionByName(e.withColumns({"dst": F.col("src"), "source": F.lit("explicit"), "ord": F.lit(0)}))
    return G.dedup_edges(rows)


@query("edge_keys", with_(e=X.edges) + "SELECT book, src, dst FROM e WHERE length(src) % 7 <> 0")
def _(spark, d):
    e = fixture(spark, d, X.edges)
    k = F.length("dst") % 3
    rows = e.select("book", F.when(k == 0, F.col("src")).otherwise("").alias("from"), F.when(k == 1, F.col("src")).alias("source"), F.when(k == 2, F.col("src")).alias("prereq"),
        F.when(k == 0, F.col("dst")).alias("to"), F.when(k == 1, F.col("dst")).alias("target"), F.when(k == 2, F.col("dst")).alias("concept"), (F.length("src") % 7 == 0).alias("gone"))
    rows = rows.withColumns({c: F.when(F.col("gone"), None).otherwise(F.col(c)) for c in ("from", "source", "prereq")})
    return G.unify_keys(rows)


@query("known_edges", with_(c=X.concepts, e=X.edges) + "SELECT e.* FROM e JOIN (SELECT book, concept FROM c WHERE weight <> 'heavy') k ON k.book = e.book AND k.concept = e.src")
def _(spark, d):
    return G.known_edges(fixture(spark, d, X.edges), fixture(spark, d, X.concepts).filter("weight <> 'heavy'")).select("book", "src", "dst", "source")


@query("match_prerequisites", with_(c=X.concepts, t="SELECT DISTINCT book, CASE WHEN position % 3 = 0 THEN concept WHEN position % 3 = 1 THEN upper(split_part(concept, ' ', 1)) ELSE concept || ' in depth' END AS term FROM c",
    m="SELECT t.book, term, concept, row_number() OVER (PARTITION BY t.book, term ORDER BY term = concept DESC, ord) AS k FROM t JOIN c ON t.book = c.book AND (term = concept OR contains(lower(concept), lower(term)) OR contains(lower(term), lower(concept)))") + "SELECT book, term, concept FROM m WHERE k = 1")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    k = F.col("position") % 3
    term = F.when(k == 0, F.col("concept")).when(k == 1, F.upper(F.split_part(F.col("concept"), F.lit(" "), F.lit(1)))).otherwise(F.concat("concept", F.lit(" in depth")))
    return G.match_terms(c.select("book", term.alias("term")), c)


@query("strong_components", with_(e=X.loops) + """, n AS (SELECT book, src AS node FROM e UNION SELECT book, dst FROM e),
 r(book, a, b) AS (SELECT book, src, dst FROM e UNION SELECT r.book, a, dst FROM r JOIN e ON e.book = r.book AND e.src = r.b)
 SELECT n.book, node, least(node, coalesce(min(x.b), node)) AS component FROM n LEFT JOIN (SELECT p.book, p.a, p.b FROM r p JOIN r q ON q.book = p.book AND q.a = p.b AND q.b = p.a) x ON x.book = n.book AND x.a = node GROUP BY n.book, node""")
def _(spark, d):
    return G.strong_components(fixture(spark, d, X.loops))


@query("orphans", with_(c=X.concepts, e=X.edges) + "SELECT book, concept FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.book = c.book AND (e.src = c.concept OR e.dst = c.concept))")
def _(spark, d):
    return G.orphans(fixture(spark, d, X.concepts), fixture(spark, d, X.edges))


@query("graph_counts", with_(c=X.concepts, e=X.edges) + "SELECT book, count(*) AS total_concepts, (SELECT count(*) FROM e WHERE e.book = c.book) AS total_edges, count(*) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE e.book = c.book AND (e.src = c.concept OR e.dst = c.concept))) AS orphan_count FROM c GROUP BY book")
def _(spark, d):
    return G.graph_counts(fixture(spark, d, X.concepts), fixture(spark, d, X.edges))


_CORE = "down AS (SELECT book, src, dst FROM l UNION SELECT d.book, d.src, l.dst FROM down d JOIN l ON l.book = d.book AND l.src = d.dst), on_loop AS (SELECT DISTINCT book, src AS node FROM down WHERE src = dst), core AS (SELECT node, book FROM on_loop UNION SELECT b.dst, b.book FROM down b JOIN on_loop x ON x.book = b.book AND x.node = b.src JOIN down f ON f.book = b.book AND f.src = b.dst JOIN on_loop y ON y.book = f.book AND y.node = f.dst)"


@query("cycle_nodes", with_(l=X.loops) + ", " + _CORE + " SELECT book, node FROM core")
def _(spark, d):
    return G.cycle_core(fixture(spark, d, X.loops))


@query("break_cycles", with_(e=X.rings, k="SELECT *, dense_rank() OVER (PARTITION BY book ORDER BY least(src, dst)) AS n FROM e") + "SELECT book, src, dst, source FROM k WHERE n > 3 OR src < dst")
def _(spark, d):
    return G.break_cycles(fixture(spark, d, X.rings))


@query("break_all_cycles", with_(l=X.loops) + ", " + _CORE + " SELECT book, count(DISTINCT node) AS on_cycles, 0 AS left_over FROM core GROUP BY book")
def _(spark, d):
    """All closing edges go, after which no node is on a cycle."""
    e = fixture(spark, d, X.loops)
    nodes = G.cycle_core(e).groupBy("book").agg(F.count(F.lit(1)).alias("on_cycles"))
    rest = G.cycle_core(G.break_cycles(e, most=1 << 30)).groupBy("book").agg(F.count(F.lit(1)).cast("int").alias("left_over"))
    return nodes.join(rest, "book", "left").na.fill(0)


_TIERS = "walk AS (SELECT book, concept, 0 AS depth FROM c UNION ALL SELECT w.book, e.dst, w.depth + 1 FROM walk w JOIN e ON e.book = w.book AND e.src = w.concept), tiers AS (SELECT book, concept, max(depth)::INT AS tier FROM walk GROUP BY ALL)"


@query("dependency_tiers", with_(c=X.concepts, e=X.edges) + ", " + _TIERS + " SELECT * FROM tiers")
def _(spark, d):
    return G.tiers(fixture(spark, d, X.concepts), fixture(spark, d, X.edges))


_ORDER = "pos AS (SELECT c.book, c.concept, (row_number() OVER (PARTITION BY c.book ORDER BY tier, cluster, ord))::INT AS position FROM c JOIN tiers t ON t.book = c.book AND t.concept = c.concept)"


@query("cluster_grouped_order", with_(c=X.concepts, e=X.edges) + ", " + _TIERS + ", " + _ORDER + " SELECT * FROM pos")
def _(spark, d):
    return G.grouped_order(fixture(spark, d, X.concepts), fixture(spark, d, X.edges))


@query("order_violations", with_(c=X.concepts, e=X.edges) + "SELECT e.book, src, dst FROM e JOIN c a ON a.book = e.book AND a.concept = src JOIN c b ON b.book = e.book AND b.concept = dst WHERE a.position % 10 >= b.position % 10")
def _(spark, d):
    return G.order_violations(fixture(spark, d, X.concepts).withColumn("position", F.col("position") % 10), fixture(spark, d, X.edges))


# --- planner --------------------------------------------------------------------------------------------------------
_PACKED = """i AS (SELECT book, concept, weight, position, row_number() OVER (PARTITION BY book ORDER BY position) AS k, CASE weight WHEN 'heavy' THEN 3 WHEN 'light' THEN 1 ELSE 2 END AS w FROM c),
 fold AS (SELECT book, k, concept, weight, position, 1 AS number, CASE WHEN w = 3 THEN 0 ELSE 1 END AS n, CASE WHEN w = 3 THEN 0 ELSE w END AS s, w = 3 AS closed FROM i WHERE k = 1
  UNION ALL SELECT i.book, i.k, i.concept, i.weight, i.position, f.number + CASE WHEN f.closed OR (f.n > 0 AND (i.w = 3 OR f.s + i.w > 6 OR f.n >= 5)) THEN 1 ELSE 0 END,
  CASE WHEN i.w = 3 THEN 0 WHEN f.n > 0 AND (f.s + i.w > 6 OR f.n >= 5) THEN 1 WHEN f.n >= 2 AND f.s + i.w >= 6 THEN 0 ELSE f.n + 1 END,
  CASE WHEN i.w = 3 THEN 0 WHEN f.n > 0 AND (f.s + i.w > 6 OR f.n >= 5) THEN i.w WHEN f.n >= 2 AND f.s + i.w >= 6 THEN 0 ELSE f.s + i.w END,
  i.w = 3 OR (NOT (f.n > 0 AND (f.s + i.w > 6 OR f.n >= 5)) AND f.n >= 2 AND f.s + i.w >= 6) FROM fold f JOIN i ON i.book = f.book AND i.k = f.k + 1),
 packed AS (SELECT book, position, concept, weight, number FROM fold)"""


def members(spark, d):
    c = fixture(spark, d, X.concepts)
    return P.pack(c).join(c.select("book", "concept", "weight", "cluster", "description"), ["book", "concept"])


@query("pack_sessions", with_(c=X.concepts) + ", " + _PACKED + " SELECT book, position, concept, number FROM packed")
def _(spark, d):
    return P.pack(fixture(spark, d, X.concepts))


@query("session_minutes", with_(c=X.concepts) + ", " + _PACKED + ", t AS (SELECT book, number, count(*) AS concept_count, sum(CASE weight WHEN 'heavy' THEN 3 WHEN 'light' THEN 1 ELSE 2 END)::BIGINT AS total_weight FROM packed GROUP BY ALL) SELECT *, greatest(10, least(20, floor(total_weight * 1.5)::INT + 3)) AS estimated_minutes FROM t")
def _(spark, d):
    return P.session_totals(members(spark, d))


@query("session_tier_order", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", " + _TIERS + ", m AS (SELECT p.book, number, max(tier) AS max_tier FROM packed p JOIN tiers t ON t.book = p.book AND t.concept = p.concept GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY book ORDER BY max_tier, number))::INT AS new_number FROM m")
def _(spark, d):
    c, e = fixture(spark, d, X.concepts), fixture(spark, d, X.edges)
    return P.tier_order(P.pack(c), G.tiers(c, e))


_MOVES = """b AS (SELECT book, dst AS src, src AS dst FROM e WHERE length(dst) % 5 = 0),
 t AS (SELECT p.book, list({'s': p.number, 'c': p.position, 'q': b.src, 'p': r.number}) AS needs FROM packed p JOIN b ON b.book = p.book AND b.dst = p.concept JOIN packed r ON r.book = p.book AND r.concept = b.src GROUP BY p.book),
 o AS (SELECT k.book, list(DISTINCT k.number ORDER BY k.number) AS line FROM packed k GROUP BY k.book),
 moved AS (SELECT o.book, line, 0 AS pass, coalesce(needs, []) AS needs FROM o LEFT JOIN t ON t.book = o.book
  UNION ALL SELECT book, line[1:first.i - 1] || [first.p] || list_filter(line[first.i:], lambda y: y <> first.p), pass + 1, needs FROM (SELECT *, list_sort(list_transform(list_filter(needs, lambda x: list_position(line, x.p) > list_position(line, x.s)),
   lambda x: {'i': list_position(line, x.s), 'c': x.c, 'q': x.q, 'p': x.p}))[1] AS first FROM moved) m WHERE first IS NOT NULL AND pass < len(line)),
 final AS (SELECT book, max_by(line, pass) AS line FROM moved GROUP BY book)"""


@query("repair_order", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", " + _MOVES + " SELECT book, unnest(line) AS number, generate_subscripts(line, 1)::INT AS new_number FROM final")
def _(spark, d):
    back = fixture(spark, d, X.edges).select("book", F.col("dst").alias("src"), F.col("src").alias("dst")).filter("length(src) % 5 = 0")
    return P.repair_order(P.pack(fixture(spark, d, X.concepts)), back)


_CAND = "cand AS (SELECT n.book, n.number, p.concept, n.number - p.number AS back, p.weight FROM (SELECT DISTINCT book, number FROM packed) n JOIN packed p ON p.book = n.book AND p.number BETWEEN n.number - 10 AND n.number - 2)"
_SCORE = "score AS (SELECT k.*, round(CASE WHEN EXISTS (SELECT 1 FROM e JOIN packed q ON q.book = e.book AND q.concept = e.dst WHERE e.book = k.book AND e.src = k.concept AND q.number = k.number) THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END + CASE weight WHEN 'heavy' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * 0.3::DOUBLE + CASE WHEN back BETWEEN 4 AND 5 THEN 1.0::DOUBLE WHEN back BETWEEN 3 AND 7 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END * 0.1::DOUBLE, 6) AS score FROM cand k)"


@query("revisit_candidates", with_(c=X.concepts) + ", " + _PACKED + ", " + _CAND + " SELECT * FROM cand")
def _(spark, d):
    return P.revisit_candidates(members(spark, d))


def scores(spark, d):
    m = members(spark, d)
    return P.revisit_scores(P.revisit_candidates(m), m, fixture(spark, d, X.edges).select("book", F.col("src").alias("concept"), F.col("dst").alias("other")))


@query("revisit_scores", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", " + _CAND + ", " + _SCORE + " SELECT * FROM score")
def _(spark, d):
    return scores(spark, d)


@query("revisit_best", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", " + _CAND + ", " + _SCORE + " SELECT book, number, concept, score FROM (SELECT *, row_number() OVER (PARTITION BY book, number ORDER BY score DESC, concept DESC) AS k FROM score) WHERE k = 1")
def _(spark, d):
    return P.best_revisit(scores(spark, d))


_ONCE = """lists AS (SELECT book, number, row_number() OVER (PARTITION BY book ORDER BY number) AS k, list({'concept': concept, 'score': score} ORDER BY score DESC, concept DESC) AS cs FROM score GROUP BY book, number),
 once AS (SELECT book, k, number, cs[1] AS pick, [cs[1].concept] AS used FROM lists WHERE k = 1 UNION ALL SELECT l.book, l.k, l.number, list_filter(l.cs, lambda x: NOT list_contains(o.used, x.concept))[1],
  list_append(o.used, list_filter(l.cs, lambda x: NOT list_contains(o.used, x.concept))[1].concept) FROM once o JOIN lists l ON l.book = o.book AND l.k = o.k + 1)"""


@query("revisit_once", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", " + _CAND + ", " + _SCORE + ", " + _ONCE + " SELECT book, number, pick.concept AS concept, pick.score AS score FROM once WHERE pick IS NOT NULL")
def _(spark, d):
    return P.revisit_once(scores(spark, d))


@query("revisit_reason", with_(c=X.concepts) + "SELECT book, concept, CASE WHEN position % 3 = 0 THEN concept || ' contrasts with ' || cluster || ', now visible from this session''s vantage point' WHEN position % 3 = 1 THEN concept || ' shaped the constraints that make ' || description || ' necessary — the earlier design decision becomes visible from this vantage point' ELSE concept || ' connects to this session''s core mechanisms in ways not apparent when first introduced' END AS reason FROM c")
def _(spark, d):
    k = F.col("position") % 3
    return fixture(spark, d, X.concepts).select("book", "concept", P.revisit_reason(F.col("concept"), F.lit("contrasts with"), F.when(k == 0, F.col("cluster")), F.when(k == 1, F.col("description"))).alias("reason"))


_TOK = "list_distinct(list_filter(list_transform(regexp_extract_all(lower({}), '\\S+'), lambda w: trim(w, '\"''.,;:!?')), lambda w: w <> ''{}))"
_STOP = " AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


@query("title_alignment", with_(s=X.sessions) + f"SELECT book, number, list_has_any({_TOK.format('title', _STOP)}, {_TOK.format('array_to_string(concepts, chr(32)) || chr(32) || CASE WHEN number % 3 = 0 THEN substring(content, 1, 60) ELSE chr(32) END', _STOP)}) AS aligned FROM s")
def _(spark, d):
    about = F.array(F.when(F.col("number") % 3 == 0, F.substring("content", 1, 60)).otherwise(" "))
    return P.title_alignment(fixture(spark, d, X.sessions).withColumn("descriptions", about))


@query("valid_title", with_(s=X.sessions) + r"SELECT book, number, CASE WHEN len(regexp_extract_all(title, '\S+')) BETWEEN 4 AND 10 OR (number % 2 = 0 AND len(regexp_extract_all(title, '\S+')) BETWEEN 2 AND 10) THEN title WHEN number % 2 = 0 THEN CASE WHEN len(concepts) >= 2 THEN concepts[1] || ' & ' || concepts[2] ELSE concepts[1] END ELSE CASE WHEN len(concepts) >= 2 THEN concepts[1] || ' & ' || concepts[2] ELSE concepts[1] END END AS title FROM s")
def _(spark, d):
    s = fixture(spark, d, X.sessions)
    short = F.when((F.col("number") % 2 == 1) & (T.word_count(F.col("title")) < 4), "x").otherwise(F.col("title"))
    return s.select("book", "number", P.valid_title(short, F.col("concepts")).alias("title"))


@query("duplicate_titles", with_(s=X.sessions, k=f"SELECT *, lower(trim(title)) AS key, len(list_intersect({_TOK.format('title', '')}, {_TOK.format(chr(97) + 'rray_to_string(concepts, chr(32))', '')})) AS shared FROM s", c="SELECT *, count(*) OVER (PARTITION BY book, key) AS copies, row_number() OVER (PARTITION BY book, key ORDER BY shared DESC, number) = 1 AS keep FROM k") + "SELECT book, number, title, copies, keep FROM c WHERE copies > 1")
def _(spark, d):
    return P.duplicate_titles(fixture(spark, d, X.sessions))


@query("overcoverage", with_(s=X.sessions, f="SELECT book, number, lower(title) AS title, unnest(concepts) AS concept, generate_subscripts(concepts, 1) AS i FROM s") + r", p AS (SELECT * FROM f WHERE i = 1 OR len(list_filter(regexp_extract_all(lower(concept), '\S+')[1:3], lambda w: length(w) > 4 AND contains(title, w))) > 0) SELECT book, concept, count(*) AS session_count, array_to_string(list(number ORDER BY number), ',') AS sessions FROM p GROUP BY book, concept HAVING count(*) >= 3")
def _(spark, d):
    return P.overcoverage(fixture(spark, d, X.sessions)).withColumn("sessions", F.array_join(F.col("sessions").cast("array<string>"), ","))


@query("index_metadata", with_(s=X.sessions) + "SELECT book, count(*) AS total_sessions, sum(len(concepts))::BIGINT AS total_concepts, count(*) FILTER (number > 2) AS revisit_connections, sum(CASE WHEN number % 9 = 0 THEN 15 ELSE 12 END)::BIGINT AS estimated_total_minutes FROM s GROUP BY book")
def _(spark, d):
    s = fixture(spark, d, X.sessions).withColumns({"concept_count": F.size("concepts"), "revisit": F.when(F.col("number") > 2, "x"), "estimated_minutes": F.when(F.col("number") % 9 != 0, 12)})
    return P.index_metadata(s)


@query("dominant_cluster", with_(c=X.concepts) + ", " + _PACKED + ", n AS (SELECT p.book, number, cluster, count(*) AS n, min(p.position) AS f FROM packed p JOIN c ON c.book = p.book AND c.concept = p.concept GROUP BY ALL) SELECT book, number, cluster FROM (SELECT *, row_number() OVER (PARTITION BY book, number ORDER BY n DESC, f) AS k FROM n) WHERE k = 1")
def _(spark, d):
    return P.dominant_cluster(members(spark, d))


@query("prev_next_context", with_(s=X.sessions, g="SELECT * REPLACE (number + number // 13 AS number) FROM s") + r"SELECT book, number, printf('%02d', number) AS label, (row_number() OVER w)::INT AS position, lag(number) OVER w AS previous, lead(number) OVER w AS next, CASE WHEN lag(number) OVER w = number - 1 THEN lag(CASE WHEN len(regexp_extract_all(content, '\S+')) < 80 THEN content ELSE array_to_string(regexp_extract_all(content, '\S+')[-80:], ' ') END) OVER w ELSE '' END AS previous_ending, lead(concepts[1]) OVER w AS next_concept FROM g WINDOW w AS (PARTITION BY book ORDER BY number)")
def _(spark, d):
    # Every thirteenth number is left out, so that some sessions have no neighbour.
    return P.reading_context(fixture(spark, d, X.sessions).withColumn("number", F.col("number") + F.floor(F.col("number") / 13).cast("int")))


@query("revisit_slot", with_(c=X.concepts) + ", " + _PACKED + " SELECT book, number, greatest(0, count(*) - 2)::INT AS slot FROM packed GROUP BY ALL")
def _(spark, d):
    return P.revisit_slot(members(spark, d))


@query("concept_neighbours", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", r AS (SELECT p.book, p.number, p.concept, 'prerequisite' AS role, e.src AS name FROM packed p JOIN e ON e.book = p.book AND e.dst = p.concept UNION ALL SELECT p.book, p.number, p.concept, 'dependent', e.dst FROM packed p JOIN e ON e.book = p.book AND e.src = p.concept WHERE NOT EXISTS (SELECT 1 FROM packed q WHERE q.book = p.book AND q.number = p.number AND q.concept = e.dst)) SELECT r.book, number, r.concept, role, coalesce(c.description, name) AS other FROM r LEFT JOIN c ON c.book = r.book AND c.concept = name")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    return G.neighbours(members(spark, d), fixture(spark, d, X.edges), c)


# --- progress and limits --------------------------------------------------------------------------------------------
_LATEST = "latest AS (SELECT session_id, k AS key, max_by(value, ord) AS value, max_by(deleted, ord) AS deleted FROM (SELECT *, CASE WHEN key = 'bookmark_word_index' THEN 'bookmark' ELSE key END AS k, row_number() OVER (ORDER BY ts, ord) AS o FROM p) GROUP BY session_id, k)".replace("max_by(value, ord)", "max_by(value, o)").replace("max_by(deleted, ord)", "max_by(deleted, o)")


@query("progress_latest", with_(p=X.progress) + ", " + _LATEST + " SELECT session_id, key, value FROM latest WHERE NOT deleted")
def _(spark, d):
    return R.latest(fixture(spark, d, X.progress))


_STATUS = "st AS (SELECT session_id, max(CASE WHEN key = 'completed' THEN value = 'true' END) AS done, max(CASE WHEN key = 'bookmark' THEN value::INT END) AS b FROM latest WHERE NOT deleted GROUP BY session_id), status AS (SELECT session_id, CASE WHEN coalesce(done, false) THEN 'complete' WHEN b IS NOT NULL THEN 'in-progress' ELSE 'none' END AS status, CASE WHEN NOT coalesce(done, false) THEN b END AS bookmark FROM st)"


@query("feed_status", with_(p=X.progress) + ", " + _LATEST + ", " + _STATUS + " SELECT * FROM status")
def _(spark, d):
    return R.feed_status(R.latest(fixture(spark, d, X.progress)))


@query("completed_count", with_(p=X.progress) + ", " + _LATEST + ", " + _STATUS + " SELECT count(*) FILTER (status = 'complete') AS completed, count(*) AS total FROM status")
def _(spark, d):
    return R.completed_count(R.feed_status(R.latest(fixture(spark, d, X.progress))))


@query("dwell_completion", "SELECT event_id, user_id, coalesce(date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 7200000000, false) AS done FROM events")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ord", F.col("event_id"))
    return R.dwell(e, 7200).select("event_id", "user_id", "done")


@query("settled_tokens", with_(r=X.rate_log) + "SELECT key_id, ord AS request_id, ts, CASE WHEN ord % 3 = 0 AND ord % 20 <= 10 THEN 2 * tokens ELSE tokens END AS tokens, ord % 3 = 0 AND ord % 20 <= 10 AS settled FROM r")
def _(spark, d):
    r = fixture(spark, d, X.rate_log).withColumnRenamed("ord", "request_id")
    reports = r.filter("request_id % 3 = 0").select("request_id", (F.col("ts") + F.make_interval(mins=(F.col("request_id") % 20).cast("int"))).alias("reported"), (2 * F.col("tokens")).alias("actual"))
    return R.settled_tokens(r, reports)


@query("rate_window", with_(r=X.rate_log) + "SELECT ord, key_id, count(*) OVER w AS requests, (sum(tokens) OVER w)::BIGINT AS tokens_in_window, count(*) OVER w = 1 OR (count(*) OVER w <= 3 AND sum(tokens) OVER w <= 900) AS admitted FROM r WINDOW w AS (PARTITION BY key_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)")
def _(spark, d):
    out = R.rate_window(fixture(spark, d, X.rate_log), ["key_id"], 3600)
    return out.select("ord", "key_id", "requests", "tokens_in_window", R.admitted(F.col("requests"), F.col("tokens_in_window"), 3, 900).alias("admitted"))


@query("actual_tokens", with_(r=X.rate_log) + "SELECT ord, key_id, CASE WHEN row_number() OVER (PARTITION BY key_id ORDER BY ts DESC, ord DESC) = 1 THEN 7 ELSE tokens END AS tokens FROM r")
def _(spark, d):
    return R.corrected(fixture(spark, d, X.rate_log).withColumn("actual", F.lit(7).cast("long"))).select("ord", "key_id", "tokens")


@query("daily_quota", with_(r=X.rate_log) + "SELECT key_id, ts::DATE AS day, sum(tokens)::BIGINT AS used, sum(tokens) + 500 > 24000 AS would_exceed FROM r GROUP BY ALL")
def _(spark, d):
    return R.daily_quota(fixture(spark, d, X.rate_log), 24_000, 500)


_SENT = """i AS (SELECT key_id, ord, tokens, epoch_us(ts) / 1000000.0::DOUBLE AS asked, row_number() OVER (PARTITION BY key_id ORDER BY ts, ord) AS k FROM r),
 z AS (SELECT key_id, k, ord, tokens, asked, asked AS now, []::STRUCT(t DOUBLE, n BIGINT)[] AS recent, false AS sent FROM i WHERE k = 1
  UNION ALL SELECT key_id, CASE WHEN sent THEN nk ELSE k END, CASE WHEN sent THEN nord ELSE ord END, CASE WHEN sent THEN ntokens ELSE tokens END, CASE WHEN sent THEN nasked ELSE asked END,
   CASE WHEN sent THEN greatest(nasked, now) WHEN fits THEN now ELSE live[1].t + 7200 + 1e-6::DOUBLE END, CASE WHEN sent THEN recent WHEN fits THEN list_append(live, {'t': now, 'n': tokens}) ELSE live END, NOT sent AND fits
   FROM (SELECT *, len(live) = 0 OR (len(live) < 3 AND list_sum(list_transform(live, lambda x: x.n)) + tokens <= 900) AS fits
    FROM (SELECT z.*, i.k AS nk, i.ord AS nord, i.tokens AS ntokens, i.asked AS nasked, list_filter(recent, lambda x: x.t >= now - 7200) AS live FROM z LEFT JOIN i ON z.sent AND i.key_id = z.key_id AND i.k = z.k + 1 WHERE NOT z.sent OR i.k IS NOT NULL) a) b)"""


@query("request_waits", with_(r=X.rate_log) + ", " + _SENT + " SELECT key_id, ord, round(now - asked, 3) AS wait_s FROM z WHERE sent")
def _(spark, d):
    return R.waits(fixture(spark, d, X.rate_log), 3, 900, 7200)


# --- storage --------------------------------------------------------------------------------------------------------
def results(spark, d):
    s = fixture(spark, d, X.sessions)
    return s.select("book", "number", "title", F.when(F.col("number") % 8 == 0, "").otherwise(F.col("content")).alias("content"), F.when(F.col("number") % 4 != 0, F.col("number") % 3 == 0).alias("needs_review"),
        F.lit("x").alias("tension_excerpt"), F.element_at(F.array(F.lit("SessionGen"), F.lit("IndexGen"), F.lit("Complete")), (F.least(F.col("number"), F.col("book") % 3 + 1)).cast("int")).alias("stage"), F.lit(1).alias("version"))


_RES = "res AS (SELECT book, number, title, CASE WHEN number % 8 = 0 THEN '' ELSE content END AS content, CASE WHEN number % 4 <> 0 THEN number % 3 = 0 END AS needs_review FROM s)"


@query("pending_sessions", with_(s=X.sessions) + ", " + _RES + " SELECT book, number FROM res WHERE content = ''")
def _(spark, d):
    r = results(spark, d)
    return S.pending_sessions(r.select("book", "number"), r)


@query("export_sessions", with_(s=X.sessions) + ", " + _RES + " SELECT book, number, title, content, coalesce(needs_review, false) AS needs_review FROM res WHERE content <> ''")
def _(spark, d):
    return S.export_rows(results(spark, d))


@query("list_books", with_(s=X.sessions) + ", " + _RES + " SELECT book, count(*) FILTER (content <> '') AS n_sessions, CASE WHEN book % 3 = 2 AND max(number) >= 3 THEN 'Complete' ELSE 'SessionGen' END AS stage FROM res GROUP BY book")
def _(spark, d):
    return S.list_books(results(spark, d))


@query("session_lookup", with_(s=X.sessions) + "SELECT book, number, title FROM s WHERE number = 7")
def _(spark, d):
    return results(spark, d).filter("number = 7").select("book", "number", "title")


@query("upsert_results", with_(s=X.sessions) + "SELECT book, number, CASE WHEN number % 5 = 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN number % 5 = 0 THEN 2 ELSE 1 END AS version FROM s")
def _(spark, d):
    r = results(spark, d).select("book", "number", "title", "version")
    new = r.filter("number % 5 = 0").withColumns({"title": F.concat(F.lit("new "), "title"), "version": F.lit(2)})
    return S.upsert(r, new, ["book", "number"], "version")


@query("keyed_results", with_(s=X.sessions) + "SELECT book, number, CASE WHEN number % 5 = 0 THEN 'new ' || title ELSE title END AS title FROM s WHERE number % 7 <> 0 OR number % 10 = 0")
def _(spark, d):
    r = fixture(spark, d, X.sessions).select("book", "number", "title")
    store = S.KeyedStore(spark, S.work_folder(spark, "keyed-results"), ("book", "number"))
    store.upsert(r)
    store.upsert(r.filter("number % 5 = 0").withColumn("title", F.lit("old")))
    store.delete(r.filter("number % 7 = 0"))
    store.compact()
    store.upsert(r.filter("number % 5 = 0 AND (number % 7 <> 0 OR number % 10 = 0)").withColumn("title", F.concat(F.lit("new "), "title")))
    return store.read()


@query("static_bundle", with_(s=X.sessions) + r"""SELECT book, number, '{"book":' || book || ',"number":' || number || ',"title":' || to_json(title) || ',"words":' || len(regexp_extract_all(content, '\S+')) || '}' AS json FROM s""")
def _(spark, d):
    s = fixture(spark, d, X.sessions)
    return S.bundle_json(s.select("book", "number", "title", T.word_count(F.col("content")).alias("words"), F.lit(True).alias("needs_review"), F.lit("x").alias("tension_excerpt")))


@query("index_text", with_(c=X.concepts) + ", " + _PACKED + ", g AS (SELECT p.book, number, string_agg('  -> ' || p.concept || ': ' || c.description, chr(10) ORDER BY p.position) AS cs FROM packed p JOIN c ON c.book = p.book AND c.concept = p.concept GROUP BY p.book, number), l AS (SELECT book, number, 'Session ' || printf('%02d', number) || ': Part ' || number || ' (' || (9 + number) || ' min)' || chr(10) || cs || chr(10) || CASE WHEN number > 2 THEN '  <- first: again' || chr(10) ELSE '' END AS line FROM g) SELECT book, string_agg(line, chr(10) ORDER BY number) AS text FROM l GROUP BY book")
def _(spark, d):
    m = members(spark, d)
    concepts = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("concept").alias("name"), "description"))), lambda c: F.struct(c["name"].alias("name"), c["description"].alias("description")))
    index = m.groupBy("book", "number").agg(concepts.alias("concepts"))
    revisit = F.when(F.col("number") > 2, F.struct(F.lit("first").alias("name"), F.lit("again").alias("reason")))
    return S.index_text(index.select("book", "number", F.concat(F.lit("Part "), "number").alias("title"), (F.col("number") + 9).alias("estimated_minutes"), "concepts", revisit.alias("revisit")))


@query("index_valid", with_(s=X.sessions) + "SELECT book, bool_and(len(concepts) > 0 AND title IS NOT NULL) AS valid FROM s GROUP BY book")
def _(spark, d):
    return S.index_valid(fixture(spark, d, X.sessions).withColumn("estimated_minutes", F.lit(12)))


# --- model seam -----------------------------------------------------------------------------------------------------
@query("model_verdicts", with_(s=X.sessions) + "SELECT book, number, contains(content, '?') AS passed FROM s")
def _(spark, d):
    from lectern.functions.jsonx import verdict

    s = fixture(spark, d, X.sessions)
    return s.select("book", "number", verdict(M.ask("binary", F.col("content"))["answer"])["passed"].alias("passed"))


def planned(spark, d):
    """Sessions of concepts with titles, as an index."""
    m = members(spark, d)
    concepts = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("concept").alias("name"), "description"))), lambda c: F.struct(c["name"].alias("name"), c["description"].alias("description")))
    revisit = F.when(F.col("number") > 2, F.struct(F.lit("cache").alias("name"), F.lit("again").alias("reason")))
    return m.groupBy("book", "number").agg(concepts.alias("concepts")).withColumn("revisit", revisit).withColumn("title", F.concat(F.lit("Part "), "number"))


_LISTED = "[passage, cluster, weight, concept, 'more']"


@query("section_context", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", " + rf"""k AS (SELECT book, concept, description, weight, cluster, position, repeat(description || ' ', 40) AS passage FROM c WHERE position % 4 <> 0),
 told AS (SELECT DISTINCT e.book, src, dst, description AS told FROM e JOIN k ON k.book = e.book AND k.concept = e.src),
 needs AS (SELECT book, dst, list(told ORDER BY src)[1:2] AS needs FROM told GROUP BY book, dst),
 m AS (SELECT p.book, p.number, p.position AS place, p.concept AS name, c.description AS planned FROM packed p JOIN c ON c.book = p.book AND c.concept = p.concept),
 back AS (SELECT book, number + 2 AS number, min(name) AS name FROM m GROUP BY book, number),
 s AS (SELECT m.book, m.number, place, concat_ws('|', name, coalesce(k.description, planned), coalesce(weight, 'medium'), coalesce(passage[1:400], ''), coalesce(array_to_string(list_transform({_LISTED.replace("passage", "passage[1:250]")}[1:2], lambda x: x), ','), ''),
  coalesce(cluster, ''), CASE WHEN k.book IS NULL THEN '' ELSE array_to_string(['a', concept, 'b', 'c'], ',') END, CASE WHEN k.book IS NULL THEN '' ELSE array_to_string([concept, weight, cluster], ',') END, CASE WHEN k.position % 2 = 0 THEN 'true' ELSE 'false' END, coalesce(array_to_string(needs, ','), ''), coalesce(weight, '')) AS line
  FROM m LEFT JOIN k ON k.book = m.book AND k.concept = m.name LEFT JOIN needs n ON n.book = m.book AND n.dst = m.name)
 SELECT s.book, s.number, string_agg(line, chr(10) ORDER BY place) AS sections, any_value(CASE WHEN b.name IS NOT NULL THEN concat_ws('|', b.name, 'again', coalesce(k.description, ''), coalesce(passage[1:300], '')) END) AS back
 FROM s LEFT JOIN back b ON b.book = s.book AND b.number = s.number LEFT JOIN k ON k.book = s.book AND k.concept = b.name GROUP BY s.book, s.number""")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    index = planned(spark, d)
    back = index.select("book", (F.col("number") + 2).alias("number"), F.struct(F.array_min(F.transform("concepts", lambda x: x["name"])).alias("name"), F.lit("again").alias("reason")).alias("revisit"))
    index = index.drop("revisit").join(back, ["book", "number"], "left")
    passage = F.expr("repeat(concat(description, ' '), 40)")
    told = c.filter("position % 4 <> 0").withColumns(
        {
            "passage": passage, "passages": F.array(passage, "cluster", "weight", "concept", F.lit("more")), "anchor": F.col("cluster"), "assumed": F.array(F.lit("a"), "concept", F.lit("b"), F.lit("c"), F.lit("d")),
            "contrasts": F.array("concept", "weight", "cluster", F.lit("more")), "enrich": F.col("position") % 2 == 0, "about": F.col("weight"),
        }
    )
    out = N.section_context(index, told, fixture(spark, d, X.edges))
    listed = lambda a: F.array_join(a, ",")
    line = lambda s: F.concat_ws("|", s["name"], s["description"], s["weight"], s["passage"], listed(s["passages"]), s["anchor"], listed(s["assumed"]), listed(s["contrasts"]), s["enrich"].cast("string"), listed(s["needs"]), s["about"])
    back = F.when(F.col("back").isNotNull(), F.concat_ws("|", "back.name", "back.reason", "back.description", "back.passage"))
    return out.select("book", "number", F.array_join(F.transform("sections", line), "\n").alias("sections"), back.alias("back"))


@query("generate_sessions")
def _(spark, d):
    return N.generate_in_order(planned(spark, d))


_NAMED = "s1 AS (SELECT book, number, concepts AS c, 'Title and ' || concepts[1] AS title FROM s WHERE len(concepts) > 0)"
_SHARED = f"len(list_intersect({_TOK.format('title', '')}, {_TOK.format(chr(97) + 'rray_to_string(c, chr(32))', '')}))"


@query("session_titles", with_(s=X.sessions) + ", " + _NAMED + f", r AS (SELECT *, row_number() OVER (PARTITION BY book, lower(title) ORDER BY {_SHARED} DESC, number) AS k, list_filter(c, lambda x: x <> c[1]) AS d FROM s1)"
    " SELECT book, number, CASE WHEN k = 1 THEN title WHEN len(d) > 0 THEN c[1] || ' and ' || d[1] WHEN len(c) >= 2 THEN c[1] || ' & ' || c[2] ELSE c[1] END AS title FROM r")
def _(spark, d):
    return N.with_titles(fixture(spark, d, X.sessions).select("book", "number", "concepts").filter("size(concepts) > 0")).select("book", "number", "title")


def evaluated(spark, d):
    s = fixture(spark, d, X.sessions).withColumn("revisit", F.when(F.col("number") > 3, F.try_element_at("concepts", F.lit(1))))
    return s.select("book", "number", "content", "concepts", "revisit")


@query("infer_edges", with_(k=X.concepts, c="SELECT floor(book / 2.0)::BIGINT AS book, concept, ord FROM k", n="SELECT *, count(*) OVER (PARTITION BY book) AS n, lag(concept) OVER (PARTITION BY book ORDER BY ord) AS src FROM c")
    + "SELECT book, src, concept AS dst, 'Inferred: listed earlier' AS reason, 'inferred' AS source FROM n WHERE n > 50 AND src IS NOT NULL")
def _(spark, d):
    c = fixture(spark, d, X.concepts).withColumn("book", F.floor(F.col("book") / 2))
    return N.infer_edges(c.select("book", "concept", "description", "ord"))


@query("derive_edges", with_(c=X.concepts, e=X.edges, u="SELECT book, src, dst, 1 AS r FROM e WHERE source = 'explicit' UNION ALL SELECT book, src, dst, 2 FROM e WHERE source = 'implicit' UNION ALL SELECT book, src, dst, 3 FROM e WHERE source = 'cross_theme' UNION ALL SELECT book, src, dst, 4 FROM e", m="SELECT book, src, dst, min(r) AS r FROM u GROUP BY ALL") + "SELECT book, src, dst, ['explicit', 'implicit', 'cross_theme', 'inferred'][r] AS source FROM m")
def _(spark, d):
    e, c = fixture(spark, d, X.edges), fixture(spark, d, X.concepts)
    of = lambda s: e.filter(F.col("source") == s)
    return N.derive_edges(c, of("explicit").select("book", F.col("dst").alias("concept"), F.col("src").alias("refers_to")), of("implicit").select("book", F.col("dst").alias("concept"), F.col("src").alias("term")),
        of("cross_theme").select("book", F.col("dst").alias("concept"), F.col("src").alias("other")), e.select("book", "src", "dst"))


@query("drop_duplicate_concepts", with_(k=X.concepts, c="SELECT floor(book / 3.0)::BIGINT AS book, description AS concept, '' AS description, ord FROM k",
    n="SELECT *, count(*) OVER (PARTITION BY book) AS n, row_number() OVER (PARTITION BY book, rtrim(lower(concept), 's') ORDER BY ord) AS k FROM c") + "SELECT book, concept, description, ord FROM n WHERE n < 100 OR k = 1")
def _(spark, d):
    c = fixture(spark, d, X.concepts).select(F.floor(F.col("book") / 3).alias("book"), F.col("description").alias("concept"), F.lit("").alias("description"), "ord")
    return N.drop_duplicates(c)


@query("concept_metadata", with_(c=X.concepts) + ", " + _PACKED + " SELECT p.book, p.number, p.concept, CASE WHEN c.position % 4 = 0 THEN '' ELSE c.description END AS description, CASE WHEN c.position % 4 = 0 THEN 'medium' ELSE c.weight END AS weight FROM packed p JOIN c ON c.book = p.book AND c.concept = p.concept")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    return P.concept_metadata(P.pack(c), c.filter("position % 4 <> 0")).select("book", "number", "concept", "description", "weight")


@query("concept_sequence", with_(c=X.concepts) + ", " + _PACKED + " SELECT book, number, concept, lead(concept) OVER w AS next_in_session, lag(concept) OVER w AS previous_in_session FROM packed WINDOW w AS (PARTITION BY book, number ORDER BY position)")
def _(spark, d):
    return P.concept_sequence(P.pack(fixture(spark, d, X.concepts)))


@query("revisit_top3", with_(c=X.concepts, e=X.edges) + ", " + _PACKED + ", " + _CAND + ", " + _SCORE + " SELECT book, number, concept, score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book, number ORDER BY score DESC, concept DESC) AS k FROM score) WHERE k <= 3")
def _(spark, d):
    return P.top_revisits(scores(spark, d), 3)


@query("topological_order", with_(c=X.concepts, e=X.edges) + ", " + _TIERS + " SELECT c.book, c.concept, (row_number() OVER (PARTITION BY c.book ORDER BY tier, ord))::INT AS position FROM c JOIN tiers t ON t.book = c.book AND t.concept = c.concept")
def _(spark, d):
    return G.topological_order(fixture(spark, d, X.concepts), fixture(spark, d, X.edges))


@query("session_list", with_(s=X.sessions) + "SELECT book, number, title, len(concepts)::INT AS concept_count FROM s")
def _(spark, d):
    return fixture(spark, d, X.sessions).select("book", "number", "title", F.size("concepts").alias("concept_count"))


@query("overall_score", "SELECT doc_id, round((doc_id % 10 + doc_id % 7 + 8.0::DOUBLE + 7.25::DOUBLE + least(10.0::DOUBLE, 7.25::DOUBLE * 1.1::DOUBLE) + doc_id % 9) / 6, 1) AS overall FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).select("doc_id", C.overall([i % 10, i % 7, F.lit(8.0)], F.lit(7.25), F.least(F.lit(10.0), F.lit(7.25) * 1.1), i % 9).alias("overall"))
