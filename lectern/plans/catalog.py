"""The registered queries of the curriculum operators with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from lectern.functions import jsonx as J
from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators import checks as C
from lectern.operators import graph as G
from lectern.operators import inventory as V
from lectern.operators import model as M
from lectern.operators import planner as P
from lectern.operators import progress as R
from lectern.plans import fixtures as X
from lectern.plans.fixtures import fixture, load
from lectern.sources import store as S

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
WORDS = r"len(regexp_extract_all({}, '\S+'))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def with_(**parts) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v(X.DUCK) if callable(v) else v})" for k, v in parts.items()) + " "


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


# --- structural audit -----------------------------------------------------------------------------------------------
_W = WORDS.format("content")
_CHECKS = rf"""checks0 AS (SELECT book, number, content,
  CASE WHEN rtrim(content) = '' THEN content ELSE regexp_replace(content, '\s+$', '') END AS bare FROM s),
 checks AS (SELECT book, number,
  len(list_filter(string_split(regexp_replace(right(bare, 300), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: contains(x, '?') AND len(regexp_extract_all(x, '\S+')) >= 5)) > 0 AS tension,
  number = 1 OR coalesce(len(regexp_extract_all(list_filter(string_split(content, chr(10) || chr(10)), lambda p: trim(p) <> '')[1], '\S+')) <= 250, false) AS anchor,
  number <= 3 OR ({" OR ".join(f"contains(lower(content), '{m}')" for m in C.REVISIT_OFFLINE)}) AS revisit,
  {_W} BETWEEN 1500 AND 2600 AS length FROM checks0),
 flat AS (SELECT book, number, k AS "check", CASE k WHEN 'tension' THEN tension WHEN 'anchor' THEN anchor WHEN 'revisit' THEN revisit ELSE length END AS passed
  FROM checks, (VALUES ('tension'), ('anchor'), ('revisit'), ('length')) v(k))"""


@query("structural_checks", with_(s=X.sessions) + ", " + _CHECKS + ' SELECT book, number, "check", passed FROM flat')
def _(spark, d):
    return C.structural_checks(fixture(spark, d, X.sessions))


_AUDIT = """a AS (SELECT book, "check", count(*) FILTER (passed) AS n_pass, count(*) AS n_total, coalesce(list(number ORDER BY number) FILTER (NOT passed), []) AS failed FROM flat GROUP BY ALL)"""


@query("structural_audit", with_(s=X.sessions) + ", " + _CHECKS + ", " + _AUDIT + """ SELECT book, "check", n_pass, n_total, array_to_string(failed, ',') AS failed FROM a""")
def structural_audit(spark, d):
    out = C.structural_audit(C.structural_checks(fixture(spark, d, X.sessions)))
    return out.withColumn("failed", F.array_join(F.col("failed").cast("array<string>"), ","))


@query("structure_score", with_(s=X.sessions) + ", " + _CHECKS + ", " + _AUDIT + """, t AS (SELECT book, round(sum(n_pass / n_total * 10 * CASE "check" WHEN 'tension' THEN 0.30::DOUBLE WHEN 'length' THEN 0.20::DOUBLE ELSE 0.25::DOUBLE END), 2) AS structure_score,
 round(max(CASE WHEN "check" = 'length' THEN n_pass / n_total * 10 END), 2) AS length_score FROM a GROUP BY book) SELECT *, round(least(10.0::DOUBLE, structure_score * 1.1::DOUBLE), 4) AS coherence_score FROM t""")
def _(spark, d):
    return C.audit_scores(C.structural_audit(C.structural_checks(fixture(spark, d, X.sessions))))


@query("needs_review", with_(s=X.sessions) + ", " + _CHECKS + " SELECT book, number, count(*) FILTER (passed) AS n_passed, bool_or(NOT passed) AS needs_review FROM flat GROUP BY ALL")
def _(spark, d):
    return C.needs_review(C.structural_checks(fixture(spark, d, X.sessions)))


@query("check_length", with_(s=X.sessions, w=rf"SELECT book, number, {_W} AS n, right(regexp_replace(content, '\s+$', ''), 1) AS z FROM s") + "SELECT book, number, n BETWEEN 1500 AND 2600 AND z IN ('.', '?', '!') AS passed, n AS word_count, CASE WHEN n < 1500 THEN 'short' WHEN n > 2600 THEN 'long' WHEN z NOT IN ('.', '?', '!') THEN 'cut' WHEN n < 1800 THEN 'below target' ELSE '' END AS reason, n BETWEEN 1800 AND 2600 AS fallback FROM w")
def _(spark, d):
    return fixture(spark, d, X.sessions).select("book", "number", C.length_verdict(F.col("content")).alias("v"), C.length_fallback(F.col("content")).alias("fallback")).select("book", "number", "v.*", "fallback")


_TAIL = r"""t AS (SELECT book, number, CASE WHEN len(w) >= 300 THEN array_to_string(w[-300:], ' ') ELSE content END AS tail FROM (SELECT *, regexp_extract_all(content, '\S+') AS w FROM s)),
 p AS (SELECT *, CASE WHEN contains(tail, '?') THEN length(tail) - instr(reverse(tail), '?') ELSE -1 END AS q FROM t),
 b AS (SELECT *, substring(tail, 1, q) AS before FROM p),
 m AS (SELECT *, greatest(CASE WHEN contains(before, '. ') THEN length(before) - instr(reverse(before), ' .') - 1 ELSE -1 END, CASE WHEN contains(before, '! ') THEN length(before) - instr(reverse(before), ' !') - 1 ELSE -1 END, CASE WHEN contains(before, '? ') THEN length(before) - instr(reverse(before), ' ?') - 1 ELSE -1 END) AS e FROM b),
 g AS (SELECT *, CASE WHEN q >= 0 THEN trim(substring(tail, CASE WHEN e >= 0 THEN e + 3 ELSE 1 END, q + 1 - CASE WHEN e >= 0 THEN e + 2 ELSE 0 END), ' ' || chr(10)) END AS question FROM m)"""


@query("tension_gate", with_(s=X.sessions) + ", " + _TAIL + r" SELECT book, number, question, CASE WHEN q < 0 THEN 'no question' WHEN len(regexp_extract_all(question, '\S+')) < 5 THEN 'short question' WHEN len(regexp_extract_all(substring(tail, q + 2), '\S+')) > 20 THEN 'late question' ELSE '' END AS gate FROM g")
def _(spark, d):
    return C.tension_gates(fixture(spark, d, X.sessions)).select("book", "number", "question", "gate")


@query("revisit_markers", with_(s=X.sessions) + "SELECT book, number, " + " OR ".join(f"contains(lower(content), '{m}')" for m in C.REVISIT_ONLINE) + " AS online, " + " OR ".join(f"contains(lower(content), '{m}')" for m in C.REVISIT_OFFLINE) + " AS offline FROM s")
def _(spark, d):
    x = F.col("content")
    return fixture(spark, d, X.sessions).select("book", "number", C.has_marker(x, C.REVISIT_ONLINE).alias("online"), C.has_marker(x, C.REVISIT_OFFLINE).alias("offline"))


@query("revisit_paragraph", with_(s=X.sessions, f="SELECT book, number, coalesce(concepts[1], '') AS c, list_filter(string_split(content, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(10)) <> '') AS ps, list_filter([" + ", ".join(f"'{m}'" for m in C.REVISIT_ONLINE) + "], lambda m: contains(lower(content), m)) AS ms FROM s",
    n="SELECT *, list_transform(ps, lambda p: len(list_filter(ms, lambda m: contains(lower(p), m)))) AS ns FROM f") + "SELECT book, number, CASE WHEN len(ms) = 0 THEN NULL ELSE coalesce(list_filter(ps, lambda p, i: ns[i] > 0 AND contains(lower(p), substring(lower(c), 1, 10)))[1], ps[list_position(ns, list_max(ns))], '') END AS paragraph FROM n")
def _(spark, d):
    return fixture(spark, d, X.sessions).select("book", "number", C.revisit_paragraph(F.col("content"), F.coalesce(F.try_element_at("concepts", F.lit(1)), F.lit(""))).alias("paragraph"))


@query("anchor_copy", with_(s=X.sessions, p="SELECT a.book, a.number, right(b.content, 300) AS t, substring(a.content, 1, 300) AS h FROM s a JOIN s b ON a.book = b.book AND b.number = a.number - 1",
    w=r"SELECT *, regexp_extract_all(lower(t), '\S+') AS tw, regexp_extract_all(lower(h), '\S+') AS hw FROM p") + "SELECT book, number, coalesce(len(list_intersect(list_distinct(tw[-30:]), list_distinct(hw[1:30]))) / nullif(least(30, len(tw[-30:]), len(hw[1:30])), 0) > 0.65 AND len(tw) > 10 AND len(hw) > 10, false) AS copied FROM w")
def _(spark, d):
    s = fixture(spark, d, X.sessions)
    before = s.select("book", (F.col("number") + 1).alias("number"), F.col("content").alias("ending"))
    return s.join(before, ["book", "number"]).select("book", "number", C.copied_opening(F.col("ending"), F.col("content")).alias("copied"))


@query("transition_pairs", with_(s=X.sessions, f="SELECT *, list_filter(string_split(content, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(10)) <> '') AS ps FROM s", x="SELECT *, unnest(generate_series(0, len(concepts) - 2)) AS pair FROM f WHERE len(ps) >= 3 AND len(concepts) >= 2",
    y="SELECT *, greatest(1, least(floor(len(ps) * (pair + 1) / len(concepts))::INT, len(ps) - 2)) AS k FROM x", z=r"SELECT *, ps[k] AS a, ps[k + 1] AS b, regexp_extract_all(ps[k], '\S+') AS aw, regexp_extract_all(ps[k + 1], '\S+') AS bw FROM y")
    + "SELECT book, number, pair::INT AS pair, concepts[pair + 1] AS from_concept, concepts[pair + 2] AS to_concept, CASE WHEN len(aw) < 80 THEN a ELSE array_to_string(aw[-80:], ' ') END AS tail, CASE WHEN len(bw) > 80 THEN array_to_string(bw[1:80], ' ') ELSE b END AS head FROM z")
def _(spark, d):
    return C.transition_pairs(fixture(spark, d, X.sessions))


@query("stratified_sample", with_(s=X.sessions, a="SELECT book, number, row_number() OVER (PARTITION BY book ORDER BY number) - 1 AS i, count(*) OVER (PARTITION BY book) AS n, md5(number || ':42') AS mix FROM s",
    b="SELECT *, CASE WHEN i < n // 3 THEN 1 WHEN i < 2 * n // 3 THEN 2 ELSE 3 END AS third FROM a", c="SELECT *, row_number() OVER (PARTITION BY book, third ORDER BY mix, number) <= 6 AS first FROM b",
    e="SELECT *, row_number() OVER (PARTITION BY book ORDER BY first DESC, mix, number) AS pick FROM c") + "SELECT book, number, third::INT AS third, CASE WHEN first THEN 'third' ELSE 'top-up' END AS taken_by FROM e WHERE pick <= 20")
def _(spark, d):
    return C.stratified_sample(fixture(spark, d, X.sessions).select("book", "number"))


@query("quality_averages", with_(r="SELECT 'TECHNICAL_ACCURACY: ' || (doc_id % 10) || chr(10) || 'CONCEPT_DEPTH: ' || (doc_id % 7) || '.5' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'PROSE_QUALITY: 8' ELSE 'VERDICT: thin' END AS a FROM documents")
    + "SELECT " + ", ".join(rf"coalesce(round(avg(nullif(regexp_extract(a, '{n}:\s*(\d+(?:\.\d+)?)', 1), '')::DOUBLE), 2), 0.0::DOUBLE) AS {n.lower()}" for n in ("TECHNICAL_ACCURACY", "CONCEPT_DEPTH", "PROSE_QUALITY")) + r", count(nullif(regexp_extract(a, 'VERDICT:\s*([^\n]+)', 1), '')) AS remarks FROM r")
def _(spark, d):
    i = F.col("doc_id")
    a = F.concat(F.lit("TECHNICAL_ACCURACY: "), i % 10, F.lit("\nCONCEPT_DEPTH: "), i % 7, F.lit(".5\n"), F.when(i % 2 == 0, "PROSE_QUALITY: 8").otherwise("VERDICT: thin"))
    rows = docs(spark, d).select(a.alias("answer"))
    return C.dimension_averages(rows, ["TECHNICAL_ACCURACY", "CONCEPT_DEPTH", "PROSE_QUALITY"]).join(rows.agg(F.count(J.remark(F.col("answer"))).alias("remarks")), F.lit(True))


# --- text -----------------------------------------------------------------------------------------------------------
@query("word_count", rf"SELECT doc_id, {WORDS.format('text')} AS n_words, greatest(1, length(text) // 4) AS tokens, array_to_string(regexp_extract_all(text, '\S+')[1:12], ' ') AS head, CASE WHEN {WORDS.format('text')} < 80 THEN text ELSE array_to_string(regexp_extract_all(text, '\S+')[-80:], ' ') END AS excerpt FROM documents")
def _(spark, d):
    x = F.col("text")
    return docs(spark, d).select("doc_id", T.word_count(x).alias("n_words"), T.token_estimate(x).alias("tokens"), T.first_words(x, 12).alias("head"), T.last_words(x, 80).alias("excerpt"))


@query("clean_text", with_(b=X.blocks, c=r"SELECT doc_id, ord, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM b") + r"SELECT doc_id, ord, trim(CASE WHEN regexp_matches(t, '[∑∫∂√∞πθαβγδ]|\$_\w+\$_|\\\w+') THEN t || ' [MATH]' ELSE t END) AS content FROM c")
def _(spark, d):
    return fixture(spark, d, X.blocks).select("doc_id", "ord", T.clean_text(F.col("text")).alias("content"))


@query("fold_compatible", "SELECT doc_id, 'file flow 1 ' || n_chars || ' km2 ' || CASE WHEN doc_id % 2 = 0 THEN 'ABC' ELSE 'VIII' END AS content FROM documents")
def _(spark, d):
    odd = F.concat(F.lit("ﬁle  ﬂow\n① "), F.col("n_chars"), F.lit(" km² "), F.when(F.col("doc_id") % 2 == 0, "ＡＢＣ").otherwise("Ⅷ"))
    return docs(spark, d).select("doc_id", T.clean_text(odd).alias("content"))


@query("tidy_document", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '[\p{L}\p{N}_]+:\s*\n', '', 'g'), '(\S):\s*([\p{L}\p{N}_]+:)', '\1' || chr(10) || chr(10) || '\2', 'g'), ' ' || chr(10)) AS text FROM (SELECT doc_id, 'BODY:' || chr(10) || replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10)) || ' note: BODY: end ' AS t FROM documents)")
def _(spark, d):
    t = F.concat(F.lit("BODY:\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n\n")), F.lit(" note: BODY: end "))
    return docs(spark, d).select("doc_id", T.tidy_document(t).alias("text"))


@query("table_to_prose", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'For Alpha' || doc_id || ', latency is ' || n_chars || '. For Alpha' || doc_id || ', lang is ' || lang || '.' ELSE 'For ' || n_chars || ', name is x' || doc_id || '. For ' || n_chars || ', lang is ' || lang || '.' END AS prose FROM documents")
def _(spark, d):
    i, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    a = F.concat(F.lit("Model  Latency\tLang\nAlpha"), i, F.lit("  "), n, F.lit("\t"), F.col("lang"), F.lit("\nshort  row\n"))
    b = F.concat(F.lit("Name\tLatency\tLang\nx"), i, F.lit("\t"), n, F.lit("\t"), F.col("lang"))
    return docs(spark, d).select("doc_id", T.table_to_prose(F.when(F.col("doc_id") % 2 == 0, a).otherwise(b)).alias("prose"))


@query("slug", r"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace(s, '(.)([A-Z])', '\1-\2', 'g')), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-'), ''), 'book') AS slug FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '!!' ELSE p_brand || ' ' || p_name || 'Deep' END AS s FROM part)")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", T.slug(F.when(F.col("p_partkey") % 50 == 0, "!!").otherwise(F.concat("p_brand", F.lit(" "), "p_name", F.lit("Deep")))).alias("slug"))


@query("title_tokens", with_(s=X.sessions, t="SELECT book, number, title, list_filter(list_transform(regexp_extract_all(lower(title), '\\S+'), lambda w: trim(w, '\"''.,;:!?')), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")) AS ws FROM s")
    + "SELECT book, number, array_to_string(list_sort(list_distinct(ws)), ' ') AS tokens, coalesce(trim(regexp_extract_all(lower(title || CASE WHEN number % 4 = 0 THEN ' basics.' ELSE '' END), '\\S+')[-1], '\"''.,;:!?') IN (" + ", ".join(f"'{w}'" for w in T.BANNED_LAST_WORDS) + "), false) AS banned FROM t")
def _(spark, d):
    s = fixture(spark, d, X.sessions)
    title = F.concat("title", F.when(F.col("number") % 4 == 0, " basics.").otherwise(""))
    return s.select("book", "number", F.array_join(F.array_sort(T.title_tokens(F.col("title"))), " ").alias("tokens"), T.banned_last_word(title).alias("banned"))


@query("question_to_resolve", with_(s=X.sessions, q=r"SELECT *, list_filter(string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: contains(x, '?')) AS qs, regexp_extract_all(content, '\S+') AS w FROM s") + r"SELECT book, number, CASE WHEN len(qs) > 0 THEN trim(qs[-1], ' ' || chr(10)) WHEN len(w) < 80 THEN content ELSE array_to_string(w[-80:], ' ') END AS question FROM q")
def _(spark, d):
    return fixture(spark, d, X.sessions).select("book", "number", T.question_to_resolve(F.col("content")).alias("question"))


@query("stitch_session", r"SELECT doc_id, 'Because.' || chr(10) || chr(10) || regexp_replace(regexp_replace(replace(text, ' the ', ' [REVISIT]  the [/REVISIT] '), '\[REVISIT\]\s*', '', 'g'), '\s*\[/REVISIT\]', '', 'g') || chr(10) || chr(10) || 'Why?' AS content FROM documents")
def _(spark, d):
    body = F.replace(F.col("text"), F.lit(" the "), F.lit(" [REVISIT]  the [/REVISIT] "))
    return docs(spark, d).select("doc_id", T.stitch(F.lit("Because."), body, F.lit("Why?")).alias("content"))


@query("opening_and_closing", with_(s=X.sessions, p="SELECT *, list_filter(string_split(content, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(10)) <> '') AS ps FROM s") + "SELECT book, number, trim(CASE WHEN len(ps) >= 2 THEN array_to_string(ps[1:len(ps)-1], chr(10) || chr(10)) ELSE substring(content, 1, length(content) // 2) END, ' ' || chr(10)) AS opening, trim(CASE WHEN len(ps) >= 2 THEN ps[-1] ELSE substring(content, length(content) // 2 + 1) END, ' ' || chr(10)) AS closing FROM p")
def _(spark, d):
    return fixture(spark, d, X.sessions).select("book", "number", T.opening_and_closing(F.col("content")).alias("p")).select("book", "number", "p.*")


@query("summary_card", r"SELECT doc_id, text AS bare, right(text, 1) NOT IN ('.', '?', '!') AS open_end, regexp_extract(text, '(?s)^(.*\S[.!?])(\s|$)', 1) AS complete FROM documents")
def _(spark, d):
    x = F.col("text")
    carded = F.concat(x, F.lit("\n\n— one thing\n– another\n"))
    return docs(spark, d).select("doc_id", T.without_card(carded).alias("bare"), T.ends_openly(x).alias("open_end"), T.complete_part(x).alias("complete"))


@query("plan_header", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'REVISIT TARGET: cache' || chr(10) || 'x' || text ELSE text END AS body FROM documents")
def _(spark, d):
    i = F.col("doc_id") % 3
    head = F.when(i == 0, "REVISIT TARGET: cache\n\n").when(i == 1, "REVISIT TARGET: cache\nKEY NOTE: again\nLAST NOTE: once\n\n").otherwise("REVISIT TARGET: cache\nx")
    return docs(spark, d).select("doc_id", T.without_plan_header(F.concat(head, "text")).alias("body"))


_FIND = "CASE WHEN contains({0}, '{1}') THEN length({0}) - instr(reverse({0}), '{2}') - 1 ELSE -1 END"
_CUT = lambda text, mark, least: f"CASE WHEN {_FIND.format(text, mark, mark[::-1])} {least} THEN substring({text}, 1, {_FIND.format(text, mark, mark[::-1])} + 1) END"


@query("last_complete_sentence", with_(s=X.sessions, w=r"SELECT *, regexp_extract_all(content, '\S+') AS w FROM s",
    v="SELECT *, CASE WHEN len(w) < 400 THEN content ELSE array_to_string(w[-400:], ' ') END AS win, array_to_string(w[1:120], ' ') AS head FROM w",
    c="SELECT *, coalesce(" + ", ".join(_CUT("win", m, ">= 0") for m in ("? ", ". ", "! ")) + ", win) AS cut FROM v", z=r"SELECT *, regexp_extract_all(cut, '\S+') AS cw FROM c")
    + "SELECT book, number, CASE WHEN len(cw) < 60 THEN cut ELSE array_to_string(cw[-60:], ' ') END AS ending, CASE WHEN len(w) <= 120 THEN content ELSE coalesce("
    + ", ".join(_CUT("head", m, "> length(head) * 0.85::DOUBLE") for m in (". ", "? ", "! ")) + ", head) END AS trimmed FROM z")
def _(spark, d):
    x = F.col("content")
    return fixture(spark, d, X.sessions).select("book", "number", T.last_complete(x, 60).alias("ending"), T.trim_words(x, 120).alias("trimmed"))


@query("prose_words", r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), f AS (SELECT doc_id, p, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS paragraph FROM p WHERE trim(p) <> ''), w AS (SELECT doc_id, paragraph, unnest(regexp_extract_all(p, '\S+')) AS word, generate_subscripts(regexp_extract_all(p, '\S+'), 1) AS j FROM f) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, j) - 1)::INT AS word_index, paragraph::INT AS paragraph, word FROM w")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.prose_words(F.col("text"))).alias("word_index", "w")).select("doc_id", "word_index", "w.paragraph", "w.word")


@query("code_fences", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE '' END AS lang, 'x = ' || doc_id || chr(10) || 'y' AS code, CASE WHEN doc_id % 3 = 0 THEN 'This sets the value of x.' ELSE '' END AS note FROM documents")
def _(spark, d):
    t = F.concat("text", F.lit("\n```"), F.when(F.col("doc_id") % 2 == 0, "python").otherwise(""), F.lit("\nx = "), F.col("doc_id"), F.lit("\ny\n```\n"), F.when(F.col("doc_id") % 3 == 0, "This sets the value of x.").otherwise("after"))
    return docs(spark, d).select("doc_id", F.explode(T.code_fences(t)).alias("f")).select("doc_id", "f.*")


@query("escape_html", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.escape_html(F.col("html")).alias("html"))


@query("durations", "SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS lasted, substring(sha256(substring('key-' || user_id || '-secret', 1, 8)), 1, 16) AS key_id FROM (SELECT event_id, user_id, ((event_id * 37) % 20000)::DOUBLE + 0.27 AS s FROM events)")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", T.duration((F.col("event_id") * 37 % 20000).cast("double") + 0.27).alias("lasted"), T.key_id(F.concat(F.lit("key-"), "user_id", F.lit("-secret"))).alias("key_id"))


# --- JSON -----------------------------------------------------------------------------------------------------------
@query("tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k, event_id % 4 <> 3 AS parsed FROM events")
def _(spark, d):
    i, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("Here it is: "), p, F.lit(" as asked"))).otherwise("nothing {here")
    v = J.tolerant(raw)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNotNull().alias("parsed"))


@query("binary_verdict", "SELECT event_id, event_id % 5 IN (0, 2) AS passed, CASE event_id % 5 WHEN 0 THEN 'it ' || event_type WHEN 1 THEN 'it does not' WHEN 2 THEN 'I say yes to ' || event_type WHEN 3 THEN 'well, no' ELSE 'Unclear response: ' || substring(event_type || ' maybe', 1, 100) END AS evidence FROM events")
def _(spark, d):
    i, t = F.col("event_id") % 5, F.col("event_type")
    raw = F.when(i == 0, F.concat(F.lit(" YES, it "), t)).when(i == 1, "no: it does not").when(i == 2, F.concat(F.lit("I say yes to "), t)).when(i == 3, "well, no").otherwise(F.concat(t, F.lit(" maybe")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", J.verdict(raw).alias("v")).select("event_id", "v.*")


@query("salvage_json", """SELECT event_id, '{"concepts": [{"name": "' || event_type || '", "n": ' || event_id || '}, {"name": "cut"}]}' AS json FROM events""")
def _(spark, d):
    raw = F.concat(F.lit('{"concepts": [{"name": "'), "event_type", F.lit('", "n": '), F.col("event_id"), F.lit('}, {"name": "cut'))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", J.salvage(raw).alias("json"))


# --- blocks ---------------------------------------------------------------------------------------------------------
_TEXT = "trim(text, ' ' || chr(10) || chr(9))"
_TAG = rf"""CASE WHEN x = '' THEN 'BODY' WHEN regexp_matches(x, '^\d{{1,4}}$') OR regexp_matches(lower(x), '^(page|p\.?)\s*\d+$') OR x = page::VARCHAR THEN 'PAGE-NUMBER' WHEN running THEN 'RUNNING-HEADER'
 WHEN regexp_matches(lower(x), '^(figure|fig\.?|exhibit|diagram|chart)\s+\d+') THEN 'FIGURE-CAPTION' WHEN regexp_matches(x, '^\s*[\d*†‡§]') OR (length(x) < 100 AND regexp_matches(x, '^\s*\d+\s+')) THEN 'FOOTNOTE'
 WHEN regexp_matches(lower(font), 'courier|mono|code|consolas|monaco') OR regexp_matches(x, '^\s*(def |function |class |import |public |private |protected )') OR regexp_matches(x, '^\s*(if |for |while |switch |case |return )') OR regexp_matches(x, '^\s*(//|#|/\*|\*)') OR regexp_matches(x, '[{{}}();,]\s*$') OR regexp_matches(x, '^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*') THEN 'CODE'
 WHEN regexp_matches(lower(x), '^(algorithm\s+\d+|procedure\s+\w+|function\s+\w+\s*\(|input:|output:|\d+:\s+)') THEN 'ALGORITHM'
 WHEN len(string_split(x, chr(10))) >= 2 AND len(list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '\t|  ') AND len(string_split_regex(trim(s, ' ' || chr(9)), '\t|  +')) >= 3)) > 0 THEN 'TABLE'
 WHEN size > 16 AND (flags & 16) <> 0 THEN 'HEADER' WHEN size > 13 AND (flags & 16) <> 0 THEN 'SUBHEADER' ELSE 'BODY' END"""
_TAGGED = rf"tagged AS (SELECT doc_id, page, ord, {_TEXT} AS x, {_TAG} AS tag FROM (SELECT *, {_TEXT} AS x, false AS running FROM b))"
_KEEP = "CASE WHEN tag IN ('CODE', 'ALGORITHM') THEN true WHEN tag = 'TABLE' THEN length(x) > 10 WHEN tag IN ('HEADER', 'SUBHEADER', 'BODY') THEN length(x) > 0 ELSE false END"


def tagged(spark, d):
    b = fixture(spark, d, X.blocks)
    return B.tagged(b.withColumn("running", F.lit(False)))


@query("classify_blocks", with_(b=X.blocks) + ", " + _TAGGED + f" SELECT doc_id, page, ord, tag, {_KEEP} AS kept FROM tagged")
def _(spark, d):
    return tagged(spark, d).select("doc_id", "page", "ord", "tag", B.keeps_bare(F.col("tag"), F.col("bare")).alias("kept"))


@query("assemble_document", with_(b=X.blocks) + ", " + _TAGGED + f" SELECT doc_id, string_agg(tag || ': ' || x, chr(10) ORDER BY page, ord) AS text FROM tagged WHERE {_KEEP} GROUP BY doc_id")
def _(spark, d):
    rows = tagged(spark, d).filter(B.keeps_bare(F.col("tag"), F.col("bare"))).withColumn("content", F.col("bare"))
    return B.assemble(rows)


_HEADERS = "h AS (SELECT doc_id, x::INT AS x, y::INT AS y, min_by(trim(text), page * 100000 + ord) AS text FROM sp WHERE page <= 10 AND length(trim(text)) BETWEEN 1 AND 49 GROUP BY doc_id, x::INT, y::INT HAVING count(*) >= 3)"


@query("running_headers", with_(sp=X.spans) + ", " + _HEADERS + " SELECT * FROM h")
def _(spark, d):
    return B.running_headers(fixture(spark, d, X.spans))


@query("header_match", with_(sp=X.spans) + ", " + _HEADERS + r" SELECT doc_id, page, ord, EXISTS (SELECT 1 FROM h WHERE h.doc_id = sp.doc_id AND abs(sp.x - h.x) < 20 AND abs(sp.y - h.y) < 20 AND regexp_replace(trim(lower(h.text)), '\s+', ' ', 'g') = regexp_replace(trim(lower(sp.text)), '\s+', ' ', 'g')) AS running FROM sp")
def _(spark, d):
    sp = fixture(spark, d, X.spans)
    return B.mark_running(sp.withColumnsRenamed({"x": "x0", "y": "y0"}), B.running_headers(sp)).select("doc_id", "page", "ord", "running")


@query("multi_column", with_(b=X.blocks) + "SELECT doc_id, page, count(*) >= 3 AND max(x0) - min(x0) > 0.4 * max(page_width) AS multi FROM b GROUP BY doc_id, page")
def _(spark, d):
    return B.multi_column(fixture(spark, d, X.blocks))


@query("column_order", with_(b=X.blocks, r="SELECT *, CASE WHEN (x0 + x1) / 2 < page_width / 2 THEN 0 ELSE 1 END AS side FROM b", k="SELECT *, row_number() OVER (PARTITION BY doc_id, page, side ORDER BY y0, ord) AS k FROM r") + "SELECT doc_id, page, ord, (row_number() OVER (PARTITION BY doc_id, page ORDER BY k, side))::INT AS position FROM k")
def _(spark, d):
    return B.column_order(fixture(spark, d, X.blocks)).select("doc_id", "page", "ord", "position")


_OWN = r"regexp_replace(trim(lower({0}), ' ' || chr(10) || chr(9)), '\s+', ' ', 'g')"
_RUNNING = (
    "h AS (SELECT doc_id, x0::INT AS x, y0::INT AS y, min_by(trim(text, ' ' || chr(10) || chr(9)), page * 100000 + ord) AS text FROM b WHERE page <= 10 AND length(trim(text, ' ' || chr(10) || chr(9))) BETWEEN 1 AND 49 GROUP BY doc_id, x0::INT, y0::INT HAVING count(*) >= 3),"
    f" r AS (SELECT *, EXISTS (SELECT 1 FROM h WHERE h.doc_id = b.doc_id AND abs(b.x0 - h.x) < 20 AND abs(b.y0 - h.y) < 20 AND {_OWN.format('h.text')} = {_OWN.format('b.text')}) AS running FROM b)"
)
_RUN_TAGGED = f"tagged AS (SELECT doc_id, page, ord, x, {_TAG} AS tag FROM (SELECT *, {_TEXT} AS x FROM r))"
_CLEAN = r"regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g')"
_CONTENT = rf"""CASE WHEN tag IN ('CODE', 'ALGORITHM') THEN x WHEN tag = 'TABLE' THEN CASE WHEN len(cells) = 3 AND trim(cells[3]) <> '' THEN 'For A1, time is two. For A1, size is ' || cells[3] || '.' ELSE x END
 ELSE trim(CASE WHEN regexp_matches(c, '[∑∫∂√∞πθαβγδ]|\$_[\p{{L}}\p{{N}}_]+\$_|\\[\p{{L}}\p{{N}}_]+') THEN c || ' [MATH]' ELSE c END) END"""
_TIDY = r"""trim(regexp_replace(regexp_replace(regexp_replace(t, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '[\p{L}\p{N}_]+:\s*\n', '', 'g'), '(\S):\s*([\p{L}\p{N}_]+:)', '\1' || chr(10) || chr(10) || '\2', 'g'), ' ' || chr(10))"""


def furnished(spark, d):
    return fixture(spark, d, X.furnished).withColumns({"x": F.col("x0"), "y": F.col("y0")})


@query("classify_running", with_(b=X.furnished) + ", " + _RUNNING + ", " + _RUN_TAGGED + f" SELECT doc_id, page, ord, tag, {_KEEP} AS kept FROM tagged")
def _(spark, d):
    b = furnished(spark, d)
    own = B.tagged(B.mark_running(b, B.running_headers(b)))
    return own.select("doc_id", "page", "ord", "tag", B.keeps_bare(F.col("tag"), F.col("bare")).alias("kept"))


_PLACED = (
    "wide AS (SELECT doc_id, page, count(*) >= 3 AND max(x0) - min(x0) > 0.4 * max(page_width) AS multi FROM b GROUP BY doc_id, page),"
    " sided AS (SELECT doc_id, page, ord, y0, multi, CASE WHEN (x0 + x1) / 2 < page_width / 2 THEN 0 ELSE 1 END AS side FROM b JOIN wide USING (doc_id, page)),"
    " placed AS (SELECT doc_id, page, ord, CASE WHEN multi THEN row_number() OVER (PARTITION BY doc_id, page, side ORDER BY y0, ord) ELSE ord END AS first, CASE WHEN multi THEN side ELSE 0 END AS second FROM sided)"
)


@query("ingest_document", with_(b=X.furnished) + ", " + _RUNNING + ", " + _RUN_TAGGED + ", " + _PLACED + f", cut AS (SELECT *, {_CLEAN} AS c, string_split_regex(trim(string_split(x, chr(10))[2], ' ' || chr(9)), '\t|  +') AS cells FROM tagged WHERE {_KEEP}),"
    f" whole AS (SELECT doc_id, string_agg(tag || ': ' || {_CONTENT}, chr(10) ORDER BY page, first, second) AS t FROM cut JOIN placed USING (doc_id, page, ord) GROUP BY doc_id) SELECT doc_id, {_TIDY} AS text FROM whole")
def _(spark, d):
    return B.ingest(furnished(spark, d))


# --- inventory ------------------------------------------------------------------------------------------------------
@query("chunk_fixed", "SELECT doc_id, unnest(generate_series(1, (length(text) + 1999) // 2000))::INT AS chunk_no, substring(text, (unnest(generate_series(1, (length(text) + 1999) // 2000)) - 1) * 2000 + 1, 2000) AS chunk FROM documents")
def _(spark, d):
    return V.fixed_chunks(docs(spark, d), 2000)


_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_EMPTY = "chr(10) || chr(10)"


@query("chunk_paragraph", with_(s=X.sessions, r=f"SELECT doc_id, 0 AS chunk_no, content AS rest, NULL::VARCHAR AS chunk FROM s UNION ALL SELECT doc_id, chunk_no + 1, CASE WHEN length(rest) > 2000 THEN {_BARE.format('substring(rest, pos + 1)')} ELSE '' END,"
    f" CASE WHEN length(rest) > 2000 THEN {_BARE.format('substring(rest, 1, pos)')} ELSE rest END FROM (SELECT *, CASE WHEN contains(substring(rest, 1, 2000), {_EMPTY}) THEN length(substring(rest, 1, 2000)) - instr(reverse(substring(rest, 1, 2000)), {_EMPTY}) - 1 ELSE 2000 END AS pos FROM r WHERE rest <> '') q")
    + "SELECT doc_id, chunk_no, chunk FROM r WHERE chunk_no > 0")
def _(spark, d):
    return V.paragraph_chunks(fixture(spark, d, X.sessions).select("doc_id", F.col("content").alias("text")), 2000)


@query("inventory_union", with_(c=X.concepts) + "SELECT book, concept, 'concept' AS kind FROM c UNION ALL SELECT book, cluster, 'anchor' FROM c WHERE weight = 'heavy' UNION ALL SELECT book, description, 'assumption' FROM c WHERE weight = 'light'")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    kind = lambda df, col, k: df.select("book", F.col(col).alias("concept"), F.lit(k).alias("kind"))
    return V.union_inventories([kind(c, "concept", "concept"), kind(c.filter("weight = 'heavy'"), "cluster", "anchor"), kind(c.filter("weight = 'light'"), "description", "assumption")])


def small_books(spark, d):
    """Concepts in books of all sizes: those of every third book are dealt out to two."""
    c = fixture(spark, d, X.concepts)
    return c.withColumn("book", F.when(F.col("book") % 3 == 0, -F.col("book") * 2 - F.col("position") % 2).otherwise(F.col("book")).cast("int"))


@query("volume_check", with_(k=X.concepts, c="SELECT CASE WHEN book % 3 = 0 THEN -book * 2 - position % 2 ELSE book END::INT AS book FROM k") + "SELECT book, count(*) AS n_concepts, CASE WHEN count(*) < 40 THEN 'split' WHEN count(*) > 250 THEN 'merge' ELSE 'ok' END AS verdict FROM c GROUP BY book")
def _(spark, d):
    return V.volume_check(small_books(spark, d))


@query("cluster_audit", with_(c=X.concepts) + "SELECT book, cluster, count(*) AS n, CASE WHEN count(*) < 5 THEN 'small' WHEN count(*) > 30 THEN 'large' ELSE 'ok' END AS size_verdict, count(*) OVER (PARTITION BY book) AS n_clusters, CASE WHEN count(*) OVER (PARTITION BY book) BETWEEN 5 AND 8 THEN 'ok' ELSE 'adjust' END AS count_verdict FROM c GROUP BY book, cluster")
def _(spark, d):
    return V.cluster_audit(fixture(spark, d, X.concepts).select("book", "cluster", "concept"))


@query("assign_missing", with_(c=X.concepts, f="SELECT book, min_by(cluster, ord) AS cluster FROM c GROUP BY book") + "SELECT c.book, CASE WHEN position % 6 = 0 THEN f.cluster ELSE c.cluster END AS cluster, concept FROM c JOIN f USING (book)")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    return V.assign_missing(c, c.filter("position % 6 <> 0"), c)


@query("fill_extractions", with_(c=X.concepts) + "SELECT book, cluster, concept, CASE WHEN position % 5 = 0 THEN '' ELSE description END AS description, CASE WHEN position % 5 = 0 THEN 'medium' ELSE weight END AS weight, position % 5 = 0 AS placeholder FROM c")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    return V.fill_extractions(c, c.filter("position % 5 <> 0"))


@query("extraction_counts", with_(c=X.concepts) + "SELECT book, cluster, count(*) FILTER (weight <> 'light') AS n_concepts FROM c GROUP BY book, cluster")
def _(spark, d):
    c = fixture(spark, d, X.concepts)
    return V.extraction_counts(c.filter("weight <> 'light'"), c.select("book", "cluster").distinct())


@query("merge_concepts", with_(c=X.concepts) + "SELECT book, cluster AS concept, min(ord) AS ord FROM c GROUP BY book, cluster")
def _(spark, d):
    return V.merge_concepts(fixture(spark, d, X.concepts).select("book", F.col("cluster").alias("concept"), "ord"))


@query("capitalized_terms", r"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]{3,})', 1)) AS term FROM documents) GROUP BY ALL")
def _(spark, d):
    return V.capitalized_terms(docs(spark, d))
