"""Boundary values and plain-Python folds for operators that SQL cannot express or that have sharp edges."""

import graphlib
import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.functions import jsonx as J
from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators import checks as C
from lectern.operators import graph as G
from lectern.operators import inventory as V
from lectern.operators import model as M
from lectern.operators import planner as P
from lectern.plans import curriculum
from lectern.sources import store as S
from lectern.streaming import progress as ST


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("n", "end", "ok", "why"), [(1499, ".", False, "short"), (1500, ".", True, "below target"), (1799, "?", True, "below target"), (1800, ".", True, ""), (2600, "!", True, ""), (2601, ".", False, "long"), (2000, ",", False, "cut")])
def test_length_bounds(spark, n, end, ok, why):
    got = one(spark, " ".join(["w"] * n) + end, C.length_verdict)
    assert (got["passed"], got["word_count"], got["reason"]) == (ok, n, why)


@pytest.mark.parametrize(("n", "verdict"), [(20, "split"), (39, "split"), (40, "ok"), (250, "ok"), (251, "merge"), (300, "merge")])
def test_volume(spark, n, verdict):
    assert one(spark, n, V.volume, "int") == verdict


@pytest.mark.parametrize(("text", "tag"), [
    ("42", "PAGE-NUMBER"), ("Page 5", "PAGE-NUMBER"), ("p. 12", "PAGE-NUMBER"), ("Figure 1: a map", "FIGURE-CAPTION"), ("Fig. 3 — shows", "FIGURE-CAPTION"),
    ("1 This is a note", "FOOTNOTE"), ("* Special note", "FOOTNOTE"), ("def my_func():", "CODE"), ("x = 4", "CODE"), ("Algorithm 1: sort", "ALGORITHM"),
    ("Input: a list", "ALGORITHM"), ("Model\tTime\tSize\nA\tb\tc", "TABLE"), ("A plain sentence", "BODY"), ("  ", "BODY"),
])
def test_classification(spark, text, tag):
    none = F.lit(False)
    assert one(spark, text, lambda x: B.classify(x, F.lit(9), F.lit("Serif"), F.lit(11.0), F.lit(0), none)) == tag


def test_headings_and_fonts(spark):
    tag = lambda size, flags, font="Serif": one(spark, "Memory", lambda x: B.classify(x, F.lit(1), F.lit(font), F.lit(size), F.lit(flags), F.lit(False)))
    assert (tag(16.5, 16), tag(14.0, 16), tag(16.5, 0), tag(16.0, 16), tag(9.0, 0, "Courier")) == ("HEADER", "SUBHEADER", "BODY", "SUBHEADER", "CODE")


@pytest.mark.parametrize(("raw", "want"), [("hello   world\n test", "hello world test"), ("con-\nnection", "connection"), ("ﬁle ﬂow", "file flow"), ("grö-\nße", "größe"), ("sum ∑", "sum ∑ [MATH]"), ("", "")])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, T.clean_text) == want


def test_table_to_prose(spark):
    assert one(spark, "Model  Latency  Throughput\nA  1  2\nB  3  4", T.table_to_prose) == "For A, latency is 1. For A, throughput is 2. For B, latency is 3. For B, throughput is 4."
    assert one(spark, "one line", T.table_to_prose) == "one line"


@pytest.mark.parametrize(("stem", "want"), [("LargeModels", "large-models"), ("A b_c", "a-b-c"), ("!!", "book"), ("x--y", "x-y")])
def test_slug(spark, stem, want):
    assert one(spark, stem, T.slug) == want


def test_nbsp_is_white_space(spark):
    assert one(spark, "a b", T.word_count) == 2 and one(spark, "", T.word_count) == 0


@pytest.mark.parametrize(("n", "want"), [("", 1), ("a", 1), ("a" * 9, 2)])
def test_token_estimate(spark, n, want):
    assert one(spark, n, T.token_estimate) == want


def plain_last_complete(text, n):
    window = " ".join(text.split()[-max(2 * n, 400) :])
    for m in ("? ", ". ", "! "):
        if (at := window.rfind(m)) >= 0:
            window = window[: at + 1]
            break
    return " ".join(window.split()[-n:])


def plain_trim(text, n):
    if len(text.split()) <= n:
        return text
    cut = " ".join(text.split()[:n])
    for m in (". ", "? ", "! "):
        if (at := cut.rfind(m)) > len(cut) * 0.85:
            return cut[: at + 1]
    return cut


def plain_question(text):
    words = text.split()
    tail = " ".join(words[-300:]) if len(words) >= 300 else text
    if "?" not in tail:
        return None
    q = tail.rfind("?")
    start = max(tail[:q].rfind(m) for m in (". ", "! ", "? "))
    return tail[start + 2 if start >= 0 else 0 : q + 1].strip()


def test_word_trims_against_plain_python(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "cc.", "dd?", "ee!", "fff"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", T.last_complete(F.col("t"), 50).alias("a"), T.trim_words(F.col("t"), 100).alias("b"), T.tension_question(F.col("t")).alias("c")).collect()
    for r in got:
        assert r["a"].split() == plain_last_complete(r["t"], 50).split()
        assert (r["b"], r["c"]) == (plain_trim(r["t"], 100), plain_question(r["t"]))


def test_chunks(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("x" * rng.randint(1, 90) for _ in range(80)), "y" * 450, "", None, "z", "\n\n".join(["p q"] * 300), "a\n\n\n\n" * 90, "w " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in V.paragraph_chunks(rows, 200).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
        assert r["chunk_no"] == len(got[r["doc_id"]])
    for i, text in enumerate(texts):
        parts, left = got.get(i, []), text or ""
        assert "".join("".join(parts).split()) == "".join(left.split()) and all(len(p) <= 200 and p == p.strip() for p in parts)
        for p, following in zip(parts, parts[1:], strict=False):  # a cut is at an empty line, or the part is full, or was before it was stripped
            left = left[left.index(p) :]
            assert left[len(p) : len(p) + 2] == "\n\n" or "\n\n" not in left[:200].rstrip() or not following
            left = left[len(p) :]
    assert got[1] == ["y" * 200, "y" * 200, "y" * 50] and 2 not in got and 3 not in got and got[4] == ["z"]


@pytest.mark.parametrize(("raw", "value"), [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('so: {"k": 3} ok', 3), ("nothing", None), ("", None)])
def test_tolerant_json(spark, raw, value):
    assert one(spark, raw, lambda x: F.try_variant_get(J.tolerant(x), "$.k", "int")) == value


@pytest.mark.parametrize(("raw", "passed"), [("YES it does", True), ("no", False), ("well, YES", True), ("I say NO", False), ("maybe", False), ("NOT so", False)])
def test_verdict(spark, raw, passed):
    assert one(spark, raw, J.verdict)["passed"] is passed


@pytest.mark.parametrize("raw", ['{"concepts": [{"name": "a"}, {"name": "b', '{"concepts": [{"name": "a"}, {"na', '{"a": [1, 2', '{"a": "q\\"uote'])
def test_salvage(raw):
    json.loads(J.salvage_text(raw))


def fold_pack(weights):
    out, cur, total = [], [], 0
    for w in weights:
        if w >= 3:
            out, cur, total = [*out, *([cur] if cur else []), [w]], [], 0
            continue
        if cur and (total + w > 6 or len(cur) >= 5):
            out, cur, total = [*out, cur], [], 0
        cur, total = [*cur, w], total + w
        if len(cur) >= 3 and total >= 6:
            out, cur, total = [*out, cur], [], 0
    return [*out, cur] if cur else out


@pytest.mark.parametrize("weights", [[2] * 7, [1] * 12, [1, 2, 1, 2, 1, 2, 2, 3, 1, 1], [3, 3], [1], [3, 1, 1, 1], [random.Random(9).choice([1, 2, 3]) for _ in range(200)]])
def test_pack(spark, weights):
    name = {1: "light", 2: "medium", 3: "heavy"}
    rows = spark.createDataFrame([("b", i, f"c{i}", name[w]) for i, w in enumerate(weights)], "book string, position long, concept string, weight string")
    by = {}
    for r in P.pack(rows).orderBy("position").collect():
        by.setdefault(r["number"], []).append(weights[r["position"]])
    assert [by[k] for k in sorted(by)] == fold_pack(weights) and sorted(by) == list(range(1, len(by) + 1))


def test_tiers_cycles_and_order(spark):
    rng = random.Random(1)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(60)}
    concepts = spark.createDataFrame([("b", n, "c", i) for i, n in enumerate(names)], "book string, concept string, cluster string, ord int")
    edges = spark.createDataFrame([("b", *p, "explicit") for p in pairs], "book string, src string, dst string, source string")
    want = {}
    for n in graphlib.TopologicalSorter({n: {a for a, b in pairs if b == n} for n in names}).static_order():
        want[n] = max((want[a] + 1 for a, b in pairs if b == n), default=0)
    assert {r["concept"]: r["tier"] for r in G.tiers(concepts, edges).collect()} == want
    assert G.order_violations(G.grouped_order(concepts, edges), edges).count() == 0
    assert G.cycle_core(edges).count() == 0
    assert [r["concept"] for r in G.grouped_order(concepts, edges.limit(0)).orderBy("position").collect()] == names
    looped = edges.unionByName(spark.createDataFrame([("b", "x", "y", "explicit"), ("b", "y", "x", "explicit")], edges.schema))
    assert {r["node"] for r in G.cycle_core(looped).collect()} == {"x", "y"}
    assert {(r["src"], r["dst"]) for r in looped.subtract(G.break_cycles(looped)).collect()} == {("y", "x")}
    more = concepts.unionByName(spark.createDataFrame([("b", "x", "a", 98), ("b", "y", "a", 99)], concepts.schema))
    for order in (G.topological_order, G.grouped_order):  # a book with a cycle keeps its order
        assert [r["concept"] for r in order(more, looped).orderBy("position").collect()] == [*names, "x", "y"]
    with pytest.raises(Exception, match="cycle"):
        G.tiers(more, looped).collect()
    ordered = {r["concept"]: r["tier"] for r in G.tiers(more, looped, "ord").collect()}
    assert {n: ordered[n] for n in names} == want and (ordered["x"], ordered["y"]) == (1, 2)


def test_large_books_are_walked_in_rounds(spark, monkeypatch):
    rng = random.Random(6)
    names = [f"n{i:02d}" for i in range(25)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(50)} | {("unknown", "n03")}
    concepts = spark.createDataFrame([("b", n, i) for i, n in enumerate(names)], "book string, concept string, ord int")
    edges = spark.createDataFrame([("b", *p, "explicit") for p in pairs], "book string, src string, dst string, source string")
    looped = edges.unionByName(spark.createDataFrame([("b", "n20", "n02", "implicit"), ("c", "p", "q", "implicit"), ("c", "q", "p", "implicit")], edges.schema))
    small = [sorted(map(tuple, f.collect())) for f in (G.tiers(concepts, edges), G.cycle_core(looped), G.cycle_core(edges))]
    monkeypatch.setattr(G, "BOOK_EDGES", 3)
    assert [sorted(map(tuple, f.collect())) for f in (G.tiers(concepts, edges), G.cycle_core(looped), G.cycle_core(edges))] == small
    with pytest.raises(ValueError, match="cycle"):
        G.tiers(concepts, looped)


def test_closing_edges_leave_no_cycle():
    rng = random.Random(2)
    pairs = [(f"{rng.randint(0, 9)}", f"{rng.randint(0, 9)}") for _ in range(40)]
    pairs = [p for p in pairs if p[0] != p[1]]
    left = set(pairs) - set(G.closing_edges(pairs, 1000))
    graph = {}
    for a, b in left:
        graph.setdefault(b, set()).add(a)
    list(graphlib.TopologicalSorter(graph).static_order())


def test_repaired_order():
    members, needs = {1: ["a"], 2: ["b"], 3: ["c"]}, {"a": ["c"], "c": ["b"]}
    assert P.repaired_order([1, 2, 3], members, needs) == [2, 3, 1]
    assert P.repaired_order([1, 2, 3], members, {}) == [1, 2, 3]


def test_revisits_are_used_once(spark):
    rows = spark.createDataFrame([("b", n, c, s) for n in range(3, 9) for c, s in (("x", 0.9), ("y", 0.5), ("z", 0.5))], "book string, number int, concept string, score double")
    got = [(r["number"], r["concept"]) for r in P.revisit_once(rows).orderBy("number").collect()]
    assert got == [(3, "x"), (4, "z"), (5, "y")]


def test_store_and_curriculum(spark, tmp_path):
    lines = ["Memory Caches hold recent Values near Processors.", "Latency Hiding needs Parallel Requests always.", "Bandwidth Limits shape Kernels and Layouts."]
    rows = [(1, p, i, f"{lines[(p + i) % 3]} Page{p} item.", "Serif", 11.0, 0, 50.0, 20.0 + i, 290.0, 600.0) for p in range(1, 6) for i in range(4)]
    ddl = "doc_id long, page int, ord int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, page_width double"
    blocks = spark.createDataFrame(rows, ddl).withColumns({"x": F.col("x0"), "y": F.col("y0")})
    store = S.StageStore(spark, f"file://{tmp_path}/run")
    assert curriculum.run(store, blocks, approve=lambda index: False)[-1] == "IndexGen"
    assert curriculum.run(store, blocks)[-1] == "Complete" and curriculum.run(store, blocks) == []
    index = store.load("IndexGen")
    assert index.count() == store.load("SessionGen").count() > 0
    assert store.progress()["completed"] == list(S.STAGES)
    store.reset("SessionGen")
    assert not store.is_complete("SessionGen") and store.current() == "Complete"
    progress = spark.createDataFrame([("s", "bookmark", "0"), ("s", "completed", "true"), ("t", "bookmark", None)], "session_id string, key string, value string")
    out = S.write_export(index.select("book", "number", "title"), progress, f"file://{tmp_path}", datetime(2026, 1, 2))
    assert S.read_export(spark, out).count() == index.count()
    assert sorted(map(tuple, S.read_progress(spark, out).collect()), key=str) == sorted(map(tuple, progress.collect()), key=str)
    store.reset()
    assert store.current() is None


def test_pending_stages():
    assert S.pending_stages(None) == list(S.STAGES) and S.pending_stages("SessionGen") == ["Complete"] and S.pending_stages("?") == list(S.STAGES)


def test_config_and_paths(tmp_path):
    assert S.Config.load(str(tmp_path / "none")).provider == "offline"
    for bad in ({"host": "ftp://x"}, {"provider": "hosted"}):
        (tmp_path / "c.json").write_text(json.dumps(bad))
        with pytest.raises(S.PipelineError):
            S.Config.load(str(tmp_path / "c.json"))
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    assert S.pdf_path(str(tmp_path / "a.PDF")).endswith("a.PDF")
    with pytest.raises(S.PipelineError):
        S.pdf_path(str(tmp_path / "none.pdf"))


def test_retries():
    calls, waits = [], []

    class Failing:
        def generate(self, task, prompt):
            calls.append(1)
            if len(calls) < 3:
                raise OSError
            return "ok"

    assert M.Retrying(Failing(), sleep=waits.append).generate("t", "p") == "ok" and waits == [2.0, 4.0]


def test_a_failed_call_keeps_its_row(spark):
    class Bad:
        def generate(self, task, prompt):
            raise ValueError("no " + prompt)

    got = spark.createDataFrame([("a",), ("b",)], "x string").select(M.ask("t", F.col("x"), Bad).alias("r")).select("r.*").collect()
    assert [(r["answer"], r["error"]) for r in got] == [(None, "no a"), (None, "no b")]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"2026-01-01 00:{m:02d}:{s:02d}", m % 3, m + s) for m in range(10) for s in range(0, 60, 7)]
    events = spark.createDataFrame(rows, "t string, user_id int, tokens long").select(F.col("t").cast("timestamp").alias("ts"), "user_id", "tokens")
    events.write.parquet(str(tmp_path / "e"))
    stream = ST.read_events(spark, str(tmp_path / "e"), events.schema, 100)
    got = ST.run_to_memory(ST.rate_windows(stream), "rates", "complete")
    want = events.groupBy("user_id", F.window("ts", "60 seconds", "30 seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens")).select("user_id", F.col("w.start").alias("start"), "requests", "tokens")
    assert sorted(got.collect()) == sorted(want.collect())
    quota = ST.run_to_memory(ST.daily_quota(ST.read_events(spark, str(tmp_path / "e"), events.schema)), "quota", "complete")
    assert sum(r["used"] for r in quota.collect()) == sum(r[2] for r in rows)


def test_spans(spark):
    span = "struct<text: string, font: string, size: double, flags: int, origin: struct<x: double, y: double>>"
    df = spark.sql(f"SELECT 1 AS doc_id, from_json('[{{\"spans\": [{{\"text\": \"a\", \"size\": 9}}, {{\"text\": \"b\"}}]}}, {{\"spans\": [{{\"text\": \"c\"}}]}}]', 'array<struct<spans: array<{span}>>>') AS lines")
    row = B.from_spans(df).first()
    assert (row["text"], row["size"], row["font"], row["flags"]) == ("a b\nc", 9.0, "", 0)


def test_no_word_lists_overlap():
    assert len(C.REVISIT_OFFLINE) == 26 and len(C.REVISIT_ONLINE) == 13 and len(T.BANNED_LAST_WORDS) == 28 and len(T.STOP_WORDS) == 19
    assert all(re.fullmatch(r"[a-z ,]+", m) for m in C.REVISIT_OFFLINE)


def test_the_six_checks(spark):
    from lectern.operators import generation as N

    long = " ".join(["word"] * 1900)
    good = f"Earlier we saw the cache.\n\n{long}\n\nIt ends here. What breaks first when this limit meets scale?"
    rows = [("b", 1, good, ["cache", "bus"], None), ("b", 2, "Plain opening. " + long + ".", ["cache"], "cache"), ("b", 3, good, ["x"], "cache")]
    s = spark.createDataFrame(rows, "book string, number int, content string, concepts array<string>, revisit string")
    got = {(r["number"], r["check"]): r["passed"] for r in N.evaluate(s).collect()}
    assert len(got) == 18
    assert got[1, "TENSION"] and not got[2, "TENSION"] and got[1, "ANCHOR"] and got[1, "REVISIT"] and not got[2, "REVISIT"] and got[3, "LENGTH"] and got[2, "TRANSITIONS"]


def test_repair_cuts_back_and_asks(spark):
    from lectern.operators import generation as N

    text = " ".join(["Word"] * 1999) + " done. And then it"
    row = N.repair_truncated(spark.createDataFrame([("b", 1, text), ("b", 2, "Fine.")], "book string, number int, content string")).orderBy("number").collect()
    assert "done.\n\nWhat breaks first" in row[0]["content"] and row[0]["content"].endswith("?") and row[1]["content"] == "Fine."


def test_sessions_follow_each_other_and_failures_stay_in_their_row(spark):
    from lectern.operators import generation as N

    class Provider:
        def generate(self, task, prompt):
            if "bad" in prompt:
                raise ValueError("no")
            if task == "frame":
                return f"Because of {prompt.partition(':')[0]}.\n \nmore\n\nWhat of {prompt[-9:]}?"
            return f"[{task}] {prompt[:40]}?" if task == "question" else f"[{task}] {prompt}"

    plan = [("b", 1, "One", [("cache", "d"), ("bus", "d")], None), ("b", 2, "Two", [("bad", "d")], None), ("b", 3, "Three", [("port", "d")], ("cache", "r"))]
    index = spark.createDataFrame(plan, "book string, number int, title string, concepts array<struct<name: string, description: string>>, revisit struct<name: string, reason: string>")
    got = {r["number"]: r for r in N.generate_in_order(index, Provider).collect()}
    assert got[1]["card"].startswith("[card] cache, bus\n") and got[1]["content"].startswith("Because of One.\n\nmore\n\n[section] cache") and got[1]["content"].endswith(got[1]["card"])
    assert got[1]["tension_excerpt"].endswith("?") and "[card]" not in got[1]["tension_excerpt"]
    assert got[2]["content"] is None and got[2]["error"] == "no" and "Because of Three" in got[3]["content"] and "Return to cache" in got[3]["content"]
    assert got[3]["card"] == "" and got[3]["content"].endswith("?")


def test_index_revision(spark):
    from lectern.operators import generation as N

    index = spark.createDataFrame([("b", 1, "A"), ("b", 2, "B")], "book string, number int, title string")
    for note in ("keep all", "make it better"):
        assert sorted(map(tuple, N.revise_index(index, note).collect())) == [("b", 1, "A"), ("b", 2, "B")]
    assert J.parse_object('```json\n{"a": [1, 2\n') == {"a": [1, 2]} and J.parse_object('so {"b": 1} ok') == {"b": 1}


def test_admission_and_waits():
    from lectern.operators import progress as R

    assert R.schedule([0, 1, 2, 3], [1, 1, 1, 1], 2, 100) == [0, 1, pytest.approx(60, abs=1e-3), pytest.approx(61, abs=1e-3)]
    assert R.schedule([0, 1], [500, 1], 9, 100) == [0, pytest.approx(60, abs=1e-3)]  # an oversize request alone is let through
    assert R.admit([(0.0, 1)], 60.0, 1, 1, 100)[0] is False and R.admit([(0.0, 1)], 60.1, 1, 1, 100)[0] is True


def test_streamed_admissions_equal_the_fold(spark, tmp_path):
    from lectern.operators import progress as R

    rng = random.Random(4)
    rows = sorted((rng.randint(0, 300), i, f"k{i % 2}", rng.randint(1, 60)) for i in range(120))
    for part in range(3):  # three files, read one a batch and in order of time
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "s long, ord long, key_id string, tokens long").select(F.timestamp_seconds("s").alias("ts"), "ord", "key_id", "tokens").coalesce(1).write.parquet(str(tmp_path / f"e/p{part}"))
    schema = spark.read.parquet(str(tmp_path / "e/p0")).schema
    stream = ST.read_events(spark, str(tmp_path / "e/*"), schema, 1)
    got = {r["ord"]: r["admitted"] for r in ST.run_to_memory(ST.admissions(stream, 5, 120), "admitted").collect()}
    recent = {"k0": [], "k1": []}
    for at, i, key, n in rows:
        ok, recent[key] = R.admit(recent[key], float(at), n, 5, 120)
        assert got[i] is ok


def test_pages_of_two_columns_are_read_in_turn(spark):
    from lectern.operators import blocks as B

    ddl = "doc_id long, page int, ord int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, page_width double"
    plain = lambda doc, page, ord, text, x0, y0, x1, width=600.0: (doc, page, ord, text, "Serif", 11.0, 0, x0, y0, x1, width)
    rows = [
        plain(1, 1, 0, "Left two is here", 50.0, 200.0, 280.0), plain(1, 1, 1, "Left one is here", 50.0, 100.0, 280.0), plain(1, 1, 2, "Right one is here", 320.0, 100.0, 560.0),
        plain(1, 1, 3, "Right two is here", 320.0, 200.0, 560.0), plain(1, 1, 4, "Left three is here", 50.0, 300.0, 280.0), plain(1, 1, 5, "Same height is here", 50.0, 300.0, 280.0),
        plain(1, 2, 0, "Second page below", 55.0, 300.0, 560.0), plain(1, 2, 1, "Second page above", 60.0, 100.0, 560.0), plain(1, 2, 2, "Second page last", 50.0, 50.0, 560.0),
        plain(2, 1, 0, "Two blocks alone", 320.0, 300.0, 560.0), plain(2, 1, 1, "Are no columns", 50.0, 100.0, 280.0),
        plain(3, 1, 0, "No place known", None, None, None, None), plain(3, 1, 1, "Nor here", None, None, None), plain(3, 1, 2, "Nor there", 50.0, 1.0, 90.0),
        plain(4, 1, 0, "42", 560.0, 700.0, 570.0), plain(4, 1, 1, "Noise tells columns", 50.0, 90.0, 250.0), plain(4, 1, 2, "Before it by height", 50.0, 10.0, 250.0),
    ]
    blocks = spark.createDataFrame(rows, ddl).withColumns({"x": F.col("x0"), "y": F.col("y0")}).repartition(3)
    got = {r["doc_id"]: [x.removeprefix("BODY: ") for x in r["text"].split("\n") if x] for r in B.ingest(blocks).collect()}
    assert got[1] == ["Left one is here", "Right one is here", "Left two is here", "Right two is here", "Left three is here", "Same height is here", "Second page below", "Second page above", "Second page last"]
    assert got[2] == ["Two blocks alone", "Are no columns"] and got[3] == ["No place known", "Nor here", "Nor there"]
    assert got[4] == ["Before it by height", "Noise tells columns"]
    bare = {r["doc_id"]: r["text"] for r in B.ingest(blocks.drop("page_width")).collect()}
    assert bare[1].index("Left two") < bare[1].index("Left one")
    plan = B.reading_order(blocks.withColumns({"tag": F.lit("BODY"), "content": F.col("text")}))
    assert B.assemble(plan)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def test_terms_are_matched_by_containment_without_all_pairs(spark):
    from lectern.operators import graph as G

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcÉé ") for _ in range(rng.randint(0, 7)))
    names = list(dict.fromkeys((b, word()) for b in ("x", "y") for _ in range(150)))
    concepts = [(b, n, i) for i, (b, n) in enumerate(names)] + [("z", "Only", 0), ("z", None, 1)]
    terms = [(b, word()) for b in ("x", "y", "none") for _ in range(200)] + [("z", t) for t in ("only one", "ON", "o", "", None, "ONLY", "Only", "ylno")]

    def first(book, term):
        own = [(n, i) for b, n, i in concepts if b == book and n is not None]
        if term in [n for n, _ in own]:
            return term
        met = [(i, n) for n, i in own if term.lower() in n.lower() or n.lower() in term.lower()]
        return min(met)[1] if met else None

    want = {(b, t, c) for b, t in terms if t is not None and (c := first(b, t)) is not None}
    got = G.match_terms(spark.createDataFrame(terms, "book string, term string"), spark.createDataFrame(concepts, "book string, concept string, ord int"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_terms_of_a_large_book_meet_few_names(spark):
    from lectern.operators import graph as G

    names = spark.range(100_000).select(F.lit("b").alias("book"), F.concat(F.lit("The common concept "), F.sha1(F.col("id").cast("string"))).alias("concept"), F.col("id").cast("int").alias("ord"))
    part = F.substr(F.sha1(F.col("id").cast("string")), F.lit(3), F.lit(20))
    terms = spark.range(0, 100_000, 50).select(F.lit("b").alias("book"), F.when(F.col("id") % 100 == 0, F.upper(part)).otherwise(F.concat(F.lit("see the common concept "), F.sha1(F.col("id").cast("string")))).alias("term"))
    low = lambda df, c, to: df.select("book", F.col(c).alias(to), F.lower(c).alias("low"))
    rare = G.rarest_grams(low(terms, "term", "needle"), G.indexed(low(names, "concept", "hay")))
    assert rare.agg(F.sum("n")).first()[0] < 120_000  # all pairs are 2 * 10**8
    assert G.match_terms(terms, names).count() == 2000


def test_order_repair_equals_the_rescan(spark):
    from lectern.operators import planner as P

    def rescanned(order, members, prerequisites):
        order = list(order)
        for _ in range(len(order)):
            at = {c: i for i, s in enumerate(order) for c in members[s]}
            move = next(((i, at[p]) for i, s in enumerate(order) for c in members[s] for p in prerequisites.get(c, ()) if at.get(p, -1) > i), None)
            if move is None:
                break
            order.insert(move[0], order.pop(move[1]))
        return order

    rng = random.Random(13)
    for _ in range(300):
        n = rng.randint(1, 14)
        members = {s: [f"c{s}.{k}" for k in range(rng.randint(0, 3))] for s in rng.sample(range(50), n)}
        every = [c for m in members.values() for c in m] + ["unknown"]
        needs = {c: rng.sample(every, min(len(every), rng.randint(0, 3))) for c in every if rng.random() < 0.6}
        order = rng.sample(list(members), n)
        assert P.repaired_order(order, members, needs) == rescanned(order, members, needs)
    n = 20_000
    chain = P.repaired_order(list(range(n)), {i: [str(i)] for i in range(n)}, {str(i): [str(i + 1)] for i in range(n - 1)})
    assert chain == list(range(n - 1, -1, -1))


def test_paragraph_chunks_of_long_texts(spark):
    from lectern.operators import inventory as I  # noqa: E741

    def folded(text, size):
        out = []
        while len(text) > size:
            at = text.rfind("\n\n", 0, size)
            at = size if at == -1 else at
            out.append(text[:at].strip())
            text = text[at:].strip()
        return [*out, text] if text else out

    rng = random.Random(14)
    texts = ["".join(rng.choice(["a", "bc ", "\n\n", "\n", " ", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", "\n\n", "\n\n" + "x" * 30, "x" * 20, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in I.paragraph_chunks(df, 10).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {i: c for i, t in enumerate(texts) if (c := folded(t or "", 10))}
    long = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("word " * 98 + "end.\n\n"), 100_000).alias("text"))
    assert I.paragraph_chunks(long).agg(F.count(F.lit(1)), F.max(F.length("chunk"))).first()[0] > 1200


def test_strong_components_of_small_and_large_books(spark, monkeypatch):
    from lectern.operators import graph as G

    rng = random.Random(15)
    edges = [("", "a", "a"), ("", "a", "b"), (None, "x", "y"), (None, "y", "x")]
    for book, n, m in (("small", 6, 8), ("rings", 24, 26), ("dense", 30, 90), ("sparse", 60, 50)):
        edges += [(book, f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)]
    edges += [("chain", f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [("chain", f"c{i + 1:02}", f"c{i:02}") for i in (3, 4, 11)] + [("chain", "c09", "c07")]

    def brute(own):
        after = {}
        for a, b in own:
            after.setdefault(a, set()).add(b)
        nodes = {x for p in own for x in p}

        def reached(x):
            seen, todo = {x}, [x]
            while todo:
                for y in after.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        far = {x: reached(x) for x in nodes}
        return {x: min(y for y in far[x] if x in far[y]) for x in nodes}

    want = {(b, n, c) for b in {e[0] for e in edges} for n, c in brute([e[1:] for e in edges if e[0] == b]).items()}
    df = spark.createDataFrame(edges, "book string, src string, dst string").repartition(3)
    assert set(map(tuple, G.strong_components(df).collect())) == want
    core = set(map(tuple, G.cycle_core(df).collect()))
    monkeypatch.setattr(G, "BOOK_EDGES", 22)  # rings, dense, sparse and chain are large ones now, the others are not
    got = G.strong_components(df).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert set(map(tuple, G.cycle_core(df).collect())) == core
    assert G.strong_components(df.limit(0)).count() == 0


def test_tiers_of_small_and_large_books_together(spark, monkeypatch):
    from lectern.operators import graph as G

    rng = random.Random(16)
    edges = [(b, f"c{x:02}", f"c{y:02}") for b, n in (("a", 5), ("b", 40)) for x, y in (sorted(rng.sample(range(n), 2)) for _ in range(2 * n))]
    concepts = spark.createDataFrame([(b, f"c{i:02}", i) for b, n in (("a", 5), ("b", 40), ("none", 2)) for i in range(n)], "book string, concept string, position int")
    df = spark.createDataFrame(edges, "book string, src string, dst string")
    want = sorted(map(tuple, G.tiers(concepts, df).collect()))
    monkeypatch.setattr(G, "BOOK_EDGES", 10)
    assert sorted(map(tuple, G.tiers(concepts, df).collect())) == want and len(want) == 47


def test_streamed_progress_equals_the_batch(spark, tmp_path):
    from lectern.operators import progress as R
    from lectern.sources.store import KeyedStore

    rng = random.Random(17)
    bodies = []
    for i in range(160):
        session = rng.choice(["s1", "s2", "s3", "s4", ""])
        bodies.append(rng.choice([
            {"session_id": session, "bookmark_word_index": rng.choice([None, 0, i])}, {"session_id": session, "completed": True, "bookmark_word_index": None}, {"session_id": session, "completed": rng.choice([False, None])},
            {"session_id": session, "updates": {"bookmark": i, "note": None}}, {"session_id": session, "theme": "dark" if i % 2 else None}, {"session_id": session, "updates": {"bookmark_word_index": i}},
        ]))
    rows = [(json.dumps(b), 1_000 + i, i) for i, b in enumerate(bodies)]
    late = rows[:]
    rng.shuffle(late)  # late ones in every file, and some twice
    late += rng.sample(rows, 40)
    posts = "body string, s long, ord long"
    for part in range(5):
        spark.createDataFrame(late[part * 40 : part * 40 + 40], posts).select("body", F.timestamp_seconds("s").alias("ts"), "ord").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    schema = spark.read.parquet(str(tmp_path / "in/p0")).schema
    store = KeyedStore(spark, f"file://{tmp_path}/store", ("session_id",))
    events = lambda pattern: R.progress_events(ST.read_events(spark, str(tmp_path / pattern), schema, 1))
    for pattern in ("in/p[0-2]", "in/p*"):  # the second run starts anew from the checkpoint, with two more files
        ST.keep_progress(events(pattern), store, str(tmp_path / "checkpoint")).awaitTermination()
        seen = R.progress_events(spark.read.parquet(str(tmp_path / pattern)))
        left = R.latest(seen)
        entries = {r["session_id"]: {} for r in seen.select("session_id").distinct().collect()}
        for r in left.collect():
            entries[r["session_id"]][r["key"]] = r["value"]
        status = {r["session_id"]: (r["status"], r["bookmark"]) for r in R.feed_status(left).collect()}
        got = {r["session_id"]: r for r in store.read().collect()}
        assert {s: r["entries"] for s, r in got.items()} == entries and "" not in got
        assert {s: (r["status"], r["bookmark"]) for s, r in got.items()} == {s: status.get(s, ("none", None)) for s in entries}


def test_streamed_dwell_completes_the_last_view(spark, tmp_path):
    from lectern.operators import progress as R

    rng = random.Random(18)
    rows = sorted((rng.randint(0, 400) * 500, i, rng.randint(1, 3)) for i in range(90))  # ms; many at one time
    files = [rows[k : k + 30] for k in (0, 30, 60)]
    files[0], files[1] = files[0][:-2] + files[1][:2], files[0][-2:] + files[1][2:]  # some out of order
    files.append([(10_000_000, 900, 9)])  # another user, much later
    for part, own in enumerate(files):
        spark.createDataFrame(own, "ms long, ord long, user_id long").select("user_id", F.timestamp_millis("ms").alias("ts"), "ord").coalesce(1).write.parquet(str(tmp_path / f"v/p{part}"))
    schema = spark.read.parquet(str(tmp_path / "v/p0")).schema
    stream = ST.read_events(spark, str(tmp_path / "v/*"), schema, 1)
    got = ST.run_to_memory(ST.dwell(stream, 3.0, "60 seconds"), "dwelt").collect()
    batch = R.dwell(spark.read.parquet(str(tmp_path / "v/*")), 3.0, F.timestamp_millis(F.lit(9_940_000))).filter("user_id < 9").collect()
    assert {(r["user_id"], r["ord"]): r["done"] for r in got} == {(r["user_id"], r["ord"]): r["done"] for r in batch} and len(got) == 90
    lasts = {u: max((t, i) for t, i, v in rows if v == u)[1] for u in (1, 2, 3)}
    assert all(r["done"] for r in got if lasts.get(r["user_id"]) == r["ord"])
    assert not any(r["done"] for r in R.dwell(spark.read.parquet(str(tmp_path / "v/*"))).collect() if lasts.get(r["user_id"]) == r["ord"])


def test_streamed_reports_settle_requests(spark, tmp_path):
    from lectern.operators import progress as R

    requests = [(f"k{i % 3}", f"r{i}", i * 20, 100 + i) for i in range(40)] + [("z", "end", 20_000, 1)]
    reports = [(f"r{i}", i * 20 + wait, 1000 + i) for i, wait in zip(range(0, 40, 2), [0, 5, 599, 600, 601, 900] * 4, strict=False)] + [("nobody", 50, 7), ("end", 20_000, 9)]
    for name, rows, ddl, at in (("requests", requests, "key_id string, request_id string, s long, tokens long", "ts"), ("reports", reports, "request_id string, s long, actual long", "reported")):
        rows = sorted(rows, key=lambda r: r[2] if name == "requests" else r[1])
        for part in range(3):
            own = rows[part * 14 : part * 14 + 14] if part < 2 else rows[28:]
            if own:
                spark.createDataFrame(own, ddl).withColumn(at, F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.parquet(str(tmp_path / f"{name}/p{part}"))
    read = lambda name: ST.read_events(spark, str(tmp_path / f"{name}/*"), spark.read.parquet(str(tmp_path / f"{name}/p0")).schema, 1)
    got = ST.run_to_memory(ST.settled(read("requests"), read("reports")), "settled").collect()
    batch = R.settled_tokens(spark.read.parquet(str(tmp_path / "requests/*")), spark.read.parquet(str(tmp_path / "reports/*"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(got) == 41
    by = {r["request_id"]: r for r in got}
    assert by["r6"]["settled"] and not by["r8"]["settled"] and by["r8"]["tokens"] == 108 and by["r6"]["tokens"] == 1006 and not by["r1"]["settled"]


def test_reports_of_all_books(spark):
    checks = [(b, n, c, (n + len(c)) % b != 0) for b in (1, 2, 5) for n in range(1, 4) for c in ("tension", "length", "anchor", "revisit")]
    audit = C.structural_audit(spark.createDataFrame(checks, "book long, number long, check string, passed boolean"))
    averages = spark.createDataFrame([(2, 7.5, 3.0), (9, 1.0, 1.0)], "book long, depth double, prose double")
    got = {r["book"]: r["report"] for r in C.reports(audit, averages).collect()}
    scores = {r["book"]: r for r in C.audit_scores(audit).collect()}
    want = {}
    for book in (1, 2, 5):
        lines = [f"# Quality of {book}", "", "| check | passed | of | failing sessions |", "|-|-|-|-|"]
        for c in sorted({c for b, _, c, _ in checks if b == book}):
            own = [(n, ok) for b, n, k, ok in checks if (b, k) == (book, c)]
            lines.append(f"| {c} | {sum(ok for _, ok in own)} | {len(own)} | {', '.join(str(n) for n, ok in own if not ok) or '-'} |")
        s = scores[book]
        lines += ["", f"Structure {s['structure_score']:.2f}, length {s['length_score']:.2f}, coherence {s['coherence_score']:.4f} of 10."]
        want[book] = "\n".join(lines + (["depth: 7.50", "prose: 3.00"] if book == 2 else [])) + "\n"
    assert got == want and C.reports(audit.limit(0), averages).count() == 0
