"""The model-backed operators with providers that fail, hesitate or leave things out, and the whole run."""

import json
import random
import uuid
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern import __main__ as cli
from lectern.operators import blocks as B
from lectern.operators import extraction as E
from lectern.operators import generation as N
from lectern.operators import model as M
from lectern.operators import progress as R
from lectern.plans import curriculum
from lectern.sources import pdf
from lectern.sources import store as S


class Failing(M.OfflineProvider):
    """Fails for prompts that hold the word Broken."""

    def generate(self, task, prompt):
        if "Broken" in prompt:
            raise OSError("out of reach")
        return super().generate(task, prompt)


class Sloppy(M.OfflineProvider):
    """Fenced, cut-off and prose answers."""

    def generate(self, task, prompt):
        out = super().generate(task, prompt)
        if task == "inventory":
            return {0: "```json\n" + out + "\n```", 1: "Here it is: " + out + " as asked", 2: out[: out.rindex('"explicit') - 12]}[len(prompt) % 3]
        return "I cannot do that" if task in ("merge", "adjust", "recluster") else out


CHUNKS = [(1, 1, "Memory and Latency and Memory"), (1, 2, "Broken Pipe"), (1, 3, "Cache and MEMORY as we saw Memory"), (2, 1, "Kernel"), (3, 1, "Broken again"), (4, 1, "")]


def chunk_rows(spark):
    return spark.createDataFrame(CHUNKS, "doc_id long, chunk_no int, chunk string")


def test_a_failed_chunk_keeps_its_row_and_the_merge_says_so(spark):
    found = {(r["doc_id"], r["chunk_no"]): r for r in E.extract(chunk_rows(spark), Failing).collect()}
    assert len(found) == len(CHUNKS) and found[1, 2]["error"] == "out of reach" and found[1, 2]["concepts"] == []
    assert [(c["name"], c["recurring"]) for c in found[1, 1]["concepts"]] == [("Memory", True), ("Latency", False)]
    assert found[1, 3]["explicit_dependencies"][0]["refers_to"] == "Memory" and found[1, 3]["implicit_assumptions"][0]["term"] == "MEMORY"
    merged = {r["doc_id"]: r for r in E.merge(E.extract(chunk_rows(spark), Failing), Failing).collect()}
    assert [c["name"] for c in merged[1]["concepts"]] == ["Memory", "Latency", "Cache"] and merged[1]["error"] == "chunk 2: out of reach"
    assert merged[3]["concepts"] == [] and merged[3]["error"] and merged[4]["error"] is None


def test_answers_are_read_tolerantly_and_no_answer_changes_nothing(spark):
    names = lambda make: {(r["doc_id"], r["chunk_no"]): [c["name"] for c in r["concepts"]] for r in E.extract(chunk_rows(spark), make).collect()}
    whole, read = names(M.OfflineProvider), names(Sloppy)
    for doc, no, text in CHUNKS:  # a cut-off answer loses what it was cut in
        assert read[doc, no] == whole[doc, no] or (len(text) % 3 == 2 and read[doc, no] == whole[doc, no][:-1])
    found = E.extract(chunk_rows(spark))
    merged = {r["doc_id"]: r for r in E.merge(found, Sloppy).collect()}
    assert Counter(c["name"] for c in merged[1]["concepts"]) == Counter({"Memory": 2, "Latency": 1, "Broken": 1, "Pipe": 1, "Cache": 1}) and merged[1]["error"] == "no JSON object"
    sized = {r["doc_id"]: r for r in E.adjust(E.merge(found), Sloppy).collect()}
    assert len(sized[2]["concepts"]) == 1 and sized[2]["error"] == "no JSON object"
    cut = E.merge(found, limits={k: 150 for k in E.LISTS}).filter("doc_id = 1").first()
    assert 0 < len(cut["concepts"]) < 5


def test_clusters_without_an_answer_and_of_another_count(spark):
    rows = [(b, f"{chr(65 + i % n)}x{i}", "", i) for b, n in (("five", 5), ("one", 1)) for i in range(20)]
    concepts = spark.createDataFrame(rows, "book string, concept string, description string, ord int")
    by = {r["book"]: r for r in E.cluster(concepts).collect()}
    assert [c["name"] for c in by["one"]["clusters"]] == [f"Part {k}" for k in range(5)] and all(c["name"].startswith("Theme") for c in by["five"]["clusters"])
    assert [len(r["clusters"]) for r in E.cluster(concepts, Sloppy).filter("book = 'one'").collect()] == [1]

    class Silent(M.OfflineProvider):
        def _cluster(self, prompt):
            return {"groups": []}

    assert {r["error"] for r in E.cluster(concepts, Silent).collect()} == {"no clusters in the answer"}

    class Forgetful(M.OfflineProvider):
        def _cluster(self, prompt):
            whole = super()._cluster(prompt)
            for c in whole["clusters"]:
                c["concepts"] = [*c["concepts"][:-1], "unheard of"]
            return whole

    full = E.members(E.cluster(concepts, Forgetful), concepts)
    assert sorted((r["book"], r["concept"]) for r in full.collect()) == sorted((b, c) for b, c, _, _ in rows)


def test_deep_extraction_fills_what_is_left_out_and_keeps_failures(spark):
    class Partial(Failing):
        def _deep(self, prompt):
            whole = super()._deep(prompt)
            whole["concepts"] = whole["concepts"][1:]
            whole["concepts"][0]["concept_weight"] = "enormous"
            return whole

    rows = [("b", "one", c, i) for i, c in enumerate(["Alpha", "Beta", "Gamma"])] + [("b", "Broken", "Delta", 3)]
    concepts = spark.createDataFrame(rows, "book string, cluster string, concept string, ord int").withColumn("description", F.lit("d"))
    members = concepts.select("book", "cluster", F.lit("").alias("about"), F.lit(0).alias("place"), "concept")
    answers = E.deep_answers(members, concepts.select("book", "concept", "description", "ord"), Partial)
    got = {r["concept"]: r for r in E.deep_extract(answers, members).collect()}
    assert set(got) == {"Alpha", "Beta", "Gamma"} and got["Alpha"]["placeholder"] and got["Alpha"]["weight"] == "medium" and got["Beta"]["weight"] == "medium"
    assert answers.filter("error IS NOT NULL").first()["cluster"] == "Broken"


@pytest.mark.parametrize(("said", "want"), [
    (["YES fine"], (True, "fine", 0, False)),
    (["no: vague", "YES now"], (True, "now", 1, False)),
    (["no 1", "no 2", "no 3"], (False, "3", 2, True)),
    ([OSError("a"), "YES late"], (True, "late", 0, False)),
    ([OSError("a"), "no 2", OSError("c")], (False, "Error: c", 1, True)),
])
def test_checks_are_asked_again_twice(said, want):
    answers, rewrites = iter(said), []

    class Provider:
        def generate(self, task, prompt):
            if task != "binary":
                rewrites.append(task)
                return "New last. Why now?"
            answer = next(answers)
            if isinstance(answer, Exception):
                raise answer
            return answer

    assert N.judged(Provider(), "TENSION", "One.\n\nTwo.", "", "") == want
    assert rewrites == ["rewrite_tension"] * want[2]


def test_a_revisit_must_be_specific():
    class Provider:
        def __init__(self, specific):
            self.specific = specific

        def generate(self, task, prompt):
            if prompt.startswith("specific?"):
                if self.specific is None:
                    raise OSError
                return self.specific
            return "YES it is there" if task == "binary" else "As we saw, again."

    text = "Open.\n\nAs we saw, the cache.\n\nEnd?"
    assert N.judged(Provider("NO too loose"), "REVISIT", text, "cache", "reason") == (False, "the connection is vague: too loose", 2, True)
    assert N.judged(Provider("YES"), "REVISIT", text, "cache", "reason")[0] and N.judged(Provider(None), "REVISIT", text, "cache", "reason")[0]
    assert N.judged(Provider("NO"), "REVISIT", text, "cache", "")[0]


def test_spliced_parts():
    class Provider:
        def generate(self, task, prompt):
            return "NEW"

    text = "first\n\nwe recall it\n\nmiddle\n\nlast"
    part = lambda check: N._spliced(Provider(), check, text, "", "").split("\n\n")
    assert part("TENSION")[-1] == part("ANCHOR")[0] == part("REVISIT")[1] == "NEW" and part("COHERENCE") == ["NEW"] and len(part("REVISIT")) == 4
    assert N._spliced(Provider(), "ANCHOR", "only one", "", "") == "only one"


def test_frames_and_endings():
    assert N.framed("A.\n \nB.\n\nWhy?") == ("A.\n\nB.", "Why?") and N.framed("abcd") == ("ab", "cd")
    assert N.to_resolve("It ends. What now? Well.") == "What now?" and N.to_resolve(" ".join(["w"] * 90)) == " ".join(["w"] * 80)
    assert N.cut_to("a b c", 3) == "a b c" and N.cut_to("w " * 50 + "done. x y z", 53) == "w " * 50 + "done." and N.cut_to("w " * 60, 10) == ("w " * 10).strip()


def test_reasons_of_weak_revisits(spark):
    best = spark.createDataFrame([("b", 3, "x", 0.2), ("b", 4, "y", 0.9)], "book string, number int, concept string, score double")
    scored = best.unionByName(spark.createDataFrame([("b", 3, "z", 0.1), ("b", 3, "v", 0.15), ("b", 3, "u", 0.05)], best.schema))
    sessions = spark.createDataFrame([("b", 3, ["p", "q"]), ("b", 4, ["r"])], "book string, number int, concepts array<string>")
    related = spark.createDataFrame([("b", "y", "r", "feeds")], "book string, concept string, other string, relation string")
    seen = []

    class Provider:
        def generate(self, task, prompt):
            assert json.loads(prompt)["candidates"] == ["x", "v", "z"]
            return json.dumps({"choice": "null", "reason": "r"} if seen else {"choice": "z", "reason": "because"})

    got = {r["number"]: (r["concept"], r["reason"]) for r in E.revisit_reasons(best, scored, sessions, related, Provider).collect()}
    assert got[3] == ("x", "because") and got[4][1].startswith("y feeds r")

    class Null:
        def generate(self, task, prompt):
            return '{"choice": null, "reason": "r"}'

    assert "shaped the constraints" in {r["number"]: r["reason"] for r in E.revisit_reasons(best, scored, sessions, related, Null).collect()}[3]


# --- the run --------------------------------------------------------------------------------------------------------------
def book_blocks(spark, n=60):
    words = [f"{a}{b}" for a in ("Cache", "Latency", "Kernel", "Memory", "Bandwidth", "Tensor", "Queue", "Router") for b in ("line", "fold", "path", "gate", "ring", "host", "mesh", "core")]
    rows = [(1, i // 6 + 1, i, f"{words[i % 64]} meets {words[(i * 7 + 3) % 64]} here; building on {words[(i * 5) % 64]} it works.", "Serif", 11.0, 0, 50.0, 20.0 + 13 * (i % 6), 290.0, 600.0) for i in range(n)]
    ddl = "doc_id long, page int, ord int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, page_width double"
    return spark.createDataFrame(rows, ddl).withColumns({"x": F.col("x0"), "y": F.col("y0")})


def test_the_whole_run(spark, tmp_path):
    store = S.StageStore(spark, f"file://{tmp_path}/run")
    assert curriculum.run(store, book_blocks(spark)) == list(S.STAGES)
    inventory = store.load("Pass1").first()
    assert 40 <= len(inventory["concepts"]) <= 250 and inventory["explicit_dependencies"] and inventory["error"] is None
    members, deep, graph, index, sessions = (store.load(s) for s in ("Cluster", "Pass2", "GraphBuild", "IndexGen", "SessionGen"))
    names = {c["name"] for c in inventory["concepts"]}
    assert {r["concept"] for r in members.collect()} == {r["concept"] for r in deep.collect()} == {r["concept"] for r in graph.collect()} == names
    assert 5 <= members.select("cluster").distinct().count() <= 8 and set(r["weight"] for r in deep.collect()) <= {"light", "medium", "heavy"}
    rows = graph.collect()
    assert sorted(r["position"] for r in rows) == list(range(1, len(rows) + 1)) and any(r["needs"] for r in rows) and any(r["related"] for r in rows)
    planned = index.orderBy("number").collect()
    assert [r["number"] for r in planned] == list(range(1, len(planned) + 1))
    assert sum(r["concept_count"] for r in planned) == len(rows) and sorted(c["name"] for r in planned for c in r["concepts"]) == sorted(names)
    assert all(r["title"] for r in planned) and all(r["revisit"] is None for r in planned[:2]) and all(r["revisit"]["reason"] for r in planned[2:] if r["revisit"])
    again = [r["revisit"]["name"] for r in planned if r["revisit"]]
    assert again and len(set(again)) == len(again)
    done = sessions.orderBy("number").collect()
    assert len(done) == len(planned) and all(len(r["evaluation"]) == 6 and r["content"] for r in done)
    assert [r["needs_review"] for r in done] == [any(not c["passed"] for c in r["evaluation"]) for r in done]
    assert store.load("Complete").first()["n_sessions"] == len(done)


def test_a_run_stops_without_clusters_and_goes_on_later(spark, tmp_path):
    class Silent(M.OfflineProvider):
        def _cluster(self, prompt):
            return {}

    store = S.StageStore(spark, f"file://{tmp_path}/run")
    with pytest.raises(S.PipelineError, match="no clusters"):
        curriculum.run(store, book_blocks(spark), make=Silent)
    assert store.current() == "Pass1"
    assert curriculum.run(store, book_blocks(spark), approve=lambda index: False)[-1] == "IndexGen"


# --- stores ---------------------------------------------------------------------------------------------------------------
def test_a_broken_write_does_not_count(spark, tmp_path):
    store = S.StageStore(spark, f"file://{tmp_path}/s")
    store.save("Ingest", spark.range(3))
    broken = spark.range(4).select(F.when(F.col("id") > 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.save("Pass1", broken)
    with pytest.raises(Exception, match="no"):
        store.save("Ingest", broken)
    assert not store.is_complete("Pass1") and store.load("Ingest").count() == 3 and store.current() == "Ingest"
    store.save("Ingest", store.load("Ingest").limit(1))
    assert store.load("Ingest").count() == 1


def test_exports_of_other_shapes(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps({"timestamp": "t", "sessions": [{"number": 1, "content": "a"}], "progress": {}}, indent=1))
    (tmp_path / "map.json").write_text(json.dumps({"sessions": {"01": {"title": "A", "content": "a"}, "02": {"title": "B", "content": "b"}}, "progress": {"01": {"bookmark": 3}}}))
    (tmp_path / "none.json").write_text("{}\n")
    assert S.read_export(spark, f"file://{tmp_path}/list.json").first()["content"] == "a"
    assert sorted((r["number"], r["title"]) for r in S.read_export(spark, f"file://{tmp_path}/map.json").collect()) == [(1, "A"), (2, "B")]
    with pytest.raises(S.PipelineError):
        S.read_export(spark, f"file://{tmp_path}/none.json")


def test_books_by_furthest_stage_and_name(spark):
    rows = [("b", "x", "SessionGen"), ("b", None, "Complete"), ("a", "x", "IndexGen"), ("a", "x", "Cluster"), ("", "x", "Complete")]
    got = [tuple(r) for r in S.list_books(spark.createDataFrame(rows, "book string, content string, stage string")).collect()]
    assert got == [("", 1, "Complete"), ("a", 2, "IndexGen"), ("b", 1, "Complete")]


def test_quota_file(tmp_path):
    quota = S.QuotaFile(str(tmp_path / "q.json"), limit=100)
    monday, tuesday = date(2026, 1, 5), date(2026, 1, 6)
    quota.record("a", 90, monday)
    quota.record("b", 50, monday)
    assert quota.pick(["a", "b"], 0, 10, monday) == 0 and quota.pick(["a", "b"], 0, 11, monday) == 1 and quota.pick(["a", "b"], 1, 60, tuesday) == 1
    with pytest.raises(S.QuotaExhausted):
        quota.pick(["a", "b"], 0, 60, monday)
    quota.record("a", 5, tuesday)
    assert quota.used("a", tuesday) == 5 and quota.used("a", monday) == 0
    (tmp_path / "q.json").write_text("{broken")
    assert quota.used("a", tuesday) == 0


def test_calls_go_to_the_next_key_and_end_with_the_quota(tmp_path):
    asked_by = []

    class Keyed:
        def __init__(self, key):
            self.key = key

        def generate(self, task, prompt):
            if task == "broken":
                raise OSError("no line")
            asked_by.append(self.key)
            return "x" * 40

    quota, day = S.QuotaFile(str(tmp_path / "q.json"), limit=100), date(2026, 1, 5)
    make = lambda: M.Metered(Keyed, ["a", "b"], quota, 50, lambda: day)
    one = make()
    with pytest.raises(OSError):
        one.generate("broken", "p" * 40)
    assert quota.used("a", day) == 0  # given back
    for _ in range(6):
        one.generate("section", "p" * 40)  # 60 are reserved, 20 used
    assert asked_by == ["a", "a", "a", "b", "b", "b"] and (quota.used("a", day), quota.used("b", day)) == (60, 60)
    with pytest.raises(S.QuotaExhausted):
        make().generate("section", "p" * 40)
    assert make().quota.pick(["a", "b"], 0, 40, day) == 0
    day = date(2026, 1, 6)
    assert make().generate("section", "p") == "x" * 40
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: quota.record("c", 1, day), range(40)))
    assert quota.used("c", day) == 40


def test_posts_and_status(spark):
    bodies = ['{"session_id": "s", "bookmark_word_index": 0}', '{"session_id": "s", "updates": {"completed": true}}', '{"session_id": "t", "bookmark": 7}', '{"session_id": "t", "bookmark_word_index": null}', '{"completed": true}']
    posts = spark.createDataFrame(list(enumerate(bodies)), "ord long, body string").withColumn("ts", F.timestamp_seconds("ord"))
    status = {r["session_id"]: (r["status"], r["bookmark"]) for r in R.feed_status(R.latest(R.progress_events(posts))).collect()}
    assert status == {"s": ("complete", None)}
    events, refused = R.bookmark_events(spark.createDataFrame([(1, '{"session_id": "s", "word_index": 0}'), (2, '{"session_id": "s"}'), (3, '{"word_index": 4}')], "ord long, body string").withColumn("ts", F.timestamp_seconds("ord")))
    assert [(r["session_id"], r["value"]) for r in events.collect()] == [("s", "0")] and refused.count() == 2


# --- PDF --------------------------------------------------------------------------------------------------------------------
def make_pdf(contents, packed=True, objects_in_stream=False):
    """A PDF of one page for each content stream."""
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Times-Bold /FirstChar 32 /Widths [" + b"600 " * 95 + b"] >>", 4: b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /DescendantFonts [5 0 R] /ToUnicode 6 0 R >>", 5: b"<< /DW 500 >>"}
    streams = {6: (b"", b"2 beginbfchar <0001> <0047> <0002> <00F600DF> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange")}
    kids = []
    for i, content in enumerate(contents):
        page = 10 + 2 * i
        kids.append(f"{page} 0 R")
        bodies[page] = f"<< /Type /Page /Parent 2 0 R /Contents {page + 1} 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>".encode()
        streams[page + 1] = (b"/Filter /FlateDecode ", zlib.compress(content)) if packed else (b"", content)
    bodies[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /MediaBox [0 0 600 800] >>".encode()
    if objects_in_stream:
        heads, body = [], b""
        for number, text in bodies.items():
            heads.append(f"{number} {len(body)}")
            body += text + b" "
        head = " ".join(heads).encode() + b" "
        streams[99] = (f"/Type /ObjStm /N {len(heads)} /First {len(head)} /Filter /FlateDecode ".encode(), zlib.compress(head + body))
        bodies = {}
    out = b"%PDF-1.7\n"
    for number, text in bodies.items():
        out += f"{number} 0 obj\n".encode() + text + b"\nendobj\n"
    for number, (entries, raw) in streams.items():
        out += f"{number} 0 obj\n<< ".encode() + entries + f"/Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>"


PAGE = rb"""BT /F1 18 Tf 50 750 Td (A \(bold\) head) Tj ET
BT /F1 10 Tf 1 0 0 1 50 700 Tm [(Two) -600 (words)] TJ 0 -12 Td (next\040line) Tj ET
q 2 0 0 2 100 100 cm BT /F2 6 Tf 0 0 Td <000100020010> Tj ET Q"""


@pytest.mark.parametrize(("packed", "inside"), [(False, False), (True, False), (True, True)])
def test_pdf_blocks(spark, tmp_path, packed, inside):
    (tmp_path / "a.pdf").write_bytes(make_pdf([PAGE, b"BT /F1 9 Tf 20 20 Td (Second page) Tj ET"], packed, inside))
    rows = S.read_pdf(spark, f"file://{tmp_path}/a.pdf")
    found = B.from_spans(rows).orderBy("page", "ord").collect()
    assert [(r["page"], r["text"]) for r in found] == [(1, "A (bold) head"), (1, "Two words\nnext line"), (1, "Gößa"), (2, "Second page")]
    head, body, wide, _ = found
    assert (head["size"], head["font"], head["flags"], head["x0"], head["y0"], head["page_width"]) == (18.0, "Times-Bold", 16, 50.0, 50.0, 600.0)
    assert (body["y"], wide["size"], wide["x0"], wide["y0"]) == (100.0, 12.0, 100.0, 700.0)
    assert head["x1"] == pytest.approx(50 + 13 * 0.6 * 18)
    assert B.ingest(B.from_spans(rows)).first()["text"].startswith("HEADER: A (bold) head")


def test_pdf_files_that_are_refused():
    with pytest.raises(ValueError, match="not a PDF"):
        list(pdf.blocks("x", b"hello"))
    with pytest.raises(ValueError, match="encrypted"):
        list(pdf.blocks("x", make_pdf([PAGE]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")))
    assert list(pdf.blocks("x", b"%PDF-1.4\n")) == []


def test_command_line(spark, tmp_path, capsys):
    pages = [b"BT /F1 10 Tf 50 700 Td 14 TL " + b" ".join(f"(Word{chr(97 + i)}{chr(97 + j)} explains Item{chr(97 + j)}{chr(97 + i)} well.) Tj T*".encode() for j in range(12)) + b" ET" for i in range(6)]
    (tmp_path / "book.pdf").write_bytes(make_pdf(pages))
    (tmp_path / "posts.json").write_text('{"session_id": "01", "bookmark_word_index": 5}\n{"session_id": "02", "completed": true}\n')
    store = f"file://{tmp_path}/store"
    cli.main(["--store", store, "--run", str(tmp_path / "book.pdf"), "--posts", f"file://{tmp_path}/posts.json", "--export", f"file://{tmp_path}/out"])
    said = capsys.readouterr().out
    assert "SessionGen" in said
    out = next(line for line in said.split("\n") if "curriculum_export" in line)
    assert sorted((r["session_id"], r["key"], r["value"]) for r in S.read_progress(spark, out).collect()) == [("01", "bookmark", "5"), ("02", "completed", "true")]
    cli.main(["--store", f"{store}2", "--import", out])
    assert S.StageStore(spark, f"{store}2").load("SessionGen").count() == S.StageStore(spark, store).load("SessionGen").count() > 0


# --- sessions in fronts -----------------------------------------------------------------------------------------------------
SESSION_DDL = "book string, number int, title string, concepts array<struct<name: string, description: string, weight: string>>, revisit struct<name: string, reason: string>"


def session_plan(spark):
    rows = [(b, n, f"{b}{n}", [(f"{b}{n}{c}", f"about {c}", "light") for c in "xyz"[: n % 3 + 1]], (f"{b}1x", f"why {n}") if n > 2 else None) for b, most in (("a", 5), ("b", 3), ("c", 1)) for n in range(2, most + 2)]
    return spark.createDataFrame(rows, SESSION_DDL)


class Counting(M.OfflineProvider):
    """Notes each prompt in a folder, and has no quota beyond ``limit`` prompts (if a file says so)."""

    folder = ""

    def generate(self, task, prompt):
        limit = Path(self.folder) / "limit"
        if limit.exists() and len(list(Path(self.folder).glob("*.prompt"))) >= int(limit.read_text()):
            raise S.QuotaExhausted("nothing left")
        (Path(self.folder) / f"{uuid.uuid4().hex}.prompt").write_text(f"{task}\n{prompt}")
        if "b3" in prompt and (Path(self.folder) / "broken").exists():
            raise OSError("out of reach")
        return super().generate(task, prompt)


def counting(folder):
    return type("Counted", (Counting,), {"folder": str(folder)})


def asked(folder):
    return sorted(p.read_text() for p in Path(folder).glob("*.prompt"))


def no_context(spark, plan):
    return N.section_context(plan, spark.createDataFrame([], "book string, concept string"), spark.createDataFrame([], "book string, src string, dst string"))


@pytest.mark.parametrize("limit", [1, 23])
def test_sessions_go_on_where_the_quota_ended(spark, tmp_path, limit):
    plan, context = session_plan(spark), no_context(spark, session_plan(spark))
    for name in ("whole", "dying"):
        (tmp_path / name).mkdir()
    keyed = lambda name: S.KeyedStore(spark, f"file://{tmp_path}/{name}/store", ("book", "number"))
    want = N.generate_sessions(plan, context, keyed("whole"), counting(tmp_path / "whole"))
    runs = 0
    while True:
        runs += 1
        (tmp_path / "dying" / "limit").write_text(str(limit * runs if limit > 1 else 7 * runs))
        try:
            got = N.generate_sessions(plan, context, keyed("dying"), counting(tmp_path / "dying"))
            break
        except S.QuotaExhausted as e:
            assert "nothing left" in str(e) and runs < 30
    assert runs > 1 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 9
    assert asked(tmp_path / "dying") == asked(tmp_path / "whole")  # nothing twice, nothing left out


def test_a_failed_session_is_tried_again_and_others_are_not(spark, tmp_path):
    plan, context, store = session_plan(spark), no_context(spark, session_plan(spark)), S.KeyedStore(spark, f"file://{tmp_path}/store", ("book", "number"))
    (tmp_path / "broken").write_text("")
    first = {(r["book"], r["number"]): r for r in N.generate_sessions(plan, context, store, counting(tmp_path)).collect()}
    assert first["b", 3]["content"] is None and first["b", 3]["error"] == "out of reach" and first["b", 4]["content"] and first["a", 4]["content"]
    before = len(asked(tmp_path))
    (tmp_path / "broken").unlink()
    second = {(r["book"], r["number"]): r for r in N.generate_sessions(plan, context, store, counting(tmp_path)).collect()}
    assert second["b", 3]["content"] and {k: r for k, r in second.items() if k != ("b", 3)} == {k: r for k, r in first.items() if k != ("b", 3)}
    assert 0 < len(asked(tmp_path)) - before <= 8
    (tmp_path / "limit").write_text("0")  # all is written: a further run asks nothing
    assert N.generate_sessions(plan, context, store, counting(tmp_path)).count() == 9


def test_what_a_section_is_told(spark, tmp_path):
    plan = spark.createDataFrame([("a", 1, "One", [("cache", "from the index", "light"), ("bus", "", "light"), ("odd", "only planned", "heavy")], ("port", "since it matters"))], SESSION_DDL)
    ddl = "book string, concept string, description string, weight string, passage string, passages array<string>, anchor string, assumed array<string>, contrasts array<string>, enrich boolean, about string"
    concepts = [
        ("a", "cache", "keeps near", "heavy", "p" * 900, ["s1" * 200, "s2", "s3"], "near is fast", ["ram", "cpu", "disk", "net", "tape"], ["buffer", "store", "pool", "heap"], True, "Memory"),
        ("a", "port", "a door", "light", "q" * 900, None, None, None, None, None, None),
        ("a", "base", "the ground", "light", None, None, None, None, None, None, None),
        ("a", "bare", "", "light", None, None, None, None, None, None, None),
        ("z", "cache", "another book", "light", None, None, None, None, None, None, None),
    ]
    edges = spark.createDataFrame([("a", "base", "cache"), ("a", "bare", "cache"), ("a", "port", "cache"), ("z", "x", "cache")], "book string, src string, dst string")
    known = spark.createDataFrame(concepts, ddl)
    row = N.section_context(plan, known, edges).first().asDict(True)
    cache, bus, odd = row["sections"]
    assert cache == {"place": 0, "name": "cache", "description": "keeps near", "weight": "heavy", "passage": "p" * 400, "passages": ["s1" * 125, "s2"], "anchor": "near is fast", "assumed": ["ram", "cpu", "disk", "net"], "contrasts": ["buffer", "store", "pool"], "enrich": True, "needs": ["bare", "the ground"], "about": "Memory"}
    assert (bus["description"], bus["weight"], bus["needs"], bus["enrich"]) == ("", "light", [], False) and odd["description"] == "only planned" and odd["weight"] == "heavy"
    assert row["back"] == {"name": "port", "reason": "since it matters", "description": "a door", "passage": "q" * 300}
    assert N.section_context(plan.limit(0), known, edges).count() == 0
    assert N.section_context(plan, known.limit(0), edges.limit(0)).first()["sections"][0]["description"] == "from the index"

    N.generate_in_order(plan, counting(tmp_path), known, edges).collect()
    sections = [p for p in asked(tmp_path) if p.startswith("section\n") and "More on" not in p]
    first = next(p for p in sections if "cache in One." in p)
    for line in ("Description: keeps near", "Weight: heavy", "Domain: Memory", "The author's insight: near is fast", "Passage: " + "p" * 400, "Supporting passage: s2", "Builds on: bare, the ground", "Already known: ram, cpu, disk, net", "Not to be taken for: buffer, store, pool", "Add present-day examples.", "Next comes bus."):
        assert line in first.split("\n")
    second = next(p for p in sections if "bus in One." in p)
    assert all(x in second.split("\n") for x in ("Return to port.", "since it matters", "a door", "q" * 300, "Next comes odd."))


def test_the_run_ends_with_the_quota_and_goes_on(spark, tmp_path):
    store = S.StageStore(spark, f"file://{tmp_path}/run")
    make = counting(tmp_path)
    assert curriculum.run(store, book_blocks(spark), approve=lambda index: False, make=make)[-1] == "IndexGen"
    (tmp_path / "limit").write_text(str(len(asked(tmp_path)) + 20))
    with pytest.raises(S.QuotaExhausted):
        curriculum.run(store, book_blocks(spark), make=make)
    assert store.current() == "AwaitApproval" and 0 < store.progress()["sessions"] < store.progress()["total"]
    begun = {r["number"]: r["content"] for r in store.results().read().collect() if r["content"]}
    (tmp_path / "limit").unlink()
    assert curriculum.run(store, book_blocks(spark), make=make) == ["SessionGen", "Complete"]
    prompts = [p for p in asked(tmp_path) if p.startswith("question\n")]
    assert len(set(prompts)) == len(prompts) and begun
    store.reset("SessionGen")
    assert store.results().read() is None

    class Spent(M.OfflineProvider):
        def generate(self, task, prompt):
            raise S.QuotaExhausted("none")

    with pytest.raises(S.QuotaExhausted, match="Pass1"):
        curriculum.run(S.StageStore(spark, f"file://{tmp_path}/other"), book_blocks(spark), make=Spent)


# --- several writers ------------------------------------------------------------------------------------------------------
def test_stages_of_two_writers_both_count(spark, tmp_path):
    stores = [S.StageStore(spark, f"file://{tmp_path}/s") for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: stores[i].save(f"Extra{i}", spark.range(i + 1)), range(6)))
    assert [stores[0].load(f"Extra{i}").count() for i in range(6)] == list(range(1, 7))
    log = S.StateLog(spark, f"file://{tmp_path}/log", {"n": 0})
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: [log.change(lambda s: {"n": s["n"] + 1}) for _ in range(12)], range(4)))
    assert log.last() == (48, {"n": 48}) and len(log._numbers()) <= log.KEPT + 2


def test_a_writer_that_is_far_behind_starts_anew(spark, tmp_path):
    log = S.StateLog(spark, f"file://{tmp_path}/log", {"n": []})
    calls = []

    def late(state):
        calls.append(list(state["n"]))
        if len(calls) == 1:
            for i in range(40):
                log.change(lambda s, i=i: {"n": [*s["n"], i]})
        return {"n": [*state["n"], "late"]}

    log.change(lambda s: {"n": ["first"]})
    log.change(late)
    assert log.last()[1]["n"] == ["first", *range(40), "late"]


def test_upserts_write_their_rows_alone(spark, tmp_path):
    store = S.KeyedStore(spark, f"file://{tmp_path}/k", ("book", "number"))
    rows = lambda *r: spark.createDataFrame(list(r), "book string, number int, content string")
    got = lambda: sorted(map(tuple, store.read().collect()), key=str)
    assert store.read() is None
    store.delete(rows(("a", 1, "")))
    store.upsert(rows(*[("a", i, f"v{i}") for i in range(200)]))
    store.upsert(rows(("a", 3, "new"), ("b", 1, None), (None, None, "null key")))
    sizes = {p: spark.read.parquet(f"{store.base}/{p}").count() for p in store._log.last()[1]["deltas"]}
    assert sorted(sizes.values()) == [3, 200]
    store.delete(rows(("a", 0, "")).unionAll(rows(("zz", 9, ""))))
    want = sorted([("a", i, "new" if i == 3 else f"v{i}") for i in range(1, 200)] + [("b", 1, None), (None, None, "null key")], key=str)
    assert got() == want
    store.compact()
    assert got() == want and len(store._log.last()[1]["deltas"]) == 1
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.upsert(rows(("c", i, "x"))), range(20)))
    assert got() == sorted([*want, *[("c", i, "x") for i in range(20)]], key=str) and len(store._log.last()[1]["deltas"]) <= store.COMPACT_AT + 1
    store.clear()
    assert store.read() is None


def test_fenced_answers_count(spark):
    class Fenced(M.OfflineProvider):
        def generate(self, task, prompt):
            return "Here:\n```json\n" + super().generate(task, prompt) + "\n```"

    index = spark.createDataFrame([("b", 1, "A"), ("b", 2, "B")], "book string, number int, title string")

    class Renaming(Fenced):
        def _revise(self, prompt):
            return json.dumps([{"number": 1, "title": "New [1]"}, {"number": 2, "title": "B"}])

    assert sorted(map(tuple, N.revise_index(index, "rename", Renaming).collect())) == [("b", 1, "New [1]"), ("b", 2, "B")]
    names = [f"Concept{i}" for i in range(60)] + [f"Word{i}" for i in range(60)] + ["Concept7s"]
    rows = spark.createDataFrame([("b", n, "d", i) for i, n in enumerate(names)], "book string, concept string, description string, ord int")
    assert N.infer_edges(rows, Fenced).count() == N.infer_edges(rows).count() > 0
    left = {r["concept"] for r in N.drop_duplicates(rows, Fenced).collect()}
    assert left == {r["concept"] for r in N.drop_duplicates(rows).collect()} and len(left) < len(names)


def folded_keys(rows, n_keys, limit):
    """Plain fold of (ts, ord, tokens) by day."""
    out, days = [], {}
    for at, number, tokens in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0)):
        day = at.date() if at else None
        used, now = days.setdefault(day, ([0] * n_keys, [0]))
        key = None if tokens is None else next((k for k in ((now[0] + i) % n_keys for i in range(n_keys)) if used[k] + tokens <= limit), None)
        if key is not None:
            used[key] += tokens
            now[0] = key
        out.append((str(day), number, str(tokens), str(key)))
    return sorted(out)


@pytest.mark.parametrize(("n_keys", "limit", "least"), [(3, 3000, 0), (1, 500, 0), (4, 60, -20), (2, 10**17, 0), (2, 0, 0), (3, -1, -5)])
def test_keys_are_assigned_as_by_a_fold(spark, n_keys, limit, least):
    rng = random.Random(n_keys)
    tokens = lambda: rng.choice([None, 0, 0, limit + 1, max(least, limit), rng.randint(least, 40), rng.randint(0, 700)])
    days = [None, *(datetime(2026, 1, d) for d in range(1, 6))]
    rows = [(day and day + timedelta(seconds=rng.randint(0, 400)), i // 2, tokens()) for i, day in enumerate(rng.choices(days, k=3000))]
    got = R.assign_keys(spark.createDataFrame(rows, "ts timestamp, ord long, tokens long"), n_keys, limit)
    assert got.columns == ["day", "ord", "tokens", "key"]
    assert sorted((str(r["day"]), r["ord"], str(r["tokens"]), str(r["key"])) for r in got.collect()) == folded_keys(rows, n_keys, limit)


def test_requests_folded_in_order_do_not_grow_with_the_log(spark, monkeypatch):
    held = {}
    keep = R.kept
    monkeypatch.setattr(R, "kept", lambda df, label: held.setdefault(label, keep(df, label)))
    n = 60_000  # in one day, every other of equal tokens
    log = spark.range(n).select(F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts"), F.col("id").alias("ord"), F.expr("if(id % 2 = 0, 50, id % 700)").cast("long").alias("tokens"))
    got = R.assign_keys(log, 3, 3000).collect()
    at = datetime(2026, 1, 1)
    assert sorted((str(r["day"]), r["ord"], str(r["tokens"]), str(r["key"])) for r in got) == folded_keys([(at + timedelta(seconds=i), i, 50 if i % 2 == 0 else i % 700) for i in range(n)], 3, 3000)
    assert held["assigned-requests"].count() <= 3 * sum(3000 // t for t in {50, *range(1, 700, 2)}) < n
    assert held["assigned-requests"].filter("tokens = 50").count() == 3 * 3000 // 50


def test_a_title_with_a_name_of_stop_words_is_on_its_concepts(spark):
    rows = [(1, 1, ["When", "Iner"]), (1, 2, ["Iner", "When"]), (1, 3, ["What"]), (2, 1, ["When", "Iner"])]
    got = N.with_titles(spark.createDataFrame(rows, "book int, number int, concepts array<string>")).collect()
    assert {(r["book"], r["number"]): r["title"] for r in got} == {(1, 1): "Title and When", (1, 2): "Title and Iner", (1, 3): "Title and What", (2, 1): "Title and When"}
    got = N.with_titles(spark.createDataFrame(rows[:3], "book int, number int, concepts array<string>"), OffTopic).collect()
    assert {r["number"]: r["title"] for r in got} == {1: "Asked again for When, Iner", 2: "Asked again for Iner, When", 3: "What it ends"}


class OffTopic:
    """Titles whose only words in common with other concepts are stop words, but for What."""

    def generate(self, task, prompt):
        again = prompt.removeprefix("Another title, closer to ")
        return json.dumps({"title": "What it ends" if again == prompt else f"Asked again for {again}"})
