"""Quality checks of sessions, the structural audit and its scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

# Marker phrases of the two revisit checks, bounds of lengths, weights of the score.
REVISIT_ONLINE = [
    "earlier", "recall", "back in session", "revisit", "building on", "as we saw", "we discussed", "introduced earlier", "remember when",
    "comes back", "reappears", "return to", "first saw",
]
REVISIT_OFFLINE = [*REVISIT_ONLINE, "takes on new meaning", "showed up", "new light", "came up", "surfaced earlier", "resurfaces", "back into focus",
    "new depth", "becomes more than", "takes on new", "evolves beyond", "new significance", "here,"]
SHORTEST, TARGET, LONGEST = 1500, 1800, 2600
SCORE_WEIGHTS = {"tension": 0.30, "anchor": 0.25, "revisit": 0.25, "length": 0.20}


def has_marker(x: Column, markers: list[str]) -> Column:
    """Whether one of the phrases stands in the text, without case. A phrase that holds another one adds nothing; plain searches beat one pattern of all phrases."""
    low = F.lower(x)
    return reduce(lambda a, b: a | b, [low.contains(m) for m in markers if not any(o != m and o in m for o in markers)])


def tension_structural(x: Column) -> Column:
    """A sentence of five words or more with a question mark in the last 300 characters before the card."""
    bare = F.regexp_replace(T.without_card(x), r"(?U)\s+$", "")
    tail = F.right(F.when(bare == "", x).otherwise(bare), F.lit(300))
    return F.coalesce(F.exists(T.sentences(tail), lambda s: s.contains("?") & (T.word_count(s) >= 5)), F.lit(False))


def anchor_structural(x: Column, number: Column) -> Column:
    """The first session passes; others need a first paragraph of at most 250 words."""
    parts = T.paragraphs(x)
    return (number == 1) | ((F.size(parts) > 0) & (T.word_count(F.try_element_at(parts, F.lit(1))) <= 250))


def revisit_structural(x: Column, number: Column) -> Column:
    return (number <= 3) | F.coalesce(has_marker(x, REVISIT_OFFLINE), F.lit(False))


def length_structural(x: Column) -> Column:
    return T.word_count(F.coalesce(x, F.lit(""))).between(SHORTEST, LONGEST)


def structural_checks(sessions: DataFrame) -> DataFrame:
    """Long rows (book, number, check, passed) of the four offline checks; sessions have book, number and content."""
    text = F.coalesce("content", F.lit(""))
    wide = sessions.select(
        "book", "number", tension_structural(text).alias("tension"), anchor_structural(text, F.col("number")).alias("anchor"),
        revisit_structural(text, F.col("number")).alias("revisit"), length_structural(text).alias("length"),
    )
    return wide.unpivot(["book", "number"], list(SCORE_WEIGHTS), "check", "passed")


def length_failures(sessions: DataFrame) -> DataFrame:
    """(book, short, long): sessions of too few and of too many words, with their words, in order of number."""
    rows = sessions.select("book", "number", T.word_count(F.coalesce("content", F.lit(""))).alias("words"))
    at = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("number", "words"))))
    return rows.groupBy("book").agg(at(F.col("words") < SHORTEST).alias("short"), at(F.col("words") > LONGEST).alias("long"))


def structural_audit(checks: DataFrame) -> DataFrame:
    """(book, check, n_pass, n_total, failed): failing numbers in order."""
    return checks.groupBy("book", "check").agg(
        F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n_total"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("number")))).alias("failed")
    )


def audit_scores(audit: DataFrame) -> DataFrame:
    """(book, structure_score, length_score, coherence_score) out of 10."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in SCORE_WEIGHTS.items() for x in kv]), F.col("check"))
    share = F.col("n_pass") / F.col("n_total") * 10
    out = audit.groupBy("book").agg(F.round(F.sum(share * weight), 2).alias("structure_score"), F.round(F.max(F.when(F.col("check") == "length", share)), 2).alias("length_score"))
    return out.withColumn("coherence_score", F.round(F.least(F.lit(10.0), F.col("structure_score") * 1.1), 4))


def overall(quality: list[Column], structure: Column, coherence: Column, length: Column) -> Column:
    return F.round((sum(quality[1:], quality[0]) + structure + coherence + length) / 6, 1)


def length_verdict(x: Column) -> Column:
    """Struct of passed, word_count and reason of the online length check."""
    n = T.word_count(x)
    out = lambda ok, why: F.struct(F.lit(ok).alias("passed"), n.alias("word_count"), F.lit(why).alias("reason"))
    return F.when(n < SHORTEST, out(False, "short")).when(n > LONGEST, out(False, "long")).when(T.ends_openly(x), out(False, "cut")).when(n < TARGET, out(True, "below target")).otherwise(out(True, ""))


def length_fallback(x: Column) -> Column:
    return T.word_count(x).between(TARGET, LONGEST)


def tension_gates(sessions: DataFrame) -> DataFrame:
    """``sessions`` with question and gate, column by column as each step is used several times.

    question: as ``text.tension_question``, of the content before the card. gate: what fails before a model
    is asked ("no question", "short question" below five words, "late question" with more than 20 words
    after it), else empty.
    """
    out = sessions.withColumn("tail_", T.last_words(T.without_card(F.col("content")), 300))
    out = out.withColumn("mark_", T.rfind(F.col("tail_"), "?")).withColumn("before_", F.substr("tail_", F.lit(1), F.col("mark_")))
    out = out.withColumn("start_", F.greatest(*[T.rfind(F.col("before_"), m) for m in (". ", "! ", "? ")]))
    at = F.when(F.col("start_") >= 0, F.col("start_") + 2).otherwise(0)
    asked = F.when(F.col("mark_") >= 0, T.strip(F.substr("tail_", at + 1, F.col("mark_") + 1 - at)))
    after = T.word_count(F.substr("tail_", F.col("mark_") + 2))
    gate = F.when(F.col("mark_") < 0, "no question").when(T.word_count(F.col("question")) < 5, "short question").when(after > 20, "late question").otherwise("")
    return out.withColumn("question", asked).withColumn("gate", gate).drop("tail_", "mark_", "before_", "start_")


def overlap(ending: Column, opening: Column, n: int = 30) -> Column:
    """Share of distinct words that the last n of ``ending`` and the first n of ``opening`` have in common."""
    a, b = F.slice(T.words(F.lower(ending)), -n, n), F.slice(T.words(F.lower(opening)), 1, n)
    a = F.when(T.word_count(ending) < n, T.words(F.lower(ending))).otherwise(a)
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.lit(n), F.size(a), F.size(b)), F.lit(0))


def copied_opening(ending: Column, opening: Column, share: float = 0.65) -> Column:
    tail, head = F.right(ending, F.lit(300)), F.substring(opening, 1, 300)
    return F.coalesce((overlap(tail, head) > share) & (T.word_count(tail) > 10) & (T.word_count(head) > 10), F.lit(False))


def found_markers(x: Column, markers: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(x), m))


def revisit_paragraph(x: Column, concept: Column) -> Column:
    """The first paragraph with a marker of the text and the concept's first ten letters, else the one with most markers."""
    parts, found = T.paragraphs(x), found_markers(x, REVISIT_ONLINE)
    count = lambda p: F.size(F.filter(found, lambda m: F.contains(F.lower(p), m)))
    named = F.filter(parts, lambda p: (count(p) > 0) & F.contains(F.lower(p), F.substring(F.lower(concept), 1, 10)))
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-count(p)).alias("n"), i.alias("i"), p.alias("p"))))
    return F.when(F.size(found) > 0, F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(ranked, F.lit(1))["p"], F.lit("")))


def transition_pairs(sessions: DataFrame) -> DataFrame:
    """(…, pair, from_concept, to_concept, tail, head) for neighbouring concepts of sessions with three paragraphs or more."""
    parts = T.paragraphs(F.col("content"))
    rows = sessions.withColumn("parts", parts).filter((F.size("parts") >= 3) & (F.size("concepts") >= 2))
    rows = rows.withColumn("pair", F.explode(F.sequence(F.lit(0), F.size("concepts") - 2)))
    n = F.size("parts")
    at = F.greatest(F.lit(1), F.least((n * (F.col("pair") + 1) / F.size("concepts")).cast("int"), n - 2))
    tail, head = F.element_at("parts", at), F.element_at("parts", at + 1)
    return rows.select(
        "book", "number", "pair", F.get("concepts", F.col("pair")).alias("from_concept"), F.get("concepts", F.col("pair") + 1).alias("to_concept"),
        T.last_words(tail, 80).alias("tail"), F.when(T.word_count(head) > 80, T.first_words(head, 80)).otherwise(head).alias("head"),
    )


def needs_review(checks: DataFrame) -> DataFrame:
    return checks.groupBy("book", "number").agg(F.count_if("passed").alias("n_passed"), F.bool_or(~F.col("passed")).alias("needs_review"))


def stratified_sample(keys: DataFrame, total: int = 20, seed: int = 42) -> DataFrame:
    """(book, number, third, taken_by): total // 3 of each third of a book by hash, then topped up from the rest.

    The remainder of the thirds goes to the last; a book of fewer than ``total`` sessions is taken whole.
    """
    mix = F.md5(F.concat_ws(":", F.col("number").cast("string"), F.lit(str(seed))))
    own = W.partitionBy("book")
    rows = keys.withColumn("i", F.row_number().over(own.orderBy("number")) - 1).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("mix", mix)
    third = F.when(F.col("i") < F.floor(F.col("n") / 3), 1).when(F.col("i") < F.floor(2 * F.col("n") / 3), 2).otherwise(3)
    rows = rows.withColumn("third", third).withColumn("rank", F.row_number().over(W.partitionBy("book", "third").orderBy("mix", "number")))
    first = F.col("rank") <= total // 3
    rows = rows.withColumn("first", first).withColumn("pick", F.row_number().over(own.orderBy(F.desc("first"), "mix", "number")))
    return rows.filter(F.col("pick") <= total).select("book", "number", "third", F.when(F.col("first"), "third").otherwise("top-up").alias("taken_by"))


def dimension_averages(answers: DataFrame, dimensions: list[str], per: tuple[str, ...] = ()) -> DataFrame:
    """The average rating of each dimension over the answers (column answer) of each ``per``, or over all; 0 where nothing was rated."""
    from lectern.functions.jsonx import rating

    return answers.groupBy(*per).agg(*[F.coalesce(F.round(F.avg(rating(F.col("answer"), d)), 2), F.lit(0.0)).alias(d.lower()) for d in dimensions])


def reports(audit: DataFrame, averages: DataFrame) -> DataFrame:
    """(book, report): a Markdown report of each audited book, from its audit rows, their scores and its row of ``averages`` (book and a column a dimension).

    Checks are in order of name; a book without averages has none in its report. One row a book travels, made by one grouping and two joins on it.
    """
    number = lambda c, digits: F.format_string(f"%.{digits}f", c)
    cell = F.concat_ws(" | ", F.col("check"), F.col("n_pass").cast("string"), F.col("n_total").cast("string"), F.when(F.size("failed") > 0, F.array_join(F.col("failed").cast("array<string>"), ", ")).otherwise("-"))
    lines = F.array_sort(F.collect_list(F.struct("check", F.concat(F.lit("| "), cell, F.lit(" |")).alias("line"))))
    tables = audit.groupBy("book").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("rows"))
    names = [c for c in averages.columns if c != "book"]
    rated = averages.select("book", F.array_join(F.array(*[F.concat(F.lit(f"{c}: "), number(F.col(c), 2)) for c in names]), "\n").alias("rated"))
    scored = F.format_string("Structure %.2f, length %.2f, coherence %.4f of 10.", "structure_score", "length_score", "coherence_score")
    head = F.concat(F.lit("# Quality of "), F.col("book").cast("string"), F.lit("\n\n| check | passed | of | failing sessions |\n|-|-|-|-|"))
    text = F.concat(F.concat_ws("\n", head, "rows", F.lit(""), scored, "rated"), F.lit("\n"))
    return tables.join(audit_scores(audit), "book").join(rated, "book", "left").select("book", text.alias("report"))
