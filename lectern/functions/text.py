"""Text functions on columns. White space, words and digits are Unicode, as ``(?U)`` makes them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MATH = r"[∑∫∂√∞πθαβγδ]|\$_\w+\$_|\\\w+"
STOP_WORDS = ["the", "a", "an", "of", "in", "for", "and", "to", "is", "are", "how", "why", "what", "when", "where", "your", "our", "its", "their"]
BANNED_LAST_WORDS = [
    "overview", "explained", "introduction", "insights", "demystified", "simplified", "decoded", "unveiled", "compared", "secrets", "practice",
    "action", "gains", "boost", "optimized", "challenges", "magic", "and more", "puzzle", "trick", "needs", "roles", "basics", "essentials",
    "deep dive", "recap", "revisited", "breakdown",
]
TITLE_MARKS = "\"'.,;:!?"
CARD = r"(?s)\n\n[—–][^\n]+(\n[—–][^\n]+)*\s*$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\S+")).cast("long")


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)(\S+)"))


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(words(x), 1, n), " ")


def last_words(x: Column, n: int) -> Column:
    """The last n words joined by spaces; a text of fewer words comes back as it is."""
    return F.when(word_count(x) < n, x).otherwise(F.array_join(F.slice(words(x), -n, n), " "))


def paragraphs(x: Column) -> Column:
    return F.filter(F.split(x, "\n\n"), lambda p: strip(p) != "")


def sentences(x: Column) -> Column:
    return F.split(x, r"(?U)(?<=[.!?])\s+")


def nfkc(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return run(x)


def flag_math(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit("(?U)" + MATH)), F.concat(x, F.lit(" [MATH]"))).otherwise(x)


def clean_text(x: Column, normalize: bool = True) -> Column:
    """White space squeezed, words broken by a hyphen joined, compatibility characters folded, mathematics flagged."""
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"(?U)(\w)-\s+(\w)", "$1$2")
    return strip(flag_math(nfkc(x) if normalize else x))


def comparable(x: Column) -> Column:
    return F.regexp_replace(strip(F.lower(x)), r"(?U)\s+", " ")


def tidy_document(x: Column) -> Column:
    """At most one empty line in a row, no tag lines without content, tags on lines of their own."""
    x = F.regexp_replace(x, r"(?U)\n\s*\n\s*\n+", "\n\n")
    x = F.regexp_replace(x, r"(?U)\w+:\s*\n", "")
    return strip(F.regexp_replace(x, r"(?U)(\S):\s*(\w+:)", "$1\n\n$2"))


def table_to_prose(x: Column) -> Column:
    """Sentences "For <main cell>, <header> is <cell>." for the rows that have as many cells as the header; else the text."""
    cells = lambda line: F.split(strip(line), r"\t|  +")
    lines = F.split(x, "\n")
    head = cells(F.element_at(lines, 1))
    rows = F.filter(F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda s: strip(s) != ""), cells), lambda r: F.size(r) == F.size(head))
    main = F.when((F.size(head) > 1) & F.lower(head[0]).contains("name"), 1).otherwise(0)

    def prose(row: Column) -> Column:
        other = F.filter(F.transform(F.arrays_zip(head.alias("h"), row.alias("c")), lambda p, i: F.struct(i.alias("i"), p["h"].alias("h"), p["c"].alias("c"))), lambda p: (p["i"] != main) & (strip(p["c"]) != ""))
        return F.transform(other, lambda p: F.concat(F.lit("For "), row[main], F.lit(", "), F.lower(p["h"]), F.lit(" is "), p["c"], F.lit(".")))

    return F.when((F.size(lines) >= 2) & (F.size(rows) > 0), F.array_join(F.flatten(F.transform(rows, prose)), " ")).otherwise(x)


def slug(stem: Column) -> Column:
    """A dash before each later capital, lower case, everything but a-z, 0-9 and dashes a dash, dashes squeezed."""
    x = F.lower(F.regexp_replace(stem, r"(?<!^)(?=[A-Z])", "-"))
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9-]", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(x, "^-+|-+$", ""), F.lit("")), F.lit("book"))


def without_card(x: Column) -> Column:
    """Without the bulleted card at the end."""
    return F.regexp_replace(x, CARD, "")


def ends_openly(x: Column) -> Column:
    """Whether the last character is not one that ends a sentence."""
    return ~F.right(F.regexp_replace(x, r"(?U)\s+$", ""), F.lit(1)).isin(".", "?", "!")


def complete_part(x: Column) -> Column:
    """Up to the last end of a sentence that white space or the end follows; empty if there is none."""
    return F.regexp_extract(x, r"(?s)^(.*\S[.!?])(?=\s|$)", 1)


def stitch(opening: Column, body: Column, closing: Column) -> Column:
    """The three parts with an empty line between, without revisit marks."""
    clean = F.regexp_replace(F.regexp_replace(body, r"\[REVISIT\]\s*", ""), r"\s*\[/REVISIT\]", "")
    return F.concat_ws("\n\n", opening, clean, closing)


def opening_and_closing(x: Column) -> Column:
    """Struct of all paragraphs but the last and the last; a single one is halved by characters."""
    parts = paragraphs(x)
    n = F.size(parts)
    half = (F.length(x) / 2).cast("int")
    return F.when(n >= 2, F.struct(strip(F.array_join(F.slice(parts, 1, n - 1), "\n\n")).alias("opening"), strip(F.element_at(parts, -1)).alias("closing"))).otherwise(
        F.struct(strip(F.substring(x, F.lit(1), half)).alias("opening"), strip(F.substr(x, half + 1)).alias("closing"))
    )


def without_plan_header(x: Column) -> Column:
    """Without a planning header at the start: its first line, further lines of a label in capitals, and the empty line after them."""
    return F.regexp_replace(x, r"^\s*REVISIT TARGET:[^\n]*\n(?:[A-Z][A-Z ]+:[^\n]*\n)*\s*\n", "")


def question_to_resolve(x: Column) -> Column:
    """The last sentence with a question mark, else the last 80 words."""
    asked = F.filter(sentences(x), lambda s: s.contains("?"))
    return F.when(F.size(asked) > 0, strip(F.element_at(asked, -1))).otherwise(last_words(x, 80))


def rfind(x: Column, mark: str) -> Column:
    """0-based place of the last ``mark``, -1 without one."""
    back = F.locate(mark[::-1], F.reverse(x))
    return F.when(back > 0, F.length(x) - back - len(mark) + 1).otherwise(-1)


def last_complete(x: Column, n: int = 200) -> Column:
    """About the last n words, from a window of twice as many (400 at least), cut at the end of a sentence.

    The marks "? ", ". " and "! " are tried in this order; the first that occurs decides.
    """
    window = last_words(x, max(2 * n, 400))
    ends = [rfind(window, m) for m in ("? ", ". ", "! ")]
    cut = F.coalesce(*[F.when(e >= 0, F.substr(window, F.lit(1), e + 1)) for e in ends], window)
    return last_words(cut, n)


def trim_words(x: Column, n: int) -> Column:
    """The first n words, back to the last end of a sentence beyond 85 % of them if there is one."""
    cut = first_words(x, n)
    ends = [rfind(cut, m) for m in (". ", "? ", "! ")]
    far = [F.when(e > F.length(cut) * 0.85, F.substr(cut, F.lit(1), e + 1)) for e in ends]
    return F.when(word_count(x) <= n, x).otherwise(F.coalesce(*far, cut))


def tension_question(x: Column) -> Column:
    """Within the last 300 words: from after the last ". ", "! " or "? " before the last question mark up to that mark; null without one."""
    tail = last_words(x, 300)
    mark = rfind(tail, "?")
    before = F.substr(tail, F.lit(1), mark)
    start = F.greatest(*[rfind(before, m) for m in (". ", "! ", "? ")])
    return F.when(mark >= 0, strip(F.substr(tail, F.when(start >= 0, start + 3).otherwise(1), mark + 1 - F.when(start >= 0, start + 2).otherwise(0))))


def title_tokens(x: Column, drop: list[str] | None = None) -> Column:
    """Distinct lower-cased words without marks around them and without stop words."""
    marks = "[" + "".join("\\" + c for c in TITLE_MARKS) + "]+"
    bare = F.transform(words(F.lower(x)), lambda w: F.regexp_replace(w, f"^{marks}|{marks}$", ""))
    return F.array_except(F.filter(bare, lambda w: w != ""), F.array(*map(F.lit, STOP_WORDS if drop is None else drop)))


def banned_last_word(title: Column) -> Column:
    marks = "[" + "".join("\\" + c for c in TITLE_MARKS) + "]+"
    last = F.regexp_replace(F.try_element_at(words(F.lower(title)), F.lit(-1)), f"^{marks}|{marks}$", "")
    return F.coalesce(last.isin(BANNED_LAST_WORDS), F.lit(False))


def token_estimate(x: Column, least: int = 1) -> Column:
    return F.greatest(F.lit(least), F.floor(F.length(x) / 4)).cast("long")


def escape_html(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def duration(seconds: Column) -> Column:
    one = lambda v: F.format_string("%.1f", v.cast("double"))
    return F.when(seconds < 60, F.concat(one(seconds), F.lit("s"))).when(seconds < 3600, F.concat(one(seconds / 60), F.lit("m"))).otherwise(F.concat(one(seconds / 3600), F.lit("h")))


def key_id(key: Column) -> Column:
    return F.substring(F.sha2(F.substring(key, 1, 8), 256), 1, 16)


def code_fences(x: Column) -> Column:
    """array<struct<lang, code, note>> of the fenced blocks; a following line of 11 characters or more is its note."""
    part = lambda g: F.regexp_extract_all(x, F.lit(r"(?s)```(\w*)\n?(.*?)```(?:\n([^\n]{11,}))?"), F.lit(g))
    rows = F.arrays_zip(part(1).alias("lang"), part(2).alias("code"), part(3).alias("note"))
    return F.transform(rows, lambda p: F.struct(p["lang"].alias("lang"), strip(p["code"]).alias("code"), p["note"].alias("note")))


def prose_words(x: Column) -> Column:
    """array<struct<paragraph, word>> in reading order: paragraphs are lines that are not blank."""
    lines = F.filter(F.split(x, r"\n+"), lambda p: strip(p) != "")
    return F.flatten(F.transform(lines, lambda p, i: F.transform(words(p), lambda w: F.struct((i + 1).alias("paragraph"), w.alias("word")))))
