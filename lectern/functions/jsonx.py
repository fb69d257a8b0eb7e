"""Functions on JSON and on short model answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip


def unfenced(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(x), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def tolerant(x: Column) -> Column:
    """A variant from the text without fences, else from its widest object or array; null if neither parses."""
    bare = unfenced(x)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)))


def verdict(x: Column) -> Column:
    """Struct of passed and evidence from an answer that says YES or NO, at its start or anywhere; else not passed."""
    upper = F.upper(strip(x))
    rest = lambda n: strip(F.regexp_replace(F.substr(strip(x), F.lit(n + 1)), r"^[\s:.,-]+", ""))
    said = lambda ok, why: F.struct(F.lit(ok).alias("passed"), why.alias("evidence"))
    return (
        F.when(upper.startswith("YES"), said(True, rest(3)))
        .when(upper.startswith("NO"), said(False, rest(2)))
        .when(upper.contains("YES"), said(True, strip(x)))
        .when(upper.contains("NO"), said(False, strip(x)))
        .otherwise(said(False, F.concat(F.lit("Unclear response: "), F.substring(strip(x), 1, 100))))
    )


def rating(x: Column, dimension: str) -> Column:
    return F.nullif(F.regexp_extract(x, dimension + r":\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def remark(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"VERDICT:\s*([^\n]+)", 1), F.lit(""))


def salvage_text(raw: str) -> str | None:
    """A cut-off object closed where it was cut, or cut back to its last complete element; null if neither parses."""
    stack, inside, escaped = [], False, False
    for c in raw:
        if inside:
            inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    tries = [raw + '"' * inside + "".join(reversed(stack))]
    if (at := raw.rfind("},")) > 0:
        head = raw[: at + 1]
        tries.append('{"concepts":' + head[head.find("[") :] + "]}" if "[" in head else head + "}")
    for text in tries:
        try:
            json.loads(text)
        except ValueError:
            continue
        return text
    return None


def salvage(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda s: None if s is None else salvage_text(s))

    return run(x)


def parse_object(raw: str) -> dict:
    """A model's JSON object, tolerant of fences, prose around it and a cut-off end."""
    bare = raw.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    for text in (bare, bare[bare.find("{") : bare.rfind("}") + 1], salvage_text(bare[bare.find("{") :]) if "{" in bare else None):
        try:
            found = json.loads(text) if text else None
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError("no JSON object")


def read_verdict(answer: str) -> tuple[bool, str]:
    """``verdict`` of one answer in plain Python, for workers that ask again."""
    bare = answer.strip()
    upper = bare.upper()
    for word, passed in (("YES", True), ("NO", False)):
        if upper.startswith(word):
            return passed, re.sub(r"^[\s:.,-]+", "", bare[len(word) :]).strip()
    for word, passed in (("YES", True), ("NO", False)):
        if word in upper:
            return passed, bare
    return False, f"Unclear response: {bare[:100]}"
