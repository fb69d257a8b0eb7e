"""The language-model seam: prompts in, answers out, behind a provider that each Python worker makes for itself."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from datetime import date
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import jsonx as J
from lectern.functions import text as T
from lectern.sources.store import QuotaExhausted, QuotaFile


class ModelProvider(Protocol):
    def generate(self, task: str, prompt: str) -> str: ...


class OfflineProvider:
    """Deterministic answers by rule, for tests and runs without a network. It names all that its rules find."""

    #: Words that an inventory takes for concepts, phrases that refer back, and terms that are taken for granted.
    CONCEPT, SIGNAL, TERM = (re.compile(p, re.ASCII) for p in (r"\b[A-Z][a-z]{3,}\b", r"\b(recall that|as we saw|building on|this requires) ([A-Z][a-z]{3,})\b", r"\b[A-Z]{3,}\b"))
    WEIGHTS = ("light", "medium", "heavy")

    def generate(self, task: str, prompt: str) -> str:
        answer = getattr(self, f"_{task}", None)
        if answer is None:
            return prompt
        out = answer(prompt)
        return out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)

    def _terms(self, prompt: str) -> list[str]:
        return list(dict.fromkeys(self.CONCEPT.findall(prompt)))

    def _inventory(self, prompt: str) -> dict:
        counts = Counter(self.CONCEPT.findall(prompt))
        return {
            "concepts": [{"name": t, "description": f"What the text says on {t}", "location": "", "recurring": n > 1} for t, n in counts.items()],
            "explicit_dependencies": [{"signal": m[1], "location": "", "refers_to": m[2]} for m in self.SIGNAL.finditer(prompt)],
            "implicit_assumptions": [{"term": t, "context": "", "location": ""} for t in dict.fromkeys(self.TERM.findall(prompt))],
            "author_anchors": [{"anchor": x, "location": ""} for x in dict.fromkeys(re.findall(r'"([^"\n]{10,80})"', prompt))],
        }

    def _merge(self, prompt: str) -> dict:
        """The first of all concepts that are equal without case; of the other lists what is not there yet."""
        given = json.loads(prompt)
        first: dict[str, dict] = {}
        for c in given["concepts"]:
            first.setdefault(c["name"].lower(), c)
        rest = {k: list({json.dumps(x, sort_keys=True): x for x in v}.values()) for k, v in given.items() if k != "concepts"}
        return {"concepts": list(first.values()), **rest}

    def _adjust(self, prompt: str) -> dict:
        """Two halves of each concept, or one concept for each four letters at the start."""
        verdict, _, listing = prompt.partition("\n")
        concepts = json.loads(listing)["concepts"]
        if verdict == "split":
            return {"concepts": [{**c, "name": f"{c['name']} {part}"} for c in concepts for part in ("idea", "use")]}
        first: dict[str, dict] = {}
        for c in concepts:
            first.setdefault(c["name"][:4], c)
        return {"concepts": list(first.values())}

    def _cluster(self, prompt: str) -> dict:
        """A theme for each sixth of the letters, by the first one."""
        themes: dict[int, list[str]] = {}
        for line in prompt.split("\n"):
            name = line.removeprefix("- ").partition(": ")[0]
            if name:
                themes.setdefault(ord(name[0]) % 6, []).append(name)
        return {"clusters": [{"name": f"Theme {k}", "description": f"{len(v)} concepts", "concepts": v} for k, v in sorted(themes.items())]}

    def _recluster(self, prompt: str) -> dict:
        """Five themes, dealt in turn."""
        names = [n for c in json.loads(prompt.partition("\n")[2])["clusters"] for n in c["concepts"]]
        return {"clusters": [{"name": f"Part {k}", "description": f"{len(names[k::5])} concepts", "concepts": names[k::5]} for k in range(5) if names[k::5]]}

    def _deep(self, prompt: str) -> dict:
        """Each concept builds on the one before it in its cluster, or requires the one before it in the book by name."""
        given = json.loads(prompt)
        own, every = given["concepts"], sorted(given["all"])
        out = []
        for i, name in enumerate(own):
            before = own[i - 1] if i else None
            earlier = every[every.index(name) - 1] if name in every[1:] else None
            out.append(
                {
                    "original_name": name, "canonical_name": name, "description": f"{name} in {given['cluster']}", "primary_passage": "", "secondary_passages": [],
                    "dependency_signals": [{"signal": "building on", "location": "", "refers_to": before}] if before and i % 3 == 1 else [],
                    "implicit_prerequisites": [before] if before and i % 3 == 2 else [], "author_anchor": "", "enrichment_flag": False,
                    "concept_weight": self.WEIGHTS[len(name) % 3], "cross_theme_deps": [{"concept": earlier, "relationship": "requires"}] if earlier and earlier not in own else [],
                }
            )
        return {"concepts": out}

    def _duplicates(self, prompt: str) -> dict:
        names = [x.partition(" - ")[0].lower().rstrip("s") for x in prompt.split("\n")]
        first = {n: i for i, n in reversed(list(enumerate(names)))}
        return {"duplicates": [{"keep_index": first[n], "discard_index": i} for i, n in enumerate(names) if first[n] != i]}

    def _edges(self, prompt: str) -> dict:
        names = [x.partition(" - ")[0] for x in prompt.split("\n")]
        return {"dependencies": [{"from": a, "to": b, "reason": "listed earlier"} for a, b in zip(names, names[1:], strict=False)]}

    def _revisit(self, prompt: str) -> dict:
        given = json.loads(prompt)
        first = given["candidates"][0] if given["candidates"] else None
        return {"choice": first, "reason": f"{first} reappears here because {given['current'][0]} leans on it" if first and given["current"] else ""}

    def _revise(self, prompt: str) -> str:
        return prompt[prompt.find("[") :] if "keep" in prompt.partition("\n")[0] else "no change"

    def _title(self, prompt: str) -> dict:
        return {"title": " and ".join(self._terms(prompt)[:2]) or "Untitled session"}

    def _binary(self, prompt: str) -> str:
        return "YES it asks" if "?" in prompt else "NO nothing is asked"

    def _rating(self, prompt: str) -> str:
        n = min(10, 5 + len(prompt.split()) // 200)
        return f"TECHNICAL_ACCURACY: {n}\nCONCEPT_DEPTH: {n}\nPROSE_QUALITY: {n}\nVERDICT: by length"

    def _question(self, prompt: str) -> str:
        terms = self._terms(prompt)
        return f"What breaks first when {terms[0] if terms else 'this'} meets real scale?"

    def _frame(self, prompt: str) -> str:
        """An opening and a closing question, with an empty line between."""
        opening, _, question = prompt.rpartition("\n")
        return f"Because of {opening}.\n\n{question}"

    def _card(self, prompt: str) -> str:
        return "\n".join(f"— {name}" for name in prompt.partition("\n")[0].split(", "))


class Retrying:
    """Another provider with up to ``tries`` calls; the wait before the n-th further call is ``base`` * 2**n seconds."""

    def __init__(self, inner: ModelProvider, tries: int = 3, base: float = 2.0, sleep: Callable[[float], None] | None = None):
        import time

        self.inner, self.tries, self.base, self.sleep = inner, tries, base, sleep or time.sleep

    def generate(self, task: str, prompt: str) -> str:
        for n in range(self.tries):
            try:
                return self.inner.generate(task, prompt)
            except QuotaExhausted:  # waiting does not help
                raise
            except Exception:
                if n == self.tries - 1:
                    raise
                self.sleep(self.base * 2**n)
        raise AssertionError


class Metered:
    """Providers of several keys behind one, each call under the daily quota of its key.

    A call reserves its estimate (a token for four characters of the prompt, and ``answer_tokens``) with the current key, or the next one in
    turn that has so much left, which becomes the current one; without any QuotaExhausted ends the run. Afterwards
    the estimate gives way to what was used; a call that failed gives its tokens back.
    """

    def __init__(self, for_key: Callable[[str], ModelProvider], key_ids: list[str], quota: QuotaFile, answer_tokens: int = 1800, today: Callable[[], date] = date.today):
        self.for_key, self.key_ids, self.quota, self.answer_tokens, self.today = for_key, list(key_ids), quota, answer_tokens, today
        self.current, self.made = 0, {}

    def generate(self, task: str, prompt: str) -> str:
        today, estimate = self.today(), len(prompt) // 4 + self.answer_tokens
        self.current = self.quota.reserve(self.key_ids, self.current, estimate, today)
        key = self.key_ids[self.current]
        used = 0
        try:
            if key not in self.made:
                self.made[key] = self.for_key(key)
            answer = self.made[key].generate(task, prompt)
            used = (len(prompt) + len(answer)) // 4
            return answer
        finally:
            self.quota.record(key, used - estimate, today)


def ask(task: str, prompt: Column, make: Callable[[], ModelProvider] = OfflineProvider) -> Column:
    """Struct of answer and error; an error is kept with its row and does not end the job."""

    @F.pandas_udf("answer string, error string")
    def run(prompts):
        import pandas as pd

        provider, out = make(), []
        for p in prompts:
            try:
                out.append((provider.generate(task, p or ""), None))
            except QuotaExhausted:  # nothing more can be asked today
                raise
            except Exception as e:  # isolated by row, as one failed call must not lose the others
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["answer", "error"])

    return run.asNondeterministic()(prompt)


def ask_json(task: str, prompt: Column, schema: str, make: Callable[[], ModelProvider] = OfflineProvider) -> Column:
    """Struct of found (of ``schema``) and error: the answer's JSON object, read tolerantly; an answer without one is an error."""

    @F.pandas_udf("string")
    def run(prompts):
        import pandas as pd

        provider, out = make(), []
        for p in prompts:
            try:
                out.append({"found": J.parse_object(provider.generate(task, p or "")), "error": None})
            except QuotaExhausted:
                raise
            except Exception as e:  # isolated by row, as one failed call must not lose the others
                out.append({"found": None, "error": str(e)})
        return pd.Series([json.dumps(x, ensure_ascii=False) for x in out], dtype=object)

    # One value a call, so that a row is never asked about twice.
    return F.from_json(run.asNondeterministic()(prompt), f"struct<found: {schema}, error: string>")


def rate(sessions: DataFrame, make: Callable[[], ModelProvider] = OfflineProvider) -> DataFrame:
    return sessions.select("book", "number", ask("rating", T.trim_words(F.col("content"), 3000), make)["answer"].alias("answer"))
