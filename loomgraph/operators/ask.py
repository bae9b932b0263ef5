"""Questions in words: what is asked, about what, and the answer as a DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .lookup import explained, resolved
from .similarity import concept
from .traverse import callees, callers, impact, named, neighborhood

EDGES = " \t\n`'\"?.,;:()"


@dataclass(frozen=True)
class Question:
    kind: str
    subject: str
    hops: int = 0


def _last_name(text: str) -> str:
    names = [w.strip(EDGES) for w in text.split()]
    names = [w for w in names if re.fullmatch(r"[\w:.#@]+", w)]
    return names[-1] if names else ""


def _after(text: str, words: list[str]) -> str:
    """What follows the first of the words that occurs, by its first name; else the last name."""
    parts = [w.strip(EDGES) for w in text.split()]
    for word in words:
        if word in parts[:-1]:
            return parts[parts.index(word) + 1]
    return _last_name(text)


def _between(text: str, a: str, b: str) -> str | None:
    m = re.search(rf"\b{a}\b\s+(.+?)\s+{b}", text)
    return m[1].strip(EDGES) if m else None


@dataclass(frozen=True)
class Rule:
    """A kind of question fits if the text starts with, or holds, one of the words, holds "does" or not (asks), and lacks others."""

    kind: str
    starts: tuple[str, ...] = ()
    has: tuple[str, ...] = ()
    asks: bool | None = None
    lacks: tuple[str, ...] = ()


# The words of questions, in the order in which they are tried.
RULES = (
    Rule("impact", has=("break", "impact", "affect")),
    Rule("callers", starts=("what calls", "who calls"), asks=False),
    Rule("callers", has=("callers of",), asks=False),
    Rule("callees", has=(" call", "depend"), asks=True),
    Rule("callees", has=("callees of", "calls made by")),
    Rule("explain", starts=("explain", "describe")),
    Rule("explain", starts=("what is",), lacks=("best", "code")),
    Rule("neighborhood", has=("subgraph", "neighborhood", "around")),
)
# The words after which a question's subject stands.
SUBJECTS = {"impact": ("change", "modify", "edit", "of"), "neighborhood": ("around", "of", "near")}


def _fits(rule: Rule, low: str) -> bool:
    first = low.startswith(rule.starts) if rule.starts else any(w in low for w in rule.has)
    return first and rule.asks in (None, "does" in low) and not any(w in low for w in rule.lacks)


def parse(text: str) -> Question:
    """The first kind that the question's words fit, in a fixed order; a concept if none does."""
    low = text.lower().rstrip("?").strip()
    kind = next((r.kind for r in RULES if _fits(r, low)), None)
    if kind is None:
        return Question("concept", text.strip())
    if kind == "callees":
        return Question(kind, _between(low, "does", "call") or _between(low, "does", "depend") or _last_name(low))
    subject = _after(low, list(SUBJECTS[kind])) if kind in SUBJECTS else _last_name(low)
    return Question(kind, subject, 2 if kind == "neighborhood" else 0)


def kind_of(text: Column) -> Column:
    """The kind of question for a whole column."""
    low = F.btrim(F.regexp_replace(F.lower(text), r"\?+$", ""))
    one_of = lambda words, at="": F.regexp_like(low, F.lit(f"{at}(" + "|".join(map(re.escape, words)) + ")"))
    out = F.lit("concept")
    for rule in reversed(RULES):
        fits = one_of(rule.starts, "^") if rule.starts else one_of(rule.has)
        if rule.asks is not None:
            fits = fits & (F.contains(low, F.lit("does")) == F.lit(rule.asks))
        if rule.lacks:
            fits = fits & ~one_of(rule.lacks)
        out = F.when(fits, rule.kind).otherwise(out)
    return out


def ask(g: Graph, text: str) -> DataFrame:
    """The answer's rows, their columns by the kind of question. A subject that is not in the graph gives no rows."""
    q = parse(text)
    spark = g.nodes.sparkSession
    if q.kind == "concept":
        return concept(g, q.subject).join(g.nodes.select("id", "path", F.col("kind").alias("node_kind")), "id").orderBy(F.desc("score"), "path")
    found = resolved(g, spark.range(1).select(F.lit(q.subject).alias("subject"))).select("path").first()
    path = found["path"] if found else None
    here = g.nodes.where(F.col("path") == path).select("id")
    if q.kind == "explain":
        return explained(g, path or "")
    if q.kind == "impact":
        return named(impact(g, here), g).select("path", "distance", "node_kind").orderBy("distance", "path")
    if q.kind == "neighborhood":
        return named(neighborhood(g, here, q.hops), g).where("distance > 0").select("path", "distance", "node_kind").orderBy("distance", "path")
    return named((callers if q.kind == "callers" else callees)(g, here), g).select("path", "node_kind").distinct().orderBy("path")


def orient(g: Graph, path: str) -> dict[str, DataFrame]:
    """All that one wants to know of a node: source, callers, callees, tests and impact, each a DataFrame."""
    from .traverse import bounded_calls, tests_for

    here = g.nodes.where(F.col("path") == path).select("id")
    if not here.limit(1).count():
        raise KeyError(path)
    return {
        "source": g.nodes.where(F.col("path") == path).select("path", "language", "source"),
        "callers": named(bounded_calls(g, here, 2), g).select("path", "distance").orderBy("distance", "path"),
        "callees": named(bounded_calls(g, here, 2, False), g).select("path", "distance").orderBy("distance", "path"),
        "tests": named(tests_for(g, here), g).select("path").orderBy("path"),
        "impact": named(impact(g, here), g).select("path", "distance").orderBy("distance", "path"),
    }
