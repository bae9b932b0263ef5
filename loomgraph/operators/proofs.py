"""Which calls are certain: proofs over a relation of all occurrences of identifiers.

An occurrence (file, name, role, at) is a definition (of a top-level function
with a body), a call (a bare name that is called), or other: a parameter, a
binding, an import, an attribute, a value that is passed on, a string that
names it. A call is certain if its file defines the name once and every other
occurrence of it is a call, the file can't be rewritten as a whole (blocked) and
the function that calls holds no macro that could.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import bucketed, materialize
from .components import cycles
from .resolve import HINT, only, owner_tail, symbol
from .spans import innermost


def proven_names(uses: DataFrame, blocked: DataFrame) -> DataFrame:
    """(file, name, target) of uses (file, name, role, path; the path of a definition) with one definition and calls besides, in files that aren't blocked (file)."""
    n = lambda role: F.count_if(F.col("role") == role)
    each = uses.groupBy("file", "name").agg(n("definition").alias("definitions"), n("call").alias("calls"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("role") == "definition", F.col("path"))).alias("target"))
    one = each.where("definitions = 1 and calls = n - 1").select("file", "name", "target")
    return one.join(blocked.select("file").distinct(), "file", "left_anti")


def owners(sites: DataFrame, functions: DataFrame, modules: DataFrame) -> DataFrame:
    """sites (site, file, start, end) with owner: the innermost function (owner, file, o_start, o_end) that holds it, else the file's module (file, module). A join by bins of places, never by all pairs."""
    found = innermost(sites.select(F.col("site").alias("span"), "file", "start", "end"), functions).select(F.col("span").alias("site"), "owner")
    return sites.join(found, "site").join(modules, "file", "left").withColumn("owner", F.coalesce("owner", "module")).drop("module")


def certain_calls(calls: DataFrame, uses: DataFrame, blocked: DataFrame, rewritten: DataFrame) -> DataFrame:
    """(ref, target) of bare calls (ref, file, name, caller) that are certain; rewritten: callers (caller) with a macro that could rebind a name."""
    return calls.join(proven_names(uses, blocked), ["file", "name"]).join(rewritten.select("caller").distinct(), "caller", "left_anti").select("ref", "target")


# imports of modules

# Names and words that let a run put other modules in place of the imported ones.
HAZARDS = ("__mocks__", ".npmrc", ".taprc")
HAZARD_PREFIXES = ("vitest.config.", "vite.config.", "vitest.workspace.", "jest.config.", ".mocharc.", ".c8rc")
HAZARD_FLAGS = ("\\", '"jest"', "--import", "--require", "-r ", "--loader", "--experimental-loader", "--experimental-test-module-mocks", "--experimental-default-type")


def blocked_roots(entries: DataFrame) -> DataFrame:
    """(root) of entries (root, path, kind: file, folder or link, text) whose names or package manifests may change what an import means, anywhere below the root."""
    name = F.substring_index("path", "/", -1)
    hazard = F.lit(False)
    for part in HAZARD_PREFIXES:
        hazard = hazard | F.startswith("name", F.lit(part))
    flagged = F.lit(False)
    for flag in HAZARD_FLAGS:
        flagged = flagged | F.contains(F.coalesce("text", F.lit("\\")), F.lit(flag))
    found = entries.withColumn("name", name).where(F.col("name").isin(*HAZARDS) | hazard | ((F.col("name") == "package.json") & ((F.col("kind") != "file") | flagged)))
    return found.select("root").distinct()


def import_cycles(imports: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """(importer, file) of imports, or other dependencies (importer, file), that lie on a cycle: both ends in one strongly connected component. A file's import of itself is one."""
    ids = lambda c: F.xxhash64(c)
    steps = imports.select("importer", "file")
    steps = (steps if dependencies is None else steps.union(dependencies.select("importer", "file"))).distinct()
    found = cycles(steps.select(ids("importer").alias("at"), ids("file").alias("to")))
    a, b = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = steps.join(a, ids("importer") == F.col("a")).join(b, ids("file") == F.col("b"))
    return both.where("ca = cb").select("importer", "file")


# methods

#: Steps at which a receiver is found: by value, by reference, by mutable reference.
STEPS = ("value", "ref", "mut")


def method_proofs(calls: DataFrame, types: DataFrame, inherent: DataFrame, traits: DataFrame, impls: DataFrame, derefs: DataFrame, aliased: DataFrame, unsafe: DataFrame) -> DataFrame:
    """(ref, target) of calls (ref, file, type, method, known: type is defined or imported by name in the file) that one inherent method answers for certain.

    types: (name) a row for each item; inherent: (type, method, receiver,
    bounds, public, gated, generic, clean, target); traits: (trait, method,
    receiver, gated); impls: (trait, type, bounds, gated; a null type is a
    blanket implementation); derefs: (type); aliased: (name) bound to something
    outside somewhere; unsafe: (file) that something may rewrite, or with an
    import that can't be verified.

    A receiver is looked up by value, then by reference, then by mutable
    reference; at each step the type's own methods come before those of traits.
    So a trait's method of that name wins at an earlier step, may at an unknown
    one, and at the same step only as a blanket implementation, or one of the
    type under other bounds; at a later step never.
    """
    step = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("receiver"))
    one_type = types.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("name").alias("type"))
    own = inherent.groupBy("type", "method").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("receiver", "bounds", "public", "gated", "generic", "clean", "target")])
    own = own.where("n = 1 and public and not gated and generic and clean and target is not null").withColumn("step", step).where("step > 0")
    own = own.join(one_type, "type", "left_semi").join(derefs.select("type"), "type", "left_anti").join(aliased.select(F.col("name").alias("type")), "type", "left_anti")
    rivals = own.select("type", "method", "step", "bounds").join(traits.select("method", "trait", F.col("gated").alias("t_gated"), step.alias("t_step")), "method")
    # a step that isn't known has 0
    early = rivals.where("t_gated or t_step < step").select("type", "method")
    level = rivals.where("not t_gated and t_step = step")
    named = level.join(impls.where("type is not null").select("trait", "type", F.col("bounds").alias("i_bounds"), F.col("gated").alias("i_gated")), ["trait", "type"]).where(F.col("i_gated") | ~F.col("i_bounds").eqNullSafe(F.col("bounds")))
    blanket = level.join(impls.where("type is null").select("trait").distinct(), "trait", "left_semi")
    lost = early.union(named.select("type", "method")).union(blanket.select("type", "method")).distinct()
    sure = own.join(lost, ["type", "method"], "left_anti").select("type", "method", "target")
    return calls.where("known").join(unsafe.select("file").distinct(), "file", "left_anti").join(sure, ["type", "method"]).select("ref", "target")


# receivers made by other calls

#: Calls in a chain, with the fallbacks in between, after which what is left has no end.
CHAIN = 256


def _top_level(text, depth: int = 4):
    """The parts between the outermost angle brackets; what is nested in them is left out."""
    inner = F.regexp_extract(text, "<(.*)>", 1)
    for _ in range(depth):
        inner = F.regexp_replace(inner, r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "<>")
        inner = F.regexp_replace(inner, "<>", "\u0001")
    return F.transform(F.split(inner, ","), lambda p: F.btrim(p))


def passes_generic(type_parameters, first_parameter, return_type):
    """Whether a function hands a type parameter of its argument on: both have the same outer type and the parameter as a direct argument."""
    outer = lambda t: F.element_at(F.regexp_extract_all(F.substring_index(t, "<", 1), F.lit(r"(\w+)"), F.lit(1)), -1)
    names = F.filter(F.transform(F.split(F.regexp_replace(type_parameters, "^<|>$", ""), ","), lambda p: F.regexp_extract(F.btrim(p), r"^(?!const )(\w+)", 1)), lambda p: p != "")
    direct = lambda t, p: (F.btrim(t) == p) | F.array_contains(_top_level(t), p)
    first, made = F.coalesce(first_parameter, F.lit("")), F.coalesce(return_type, F.lit(""))
    same = (F.size(F.regexp_extract_all(F.substring_index(first, "<", 1), F.lit(r"(\w+)"), F.lit(1))) > 0) & (outer(first).eqNullSafe(outer(made)))
    return F.coalesce(same & F.exists(names, lambda p: direct(first, p) & direct(made, p)), F.lit(False))


def chained_receivers(calls: DataFrame, factories: DataFrame, functions: DataFrame, most: int = CHAIN) -> DataFrame:
    """(ref, target) of calls (ref, name, factory) by the type that the factory makes, through chains of factories to a fixpoint.

    factories: (factory, name, receiver, base, fallback_type, fallback): base is
    the function that is called, where that is known; else the call is of name
    on what the receiver, a factory too, makes. functions: (id, name, owner,
    return_type, type_parameters, first_parameter).

    A factory's function says the owner: ``Self`` is its own one, else one that
    its return type names; the method is the only one of its name there. If
    there is none and the function hands a type parameter on, the fallback type
    is asked, then the fallback factory. Each round answers what waits for
    functions that are known; it ends when a round finds nothing, so cycles end.
    """
    words = lambda c: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), symbol), lambda w: F.char_length(w) >= HINT))
    own = F.regexp_like("return_type", F.lit(r"(?<![A-Za-z0-9_])Self(?![A-Za-z0-9_])"))
    spark, tables = functions.sparkSession, []

    def dealt(df, *keys):
        """df written in buckets of its keys, so that rounds shuffle only what is new to meet it."""
        tables.append(bucketed(df, *keys))
        return spark.table(tables[-1])

    passes = passes_generic(F.col("type_parameters"), F.col("first_parameter"), F.col("return_type"))
    typed = functions.where("return_type is not null")
    makers = dealt(typed.select(F.col("id").alias("made_by"), F.when(own, F.col("owner")).alias("made_owner"), own.alias("own"), F.when(~own, words(F.col("return_type"))).alias("makes"), passes.alias("passes")), "made_by")
    byowner = dealt(functions.select("name", F.col("owner").alias("made_owner"), "id"), "name", "made_owner")
    bytail = dealt(functions.select("name", owner_tail(F.col("owner")).alias("tail"), "id"), "name", "tail")
    f = dealt(factories.select(F.col("factory").alias("at"), "fallback_type", "fallback"), "at")
    asked = factories.where("base is null and receiver is not null").select(F.lit(False).alias("final"), F.col("factory").alias("who"), "name", F.col("receiver").alias("at"))
    waiting = dealt(asked.union(calls.select(F.lit(True), "ref", "name", "factory")), "at")
    makes = lambda df, label: materialize(df.join(makers.select("made_by"), "made_by", "left_semi").distinct(), label)

    new = makes(factories.where("base is not null").select(F.col("factory").alias("at"), F.col("base").alias("made_by")), "known")
    known, late, moved, found = new, None, None, None  # late: what was moved and waits; moved: in the last round
    try:
        for _ in range(most):
            # what waits for factories that have become known, with what those make
            came = waiting.join(new, "at")
            if moved is not None:
                came = came.unionByName(late.join(new, "at")).unionByName(moved.join(known, "at"))
                # a fallback may ask for what has long been known
                late = materialize(late.join(new, "at", "left_anti").unionByName(moved.join(known, "at", "left_anti")), "late")
            ready = materialize(came.join(makers, "made_by").join(f, "at", "left"), "ready")
            if not ready.limit(1).count():
                break
            byself = ready.where("own").join(byowner, ["name", "made_owner"]).select("final", "who", "at", "id", F.lit(False).alias("other"))
            types = F.array(F.struct(F.lit(False).alias("other"), F.col("makes").alias("tails")), F.struct(F.lit(True).alias("other"), F.when(F.col("passes"), words(F.col("fallback_type"))).alias("tails")))
            tails = ready.select("final", "who", "at", "name", F.inline(types)).select("final", "who", "at", "name", "other", F.explode("tails").alias("tail"))
            bytype = tails.join(bytail, ["name", "tail"]).select("final", "who", "at", "id", "other")
            each = byself.union(bytype).withColumn("first", F.when(~F.col("other"), F.col("id"))).withColumn("second", F.when(F.col("other"), F.col("id")))
            answers = each.groupBy("final", "who", "at").agg(only("first").alias("first"), only("second").alias("second"))
            answers = materialize(answers.select("final", "who", "at", F.coalesce("first", "second").alias("id")).where("id is not null"), "answers")
            here = answers.where("final").select(F.col("who").alias("ref"), F.col("id").alias("target"))
            found = here if found is None else found.union(here)
            again = materialize(ready.where("passes and fallback is not null").join(answers, ["final", "who", "at"], "left_anti").select("final", "who", "name", F.col("fallback").alias("at")).distinct(), "moved")
            moved, late = again, again.limit(0) if late is None else late
            made = makes(answers.where("not final").select(F.col("who").alias("at"), F.col("id").alias("made_by")), "made")
            new = materialize(made.join(known.select("at"), "at", "left_anti"), "new")
            known = materialize(known.union(made).distinct(), "known")
    finally:
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return calls.select("ref", F.lit(None).cast("long").alias("target")).limit(0) if found is None else found
