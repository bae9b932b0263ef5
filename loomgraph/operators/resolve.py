"""Resolution: references by name become edges to the only candidate, or to none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.idents import last_segment, module_of
from ..graph import Graph
from ..lineage import materialize


def only(value: str):
    """An aggregate: the value if there is exactly one, else null."""
    return F.when(F.count_distinct(value) == 1, F.min(value))


def agreed(value: str):
    """An aggregate: the value if all rows have the same one, else null."""
    return F.when((F.count_distinct(value) == 1) & (F.count(value) == F.count(F.lit(1))), F.min(value))


def ladder(candidates: DataFrame, ref: str, tier: str, value: str) -> DataFrame:
    """(ref, value): of the tiers with exactly one candidate the lowest; a tier with several falls through to the next."""
    each = candidates.groupBy(ref, tier).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1")
    return each.groupBy(ref).agg(F.min_by(value, tier).alias(value), F.min(tier).alias(tier))


#: Letters and digits that a hint needs to be evidence.
HINT = 3


def symbol(text: Column) -> Column:
    """ASCII letters and digits in lower case: how hints and owners are compared."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def hint_tail(text: Column) -> Column:
    """The last part of a qualifier or receiver type that isn't empty."""
    return F.btrim(F.regexp_extract(text, r"([^.:]*)[.:]*$", 1))


def owner_tail(owner: Column) -> Column:
    """An owner's last segment without generic parameters, as a symbol."""
    return symbol(F.substring_index(last_segment(owner), "<", 1))


def candidate_index(functions: DataFrame) -> DataFrame:
    """(by, name, key, id): what a name and a key of each kind stand for, where it is one function.

    by: o, the owner; t, the owner's tail; s, an ending of the tail; m, the
    module, of its own functions; w, the module, of all in it; n, no key.
    Functions of one key are counted before anything is joined, so a name that
    many functions have costs its references nothing.
    """
    module = F.col("module") if "module" in functions.columns else module_of(F.col("path"))
    f = functions.select("id", "name", module_of(F.col("path")).alias("owner"), F.coalesce(module, module_of(F.col("path"))).alias("module"))
    f = f.withColumn("tail", owner_tail(F.col("owner")))
    key = lambda by, value: F.struct(F.lit(by).alias("by"), value.alias("key"))
    endings = F.transform(F.sequence(F.lit(HINT), F.greatest(F.char_length("tail"), F.lit(HINT))), lambda n: key("s", F.right("tail", n)))
    own = F.when(F.col("owner") == F.col("module"), key("m", F.col("module")))
    keys = F.concat(F.array(key("o", F.col("owner")), key("t", F.col("tail")), own, key("w", F.col("module")), key("n", F.lit(""))), F.when(F.char_length("tail") >= HINT, endings).otherwise(F.array()))
    rows = f.select("id", "name", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("k.by", "name", "k.key", "id")
    return rows.groupBy("by", "name", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def select_candidates(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """(ref, id, tier) for refs (ref, caller_path, callee, qualifier, receiver_type, qualifier_owner_fallback, shadowed_by_local[, caller_module]).

    functions: (id, path, name[, module]); without modules an owner is its own.
    A shadowed bare name has none. self, Self and cls mean the caller's owner.
    Other qualifiers need a receiver type or the fallback: the owner of that
    path, if it is one; else the owner of that last part, else one that ends
    so. A bare name: the caller's module's own, else one in the module, else
    the only one of all. Each tier counts only with a single candidate.
    """
    module = F.col("caller_module") if "caller_module" in refs.columns else F.lit(None).cast("string")
    owner = module_of(F.col("caller_path"))
    bare, hint = F.col("qualifier").isNull(), F.coalesce("receiver_type", "qualifier")
    mine = hint_tail(F.col("qualifier")).isin("self", "Self", "cls")
    typed = F.col("receiver_type").isNotNull() | F.coalesce("qualifier_owner_fallback", F.lit(False))
    short = symbol(hint_tail(hint))
    useful = (F.char_length(short) >= HINT) & ~short.isin("self", "cls")
    place = F.coalesce(module, owner)
    key = lambda tier, by, value: F.struct(F.lit(tier).alias("tier"), F.lit(by).alias("by"), value.alias("key"))
    none = F.array().cast("array<struct<tier:int,by:string,key:string>>")
    keys = (
        F.when(bare & F.coalesce("shadowed_by_local", F.lit(False)), none)
        .when(bare, F.array(key(3, "m", place), key(4, "w", place), key(5, "n", F.lit(""))))
        .when(mine, F.array(key(0, "o", owner)))
        .when(typed, F.concat(F.when(F.contains(hint, F.lit("::")), F.array(key(0, "o", hint))).otherwise(none), F.when(useful, F.array(key(1, "t", short), key(2, "s", short))).otherwise(none)))
        .otherwise(none)
    )
    asked = refs.select("ref", F.col("callee").alias("name"), F.explode(keys).alias("k")).select("ref", "name", "k.tier", "k.by", "k.key")
    found = asked.join(candidate_index(functions), ["by", "name", "key"])
    return found.groupBy("ref").agg(F.min_by("id", "tier").alias("id"), F.min("tier").alias("tier"))


def resolve_calls(g: Graph, refs: DataFrame) -> DataFrame:
    """(src, dst, kind, weight): calls from refs, with those of the graph that an end outside of source files keeps; none to itself."""
    f = g.nodes.where("kind = 'Function'").select("id", "path", "name")
    found = select_candidates(refs, f).join(refs.select("ref", "caller"), "ref")
    new = found.where("caller <> id").select(F.col("caller").alias("src"), F.col("id").alias("dst")).distinct()
    from ..graph import graph_owned

    owned = g.nodes.where(graph_owned()).select("id")
    e = g.edges.where("kind = 'Calls'")
    kept = e.join(owned, e["src"] == owned["id"], "left_semi").union(e.join(owned, e["dst"] == owned["id"], "left_semi")).distinct()
    new = new.select("src", "dst", F.lit("Calls").alias("kind"), F.lit(1.0).cast("float").alias("weight"))
    return kept.select(*new.columns).unionByName(new.join(kept, ["src", "dst"], "left_anti").select(*new.columns))


#: Names that are looked up from one on: a chain that has not ended by then has no end.
LOOKUPS = 16


def follow(starts: DataFrame, imports: DataFrame, most: int = LOOKUPS) -> DataFrame:
    """(start, target) of starts (start) followed through re-exports (name, target) to their end.

    A name that is not re-exported itself goes on by its module's wildcard
    (module::*), if there is one. None in cycles, none where a name or wildcard
    has several targets, none beyond the number of lookups.
    """
    step = materialize(imports.groupBy("name").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")), "reexports")
    named = step.select(F.col("name").alias("k"), F.col("n").alias("k_n"), F.col("target").alias("k_to"))
    wild = step.where(F.endswith("name", F.lit("::*"))).select(F.col("name").alias("w"), F.col("n").alias("w_n"), F.col("target").alias("w_to"))
    at = starts.select("start", F.col("start").alias("at"), F.array().cast("array<string>").alias("seen")).distinct()
    ended = None
    for _ in range(most):
        both = at.where(~F.array_contains("seen", F.col("at"))).join(named, F.col("at") == F.col("k"), "left")
        star = F.when(F.col("k").isNull() & F.contains("at", F.lit("::")), F.concat(module_of(F.col("at")), F.lit("::*")))
        both = both.withColumn("star", star).join(wild, F.col("star") == F.col("w"), "left")
        nxt = F.when(F.col("k_n") == 1, F.col("k_to")).when(F.col("k").isNull() & (F.col("w_n") == 1), F.concat("w_to", F.lit("::"), last_segment(F.col("at"))))
        both = materialize(both.select("start", "at", "seen", nxt.alias("nxt"), (F.col("k").isNull() & F.col("w").isNull()).alias("done")), "chain")
        here = both.where("done").select("start", F.col("at").alias("target"))
        ended = here if ended is None else ended.union(here)
        at = both.where("nxt is not null").select("start", F.col("nxt").alias("at"), F.concat("seen", F.array("at")).alias("seen"))
        if not at.limit(1).count():
            break
    return ended


def reexports(imports: DataFrame, most: int = LOOKUPS) -> DataFrame:
    """(name, target) of all names that are re-exported (name, target), followed to their end."""
    starts = imports.where(~F.endswith("name", F.lit("::*"))).select(F.col("name").alias("start"))
    return follow(starts, imports, most).select(F.col("start").alias("name"), "target")


def aliases(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, state, target) of calls (ref, file, callee) through imports (file, local, target): Resolved, Ambiguous or NotAliased."""
    i = imports.groupBy("file", "local").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    both = calls.join(i, (calls["file"] == i["file"]) & (calls["callee"] == i["local"]), "left")
    return both.select("ref", F.when(F.col("n").isNull(), "NotAliased").when(F.col("n") == 1, "Resolved").otherwise("Ambiguous").alias("state"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


def exact_path(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """(ref, id) of refs (ref, path) whose path one function has."""
    return refs.join(functions.select("path", "id"), "path").groupBy("ref").agg(only("id").alias("id")).where("id is not null")


def factory_owners(calls: DataFrame, producers: DataFrame, owners: DataFrame) -> DataFrame:
    """(ref, owner) of calls (ref, producer) by the return type of producers (name, owner, return_type): Self is its owner, else the only owner (path) whose last segment the type names."""
    p = producers.groupBy("name").agg(only("return_type").alias("return_type"), only("owner").alias("own"))
    both = calls.join(p, F.col("producer") == F.col("name"))
    own = both.where(F.regexp_like("return_type", F.lit(r"\bSelf\b"))).select("ref", F.col("own").alias("owner"))
    tails = owners.select("path", last_segment(F.col("path")).alias("tail"))
    words = both.where(~F.regexp_like("return_type", F.lit(r"\bSelf\b"))).select("ref", F.explode(F.regexp_extract_all("return_type", F.lit(r"(\w+)"), 1)).alias("tail"))
    other = words.join(tails, "tail").groupBy("ref").agg(only("path").alias("owner")).where("owner is not null")
    return own.union(other)


def entry_points(launches: DataFrame, manifest: DataFrame, mains: DataFrame) -> DataFrame:
    """(ref, path) of launches (ref, target): the manifest's (target, path), else src/bin/<target> or the only main (path, file) of all."""
    conventional = mains.select(F.regexp_extract("file", r"src/bin/([^/.]+)", 1).alias("target"), F.col("path").alias("by_name")).where("target <> ''")
    sole = mains.agg(only("path").alias("sole"))
    out = launches.join(manifest.select("target", F.col("path").alias("by_manifest")), "target", "left").join(conventional, "target", "left").join(F.broadcast(sole), F.lit(True))
    return out.select("ref", F.coalesce("by_manifest", "by_name", "sole").alias("path")).where("path is not null")


def universal_routes(calls: DataFrame) -> DataFrame:
    """(helper) of calls (helper, caller, literal): helpers whose every caller passes a literal."""
    return calls.groupBy("helper").agg(F.bool_and(F.col("literal").isNotNull()).alias("all_literal"), F.count(F.lit(1)).alias("callers")).where("all_literal").select("helper", "callers")


def guards(calls: DataFrame) -> DataFrame:
    """(dispatcher, callee, guard) of calls with a guard: kept where all agree."""
    return calls.groupBy("dispatcher", "callee").agg(agreed("guard").alias("guard")).where("guard is not null")


def drop_edges(calls: DataFrame, constructors: DataFrame, drops: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst): callers of a constructor (id, owner) of a type with a drop (owner) to the type's drop function (id, path)."""
    c = calls.join(constructors, calls["dst"] == constructors["id"]).join(drops, "owner", "left_semi").select("src", F.concat("owner", F.lit("::drop")).alias("path"))
    return c.join(functions.select("path", "id"), "path").select("src", F.col("id").alias("dst")).distinct()


def resolve_inherits(refs: DataFrame, types: DataFrame) -> DataFrame:
    """(ref, path) of refs (ref, module, base) by types (path, name): an exact path, else the module's type, else the only one of the name."""
    exact = refs.join(types.select("path"), F.col("base") == F.col("path")).select("ref", F.lit(0).alias("tier"), "path")
    named = refs.join(types, F.col("base") == F.col("name"))
    near = named.where(module_of(F.col("path")) == F.col("module")).select("ref", F.lit(1).alias("tier"), "path")
    return ladder(exact.union(near).union(named.select("ref", F.lit(2).alias("tier"), "path")), "ref", "tier", "path")


def upgraded(claims: DataFrame, inherent: DataFrame, competing: DataFrame, unclean: DataFrame) -> DataFrame:
    """claims (ref, module, owner, method) that may be certain: one inherent method (owner, method), no competing trait's (method), no unclean module (module)."""
    one = inherent.groupBy("owner", "method").count().where("count = 1").select("owner", "method")
    return claims.join(one, ["owner", "method"]).join(competing, "method", "left_anti").join(unclean, "module", "left_anti")


def rebound(claims: DataFrame, literals: DataFrame) -> DataFrame:
    """claims (.., name, class) that are certain become unknown where a literal (text), or its part after the last dot, is their name."""
    names = literals.select(F.element_at(F.split("text", r"\."), -1).alias("name")).distinct().withColumn("hit", F.lit(True))
    return claims.join(names, "name", "left").withColumn("class", F.when(F.col("hit") & (F.col("class") == "must"), "unknown").otherwise(F.col("class"))).drop("hit")


def import_proofs(imports: DataFrame, exports: DataFrame, mocked: DataFrame, dependencies: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """imports (importer, local, file, name[, root]) that are proved: one export (file, name), no mock of the file, no way of imports or other dependencies (importer, file) back to the importer, no blocked root (root)."""
    from .proofs import import_cycles

    one = exports.groupBy("file", "name").count().where("count = 1").select("file", "name")
    good = imports.join(one, ["file", "name"]).join(mocked.select("file").distinct(), "file", "left_anti")
    if blocked is not None:
        good = good.join(blocked.select("root").distinct(), "root", "left_anti")
    # an import leads back to its importer where both ends are in one component
    return good.join(import_cycles(imports, dependencies), ["importer", "file"], "left_anti")


def package_proofs(refs: DataFrame, declarations: DataFrame, constrained: DataFrame) -> DataFrame:
    """(ref, id) of refs (ref, dir, package, name): one declaration (dir, package, name, file, plain, id), plain, in a file without build constraints (file)."""
    keys = ["dir", "package", "name"]
    one = declarations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("file").alias("file"), F.bool_and("plain").alias("plain")).where("n = 1 and plain")
    return refs.join(one.join(constrained, "file", "left_anti"), keys).select("ref", "id")


def lexical_proofs(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """(ref, id) of sites (ref, file, name, at) by scopes (file, name, start, end, id, once): the innermost scope that holds the site, if its name is bound once there."""
    s = scopes.select(F.col("file").alias("f"), F.col("name").alias("n"), "start", "end", "id", "once")
    both = sites.join(s, (F.col("file") == F.col("f")) & (F.col("name") == F.col("n")) & (F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")))
    best = both.groupBy("ref").agg(F.min_by(F.struct("id", "once"), F.struct(F.col("end") - F.col("start"), "id")).alias("b"))
    return best.where("b.once").select("ref", "b.id")


def apply_facts(g: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """New facts of files (nodes, edges) in place of what these files owned before."""
    from dataclasses import replace

    from ..graph import add_edges, remove_nodes, upsert_projection

    files = nodes.select("file").distinct()
    stale = g.nodes.join(files, "file", "left_semi").join(nodes.select("id"), "id", "left_anti")
    out = upsert_projection(remove_nodes(g, stale.select("id")), nodes)
    own = nodes.select(F.col("id").alias("src"))
    old = out.edges.where(F.col("kind").isin("Contains", "DataFlow")).join(own, "src", "left_semi").join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    kept = out.edges.join(old.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti").select(*g.edges.columns)
    return add_edges(replace(out, edges=kept), edges)


def path_occurrences(facts: DataFrame) -> DataFrame:
    """(path, n) counted before rows of one path become one."""
    return facts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def collisions(methods: DataFrame) -> DataFrame:
    """(file, type, method, n) of methods that a type has more than once in a file."""
    return methods.groupBy("file", "type", "method").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bare_proofs(calls: DataFrame, definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """calls (ref, file, name) of a name with one definition (file, name) in the file and no other use (file, name)."""
    one = definitions.groupBy("file", "name").count().where("count = 1").select("file", "name")
    return calls.join(one, ["file", "name"]).join(uses.select("file", "name").distinct(), ["file", "name"], "left_anti")


