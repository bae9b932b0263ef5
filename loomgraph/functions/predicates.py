"""Nested any/all/not predicates in three-valued logic, as one Column.

A predicate is cut into tokens; a fold over them keeps a stack of values and
open brackets, and a closing bracket folds what stands above its opening one.
What isn't known is null: false decides ``all`` and true decides ``any``
whatever else is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is known where tests are looked for.
KNOWN = {"unix": True, "windows": False, "test": True, "debug_assertions": True}
KNOWN_VALUES = {"target_os": "linux", "target_family": "unix", "target_arch": "x86_64"}

STACK = "array<struct<op:string,v:boolean>>"
TOKENS = r'(any\s*\(|all\s*\(|not\s*\(|\)|,|[A-Za-z_][\w.]*\s*=\s*"[^"]*"|[A-Za-z_][\w.]*)'


def leaf(token: Column, known: dict[str, bool], values: dict[str, str]) -> Column:
    out = F.lit(None).cast("boolean")
    for name, value in known.items():
        out = F.when(token == name, F.lit(value)).otherwise(out)
    key, value = F.btrim(F.substring_index(token, "=", 1)), F.regexp_extract(token, '"([^"]*)"', 1)
    for name, own in values.items():
        out = F.when(F.contains(token, F.lit("=")) & (key == name), value == own).otherwise(out)
    return out


def cfg_value(predicate: Column, known: dict[str, bool] | None = None, values: dict[str, str] | None = None) -> Column:
    """True, false or, where it can't be told, null; an empty ``all`` is true, an empty ``any`` false; a text that isn't a predicate is null."""
    known, values = KNOWN if known is None else known, KNOWN_VALUES if values is None else values
    item = lambda op, v: F.array(F.struct(F.lit(op).alias("op") if isinstance(op, str) else op.alias("op"), v.cast("boolean").alias("v")))

    def closed(stack: Column) -> Column:
        from_end = F.array_position(F.reverse(F.transform(stack, lambda x: x["op"] != "")), F.lit(True))
        at = (F.size(stack) - from_end + 1).cast("int")
        inner, op = F.slice(stack, at + 1, F.greatest(F.size(stack) - at, F.lit(0))), F.get(stack, at - 1)["op"]
        has = lambda value: F.exists(inner, lambda x: x["v"].eqNullSafe(F.lit(value)))
        folded = (
            F.when(op == "not", F.when(F.size(inner) == 1, ~F.get(inner, F.lit(0))["v"]))
            .when(op == "all", F.when(has(False), False).when(has(None), None).otherwise(True))
            .otherwise(F.when(has(True), True).when(has(None), None).otherwise(False))
        )
        return F.when(from_end > 0, F.concat(F.slice(stack, 1, F.greatest(at - 1, F.lit(0))), item("", folded))).otherwise(F.concat(stack, item("", F.lit(None)), item("", F.lit(None))))

    def step(stack: Column, token: Column) -> Column:
        word = F.regexp_extract(token, r"^(any|all|not)\s*\($", 1)
        return F.when(word != "", F.concat(stack, item(word, F.lit(None)))).when(token == ")", closed(stack)).when(token == ",", stack).otherwise(F.concat(stack, item("", leaf(token, known, values))))

    stack = F.aggregate(F.regexp_extract_all(predicate, F.lit(TOKENS), F.lit(1)), F.array().cast(STACK), step)
    return F.when((F.size(stack) == 1) & (F.get(stack, F.lit(0))["op"] == ""), F.get(stack, F.lit(0))["v"])
