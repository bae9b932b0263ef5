"""Source files into facts: definitions, fields, calls, supertypes and imports.

Python is read with its own parser; Rust, Go and TypeScript with a small
scanner that masks strings and comments and matches braces. What a scanner
can't be sure of becomes no fact, or a claim of class unknown.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.idents import module_of, node_id
from ..functions.idents import module_path as file_module
from ..functions.predicates import cfg_value
from ..graph import Graph
from ..operators.proofs import certain_calls, owners
from ..operators.resolve import resolve_inherits, select_candidates
from ..schema import SPAN

FACTS = "fact string, file string, lang string, path string, owner string, kind string, name string, start long, stop long, row int, col int, source string, qualifier string, receiver string, shadowed boolean, test boolean, returns string"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]


def module_path(file: str) -> str:
    bare = re.sub(r"\.[^./]+$", "", re.sub(r"^(\./)?(src/)?", "", file))
    return "::".join(["crate", *(p for p in bare.split("/") if p and p not in ("mod", "lib", "main", "__init__"))])


class Facts:
    def __init__(self, file: str, lang: str, source: str):
        self.file, self.lang, self.source, self.rows = file, lang, source, []
        self.module = module_path(file)
        lines = source.split("\n")
        self.starts = [0]
        for line in lines:
            self.starts.append(self.starts[-1] + len(line.encode()) + 1)
        self.define("Module", self.module, None, self.module.split("::")[-1], 0, len(source.encode()), source)

    def add(self, fact, **more):
        self.rows.append({c: None for c in COLUMNS} | {"fact": fact, "file": self.file, "lang": self.lang} | more)

    def define(self, kind, path, owner, name, start, stop, text, test=False, returns=None):
        row = max(0, next((k for k, s in enumerate(self.starts) if s > start), len(self.starts)) - 1)
        self.add("def", kind=kind, path=path, owner=owner, name=name, start=start, stop=stop, row=row, col=start - self.starts[row], source=text, test=test, returns=returns)

    def call(self, caller, qualifier, name, start, receiver=None, shadowed=False, kind=None):
        self.add("call", path=caller, qualifier=qualifier or None, name=name, start=start, receiver=receiver, shadowed=shadowed, kind=kind)

    def use(self, name, role, start, path=None):
        self.add("use", name=name, kind=role, start=start, path=path)

    def region(self, kind, start, stop):
        """What can run or change code without a call of its own: a macro, an attribute, an operator."""
        self.add("region", kind=kind, start=start, stop=stop)


def python_facts(file: str, source: str) -> list[dict]:
    out = Facts(file, "python", source)
    lines = source.split("\n")
    encoded = [line.encode() for line in lines]
    tests = bool(re.search(r"(^|/)(test[^/]*|[^/]*_test)\.py$", file))

    def at(node, end=False):
        row, col = (node.end_lineno, node.end_col_offset) if end else (node.lineno, node.col_offset)
        return out.starts[row - 1] + min(col, len(encoded[row - 1]))

    def typed(annotation):
        """The one owner that an annotation names; None if there is none or more."""
        if annotation is None:
            return None
        if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
            try:
                annotation = ast.parse(annotation.value, mode="eval").body
            except SyntaxError:
                return None
        if isinstance(annotation, ast.Subscript) and isinstance(annotation.value, ast.Name) and annotation.value.id == "Optional":
            return typed(annotation.slice)
        if isinstance(annotation, ast.BinOp) and isinstance(annotation.op, ast.BitOr):
            sides = {typed(s) for s in (annotation.left, annotation.right) if not (isinstance(s, ast.Constant) and s.value is None)}
            return sides.pop() if len(sides) == 1 else None
        return annotation.id if isinstance(annotation, ast.Name) else annotation.attr if isinstance(annotation, ast.Attribute) else None

    def dotted(e):
        parts = []
        while isinstance(e, ast.Attribute):
            parts.append(e.attr)
            e = e.value
        return ".".join([e.id, *reversed(parts)]) if isinstance(e, ast.Name) else None

    def body(nodes, path, kind, hints, bound, nested):
        """Statements in order: the last binding before a call is what a receiver is."""
        for n in nodes:
            visit(n, path, kind, hints, bound, nested)

    def visit(n, path, kind, hints, bound, nested):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own = f"{path}::{n.name}"
            for d in n.decorator_list:
                visit(d, path, kind, hints, bound, nested)
            out.define("Function", own, path, n.name, at(n), at(n, True), ast.get_source_segment(source, n) or "", tests and n.name.startswith("test") and not nested, ast.unparse(n.returns) if n.returns else None)
            args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
            names = {a.arg for a in args} | {t.id for s in ast.walk(n) if isinstance(s, (ast.Assign, ast.For, ast.With)) for t in ast.walk(s) if isinstance(t, ast.Name) and isinstance(t.ctx, ast.Store)}
            body(n.body, own, "Function", hints | {a.arg: typed(a.annotation) for a in args}, bound | names, True)
        elif isinstance(n, ast.ClassDef):
            own = f"{path}::{n.name}"
            out.define("Type", own, path, n.name, at(n), at(n, True), ast.get_source_segment(source, n) or "")
            for b in n.bases:
                if base := dotted(b):
                    out.add("inherit", path=own, name=base.split(".")[-1])
            for s in n.body:
                for t in [s.target] if isinstance(s, ast.AnnAssign) else s.targets if isinstance(s, ast.Assign) else []:
                    if isinstance(t, ast.Name):
                        out.define("Field", f"{own}::{t.id}", own, t.id, at(s), at(s, True), ast.get_source_segment(source, s) or "")
            body(n.body, own, "Type", dict(hints), bound, nested)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            for a in n.names:
                target = f"{n.module}.{a.name}" if isinstance(n, ast.ImportFrom) and n.module else a.name
                if a.name != "*":
                    out.add("import", path=path, name=a.asname or a.name.split(".")[0], source="crate::" + target.replace(".", "::"))
        else:
            if isinstance(n, ast.Call):
                name = dotted(n.func)
                if name:
                    q, _, last = name.rpartition(".")
                    out.call(path, q, last, at(n), hints.get(q), not q and last in bound)
                elif isinstance(n.func, ast.Attribute):
                    out.call(path, "()", n.func.attr, at(n))
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self":
                out.add("flow", path=path, name=n.attr)
            for child in ast.iter_child_nodes(n):
                visit(child, path, kind, hints, bound, nested)
            if isinstance(n, (ast.Assign, ast.AnnAssign)):
                made = n.value.func.id if isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id[:1].isupper() else None
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        hints[t.id] = typed(n.annotation) if isinstance(n, ast.AnnAssign) else made

    try:
        tree = ast.parse(source)
    except SyntaxError:
        out.add("gap", path=out.module, name="parse-error")
        return out.rows
    body(tree.body, out.module, "Module", {}, set(), False)
    out.add("gap", path=out.module, name="implicit-runtime-dispatch-not-certified")
    python_uses(out, tree, at)
    return out.rows


def python_uses(out: Facts, tree, at) -> None:
    """Every occurrence of a name with its role, and what may run code without a call."""
    top = {id(n) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not n.decorator_list}
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Name):
            out.use(n.id, "call" if id(n) in called else "other", at(n))
            if id(n) in called and n.id in ("exec", "eval", "compile"):
                out.add("gap", name="blocked")
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.use(n.name, "definition" if id(n) in top else "other", at(n), f"{out.module}::{n.name}" if id(n) in top else None)
            for d in n.decorator_list:
                out.region("attribute", at(d), at(d, True))
        elif isinstance(n, ast.alias):
            if n.name == "*":
                out.add("gap", name="blocked")
            for name in {*n.name.split("."), n.asname or ""} - {""}:
                out.use(name, "other", at(n))
        elif isinstance(n, ast.Constant) and isinstance(n.value, str):
            # a string can rebind: setattr, patch, globals()[...]
            out.use(n.value.rsplit(".", 1)[-1][:200], "other", at(n))
        elif isinstance(n, (ast.BinOp, ast.Compare, ast.UnaryOp)):
            out.region("operator", at(n), at(n, True))
        else:
            names = [getattr(n, a, None) for a in ("arg", "attr", "name", "rest")] + list(getattr(n, "names", []))
            for name in names:
                if isinstance(name, str):
                    out.use(name, "other", at(n) if hasattr(n, "lineno") else 0)


MASKS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'", re.DOTALL)
# Words before a bracket that are no calls.
NOISE = ("if", "while", "for", "match", "return", "fn", "loop", "in", "as", "move", "func", "switch", "select", "go", "defer", "range", "function", "catch", "typeof", "new", "await", "super", "constructor")
FORMS = {
    "rust": [("Function", r"\bfn\s+(\w+)"), ("Type", r"\b(?:struct|enum|trait)\s+(\w+)"), ("Impl", r"\bimpl\b(?:<[^>]*>)?\s*(?:(\w+)(?:<[^>]*>)?\s+for\s+)?(\w+)")],
    "go": [("Function", r"\bfunc\s+(\w+)\s*[(\[]"), ("Method", r"\bfunc\s*\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)\s*\("), ("Type", r"\btype\s+(\w+)\s+(?:struct|interface)")],
    "typescript": [("Function", r"\bfunction\s*\*?\s*(\w+)"), ("Function", r"\b(?:const|let)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=\n]+)?=>"), ("Type", r"\b(?:class|interface)\s+(\w+)(?:\s+extends\s+(\w+))?"), ("Member", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(\w+)\s*\([^()\n]*\)\s*(?::[^{\n]+)?\{")],
}
IMPORTS = {
    "rust": r"\buse\s+([\w:]+)(?:\s+as\s+(\w+))?\s*;",
    "go": r"\bimport\s+(?:(\w+)\s+)?\"([^\"]+)\"",
    "typescript": r"\bimport\s*\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]",
}


def scanned_facts(file: str, lang: str, source: str) -> list[dict]:
    out = Facts(file, lang, source)
    form = "typescript" if lang == "tsx" else lang
    blank = lambda text: re.sub(r"[^\n]", " ", text)
    code = MASKS.sub(lambda m: blank(m[0]), source)
    offset = (lambda k: k) if source.isascii() else (lambda k: len(source[:k].encode()))
    attributes: list[tuple[int, int]] = []
    for m in re.finditer(r"#!?\[", code) if form == "rust" else re.finditer(r"@[\w.]+(?:\([^()]*\))?", code) if form == "typescript" else ():
        attributes.append((m.start(), bracket(code, m.end() - 1) if form == "rust" else m.end()))
    for a, b in attributes:
        out.region("attribute", offset(a), offset(b))
        if form != "rust" or re.sub(r"\s", "", source[a:b]) not in ("#[test]", "#[tokio::test]"):
            out.add("gap", name="blocked")
        code = code[:a] + blank(code[a:b]) + code[b:]

    def end_of(k):
        """After the block that opens next; the end of the statement if none does."""
        open_, stop = code.find("{", k), code.find(";", k)
        if open_ < 0 or 0 <= stop < open_:
            return (stop if stop >= 0 else len(code) - 1) + 1
        depth = 0
        for m in re.compile(r"[{}]").finditer(code, open_):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.end()
        return len(code)

    found = []
    for kind, pattern in FORMS[form]:
        for m in re.finditer(pattern, code, re.MULTILINE):
            if kind == "Member" and m[1] in NOISE:
                continue
            found.append((m.start(), end_of(m.end()), kind, m))
    found.sort(key=lambda x: (x[0], -x[1]))
    scopes: list[tuple[int, int, str, str]] = []  # start, end, path, kind
    seen: dict[str, int] = {}
    for start, stop, kind, m in found:
        holders = [s for s in scopes if s[0] <= start and stop <= s[1]]
        top = holders[-1] if holders else (0, len(code), out.module, "Module")
        if kind == "Impl":
            own = f"{out.module}::{m[2]}"
            scopes.append((start, stop, own, "Type"))
            if m[1]:
                out.add("inherit", path=own, name=m[1])
                if m[1] == "Drop":
                    out.add("drop", path=own)
            continue
        owner, name = (f"{out.module}::{m[1]}", m[2]) if kind == "Method" else (top[2], m[1])
        if kind == "Member" and top[3] != "Type":
            continue
        path = f"{owner}::{name}"
        seen[path] = seen.get(path, 0) + 1
        if seen[path] > 1:
            path = f"{path}#{seen[path]}"
        own = [source[a:b] for a, b in attributes if b <= start and not re.search(r"[;{}]", code[b:start])] if form == "rust" else []
        for a in own:
            if c := re.match(r"#\[\s*cfg\s*\((.*)\)\s*\]$", a, re.DOTALL):
                out.add("cfg", path=path, source=c[1])
        test = {
            "rust": any(re.match(r"#\[\s*(?:\w+::)*(?:test|rstest)\b", a) for a in own),
            "go": file.endswith("_test.go") and bool(re.match(r"(Test|Benchmark|Fuzz|Example)(?![a-z])", name)),
        }.get(form, False)
        sort = "Type" if kind == "Type" else "Function"
        returns = re.search(r"->\s*([^{;]+)", code[m.end() : code.find("{", m.end())]) if form == "rust" else None
        out.define(sort, path, owner, name, offset(start), offset(stop), source[start:stop], test, returns[1].strip() if returns else None)
        if kind == "Type" and form == "typescript" and m[2]:
            out.add("inherit", path=path, name=m[2])
        if kind == "Type":
            for f in re.finditer(r"^\s*(?:pub\s+)?(\w+)\s*:\s*\w" if form != "go" else r"^\s+(\w+)\s+[\w*\[\].]+\s*$", code[start:stop], re.MULTILINE):
                out.define("Field", f"{path}::{f[1]}", path, f[1], offset(start + f.start(1)), offset(start + f.end()), f[0].strip())
        scopes.append((start, stop, path, sort))
    functions = [s for s in scopes if s[3] == "Function"]
    heads = {m.start(1 if kind != "Method" else 2) for _, _, kind, m in found if kind in ("Function", "Method", "Member")}
    for m in re.finditer(r"((?:\w+(?:::|\.))*)(\w+)\s*\(", code):
        if m[2] in NOISE or m.start(2) in heads or m[2].isdigit():
            continue
        inner = [s for s in functions if s[0] <= m.start() < s[1]]
        caller = min(inner, key=lambda s: s[1] - s[0])[2] if inner else out.module
        q = re.sub(r"(::|\.)$", "", m[1])
        made = bool(re.search(r"\bnew\s+$", code[max(0, m.start() - 16) : m.start()]))
        out.call(caller, {"this": "self", "super": "self"}.get(q, q), m[2], offset(m.start()), kind="new" if made else None)
    tops = {m.start(1): f"{out.module}::{m[1]}" for start, stop, kind, m in found if kind == "Function" and m[0].lstrip().startswith(("fn", "func")) and not any(a < start < b for a, b, _, _ in scopes) and code[m.end() : stop].rstrip().endswith("}") and "extern" not in code[max(0, start - 40) : start].rsplit("}", 1)[-1].rsplit(";", 1)[-1]}
    scanned_uses(out, form, code, source, offset, tops)
    if form == "typescript":
        for m in re.finditer(r"\b(?:it|test)\s*\(\s*(['\"`])(.*?)\1", source):
            path = f"{out.module}::@test[{m[2].encode().hex()}]"
            seen[path] = seen.get(path, 0) + 1
            stop = end_of(m.end())
            out.define("Function", f"{path}#{seen[path]}", out.module, m[2], offset(m.start()), offset(stop), source[m.start() : stop], True)
    if form == "rust":
        for start, stop, path, sort in functions:
            text = source[start:stop]
            for target, literal, parameter in launches(text):
                out.add("launch", path=path, name=target, source=literal, start=parameter)
            for callee, literal in dispatch_guards(text):
                out.add("guard", path=path, name=callee, source=literal)
    for m in re.finditer(IMPORTS[form], source):
        if form == "rust":
            out.add("import", path=out.module, name=m[2] or m[1].split("::")[-1], source=m[1])
        elif form == "go":
            out.add("import", path=out.module, name=m[1] or m[2].split("/")[-1], source=m[2])
        else:
            for part in filter(None, (p.strip() for p in m[1].split(","))):
                a, _, b = part.partition(" as ")
                out.add("import", path=out.module, name=(b or a).strip(), source=f"{m[2]}::{a.strip()}")
    return out.rows


# Macros of the standard library that evaluate their arguments as they stand.
ASSERTS = ("assert", "assert_eq", "assert_ne", "debug_assert", "debug_assert_eq", "debug_assert_ne")


def bracket(code: str, k: int) -> int:
    """After the bracket that closes the one at k; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(code, k):
        depth += 1 if m[0] in "([{" else -1
        if depth <= 0:
            return m.end()
    return len(code)


def scanned_uses(out: Facts, form: str, code: str, source: str, offset, tops: dict[int, str]) -> None:
    """Every identifier with its role: what isn't surely a definition or a call is other. Macros are regions; in all but the standard assertions nothing is a call."""
    opaque: list[tuple[int, int]] = []
    if form == "rust":
        own = re.search(rf"\bmacro_rules\s*!\s*(?:{'|'.join(ASSERTS)})\b|\buse\b[^;]*\b(?:{'|'.join(ASSERTS)})\b", code)
        for m in re.finditer(r"\b(\w+)\s*!\s*(?:\w+\s*)?(?=[(\[{])", code):
            stop = bracket(code, m.end())
            trusted = m[1] in ASSERTS and not own and not re.search(r"[{|]|\blet\b|\bfn\b|\w\s*!\s*[(\[{]", code[m.end() : stop])
            if not trusted:
                opaque.append((m.start(), stop))
            if m[1] != "macro_rules":
                out.region("assertion" if trusted else "macro", offset(m.start()), offset(stop))
        if re.search(r"\blet\b|\bfor\b|\bimpl\b|[-+*/%?\[]|[<>=]=", code):
            out.add("gap", path=out.module, name="implicit-drop-or-operator-dispatch-not-certified")
    elif form == "typescript":
        out.add("gap", path=out.module, name="implicit-runtime-dispatch-not-certified")
        if not re.search(r"^\s*(?:export|import)\b", code, re.MULTILINE):
            out.add("gap", name="blocked")
    elif re.search(r"^\s*//go:", source, re.MULTILINE):
        out.add("gap", path=out.module, name="go-build-or-compiler-directive-not-certified")
    at = 0
    for m in re.finditer(r"[A-Za-z_$][\w$]*", code):
        if m[0] in NOISE or m[0] == "fn" or m[0] == "func":
            continue
        while at < len(opaque) and opaque[at][1] <= m.start():
            at += 1
        hidden = at < len(opaque) and opaque[at][0] <= m.start()
        before, after = code[max(0, m.start() - 16) : m.start()], code[m.end() : m.end() + 16].lstrip()
        called = after.startswith("(") and not re.search(r"(?:\.|::|->|\bnew|\bfn|\bfunc|\bfunction|\*)\s*$", before)
        if path := tops.get(m.start()):
            out.use(m[0], "definition", offset(m.start()), path)
        else:
            out.use(m[0], "call" if called and not hidden else "other", offset(m.start()))


def identifier_spans(source: str, name: str) -> list[tuple[int, int]]:
    """Byte spans of an identifier in code, outside of strings and comments."""
    code = MASKS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    found = re.finditer(rf"(?<![\w]){re.escape(name)}(?![\w])", code)
    return [(len(source[: m.start()].encode()), len(source[: m.end()].encode())) for m in found]


def launches(source: str) -> list[tuple[str, str | None, int | None]]:
    """(target, literal, parameter) of a Rust test's launches of a package's binary: the first argument's literal, or the place of the parameter that it is."""
    out = []
    for m in re.finditer(r'env!\s*\(\s*"CARGO_BIN_EXE_([\w-]+)"\s*\)', source):
        arg = re.compile(r'\.arg\s*\(\s*(?:"([^"]*)"|&?(\w+))').search(source, m.end(), m.end() + 400)
        parameter = None
        if arg and arg[2]:
            heads = list(re.finditer(r"\bfn\s+\w+\s*(?:<[^>]*>)?\(([^)]*)\)", source[: m.start()]))
            names = [p.split(":")[0].strip() for p in heads[-1][1].split(",")] if heads else []
            parameter = names.index(arg[2]) if arg[2] in names else None
        out.append((m[1], arg[1] if arg else None, parameter))
    return out


def dispatch_guards(source: str) -> list[tuple[str, str]]:
    """(callee, literal) of the arms of a Rust match that call on one literal."""
    return [(m[2], m[1]) for m in re.finditer(r'(?:Some\(\s*)?"([^"]+)"\s*\)?\s*=>\s*\{?\s*(?:return\s+)?(\w+)\s*\(', source)]


def facts_of(file: str, lang: str, source: str) -> list[dict]:
    return python_facts(file, source) if lang == "python" else scanned_facts(file, lang, source)


def extract(files: DataFrame) -> DataFrame:
    """Facts of files (path, lang, source), file by file."""

    def run(frames):
        for frame in frames:
            rows = [r for f in frame.itertuples(index=False) for r in facts_of(f.path, f.lang, f.source)]
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("start", "stop", "row", "col"):
                out[c] = out[c].astype("Int64")
            yield out

    return files.select("path", "lang", "source").mapInPandas(run, FACTS)


def call_facts(facts: DataFrame) -> DataFrame:
    """Calls with their number (ref), which stays the same as long as the call's place does."""
    return facts.where("fact = 'call'").withColumn("ref", F.xxhash64("file", "path", "start", "qualifier", "name"))


def call_refs(calls: DataFrame) -> DataFrame:
    """Calls as references to be resolved."""
    return calls.select("ref", node_id(F.col("path")).alias("caller"), F.col("path").alias("caller_path"), F.col("name").alias("callee"), "qualifier", F.col("receiver").alias("receiver_type"), F.lit(True).alias("qualifier_owner_fallback"), F.col("shadowed").alias("shadowed_by_local"), file_module(F.col("file")).alias("caller_module"))


def function_candidates(defs: DataFrame) -> DataFrame:
    """Definitions of functions (path, name, file) as candidates."""
    return defs.where("kind = 'Function'").select(node_id(F.col("path")).alias("id"), "path", "name", file_module(F.col("file")).alias("module")).dropDuplicates(["id"])


def build(facts: DataFrame, found: DataFrame | None = None) -> Graph:
    """The graph of facts: nodes, containment, data flow, calls and supertypes by the only candidate, and a claim for each call.

    found: (ref, id) of the calls' resolution, where that is known already.
    """
    d = facts.where("fact = 'def'")
    attributes = F.map_filter(F.create_map(F.lit("is_test"), F.when(F.col("test"), F.lit("true")), F.lit("return_type"), F.col("returns")), lambda k, v: v.isNotNull())
    span = F.struct(F.col("start").alias("start_byte"), F.col("stop").alias("end_byte"), F.col("row").alias("start_row"), F.col("col").alias("start_col")).cast(SPAN)
    # a test that is configured away is none; what can't be told stays one
    off = facts.where("fact = 'cfg'").select("path", cfg_value(F.col("source")).alias("on")).where("not on").select("path").distinct().withColumn("off", F.lit(True))
    d = d.join(off, "path", "left").withColumn("test", F.col("test") & F.col("off").isNull())
    nodes = d.select(node_id(F.col("path")).alias("id"), "kind", "name", "path", F.col("lang").alias("language"), "file", span.alias("span"), "source", attributes.alias("attributes"))
    nodes = nodes.dropDuplicates(["id"])
    one = F.lit(1.0).cast("float").alias("weight")
    of = lambda df, a, b, kind: df.select(node_id(a).alias("src"), node_id(b).alias("dst"), F.lit(kind).alias("kind"), one)
    ids = nodes.select("id")
    edges = of(d.where("owner is not null"), F.col("owner"), F.col("path"), "Contains")
    flows = facts.where("fact = 'flow'").select("path", F.concat_ws("::", module_of(F.col("path")), "name").alias("field")).distinct()
    flows = flows.join(d.where("kind = 'Field'").select(F.col("path").alias("field")), "field", "left_semi")
    edges = edges.union(of(flows, F.col("path"), F.col("field"), "DataFlow"))
    types = d.where("kind = 'Type'").select("path", "name").distinct()
    inherits = facts.where("fact = 'inherit'").select(F.col("path").alias("ref"), module_of(F.col("path")).alias("module"), F.col("name").alias("base")).distinct()
    edges = edges.union(of(resolve_inherits(inherits, types), F.col("ref"), F.col("path"), "Inherits"))
    calls = call_facts(facts)
    refs = call_refs(calls)
    if found is None:
        found = select_candidates(refs, function_candidates(d))
    made = found.join(refs.select("ref", "caller"), "ref").where("caller <> id").select(F.col("caller").alias("src"), F.col("id").alias("dst"), F.lit("Calls").alias("kind"), one)
    edges = edges.union(made).distinct()
    edges = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
    # a call is certain by the proof over all occurrences of its name; every other one is unknown, and its edge is not certified
    modules = d.where("kind = 'Module'").select("file", F.col("path").alias("module"))
    spans = d.where("kind = 'Function'").select(F.col("path").alias("owner"), "file", F.col("start").alias("o_start"), F.col("stop").alias("o_end"))
    regions = facts.where("fact = 'region'").select(F.xxhash64("file", "kind", "start", "stop").alias("site"), "file", F.col("start").alias("start"), F.col("stop").alias("end"), F.col("kind").alias("region"))
    regions = owners(regions.distinct(), spans, modules)
    macros = regions.where("region = 'macro'")
    # a macro outside of functions may rewrite the whole file
    whole = macros.join(modules, "file").where("owner = module").select("file")
    blocked = facts.where("fact = 'gap' and name in ('blocked', 'parse-error')").select("file").union(whole)
    blocked = blocked.union(d.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where("n > 1").select("file"))
    uses = facts.where("fact = 'use'").select("file", "name", F.col("kind").alias("role"), "path")
    bare = calls.where("qualifier is null and kind is null").select("ref", "file", "name", F.col("path").alias("caller"))
    sure = certain_calls(bare, uses, blocked, macros.select(F.col("owner").alias("caller")))
    asserted = regions.where("region = 'assertion'").select(F.col("owner").alias("a_owner"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    text = nodes.select(F.col("id").alias("caller"), node_id(F.coalesce("source", F.lit(""))).alias("source_fingerprint"))
    here = calls.select("ref", F.col("path").alias("caller_path"), "start", F.length("name").alias("n"), "lang")
    inside = here.join(asserted, (F.col("caller_path") == F.col("a_owner")) & (F.col("start") >= F.col("a_start")) & (F.col("start") < F.col("a_end"))).select("ref", F.lit(True).alias("asserted")).distinct()
    c = here.join(sure, "ref", "left").join(inside, "ref", "left").withColumn("caller", node_id(F.col("caller_path")))
    proof = F.when(F.col("asserted"), "proven-call-inside-trusted-assertion-macro").when(F.col("lang").isin("typescript", "tsx"), "proven-typescript-lexical-binding").otherwise("proven-top-level-lexical-binding")
    none = lambda t: F.lit(None).cast(t)
    no_targets, no_words = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    site = lambda start, end: F.struct(start.alias("start_byte"), end.alias("end_byte"), F.lit(0).alias("start_row"), F.lit(0).alias("start_col")).cast(SPAN)
    found_target = F.col("target").isNotNull()
    rows = c.select("caller", site(F.col("start"), F.col("start") + F.col("n")).alias("site"), F.when(found_target, "must").otherwise("unknown").alias("class"), F.when(found_target, F.array(node_id(F.col("target")))).otherwise(no_targets).alias("targets"), F.when(found_target, proof).otherwise("unproven-call-site").alias("reason"), F.lit(False).alias("coverage_gap"))
    why = F.when(F.col("region") == "operator", "implicit-operator-dispatch-not-certified").otherwise("unexpanded-macro-or-decorator")
    unknown = lambda start, end, reason: [site(start, end), F.lit("unknown"), no_targets, reason, F.lit(True)]
    rows = rows.union(regions.where("region <> 'assertion'").select(node_id(F.col("owner")), *unknown(F.col("start"), F.col("end"), why)))
    gaps = facts.where("fact = 'gap' and path is not null").select("file", "path", "name").distinct().join(d.where("kind = 'Module'").select("file", "start", "stop"), "file")
    rows = rows.union(gaps.select(node_id(F.col("path")), *unknown(F.col("start"), F.col("stop"), F.col("name"))))
    assumed = F.when(F.col("language").isin("python", "typescript", "tsx"), F.array(F.lit("indexed-source-snapshot"), F.lit("no-runtime-rebinding-or-monkey-patching"))).otherwise(F.array(F.lit("indexed-source-snapshot")))
    said = nodes.select(F.col("id").alias("caller"), assumed.alias("assumptions"))
    claims = rows.join(text, "caller").join(said, "caller").select("caller", F.lit(1).alias("version"), "source_fingerprint", "assumptions", "site", "class", "targets", "reason", "coverage_gap")
    # functions and modules without calls say so: without a claim their evidence would be missing
    idle = nodes.where("kind in ('Function', 'Module')").select(F.col("id").alias("caller")).join(claims.select("caller"), "caller", "left_anti").join(text, "caller")
    idle = idle.select("caller", F.lit(1), "source_fingerprint", F.array().cast("array<string>"), none(SPAN), none("string"), F.array().cast("array<bigint>"), none("string"), F.lit(False))
    return Graph(nodes, edges.select("src", "dst", "kind", "weight"), claims.distinct().union(idle))
