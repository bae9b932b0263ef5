import hashlib
import random
import zlib
from itertools import product

import pytest
from pyspark.sql import types as T

from loomgraph.llm import conversation_repair as C
from loomgraph.llm import registry

WS = " \t\n\x0b\x0c\r"
FIELDS = [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def form(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return not initials or (len(body) >= 2 and body == "ua" * (len(body) // 2))


def brute_repair(rows):
    """Every edit sequence, by a search over (row, initials so far): for short conversations only."""
    seen, marks = set(), []
    for role, text in rows:
        t = text.strip(WS)
        fault = "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append(fault)
    best = None

    def go(i, out, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if form("".join(r[:1] for r, _ in out)):
                best = min(best, (cost, audit, out), key=lambda b: b[:2]) if best else (cost, audit, out)
        else:
            role, text = rows[i]
            extra = 3 if marks[i] == "truncated" else 0
            go(i + 1, out, cost + 4, audit + "D", 0)
            if marks[i] not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, out + [(role, text)], cost + extra, audit + "K", 0)
                for new in ("user", "assistant"):
                    go(i + 1, out + [(new, text)], cost + extra + 3, audit + "R", 0)
        if inserted < 2:
            for new in ("user", "assistant"):
                go(i, out + [(new, "")], cost + 3, audit + "I", inserted + 1)

    go(0, [], 0, "", 0)
    return marks, best


def brute(rows):
    """{conv_id: report} of original rows."""
    found = {}
    after = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        marks, (cost, audit, out) = brute_repair([r[2:] for r in own])
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[marks.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
    return found


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(report):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in report.collect()}


def odd_conversations(seed, n):
    r = random.Random(seed)
    texts = ["Hello there.", "what now", "Yes!", "", " \t\n", None, "Hello there.", "no end \x0b", "é ü?", "a\nb."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "useful", "Admin"]
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, 6)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 2, None]), r.choice(roles[: r.choice([3, 10])]), r.choice(texts)))
    return rows + rows[:5] + [(None, None, None, None), (None, 3, "user", "x.")]


def test_layers_against_every_audit():
    """The trie's answers for all short signatures, and no layer is made twice for a shared beginning."""
    signs = sorted("".join(p) for k in range(4) for p in product("suaoSUAOx", repeat=k))
    texts = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    made = 0
    before = C.layer_before

    def counted(*args):
        nonlocal made
        made += 1
        return before(*args)

    C.layer_before = counted
    try:
        found = {s: (c, a) for s, c, a in C.answers(signs)}
    finally:
        C.layer_before = before
    assert made == len({s[: i + 1] for s in signs for i in range(len(s))})
    for s in random.Random(1).sample(signs, 300):
        rows = [("user", " ") if m == "x" else (texts[m.lower()], f"{i} no end" if m.isupper() else f"{i}.") for i, m in enumerate(reversed(s))]
        assert found[s] == brute_repair(rows)[1][:2], s


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = odd_conversations(seed, 60)
    df = spark.createDataFrame(rows, T.StructType(FIELDS))
    report, fixed = C.repair(C.damaged(df), df)
    assert got(report) == brute(rows)
    by = {}
    for r in fixed.orderBy("conv_id", "place").collect():
        by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, row in got(report).items():
        assert hashlib.sha256("\n".join(by.get(conv, [])).encode()).hexdigest() == row[-1]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.queries()["op11_conversation_repair"](spark, sf)) == brute(rows)


def test_long_conversation_and_clashing_columns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"row {i}.", "x", "y", 3) for i in range(4000)]
    df = spark.createDataFrame(rows, T.StructType([*FIELDS, T.StructField("Place", T.StringType()), T.StructField("KIND", T.StringType()), T.StructField("cost", T.LongType())]))
    report, fixed = C.repair(C.damaged(df), df)
    (row,) = report.collect()
    after = brute_damage([r[:4] for r in rows])
    assert row["duplicate"] == sum(a == b for a, b in zip(after, after[1:])) and row["cost"] > 0
    roles = [r["role"] for r in fixed.orderBy("place").collect()]
    assert form("".join(r[0] for r in roles)) and len(row["audit"]) - row["audit"].count("D") == len(roles)
    # costs of the audit's edits, row by row
    assert sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in row["audit"]) <= row["cost"]


def test_empty(spark):
    df = spark.createDataFrame([], T.StructType(FIELDS))
    report, fixed = C.repair(C.damaged(df), df)
    assert report.count() == 0 and fixed.count() == 0
