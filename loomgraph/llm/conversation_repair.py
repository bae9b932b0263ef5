"""Conversations brought into the form of turns by the cheapest edits.

A conversation's rows, by turn, should have role initials ``(s?(ua)+)?``: at
most one system row at the start, then users and assistants by turns. Rows have
at most one fault, the first of: blank (no character that isn't white space),
duplicate (role and text seen earlier in the conversation), truncated (the last
such character isn't one of ``.!?``). Edits are Keep (0), Rerole to user or
assistant (3), Delete (4; the only one for blank and duplicate rows) and Insert
of a user or assistant row without text (3); a truncated row that stays adds 3.

What the edits cost hangs on roles and faults alone: a conversation's signature
has one character a row. Signatures are written from the last row to the first,
made distinct, dealt by ranges and sorted, so equal beginnings lie together: a
task walks them as a prefix trie, keeps one layer of the dynamic program for
each node on the way to the current one, and computes a layer once for all
signatures that share it. A layer has, for each state of the form (nothing yet,
after system, user, assistant), the least cost from there to the end and the
first edit of it. Read backwards, every edit leads to one state, so of equal
costs the least first letter gives the ASCII-least audit, and the answer stands
at the node where a signature ends.

Rows and their signatures are DataFrame windows; a conversation's text goes
through a task row by row, in order, and is never held whole.

Defined cases: null ids are one conversation, whose id stays null; a null role
or text reads as one space, so such a text is blank and such a role can't be
kept; null turns come first and count for no gap; rows of one turn go by role
and then text, and repeated rows are duplicates; an empty role has no initial
and can't be kept; very long texts and conversations are gone through whole; no
rows give no rows; other columns of the input are not looked at, whatever their
names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What follows each state besides system, which only stands at the start.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: A signature's characters: the role's initial (``o`` for any other), in upper case where truncated; ``x`` must be deleted.
MUST_GO = "x"


def last_layer() -> list[tuple[int, str]]:
    """Per state the least cost and the first edit behind the last row: nothing may follow at the start and after an assistant."""
    return with_inserts([(0, ""), (FAR, ""), (FAR, ""), (0, "")])


def with_inserts(layer: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Inserts before the row: two in a row at most pay, since the second leads on from the other role."""
    user, assistant = layer[USER], layer[ASSISTANT]
    out = list(layer)
    out[USER] = min(user, (assistant[0] + INSERT, "I"))
    out[ASSISTANT] = min(assistant, (user[0] + INSERT, "I"))
    for state in (START, SYSTEM):
        out[state] = min(layer[state], (out[USER][0] + INSERT, "I"))
    return out


def layer_before(row: str, after: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The layer of the states before a row of this kind, from the one behind it."""
    out = []
    for state in range(4):
        best = (after[state][0] + DELETE, "D")
        if row != MUST_GO:
            role, stays = row.lower(), TRUNCATED * row.isupper()
            if role == "s" and state == START:
                best = min(best, (after[SYSTEM][0] + stays, "K"))
            if role == "ua"[NEXT[state] - USER]:
                best = min(best, (after[NEXT[state]][0] + stays, "K"))
            best = min(best, (after[NEXT[state]][0] + REROLE + stays, "R"))
        out.append(best)
    return with_inserts(out)


def audit_of(reversed_rows: str, layers: list[list[tuple[int, str]]]) -> str:
    """The edits from the start of the conversation, whose rows are read from the end of the signature."""
    at, state, out = len(reversed_rows), START, []
    while edit := layers[at][state][1]:
        out.append(edit)
        if edit != "I":
            at -= 1
        if edit == "K" and reversed_rows[at].lower() == "s":
            state = SYSTEM
        elif edit != "D":
            state = NEXT[state]
    return "".join(out)


def answers(signatures):
    """(signature, cost, audit) of sorted signatures: the layers of the trie's path to the last one are kept, those of the shared beginning used again."""
    path, layers = "", [last_layer()]
    for signature in signatures:
        shared = 0
        for a, b in zip(path, signature, strict=False):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :]
        for row in signature[shared:]:
            layers.append(layer_before(row, layers[-1]))
        path = signature
        yield signature, layers[-1][START][0], audit_of(signature, layers)


def solved(batches):
    def texts():
        for batch in batches:
            yield from batch.column(0).to_pylist()

    for some in in_batches(answers(texts())):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["signature", "cost", "audit"])


def in_batches(rows, count: int = 4096, size: int = 1 << 22):
    """Lists of rows, up to so many and about so many characters."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= count or held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with known damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv_id), F.lit(":"), shown(turn)).cast("binary")) % 20
    out = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("kind")).where("kind != 0")
    out = out.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "times")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with place (from 1), fault (blank, duplicate, truncated or null), mark (the signature's character), illegal and new_turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial: Column = F.substring("role", 1, 1)
    out = rows.withColumn("place", F.row_number().over(order)).withColumn("pair", F.concat(F.lag(initial).over(order), initial))
    out = out.withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)))
    # equal rows lie together in place: the first of a role and text is the one of the least place
    out = out.withColumn("first", F.min("place").over(Window.partitionBy("conv_id", "role", "text")))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    out = out.withColumn("fault", fault)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    out = out.withColumn("mark", F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(role)).otherwise(role))
    legal = F.coalesce(F.col("pair").isin("su", "ua", "au"), F.lit(False))
    return out.select("conv_id", "turn", "role", "text", "place", "fault", "mark", "new_turn", ((F.col("place") > 1) & ~legal).alias("illegal"))


def signatures(rows: DataFrame) -> DataFrame:
    """For each conversation its signature, last row first, and its counts; rows as faults() gives them."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    turn = F.max("turn") - F.min("turn") + 1 - F.sum(F.when(F.col("new_turn"), 1).otherwise(0))
    # by place; a struct of three numbers and letters a row is all that is gathered
    marks = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("at"), F.col("mark").alias("mark"))))
    return rows.groupBy("conv_id").agg(
        F.coalesce(turn, F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(marks, lambda m: m["mark"]), "").alias("signature"),
    )


def edits(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures of found."""
    distinct = found.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(solved, "signature string, cost long, audit string")


def rewritten(rows, audit: str):
    """The repaired (role, text) of rows in order, one by one."""
    state = START
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = SYSTEM if edit == "K" and row[0][:1] == "s" else NEXT[state]
        yield row if edit == "K" else (NAMES[state], "" if row is None else row[1])


#: Bytes that one task hands on at a time.
CHUNK = 1 << 22


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations.

    rows: (conv_id, place, role, text), audits: (conv_id, audit). An audit
    travels as its conversation's first row, once, and rows stream behind it.
    """
    return streamed(rows, audits).mapInArrow(_repaired_rows, "conv_id long, place long, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of ``role:text`` of the repaired rows, newline-joined; the text streams through the hash."""
    return streamed(rows, audits).mapInArrow(_digested, "conv_id long, repaired_sha256 string")


def streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    first = audits.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "place", "role", "text").unionByName(first)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _conversations(batches):
    """(conv_id, repaired rows) of each conversation, to be used up in turn."""
    from itertools import groupby

    def rows():
        for batch in batches:
            # rows of whole texts: few become Python objects at a time
            for at in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

    for key, some in groupby(rows(), lambda r: r[0]):
        audit = next(some)[3]
        yield key, rewritten(((r[2], r[3]) for r in some), audit)


def _digested(batches):
    def each():
        for key, rows in _conversations(batches):
            h = hashlib.sha256()
            for i, (role, text) in enumerate(rows):
                h.update(f"{chr(10) if i else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield key, h.hexdigest()

    for some in in_batches(each()):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.string())], names=["conv_id", "repaired_sha256"])


def _repaired_rows(batches):
    each = ((key, i, role, text) for key, rows in _conversations(batches) for i, (role, text) in enumerate(rows, 1))
    for some in in_batches(each):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])


def repair(rows: DataFrame, everyone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of rows (conv_id, turn, role, text; roles and texts not null).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, for each id of everyone (conv_id) or of rows; repaired:
    conv_id, place, role, text.
    """
    placed = materialize(faults(rows), "placed")
    found = materialize(signatures(placed), "signatures")
    # few distinct signatures may stand for many conversations: Spark splits such keys of the join
    known = materialize(found.join(edits(found), "signature"), "repairs").drop("signature")
    texts, audits = placed.select("conv_id", "place", "role", "text"), known.select("conv_id", "audit")
    hashed = digests(texts, audits).withColumnRenamed("conv_id", "h_id")
    ids = (everyone if everyone is not None else rows).select(F.col("conv_id").alias("e_id")).distinct()
    report = ids.join(known, F.col("e_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    report = report.join(hashed, F.col("e_id").eqNullSafe(F.col("h_id")), "left")
    report = report.select(
        F.col("e_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
    return report, repaired(texts, audits)
