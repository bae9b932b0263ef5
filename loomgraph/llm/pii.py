"""Personal data by bootstrapped contextual extraction.

Seed entities are found by fixed forms (emails, addresses, card and phone
numbers) and by strong shapes of keys (long mixed hexadecimal or upper-case
runs). The text before a value induces lexical patterns: the word and the
punctuation before it, and the letters a value begins with. Pattern and value
form a graph, scored in rounds: a pattern by the share of its occurrences in
the distinct texts of the corpus that hold a known value (so copies of a text
count once above and below the line), a value by the patterns it is found
with. Values of high-confidence patterns are added as spans of kind ``secret``.

Everything is a DataFrame expression: no Python runs on executors.

Defined cases: a null text is empty and has no spans; equal texts get equal
spans; null and repeated ids are kept, a row for each input row; very long texts
are searched whole; a value that several patterns find is one span; no rows give
no rows; other columns aren't looked at, whatever their names; positions are
code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: Fixed forms. Possessive repeats and the look-behinds find the same spans as the plain forms, in linear time and flat stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A value that may identify: six or more of these characters, a digit among them.
VALUE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{6,}+"
#: Shapes of keys that seed the search: 16 or more upper-case letters and digits, or hexadecimal digits, of both kinds.
STRONG = r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[A-Z0-9]{16,}|[0-9a-f]{16,})$"
#: Rounds; distinct values a pattern needs; score that accepts a pattern.
ROUNDS, SUPPORT, ACCEPT = 3, 5, 0.5


def running(lengths: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array, in blocks, so that long arrays don't take quadratic time."""

    def sums(a: Column) -> Column:
        return F.aggregate(a, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("at")), lambda s, x: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + x).alias("at")))

    def over(blocks: Column) -> Column:
        starts = sums(F.transform(blocks, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["out"], lambda x: x + s)))

    parts = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(block)), lambda i: sums(F.slice(a, i + 1, F.lit(block))))
    return let(lengths, lambda a: let(parts(a), over))


def matches(text: Column, regex: str) -> Column:
    """Array of (start, end, value, before) of the leftmost non-overlapping matches; before: the end of the text since the last match."""

    def zipped(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            whole = F.zip_with(gaps, found, lambda g, m: F.char_length(g).cast("bigint") + F.coalesce(F.char_length(m), F.lit(0)))
            return F.zip_with(
                F.transform(F.slice(gaps, 1, F.size(found)), lambda g: g),
                F.zip_with(running(whole), found, lambda s, m: F.struct(s.alias("s"), m.alias("m"))),
                lambda g, x: F.when(
                    x["m"].isNotNull(),
                    F.struct((x["s"] + F.char_length(g)).alias("start"), (x["s"] + F.char_length(g) + F.char_length(x["m"])).alias("end"), x["m"].alias("value"), F.right(g, F.lit(48)).alias("before")),
                ),
            )

        return F.when(F.size(found) > 0, F.filter(let(F.split(text, regex, -1), placed), lambda x: x.isNotNull()))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    return F.coalesce(let(F.regexp_extract_all(text, F.lit(regex), 0), zipped), empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    def valid(d: Column) -> Column:
        each = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0

    return let(digits(value), lambda d: F.when(F.char_length(d).between(13, 19), valid(d)).otherwise(F.lit(False)))


def small_parts(value: Column) -> Column:
    return F.forall(F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


def base_spans(text: Column) -> Column:
    """Struct of the four kinds' spans: arrays of (start, end)."""
    bounds = lambda a: F.transform(a, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    some = lambda has, a: F.when(has, bounds(a)).otherwise(none)
    number = F.regexp_like(text, F.lit("[0-9]"))
    return F.struct(
        some(F.contains(text, F.lit("@")), matches(text, EMAIL)).alias("email"),
        some(number, F.filter(matches(text, IP), lambda m: small_parts(m["value"]))).alias("ip"),
        some(number, F.filter(matches(text, CARD), lambda m: luhn(m["value"]))).alias("card"),
        some(F.contains(text, F.lit("+")) & number, F.filter(matches(text, PHONE), lambda m: F.char_length(digits(m["value"])).between(9, 15))).alias("phone"),
    )


#: A word and the punctuation after it, up to where a value could begin: what ``before`` patterns are made of.
CUE = r"(?<![a-z])[a-z]++[^a-z0-9]{0,3}[^a-z0-9_+/-](?=[a-z0-9_+/-])"
#: White space in a pattern is a space.
BLANKS = ("\t\n\x0b\x0c\r", "     ")


KINDS = ("email", "ip", "card", "phone")


def rows_of_spans(base: Column, kinds=KINDS) -> Column:
    """'kind:start:end' of all spans, by kind and start."""
    said = lambda k: F.transform(base[k], lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return F.flatten(F.array(*[said(k) for k in kinds]))


def found_by_pattern(features: DataFrame, occurs: DataFrame) -> DataFrame:
    """(hash, secret): spans that high-confidence patterns add to the texts of features (hash, base, values)."""
    value = F.col("v.value")
    overlaps = lambda k: F.exists(F.col("base")[k], lambda s: (s["start"] < F.col("v.end")) & (s["end"] > F.col("v.start")))
    rows = features.where(F.size("values") > 0).dropDuplicates(["hash"]).withColumn("v", F.explode("values"))
    rows = rows.select("hash", F.col("v.start").alias("start"), F.col("v.end").alias("end"), value.alias("value"), F.lower("v.before").alias("before"), (overlaps("email") | overlaps("ip") | overlaps("card") | overlaps("phone")).alias("base"))
    cue = r"([a-z]+)([^a-z0-9]{1,4})$"
    word, mark = F.regexp_extract("before", cue, 1), F.translate(F.regexp_extract("before", cue, 2), *BLANKS)
    letters = F.regexp_extract("value", "^[A-Za-z]{3,8}", 0)
    rows = rows.withColumn("patterns", F.filter(F.array(F.when(word != "", F.struct(F.lit("before").alias("by"), word.alias("word"), F.concat(word, mark).alias("pattern"))), F.when(letters != "", F.struct(F.lit("begins").alias("by"), letters.alias("word"), F.concat(letters, F.lit(":"), F.char_length("value").cast("string")).alias("pattern")))), lambda p: p.isNotNull()))
    rows = materialize(rows.drop("before"), "values")
    strong = F.regexp_like("value", F.lit(STRONG))
    links = rows.select("value", "base", (strong | F.col("base")).cast("double").alias("seed"), F.explode("patterns").alias("p"))
    links = links.groupBy("p.by", "p.word", "p.pattern", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("times"))
    links = materialize(links, "links")
    # how often a pattern occurs in the distinct texts, before a value or not
    held = links.groupBy("by", "pattern").agg(F.sum("times").alias("held"), F.countDistinct("value").alias("values")).where(F.col("values") >= SUPPORT)
    cues = held.join(occurs.select(F.col("pattern").alias("w"), F.col("n")), (F.col("pattern") == F.col("w")) & (F.col("by") == "before"), "left")
    cues = cues.select("by", "pattern", F.greatest(F.coalesce("n", "held"), "held").alias("occurs"))
    links = materialize(links.join(cues, ["by", "pattern"]), "cues")
    scores = links.select("value", "seed").groupBy("value").agg(F.max("seed").alias("score"))
    for _ in range(ROUNDS):
        known = links.join(scores, "value")
        patterns = known.groupBy("by", "pattern", "occurs").agg(F.sum(F.col("score") * F.col("times")).alias("known"))
        patterns = patterns.select("by", "pattern", (F.col("known") / (F.col("occurs") + 1.0)).alias("p"))
        scores = links.join(patterns, ["by", "pattern"]).groupBy("value").agg(F.greatest(F.max("seed"), F.max(F.when(F.col("p") >= ACCEPT, F.col("p")).otherwise(0.0))).alias("score"))
        scores = materialize(scores, "scores")
    good = materialize(patterns.where(F.col("p") >= ACCEPT).select(F.col("by").alias("g_by"), F.col("pattern").alias("g_pattern")), "patterns")
    hits = rows.where(~F.col("base")).select("hash", "start", "end", F.explode("patterns").alias("p"))
    hits = hits.join(good, (F.col("p.by") == F.col("g_by")) & (F.col("p.pattern") == F.col("g_pattern")), "left_semi")
    return hits.groupBy("hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("secret"))


def personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, spans (struct of arrays of (start, end): email, ip, card, phone, secret)."""
    x = F.coalesce(F.col(text), F.lit(""))
    values = F.when(F.regexp_like(x, F.lit("[0-9]")), matches(x, VALUE)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>"))
    features = materialize(df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(x).alias("hash"), base_spans(x).alias("base"), values.alias("values")), "spans")
    texts = df.select(F.xxhash64(x).alias("hash"), F.lower(x).alias("lower")).dropDuplicates(["hash"])
    occurs = texts.select(F.explode(F.regexp_extract_all("lower", F.lit(CUE), F.lit(0))).alias("cue")).groupBy(F.translate("cue", *BLANKS).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    added = found_by_pattern(features, occurs)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = features.join(added, "hash", "left").select("doc_id", F.struct(*[F.col("base")[k].alias(k) for k in KINDS], F.coalesce("secret", none).alias("secret")).alias("spans"))
    return out
