"""Quality rules: cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents that hold
a line are counted; lines in too large a share of a host's documents go (the
text without them is ``text_left``); a document that keeps too few of its words
without them is rejected. Rules on the single document come first: too few
words, or too many in repeated windows.

Everything is a DataFrame expression: no Python runs on executors.

Defined cases: a null text is an empty one and fails the word count; a text
without frequent lines is left as it is, in others lines without a word stay; a null
host is a host of its own; exact copies of a text count as one document of
their host, so that copies alone don't make their lines boilerplate; repeated
rows get equal results; very long texts are gone through whole; a line exactly
at a limit stays; no rows give no rows; columns of the input that have
the name of a result column keep their name with ``in_`` before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, let, materialize, words_of

#: Symbols whose number is reported.
SYMBOLS = "#*$%&|<>"
#: A line is boilerplate of a host in at least so many of its distinct documents, if these are more than this share of all or more than so many.
MAX_SHARE, MIN_DOCS, MAX_DOCS = 0.10, 10, 100_000
#: Percent of its words that a document must keep without boilerplate lines.
MIN_LEFT = 50
#: Words a document needs; percent of words in repeated windows that it may have.
MIN_WORDS, MAX_REPEATED = 50, 50
#: So many frequent lines are surely small enough to send to every executor (16 bytes each); more are joined by host and text.
BROADCAST_LINES = 100_000


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def normal(text: Column) -> Column:
    """Lower case, numbers as 0: what is hashed of a text's lines, after their ends are trimmed."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def line_hashes(text: Column) -> Column:
    return F.transform(lines_of(normal(text)), lambda x: F.xxhash64(F.btrim(x, F.lit(SPACE))))


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines of these hashes; lines without a word stay."""
    hashed = F.transform(F.split(normal(text), "\n", -1), lambda x: F.when(F.btrim(x, F.lit(SPACE)) != "", F.xxhash64(F.btrim(x, F.lit(SPACE)))))
    left = F.zip_with(F.split(text, "\n", -1), hashed, lambda line, h: F.when(h.isNull() | ~F.array_contains(hashes, h), line))
    return F.array_join(F.filter(left, lambda line: line.isNotNull()), "\n")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Number of words in windows that are found twice or more in the array."""

    def of(w: Column) -> Column:
        n = F.size(w) - (window - 1)
        hashed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[w[i + k] for k in range(window)]))

        def starts(s: Column) -> Column:
            same = lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == e["h"])) | ((k < n - 1) & (s[F.least(k + 1, n - 1)]["h"] == e["h"]))
            return F.filter(F.transform(s, lambda e, k: F.when(same(e, k), e["i"]).otherwise(F.lit(-1))), lambda i: i >= 0)

        def covered(d: Column) -> Column:
            return F.size(F.array_distinct(F.flatten(F.transform(d, lambda i: F.sequence(i, i + window - 1)))))

        def found(h: Column) -> Column:
            ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == n, F.lit(0)).otherwise(let(let(ordered, starts), covered))

        return F.when(n < 2, F.lit(0)).otherwise(let(hashed, found))

    return let(words, of).cast("long")


def frequent_lines(df: DataFrame, text: str, host: str, max_share: float, min_docs: int, max_docs: int) -> DataFrame:
    """(host, lines): for each host, the hashes of the lines in too many of its distinct texts."""
    x = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(host).alias("host"), F.xxhash64(x).alias("doc"), F.array_distinct(line_hashes(x)).alias("lines"))
    # a hash of 64 bits stands for the text; the pairs are made distinct over all three columns, so no host or line is one task's load
    seen = rows.select("host", "doc", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    total = rows.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_docs"))
    seen = seen.where(F.col("docs") >= min_docs)
    most = F.least(max_share * F.col("all_docs"), F.lit(float(max_docs)))
    over = seen.alias("s").join(total.alias("t"), F.col("s.host").eqNullSafe(F.col("t.host"))).where(F.col("docs") > most)
    return over.groupBy(F.col("s.host").alias("host")).agg(F.collect_set("line").alias("lines"))


def lines_by_text(df: DataFrame, text: str, host: str, often: DataFrame) -> DataFrame:
    """(host, doc, lines): the frequent lines of each distinct text that has any, found line by line: no host is one task's load."""
    x = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(host).alias("host"), F.xxhash64(x).alias("doc"), F.explode(F.array_distinct(line_hashes(x))).alias("line")).distinct()
    each = often.select(F.col("host").alias("h"), F.explode("lines").alias("l"))
    found = rows.join(each, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    return found.groupBy("host", "doc").agg(F.collect_list("line").alias("lines"))


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_left", "text_left", "base_failed", "kept")


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with other names for the columns that are called like a result, and what each of its columns is called now."""
    names = {c: c for c in df.columns}
    for c in [c for c in df.columns if c.lower() in MADE]:
        names[c] = fresh(df, f"in_{c}")
        df = df.withColumnRenamed(c, names[c])
    return df, names


def quality_rules(df: DataFrame, text: str = "text", host: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: int = MIN_LEFT, max_docs: int = MAX_DOCS, sent: int = BROADCAST_LINES) -> DataFrame:
    """The rows of df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words_left, text_left, base_failed and kept."""
    df = renamed(df)[0]
    often = materialize(frequent_lines(df, text, host, max_share, min_docs, max_docs), "lines")
    # at most (lines a document has) / max_share a host; hosts are counted, not assumed to be few
    n = often.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0] + often.count()
    host_, lines_, words_, doc_ = fresh(df, "host_"), fresh(df, "lines_"), fresh(df, "words_"), fresh(df, "doc_")
    x = F.coalesce(F.col(text), F.lit(""))
    if n <= sent:
        often = F.broadcast(often.select(F.col("host").alias(host_), F.col("lines").alias(lines_)))
        same = df[host].eqNullSafe(F.col(host_))
    else:
        often = lines_by_text(df, text, host, often).select(F.col("host").alias(host_), F.col("doc").alias(doc_), F.col("lines").alias(lines_))
        same = df[host].eqNullSafe(F.col(host_)) & (F.xxhash64(x) == F.col(doc_))
    lines = lines_of(x)
    # lower-casing and 0 for numbers leave the lines and their words' number as they are
    here = F.filter(F.zip_with(lines, line_hashes(x), lambda line, h: F.when(F.array_contains(F.col(lines_), h), line)), lambda line: line.isNotNull())
    gone = F.when(F.col(lines_).isNull(), F.lit(0)).otherwise(F.aggregate(here, F.lit(0), lambda a, line: a + F.size(words_of(line))))
    out = df.join(often, same, "left").withColumn(words_, words_of(x))
    out = out.select(
        *df.columns,
        F.size(words_).cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", words_)).cast("long").alias("word_chars"),
        (F.size(F.split(x, f"[{SYMBOLS}]", -1)) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(words_)).alias("n_repeat_words"),
        (F.size(words_) - gone).cast("long").alias("n_words_left"),
        F.when(gone > 0, without_lines(x, F.col(lines_))).otherwise(F.col(text)).alias("text_left"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("n_words_left") >= min_left * F.col("n_words")))


def cleaned(df: DataFrame, text: str = "text", host: str = "source", chars: str | None = "n_chars", **how) -> DataFrame:
    """The rows of df that the rules keep, with df's columns and values; of their texts the frequent lines are gone."""
    here, names = renamed(df)
    out = quality_rules(here, names[text], names[host], **how).where("kept").withColumn(names[text], F.col("text_left"))
    if chars and chars in names:
        out = out.withColumn(names[chars], F.char_length(names[text]).cast(df.schema[chars].dataType))
    return out.select(*[F.col(names[c]).alias(c) for c in df.columns])
