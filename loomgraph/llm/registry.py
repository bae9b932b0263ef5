"""The queries ``opN_<name>`` on the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversation_repair, decontamination, hmm, minhash, mixing, packing, pieces, pii, quality_cnn, quality_rules, suffix_dedup, toxicity
from .common import table
from .labelled import crc_of


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    shards = F.size(F.array_distinct(F.flatten(F.transform("pieces", lambda p: p["shards"]))))
    return out.select("doc_id", "size", "source_size", "target", "taken", shards.cast("long").alias("n_shards"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    kinds = pii.KINDS
    joined = lambda names: F.array_join(pii.rows_of_spans(F.col("spans"), names), ",")
    return found.select(
        "doc_id",
        *[F.size(F.col("spans")[k]).cast("long").alias(f"n_{k}") for k in kinds],
        F.size(F.col("spans")["secret"]).cast("long").alias("n_secret"),
        F.sha2(joined(kinds), 256).alias("base_sha256"),
        joined((*kinds, "secret")).alias("spans"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "end", "matched", "item_words")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of(F.col("doc_id")) % 10 == 0
    out = hmm.language_model(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def classified(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of(F.col("doc_id")) % 5 == 0
    return classified(quality_cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of(F.col("doc_id")) % 4 == 2
    return classified(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), rows)[0]


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_mixing": op3_mixing,
        "op4_minhash": op4_minhash,
        "op5_pii": op5_pii,
        "op6_decontamination": op6_decontamination,
        "op7_quality_rules": op7_quality_rules,
        "op8_hmm": op8_hmm,
        "op9_quality_cnn": op9_quality_cnn,
        "op10_toxicity": op10_toxicity,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_collocations": op13_collocations,
    }


#: Words, as every operator here takes them.
WORDS = r"'[^\x20\x09-\x0D]+'"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM d),
sets AS (SELECT g, min(doc_id) AS id, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY 1),
one AS (SELECT id, n, unnest(g) AS x FROM sets),
pairs AS (SELECT a.id AS a, b.id AS b FROM one a JOIN one b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
steps AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r AS (SELECT id, id AS c FROM sets UNION SELECT steps.b, r.c FROM r JOIN steps ON r.id = steps.a),
least AS (SELECT g, min(c) AS c FROM r JOIN sets USING (id) GROUP BY 1)
SELECT doc_id, len(s.g) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN least ON s.g = least.g"""

OP7 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
b AS (SELECT doc_id, source, t, regexp_extract_all(t, {WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {SPACES}) <> '') AS l FROM d),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM b WHERE len(w) > 2),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
lines AS (SELECT doc_id, source, t, unnest(l) AS x FROM b),
keyed AS (SELECT doc_id, source, t, trim(regexp_replace(lower(x), '[0-9]+', '0', 'g'), {SPACES}) AS x, len(regexp_extract_all(x, {WORDS})) AS n FROM lines),
often AS (SELECT source, x FROM keyed JOIN (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY 1) USING (source) GROUP BY source, x, docs HAVING count(DISTINCT t) >= {quality_rules.MIN_DOCS} AND count(DISTINCT t) > least({quality_rules.MAX_SHARE} * docs, {quality_rules.MAX_DOCS})),
gone AS (SELECT doc_id, sum(n) AS n FROM keyed SEMI JOIN often ON keyed.source = often.source AND keyed.x = often.x GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(w) - coalesce(gone.n, 0) AS n_words_left FROM b LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_left >= {quality_rules.MIN_LEFT} * n_words AS kept FROM f"""


OP11 = r"""WITH RECURSIVE crc AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, _y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM hurt),
faulty AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN place > min(place) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] AS pair FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (place > 1 AND NOT coalesce(pair IN ('su', 'ua', 'au'), false)) AS illegal, count(*) AS n FROM faulty GROUP BY 1),
ends AS (SELECT conv_id, n + 1 AS place, {'c': 0, 'a': '', 'r': ''} AS s0, {'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1, {'c': 3, 'a': 'I', 'r': chr(10) || 'assistant:'} AS s2, {'c': 0, 'a': '', 'r': ''} AS s3 FROM counts),
dp AS (SELECT * FROM ends UNION ALL SELECT conv_id, place, i0, i1, i2, i3 FROM (
  SELECT *, list_min([b0, {'c': i2.c + 3, 'a': 'I' || i2.a, 'r': chr(10) || 'user:' || i2.r}]) AS i0, list_min([b1, {'c': i2.c + 3, 'a': 'I' || i2.a, 'r': chr(10) || 'user:' || i2.r}]) AS i1 FROM (
  SELECT *, list_min([b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 'r': chr(10) || 'assistant:' || b3.r}]) AS i2, list_min([b3, {'c': b2.c + 3, 'a': 'I' || b2.a, 'r': chr(10) || 'user:' || b2.r}]) AS i3 FROM (
  SELECT f.conv_id, f.place,
    list_min([{'c': s0.c + 4, 'a': 'D' || s0.a, 'r': s0.r}] || CASE WHEN gone THEN [] ELSE [{'c': s2.c + 3 + late, 'a': 'R' || s2.a, 'r': asuser || s2.r}] END || CASE WHEN NOT gone AND role[1] = 's' THEN [{'c': s1.c + late, 'a': 'K' || s1.a, 'r': own || s1.r}] ELSE [] END || CASE WHEN NOT gone AND role[1] = 'u' THEN [{'c': s2.c + late, 'a': 'K' || s2.a, 'r': own || s2.r}] ELSE [] END) AS b0,
    list_min([{'c': s1.c + 4, 'a': 'D' || s1.a, 'r': s1.r}] || CASE WHEN gone THEN [] ELSE [{'c': s2.c + 3 + late, 'a': 'R' || s2.a, 'r': asuser || s2.r}] END || CASE WHEN NOT gone AND role[1] = 'u' THEN [{'c': s2.c + late, 'a': 'K' || s2.a, 'r': own || s2.r}] ELSE [] END) AS b1,
    list_min([{'c': s2.c + 4, 'a': 'D' || s2.a, 'r': s2.r}] || CASE WHEN gone THEN [] ELSE [{'c': s3.c + 3 + late, 'a': 'R' || s3.a, 'r': asother || s3.r}] END || CASE WHEN NOT gone AND role[1] = 'a' THEN [{'c': s3.c + late, 'a': 'K' || s3.a, 'r': own || s3.r}] ELSE [] END) AS b2,
    list_min([{'c': s3.c + 4, 'a': 'D' || s3.a, 'r': s3.r}] || CASE WHEN gone THEN [] ELSE [{'c': s2.c + 3 + late, 'a': 'R' || s2.a, 'r': asuser || s2.r}] END || CASE WHEN NOT gone AND role[1] = 'u' THEN [{'c': s2.c + late, 'a': 'K' || s2.a, 'r': own || s2.r}] ELSE [] END) AS b3
  FROM dp JOIN (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late, chr(10) || role || ':' || text AS own, chr(10) || 'user:' || text AS asuser, chr(10) || 'assistant:' || text AS asother FROM faulty) f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.place = dp.place - 1)))),
done AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, s0.r AS body FROM dp WHERE place = 1)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(body, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM i.conv_id"""

OP13 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, size, a, w, unnest(range(1, size)) AS k FROM c),
s AS (SELECT cuts.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.w[1:cuts.k], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.w[cuts.k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS more FROM inside GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE NOT coalesce(100 * more >= 50 * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say in reasonable time; the others are tested against brute force, round trips and held-out labels."""
    return {"op4_minhash": OP4, "op7_quality_rules": OP7, "op11_conversation_repair": OP11, "op13_collocations": OP13}
