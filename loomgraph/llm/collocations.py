"""Phrases whose words stand together more often than their parts let expect.

Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces,
those into words; all counts are per language. A phrase of two or three words
with a >= 10 occurrences is a candidate; its score is the least, over its cuts,
of floor(1000000 a a / (l r)), l and r being the occurrences of the parts.

1. Sketch: every task counts its phrases in cells of a hash table, many more
   cells than phrases; cells are summed by blocks. A cell's sum is an upper
   bound of each of its phrases, so phrases of a cell under the least count are
   out. What goes to the tasks is one bit a cell (``BITS`` bounds it).
2. The phrases in cells that reach it, made distinct, and their words are the
   patterns. They are cut into groups of bounded size, by hash. Where there are
   more than two, texts are cut into windows by the same hash of two words, so
   that a group's scan reads only where its phrases can be.
3. Each group is compiled into Aho-Corasick automata, one a language; words are
   written as codes and pieces stand between delimiters, so that nothing matches
   within a word or across pieces. Shards of the corpus are scanned, overlapping
   matches counted, and the counts of shards are summed: they are exact, whatever
   the sketch let through.
4. Thresholds, scores and ranks are joins of the counted phrases.

Defined cases: null and empty texts have no words; a null language is ``und``;
repeated rows and ids, null or not, count as often as they are there; very long
texts are gone through whole; of equal scores the more frequent phrase comes
first, then the lesser in the order of UTF-8 bytes; of equal cuts the one after
fewer words counts; no rows give no rows; other columns aren't looked at,
whatever their names. More words than a group holds mean one more scan of the
texts for each group; phrases beyond two groups are scanned in windows, about
three times the texts in all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .vector import flat, mixed, pieces, small_batches, splitmix, word_hashes

#: Least count, words of a phrase, results a language, and the share (of 100) of a longer phrase that takes a shorter one's place.
LEAST, WORDS, TOP, INSIDE = 10, 3, 2000, 50
#: Log of the number of cells: at least, at most (128 MB of bits); log of the cells of a block.
BITS, BLOCK = (16, 30), 16
#: Patterns of a group: about 250 MB of automata in a worker. Texts that one task lists and scans, in bytes, where there are enough tasks.
GROUP, SHARD = 2_000_000, 128 << 20
#: Occurrences that a task counts before it hands them on; bytes of text that are hashed at a time, but for a longer text.
HELD, SLICE = 2 << 20, 1 << 19
UNKNOWN = "und"
DELIMITERS = b".,;:!?\n\x0b\x0c\r"

SPLITS = np.zeros(256, bool)
SPLITS[list(DELIMITERS)] = True
SEPARATES = SPLITS.copy()
SEPARATES[[9, 32]] = True
#: Bytes as they are scanned: lower case, one delimiter, one kind of white space.
FOLDED = bytes(10 if SPLITS[b] else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = splitmix(8, 13) | np.uint64(1)


def phrase_hashes(texts: pa.Array, langs: pa.Array):
    """(data, starts, ends, per text number of words, then for k = 2, 3: first words of all phrases of k words and the phrases' hashes, with their language)."""
    data, bounds = flat(texts)
    words, first, starts, ends = word_hashes(data, bounds, True, SEPARATES)
    n = len(words)
    # a word's piece: delimiters before it, and the text it is in
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    split = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SPLITS[data], out=split[1:])
    piece = split[starts] + doc
    codes = langs.dictionary_encode()
    names = [hash_of_name(x) for x in codes.dictionary.to_pylist()]
    lang = np.array(names or [0], np.uint64)[codes.indices.to_numpy(zero_copy_only=False)][doc] if n else words
    found = []
    for k in range(2, WORDS + 1):
        at = np.flatnonzero(piece[: n - k + 1] == piece[k - 1 :]) if n >= k else np.zeros(0, np.int64)
        h = lang[at] + np.uint64(k)
        for j in range(k):
            h = h + words[at + j] * ODD[j]
        found.append((at, mixed(h)))
    return data, starts, ends, np.diff(first), found


def hash_of_name(name: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def sketched(batches, bits: int):
    """Rows (lang, words) of how many words there are, and (block, cells, counts): differences of a block's used cells, and their counts up to the least count."""
    langs: dict[str, int] = {}
    held: list[np.ndarray] = []
    size = 0

    def blocks():
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        counts = np.minimum(counts, LEAST).astype(np.uint8)
        block = cells >> BLOCK
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[at[1:], len(cells)]
        for i in range(0, len(at), 1024):
            rows = [(int(block[a]), np.diff(cells[a:b] & ((1 << BLOCK) - 1), prepend=np.uint32(0)).astype("<u2").tobytes(), counts[a:b].tobytes()) for a, b in zip(at[i : i + 1024], ends[i : i + 1024], strict=True)]
            yield batch_of(SKETCH, [(None, None, *r) for r in rows])

    for batch in batches:
        for some in pieces(batch, 0, SLICE):
            _, _, _, words, found = phrase_hashes(some.column(0), some.column(1))
            for lang, n in zip(some.column(1).to_pylist(), words.tolist(), strict=True):
                langs[lang] = langs.get(lang, 0) + n
            for _, h in found:
                held.append((h >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(h)
            if size >= HELD:
                yield from blocks()
                size = 0
    if size:
        yield from blocks()
    if langs:
        yield batch_of(SKETCH, [(k, v, None, None, None) for k, v in langs.items()])


SKETCH = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=schema.names)


def summed(batches):
    """(block, cells) of the cells of each block that reach the least count; rows come by block."""
    now, sums = None, np.zeros(1 << BLOCK, np.uint32)

    def reached():
        at = np.flatnonzero(sums >= LEAST)
        return [(now, np.diff(at, prepend=0).astype("<u2").tobytes())] if len(at) else []

    out: list[tuple] = []
    for batch in batches:
        for block, cells, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
            if block.as_py() != now:
                out += reached() if now is not None else []
                now = block.as_py()
                sums[:] = 0
            # a row has each cell once
            at = np.cumsum(np.frombuffer(cells.as_buffer(), "<u2"), dtype=np.int64)
            sums[at] += np.frombuffer(counts.as_buffer(), np.uint8)
        if len(out) >= 4096:
            yield batch_of(REACHED, out)
            out = []
    if now is not None:
        out += reached()
    if out:
        yield batch_of(REACHED, out)


REACHED = pa.schema([("block", pa.int32()), ("cells", pa.binary())])


def once(shared: dict, make):
    """What a worker makes of a broadcast's plain values, once for all its tasks; no class of ours is in the broadcast, so workers need no copy of this package."""
    if "made" not in shared:
        shared["made"] = make(shared)
    return shared["made"]


class Cells:
    """One bit for each cell that reaches the least count: what goes to the workers, each of which unfolds it once."""

    def __init__(self, bits: int, blocks: list[tuple[int, bytes]]):
        self.bits, self.blocks, self.table = bits, blocks, None

    def unfolded(self) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << (self.bits - 3), np.uint8)
            for block, cells in self.blocks:
                part = np.zeros(1 << BLOCK, bool)
                part[np.cumsum(np.frombuffer(cells, "<u2"), dtype=np.int64)] = True
                at = block << (BLOCK - 3)
                self.table[at : at + (1 << (BLOCK - 3))] = np.packbits(part, bitorder="little")
        return self.table

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> np.uint64(64 - self.bits)
        return self.unfolded()[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 == 1


def listed(batches, cells):
    """(lang, phrase) of phrases in cells that reach the least count, about once a task."""
    seen = np.zeros(0, np.uint64)
    own = once(cells.value, lambda x: Cells(x["bits"], x["blocks"]))
    for batch in batches:
        for some in pieces(batch, 0, SLICE):
            data, starts, ends, words, found = phrase_hashes(some.column(0), some.column(1))
            langs = some.column(1)
            doc = np.repeat(np.arange(len(words)), words)
            folded = data.tobytes().translate(FOLDED)
            for k, (at, h) in enumerate(found, 2):
                kept = np.flatnonzero(own.has(h))
                new, one = np.unique(h[kept], return_index=True)
                place = np.searchsorted(seen, new)
                unseen = np.append(seen, np.uint64(0))[place] != new
                first = at[kept[one[unseen]]]
                seen = np.insert(seen, place[unseen], new[unseen]) if len(seen) < HELD else new
                rows = langs.take(pa.array(doc[first])) if len(first) else pa.array([], pa.string())
                for i in range(0, len(first), 16_384):
                    part = first[i : i + 16_384]
                    texts = [b" ".join(folded[a:b].split()).decode("utf-8", "replace") for a, b in zip(starts[part].tolist(), ends[part + k - 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.slice(i, len(part)), pa.array(texts, pa.string())], names=["lang", "phrase"])


def headed(batches, k: int):
    """(lang, phrase, pid, part): patterns of two or more words, dealt to k parts by their first two."""
    for batch in batches:
        _, _, _, words, ((at, h), *_) = phrase_hashes(batch.column(1), batch.column(0))
        part = h[np.searchsorted(at, np.cumsum(words) - words)] % np.uint64(k)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["lang", "phrase", "pid", "part"])


def windows(batches, cells, k: int):
    """(lang, text, part): of each part what a pattern of it can match: every two words that reach the least count with the word after them.

    A pair is dealt as patterns that begin with it. Windows of one part that
    overlap are one, so that it holds each occurrence of its patterns once.
    """
    own = once(cells.value, lambda x: Cells(x["bits"], x["blocks"]))
    for batch in batches:
        for some in pieces(batch, 0, SLICE):
            data, starts, ends, words, ((at, h), (longer, _)) = phrase_hashes(some.column(0), some.column(1))
            kept = own.has(h)
            at, part = at[kept], (h[kept] % np.uint64(k)).astype(np.int32)
            if not len(at):
                continue
            codes = some.column(1).dictionary_encode()
            lang = np.repeat(codes.indices.to_numpy(zero_copy_only=False), words)[at]
            last = at + 1 + np.isin(at, longer, assume_unique=True)
            by = np.lexsort((at, lang, part))
            at, last, lang, part = at[by], last[by], lang[by], part[by]
            row = np.r_[True, (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])]
            first = np.flatnonzero(row | np.r_[True, at[1:] > last[:-1]])
            to = ends[last[np.r_[first[1:], len(at)] - 1]].tolist()
            folded = data.tobytes().translate(FOLDED)
            texts = [folded[a:b] for a, b in zip(starts[at[first]].tolist(), to, strict=True)]
            rows = np.flatnonzero(row)
            bounds = np.searchsorted(first, np.r_[rows, len(at)]).tolist()
            joined = [b"\n".join(texts[a:b]).decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(lang[rows])), pa.array(joined, pa.string()), pa.array(part[rows])], names=["lang", "text", "part"])


class Automata:
    """Patterns (lang, phrase, pid) of a group and their automata, which a worker makes once.

    A word of the patterns is written as two characters: one of LEAD, then one
    of TAIL. No lead is a tail, so nothing matches from within a word; other
    words and the bounds of pieces are DELIMITER, which no pattern holds.
    """

    def __init__(self, patterns: pa.Table | bytes):
        self.made = None
        if isinstance(patterns, bytes):
            self.patterns = patterns
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, patterns.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(patterns, max_chunksize=16_384)
        self.patterns = sink.getvalue().to_pybytes()

    def compiled(self) -> tuple[Codes, dict, np.ndarray]:
        """(words' codes, automata by language, pids by place)."""
        if self.made is None:
            from collections import Counter

            import ahocorasick

            words: Counter = Counter()
            for batch in pa.ipc.open_stream(self.patterns):
                for phrase in batch.column(1).to_pylist():
                    words.update(phrase.split(" "))
            # children of a node are looked through in their order: words of many patterns first
            codes = Codes({w.encode(): chr(LEAD + i // TAILS) + chr(TAIL + i % TAILS) for i, (w, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0])))})
            del words
            automata: dict = {}
            pids, n = [], 0
            for batch in pa.ipc.open_stream(self.patterns):
                for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if lang not in automata:
                        automata[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    automata[lang].add_word("".join([codes[w.encode()] for w in phrase.split(" ")]), n)
                    n += 1
                pids.append(batch.column(2).to_numpy())
            for automaton in automata.values():
                automaton.make_automaton()
            self.made = codes, automata, np.concatenate(pids) if pids else np.zeros(0, np.int64)
        return self.made


#: First characters of words' codes from LEAD on (as many as are needed), second ones TAILS from TAIL on; neither is the delimiter.
TAIL, TAILS, LEAD, DELIMITER = 0x100, 512, 0x10000, "|"


class Codes(dict):
    """Words' codes; another word is a delimiter."""

    def __missing__(self, word: bytes) -> str:
        return DELIMITER


def guarded(text: str, codes: Codes) -> str:
    """The codes of the words, pieces and unknown words apart by a delimiter."""
    folded = text.encode("utf-8", "surrogatepass").translate(FOLDED)
    return DELIMITER.join(["".join(map(codes.__getitem__, p.split())) for p in folded.split(b"\n")])


def scanned(batches, automata):
    """(pid, n): overlapping matches of each pattern in a shard of the corpus."""
    from itertools import chain
    from operator import itemgetter

    codes, by_language, pids = once(automata.value, lambda x: Automata(x["patterns"])).compiled()
    counts = np.zeros(len(pids), np.int64)
    place = itemgetter(1)
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            some = batch.slice(at, 32)
            rows = zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
            matches = chain.from_iterable(map(place, by_language[lang].iter(guarded(text, codes))) for text, lang in rows if text and lang in by_language)
            found, n = np.unique(np.fromiter(matches, np.int32), return_counts=True)
            counts[found] += n
    found = np.flatnonzero(counts)
    for i in range(0, len(found), 65_536):
        part = found[i : i + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(pids[part], pa.int64()), pa.array(counts[part], pa.int64())], names=["pid", "n"])


def frequent_cells(texts: DataFrame, bits: int) -> tuple[DataFrame, list[tuple[int, bytes]]]:
    """(words per language, the cells that reach the least count)."""
    made = materialize(texts.mapInArrow(lambda batches: sketched(batches, bits), "lang string, words long, block int, cells binary, counts binary"), "sketch")
    words = made.where("block is null").groupBy("lang").agg(F.sum("words").alias("n"))
    blocks = made.where("block is not null").select("block", "cells", "counts")
    reached = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(summed, "block int, cells binary")
    # two bytes for each cell that reaches it, of at most 2 to the BITS cells
    return words, [(r["block"], bytes(r["cells"])) for r in reached.toLocalIterator()]


def groups_of(found: DataFrame, shards: DataFrame, cells, group: int) -> list[tuple[DataFrame, DataFrame]]:
    """(patterns, texts) of each scan: about group of the patterns (lang, phrase, pid), and all texts (text, lang) where they can be.

    Two groups are looked for in all of the texts. Where there are more, only
    words are; phrases are dealt by their first two words, and windows of the
    texts with them, so that what is scanned does not grow with the groups.
    """
    alone = ~F.contains("phrase", F.lit(" "))
    n, singles = found.agg(F.count(F.lit(1)), F.count_if(alone)).first()
    head = F.slice(F.split("phrase", " "), 1, 2)
    whole = lambda df, k: [(df.where(F.pmod(F.xxhash64("lang", head), F.lit(k)) == i), shards) for i in range(k)]
    if n <= 2 * group:
        return whole(found, max(1, -(-n // group)))
    out = whole(materialize(found.where(alone), "singles"), -(-singles // group))
    k = -(-(n - singles) // group)
    dealt = materialize(found.where(~alone).mapInArrow(lambda batches: headed(batches, k), "lang string, phrase string, pid long, part int"), "headed", "part")
    texts = materialize(shards.mapInArrow(lambda batches: windows(batches, cells, k), "lang string, text string, part int"), "windows", "part")
    return out + [(dealt.where(F.col("part") == i), texts.where(F.col("part") == i).select("text", "lang")) for i in range(k)]


def counted_phrases(df: DataFrame, text: str = "text", lang: str = "lang", bits: tuple[int, int] = BITS, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): (lang, phrase, size, f) of all phrases and their words with f of the least count or more, and (lang, n)."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"))
    length = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # about a fifth as many phrases as bytes, and two cells or more for each
    wide = min(bits[1], max(bits[0], math.ceil(math.log2(length / 2 + 1))))
    words, blocks = frequent_cells(texts, wide)
    cells = spark.sparkContext.broadcast({"bits": wide, "blocks": blocks})
    # each task lists the phrases it finds: fewer, larger shards of the corpus list a phrase less often
    shards = texts.coalesce(max(2 * spark.sparkContext.defaultParallelism, length // SHARD))
    found = shards.mapInArrow(lambda batches: listed(batches, cells), "lang string, phrase string").distinct()
    own = found.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    found = materialize(found.unionByName(own).distinct().withColumn("pid", F.monotonically_increasing_id()), "patterns")
    counts = None
    for patterns, searched in groups_of(found, shards, cells, group):
        # about group patterns, whatever the size of the corpus
        automata = spark.sparkContext.broadcast({"patterns": Automata(patterns.select("lang", "phrase", "pid").orderBy("lang", "phrase").toArrow()).patterns})
        one = materialize(searched.mapInArrow(lambda batches, a=automata: scanned(batches, a), "pid long, n long").groupBy("pid").agg(F.sum("n").alias("f")), "counts")
        automata.unpersist()
        counts = one if counts is None else counts.unionByName(one)
    cells.unpersist()
    return materialize(found.join(counts.where(F.col("f") >= LEAST), "pid").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"), "phrases"), words


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, bits: tuple[int, int] = BITS, group: int = GROUP) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, words = counted_phrases(df, text, lang, bits, group)
    many = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    part = lambda a, b: F.array_join(F.slice(F.split("phrase", " "), a, b), " ")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", part(1, F.col("k"))).withColumn("right", part(F.col("k") + 1, F.col("size") - F.col("k")))
    of = lambda name, value: phrases.select(F.col("lang").alias("p_lang"), F.col("phrase").alias(name), F.col("f").alias(value))
    for name, value in (("left", "l"), ("right", "r")):
        cuts = cuts.join(of("p", value), (F.col("lang") == F.col("p_lang")) & (F.col(name) == F.col("p"))).drop("p_lang", "p")
    # 38 digits: counts up to 10 to the 16 are exact
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("l_", wide("l")).withColumn("r_", wide("r")).withColumn("a_", wide("a"))
    cuts = cuts.withColumn("score", F.expr("(cast(a_ * a_ as decimal(38,0)) * 1000000BD) div (l_ * r_)").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = materialize(scored.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score"), "scored")
    inner = lambda a: part(a, F.col("size") - 1)
    longer = scored.where("size > 2").select("lang", F.explode(F.array(inner(1), inner(2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("more"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("more") >= INSIDE * F.col("a"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    # a row a language
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
