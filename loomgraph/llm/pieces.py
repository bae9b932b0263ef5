"""Encoding and decoding with a sentencepiece model of merge type, exactly and in one walk.

The model's own way merges the best adjacent pair again and again. Which tokens
come out is settled locally: a sequence of tokens is the encoding if each token
is the encoding of its own characters and each two adjacent ones are the
encoding of theirs. So a text is walked from left to right: an Aho-Corasick
automaton gives the longest piece at each place; a piece is taken if it is
compatible with the one before (their characters, merged again, give just these
two), else the next shorter one is tried; if none is left, the place is marked
in a bitfield as failed, the last token is taken back and its shorter ones are
tried. Every place fails once at most, so the walk is linear.

Characters that are in no piece stand for themselves, as their bytes. Where no
piece of the model goes on from one kind of character to another, there is a
bound between tokens anyway: texts are cut there, and what was found for a word
is kept in a bounded memory.

Defined cases: a null or empty text has no tokens; null and repeated ids and
equal texts are kept, row by row; very long texts, with or without white space,
are encoded whole; bounds and ties of merges are the model's own (of equal
scores the leftmost goes first); no rows give no rows; other columns of the
input stay, and the new ones take free names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .vector import pieces as slices
from .vector import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: White space as pieces write it.
SPACE = "▁"
#: Kinds of pieces of the model's format.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Words and pairs that a task remembers; beyond it, it begins anew. Longer words aren't remembered.
MEMORY, WORD = 1 << 18, 64
#: Letters, without the figures that Python counts among them.
LETTER = r"[^\W\d_²³¹¼½¾]"
#: Cuts of a text, the finer first: white space goes with what follows it; letters are apart from all else, or not.
CUTS = (rf"{SPACE}*{LETTER}+|{SPACE}*(?:(?!{SPACE}|{LETTER}).)+|{SPACE}+", rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: The score of two tokens that make no piece.
NEVER = float("-inf")


class Pieces:
    """The tables of a model: what the walk looks up."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        normal, trainer = spec.normalizer_spec, spec.trainer_spec
        if trainer.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model is asked for, that takes text as it is but for its spaces")
        if {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, 3, BYTE}:
            raise ValueError("pieces of the user's own or unused ones are not known here")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        if not trainer.byte_fallback or {c for p in self.ids for c in p} - self.ids.keys():
            raise ValueError("a model is asked for, that has each character of its pieces as a piece and writes others as bytes")
        # pieces that merging never makes are no tokens
        made = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p, i in made.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.text = [p.piece for p in spec.pieces]
        self.size = [len(p) for p in self.text]
        # the next shorter piece that a piece begins with, -1 behind the last one
        self.shorter = [-1] * len(self.text)
        for p, i in made.items():
            self.shorter[i] = next((made[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in made), -1)
        # the first cut that goes through no piece; each looks at two neighbours only, so none goes through a piece in a text
        self.cut = next((c for c in (re.compile(x, re.S) for x in CUTS) if all(c.findall(p) == [p] for p in self.ids)), None)
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Best adjacent pair first, of equal ones the leftmost: for the few characters of two pieces."""
        score, out = self.score.get, list(text)
        scores = [score(a + b, NEVER) for a, b in zip(out, out[1:], strict=False)]
        while scores and (best := max(scores)) != NEVER:
            i = scores.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(out[i - 1] + out[i], NEVER)
            if i < len(scores):
                scores[i] = score(out[i] + out[i + 1], NEVER)
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b side by side stay as they are when their characters are merged again."""
        if len(self.pairs) >= MEMORY:
            self.pairs.clear()
        x, y = self.text[a], self.text[b]
        known = self.pairs[a << 32 | b] = self.merged(x + y) == [x, y]
        return known

    def walk(self, text: str) -> list[int]:
        """The tokens of text, whose spaces are written as pieces write them; a character that is in no piece is below zero: -1 less its code point."""
        n = len(text)
        size, shorter, pairs = self.size, self.shorter, self.pairs
        longest = [-1] * (n + 1)
        for end, piece in self.automaton.iter(text):
            longest[end + 1 - size[piece]] = piece  # ends grow, so the last one is the longest
        failed, out, at = bytearray((n >> 3) + 1), [], 0
        last, piece = -1, longest[0]
        while at < n:
            if longest[at] < 0:  # a bound between tokens, whatever stands beside it
                last = -1 - ord(text[at])
                out.append(last)
                at += 1
                piece = longest[at]
                continue
            while piece >= 0:
                end = at + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | piece)
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                last, at = piece, end
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= size[last]
                piece = shorter[last]
                last = out[-1] if out else -1
        return out

    def word(self, text: str) -> list[int]:
        out = self.walk(text)
        if out and min(out) < 0:
            out = [i for t in out for i in ([t] if t >= 0 else [self.bytes[b] for b in chr(-1 - t).encode("utf-8", "surrogatepass")])]
        if len(text) <= WORD:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[text] = out
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        out: list[int] = []
        known, word = self.words, self.word
        for part in self.cut.findall(text) if self.cut else [text]:
            ids = known.get(part)
            out += word(part) if ids is None else ids
        return out


def shipped(spark, model: str):
    """The model's bytes, a file of the driver: under a megabyte goes with the tasks, as plain values, and each worker makes its tables once."""
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast({"model": f.read()})


def tables_of(shared: dict) -> Pieces:
    if "pieces" not in shared:
        shared["pieces"] = Pieces(shared["model"])
    return shared["pieces"]


def library_of(shared: dict):
    if "library" not in shared:
        import sentencepiece

        shared["library"] = sentencepiece.SentencePieceProcessor(model_proto=shared["model"])
    return shared["library"]


def encode(df: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """df with a column of token ids and, if it has a name, one of the text that the model decodes from them; both names are made free ones."""
    small_batches(df.sparkSession)
    shared = shipped(df.sparkSession, model)
    ids = fresh(df, ids)
    decoded = decoded and fresh(df.withColumn(ids, F.lit(0)), decoded)
    at = df.columns.index(next(c for c in df.columns if c.lower() == text.lower()))

    def run(batches):
        pieces = tables_of(shared.value)
        decode = library_of(shared.value).decode if decoded else None
        for batch in batches:
            for some in slices(batch, at):
                found = [pieces.encode(t or "") for t in some.column(at).to_pylist()]
                new = [pa.array(found, pa.list_(pa.int32()))]
                if decode:
                    new.append(pa.array([decode(x) if x else "" for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*some.columns, *new], names=[*some.schema.names, ids, *([decoded] if decoded else [])])

    fields = [*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return df.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL, name: str = "decoded") -> DataFrame:
    """df with a column of the texts that the model decodes from its ids; null ids give an empty text."""
    shared = shipped(df.sparkSession, model)
    name = fresh(df, name)
    at = df.columns.index(ids)

    def run(batches):
        library = library_of(shared.value)
        for batch in batches:
            texts = [library.decode(x) if x else "" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
