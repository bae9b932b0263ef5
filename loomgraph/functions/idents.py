"""Identifiers: ids, paths, names and their words, as column expressions."""

from __future__ import annotations

import functools
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Tokens without meaning.
STOPWORDS = ("let", "mut", "fn", "pub", "return", "self", "for", "while", "loop", "if", "else", "match", "the", "and", "def", "class", "import", "from", "i64", "i32", "u64", "u32", "f64", "usize", "str", "string", "int", "float", "none", "true", "false", "result", "option", "vec", "new")
# Start and factor of FNV-1a in 64 bits.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Texts left from which bytes are hashed one text at a time, not place by place over all.
FEW = 8


def fnv(text: str) -> int:
    """FNV-1a in 64 bits of the UTF-8 bytes, as a signed number."""
    return signed(fnv_on(FNV_START, text.encode()))


def fnv_on(h: int, data: bytes) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def fnv_each(texts: pa.Array) -> pa.Array:
    """FNV-1a of each text: byte by byte over all texts of a batch at a time, the longest first."""
    a = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, ends = bounds[:-1][order], bounds[1:][order]
    ranked = -lengths[order]
    h, prime, t = np.full(len(order), FNV_START, np.uint64), np.uint64(FNV_PRIME), 0
    while (n := int(np.searchsorted(ranked, -t, "left"))) > FEW:  # texts of more than t bytes
        h[:n] = (h[:n] ^ data[starts[:n] + t]) * prime
        t += 1
    for k in range(n):
        h[k] = fnv_on(int(h[k]), data[starts[k] + t : ends[k]].tobytes())
    out = np.empty(len(order), np.uint64)
    out[order] = h
    return pa.array(out.view(np.int64), mask=pc.is_null(texts).to_numpy(zero_copy_only=False))


@functools.cache
def _hashed():
    return F.arrow_udf(fnv_each, T.LongType())


def node_id(path: Column) -> Column:
    """FNV-1a in 64 bits of the UTF-8 bytes, as the bits of a BIGINT; null of null.

    SQL has no multiplication modulo 2 to the 64, and a fold over letters is
    interpreted: 40 microseconds an id. Batches in numpy take about one.
    """
    return _hashed()(path)


def hex_id(i: Column) -> Column:
    """16 lower-case hex digits: the order of ids as unsigned numbers."""
    return F.lpad(F.lower(F.hex(i)), 16, "0")


def module_of(path: Column) -> Column:
    """The path without its last segment."""
    return F.regexp_replace(path, "::[^:]+$", "")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "::", -1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def stem(word: Column) -> Column:
    """A plural or third person without its ending; what ends in ss, us or is stays."""
    n = F.octet_length(word)
    cut = lambda k: F.left(word, F.char_length(word) - k)
    sibilant = F.lit(False)
    for s in ("ches", "shes", "sses", "xes", "zes"):
        sibilant = sibilant | F.endswith(word, F.lit(s))
    plain = F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")) & ~F.endswith(word, F.lit("us")) & ~F.endswith(word, F.lit("is"))
    return F.when((n > 4) & F.endswith(word, F.lit("ies")), F.concat(cut(F.lit(3)), F.lit("y"))).when((n > 4) & sibilant, cut(F.lit(2))).when((n > 3) & plain, cut(F.lit(1))).otherwise(word)


WORD, INNER = r"([\p{L}\p{N}_]+)", r"(?<=[\p{Ll}0-9])(?=\p{Lu})|_"


def kept(word: Column) -> Column:
    """Whether a stem is a token: three bytes or more, no stopword, no number."""
    return (F.octet_length(word) >= 3) & ~word.isin(*STOPWORDS) & ~F.regexp_like(word, F.lit(r"^\p{N}+$"))


def tokens(text: Column) -> Column:
    """The distinct tokens of a text: identifiers whole and by their words, lower case, stemmed, of three bytes or more, without stopwords and numbers."""
    whole = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 1))
    parts = F.array_distinct(F.flatten(F.transform(whole, lambda t: F.concat(F.array(t), F.split(t, INNER, -1)))))
    return F.array_distinct(F.filter(F.transform(parts, lambda w: stem(ascii_lower(w))), kept))


def token_pairs(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, token): the same as rows, each once for a row of df; a word that many texts of a batch have is cut up and stemmed once."""
    return df.select(*keys, F.explode(token_lists()(text)).alias("token"))


# The same in Python, for whole batches: letters, numbers and cases by Python's tables of Unicode.
ASCII_INNER = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|_")
FOLDED, STOPS = str.maketrans(UPPER, LOWER), frozenset(STOPWORDS)


@functools.cache
def word_chars() -> np.ndarray:
    """For each code point whether words have it."""
    table = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])
    table[ord("_")] = True
    return table


def inner_parts(word: str) -> list[str]:
    """The parts of a word between underscores, and between a small letter or digit and a capital."""
    if word.isascii():
        return ASCII_INNER.split(word)
    kinds = [unicodedata.category(c) for c in word]
    cut = [i for i in range(1, len(word)) if kinds[i] == "Lu" and (kinds[i - 1] == "Ll" or word[i - 1] in "0123456789")]
    return [p for a, b in zip([0, *cut], [*cut, len(word)], strict=True) for p in word[a:b].split("_")]


def stemmed(word: str) -> str:
    if word[-1:] != "s":
        return word
    n = len(word.encode())
    if n > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if n > 4 and word.endswith(("ches", "shes", "sses", "xes", "zes")):
        return word[:-2]
    return word[:-1] if n > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def word_tokens(word: str) -> list[str]:
    """The distinct tokens of a word."""
    if word.islower() and "_" not in word:  # one part, without a capital
        stems = (stemmed(word),)
    else:
        stems = dict.fromkeys(stemmed(p.translate(FOLDED)) for p in (word, *inner_parts(word)))
    return [t for t in stems if (len(t) >= 3 or len(t.encode()) >= 3) and t not in STOPS and (t.isalpha() or not all(unicodedata.category(c)[0] == "N" for c in t))]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, code, words): of each word of each text the text's place and its number among the distinct words."""
    a = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    known = word_chars()
    fits = (known[:256] & (np.arange(256) < 128))[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (more[lead + j].astype(np.int64) & (0x3F if j else 0xFF) for j in range(4))
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        code = np.select([size == 2, size == 3], [(b0 & 0x1F) << 6 | b1, (b0 & 0xF) << 12 | b1 << 6 | b2], (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)
        letter = known[np.minimum(code, 0x10FFFF)]
        for j in range(4):
            at = lead[letter & (size > j)] + j
            fits[at[at < len(data)]] = True
    # all else is blank
    spaced = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(bounds - bounds[0]), pa.py_buffer(np.where(fits, data, 32).astype(np.uint8))])
    split = pc.ascii_split_whitespace(spaced)
    codes = split.flatten().dictionary_encode()
    words = [w.decode(errors="replace") for w in codes.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
    return np.repeat(np.arange(len(a)), pc.list_value_length(split).to_numpy()), codes.indices.to_numpy(), words


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once: by sorting, since np.unique hashes first."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0]


def token_places(texts: pa.Array, known: dict[str, list[int]], places: dict[str, int]) -> np.ndarray:
    """Sorted distinct text * 2 to the 32 + place of the texts' tokens; known words and the places of tokens grow."""
    text, code, words = word_codes(texts)
    for w in words:
        if w not in known:
            known[w] = [places.setdefault(t, len(places)) for t in word_tokens(w)]
    each = [known[w] for w in words]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.fromiter(chain.from_iterable(each), np.int64, int(sizes.sum()))
    n, starts = sizes[code], (np.cumsum(sizes) - sizes)[code]
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return distinct(np.repeat(text, n) << 32 | flat[at])


def sliced(size: np.ndarray, limit: int = 16 << 20):
    """(from, to) of rows of a size that together have about the limit."""
    ends, at = np.cumsum(size), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def tokens_each(texts: pa.Array) -> pa.Array:
    known, places, found = {}, {}, [np.zeros(0, np.int64)]
    for at, to in sliced(byte_sizes(texts)):
        found.append(token_places(texts.slice(at, to - at), known, places) + (at << 32))
    found = np.concatenate(found)
    bounds = np.searchsorted(found >> 32, np.arange(len(texts) + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(list(places), pa.string()).take(pa.array(found & 0xFFFFFFFF)))


@functools.cache
def token_lists():
    """A function of a text column: its distinct tokens."""
    return F.arrow_udf(tokens_each, T.ArrayType(T.StringType()))


def with_identifier(text: Column, old: str, new: str) -> Column:
    """text with the identifier old, where it stands alone, replaced by new."""
    quoted = re.sub(r"([^\w])", r"\\\1", old)
    return F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])", new.replace("\\", "\\\\").replace("$", "\\$"))


def occurrences(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def hex_title(title: Column) -> Column:
    return F.lower(F.hex(F.encode(title, "UTF-8")))


def module_path(file: Column) -> Column:
    """The path of a file's module: crate, folders without a leading src, and the stem; mod, lib, main and __init__ name their folder."""
    bare = F.regexp_replace(F.regexp_replace(file, r"^(\./)?(src/)?", ""), r"\.[^./]+$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: (p != "") & ~p.isin("mod", "lib", "main", "__init__"))
    return F.array_join(F.concat(F.array(F.lit("crate")), parts), "::")


def language(file: Column) -> Column:
    """The language by extension; null for all else."""
    names = F.create_map(*[F.lit(x) for x in ("rs", "rust", "py", "python", "ts", "typescript", "mts", "typescript", "cts", "typescript", "tsx", "tsx", "go", "go")])
    return F.try_element_at(names, F.element_at(F.split(file, "[.]"), -1))


def callee_parts(text: Column) -> Column:
    """(qualifier, name) of a callee: the last dot or colons separate them."""
    return F.struct(F.nullif(F.regexp_extract(text, r"^(.*?)(?:::|\.)?([^.:]+)$", 1), F.lit("")).alias("qualifier"), F.regexp_extract(text, r"^(.*?)(?:::|\.)?([^.:]+)$", 2).alias("name"))


# Keywords that stand before a parenthesis.
KEYWORDS = ("if", "while", "for", "match", "return", "fn", "loop", "in", "as", "move")


def macro_calls(text: Column) -> Column:
    """Names before an opening parenthesis in macro text, outside strings and comments, without keywords."""
    masked = F.regexp_replace(text, r'"(?:\\.|[^"\\])*+"|//[^\n]*|/\*(?s:.*?)\*/', " ")
    found = F.regexp_extract_all(masked, F.lit(r"([A-Za-z_]\w*)\s*\("), 1)
    return F.filter(found, lambda n: ~n.isin(*KEYWORDS))
