"""Reading a word-BPE tokenizer file and cutting texts into its pre-tokens.

A pre-token never crosses white space, so ``encode(text)`` is the
concatenation of ``encode(chunk)`` over the chunks between white space. Each
distinct chunk is encoded once per worker and remembered; of a bounded cache,
the older half goes when the newer one is full.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import worker_state

#: Chunks in each half of a worker's cache (only speed depends on it).
CACHE_CHUNKS = 300_000
#: Longer chunks are encoded each time they occur.
CACHE_CHARS = 64
#: The same for a worker's cache of ``ColumnEncoder``.
COLUMN_CHUNKS = 500_000
#: Pre-tokens in its cache of those, which starts anew when it is full.
COLUMN_PIECES = 300_000
#: Pre-tokens in one call of the library.
LIBRARY_PIECES = 1 << 16

_C0 = re.compile("[\x1c-\x1f]")
_ASCII_SPACE = re.compile(r"[ \t-\r]+")
_MARKS = frozenset(".,;:!?|")
# The pre-tokenizer's pattern for characters below U+0250, whose classes no Unicode version changes.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\xa0\p{L}\p{N}]+")
# The same over many chunks in lower case, one in a line: the letters (with those that some of them have as
# lower case) and numbers by name, for which the standard library's patterns do and are faster.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-\u02af\u2c65\u2c66", "0-9²³¹¼-¾"
_LINES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r\x20\x85\xa0{_L}{_N}]+|\n")
# Chunks that those patterns are not enough for: other characters, perhaps a special token.
_RARE = re.compile("[\u0250-\U0010ffff]|<\\|")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [table[b] for b in range(256)]


class _Letters(dict):
    """For str.translate: a character to the byte letters of its UTF-8."""

    def __missing__(self, c: int) -> str:
        self[c] = "".join(byte_letters()[b] for b in chr(c).encode("utf-8", "surrogatepass"))
        return self[c]


class WordTokens:
    """The tokenizer file: vocabulary, merges, special tokens, and its own normaliser."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.suffix: str = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._letters = _Letters()

    def chunks(self, text: str | None) -> list[str]:
        """Parts of the text between white space; every separator is one for the tokenizer too."""
        if not text:
            return []
        if _C0.search(text):  # str.split would cut at these, the tokenizer doesn't
            return [c for c in _ASCII_SPACE.split(text) if c]
        return text.split()

    def pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a chunk in byte letters, or the id of a special token."""
        if "<|" in chunk and self._special.search(chunk):
            parts = self._special.split(chunk)
            return list(chain.from_iterable([self.special[p]] if p in self.special else self.pieces(p) for p in parts if p))
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in _MARKS:
                return [low[:-1], low[-1]]
            found = _PIECES.findall(low)
            return found if low.isprintable() else [p.translate(self._letters) for p in found]
        if max(chunk) < "ɐ":
            low = "".join(map(str.lower, chunk))
            found = [low] if low.isalpha() else _PIECES.findall(low)
            return [p.translate(self._letters) for p in found]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]


class LibraryWords:
    """Ids of pre-tokens by the tokenizers library's BPE model."""

    def __init__(self, spec: WordTokens):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer(spec.library.model)

    one = staticmethod(lambda i: np.array([i], "<u4").tobytes())

    def __call__(self, pieces: list[str]) -> list[bytes]:
        """Of each pre-token, its ids as little-endian 32-bit integers."""
        e = self.model.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(e.ids, "<u4").tobytes()
        ends = (4 * np.flatnonzero(np.diff(np.array(e.word_ids), append=-1)) + 4).tolist()
        return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]


class CachedEncoder:
    """Encodes whole texts, each distinct chunk once.

    ``words`` maps pre-tokens to ids, ``value`` turns ids into what is kept of
    them, ``join`` makes a chunk's from those of its pre-tokens.
    """

    def __init__(self, path: str, words, value, join):
        state = worker_state("chunks")
        if (key := (path, words.__name__, value.__name__)) not in state:
            spec = WordTokens(path)
            state[key] = (spec, words(spec), [{}, {}])
        self.spec, self.words, self.halves = state[key]
        self.value, self.join = value, join

    def __call__(self, texts: list[str | None]) -> list[list]:
        """For each text, the kept values of its chunks in order."""
        split = [self.spec.chunks(t) for t in texts]
        if len(self.halves[0]) > CACHE_CHUNKS:
            self.halves[:] = {}, self.halves[0]
        cache, older = self.halves
        unseen = set().union(*split).difference(cache)
        back = [c for c in unseen if c in older]
        cache.update(zip(back, map(older.__getitem__, back), strict=True))  # chunks in use outlive the older half
        missing = list(unseen.difference(back))
        now = dict(zip(missing, self._encode(missing), strict=True))
        long = {c: now.pop(c) for c in missing if len(c) > CACHE_CHARS}
        cache.update(now)
        get = cache.__getitem__
        if long:
            return [[long[c] if c in long else get(c) for c in s] for s in split]
        return [list(map(get, s)) for s in split]

    def _encode(self, chunks: list[str]) -> list:
        cut = list(map(self.spec.pieces, chunks))
        own = list({p for p in chain.from_iterable(cut) if isinstance(p, str)})
        known = {i: self.value(self.spec, self.words.one(i)) for i in self.spec.special.values()}
        if own:
            known.update(zip(own, (self.value(self.spec, ids) for ids in self.words(own)), strict=True))
        return [known[c[0]] if len(c) == 1 else self.join([known[p] for p in c]) for c in cut]


class LibraryIds:
    """Ids of pre-tokens by the tokenizers library's BPE model, as an Arrow column of binary values.

    The last id of each pre-token, and no other, is that of a token with the end-of-word suffix.
    """

    def __init__(self, spec: WordTokens):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = Tokenizer(spec.library.model)
        self.model.model._resize_cache(0)  # pre-tokens come once
        self.last = np.zeros(max(spec.vocab.values()) + 1, bool)
        self.last[[i for t, i in spec.vocab.items() if t.endswith(spec.suffix)]] = True

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokens after each other, and where those of each end."""
        found = []
        for at in range(0, len(pieces), LIBRARY_PIECES):
            found.append(np.array(self.model.encode_batch_fast([pieces[at : at + LIBRARY_PIECES]], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(found) if found else np.zeros(0, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("a pre-token without a token that ends it")
        return ids, ends


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Values that follow each other in ``data``; ``ends`` in bytes."""
    offsets = np.concatenate([np.zeros(1, np.int64), ends.astype(np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def parts_of(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's values after each other, and their offsets (one more than values)."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def strings(column: pa.StringArray, between: str) -> list[str]:
    """The values of a column as a list (in fewer steps than Arrow's); none holds ``between``."""
    if not len(column):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), between)[0].as_py().split(between)


class ColumnEncoder:
    """Encodes columns of whole texts to ids by the tokenizers library, each distinct chunk once.

    Arrow cuts the texts at ASCII white space, numbers the distinct chunks of a
    column and lines up their ids; Python handles those chunks alone. They are
    remembered as in ``CachedEncoder``.
    """

    def __init__(self, path: str):
        state = worker_state("columns")
        if path not in state:
            spec = WordTokens(path)
            table = list(byte_letters())
            table[32], table[10] = " ", "\n"  # between pieces and between chunks
            state[path] = (spec, LibraryIds(spec), "".join(table), [{"": b""}, {}], {})
        self.spec, self.words, self.table, self.halves, self.known = state[path]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and their offsets (one more than texts)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.dictionary_encode(split.flatten())
        data, offsets = parts_of(pa.array(self._values(strings(coded.dictionary, "\n")), pa.large_binary()).take(coded.indices))
        upto = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return data.view("<u4"), np.concatenate([np.zeros(1, np.int64), offsets[upto]]) // 4

    def _values(self, chunks: list[str]) -> list[bytes]:
        if len(self.halves[0]) > COLUMN_CHUNKS:
            self.halves[:] = {"": b""}, self.halves[0]
        cache, older = self.halves
        out = list(map(cache.get, chunks))
        at = [i for i, v in enumerate(out) if v is None]
        for i in at:
            out[i] = older.get(chunks[i])
        missing = [i for i in at if out[i] is None]
        if missing:
            for i, v in zip(missing, self._encode([chunks[i] for i in missing]), strict=True):
                out[i] = v
        for i in at:  # chunks in use outlive the older half
            if len(c := chunks[i]) <= CACHE_CHARS:
                cache[c] = out[i]
        return out

    def _encode(self, chunks: list[str]) -> list[bytes]:
        all_ = "\n".join(chunks)
        if not _RARE.search(all_):
            return self._plain(chunks)
        # (an ASCII chunk can only hold a special token)
        search = _RARE.search
        rare = [bool(search(c)) for c in chunks] if "<|" in all_ else [not c.isascii() and bool(search(c)) for c in chunks]
        odd, plain = iter(self._rare(list(compress(chunks, rare)))), iter(self._plain([c for c, r in zip(chunks, rare, strict=True) if not r]))
        return [next(odd if r else plain) for r in rare]

    def _plain(self, chunks: list[str]) -> list[bytes]:
        """Of chunks of characters below U+0250 without special tokens: all pieces by one pattern, their letters by one table."""
        if not chunks:
            return []
        found = _LINES.findall("\n".join(chunks).lower()) + ["\n"]
        pieces = pc.dictionary_encode(pa.array(codecs.charmap_decode(" ".join(found).encode(), "strict", self.table)[0].split(" "), pa.string()))
        own = strings(pieces.dictionary, " ")
        line = own.index("\n")
        own[line] = ""  # the end of a line has no ids
        data, offsets = parts_of(pa.array(self._pieces(own), pa.large_binary()).take(pieces.indices))
        cuts = offsets[np.flatnonzero(pieces.indices.to_numpy() == line)].tolist()
        raw = data.tobytes()
        return [raw[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens; of one that other chunks had before, those found then."""
        if len(self.known) > COLUMN_PIECES:
            self.known.clear()
        self.known[""] = b""
        out = list(map(self.known.get, pieces))
        missing = [p for p, v in zip(pieces, out, strict=True) if v is None]
        ids, ends = self.words(missing)
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        new = [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        self.known.update((p, v) for p, v in zip(missing, new, strict=True) if len(p) <= CACHE_CHARS)
        left = iter(new)
        return [next(left) if v is None else v for v in out]

    def _rare(self, chunks: list[str]) -> list[bytes]:
        cut = list(map(self.spec.pieces, chunks))
        own = list({p for p in chain.from_iterable(cut) if isinstance(p, str)})
        ids, ends = self.words(own)
        known = {i: [i] for i in self.spec.special.values()}
        known.update((p, ids[s:e]) for p, s, e in zip(own, [0, *ends.tolist()], ends.tolist(), strict=False))
        return [np.concatenate([known[p] for p in c]).astype("<u4").tobytes() if c else b"" for c in cut]
