"""BPE, packing and the coder against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tidewatch.llm import bpe, coder, packing, tokens
from tidewatch.llm.tokens import CachedEncoder, ColumnEncoder, LibraryWords

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a<|endoftext|>B <|startoftext|><|endoftext|> <|ENDOFTEXT|>", "x" * 3000, "ab" * 300 + "!" * 200, "it's I'LL we'd", "İstanbul ǅ ẞ ΣΣ é 가", "a\x1cb\x85c\xa0d　e​f", "\x00\x7f퟿", " \t\n", "12½٣ 3,4.5"]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def random_texts(n):
    rng = random.Random(3)
    alphabet = "abcdeÉéßñ'’ \t\n.,<|>0129²½ΑσK中文\U0001f600̧́"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["".join(chr(rng.randint(0, 0x3FF)) for _ in range(30)) for _ in range(n)]


def test_merges_equal_the_library():
    texts = ODD + random_texts(300)
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    own = CachedEncoder(PATH, bpe.RankMerge, lambda _, ids: list(ids), lambda parts: sum(parts, []))
    assert [sum(c, []) for c in own(texts)] == want
    lib = CachedEncoder(PATH, LibraryWords, packing.packed, b"".join)
    assert [np.frombuffer(b"".join(c), "<u4").tolist() for c in lib(texts)] == want
    assert own([None]) == [[]]


def test_columns_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "COLUMN_CHUNKS", 100)  # halves are dropped and chunks come back
    monkeypatch.setattr(tokens, "LIBRARY_PIECES", 7)
    texts = [None, *ODD, *random_texts(300), None]
    want = [e.ids for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encode, got = ColumnEncoder(PATH), []
    for at in [*range(0, len(texts), 50)] * 2:
        ids, offsets = encode(pa.array(texts[at : at + 50]))
        got += [ids[s:e].tolist() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == want * 2
    for empty in (pa.array([], pa.string()), pa.array([None], pa.string()), pa.array(["\x85"])):
        ids, offsets = encode(empty)
        assert len(ids) == 0 and offsets.tolist() == [0] * (len(empty) + 1)


def test_columns_encode_distinct_chunks_only(monkeypatch):
    encode, asked = ColumnEncoder(PATH), []
    words = encode.words
    monkeypatch.setattr(encode, "words", lambda pieces: asked.extend(pieces) or words(pieces))
    text = " ".join(f"Columnword{i}." for i in range(50)) * 20
    encode(pa.array([text] * 30))
    encode(pa.array([text]))
    assert 0 < len(asked) == len(set(asked))


def test_short_and_long_words_merge_alike():
    spec = CachedEncoder(PATH, bpe.RankMerge, bpe.kept, bpe.joined).spec
    m, rng = bpe.RankMerge(spec), random.Random(5)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, bpe.SHORT))) for _ in range(300)]
    assert m(words) == [m._long(m._parts(w)) for w in words]


def test_query_digests(docs):
    rows = list(enumerate([None, *ODD, *random_texts(20)])) + [(5, "twice"), (5, "twice"), (None, "no id")]
    t = library()
    got = sorted(map(tuple, bpe.encode_digests(docs(rows, extra=True), PATH).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    assert bpe.encode_digests(docs([]), PATH).count() == 0


def ids_of(text):
    return np.array([*library().encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_packing_holds_every_id_once(docs, words):
    rng = random.Random(1)
    rows = [(i, words(rng.choice([1, 5, 60, 400, 2500]))) for i in range(120)] + [(200, None), (201, ""), (202, "a"), (202, "a")]
    got = packing.pack(docs(rows, extra=True), PATH).toPandas()
    by = {i: ids_of(t) for i, t in rows}
    for r in got.itertuples():
        own = by[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    for i, g in got[got.doc_id != 202].groupby("doc_id"):
        g = g.sort_values("start")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(by[i])
    assert got[got.doc_id == 202].length.sum() == 2 * len(by[202])
    size = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.WINDOW
        n = g.length.sum()
        size += n if n & (n - 1) == 0 else packing.WINDOW
    assert size < 1.02 * got.length.sum() + 2 * packing.WINDOW
    assert packing.pack(docs([]), PATH).count() == 0


def test_windows_are_bounded():
    w, rng, most = packing.Windows(64, 4, 8), random.Random(2), 0
    for i in range(500):
        for seq in w.add(packing.Piece(i, 0, np.zeros(rng.randint(1, 200), "<u4"), 0)):
            assert sum(len(p.ids) for p in seq) <= 64
        most = max(most, len(w.room))
    assert most <= 4


@pytest.mark.parametrize("ids", [[], [0], [5] * 10, [0, 49407, 3], [2**28 - 2] * 3, list(range(5000)), [1, 2, 3] * 3000])
def test_coder_round_trip(ids):
    data = coder.encode(np.array(ids))
    assert coder.decode(data).tolist() == ids


def test_coder_random_and_damage():
    rng = np.random.default_rng(4)
    ids = rng.zipf(1.3, 9000) % 49408
    data = coder.encode(ids)
    assert coder.decode(data).tolist() == ids.tolist()
    assert len(coder.encode(np.tile(rng.integers(0, 40000, 50), 100))) < 2 * 5000 / 5
    for at in (200, len(data) // 2, len(data) - 40):
        bad = bytearray(data)
        bad[at] ^= 64
        with pytest.raises(ValueError):
            coder.decode(bytes(bad))


def test_order_0_predicts_ids():
    rng = np.random.default_rng(6)
    ids = rng.choice(rng.integers(1000, 49000, 20), 12000)  # no context helps, each id is one of 20
    data = coder.encode(ids)
    assert coder.decode(data).tolist() == ids.tolist()
    assert len(data) * 8 / len(ids) < np.log2(20) + 1.6


def test_blocks_of_a_segment_share_one_model():
    rng = np.random.default_rng(8)
    phrases = [rng.integers(0, 2**28 - 2, 12) for _ in range(40)]  # ids far apart are coded by rank
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 40, 4000)])  # each phrase is rare in one block
    data = coder.encode(ids)
    assert coder.decode(data).tolist() == ids.tolist()
    assert len(data) * 8 / len(ids) < 2
    for at in (5, 9, 14, 40):  # the head has a checksum of its own
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(bad))
    with pytest.raises(ValueError):
        coder.decode(data[:-3])


@pytest.mark.parametrize("n", [coder.BLOCK - 1, coder.BLOCK, coder.BLOCK + 1, 3 * coder.BLOCK + 17])
def test_coder_at_block_ends(n):
    ids = np.random.default_rng(n).zipf(1.2, n) % 49408
    assert coder.decode(coder.encode(ids)).tolist() == ids.tolist()


def test_files_give_offsets_and_checksums(docs, words, monkeypatch):
    monkeypatch.setattr(coder, "SEGMENT", 700)
    rows = [(i * 3 % 101, words(20)) for i in range(60)] + [(500, None), (501, ""), (502, words(3000))]
    files = coder.write(docs(rows, extra=True), PATH)
    assert files.count() > 1
    got = sorted(map(tuple, coder.read(files).collect()))
    want, at = [], 0
    for i, text in sorted(rows):
        ids = ids_of(text)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert coder.read(coder.write(docs([]), PATH)).count() == 0
