import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import queries, runs


def brute(words):
    """All (start, length, period) by the definition: every period, every stretch that keeps it."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period of the stretch comes first
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def caught(texts):
    texts = sorted(texts, key=len, reverse=True)
    names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    line, places = [], []
    for k, t in enumerate(texts):
        places.append(len(line))
        line += [names[w] for w in t] + [len(names) + k]
    out = {k: [] for k in range(len(texts))}
    for s, e, q in runs.catch(np.array(line, np.int64), np.array([len(t) for t in texts], np.int64)):
        k = int(np.searchsorted(places, s, "right")) - 1
        out[k].append((s - places[k], e - s, q))
    return texts, out


def periodic(rng):
    """Words with nested and neighbouring repetitions."""
    def piece(depth):
        if not depth:
            return [rng.choice("abc") for _ in range(rng.randint(1, 4))]
        inner = [w for _ in range(rng.randint(1, 3)) for w in piece(depth - 1)]
        return (inner * rng.randint(1, 6))[: rng.randint(1, 400)]
    return [w for _ in range(rng.randint(1, 4)) for w in piece(rng.randint(0, 3))]


@pytest.mark.parametrize("seed", range(60))
def test_equals_the_definition_on_nested_repetitions(seed):
    rng = random.Random(seed)
    texts, out = caught([periodic(rng) for _ in range(12)])
    for k, t in enumerate(texts):
        assert out[k] == brute(t), t


@pytest.mark.parametrize("q", [1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100])
def test_every_place_and_the_least_length(q):
    rng = random.Random(q)
    word = [f"w{i}" for i in range(q)]
    texts = []
    for at in range(0, 20):
        for length in (max(24, 3 * q) - 1, max(24, 3 * q), 4 * q + 30):
            texts.append([f"x{rng.random()}" for _ in range(at)] + [word[i % q] for i in range(length)] + ["end"] * (at % 2))
    texts, out = caught(texts)
    for k, t in enumerate(texts):
        assert out[k] == brute(t)


def test_degenerate_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 2500:
        fib.append(fib[-1] + fib[-2])
    thue = "".join(str(bin(i).count("1") % 2) for i in range(2048))
    spaced = ("a" * 60 + "b") * 12 + "a" * 300 + "c" + ("a" * 97 + "b") * 4
    texts, out = caught([list(x) for x in (fib[-1][:1500], thue, spaced, "a" * 1000, "ab" * 500, "aab" * 300 + "b" + "aab" * 100)])
    for k, t in enumerate(texts):
        assert out[k] == brute(t)


def test_work_stays_in_proportion():
    """All words equal, and blocks of equal words: few stretches are compared however many copies there are."""
    for unit in ([0], [0] * 500 + [1], [0] * 90 + [1] + [0] * 91 + [2]):
        n = 60_000
        words = np.array(([*unit] * (n // len(unit) + 1))[:n] + [9], np.int64)
        seen = []
        plain = runs._stretch
        runs._stretch = lambda *a: seen.append(a) or plain(*a)
        try:
            assert runs.catch(words, np.array([n])) != []
        finally:
            runs._stretch = plain
        assert len(seen) < n // 8


def test_a_collision_makes_no_run(monkeypatch):
    rng = random.Random(1)
    texts = [periodic(rng) for _ in range(4)] + [[f"u{i}" for i in range(60)]]
    monkeypatch.setattr(runs, "_doubled", lambda h, size: np.zeros(len(h) - size, np.uint64))
    texts, out = caught(texts)
    for k, t in enumerate(texts):
        assert out[k] == brute(t)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text, rewritten=False):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if rewritten and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return found, " ".join(w for i, w in enumerate(words) if i not in gone)


LINE = "one two three four five six seven eight nine ten"


def test_runs_and_collapsed_text(docs):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "  a b  c\n"), (5, f"start {LINE} " * 9 + "end"), (6, "x " * 30), (7, "x y \x1c " * 30), (None, "x " * 30), (6, "x " * 30), (8, "\x0bno\x0cway\r\n" * 12)]
    out = runs.find_runs(docs(rows, extra=True).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c"))).collect()
    got = sorted(((r.doc_id, [(x.start, x.length, x.period) for x in r.runs], r.collapsed, r.n_words) for r in out), key=str)
    assert got == sorted(((i, *expected(i, t), len(words_of(t))) for i, t in rows), key=str)
    assert runs.find_runs(docs([])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_runs(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    with_runs = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found, left = expected(r.doc_id, r.text, rewritten=True)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert tuple(got[r.doc_id]) == (r.doc_id, len(found), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(left))
        with_runs += bool(found)
    assert with_runs > 5
