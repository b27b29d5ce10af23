"""Near duplicates and repeated passages against brute force."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import minhash, shingles, substrings
from tidewatch.llm.components import components


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and len(x & y) >= 0.8 * len(x | y) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if v == hi else v for i, v in label.items()}
    return label


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.random()}"
    return " ".join(w)


def corpus(words):
    rng, rows = random.Random(11), []
    for k in range(12):
        base = words(rng.choice([12, 60, 200]))
        rows += [edited(base, e, rng) for e in (0, 0, 1, 2, 3, 6)] + [base.replace(" ", " \n ")]
    base = words(300)
    rows += [edited(base, rng.randint(1, 9), rng) for _ in range(60)]
    rows += [words(rng.choice([1, 3, 5, 50, 400])) for _ in range(40)] + ["dup", "dup", "a b", "", "", None, None]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(docs, words):
    rows = corpus(words)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(rows, extra=True)).collect()}
    assert got == brute_classes(rows)
    kept = minhash.keep_first(docs(rows + [rows[0]], extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_classes_of_documents_with_repeated_lines(docs, words):
    rows = []
    for c in (16, 32, 64):
        for _ in range(30):
            base, line = words(84), words(20)
            rows += [f"{base} {line}", f"{base} {' '.join([line] * c)}"]
    rows = list(enumerate(rows))
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(rows)).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) == 90


def test_empty_null_and_repeated(docs):
    assert minhash.classes(docs([])).count() == 0
    rows = [(1, None), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "x"), (5, "x")]
    got = sorted(map(tuple, minhash.classes(docs(rows)).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (None, 4)], key=repr)
    assert sorted([r.doc_id for r in minhash.keep_first(docs(rows)).collect()], key=repr) == sorted([1, 2, 3, 4, None], key=repr)


def test_of_a_doc_id_with_two_texts_the_one_of_its_own_class_stays(docs, words):
    rows = []
    for i in range(0, 200, 2):
        copied = words(30)
        rows += [(i, copied), (i + 1, copied), (i + 1, words(30))]
    df = docs(rows)
    want = sorted([t for k, (_, t) in enumerate(rows) if k % 3 != 1])
    assert sorted(r.text for r in minhash.keep_first(df).collect()) == want


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    a, b, both = (shingles.mix(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (30, 30, 140))
    one = lambda x: (np.concatenate([x, both]), np.ones(len(x) + len(both)))
    s = minhash.signatures([one(a), one(b), one(a)], 4096)
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 0.7) < 0.03
    heavy = (one(a)[0], np.where(np.arange(170) < 30, 10.0, 1.0))
    share = 300 / 440
    assert abs(np.isin(minhash.signatures([heavy], 4096)[0], a).mean() - share) < 0.03


def brute_weighted(rows):
    """Classes of documents alike in plain or weighted shingles, and the pairs alike in weights alone."""
    tokens = {i: [int(x) for x in shingles.words(t)] for i, t in rows}
    names = {i: (t or "").split() for i, t in rows}
    count = Counter(x >> 48 for w in tokens.values() for x in w)
    level = lambda x: round(8 * math.log2(count.total() / count[x >> 48]))
    of = {}
    for i, w in tokens.items():
        k = min(5, len(w))
        of[i] = {tuple(names[i][j : j + k]): min(255, max(1, sum(map(level, w[j : j + k])) // k)) for j in range(len(w) - k + 1)} if w else {}
    label, only = {i: i for i in of}, set()
    for a in sorted(of):
        for b in sorted(of):
            x, y = of[a], of[b]
            if a < b and x and y:
                plain = len(x.keys() & y.keys()) >= 0.8 * len(x.keys() | y.keys())
                heavy = sum(x[s] for s in x.keys() & y.keys()) * 10 >= 8 * sum((x | y).values())
                only |= {(a, b)} if heavy and not plain else set()
                if (plain or heavy) and label[a] != label[b]:
                    lo, hi = sorted((label[a], label[b]))
                    label = {i: lo if v == hi else v for i, v in label.items()}
    return label, only


def test_classes_by_weighted_shingles_equal_brute_force(docs, words):
    rng, rows = random.Random(3), []
    phrases = [words(18) for _ in range(8)]
    for k in range(40):  # documents of their own words that differ in common phrases, and others with the same phrases
        body = words(rng.choice([40, 80, 120, 160]))
        rows += [f"{body} {rng.choice(phrases)}" for _ in range(3)] + [f"{edited(body, 1, rng)} {rng.choice(phrases)}"]
        rows += [f"{words(30)} {rng.choice(phrases)}", " ".join(rng.sample(phrases, 3))]
    rows = list(enumerate([*rows, "", None, "one", "one two"]))
    want, only = brute_weighted(rows)
    assert len(only) >= 20 and want != brute_classes(rows)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs(rows, extra=True)).collect()}
    assert got == want
    assert all(got[a] == got[b] for a, b in only)


def test_a_shingle_weighs_the_same_in_all_documents(docs, words):
    phrase, own = words(9), words(40)
    levels = minhash.word_levels(docs([(i, f"{phrase} {words(20)}") for i in range(50)] + [(50, own), (51, None)]))
    weight = lambda t: {int(s): int(w) for h in [minhash.weighted_shingles(shingles.words(t), levels)] for s, w in zip(h, minhash.weights(h), strict=True)}
    alone, within, rare = weight(phrase), weight(f"{own} {phrase} {phrase} {own}"), weight(own)
    assert len(alone) == 5 and alone.items() <= within.items() and rare.items() <= within.items()
    assert max(alone.values()) < min(rare.values())
    assert len(minhash.weighted_shingles(shingles.words(""), levels)) == 0 and len(weight("a b")) == 1


def test_templated_documents_make_few_candidates(spark, docs, words):
    def asked(n):
        phrase = words(40)
        df = docs([(i, f"{phrase} {words(14)} {phrase[::-1]}") for i in range(n)])
        sets = minhash.shingle_sets(df, minhash.word_levels(df))
        return minhash.across(df.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")), sets).count() / n

    assert asked(600) <= 2 * asked(150) + 10


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((100, 200, 300), 100)


def test_windows_equal_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for n, least in ((30, 4), (200, 13), (46, 46), (5, 6), (400, 46)):
        h = shingles.mix(rng.integers(0, 60, n).astype(np.uint64))
        bits = max(1, n.bit_length())
        v = [(x >> bits, i) for i, x in enumerate(h.tolist())]
        want = set()
        for c in range(n):
            lo, hi = c, c
            while lo and v[lo - 1] > v[c]:
                lo -= 1
            while hi < n - 1 and v[hi + 1] > v[c]:
                hi += 1
            if hi - lo + 1 >= least:
                want.add((c, lo, hi))
        one, two = np.zeros(n, np.int64), np.repeat([0, 1], n)
        assert set(zip(*(x.tolist() for x in substrings.compact_windows(h, one, least)), strict=True)) == want
        twice = set(zip(*(x.tolist() for x in substrings.compact_windows(np.concatenate([h, h]), two, least)), strict=True))
        if 60 > n:  # (with more places fewer bits order the hashes)
            assert {w for w in twice if w[0] < n} == want and {tuple(x - n for x in w) for w in twice if w[0] >= n} == want


def test_passages_equal_brute_force(docs, words):
    rng, rows = random.Random(5), []
    shared = [words(n) for n in (50, 55, 70, 120)]
    for i in range(60):
        parts = [words(rng.choice([10, 60, 150]))] + [p for p in shared if rng.random() < 0.15] + [words(rng.choice([0, 40]))]
        rows.append((i, " \n".join(parts)))
    rows += [(100, None), (101, ""), (102, words(49)), (103, "same " * 400), (104, rows[3][1]), (104, rows[3][1])]
    got = substrings.passages(docs(rows, extra=True)).collect()
    text = {i: (t or "").split() for i, t in rows}
    first, want = {}, set()
    for i in sorted(text):
        w = text[i]
        grams = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        want |= {i} if any(g in first for g in grams) else set()
        first.update({g: i for g in grams if g not in first})
    assert {r.doc_id for r in got} == want
    for r in got:
        assert r.first_id < r.doc_id and text[r.doc_id][r.start : r.end] == text[r.first_id][r.first_start : r.first_end] and r.n_words >= 50
    assert substrings.passages(docs([])).count() == 0


def test_passages_that_an_earlier_document_holds_in_part(docs, words):
    rng, rows = random.Random(8), []
    for _ in range(40):
        p, q, r = words(70), words(50), words(60)
        part = " ".join(q.split()[:40] if rng.random() < 0.5 else q.split()[10:])
        rows.append(f"{p} {words(20)} {part} {words(30)}")  # all of p, most of q
        rows.append(f"{words(9)} {q} {words(30)} {r} {words(9)} {p}")
        rows.append(f"{r} {words(25)} {p} {words(11)} {q}" if rng.random() < 0.5 else f"{p} {q} {words(8)} {r}")
        rows.append(f"{part} {words(80)} {q}")
    rows = list(enumerate(rows))
    held = {}
    for r in substrings.passages(docs(rows)).collect():
        held.setdefault(r.doc_id, []).append((r.start, r.end))
    first, missed = {}, []
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i and not any(s <= k and k + 50 <= e for s, e in held.get(i, ())):
                missed.append((i, k))
    assert not missed


def test_one_changed_word_is_aligned():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**60, 120)
    b = np.concatenate([rng.integers(0, 2**60, 20), a[:60], rng.integers(0, 2**60, 5), a[65:], rng.integers(0, 2**60, 9)])
    assert substrings.align(a, b, {-20}) == [(0, 120, 20, 140)]
    assert substrings.align(a[:40], b, {-20}) == []


def test_repeats_are_cut_from_later_documents(docs, words):
    p = words(60)
    rows = [(1, f"head {p} tail"), (2, f"Vor  {p}\n nach"), (3, words(80)), (4, None), (None, p)]
    df = docs(rows, extra=True)
    got = {r.doc_id: r.text for r in substrings.remove_repeats(df).collect()}
    assert got == {1: rows[0][1], 2: "Vor  nach", 3: rows[2][1], 4: None, None: p}
    assert substrings.remove_repeats(df).columns == df.columns
    assert substrings.without("a bb  ccc d", [(1, 3)]) == "a d"


def test_texts_of_one_doc_id_are_cut_by_themselves(docs, words):
    passage, own = words(60), words(120)
    rows = [(1, words(20) + " " + passage), (2, passage + " " + words(30)), (2, own), (3, own + " x"), (2, own)]
    df = docs(rows).withColumn("_spans", F.lit(1)).withColumn("_node", F.lit("n"))
    got = sorted((r.doc_id, r.text) for r in substrings.remove_repeats(df).collect())
    left = rows[1][1][len(passage) + 1 :]
    kept = [t for i, t in got if i == 2]
    assert left in kept and len(got) == 5
    # of the two documents with the same 120 words one keeps them: doc_id 3 is before 2's second text or 2's is the least
    assert sum(own in t for _, t in got) in (1, 2) and any(own in t for _, t in got)
    assert substrings.remove_repeats(df).columns == df.columns
    found = substrings.passages(df).collect()
    assert {(r.doc_id, r.first_id) for r in found} <= {(2, 1), (3, 2), (2, 3)} and (2, 1) in {(r.doc_id, r.first_id) for r in found}


def near_pairs(words, rng, n, length, changes):
    """Texts that share one passage of ``length`` words with ``changes`` words replaced inside."""
    out = []
    for _ in range(n):
        p = words(length).split()
        q = list(p)
        for i in rng.sample(range(10, length - 10), changes):
            q[i] = f"other{i}"
        out.append((" ".join([words(70), *p, words(40)]), " ".join([words(45), *q, words(60)])))
    return out


def test_recall_of_near_passages(docs, words):
    """Against brute force (all diagonals of the pair aligned), pairs alone and behind an earlier partial holder."""
    rng = random.Random(5)
    rows, pairs, number = [], [], 0
    for length, changes in ((55, 1), (60, 1), (70, 1), (80, 1), (100, 2), (140, 3)):
        for a, b in near_pairs(words, rng, 25, length, changes):
            early = " ".join([words(50), *a.split()[70 : 70 + length // 2]])  # holds a part of the passage
            rows += [(number, early), (number + 1, a), (number + 2, b)]
            pairs.append((number + 1, number + 2, a, b))
            number += 3
    found = {(r.first_id, r.doc_id) for r in substrings.passages(docs(rows)).collect()}
    want = caught = 0
    for i, j, a, b in pairs:
        x, y = (shingles.of_words(shingles.words(t)) for t in (a, b))
        if substrings.align(y, x, set(range(-len(x), len(y)))):
            want += 1
            caught += (i, j) in found
    print("recall", caught, want)
    assert want >= 80 and caught >= 0.95 * want


def test_windows_are_made_once(docs, words, monkeypatch):
    asked, real = [], substrings.windows
    monkeypatch.setattr(substrings, "windows", lambda *a: asked.append(a) or real(*a))
    text = words(80)
    found = substrings.passages(docs([(1, text), (2, words(30) + " " + text), (3, words(80))])).collect()
    assert [(r.doc_id, r.first_id, r.n_words) for r in found] == [(2, 1, 80)]
    assert len(asked) == 1


def test_shingles_of_texts_together():
    texts = ["", "a b c", "a b c d e f", " \n", "x" * 400 + " y z \x85 q w e r", "a b c d"]
    assert [s.tolist() for s in substrings._shingles(texts)] == [substrings.S.of_words(substrings.S.words(t)).tolist() for t in texts]
    assert [s.tolist() for s in substrings._shingles([""])] == [[]]


def test_enough_functions_overlap():
    rng, least = np.random.default_rng(9), 5
    group, k = np.sort(rng.integers(0, 60, 300)), rng.integers(0, substrings.HASHES, 300)
    a, b, left, right = rng.integers(20, 40, 300), rng.integers(20, 40, 300), rng.integers(0, 12, (2, 300)), rng.integers(0, 12, (2, 300))
    pack = lambda i, at: at << 32 | left[i] << 16 | right[i]
    want = set()
    for g in range(60):
        under: dict[int, set] = {}
        for i in np.flatnonzero(group == g):
            s, e = a[i] - min(left[:, i]), a[i] + min(right[:, i]) + 1
            for start in range(s, e - least + 1):
                under.setdefault(start, set()).add(k[i])
        if any(len(u) >= 2 for u in under.values()):
            want.add(g)
    got = substrings.enough(group, k, pack(0, a), pack(1, b), least, 2)
    assert set(got.tolist()) == want and 0 < len(want) < 60
