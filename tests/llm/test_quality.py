"""Counts against plain Python, verdicts against the stated rules."""

import re

from tidewatch.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "a b", "a b c", "a b c a b c", "x x x x x", "a\na\n\na\n b\n", "\xa0 　 \x1c é ß 中文 \U0001f600", "#|<> *$ %& a#b", "one two three four\none two three five\none two three four\n" * 9, " ".join(f"w{i % 37}" for i in range(300)), "solid" * 3000]


def test_counts(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one")]
    got = quality.judge(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        n, *_, repeat = brute(t)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs([])).count() == 0


def test_hosts_and_their_documents(docs, words):
    clean = [(i, words(80), "en", "good") for i in range(60)]
    junk = [(100 + i, words(5), "en", "bad") for i in range(60)]
    table = lambda i: (i, " | ".join(words(80).split()), "en", "good" if i < 300 else "tables")
    rows = clean + junk + [(200, words(80), "en", "bad"), (201, words(80), "en", None), table(250)] + [table(i) for i in range(300, 340)] + [(400 + i, words(80), "en", "tables") for i in range(60)]
    got = {r.doc_id: r for r in quality.judge(docs(rows)).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[100 + i].kept for i in range(60))
    assert got[200].host_blocked and not got[200].kept and not got[200].base_failed
    assert got[201].kept
    assert got[250].kept  # one odd document of a good host
    assert not got[300].kept and got[400].kept  # many of a host whose others are fine
    kept = quality.keep(docs(rows, extra=True))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert kept.columns == docs(rows, extra=True).columns


def test_keep_judges_each_text_of_a_doc_id(docs, words):
    clean = words(200)
    rows = [(1, clean), (1, "too short"), (2, words(100)), (None, "short"), (None, words(90)), (3, None)]
    df = docs(rows, extra=True)
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
