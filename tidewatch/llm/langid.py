"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier per bit weighs hashed byte
n-grams by the log odds of the languages whose bit is one against the others.
A document's bit margins are compared with every codeword; logistic losses,
weighted by how well each bit separates the training languages, choose the
nearest one. A close runner-up is flagged as ambiguous.

Training counts n-grams over all labelled documents (no sample), combined per
task and per language before they meet; only the table languages x DIM, whose
size doesn't depend on the documents, comes to the driver.

Null texts and texts without a letter are ``und`` with score 0, as is all
where nothing is labelled. A null doc_id is neither trained on nor held out.
Repeated rows count as rows; whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, to_arrow

DIM = 1 << 14
ORDERS = (2, 3, 4)
#: Added to every count.
SMOOTH = 0.5 * 256
#: N-grams of a document that count in full; a longer one's are scaled down to as many in all, so
#: that no single document decides a language. Counts are whole numbers of 1 / UNIT.
EQUAL, UNIT = 20_000, 256
#: Margins in nats per n-gram are sharpened by this before the logistic loss.
SHARP = 4.0
#: A score under this is ambiguous.
CLEAR = 0.6
#: The model's rows: more labels than this are no languages.
MOST_LANGUAGES = 1000
UNKNOWN = "und"

#: What may be a letter: the pattern also has numerals and marks such as ², ½ or Ⅷ.
_WORDLIKE = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 20


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the byte n-grams of a lower-cased text, a bounded piece at a time."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data), _CHUNK):
        d = data[max(0, at - max(ORDERS) + 1) : at + _CHUNK].astype(np.uint32)
        lead = min(at, max(ORDERS) - 1)
        h = d.copy()
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(257) + d[n - 1 :]
            if n in ORDERS:
                # Of n-grams that begin in the piece before, only those that end in this one are new.
                yield (h[max(0, lead - n + 1) :] * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - 14)


def counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text)."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                table = held.setdefault(lang, np.zeros(DIM, np.int64))
                pieces = list(grams(text))
                n = sum(map(len, pieces))
                if n <= EQUAL:
                    for g in pieces:
                        np.add.at(table, g, UNIT)
                else:
                    own = sum(np.bincount(g, minlength=DIM) for g in pieces)
                    table += np.rint(own * (UNIT * EQUAL / n)).astype(np.int64)
        for lang, table in held.items():
            at = np.flatnonzero(table)
            yield to_arrow(schema, lang=[lang] * len(at), gram=at, n=table[at])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def codewords(k: int) -> np.ndarray:
    """k rows of +-1: all distinct splits for few languages, else a fixed dense random code."""
    if not k:
        return np.zeros((0, 0))
    if k <= 6:
        columns = range(1, 2 ** (k - 1))
        return np.array([[1 if c >> r & 1 else -1 for c in columns] for r in range(k)], float).reshape(k, -1)
    rng, bits = np.random.default_rng(k), 10 * k.bit_length()
    code = rng.choice([-1.0, 1.0], (k, bits))
    return code[:, np.abs(code.sum(0)) < k]


class Ecoc:
    def __init__(self, languages: list[str], table: np.ndarray):
        """table: n-gram counts, a row per language."""
        self.languages = languages
        self.code = codewords(len(languages))
        share = (table + SMOOTH) / (table + SMOOTH).sum(1, keepdims=True)
        # Languages count alike in a bit, however many documents they have.
        side = lambda b, s: share[self.code[:, b] == s].mean(0)
        odds = [np.log(side(b, 1)) - np.log(side(b, -1)) for b in range(self.code.shape[1])]
        self.odds = np.array(odds, np.float32).reshape(len(odds), DIM).T.copy()
        # Mean margin of each bit on the side where it belongs, per language and bit.
        own = (share @ self.odds) * self.code
        good = np.clip(own, 1e-3, None)
        self.weight = good / good.sum(1, keepdims=True) if good.size else good

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.odds.shape[1]), 0
        for g in grams(text):
            total += self.odds.take(g, 0).sum(0) if len(g) < DIM else np.bincount(g, minlength=DIM) @ self.odds
            n += len(g)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, whether another is about as near."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        f = self.margins(text) * SHARP
        loss = (np.logaddexp(0, -self.code * f) * self.weight).sum(1)
        p = np.exp((loss.min() - loss) * SHARP * 2)
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(min(p[best], 1.0)), bool(p[best] < CLEAR)


def train(labelled: DataFrame) -> Ecoc:
    n = counts(labelled)
    languages = [r[0] for r in n.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    languages.sort()
    table = np.zeros((len(languages), DIM))
    at = {x: i for i, x in enumerate(languages)}
    if languages:  # at most MOST_LANGUAGES x DIM numbers
        for r in n.groupBy("lang").agg(F.collect_list("gram").alias("g"), F.collect_list("n").alias("n")).toLocalIterator():
            table[at[r.lang], r.g] = r.n
    return Ecoc(languages, table)


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(docs: DataFrame, model: Ecoc) -> DataFrame:
    """docs: doc_id, held_out, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            lang, score, close = zip(*map(m.predict, b.column(2).to_pylist()), strict=True)
            yield to_arrow(PREDICTED, doc_id=b.column(0), held_out=b.column(1), lang_pred=lang, score=score, ambiguous=close)

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled documents outside fold 1 of three by crc32(doc_id), predict all."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    d = docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))
    return predict(d, train(d.where((fold != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())))
