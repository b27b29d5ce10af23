"""Host-level quality rules, in DataFrame functions alone.

Every document is measured once. Failures of each rule are counted per host
(``source``), the rates are shrunk towards an empirical beta prior (method of
moments over the hosts), and the host's verdicts go back to its documents:

* a document that fails a base rule is rejected wherever it comes from;
* a host whose shrunk rate of any rule is over ``BLOCK`` loses all documents;
* a document that fails a soft rule is rejected if its host's shrunk rate of
  that rule is over ``DOUBT``; elsewhere it has the benefit of the doubt.

Counting per host combines before the shuffle; the join back is an ordinary
equi-join, which AQE broadcasts or splits where one host is hot.

Null and empty texts have no words and fail the base rule. A null host is a
host of its own. Repeated rows are judged as rows; an empty table gives an
empty result. Windows of three words are compared by a 64-bit hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

LEAST_WORDS = 50
#: Strength of the prior, in documents: at least and at most.
WEAK, STRONG = 1.0, 1000.0
BLOCK, DOUBT = 0.5, 0.1

_BLANK = " \t\n\x0b\f\r"

#: rule -> SQL condition over the measured columns, that also holds in other engines.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
BASE = ("short", "repeats")
SOFT = tuple(r for r in RULES if r not in BASE)


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANK))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts of each text, in whole-row expressions without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    d = docs.select(*keep, text.alias("_t"), F.when(_trimmed(text) == "", none).otherwise(F.split(_trimmed(text), SPACE)).alias("_w"))
    d = d.select(*keep, "_t", "_w", F.size("_w").alias("_n"), F.filter(F.split("_t", "\n"), lambda x: _trimmed(x) != "").alias("_l"))
    gram = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    d = d.withColumn("_g", F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), gram)).otherwise(F.array().cast("array<bigint>")))
    # Windows in the order of their hash; one is repeated if a neighbour is equal.
    found = F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), found))
    same = lambda x, j: (x["g"] == F.get("_s", j - 1)["g"]) | (x["g"] == F.get("_s", j + 1)["g"])
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"])))
    # Each repeated window covers its words up to the next one's start.
    covered = F.aggregate(F.transform("_p", lambda p, j: F.coalesce(F.least(F.lit(3), F.get("_p", j + 1) - p), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return d.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def shrunk(hosts: DataFrame) -> DataFrame:
    """Per host and rule, the mean of the rate's posterior: ``p_<rule>``."""
    rate = lambda r: F.col(f"f_{r}") / F.col("n")
    prior = hosts.agg(*[f(rate(r)).alias(f"{n}_{r}") for r in RULES for n, f in (("m", F.avg), ("v", F.var_samp))]).first()
    out = []
    for r in RULES:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, WEAK), STRONG) if v > 0 else STRONG
        out.append(((F.col(f"f_{r}") + m * strength) / (F.col("n") + strength)).alias(f"p_{r}"))
    return hosts.select("source", *out)


def judge(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and the host's verdict."""
    keep = list(dict.fromkeys(["doc_id", "source", *keep]))
    measured = measure(docs, keep)
    # Measured once: written before it is counted per host and joined with that.
    m = cut(measured.withColumns({f"r_{r}": F.expr(c) for r, c in RULES.items()}))
    hosts = shrunk(m.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"r_{r}").alias(f"f_{r}") for r in RULES]))
    either = lambda cs: reduce(lambda a, b: a | b, cs)
    verdict = hosts.select(
        F.col("source").alias("_host"),
        either([F.col(f"p_{r}") > BLOCK for r in RULES]).alias("host_blocked"),
        *[(F.col(f"p_{r}") > DOUBT).alias(f"d_{r}") for r in SOFT],
    )
    j = m.join(verdict, m["source"].eqNullSafe(verdict["_host"]), "left")
    failed = either([F.col(f"r_{r}") for r in BASE])
    doubted = either([F.col(f"r_{r}") & F.col(f"d_{r}") for r in SOFT])
    return j.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~(failed | F.col("host_blocked") | doubted)).alias("kept"),
        "host_blocked",
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns; each row is judged by its doc_id, host and text."""
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    gone = judge(hashed, ["_text_hash"]).where(~F.col("kept")).select("doc_id", "source", "_text_hash").distinct()
    gone = gone.toDF("_id", "_host", "_hash")
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & docs["source"].eqNullSafe(gone["_host"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    return docs.join(gone, same, "left_anti")


def _sql() -> str:
    rules = ", ".join(f"({c}) as r_{r}" for r, c in RULES.items())
    fails = ", ".join(f"count(*) filter (r_{r}) as f_{r}" for r in RULES)
    moments = ", ".join(f"avg(f_{r} * 1.0e0 / n) as m_{r}, coalesce(var_samp(f_{r} * 1.0e0 / n), 0) as v_{r}" for r in RULES)
    strength = lambda r: f"case when v_{r} > 0 then least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {WEAK}), {STRONG}) else {STRONG} end"
    rates = ", ".join(f"(f_{r} + m_{r} * ({strength(r)})) / (n + ({strength(r)})) as p_{r}" for r in RULES)
    return f"""
with t as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
p as (select doc_id, unnest(ws) as a, generate_subscripts(ws, 1) as i from w),
g as (select doc_id, i, a, lead(a) over q as b, lead(a, 2) over q as c from p window q as (partition by doc_id order by i)),
h as (select doc_id, i, case when c is not null then count(*) over (partition by doc_id, a, b, c) else 0 end as k from g),
r as (select doc_id, i, k, lag(k, 1, 0) over q as k1, lag(k, 2, 0) over q as k2 from h window q as (partition by doc_id order by i)),
s as (select doc_id, count(*) as n_repeat_words from r where k > 1 or k1 > 1 or k2 > 1 group by doc_id),
m as (select w.doc_id, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words
      from w left join s on w.doc_id = s.doc_id),
f as (select *, {rules} from m),
hosts as (select source, count(*) as n, {fails} from f group by source),
prior as (select {moments} from hosts),
rate as (select source, {rates} from hosts, prior)
select doc_id, f.source as source, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  ({" or ".join(f"r_{r}" for r in BASE)}) as base_failed,
  not (({" or ".join(f"r_{r}" for r in BASE)}) or ({" or ".join(f"p_{r} > {BLOCK}" for r in RULES)}) or {" or ".join(f"(r_{r} and p_{r} > {DOUBT})" for r in SOFT)}) as kept,
  ({" or ".join(f"p_{r} > {BLOCK}" for r in RULES)}) as host_blocked
from f join rate on f.source is not distinct from rate.source
"""


SQL = _sql()
