"""Column profiling (P-1 .. P-12): dtype, value shape, samples and a descriptor per column.

Many datasets are profiled at once, over all their rows: one aggregate per dataset
gives the counts and numbers of all its columns, without a row per cell. The first
non-null values (200 and 50) come from a dataset's first rows. Only a column that may
be categorical (no more than 20 distinct values proven), or whose first rows don't
show 5 distinct values, is counted per distinct value (map-side). ``sample_rows``
profiles the first rows only (query ``profile_head``).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.firstk import first_k_rows
from ..functions.ipv4 import IPV4_SHAPE
from ..functions.numfmt import fixed_text
from ..functions.timeparse import parse_ts
from ..session import cut_lineage

# ---- fixed values ---------------------------------------------------------------
SAMPLE_ROWS = 1000          # of profile_head
HEAD_ROWS = 1000            # rows of a dataset in which the first values of its columns are looked for first
IP_SAMPLE = 200
SAMPLES = 5
DATETIME_SAMPLE = 50
SHAPE_SHARE = 0.8
CATEGORICAL_RATIO = 0.05
CATEGORICAL_MAX = 20
INTEGER_TEXT = r"^-?\d+$"
NUMBER_TEXT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
# ------------------------------------------------------------------------------------

PROFILE_SCHEMA = "dataset_id string, column_name string, inferred_dtype string, sample_values array<string>, " \
                 "descriptor string, col_index int"


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return "nested"
    return "boolean" if isinstance(t, T.BooleanType) else "plain"


def _columns(df: DataFrame) -> list[tuple[int, T.StructField]]:
    return list(enumerate(f for f in df.schema.fields if f.name != "row_id"))


def _text(f: T.StructField) -> Column:
    """A cell as text; list/dict cells as JSON."""
    c = F.col(f"`{f.name}`")
    text = {"nested": F.to_json, "boolean": lambda c: F.when(c, "True").when(~c, "False"), "plain": lambda c: c}[_kind(f.dataType)]
    return text(c).cast("string")


def _cells(df: DataFrame) -> list[Column]:
    """(name, index, text, kind) per column."""
    return [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("col_index"), _text(f).alias("value"),
                     F.lit(_kind(f.dataType)).alias("kind")) for i, f in _columns(df)]


def _numbered(datasets: Iterable[tuple[str, DataFrame]], sample_rows: int | None) -> list[tuple[str, DataFrame]]:
    out = []
    for name, df in datasets:
        if "row_id" not in df.columns:
            df = df.withColumn("row_id", F.monotonically_increasing_id())
        if sample_rows:
            df = df.orderBy("row_id").limit(sample_rows)
        out.append((name, df))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def long_values(datasets: Iterable[tuple[str, DataFrame]], sample_rows: int | None = None) -> DataFrame:
    """P-1 / P-2: ``dataset_id, row_id, column_name, col_index, value, kind``, a row per cell.

    ``row_id`` is turned into text-free order keys of one type per call: datasets numbered by a long
    keep it, others (see ``with_row_id``) keep their struct; both kinds can't be mixed in one call.
    """
    return _union([df.select(F.lit(name).alias("dataset_id"), "row_id", F.inline(F.array(*cells)))
                   for name, df in _numbered(datasets, sample_rows) if (cells := _cells(df))])


def _cell_stats(name: str, df: DataFrame) -> DataFrame:
    """``dataset_id, column_name, col_index, nested, n, seen, nums, ints, vmin, vmax, vsum``: a row per column.

    One pass over the rows as they are, without a row per cell. What a type's text can never be is not
    asked: integers are integer text, finite doubles numbers and no integer text, dates neither.
    ``seen`` of 64 buckets of the values' hash are occupied, so there are that many distinct values at least.
    """
    columns, per_cell, stats = _columns(df), [], []
    for i, f in columns:
        c, t, text = F.col(f"`{f.name}`"), f.dataType, _text(f)
        trimmed = F.trim(text)
        num, whole, value = trimmed.rlike(NUMBER_TEXT), text.rlike(INTEGER_TEXT), text
        num = F.when(num, trimmed.try_cast("double"))
        if isinstance(t, T.IntegralType):
            num, whole, value = c.cast("double"), c.isNotNull(), c
        elif isinstance(t, T.DoubleType):
            num, whole, value = F.when(F.abs(c) < F.lit(float("inf")), c), F.lit(False), c
        elif isinstance(t, (T.DateType, T.TimestampNTZType)):
            num, whole, value = F.lit(None).cast("double"), F.lit(False), c
        elif isinstance(t, T.BooleanType):
            num, whole = c.cast("int").cast("double"), F.lit(False)
        if _kind(t) == "nested":
            num, whole, bit = F.lit(None).cast("double"), F.lit(False), F.lit(0).cast("long")
        else:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(value), F.lit(64)).cast("int"))
        per_cell += [c.isNotNull().alias(f"has{i}"), F.when(c.isNotNull(), bit).alias(f"bit{i}"), num.alias(f"num{i}"), whole.alias(f"int{i}")]
        stats.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(i).alias("col_index"), F.lit(_kind(t) == "nested").alias("nested"),
            F.count_if(f"has{i}").alias("n"), F.bit_count(F.bit_or(f"bit{i}")).alias("seen"), F.count(f"num{i}").alias("nums"),
            F.count_if(f"int{i}").alias("ints"), F.min(f"num{i}").alias("vmin"), F.max(f"num{i}").alias("vmax"), F.sum(f"num{i}").alias("vsum")))
    one = df.select(*per_cell).agg(F.array(*stats).alias("stats"), F.count(F.lit(1)).alias("rows"))
    return one.where(F.col("rows") > 0).select(F.lit(name).alias("dataset_id"), F.inline("stats"))


def _heads(datasets: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """``dataset_id, column_name, row_id, value, rank``: each column's first ``IP_SAMPLE`` non-null values in input order.

    From the first ``HEAD_ROWS`` rows of a dataset, and by a scan of its own for a column with too few values there.
    """
    cells = lambda name, df, keep: df.select(F.lit(name).alias("dataset_id"), "row_id", F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), _text(f).alias("value")) for _, f in _columns(df) if f.name in keep])))
    ranked = lambda c: c.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(
        Window.partitionBy(*key).orderBy("row_id"))).where(F.col("rank") <= IP_SAMPLE)
    # at most HEAD_ROWS rows of a dataset
    first = cut_lineage(ranked(_union([cells(name, df.orderBy("row_id").limit(HEAD_ROWS), df.columns) for name, df in datasets])))
    full = {(r[0], r[1]) for r in first.groupBy(*key).agg(F.max("rank").alias("n")).where(F.col("n") == IP_SAMPLE).collect()}
    short = [(name, df, f.name) for name, df in datasets for _, f in _columns(df) if (name, f.name) not in full]
    longer = {name for name, df in datasets if any(s[0] == name for s in short) and len(df.select(F.lit(1)).take(HEAD_ROWS + 1)) > HEAD_ROWS}
    more = [(name, df, c) for name, df, c in short if name in longer]
    if not more:
        return first
    own = [cells(name, df.where(F.col(f"`{c}`").isNotNull()).orderBy("row_id").limit(IP_SAMPLE), [c]) for name, df, c in more]
    again = F.struct(*key).isin(*[F.struct(F.lit(name), F.lit(c)) for name, _, c in more])
    return cut_lineage(first.where(~again).unionByName(ranked(_union(own))))


def fmt_g(x: Column) -> Column:
    """Python ``format(x, 'g')``: 6 significant digits, trailing zeros dropped, exponent
    form below 1e-4 or from 1e6."""
    a = F.abs(x)
    sci = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e"), r"e([+-])(\d)$", "e$10$2")
    digits = F.lit(5) - F.floor(F.log10(a)).cast("int")
    scaled = F.bround(x * F.pow(F.lit(10.0), digits), 0) / F.pow(F.lit(10.0), digits)
    plain = F.regexp_replace(F.regexp_replace(
        F.format_string("%.10f", scaled), r"0+$", ""), r"\.$", "")
    return (F.when(x == 0, F.lit("0"))
             .when((a >= 1e-4) & (a < 1e6), plain)
             .otherwise(sci))


def profile(datasets: Iterable[tuple[str, DataFrame]], sample_rows: int | None = None) -> DataFrame:
    """One row per (dataset, column): inferred dtype, first 5 distinct samples, descriptor."""
    datasets = [(name, df) for name, df in _numbered(datasets, sample_rows) if _columns(df)]
    key = ["dataset_id", "column_name"]
    heads = _heads(datasets, key)
    firsts = heads.groupBy(*key, "value").agg(F.min("row_id").alias("first_row"))
    last = heads.groupBy(*key).agg(
        F.avg(F.col("value").rlike(IPV4_SHAPE).cast("double")).alias("ip_share"),
        F.bool_and(F.when(F.col("rank") <= DATETIME_SAMPLE, parse_ts(F.col("value")).isNotNull())).alias("all_ts"),
        F.count(F.lit(1)).alias("n_head"), F.max("row_id").alias("last_row"))
    early = firsts.join(last.select(*key, "last_row"), key).where(F.col("first_row") < F.col("last_row")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("early"))
    st = _union([_cell_stats(name, df) for name, df in datasets])
    st = cut_lineage(st.join(last.drop("last_row"), key, "left").join(early, key, "left"))
    ip, number = F.col("ip_share") > SHAPE_SHARE, F.col("nums") == F.col("n")
    # values are counted only where it matters: a column that may be categorical, or whose first rows don't show its samples
    few = ~F.col("nested") & ~ip & ~number & ~F.col("all_ts") & (F.col("seen") <= CATEGORICAL_MAX)
    hidden = (F.coalesce("early", F.lit(0)) < SAMPLES) & (F.col("n_head") < F.col("n"))
    ask = {(r[0], r[1]) for r in st.where((F.col("n") > 0) & (few | hidden)).select(*key).collect()}
    asked = [(name, df.select("row_id", *[F.col(f"`{f.name}`") for f in own])) for name, df in datasets
             if (own := [f for _, f in _columns(df) if (name, f.name) in ask])]
    none = heads.select(*key, "value", F.lit(0).cast("long").alias("freq"), F.col("row_id").alias("first_row")).limit(0)
    ranked = cut_lineage(long_values(asked).where(F.col("value").isNotNull()).groupBy(*key, "value").agg(
        F.count(F.lit(1)).alias("freq"), F.min("row_id").alias("first_row"))) if asked else none
    counted = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("nd"))
    st = st.join(counted, key, "left")
    dtype = (F.when(F.col("n") == 0, "unknown")
              .when(F.col("nested"), "string")
              .when(ip, "ip")
              .when(number, F.when(F.col("ints") / F.col("n") > SHAPE_SHARE, "integer").otherwise("float"))
              .when(F.col("all_ts"), "datetime")
              .when((F.col("nd") / F.col("n") < CATEGORICAL_RATIO) & (F.col("nd") <= CATEGORICAL_MAX), "categorical")
              .otherwise("string"))
    st = st.withColumn("inferred_dtype", dtype).withColumn("vmean", F.col("vsum") / F.col("n"))

    # first 5 distinct values in input order, and the 5 most frequent (ties: first seen)
    listed = lambda rows, order, name: first_k_rows(rows, key, order, SAMPLES).groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias(name))
    seen = firsts.join(counted.select(*key), key, "left_anti").unionByName(ranked.drop("freq"))
    st = st.join(listed(seen, [F.col("first_row"), F.col("value")], "sample_values"), key, "left") \
           .join(listed(ranked, [F.col("freq").desc(), F.col("first_row"), F.col("value")], "top_values"), key, "left")

    shape = (F.when(F.col("inferred_dtype") == "unknown", F.lit("column is entirely empty"))
              .when(F.col("inferred_dtype").isin("integer", "float"),
                    F.concat(F.lit("numeric values ranging from "), fmt_g(F.col("vmin")), F.lit(" to "),
                             fmt_g(F.col("vmax")), F.lit(", mean "), fixed_text(F.col("vmean"), 2)))
              .when(F.col("inferred_dtype") == "categorical",
                    F.concat(F.lit("categorical values, most common: "), F.array_join("top_values", ", ")))
              .when(F.col("inferred_dtype") == "ip", F.lit("values formatted as dotted-decimal IPv4 addresses"))
              .when(F.col("inferred_dtype") == "datetime", F.lit("values formatted as timestamps or dates"))
              .otherwise(F.concat(F.lit("text values, examples: "), F.array_join("sample_values", ", "))))
    readable = F.trim(F.regexp_replace("column_name", r"[_\-.]+", " "))
    descriptor = F.concat(F.lit("Column named '"), F.col("column_name"), F.lit("' (read as '"), readable,
                          F.lit("'). Inferred type: "), F.col("inferred_dtype"), F.lit(". "), shape, F.lit("."))
    return st.select("dataset_id", "column_name", "inferred_dtype",
                     F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
                     descriptor.alias("descriptor"), F.col("col_index").cast("int").alias("col_index"))
