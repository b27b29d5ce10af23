"""Raw security-log readers (S-1 .. S-8).

Input column names are unknown; CSV columns are read as strings and JSON
columns keep their inferred types. How a file is to be read (encoding, quoted
line breaks, JSON document or lines) is decided per file from all it holds.
NDJSON is preferred for large inputs because it splits across tasks; a
multi-line JSON document is a single task by nature.
"""

from __future__ import annotations

import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..session import apply_engine_conf

CORRUPT = "_corrupt_record"
# ---- fixed values: text tokens read as missing (pandas' default NA list) ------
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
MAX_UNWRAP_DEPTH = 6
MAX_FLATTEN_LEVEL = 3
#: A JSON document is one row while it is parsed; a row holds less than 2 GB.
MAX_DOCUMENT_BYTES = 1 << 30
# ---------------------------------------------------------------------------------


class UnsupportedFileTypeError(ValueError):
    pass


def read_log(spark: SparkSession, path: str, fmt: str | None = None, encoding: str = "auto") -> DataFrame:
    """S-1: dispatch on ``fmt`` or the path suffix (``.csv`` / ``.json``)."""
    kind = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if kind == "csv":
        return read_csv_log(spark, path, encoding)
    if kind in ("json", "ndjson", "jsonl"):
        return read_json_log(spark, path)
    raise UnsupportedFileTypeError(f"Unsupported file type: .{kind}. Only .csv and .json are supported.")


def _null_tokens(c: Column) -> Column:
    return F.when(c.isin(*NA_TOKENS), F.lit(None)).otherwise(c)


def _csv_reader(spark: SparkSession, encoding: str, multi_line: bool):
    """RFC-4180 quoting: a quote inside a quoted field is doubled, and a field may hold line breaks."""
    return (spark.read.option("header", True).option("encoding", encoding).option("escape", '"')
            .option("multiLine", multi_line).option("columnPruning", False))


def _as_path(file: str) -> str:
    """A file as a path to read: ``_metadata.file_path`` and ``inputFiles`` are URI-encoded, and a
    path's own glob characters stand for themselves."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", re.sub("^file:/+", "file:/", unquote(file)))


def _line_verdicts(spark: SparkSession, path: str) -> list[Row]:
    """Of the files that need care: whether one holds bytes that are no UTF-8, and whether it has a
    line with an odd number of quotes. One pass over the lines; a flag or two per file reach the driver."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                         (~F.expr("is_valid_utf8(value)")).alias("latin"), (quotes % 2 == 1).alias("open"))
    return lines.groupBy("file").agg(F.max("latin").alias("latin"), F.max("open").alias("open")).where("latin or open").collect()


def _csv_files(spark: SparkSession, paths, names: list[str], encoding: str, multi_line: bool) -> DataFrame:
    fields = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))]
                          + [T.StructField(CORRUPT, T.StringType())])
    raw = (_csv_reader(spark, encoding, multi_line).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).schema(fields).csv(paths))
    # a record of another width is reported whole: count its fields outside quotes
    outside = F.regexp_replace(F.col(CORRUPT), r'"(?:[^"]|"")*"', "")
    too_long = F.length(outside) - F.length(F.replace(outside, F.lit(","))) + 1 > len(names)
    # (a filter on the corrupt column alone is not allowed once all others are pruned)
    other = F.length(F.coalesce("_c0", F.lit(""))) >= 0
    kept = raw.where((F.col(CORRUPT).isNull() | ~too_long) & other)
    return kept.select(*[_null_tokens(F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)])


def read_csv_log(spark: SparkSession, path: str, encoding: str = "auto", multi_line: bool | None = None) -> DataFrame:
    """S-2 / S-3: header CSV, all columns strings, NA tokens -> null.

    Rows with *more* fields than the header are skipped; shorter rows are kept
    with the missing trailing fields null. ``encoding='auto'`` reads each file as
    UTF-8 unless it holds other bytes, then as Latin-1; a byte-order mark is
    removed from the first column name. Where every line of a file has an even
    number of quotes, no field holds a line break and the file is split over
    tasks; only a file with another line is read by one task. ``multi_line``
    sets this for all files.
    """
    auto = encoding == "auto"
    care = {_as_path(r["file"]): r for r in _line_verdicts(spark, path)} if auto or multi_line is None else {}
    kinds: dict[str, tuple[str, bool]] = {}
    for file in sorted(map(_as_path, spark.read.text(path).inputFiles())):
        r = care.get(file)
        kinds[file] = ("ISO-8859-1" if r and r["latin"] else "UTF-8") if auto else encoding, bool(r and r["open"]) if multi_line is None else multi_line
    header = next((h for file, kind in kinds.items() if (h := _csv_reader(spark, *kind).csv(file).columns)), None)
    if not header:
        raise ValueError(f"{os.path.basename(path)} is empty")
    names = [header[0].lstrip("\ufeff")] + header[1:]
    groups = {kind: [f for f in kinds if kinds[f] == kind] for kind in set(kinds.values())}
    if len(groups) == 1:
        return _csv_files(spark, path, names, *next(iter(groups)))
    return reduce(DataFrame.unionByName, [_csv_files(spark, groups[kind], names, *kind) for kind in sorted(groups)])


def flatten(df: DataFrame, max_level: int = MAX_FLATTEN_LEVEL) -> DataFrame:
    """S-7: nested objects -> dotted column names, at most ``max_level`` expansions;
    deeper objects stay as one JSON-text value."""
    cols: list[Column] = []

    def walk(c: Column, name: str, dt: T.DataType, level: int) -> None:
        if isinstance(dt, T.StructType) and level < max_level:
            for f in dt.fields:
                walk(c.getField(f.name), f"{name}.{f.name}", f.dataType, level + 1)
        elif isinstance(dt, T.StructType):
            cols.append(F.to_json(c).alias(name))
        else:
            cols.append(c.alias(name))

    for f in df.schema.fields:
        if f.name == CORRUPT:
            continue
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                walk(F.col(f"`{f.name}`").getField(g.name), f"{f.name}.{g.name}", g.dataType, 1)
        else:
            cols.append(F.col(f"`{f.name}`").alias(f.name))
    return df.select(*cols)


# ---- JSON: every file is one document or one record per line; both become VARIANT records

_SPACES = " \t\r\n\f\x0b"


def _json_value(text: Column) -> Column:
    """The one JSON value that the text is, as VARIANT; null if it is none or holds more than one.

    (The parser itself stops behind the first value, so the text is read as the only element of an array.)
    NaN and Infinity are no JSON but common in logs: where a text with them fails they are taken as null.
    """
    def only(t: Column) -> Column:
        boxed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        return F.when(F.try_variant_get(boxed, "$[1]", "variant").isNull(), F.try_variant_get(boxed, "$[0]", "variant"))

    bare = F.regexp_replace(text, r"(?<=[:\[,])\s*-?(?:NaN|Infinity)\s*(?=[,}\]])", "null")
    return F.coalesce(only(text), F.when(text.rlike("NaN|Infinity"), only(bare)))


def _json_text(value: Column) -> Column:
    """A text without the white space, byte-order mark and trailing commas around it."""
    return F.rtrim(F.ltrim(F.expr("make_valid_utf8(value)") if value is None else value, F.lit(_SPACES + "\ufeff")), F.lit(_SPACES + ","))


def _lines(spark: SparkSession, paths) -> DataFrame:
    """The lines that are not blank, trimmed as ``text``, with ``opens``, their first character."""
    text = spark.read.text(paths).select(_json_text(None).alias("text"), F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"))
    return text.where(F.length("text") > 0).withColumn("opens", F.substring("text", 1, 1))


def _json_kinds(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files to read as whole documents, and files to read by line.

    A file whose first line is a JSON value of its own, with lines behind it, can't be one value as
    a whole. A file of one line, or whose first line opens a bracket and is no value, may be: that is
    decided by parsing the file. Only the first split of a file is parsed for this, and a few numbers
    per file reach the driver.
    """
    lines = _lines(spark, path)
    alone = F.when(_json_value(F.col("text")).isNotNull(), 2).when(F.col("opens").isin("{", "["), 1).otherwise(0)
    seen = lines.select("file", "size", F.when(F.col("block") == 0, F.monotonically_increasing_id() * 4 + alone).alias("first"))
    files = seen.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"),
                                     (F.min("first") % 4).alias("alone")).collect()
    whole = [f for f in files if f["n"] == 1 or f["alone"] == 1]
    for f in whole:
        if f["size"] > MAX_DOCUMENT_BYTES:
            raise ValueError(f"{unquote(f['file'])} may be one JSON document of {f['size']} bytes; a document is read as one row of at most {MAX_DOCUMENT_BYTES}")
    documents = {f["file"] for f in whole}
    if documents:
        bad = _documents(spark, [_as_path(f) for f in documents]).where(F.col("v").isNull()).select("file").collect()
        documents -= {f["file"] for f in bad}
    return [_as_path(f) for f in sorted(documents)], [_as_path(f["file"]) for f in files if f["file"] not in documents]


def _documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, v: each file as one JSON value (null if it is none)."""
    text = spark.read.text(paths, wholetext=True)
    trimmed = text.select(F.col("_metadata.file_path").alias("file"), _json_text(None).alias("text"))
    return trimmed.select("file", _json_value(F.col("text")).alias("v"), F.substring("text", 1, 1).alias("opens"))


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT<")


def _struct_of(records: DataFrame, value: str) -> T.StructType:
    """The merged structure of VARIANT objects (an aggregate over all of them)."""
    found = records.agg(F.schema_of_variant_agg(value).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return T.StructType()
    quoted = re.split(r"(`(?:[^`]|``)*`)", found)
    dt = T.DataType.fromDDL("".join(q if q.startswith("`") else q.replace("OBJECT<", "STRUCT<") for q in quoted))
    return dt if isinstance(dt, T.StructType) else T.StructType()


def _step(name: str) -> str | None:
    """A key as a step of a VARIANT path."""
    if "'" not in name:
        return f"['{name}']"
    return f'["{name}"]' if '"' not in name else None


def _list_paths(objects: DataFrame, node: str = "$", depth: int = 0) -> list[str]:
    """Paths in the documents under which some document has a list; lists are not descended into."""
    found: list[str] = []

    def walk(dt: T.StructType, node: str, depth: int) -> None:
        for f in dt.fields:
            step = _step(f.name)
            if step is None or depth + 1 > MAX_UNWRAP_DEPTH:
                continue
            kind = f.dataType
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.VariantType)):
                found.append(node + step)
            elif isinstance(kind, T.StructType):
                walk(kind, node + step, depth + 1)
            elif isinstance(kind, T.VariantType):      # an object in one document, something else in another
                found.append(node + step)
                inner = objects.select(F.try_variant_get("v", node + step, "variant").alias("v")).where(F.col("v").isNotNull())
                found.extend(node + step + p[1:] for p in _list_paths(inner.where(_is_object(F.col("v"))), "$", depth + 1))

    walk(_struct_of(objects, "v"), node, depth)
    return found


def unwrap_documents(documents: DataFrame) -> DataFrame:
    """S-4 / S-6: the records ``v`` of whole documents, decided for each document by itself.

    A list gives its elements. An object gives the elements of its largest list of objects, at most
    ``MAX_UNWRAP_DEPTH`` keys deep (of equal ones the first by path), or itself if it has none.
    """
    elements = documents.where(F.col("opens") == "[").select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
    objects = documents.where(F.col("opens") == "{")
    lists = [F.try_variant_get("v", p, "array<variant>") for p in _list_paths(objects)]
    if lists:
        held = objects.select("v", *[F.when(F.forall(x, _is_object), x).alias(f"l{i}") for i, x in enumerate(lists)])
        sizes = [F.struct(F.coalesce(F.size(f"l{i}"), F.lit(0)).alias("n"), F.lit(-i).alias("i")) for i in range(len(lists))]
        best = F.array_max(F.array(*sizes))
        chosen = F.coalesce(*[F.when((best["n"] > 0) & (best["i"] == -i), F.col(f"l{i}")) for i in range(len(lists))], F.array("v"))
        objects = held.select(F.explode(chosen).alias("v"))
    return elements.where(_is_object(F.col("v"))).unionByName(objects.select("v"))


def _column_type(dt: T.DataType) -> T.DataType:
    """What a column of merged JSON types is read as: mixed types as text, fractions as double."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _column_type(f.dataType)) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_column_type(dt.elementType))
    if isinstance(dt, T.DecimalType):
        return dt if dt.scale == 0 and dt.precision > 18 else T.DoubleType()
    return T.StringType() if isinstance(dt, (T.VariantType, T.NullType)) else dt


def _without_empty(dt: T.DataType) -> T.DataType:
    """A structure without keys holds no columns; inside a list it stays as text."""
    if isinstance(dt, T.StructType):
        fields = [T.StructField(f.name, _without_empty(f.dataType)) for f in dt.fields]
        return T.StructType([f for f in fields if not (isinstance(f.dataType, T.StructType) and not f.dataType.fields)])
    if isinstance(dt, T.ArrayType):
        inner = _without_empty(dt.elementType)
        return T.ArrayType(T.StringType() if isinstance(inner, T.StructType) and not inner.fields else inner)
    return dt


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """S-4 .. S-8: JSON documents (a list, an object, a wrapped list) and NDJSON with bad lines skipped.

    What a file is, is decided by parsing it; files of one folder may differ. All records become one
    table whose columns are the keys of all of them, nested keys joined by dots (``flatten``). A key
    whose values differ in kind is text. Of a repeated key in an object the last value counts.
    """
    apply_engine_conf(spark)
    name = os.path.basename(path.rstrip("/"))
    documents, by_line = _json_kinds(spark, path)
    if not documents and not by_line:
        raise ValueError(f"{name} is empty")
    parts = []
    if by_line:
        lines = _lines(spark, by_line if documents else path).where(F.col("opens") == "{")
        parts.append(lines.select(_json_value(F.col("text")).alias("v")).where(F.col("v").isNotNull()))
    if documents:
        parts.append(unwrap_documents(_documents(spark, documents)))
    records = reduce(DataFrame.unionByName, parts)
    found = _without_empty(_column_type(_struct_of(records, "v")))
    if not found.fields:
        if documents:
            raise ValueError(f"{name} contains no records")
        raise ValueError(f"{name} is not valid JSON or newline-delimited JSON")
    return flatten(records.select(F.col("v").cast(found).alias("r")).select("r.*"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Input order as a column that sorts by file, place of the split in it, and place in the split.

    Spark packs splits by size, so a running number alone doesn't follow the files' order. A frame
    that isn't read from files in one scan is numbered alone.
    """
    n = F.monotonically_increasing_id()
    try:
        return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"),
                                            F.col("_metadata.file_block_start").alias("block"), n.alias("n")))
    except AnalysisException:
        return df.withColumn(name, F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), n.alias("n")))
