"""Profiles of whole columns: what is counted, and values that lie beyond the first rows."""

from pyspark.sql import functions as F

from tidewatch.operators import profile as P


def frame(spark):
    i = F.col("row_id")
    return spark.range(3000).withColumnRenamed("id", "row_id").select(
        "row_id", i.alias("key"), (i / 7).alias("share"), F.concat(F.lit("name "), i).alias("name"),
        F.when(i >= 1500, F.concat(F.lit("10.0.0."), i % 250)).alias("late_ip"),                   # null in the first rows
        F.when(i == 2999, F.lit("only")).alias("last"),
        F.concat(F.lit("run"), F.lpad((i / 100).cast("int").cast("string"), 2, "0")).alias("runs"),  # 30 values, 100 rows each
        F.element_at(F.array(*map(F.lit, ["low", "mid", "high"])), (i % 3 + 1).cast("int")).alias("level"),
        F.when(i % 2 == 0, i.cast("string")).otherwise(F.lit(" 1.5 ")).alias("mixed"),
        F.when(i == 2000, F.lit(float("nan"))).otherwise(i.cast("double")).alias("broken"),
        (i.cast("decimal(12,2)") / 4).cast("decimal(12,2)").alias("money"), (i % 2 == 0).alias("flag"),
        F.array(i % 4).alias("list"), F.timestamp_seconds(i).alias("at"), F.lit(None).cast("string").alias("nothing"))


def test_profile_over_all_rows(spark, monkeypatch):
    counted, plain = [], P.long_values

    def noted(datasets, *more):
        datasets = list(datasets)
        counted.extend(c for _, d in datasets for c in d.columns)
        return plain(datasets, *more)

    monkeypatch.setattr(P, "long_values", noted)
    rows = {r["column_name"]: r for r in P.profile([("d", frame(spark)), ("none", frame(spark).where("row_id < 0"))]).collect()}
    assert {r["dataset_id"] for r in rows.values()} == {"d"}             # a dataset without rows has no profile
    assert sorted(set(counted) - {"row_id"}) == ["flag", "last", "level", "list", "runs"]    # no keys, numbers, texts or dates
    assert {c: r["inferred_dtype"] for c, r in rows.items()} == {
        "key": "integer", "share": "float", "name": "string", "late_ip": "ip", "last": "string", "runs": "string", "level": "categorical",
        "mixed": "float", "broken": "datetime", "money": "float", "flag": "float", "list": "string", "at": "datetime", "nothing": "unknown"}
    samples = {c: r["sample_values"] for c, r in rows.items()}
    assert samples["late_ip"] == [f"10.0.0.{k}" for k in range(5)] and samples["last"] == ["only"] and samples["nothing"] == []
    assert samples["runs"] == [f"run0{k}" for k in range(5)] and samples["list"] == ["[0]", "[1]", "[2]", "[3]"]
    assert samples["level"] == ["low", "mid", "high"] and samples["mixed"] == ["0", " 1.5 ", "2", "4", "6"]
    shape = {c: r["descriptor"].split(". ", 2)[2] for c, r in rows.items()}
    assert shape["key"] == "numeric values ranging from 0 to 2999, mean 1499.50."
    assert shape["mixed"] == "numeric values ranging from 0 to 2998, mean 750.25."
    assert shape["money"] == "numeric values ranging from 0 to 749.75, mean 374.88."
    assert shape["level"] == "categorical values, most common: low, mid, high."
