"""Column helpers against Python's own semantics."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidewatch.functions.ipv4 import ipv4_to_long
from tidewatch.functions.numfmt import rnd
from tidewatch.operators.profile import fmt_g


def py_ip(s):
    try:
        ip = ipaddress.ip_address(s)
    except (ValueError, TypeError):
        return None
    return int(ip) if isinstance(ip, ipaddress.IPv4Address) else None


def test_ipv4_parse_matches_stdlib(spark):
    rng = random.Random(11)
    cases = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", " 1.2.3.4",
             "::1", "1.2.3.04", "10.0.0.1 ", "a.b.c.d", "", "1..2.3"]
    for _ in range(300):
        parts = [str(rng.choice([rng.randint(0, 255), rng.randint(256, 999)])) for _ in range(4)]
        if rng.random() < 0.2:
            parts[rng.randint(0, 3)] = "0" + parts[0]
        cases.append(".".join(parts))
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = {r["s"]: r["v"] for r in df.select("s", ipv4_to_long(F.col("s")).alias("v")).collect()}
    for c in cases:
        assert got[c] == py_ip(c), c


def test_fmt_g_matches_python(spark):
    rng = random.Random(5)
    vals = [0.0, 47.0, -3.0, 1234567.0, 999999.0, 1e-5, 0.0001, 123.456789, 2.5, 1e20, -0.000123456]
    vals += [rng.uniform(-1e7, 1e7) for _ in range(100)] + [rng.uniform(0, 1) for _ in range(100)]
    vals += [float(rng.randint(0, 100000)) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["g"] for r in df.select(fmt_g(F.col("x")).alias("g")).collect()]
    for v, g in zip(vals, got):
        assert g == format(v, "g"), (v, g)


def test_rnd_agrees_with_duckdb(spark):
    import duckdb
    rng = random.Random(9)
    vals = [0.125, 2.675, -0.125, 1.0005, 0.5, -2.5] + [rng.uniform(-100, 100) for _ in range(300)] \
        + [round(rng.uniform(0, 1), 5) for _ in range(300)]
    for d in (1, 2, 4):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
        got = [r[0] for r in df.orderBy("i").select(rnd(F.col("x"), d)).collect()]
        con = duckdb.connect()
        con.execute("create table t(i int, x double)")
        con.executemany("insert into t values (?, ?)", list(enumerate(vals)))
        want = [r[0] for r in con.execute(f"select round(x * 1e{d}) / 1e{d} from t order by i").fetchall()]
        assert got == want


def test_fixed_text_matches_python(spark):
    from tidewatch.functions.numfmt import fixed_text
    rng = random.Random(13)
    vals = [2.675, 0.125, 1.005, -0.125, 2.5, 0.5, -2.675, 1e-9, 123456.785, 0.0]
    vals += [rng.uniform(-1000, 1000) for _ in range(300)] + [round(rng.uniform(0, 10), 3) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    for d in (0, 1, 2):
        got = [r[0] for r in df.orderBy("i").select(fixed_text(F.col("x"), d)).collect()]
        assert got == [f"{v:.{d}f}" for v in vals]
