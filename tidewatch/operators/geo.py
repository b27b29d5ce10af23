"""IPv4 -> location enrichment by longest-prefix match (J-1) and location fill (J-2).

The range table is small and of fixed size, so it is broadcast (its row count is
checked first); the match is one broadcast *equi*-join per distinct prefix length
on ``ip >> (32 - len)``, most specific length first, so no nested-loop or range
join appears in the plan and nothing is shuffled. Addresses are de-duplicated
by the caller's grouping before the lookup where possible.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ipv4 import ipv4_to_long

# ---- fixed values: bundled illustrative range table (cidr,country,code,city,lat,lon)
GEO_RANGES_CSV = """cidr,country,country_code,city,lat,lon
3.0.0.0/8,United States,US,Ashburn,39.0438,-77.4874
45.0.0.0/8,United States,US,San Jose,37.3382,-121.8863
64.0.0.0/8,United States,US,Chicago,41.8781,-87.6298
104.0.0.0/8,United States,US,Seattle,47.6062,-122.3321
23.0.0.0/8,Canada,CA,Toronto,43.6511,-79.3470
142.0.0.0/8,Canada,CA,Montreal,45.5019,-73.5674
80.0.0.0/8,United Kingdom,GB,London,51.5074,-0.1278
81.0.0.0/8,Germany,DE,Frankfurt,50.1109,8.6821
90.0.0.0/8,France,FR,Paris,48.8566,2.3522
95.0.0.0/8,Netherlands,NL,Amsterdam,52.3676,4.9041
178.0.0.0/8,Russia,RU,Moscow,55.7558,37.6173
91.0.0.0/8,Ukraine,UA,Kyiv,50.4501,30.5234
36.0.0.0/8,China,CN,Beijing,39.9042,116.4074
114.0.0.0/8,China,CN,Shanghai,31.2304,121.4737
1.0.0.0/8,China,CN,Shenzhen,22.5431,114.0579
121.0.0.0/8,South Korea,KR,Seoul,37.5665,126.9780
126.0.0.0/8,Japan,JP,Tokyo,35.6762,139.6503
133.0.0.0/8,Japan,JP,Osaka,34.6937,135.5023
103.0.0.0/8,India,IN,Mumbai,19.0760,72.8777
117.0.0.0/8,India,IN,Bengaluru,12.9716,77.5946
202.0.0.0/8,Australia,AU,Sydney,-33.8688,151.2093
203.0.0.0/8,Australia,AU,Melbourne,-37.8136,144.9631
196.0.0.0/8,South Africa,ZA,Johannesburg,-26.2041,28.0473
41.0.0.0/8,Nigeria,NG,Lagos,6.5244,3.3792
177.0.0.0/8,Brazil,BR,Sao Paulo,-23.5505,-46.6333
181.0.0.0/8,Argentina,AR,Buenos Aires,-34.6037,-58.3816
190.0.0.0/8,Mexico,MX,Mexico City,19.4326,-99.1332
217.0.0.0/8,Poland,PL,Warsaw,52.2297,21.0122
109.0.0.0/8,Italy,IT,Rome,41.9028,12.4964
88.0.0.0/8,Spain,ES,Madrid,40.4168,-3.7038
"""
UNKNOWN_COUNTRY = "Unknown"
UNKNOWN_CODE = "XX"
UNKNOWN_CITY = "Unknown"
# ----------------------------------------------------------------------------
BROADCAST_MAX_ROWS = 5_000_000
GEO_COLS = ["country", "country_code", "city", "lat", "lon"]


def geo_ranges(spark: SparkSession, csv_text: str = GEO_RANGES_CSV) -> DataFrame:
    """``network long, prefix_len int`` + location columns."""
    pdf = pd.read_csv(io.StringIO(csv_text), dtype={"cidr": str, "country": str, "country_code": str,
                                                    "city": str, "lat": float, "lon": float})
    df = spark.createDataFrame(pdf)
    return df.select(ipv4_to_long(F.split("cidr", "/")[0]).alias("network"),
                     F.split("cidr", "/")[1].cast("int").alias("prefix_len"), *GEO_COLS)


def geo_lookup(df: DataFrame, ip_col: str, ranges: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Add ``country, country_code, city, lat, lon`` for ``ip_col`` (longest prefix wins;
    invalid / IPv6 / unmatched -> Unknown, XX, Unknown, null, null)."""
    spark = df.sparkSession
    if ranges is None:          # the bundled table: its prefix lengths and size are known here
        ranges = geo_ranges(spark)
        lengths = sorted({int(c.split("/")[1]) for c in pd.read_csv(io.StringIO(GEO_RANGES_CSV))["cidr"]},
                         reverse=True)
        small = True
    else:
        lengths = sorted({r[0] for r in ranges.select("prefix_len").distinct().collect()}, reverse=True)
        small = ranges.count() <= BROADCAST_MAX_ROWS
    ipl = "_ip_long"
    out = df.withColumn(ipl, ipv4_to_long(F.col(ip_col)))
    hits = []
    for ln in lengths:
        shift = 32 - ln
        r = (ranges.where(F.col("prefix_len") == ln)
                   .select(F.shiftright("network", shift).alias(f"_k{ln}"),
                           F.struct(*GEO_COLS).alias(f"_g{ln}")))
        r = F.broadcast(r) if small else r
        out = out.join(r, F.shiftright(F.col(ipl), shift) == F.col(f"_k{ln}"), "left").drop(f"_k{ln}")
        hits.append(F.col(f"_g{ln}"))
    g = F.coalesce(*hits) if len(hits) > 1 else (hits[0] if hits else F.lit(None))
    out = out.withColumn("_geo", g)
    out = out.select(*df.columns,
                     F.coalesce(F.col("_geo.country"), F.lit(UNKNOWN_COUNTRY)).alias(prefix + "country"),
                     F.coalesce(F.col("_geo.country_code"), F.lit(UNKNOWN_CODE)).alias(prefix + "country_code"),
                     F.coalesce(F.col("_geo.city"), F.lit(UNKNOWN_CITY)).alias(prefix + "city"),
                     F.col("_geo.lat").alias(prefix + "lat"), F.col("_geo.lon").alias(prefix + "lon"))
    return out


def fill_location(events: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``source_location`` := country of ``source_ip`` where it is null and the IP is present."""
    if "source_location" not in events.columns:
        events = events.withColumn("source_location", F.lit(None).cast("string"))
    g = geo_lookup(events, "source_ip", ranges, prefix="_loc_")
    filled = F.when(F.col("source_location").isNull() & F.col("source_ip").isNotNull(),
                    F.col("_loc_country")).otherwise(F.col("source_location"))
    return g.select(*[filled.alias(c) if c == "source_location" else F.col(c) for c in events.columns])


def geo_values_sql(csv_text: str = GEO_RANGES_CSV) -> str:
    """The range table as a DuckDB VALUES list (oracle side)."""
    pdf = pd.read_csv(io.StringIO(csv_text), dtype={"cidr": str, "country": str, "country_code": str,
                                                    "city": str, "lat": float, "lon": float})
    rows = []
    for r in pdf.itertuples(index=False):
        net, ln = r.cidr.split("/")
        a, b, c, d = (int(x) for x in net.split("."))
        rows.append(f"({((a * 256 + b) * 256 + c) * 256 + d}, {int(ln)}, '{r.country}', '{r.country_code}', "
                    f"'{r.city}', {r.lat!r}, {r.lon!r})")
    return ("(values " + ", ".join(rows) + ") as g(network, prefix_len, country, country_code, city, lat, lon)")
