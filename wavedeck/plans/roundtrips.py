"""Rows written in the binary formats by tasks and read back by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layers
from ..sources import tables
from ..workspace import folder
from .adapters import oracle, view
from .queries import FIELDS, Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle(sql)
        return f

    return keep


def _through(df: DataFrame, kind: str, length: int) -> DataFrame:
    spark = df.sparkSession
    tables.register(spark)
    path = folder(spark, kind)
    df.write.format(kind).mode("append").option("path", path).save()
    return spark.read.format(kind).option("path", path).option("length", length).load()


@query("select call as callsign, vintage, nullif(first_name, '') as first_name, middle_name, last_name, address from v_archive")
def roundtrip_dat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_archive").select(F.col("call").alias("callsign"), "vintage", *(c for c in FIELDS if c != "jurisdiction"))
    return _through(rows, "tagged_records", 1 << 20).select("callsign", "vintage", "first_name", "middle_name", "last_name", "address")


@query("""select "key", dat_offset from v_index""")
def roundtrip_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(view(spark, sf_dir, "v_index").select("key", "dat_offset"), "text_index", 1 << 20).where("parsed").select("key", "dat_offset")


@query("""select call as "key", c_custkey * 3 as "count", cast(20200101 + c_custkey % 28 as int) as updated, 'N' as status from v_calls""")
def roundtrip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_calls").select(F.col("call").alias("key"), (F.col("c_custkey") * 3).alias("count"), (20200101 + F.col("c_custkey") % 28).cast("int").alias("updated"), F.lit("N").alias("status"))
    return _through(rows, "lookup_counts", 1 << 18).select("key", "count", "updated", "status")


@query("""select header_key, year_ as "year", dat_offset, cast(posting_no as int) as position from v_postings""")
def roundtrip_hci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_postings").select("header_key", F.col("year_").alias("year"), F.array(F.struct(F.lit(0).cast("long").alias("posting_no"), "dat_offset", F.col("posting_no").cast("int").alias("position"))).alias("postings"))
    back = _through(rows, "inverted_index", 1 << 16)
    return back.select("header_key", "year", F.explode("postings").alias("p")).select("header_key", "year", "p.dat_offset", "p.position")


@query("select cast(l_quantity as bigint) as lat_minutes, cast(l_partkey % 1000 as bigint) as lon_minutes, count(*) as points from lineitem group by 1, 2")
def roundtrip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "lineitem").select(F.lit(4000).cast("short").alias("command"), F.col("l_quantity").cast("short").alias("lat_min"), (F.col("l_partkey") % 1000).cast("short").alias("lon_min"))
    paths = layers.paths(_through(rows, "state_vectors", 60_000).withColumn("lat_min", F.col("lat_min").cast("double")).withColumn("lon_min", F.col("lon_min").cast("double")), "point_no", "path")
    points = paths.select(F.explode("points").alias("p"))
    return points.groupBy(F.round(F.col("p.lat") * 60).cast("long").alias("lat_minutes"), F.round(F.col("p.lon") * 60).cast("long").alias("lon_minutes")).agg(F.count("*").alias("points"))
