"""Views that derive spatial inputs from the star-schema tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarix import storage
from planarix.functions import geometry as G

CELLS = """
select o_orderkey as uid,
  cast(cast(round(o_totalprice*100) as bigint) % 10007 as double) as x,
  cast((cast(floor(round(o_totalprice*100)/10007) as bigint)*7 + o_custkey*104729) % 9973 as double) as y,
  cast(4 + o_orderkey % 13 as double) as w, cast(4 + o_orderkey % 7 as double) as h,
  case o_orderkey % 5 when 0 then 'neoplastic' when 1 then 'inflammatory' when 2 then 'connective'
       when 3 then 'dead' else 'epithelial' end as class_name
from orders
"""

TISSUES = """
select n_nationkey as tissue_id,
  cast((n_nationkey % 5)*2000+100 as double) as minx, cast(floor(n_nationkey / 5)*2000+100 as double) as miny,
  cast((n_nationkey % 5)*2000+1900 as double) as maxx, cast(floor(n_nationkey / 5)*2000+1900 as double) as maxy,
  case n_regionkey when 0 then 'stroma' when 1 then 'cin' when 2 then 'squamous_epithelium'
       when 3 then 'glandular_epithelium' else 'blood' end as class_name
from nation
"""

CLUSTERS = """
select o_orderkey as uid,
  cast((o_custkey % 12)*2400 + (cast(round(o_totalprice*100) as bigint) % 300
      + cast(floor(round(o_totalprice*100)/300) as bigint) % 300)*1.5 as double) as x,
  cast((o_custkey % 12 * 5 % 12)*2400 + (cast(floor(round(o_totalprice*100)/90000) as bigint) % 300
      + o_custkey*7919 % 300)*1.5 as double) as y
from orders
"""

PIXELS = """
select l_partkey as label, l_orderkey as prow, l_linenumber as pcol, cast(l_quantity as int) as v, l_returnflag as gt, l_linestatus as pred
from lineitem
"""

LINES = """
select user_id as line_id, row_number() over (partition by user_id order by ts, event_id) as seq,
  cast(value as double) as x, cast(event_id % 97 as double) as y
from events
"""


def _view(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table}", "from {src}"), src=storage.spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as boxes around (x, y)."""
    df = _view(spark, sf_dir, CELLS, "orders")
    x0, y0, x1, y1 = F.col("x") - F.col("w") / 2, F.col("y") - F.col("h") / 2, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    return df.select("*", x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy")).withColumn("geometry", G.box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))


def cell_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CELLS, "orders")


def tissues(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, sf_dir, TISSUES, "nation")
    return df.withColumn("geometry", G.box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CLUSTERS, "orders")


def points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ident = df.columns[0]
    e = F.col("embedding")
    return df.select(F.col(ident).alias("uid"), (e[0].cast("double") * 1000).alias("x"), (e[1].cast("double") * 1000).alias("y"), F.col("label").cast("string").alias("class_name"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PIXELS, "lineitem")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, geometry)"""
    rows = _view(spark, sf_dir, LINES, "events")
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: G.xy(p["x"], p["y"]))
    return rows.groupBy("line_id").agg(G.line(pts).alias("geometry"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons with closed-form measures: boxes, L shapes, right triangles and boxes with a hole, by uid % 4."""
    df = _view(spark, sf_dir, CELLS, "orders")
    w, h, x, y = (F.col(c) for c in "whxy")
    ring = lambda *p: F.array(*[G.xy(x + w * a, y + h * b) for a, b in (*p, p[0])])
    box_ = ring((0, 0), (1, 0), (1, 1), (0, 1))
    ell = ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))
    tri, hole = ring((0, 0), (1, 0), (0, 1)), ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75))
    k = F.col("uid") % 4
    geom = F.when(k == 0, G.polygon(box_)).when(k == 1, G.polygon(ell)).when(k == 2, G.polygon(tri)).otherwise(G.polygon(box_, hole))
    return df.select("uid", "class_name", "w", "h", geom.alias("geometry"))
