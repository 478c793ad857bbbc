"""Readers and writers of vector tables."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarix.functions import geometry as G
from planarix.operators.shape import to_arrow


def parse_wkb(data: bytes) -> list[tuple[str, list[np.ndarray]]]:
    """Parts of a well-known-binary geometry as (kind, rings); z and m values are dropped."""
    out: list[tuple[str, list[np.ndarray]]] = []

    def read(at: int) -> int:
        order = "<" if data[at] == 1 else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if code & 0x20000000:
            at += 4  # a reference system id
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        if code >= 1000:
            dims, code = {1: 3, 2: 3, 3: 4}[code // 1000], code % 1000

        def points(at: int, n: int) -> tuple[np.ndarray, int]:
            a = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2].astype(float)
            return a, at + 8 * n * dims

        count = lambda at: struct.unpack_from(order + "I", data, at)[0]
        if code == 1:
            a, at = points(at, 1)
            out.append(("point", [a]))
        elif code == 2:
            a, at = points(at + 4, count(at))
            out.append(("line", [a]))
        elif code == 3:
            n, rings, at = count(at), [], at + 4
            for _ in range(n):
                a, at = points(at + 4, count(at))
                rings.append(a)
            out.append(("polygon", rings))
        elif code in (4, 5, 6, 7):
            n, at = count(at), at + 4
            for _ in range(n):
                at = read(at)
        else:
            raise ValueError(f"geometry code {code}")
        return at

    read(0)
    return out


def to_wkb(kind: str, rings: list[np.ndarray]) -> bytes:
    body = lambda r: struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes()
    if kind == "point":
        return struct.pack("<BI", 1, 1) + np.ascontiguousarray(rings[0][0], "<f8").tobytes()
    if kind == "line":
        return struct.pack("<BI", 1, 2) + body(rings[0])
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(body(r) for r in rings)


def decode_wkb(df: DataFrame, col: str = "geometry") -> DataFrame:
    """A binary geometry column as geometry structs; multi-part geometries become rows with part numbers."""
    kind = f"array<{G.GEOMETRY}>"

    @F.arrow_udf(kind)
    def run(c):
        import pyarrow as pa

        parts = [[] if v is None else parse_wkb(v) for v in c.to_pylist()]
        flat = to_arrow([p for ps in parts for p in ps], pa)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32()), flat)

    rest = [c for c in df.columns if c != col]
    return df.withColumn("__parts", run(F.col(col))).select(*rest, F.posexplode("__parts").alias("part", col))


def encode_wkb(df: DataFrame, col: str = "geometry") -> DataFrame:
    from planarix.operators.spatial_join import geometries

    @F.arrow_udf("binary")
    def run(c):
        import pyarrow as pa

        return pa.array([to_wkb(k, r) for k, r in geometries(c)], pa.binary())

    return df.withColumn(col, run(F.col(col)))


def read_vector(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet file or directory with geometry as WKB or as our own structs. Bounding-box columns, where stored, prune row groups."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return decode_wkb(df) if "geometry" in df.columns and dict(df.dtypes)["geometry"] == "binary" else df


def write_vector(df: DataFrame, path: str, fmt: str = "parquet", *, wkb: bool = False, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write parquet (structs with bounding boxes, or WKB), geojson lines, or feather (Arrow files, one a partition).

    partition_by gives the per-tile, per-layer layout.
    """
    if fmt == "parquet":
        out = encode_wkb(df) if wkb else G.with_bounds(df)
        out.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)
    elif fmt == "geojson":
        geojson(df).write.mode(mode).text(path)
    elif fmt == "feather":
        _feather(df, path)
    else:
        raise ValueError(f"unknown format {fmt!r}: parquet, geojson or feather")


def geojson(df: DataFrame) -> DataFrame:
    """One feature a line."""
    g = F.col("geometry")
    pair = lambda p: F.array(p["x"], p["y"])
    rings = F.transform(g["rings"], lambda r: F.transform(r, pair))
    coords = F.when(g["kind"] == "polygon", F.to_json(rings)).when(g["kind"] == "line", F.to_json(rings[0])).otherwise(F.to_json(rings[0][0]))
    kind = F.when(g["kind"] == "polygon", "Polygon").when(g["kind"] == "line", "LineString").otherwise("Point")
    props = F.to_json(F.struct(*[c for c in df.columns if c != "geometry"])) if len(df.columns) > 1 else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":'), props, F.lit("}")).alias("value"))


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features, one a line: the named properties (a DDL schema) and geometry; polygons, lines and points."""
    raw = spark.read.text(path)
    head = F.from_json("value", f"type string, geometry struct<type:string,coordinates:string>, properties struct<{properties}>")
    f = raw.select(head.alias("f")).select("f.*")
    c, t = F.col("geometry.coordinates"), F.col("geometry.type")
    nested = F.when(t == "Polygon", F.from_json(c, "array<array<array<double>>>")).when(t == "LineString", F.array(F.from_json(c, "array<array<double>>"))).otherwise(F.array(F.array(F.from_json(c, "array<double>"))))
    rings = F.transform(nested, lambda r: F.transform(r, lambda p: G.xy(p[0], p[1])))
    kind = F.when(t == "Polygon", "polygon").when(t == "LineString", "line").otherwise("point")
    return f.select("properties.*", F.struct(kind.alias("kind"), rings.alias("rings")).alias("geometry"))


def _feather(df: DataFrame, path: str) -> None:
    """Arrow IPC files through Hadoop's file system, one a partition, written by the tasks."""
    import io

    import pyarrow as pa

    rows = df.withColumn("__part", F.spark_partition_id())
    columns = df.columns

    def run(batches):
        for n, batch in enumerate(batches):
            part = batch.column(batch.schema.get_field_index("__part"))[0].as_py()
            sink = io.BytesIO()
            table = pa.Table.from_batches([batch]).select(columns)
            with pa.ipc.new_file(sink, table.schema) as w:
                w.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}"]), pa.array([sink.getvalue()], pa.binary())], names=["name", "data"])

    rows.mapInArrow(run, "name string, data binary").write.mode("overwrite").parquet(path)


def read_feather(spark: SparkSession, path: str, schema) -> DataFrame:
    """Tables written by write_vector(fmt="feather")."""
    import io

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from pa.ipc.open_file(io.BytesIO(data)).read_all().to_batches()

    return spark.read.parquet(path).select("data").mapInArrow(run, schema)
