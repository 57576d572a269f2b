"""File readers: GeoJSON, point CSV, OBJ, ASCII PLY, LAS, shapefiles, survey documents."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from geojobs.functions.geometry import GEOMETRY
from geojobs.operators.cloud import ranked
from geojobs.operators.rings import nest
from geojobs.operators.storage import open_store, qualified, settle
from geojobs.sources import collections

XYZ = "x double, y double, z double, nx double, ny double, nz double"


def read_geojson(spark: SparkSession, path: str, properties: str, range_bytes: int = collections.RANGE) -> DataFrame:
    """FeatureCollections or features as JSON lines -> gid, the properties of the given DDL, geom with z (0 where missing).

    ``gid`` is the feature's place from 1; files follow each other by name. A file that begins with a feature is read line by line
    and so by many tasks; a collection, one JSON document, is read by ranges of ``range_bytes``. Empty files have none.
    """
    fields = ",".join(p.strip().replace(" ", ":", 1) for p in properties.split(","))
    feature = f"struct<type:string,properties:struct<{fields}>,geometry:struct<type:string,coordinates:string>>"
    kinds = settle(collections.kinds(spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")))
    names = {k: [r["file"] for r in kinds.where(F.col("kind") == k).select("file").collect()] for k in ("lines", "collection")}  # a row for each file
    found = []
    if names["lines"]:
        rows = numbered(spark, names["lines"]).where(F.trim("value") != "")
        found.append(rows.select("file", F.col("line_no").alias("at"), F.from_json(F.concat(F.lit('{"f":'), "value", F.lit("}")), f"f {feature}")["f"].alias("f")))
    if names["collection"]:
        rows = collections.features(kinds.where("kind = 'collection'").select("file", "length"), range_bytes)
        found.append(rows.select("file", "at", F.from_json(F.concat(F.lit('{"f":'), "value", F.lit("}")), f"f {feature}")["f"].alias("f")))
    none = spark.createDataFrame([], f"file string, at long, f {feature}")
    return _features(reduce(DataFrame.unionByName, found, none))


def _features(rows: DataFrame) -> DataFrame:
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.array(F.array(F.from_json(text, "array<double>")))
    rings = F.when(kind == "Point", point).when(kind == "Polygon", F.from_json(text, "array<array<array<double>>>"))
    full = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p[0], p[1], F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)))))
    out = rows.select((F.col("at") + 1).cast("long").alias("at"), "file", "f.properties.*", F.struct(kind.alias("type"), full.alias("rings")).cast(GEOMETRY).alias("geom"))
    names = [c for c in out.columns if c not in ("at", "file", "geom")]
    sizes = out.groupBy("file").agg(F.max("at").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return out.join(starts, "file").select((F.col("at") + F.col("before")).alias("gid"), *names, "geom")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """CSV of points with normals, its header skipped; the columns count, not their names."""
    return spark.read.csv(path, header=True, schema=XYZ, enforceSchema=True)


def numbered(spark: SparkSession, path: str | list[str], through: bool = False) -> DataFrame:
    """(file, line_no, value): text lines with their numbers from 0 within each file, or ``through`` all files by name.

    No file is read by one task. Lines of a split come in order, so a line's number is its place in the split and what the splits
    before hold: a running sum over a row for each split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = settle(lines)
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    order = Window.orderBy("file", "start") if through else Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "start", "first", before.alias("before"))
    return lines.join(splits, ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "value")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of an OBJ file, or of the parts of one in a folder, which follow each other by name."""
    lines = settle(numbered(spark, path, through=True).select("line_no", "value"))
    return obj_vertices(lines), obj_faces(lines)


def _words(lines: DataFrame, kind: str) -> DataFrame:
    """(line_no, p): the words of the lines that begin with ``kind`` and a space."""
    return lines.where(F.col("value").startswith(kind + " ")).select("line_no", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p"))


def _vertices(lines: DataFrame) -> DataFrame:
    rows = _words(lines, "v").where(F.size("p") >= 4)
    rows = rows.select("line_no", *[F.try_element_at("p", F.lit(i + 2)).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    return rows.where("x is not null and y is not null and z is not null")


def obj_vertices(lines: DataFrame) -> DataFrame:
    """``lines(line_no, value)`` -> vid (from 1, in file order), x, y, z. Short or unreadable ``v`` lines are skipped."""
    return ranked(_vertices(lines), "line_no").select((F.col("rank") + 1).alias("vid"), "x", "y", "z")


def obj_faces(lines: DataFrame) -> DataFrame:
    """``lines(line_no, value)`` -> fid, a, b, c: faces as fans of triangles about their first corner.

    Numbers count vertices from 1, or from the face's line backwards where they are negative. ``fid`` has the line in its upper bits
    and the triangle in its lower 24, so that faces of millions of corners don't collide.
    """
    corners = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda t: F.split(t, "/")[0].try_cast("long"))
    rows = _words(lines, "f").select("line_no", corners.alias("v")).where(F.size("v") >= 3)
    back = rows.where(F.exists("v", lambda i: i < 0))
    plain = rows.where(~F.coalesce(F.exists("v", lambda i: i < 0), F.lit(False)))
    # How many vertices stand before a face: its place among vertices and such faces, less such faces before it.
    both = _vertices(lines).select("line_no", F.lit(None).cast("array<bigint>").alias("v")).unionByName(back)
    placed = ranked(both, "line_no").where("v is not null").withColumnRenamed("rank", "_all")
    placed = ranked(placed, "line_no").select("line_no", (F.col("_all") - F.col("rank")).alias("n"), "v")
    turned = placed.select("line_no", F.transform("v", lambda i: F.when(i < 0, F.col("n") + 1 + i).otherwise(i)).alias("v"))
    fans = plain.unionByName(turned).select("line_no", "v", F.explode(F.sequence(F.lit(1), F.size("v") - 2)).alias("k"))
    fid = F.shiftleft(F.col("line_no").cast("long"), 24) + F.col("k")
    made = fans.select(fid.alias("fid"), F.col("v")[0].alias("a"), F.element_at("v", F.col("k") + 1).alias("b"), F.element_at("v", F.col("k") + 2).alias("c"))
    return made.where("a is not null and b is not null and c is not null")


def _head(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first ``n`` lines of the files by name; Spark itself reads large files first. The driver holds a row for each file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length").where("length > 0")
    out: list[str] = []
    for name in sorted(r["file"] for r in files.select("file").collect()):
        begin = spark.read.text(name).where(F.col("_metadata.file_block_start") == 0)  # one task's lines, in their order
        out += [r["value"] for r in begin.select("value").limit(n - len(out)).collect()]
        if len(out) >= n or any(line.split()[:1] == ["end_header"] for line in out):
            break
    return out


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """ASCII PLY, a file or the parts of one in a folder -> pid and the vertices' properties as doubles. The driver reads the header."""
    head, kinds, count, inside = _head(spark, path, 200), [], 0, False
    if not head or head[0].strip() != "ply" or "format ascii 1.0" not in [h.strip() for h in head]:
        raise ValueError(f"{path} is no ASCII PLY file")
    for i, line in enumerate(head):
        words = line.split()
        if words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            kinds.append(words[-1])
        elif words[:1] == ["end_header"]:
            begin = i + 1
            break
    else:
        raise ValueError(f"the header of {path} has no end")
    rows = numbered(spark, path, through=True).where(F.col("line_no").between(begin, begin + count - 1))
    parts = F.split(F.trim("value"), r"\s+")
    return rows.select((F.col("line_no") - begin).alias("pid"), *[parts[i].cast("double").alias(n) for i, n in enumerate(kinds)])


def read_survey(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reconstruction documents -> cameras (file, camera_id, numbers) and shots (file, shot_id, camera_id, rotation, translation)."""
    camera = "struct<width:int,height:int,focal_x:double,focal_y:double,c_x:double,c_y:double,k1:double,k2:double,k3:double,p1:double,p2:double>"
    shot = "struct<camera:string,rotation:array<double>,translation:array<double>>"
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"array<struct<cameras:map<string,{camera}>,shots:map<string,{shot}>>>")[0].alias("d")).where("d is not null")
    cameras = docs.select("file", F.explode("d.cameras").alias("camera_id", "c")).select("file", "camera_id", "c.*")
    shots = docs.select("file", F.explode("d.shots").alias("shot_id", "s")).select("file", "shot_id", F.col("s.camera").alias("camera_id"), "s.rotation", "s.translation")
    return cameras, shots


#: Where the LAS point formats with colour have it.
LAS_COLOR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
LAS_SCHEMA = "pid bigint, x double, y double, z double, intensity int, classification int, red int, green int, blue int"


def las_header(data: bytes) -> dict:
    """Places, counts, scales and offsets from the first 375 bytes of a LAS file."""
    if data[:4] != b"LASF":
        raise ValueError("no LAS file")
    minor = data[25]
    offset, = struct.unpack_from("<I", data, 96)
    kind, size, count = struct.unpack_from("<BHI", data, 104)
    if kind & 0x80:
        raise ValueError("compressed LAS files are not read")
    scale_offset = struct.unpack_from("<6d", data, 131)
    if minor >= 4 and len(data) >= 255:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    return {"offset": offset, "format": kind, "size": size, "count": count, "scale": scale_offset[:3], "shift": scale_offset[3:]}


def las_points(data: bytes, head: dict, first: int) -> pd.DataFrame:
    """Point records -> columns; ``first`` is the first one's pid."""
    fields = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "intensity": ("<u2", 12), "classification": ("u1", 15 if head["format"] < 6 else 16)}
    if head["format"] in LAS_COLOR:
        fields |= {n: ("<u2", LAS_COLOR[head["format"]] + 2 * i) for i, n in enumerate(("red", "green", "blue"))}
    kind = np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": head["size"]})
    raw = np.frombuffer(data, kind)
    out = {"pid": np.arange(first, first + len(raw))} | {c: raw[c.upper()] * head["scale"][i] + head["shift"][i] for i, c in enumerate("xyz")}
    out["intensity"] = raw["intensity"].astype(np.int32)
    out["classification"] = (raw["classification"] & (31 if head["format"] < 6 else 255)).astype(np.int32)
    colors = {n: raw[n].astype(np.int32) if n in fields else np.zeros(len(raw), np.int32) for n in ("red", "green", "blue")}
    return pd.DataFrame(out | colors)


class LasRange(InputPartition):
    def __init__(self, path: str, head: dict, first: int, pid: int, count: int):
        self.path, self.head, self.first, self.pid, self.count = path, head, first, pid, count


def _headers(path: str) -> list[tuple[str, dict]]:
    """(file, header) of a LAS file, or of all in a folder by name."""
    from concurrent.futures import ThreadPoolExecutor

    from pyarrow import fs

    system, place = open_store(path)
    found = [place]
    if system.get_file_info(place).type == fs.FileType.Directory:
        files = system.get_file_info(fs.FileSelector(place, recursive=True))
        found = sorted(f.path for f in files if f.is_file and f.path.lower().endswith(".las"))

    def head(name: str) -> tuple[str, dict]:
        with system.open_input_file(name) as f:
            return path.removesuffix(place) + name if path.endswith(place) else path.partition(":")[0] + "://" + name, las_header(f.read_at(375, 0))

    with ThreadPoolExecutor(32) as pool:  # some hundred bytes of each file
        return list(pool.map(head, found))


class LasReader(DataSourceReader):
    """One partition per range of records; executors seek. ``pid`` counts on over the files of a folder."""

    def __init__(self, options: dict):
        self.path, self.records = options["path"], int(options.get("records", 1_000_000))

    def partitions(self) -> list[LasRange]:
        out, before = [], 0
        for name, head in _headers(self.path):
            out += [LasRange(name, head, at, before + at, min(self.records, head["count"] - at)) for at in range(0, head["count"], self.records)]
            before += head["count"]
        return out

    def read(self, part: LasRange) -> Iterator:
        import pyarrow as pa

        system, path = open_store(part.path)
        with system.open_input_file(path) as f:
            for at in range(0, part.count, 100_000):
                n = min(100_000, part.count - at)
                data = f.read_at(n * part.head["size"], part.head["offset"] + (part.first + at) * part.head["size"])
                kinds = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
                schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in LAS_SCHEMA.split(", ")])
                yield pa.RecordBatch.from_pandas(las_points(data, part.head, part.pid + at), schema, preserve_index=False)


class LasSource(DataSource):
    """``spark.read.format("las_points").load(path)``: uncompressed LAS, a file or a folder, on any file system that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "las_points"

    def schema(self) -> str:
        return LAS_SCHEMA

    def reader(self, schema: T.StructType) -> LasReader:
        return LasReader(self.options)


def read_las(spark: SparkSession, path: str, records: int = 1_000_000) -> DataFrame:
    """The points of a LAS file, or of all .las files in a folder, which follow each other by name."""
    spark.dataSource.register(LasSource)
    return spark.read.format("las_points").option("records", records).load(qualified(spark, path))


SHAPES = {1: "Point", 5: "Polygon", 11: "Point", 15: "Polygon", 21: "Point", 25: "Polygon"}


def shape_of(body: bytes) -> tuple[str | None, list]:
    """(type, parts of rings) of a record's content. Rings are nested by what contains them: a record of several outer rings is a
    MultiPolygon. Other types than points and polygons have null geometries."""
    kind = struct.unpack_from("<i", body)[0]
    if SHAPES.get(kind) == "Point":
        xyz = struct.unpack_from("<2d", body, 4) + (struct.unpack_from("<d", body, 20) if kind == 11 else (0.0,))
        return "Point", [[[list(xyz)]]]
    if SHAPES.get(kind) == "Polygon":
        parts, n = struct.unpack_from("<2i", body, 36)
        starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
        xy = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2)
        z = np.frombuffer(body, "<f8", n, 44 + 4 * parts + 16 * n + 16) if kind == 15 else np.zeros(n)
        line = np.column_stack((xy, z))
        rings = [line[a:b] for a, b in zip(starts, starts[1:])]
        polygons = [[rings[k].tolist() for k in ks] for ks in nest(rings)]
        return "MultiPolygon" if len(polygons) > 1 else "Polygon", polygons
    return None, []


def table_fields(head: bytes) -> list[tuple[str, int, int]]:
    """(name, begin, end) of the fields in a row, from the header of a layer's table."""
    fields, place = [], 1
    for at in range(32, len(head) - 1, 32):
        if head[at] == 0x0D:
            break
        fields.append((head[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), place, place + head[at + 16]))
        place += head[at + 16]
    return fields


class LayerRange(InputPartition):
    """``count`` records from ``first`` on; ``at`` is the place of that one in a layer without its own index."""

    def __init__(self, layer: str, shp: str, dbf: str, shx: str | None, first: int, count: int, at: int = 100):
        self.layer, self.shp, self.dbf, self.shx, self.first, self.count, self.at = layer, shp, dbf, shx, first, count, at


def _layers(path: str) -> list[tuple]:
    """(layer, shp, dbf, shx or None) files of a folder, by name."""
    from pyarrow import fs

    system, place = open_store(path)
    found = {f.path.lower(): f for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file}
    named = [(found[n], found.get(n[:-4] + ".dbf"), found.get(n[:-4] + ".shx")) for n in sorted(found) if n.endswith(".shp")]
    return [(f"{path.rstrip('/')}/{shp.path[len(place.rstrip('/')) + 1 : -4]}", shp, dbf, shx) for shp, dbf, shx in named if dbf is not None]


def _scan(records: int, block: int = 8 << 20):
    """(uri of a .shp) -> (uri, first, at): where every ``records``-th record begins. Headers tell how long records are; their contents
    are passed over, and headers that stand near each other are read together."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = open_store(uri)
                firsts, places = [], []
                with system.open_input_file(path) as f:
                    at, n, size, data, begin = 100, 0, f.size(), b"", 0
                    while at + 8 <= size:
                        if n % records == 0:
                            firsts.append(n)
                            places.append(at)
                        if not begin <= at <= begin + len(data) - 8:
                            data, begin = f.read_at(min(block, size - at), at), at
                        at, n = at + 8 + 2 * struct.unpack_from(">i", data, at - begin + 4)[0], n + 1
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(firsts)), pa.array(firsts, pa.int64()), pa.array(places, pa.int64())], names=["uri", "first", "at"])

    return run


class LayerRanges(InputPartition):
    """Ranges that one task reads one after another."""

    def __init__(self, ranges: list[LayerRange]):
        self.ranges = ranges


#: Records that a task reads at least, where there are as many: starting one costs more than reading a few ranges.
TASK_RECORDS = 10_000


class LayerReader(DataSourceReader):
    """Ranges of records, by a layer's index (.shx) or by the places in ``starts``; executors seek. Small ranges share a partition."""

    def __init__(self, options: dict):
        self.path, self.properties, self.records = options["path"], json.loads(options["properties"]), int(options.get("records", 50_000))
        self.starts = json.loads(options.get("starts", "{}"))

    def partitions(self) -> list[LayerRanges]:
        ranges = self._ranges()
        each = max(1, TASK_RECORDS // self.records)
        return [LayerRanges(ranges[at : at + each]) for at in range(0, len(ranges), each)]

    def _ranges(self) -> list[LayerRange]:
        out = []
        for layer, shp, dbf, shx in _layers(self.path):
            if shx is None:
                out += [LayerRange(layer, shp.path, dbf.path, None, first, self.records, at) for first, at in self.starts.get(layer, [(0, 100)])]
                continue
            n = (shx.size - 100) // 8
            out += [LayerRange(layer, shp.path, dbf.path, shx.path, at, min(self.records, n - at)) for at in range(0, n, self.records)]
        return out

    def _places(self, shp, part: LayerRange, open_file) -> Iterator[tuple[int, int]]:
        """(place of the content, its bytes) of each record."""
        if part.shx is None:
            at, size, left = part.at, shp.size(), part.count
            while at + 8 <= size and left:
                length = struct.unpack(">i", shp.read_at(4, at + 4))[0] * 2
                yield at + 8, length
                at, left = at + 8 + length, left - 1
            return
        with open_file(part.shx) as f:
            for at, length in struct.iter_unpack(">2i", f.read_at(8 * part.count, 100 + 8 * part.first)):
                yield 2 * at + 8, 2 * length

    def read(self, some: LayerRanges) -> Iterator:
        for part in some.ranges:
            yield from self._read(part)

    def _read(self, part: LayerRange) -> Iterator:
        import pyarrow as pa

        system, _ = open_store(self.path)
        kinds = {"layer": pa.string(), "gid": pa.int64(), "p": pa.list_(pa.string()), "type": pa.string(), "parts": pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))}
        with system.open_input_file(part.shp) as shp, system.open_input_file(part.dbf) as dbf:
            head, width = struct.unpack("<2H", dbf.read_at(4, 8))
            fields = {n: (a, b) for n, a, b in table_fields(dbf.read_at(head, 0))}
            places, first = iter(self._places(shp, part, system.open_input_file)), part.first
            while some := list(islice(places, 1_000)):
                low, high = min(a for a, _ in some), max(a + n for a, n in some)
                # Records mostly stand one after another; else each is read alone.
                whole = shp.read_at(high - low, low) if high - low < 4 * sum(n + 8 for _, n in some) else None
                table = dbf.read_at(width * len(some), head + width * first)
                rows: dict[str, list] = {c: [] for c in kinds}
                for k, (at, n) in enumerate(some):
                    kind, parts = shape_of(whole[at - low : at - low + n] if whole is not None else shp.read_at(n, at))
                    row = table[k * width : (k + 1) * width]
                    texts = [row[slice(*fields[p])].decode("utf-8", "replace").strip() if p in fields else None for p in self.properties]
                    for c, v in zip(rows, (part.layer, first + k + 1, texts, kind, parts)):
                        rows[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], kind) for c, kind in kinds.items()], names=list(kinds))
                first += len(some)


class LayerSource(DataSource):
    """``spark.read.format("shapefile_layers").option("properties", '["name"]').load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_layers"

    def schema(self) -> str:
        return "layer string, gid bigint, p array<string>, type string, parts array<array<array<array<double>>>>"

    def reader(self, schema: T.StructType) -> LayerReader:
        return LayerReader(self.options)


def read_shapefiles(spark: SparkSession, path: str, properties: list[str], records: int = 50_000) -> DataFrame:
    """A folder of .shp and .dbf pairs -> layer, gid, the properties as strings, geom (type, rings, parts).

    Layers are read by ranges of ``records`` records, through their index (.shx) or one that a task makes by passing over their record
    headers. ``geom.parts`` are the polygons of a record, ``geom.rings`` those of its only one: a record of several is a MultiPolygon,
    without rings, which ``layer_types`` and ``layer_validate`` tell.
    """
    spark.dataSource.register(LayerSource)
    path = qualified(spark, path)
    bare = [(layer, layer + shp.path[-4:]) for layer, shp, _, shx in _layers(path) if shx is None]
    starts: dict[str, list] = {}
    if bare:  # a row for each range of records reaches the driver
        names = dict((uri, layer) for layer, uri in bare)
        for r in spark.createDataFrame([(uri,) for uri in names], "uri string").repartition(len(names)).mapInArrow(_scan(records), "uri string, first long, at long").orderBy("uri", "first").collect():
            starts.setdefault(names[r["uri"]], []).append((r["first"], r["at"]))
    rows = spark.read.format("shapefile_layers").options(properties=json.dumps(properties), records=records, starts=json.dumps(starts)).load(path)
    part = F.transform("parts", lambda r: F.struct(F.col("type").alias("_"), r.alias("rings")))
    parts = F.transform(part, lambda p: F.struct(F.when(p["_"] == "MultiPolygon", "Polygon").otherwise(p["_"]).alias("type"), p["rings"].alias("rings")))
    rings = F.when(F.col("type") != "MultiPolygon", F.coalesce(F.get("parts", F.lit(0)), F.expr("cast(array() as array<array<array<double>>>)")))
    rings = F.when(F.col("type").isNull(), F.expr("cast(array() as array<array<array<double>>>)")).otherwise(rings)
    return rows.select("layer", "gid", *[F.col("p")[i].alias(p) for i, p in enumerate(properties)], F.struct("type", rings.alias("rings"), parts.alias("parts")).alias("geom"))


def layer_types(features: DataFrame) -> DataFrame:
    """(layer, geometry_type) of the layers of ``read_shapefiles``, as ``layer_validate`` takes it: Multi as soon as one record has several parts."""
    kinds = features.groupBy("layer").agg(F.max_by("geom.type", F.length("geom.type")).alias("geometry_type"))
    return kinds.select("layer", "geometry_type")
