"""Fixtures: inputs of the registered queries, derived from the driver's tables. Each is one SQL text that Spark and DuckDB run unchanged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Columns and rows of the mesh's grid of vertices, as square as the orders allow; both are one more than a multiple of eight, so that
#: tile lines of three levels run along its sides. Orders beyond the last full row stand over the first rows and belong to no face.
GRID = """(select w, 8 * cast(floor((floor(cast(n as double) / w) - 1) / 8) as bigint) + 1 as r
  from (select n, 8 * cast(floor(sqrt(cast(n as double)) / 8) as bigint) + 1 as w from (select count(*) as n from orders) g0) g1) g"""

TABLES = "region nation customer supplier part orders lineitem events".split()

FIXTURES: dict[str, str] = {
    "cloud_points": r"""
select pid, x, y,
  cast(pid * 37 % 101 as double) / 100
   + case when cast(floor(x / 20) as bigint) % 3 = 0 and cast(floor(y / 20) as bigint) % 3 = 0 then 8.0 else 0.0 end
   - case when pid % 997 = 0 then 15.0 else 0.0 end as z,
  pid * 13 % 65536 as intensity, pid * 7 % 256 as red, pid * 11 % 256 as green, pid * 17 % 256 as blue, 0 as classification
from (select o_orderkey as pid,
  cast((o_orderkey * o_orderkey * 31 + o_orderkey * 7919) % 20011 as double) / 100 as x,
  cast((o_orderkey * o_orderkey * 17 + o_orderkey * 104729) % 19997 as double) / 100 as y
  from orders) p
""",
    "poly_params": r"""
select p_partkey as gid, p_name, p_brand, p_type, p_size, p_retailprice,
  case when p_partkey % 50 = 49 then 3 when p_partkey % 10 = 5 then 4 else p_partkey % 3 end as kind,
  cast(1120000 + (p_partkey % 100) * 100 as double) / 100000 as lon0,
  cast(4370000 + cast(floor(p_partkey / 100) as bigint) * 100 as double) / 100000 as lat0,
  cast(20 + p_partkey % 7 as double) / 100000 as w,
  case when p_partkey % 50 = 49 then 0.0 else cast(16 + p_partkey % 5 as double) / 100000 end as h,
  cast(p_partkey % 11 as double) / 10 as z0
from part
""",
    "feat_point": r"""
select c_custkey as gid, c_name, c_mktsegment, c_acctbal,
  cast(1120000 + c_custkey * 7919 % 20011 as double) / 100000 as x,
  cast(4370000 + c_custkey * 104729 % 19997 as double) / 100000 as y,
  case when c_custkey % 10 = 0 then 0.0 else cast(c_custkey % 90 as double) / 10 end as z
from customer
""",
    "mesh_vertices": rf"""
select o_orderkey as vid, cast(o_orderkey % w * 3 as double) / 2 as x,
  cast(cast(floor(o_orderkey / w) as bigint) % r * 3 as double) / 2 as y,
  cast(o_orderkey * 29 % 83 as double) / 20 as z
from orders cross join {GRID}
""",
    "mesh_faces": rf"""
select v * 2 + t as fid, v as a, case when t = 0 then v + 1 else v + w + 1 end as b, case when t = 0 then v + w + 1 else v + w end as c
from (select o_orderkey as v, w from orders cross join {GRID} where o_orderkey % w < w - 1 and o_orderkey + w + 1 < w * r
  and o_orderkey + w + 1 in (select o_orderkey from orders)) q
cross join (select 0 as t union all select 1 as t) s
""",
    "obj_lines": r"""
select o_orderkey as line_no,
  case when o_orderkey % 40 = 0 then '# comment'
       when o_orderkey % 40 = 1 then 'v 1.0 abc 2.0'
       when o_orderkey % 40 = 2 then 'v 9999 9999'
       when o_orderkey % 40 = 3 then 'vn 0 0 1'
       else concat('v ', cast(o_orderkey % 211 as varchar(20)), '.', cast(o_orderkey % 9 + 1 as varchar(20)), ' -',
                   cast(o_orderkey % 173 as varchar(20)), '.25 ', cast(o_orderkey % 31 as varchar(20))) end as value
from orders
""",
    "raster": r"""
select cast(floor(o_orderkey / 100) as bigint) as r_row, o_orderkey % 100 as r_col,
  o_orderkey * 3 % 256 as r, o_orderkey * 5 % 256 as g, o_orderkey * 9 % 256 as b
from orders
""",
    "geoid": r"""
select cast(floor(o_orderkey / 51) as bigint) as gi, o_orderkey % 51 as gj, cast(4500 + o_orderkey * 7 % 100 as double) / 100 as n
from orders
""",
    "assets": r"""
select p_partkey as id, p_partkey % 10 as owner_id,
  case p_partkey % 6
    when 2 then case cast(floor(p_partkey / 6) as bigint) % 4 when 0 then 'household.glb' when 1 then 'building.glb' when 2 then 'automobile.glb' else 'machinery.glb' end
    when 3 then concat('img_', cast(p_partkey % 600 as varchar(20)), '.tif')
    else concat(substr(p_name, 1, 3), '_', cast(p_partkey % 600 as varchar(20)),
      case p_partkey % 6 when 0 then '.shp.zip' when 1 then '.las' when 4 then '.obj.zip' else '.v1.las' end) end as filename,
  case p_partkey % 6 when 0 then '.shp.zip' when 1 then '.las' when 2 then '.glb' when 3 then '.tif' when 4 then '.obj.zip' else '.v1.las' end as extension,
  case p_partkey % 6 when 1 then 'LAS' when 4 then 'Mesh' when 0 then 'ESRI Shapefile' else null end as asset_type,
  case when p_partkey % 6 = 1 then 'PointCloud' when p_partkey % 12 = 0 then 'Polygon' when p_partkey % 6 = 0 then 'Point' else null end as geometry_type,
  case p_partkey % 4 when 0 then 'PENDING' when 1 then 'STARTED' when 2 then 'SUCCESS' else null end as upload_status,
  p_size * 50000 as content_size
from part
""",
    "pipelines": r"""
select o_orderkey as id, concat('pipeline ', cast(o_orderkey % 1000 as varchar(20))) as title,
  case when o_orderkey % 9 = 0 then null else o_custkey * 2 end as asset_id,
  case when o_orderkey % 13 = 0 then 0 else o_custkey * 2 % 10 end as owner_id,
  case o_orderkey % 3 when 0 then concat('{"colorization_image": "img_', cast(o_orderkey % 600 as varchar(20)), '.tif", "sample_radius": "0.5"}')
    when 1 then '{"translate_z": "2", "max_features_per_tile": "500"}' else null end as data,
  case o_orderstatus when 'P' then 'PENDING' when 'F' then 'SUCCESS' else 'FAILURE' end as task_status,
  case when o_orderstatus = 'F' and o_orderkey % 5 > 0 then concat('{"tileset": "/api/v1/output/', cast(o_orderkey as varchar(20)), '/tiles/tileset.json"}')
       when o_orderstatus = 'F' then '{"output": "none"}' else null end as task_result
from orders
""",
    "task_events": r"""
select event_id, ts, user_id as task_id,
  case event_type when 'view' then 'PENDING' when 'click' then 'STARTED' when 'purchase' then 'SUCCESS' when 'error' then 'FAILURE' else 'REVOKED' end as status,
  case when event_type = 'purchase' then props else null end as result
from events
""",
    "archive_members": r"""
select s_suppkey as archive_id, m,
  case when m = 0 then case s_suppkey % 5 when 0 then 'data/roads.shp' when 1 then 'm/._x.obj' when 2 then 'IMG_1.JPG' when 3 then 'readme.txt' else 'b/house.obj' end
       when m = 1 then case s_suppkey % 5 when 0 then 'data/roads.dbf' when 1 then 'a/b/x.obj' when 2 then 'config.json' when 3 then 'x.jpg' else '__MACOSX/b/house.obj' end
       else case s_suppkey % 5 when 1 then 'a/y.obj' when 4 then 'b/a.obj' else 'dir/' end end as path
from supplier cross join (select 0 as m union all select 1 as m union all select 2 as m) t
""",
    "survey_images": r"""
select p_partkey as image_id, p_partkey % 20 as survey_id,
  concat('img_', cast(p_partkey as varchar(20)), case p_partkey % 5 when 0 then '.JPG' when 1 then '.png' when 2 then '.txt' else '.tif' end) as name,
  800 + p_partkey * 37 % 5000 as width, 600 + p_partkey * 53 % 4000 as height,
  case when p_partkey % 20 < 6 and p_partkey % 7 = 0 then '{"make": "x", "opk": {"omega": 1.0}}' when p_partkey % 13 = 0 then '{bad' else '{"make": "x"}' end as exif
from part
""",
    "shots": r"""
select s_suppkey as shot_id, s_suppkey % 3 as camera_id, cast(s_suppkey % 17 as double) / 50 as rx, cast(s_suppkey % 13 as double) / 50 as ry,
  cast(s_suppkey % 11 as double) / 50 as rz, cast(s_suppkey % 7 as double) as tx, cast(s_suppkey % 5 as double) as ty, cast(40 + s_suppkey % 9 as double) as tz,
  1600 as width, 1200 as height
from supplier
""",
    "cameras": r"""
select n_nationkey as camera_id, cast(85 + n_nationkey as double) / 100 as focal_x, cast(86 + n_nationkey as double) / 100 as focal_y,
  case when n_nationkey = 1 then null else cast(n_nationkey as double) / 100 end as k1, cast(n_nationkey as double) / 1000 as k2
from nation where n_nationkey < 3
""",
    "crs_meta": r"""
select n_nationkey as asset_id,
  case n_nationkey % 4 when 0 then concat('PROJCS["x",AUTHORITY["EPSG","', cast(32600 + n_nationkey as varchar(20)), '"]]')
    when 1 then 'GEOGCS["w",authority["epsg","4979"],AUTHORITY["EPSG","4326"]]' when 2 then '' else null end as horizontal,
  case n_nationkey % 3 when 0 then 'VERT_CS["v",AUTHORITY["EPSG","3855"]]' else null end as vertical,
  case n_nationkey % 5 when 0 then 'VERT_CS["v",AUTHORITY["EPSG","3855"]]' when 1 then 'COMPD_CS["c",AUTHORITY["EPSG","32632"]]' else null end as comp,
  case when n_nationkey % 2 = 0 then '{"components":[{"type":"ProjectedCRS","id":{"authority":"EPSG","code":32633}},{"type":"VerticalCRS","id":{"authority":"EPSG","code":5773}}]}' else null end as srs_json
from nation
""",
    "layers": r"""
select n_nationkey as asset_id, case when n_nationkey % 11 = 10 then 2 else 1 end as layer_count, case when n_nationkey % 9 = 8 then 2 else 1 end as geom_fields,
  case n_nationkey % 6 when 0 then '3D Polygon' when 1 then 'Point' when 2 then 'Multi Polygon' when 3 then 'Line String' when 4 then 'Polygon' else '3D Point' end as geometry_type,
  n_nationkey % 7 <> 6 as has_srs, n_nationkey * 1000 as feature_count, n_nationkey * 200000 as content_size
from nation
""",
}


#: Fixtures that look a table up in itself, by its key: rows a task of this look-up.
LOOKED_UP, SHARE = {"mesh_faces": ("orders", "o_orderkey")}, 500_000


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture of ``FIXTURES`` over the tables of ``sf_dir``."""
    sql = FIXTURES[name]
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            if LOOKED_UP.get(name, ("", ""))[0] == table:
                tasks = -(-rows.count() // SHARE)
                if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
                    rows = rows.repartition(tasks, LOOKED_UP[name][1])  # else a task's share would grow with the table
            rows.createOrReplaceTempView(table)
    return spark.sql(sql)


def over(sql: str, *names: str) -> str:
    """``sql`` with the fixtures ``names`` before it as common table expressions (``sql`` may begin with a comma and go on with its own)."""
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names)
    body = sql.strip()
    if body[:1] == ",":  # further common table expressions of its own
        return f"WITH {ctes}{body}"
    return f"WITH {ctes} {body}"
