"""One query per operator over meshes derived from the driver's tables, each with the SQL that checks it.

Meshes: a box per row of ``part`` (some without floor, some faces wound wrong), and height
fields of eight by eight vertices over runs of 64 parts. Both are made by expressions over whole tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide import plans, sources
from meshtide.functions import STRIDES, quantised, uniform
from meshtide.model import CORNERS, Settings, bad_corners
from meshtide.operators import casting, components, evaluate, prep, raster, rays, voting
from meshtide.operators.staging import saved, shared_folder

FACETS = Settings(rays_total=120, rays_minimum=4, strategy="sql")
WHOLE = Settings(rays_total=60, rays_minimum=10, facet_wise=False, strategy="sql")
# fixed values: the quads of a box, corners numbered by the bits x, y, z, wound outward: floor, roof, south, north, west, east
QUADS = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A box per part, about half of its faces reversed; every third without floor."""
    part = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("mesh_id"), "p_partkey", F.col("p_size").cast("double").alias("w"), (1 + F.col("p_partkey") % 7).cast("double").alias("d"), (F.col("p_retailprice") - 899).alias("h"))
    i = F.col("vertex_id")
    corner = part.withColumn("vertex_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    vertices = corner.select("mesh_id", "vertex_id", ((i % 2) * F.col("w")).alias("x"), (F.floor(i / 2) % 2 * F.col("d")).alias("y"), (F.floor(i / 4) * F.col("h")).alias("z"))
    made = F.array(*(F.struct(F.lit(2 * q + t).cast("bigint").alias("face_id"), *(F.lit(x).cast("bigint").alias(k) for k, x in zip(CORNERS, (r[0], r[1 + t], r[2 + t]), strict=True))) for q, r in enumerate(QUADS) for t in (0, 1)))
    faces = part.select("mesh_id", "p_partkey", F.explode(made).alias("f")).where("f.face_id > 1 or p_partkey % 3 <> 0").select("mesh_id", "f.*")
    return vertices, _reversed(faces, 0.5)


def fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Height fields: part sizes over a grid of eight by eight, two triangles a cell, three tenths reversed."""
    k = F.col("p_partkey")
    at = _table(spark, sf_dir, "part").select(F.concat(F.lit("g"), F.floor(k / 64)).alias("mesh_id"), (k % 64).alias("i"), F.col("p_size").cast("double").alias("z"))
    vertices = at.select("mesh_id", F.col("i").alias("vertex_id"), (F.col("i") % 8).cast("double").alias("x"), F.floor(F.col("i") / 8).cast("double").alias("y"), "z")
    cell = at.where("i % 8 < 7 and i < 56").join(at.select("mesh_id", (F.col("i") - 9).alias("i")).hint("merge"), ["mesh_id", "i"], "left_semi")
    i = F.col("i")
    two = F.array(*(F.struct((2 * i + t).alias("face_id"), i.alias("a"), (i + p).alias("b"), (i + q).alias("c")) for t, p, q in ((0, 1, 9), (1, 9, 8))))
    return vertices, _reversed(cell.select("mesh_id", F.explode(two).alias("f")).select("mesh_id", "f.*"), 0.3)


def _reversed(faces: DataFrame, share: float) -> DataFrame:
    turn = uniform("wind", F.col("mesh_id"), F.col("face_id")) < share
    return faces.select("mesh_id", "face_id", F.when(turn, F.col("c")).otherwise(F.col("a")).alias("a"), "b", F.when(turn, F.col("a")).otherwise(F.col("c")).alias("c"))


def doubled(faces: DataFrame) -> DataFrame:
    """Faces of every other mesh once more, rotated and with higher ids."""
    return faces.unionByName(faces.where("crc32(mesh_id) % 2 = 0").select("mesh_id", (F.col("face_id") + 1000).alias("face_id"), F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c")))


def triangles(spark: SparkSession, sf_dir: str, of=boxes) -> DataFrame:
    """Box triangles with normals, each its own component, made once."""
    vertices, faces = of(spark, sf_dir)
    return saved(prep.with_normals(prep.gather(vertices, faces)).withColumn("component", F.col("face_id")), "triangles")


def box_lines(spark: SparkSession, sf_dir: str, settings: Settings = FACETS) -> tuple[DataFrame, DataFrame]:
    tri = triangles(spark, sf_dir).repartition("mesh_id")
    return tri, rays.facet_lines(tri, rays.allot(tri, settings), settings)


def whole_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height-field triangles, wound and numbered by component."""
    vertices, faces = fields(spark, sf_dir)
    return saved(prep.with_normals(prep.gather(vertices, components.orient_components(faces), "component")), "triangles")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table like the evaluation's: a mass per supplier pair of scores derived from its account."""
    s = _table(spark, sf_dir, "supplier")
    score = lambda m: F.round(uniform(m, F.col("s_suppkey")), 4)
    rows = F.array(*(F.struct(F.lit(m).alias("method"), score(m).alias("backfacingness")) for m in ("published", "facets", "whole")))
    return s.select(F.col("s_name").alias("mass"), (F.col("s_suppkey") * 37 % 1009).cast("int").alias("triangles"), F.explode(rows).alias("r")).select("mass", "triangles", "r.*")


# --- SQL of the meshes -------------------------------------------------------------------------------------

def _u(*keys: str) -> str:
    return f"(cast(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13)) as bigint) / 4503599627370496::double)"


def _q(x: str) -> str:
    return f"cast(floor(({x}) * 1e6 + 0.5) as bigint)"


def _dot(a: str, b: str) -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def _cross(a: str, b: str, name: str) -> str:
    return ", ".join(f"{a}{p} * {b}{r} - {a}{r} * {b}{p} as {name}{x}" for x, p, r in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")))


def _sub(a: str, b: str, name: str) -> str:
    return ", ".join(f"{a}{x} - {b}{x} as {name}{x}" for x in "xyz")


def _turn(source: str, share: float) -> str:
    return f"select mesh_id, face_id, case when u < {share} then c else a end as a, b, case when u < {share} then a else c end as c from (select *, {_u(chr(39) + 'wind' + chr(39), 'mesh_id', 'cast(face_id as varchar)')} as u from {source})"


_QUAD_ROWS = ", ".join(f"({2 * q + t}, {r[0]}, {r[1 + t]}, {r[2 + t]})" for q, r in enumerate(QUADS) for t in (0, 1))
BOXES = f"""v as (select 'p' || p_partkey as mesh_id, i as vertex_id, (i % 2) * p_size::double as x, ((i // 2) % 2) * (1 + p_partkey % 7)::double as y, (i // 4) * (p_retailprice - 899) as z
    from part, (select unnest(range(8)) as i)),
  f0 as (select 'p' || p_partkey as mesh_id, t.face_id, t.a, t.b, t.c from part, (values {_QUAD_ROWS}) t(face_id, a, b, c) where t.face_id > 1 or p_partkey % 3 <> 0),
  f as ({_turn('f0', 0.5)})"""
FIELDS = f"""pt as (select 'g' || (p_partkey // 64) as mesh_id, p_partkey % 64 as i, p_size::double as z from part),
  v as (select mesh_id, i as vertex_id, (i % 8)::double as x, (i // 8)::double as y, z from pt),
  cell as (select * from pt where i % 8 < 7 and i < 56 and (mesh_id, i + 9) in (select mesh_id, i from pt)),
  f0 as (select mesh_id, 2 * i + t as face_id, i as a, i + p as b, i + q as c from cell, (values (0, 1, 9), (1, 9, 8)) k(t, p, q)),
  f as ({_turn('f0', 0.3)})"""


def _tri(faces: str = "f", component: str = "face_id", name: str = "tri") -> str:
    corners = ", ".join(f"v{k}.{x} as {k}{x}" for k in CORNERS for x in "xyz")
    joins = " ".join(f"join v v{k} on v{k}.mesh_id = f.mesh_id and v{k}.vertex_id = f.{k}" for k in CORNERS)
    return f"""{name}_c as (select f.mesh_id, f.face_id, {component} as component, f.a, f.b, f.c, {corners} from {faces} f {joins}),
  {name}_e as (select *, {_sub('b', 'a', 'e1')}, {_sub('c', 'a', 'e2')} from {name}_c),
  {name}_n as (select *, {_cross('e1', 'e2', 'n')} from {name}_e),
  {name} as (select *, sqrt({_dot('n', 'n')}) as dbl_area from {name}_n)"""


def _allot(s: Settings) -> str:
    total = s.rays_total if s.rays_total is not None else "faces_all * 100"
    return f"""ca as (select mesh_id, component, sum({_q('dbl_area')})::bigint as area, count(*) as faces from tri group by 1, 2),
  cm as (select *, sum(area) over (partition by mesh_id)::bigint as mesh_area, sum(faces) over (partition by mesh_id) as faces_all from ca),
  allot as (select mesh_id, component, area, case when area = 0 then 0 else greatest(cast(floor({total} * area / nullif(mesh_area, 0)::double + 1e-9) as bigint), {s.rays_minimum}) end as rays from cm)"""


def _draw(k: int) -> str:
    return f"((cast(('0x' || substr(m, {6 * k + 1}, 6)) as bigint) / 16777216.0::double + ray_no::double * {STRIDES[k]!r}e0) % 1.0::double)"


def _starts(s: Settings) -> str:
    each = f"each_ray as (select mesh_id, component, area, md5(concat_ws('|', '{s.seed}', mesh_id, component::varchar)) as m, unnest(range(rays::bigint)) as ray_no from allot where rays > 0)"
    if s.facet_wise:
        return f"{each},\n  starts as (select mesh_id, component, ray_no, component as face_id, m from each_ray)"
    return f"""{each},
  reach as (select mesh_id, component, face_id, sum(qa) over (partition by mesh_id, component order by face_id rows unbounded preceding)::bigint as hi, qa from (select *, {_q('dbl_area')} as qa from tri)),
  starts as (select e.mesh_id, e.component, e.ray_no, r.face_id, e.m from (select *, {_draw(4)} * area as target from each_ray) e
    join reach r on r.mesh_id = e.mesh_id and r.component = e.component and r.qa > 0 and e.target >= r.hi - r.qa and e.target < r.hi)"""


def _lines(s: Settings) -> str:
    us = ", ".join(f"{_draw(k)} as u{k}" for k in range(4))
    origin = ", ".join(f"(a{x} * (1.0 - root) + b{x} * ((1.0 - u1) * root)) + c{x} * (u1 * root) as o{x}" for x in "xyz")
    unit = ", ".join(f"e1{x} / sqrt({_dot('e1', 'e1')}) as t{x}, n{x} / dbl_area as m{x}" for x in "xyz")
    direction = ", ".join(f"m{x} * up + (t{x} * (side * cos(turn)) + w{x} * (side * sin(turn))) as d{x}" for x in "xyz")
    return f"""l0 as (select t.*, s.ray_no, s.component as comp, {us} from starts s join tri t on t.mesh_id = s.mesh_id and t.face_id = s.face_id),
  l1 as (select *, sqrt(u0) as root, 0.1::double + 0.9::double * u2 as up, 2.0::double * pi() * u3 as turn, {unit} from l0),
  l2 as (select *, sqrt(1.0 - up * up) as side, {origin}, {_cross('m', 't', 'w')} from l1),
  lines as (select mesh_id, comp as component, ray_no, face_id, ox, oy, oz, {direction} from l2)"""


_HITS = f"""h0 as (select l.mesh_id, l.component, l.ray_no, l.ox, l.oy, l.oz, l.dx, l.dy, l.dz, t.ax, t.ay, t.az, t.e1x, t.e1y, t.e1z, t.e2x, t.e2y, t.e2z from lines l join tri t on t.mesh_id = l.mesh_id and t.face_id <> l.face_id),
  h1 as (select *, {_cross('d', 'e2', 'p')}, {_sub('o', 'a', 's')} from h0),
  h2 as (select *, 1.0 / nullif({_dot('e1', 'p')}, 0.0) as inv, {_cross('s', 'e1', 'q')} from h1),
  h3 as (select mesh_id, component, ray_no, {_dot('s', 'p')} * inv as u, {_dot('d', 'q')} * inv as w, {_dot('e2', 'q')} * inv as t from h2),
  h as (select l.mesh_id, l.component, l.ray_no, x.t from lines l left join (select * from h3 where u >= 0 and w >= 0 and u + w <= 1 and t <> 0) x on x.mesh_id = l.mesh_id and x.component = l.component and x.ray_no = l.ray_no)"""
_NEAREST = "nearest as (select mesh_id, component, ray_no, min(t) filter (t > 0) as front, min(-t) filter (t < 0) as back from h group by 1, 2, 3)"
_TALLY = f"""tally as (select mesh_id, component, count(*) filter (front is null) as front_escapes, count(*) filter (back is null) as back_escapes,
    coalesce(sum({_q('front')}), 0)::bigint as front_distance, coalesce(sum({_q('back')}), 0)::bigint as back_distance from nearest group by 1, 2)"""
_VOTE = "votes as (select mesh_id, component, front_escapes < back_escapes or (front_escapes = back_escapes and front_distance < back_distance) as vote from tally)"
_FACET_CHAIN = ",\n  ".join((BOXES, _tri(), _allot(FACETS), _starts(FACETS), _lines(FACETS), _HITS))
_PAIRS = """inc as (select mesh_id, face_id, u, v from (select mesh_id, face_id, a as u, b as v from f union all select mesh_id, face_id, b, c from f union all select mesh_id, face_id, c, a from f) where u <> v),
  pairs as (select distinct mesh_id, f1, f2 from (select mesh_id, least(u, v) as lo, greatest(u, v) as hi, count(*) as n, min(face_id) as f1, max(face_id) as f2 from inc group by 1, 2, 3) where n = 2 and f1 <> f2)"""
_AGAINST = _PAIRS + """,
  against as (select mesh_id, f1, f2, exists (select 1 from inc i join inc j on i.mesh_id = j.mesh_id and i.u = j.u and i.v = j.v where i.mesh_id = pairs.mesh_id and i.face_id = f1 and j.face_id = f2) as against from pairs)"""
_COMPONENTS = _AGAINST + """,
  links as (select mesh_id, f1 as p, f2 as q, against::int as w from against union all select mesh_id, f2, f1, against::int from against),
  walk as (select mesh_id, face_id as root, face_id as face, 0 as turn from f union select k.mesh_id, k.root, l.q, k.turn # l.w from walk k join links l on l.mesh_id = k.mesh_id and l.p = k.face),
  best as (select mesh_id, face as face_id, min(root) as root, arg_min(turn, root * 2 + turn) as turn from walk group by 1, 2),
  comp as (select mesh_id, face_id, turn, dense_rank() over (partition by mesh_id order by root) - 1 as component from best),
  wound as (select f.mesh_id, f.face_id, case when turn = 1 then f.c else f.a end as a, f.b, case when turn = 1 then f.a else f.c end as c, component, turn from f join comp using (mesh_id, face_id))""".replace("k.turn # l.w", "xor(k.turn, l.w)")
_WHOLE_CHAIN = ",\n  ".join((FIELDS, _COMPONENTS, _tri("wound", "f.component"), _allot(WHOLE), _starts(WHOLE)))


def query(name: str, sql: str | None, recursive: bool = False):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            # corner b's y is a word of SQL
            text = re.sub(r"(?<!group )(?<!order )(?<!partition )\bby\b", '"by"', sql)
            ORACLES[name] = text if text.startswith("select") else ("with recursive " if recursive else "with ") + text
        return f

    return add


# --- sources and sinks -------------------------------------------------------------------------------------

@query("s1_read_off", BOXES + " select mesh_id, vertex_id, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from v")
def s1(spark, sf_dir):
    return sources.parse_off(sources.format_off(*boxes(spark, sf_dir)))[0]


@query("s1_read_off_faces", BOXES + ", n as (select *, row_number() over (partition by mesh_id order by face_id) - 1 as i from f) select mesh_id, i as face_id, a, b, c from n")
def s1_faces(spark, sf_dir):
    return sources.parse_off(sources.format_off(*boxes(spark, sf_dir)))[1]


@query("s2_corpus_scan", FIELDS + " select v.mesh_id, count(distinct vertex_id) as vertices, any_value(n) as faces from v join (select mesh_id, count(*) as n from f group by 1) g on g.mesh_id = v.mesh_id group by 1")
def s2(spark, sf_dir):
    """Height fields written as OFF files, a file a mesh, and the folder scanned."""
    path = f"{shared_folder(spark)}/off-{uuid.uuid4().hex}"
    sources.write_off(*fields(spark, sf_dir), path)
    v, f = sources.read_written(spark, path)
    return v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices")).join(f.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("faces")), "mesh_id")


@query("s3_bad_corners", BOXES + ", w as (select * from v where not (vertex_id = 7 and length(mesh_id) % 2 = 0)) select f.mesh_id, face_id, corner from (select mesh_id, face_id, unnest([a, b, c]) as corner from f) f where not exists (select 1 from w where w.mesh_id = f.mesh_id and w.vertex_id = f.corner)")
def s3(spark, sf_dir):
    v, f = boxes(spark, sf_dir)
    return bad_corners(v.where("not (vertex_id = 7 and length(mesh_id) % 2 = 0)"), f)


_RESULTS = f"""r as (select s_name as mass, (s_suppkey * 37 % 1009)::int as triangles, m as method, round({_u('m', 's_suppkey::varchar')}, 4) as backfacingness from supplier, (values ('published'), ('facets'), ('whole')) t(m)),
  wide as (select mass, max(triangles) as triangles, max(backfacingness) filter (method = 'published') as published, max(backfacingness) filter (method = 'facets') as facets, max(backfacingness) filter (method = 'whole') as whole from r group by 1)"""
_METHODS = ["published", "facets", "whole"]


@query("s4_results_by_method", _RESULTS + " select * from wide")
def s4(spark, sf_dir):
    return evaluate.by_method(results(spark, sf_dir), _METHODS)


@query("s6_box_filter_distinct", "select c_name as name, min(c_custkey) as first_key from customer where c_acctbal between 0 and 5000 and c_nationkey between 3 and 12 group by 1")
def s6(spark, sf_dir):
    return _table(spark, sf_dir, "customer").where("c_acctbal between 0 and 5000 and c_nationkey between 3 and 12").groupBy(F.col("c_name").alias("name")).agg(F.min("c_custkey").alias("first_key"))


@query("k1_write_off", BOXES + r""", vl as (select mesh_id, count(*) as nv, string_agg(printf('%.3f %.3f %.3f', x, y, z), chr(10) order by vertex_id) as t from v group by 1),
  fl as (select mesh_id, count(*) as nf, string_agg(printf('3 %d %d %d', a::bigint, b::bigint, c::bigint), chr(10) order by face_id) as t from f group by 1)
  select vl.mesh_id, md5('OFF' || chr(10) || nv || ' ' || nf || ' 0' || chr(10) || vl.t || chr(10) || fl.t || chr(10)) as digest from vl join fl using (mesh_id)""")
def k1(spark, sf_dir):
    return sources.format_off(*boxes(spark, sf_dir)).select("mesh_id", F.md5("text").alias("digest"))


@query("k2_results_csv", _RESULTS + " select mass, triangles, method, printf('%.4f', backfacingness) as backfacingness, case when triangles % 2 = 0 then printf('%.3f', triangles / 7.0) end as seconds, null::varchar as cpu_seconds from r")
def k2(spark, sf_dir):
    r = results(spark, sf_dir).withColumn("seconds", F.when(F.col("triangles") % 2 == 0, F.col("triangles") / 7.0)).withColumn("cpu_seconds", F.lit(None).cast("double"))
    return sources.format_results(r)


# --- projections and predicates ----------------------------------------------------------------------------

@query("p1_gather", f"{BOXES},\n  {_tri()} select mesh_id, face_id, " + ", ".join(f"{k}{x}" for k in CORNERS for x in "xyz") + " from tri")
def p1(spark, sf_dir):
    return prep.gather(*boxes(spark, sf_dir)).drop(*CORNERS)


@query("p3_normals", f"{BOXES},\n  {_tri()} select mesh_id, face_id, {_q('nx')} as nx, {_q('ny')} as ny, {_q('nz')} as nz, {_q('dbl_area')} as dbl_area from tri")
def p3(spark, sf_dir):
    return triangles(spark, sf_dir).select("mesh_id", "face_id", *(quantised(F.col(k)).alias(k) for k in ("nx", "ny", "nz", "dbl_area")))


@query("p5_apply_flips", BOXES + " select mesh_id, face_id, case when face_id % 3 = 0 then c else a end as a, b, case when face_id % 3 = 0 then a else c end as c from f")
def p5(spark, sf_dir):
    _, f = boxes(spark, sf_dir)
    return prep.apply_flips(f, f.select("mesh_id", "face_id", (F.col("face_id") % 3 == 0).alias("flip")))


@query("p6_turned", BOXES + " select mesh_id, face_id, (f.a <> f0.a or f.b <> f0.b or f.c <> f0.c) as turned from f join f0 using (mesh_id, face_id)")
def p6(spark, sf_dir):
    _, f = boxes(spark, sf_dir)
    # the box as it was before some of its faces were reversed: reversed again where the same number says so
    return prep.turned(_reversed(f, 0.5), f)


@query("p9_screen", f"{BOXES},\n  {_tri()}, " + """b as (select mesh_id, least(min(ax), min(bx), min(cx)) as lx, greatest(max(ax), max(bx), max(cx)) as hx, least(min(ay), min(by), min(cy)) as ly, greatest(max(ay), max(by), max(cy)) as hy, least(min(az), min(bz), min(cz)) as lz, greatest(max(az), max(bz), max(cz)) as hz from tri group by 1),
  s as (select mesh_id, face_id, view, (bu - au) * (cv - av) - (bv - av) * (cu - au) as area from (select mesh_id, face_id, view,
    case view when 0 then -az when 1 then az when 2 then ax when 3 then az when 4 then -az else -ax end as au, case view when 0 then ay when 1 then ax when 2 then ay when 3 then ay when 4 then ax else ay end as av,
    case view when 0 then -bz when 1 then bz when 2 then bx when 3 then bz when 4 then -bz else -bx end as bu, case view when 0 then by when 1 then bx when 2 then by when 3 then by when 4 then bx else by end as bv,
    case view when 0 then -cz when 1 then cz when 2 then cx when 3 then cz when 4 then -cz else -cx end as cu, case view when 0 then cy when 1 then cx when 2 then cy when 3 then cy when 4 then cx else cy end as cv
    from tri, (select unnest(range(6)) as view))) select mesh_id, face_id, view::int as view, case when area > 0 then 1 else 2 end as shows from s where abs(area) > 1e-9""")
def p9(spark, sf_dir):
    # facing colour by the sign of the area on screen, edge-on faces left out
    screen = raster.screen_triangles(prep.gather(*boxes(spark, sf_dir)), 32)
    return screen.where(F.abs("area") > 1e-9).select("mesh_id", "face_id", "view", "shows")


@query("p12_to_origin", FIELDS + " select mesh_id, vertex_id, " + ", ".join(f"round({x} - min({x}) over (partition by mesh_id), 3) as {x}" for x in "xyz") + " from v")
def p12(spark, sf_dir):
    return prep.to_origin(fields(spark, sf_dir)[0])


# --- joins -------------------------------------------------------------------------------------------------

@query("j1_edge_pairs", f"{FIELDS},\n  {_PAIRS} select mesh_id, f1, f2 from pairs")
def j1(spark, sf_dir):
    return prep.edge_pairs(fields(spark, sf_dir)[1])


@query("j2_wound_against", f"{FIELDS},\n  {_AGAINST} select * from against")
def j2(spark, sf_dir):
    _, f = fields(spark, sf_dir)
    return prep.wound_against(f, prep.edge_pairs(f))


@query("j3_nearest_hit", f"{_FACET_CHAIN},\n  {_NEAREST} select mesh_id, component, ray_no, {_q('front').replace('1e6', '1e3')} as front, {_q('back').replace('1e6', '1e3')} as back from nearest")
def j3(spark, sf_dir):
    tri, lines = box_lines(spark, sf_dir)
    return casting.nearest_hits(lines, tri).select("mesh_id", "component", F.col("ray_no").cast("bigint").alias("ray_no"), quantised(F.col("front"), 3).alias("front"), quantised(F.col("back"), 3).alias("back"))


_CROSSED = f"""{_FACET_CHAIN},
  sides as (select mesh_id, component, ray_no, list_sort(coalesce(list(t) filter (t > 0), [])) as fr, list_sort(coalesce(list(-t) filter (t < 0), [])) as bk from h group by 1, 2, 3),
  crossed as (select mesh_id, component, ray_no, list_reduce(list_prepend({{'n': 0, 's': 0.0::double}}, list_transform(fr, lambda t: {{'n': 1, 's': t}})), lambda p, q: case when q.s >= p.s then {{'n': p.n + 1, 's': q.s + 1e-5 * (1.0 + q.s)}} else p end).n as front,
    list_reduce(list_prepend({{'n': 0, 's': 0.0::double}}, list_transform(bk, lambda t: {{'n': 1, 's': t}})), lambda p, q: case when q.s >= p.s then {{'n': p.n + 1, 's': q.s + 1e-5 * (1.0 + q.s)}} else p end).n as back from sides)"""


@query("j4_crossings", _CROSSED + " select mesh_id, component, ray_no, front::int as front, back::int as back from crossed")
def j4(spark, sf_dir):
    tri, lines = box_lines(spark, sf_dir)
    return casting.crossings(lines, tri).withColumn("ray_no", F.col("ray_no").cast("bigint"))


@query("j5_not_chosen", _RESULTS + ", top as (select mass from wide order by triangles desc, mass limit 10) select mass, triangles from wide where mass not in (select mass from top)")
def j5(spark, sf_dir):
    wide = evaluate.by_method(results(spark, sf_dir), _METHODS)
    return wide.join(wide.orderBy(F.desc("triangles"), "mass").limit(10).select("mass"), "mass", "left_anti").select("mass", "triangles")


@query("j6_before_after", _RESULTS + " select mass, cast(round((published - facets) * 10000) as bigint) as change from wide")
def j6(spark, sf_dir):
    return evaluate.by_method(results(spark, sf_dir), _METHODS).select("mass", F.round((F.col("published") - F.col("facets")) * 10000).cast("bigint").alias("change"))


# --- aggregations ------------------------------------------------------------------------------------------

@query("a1_component_area", f"{BOXES},\n  {_tri()},\n  {_allot(FACETS)} select mesh_id, component, area, faces from ca")
def a1(spark, sf_dir):
    return rays.component_areas(triangles(spark, sf_dir))


@query("a2_mesh_area", f"{BOXES},\n  {_tri()},\n  {_allot(FACETS)} select mesh_id, sum(area)::bigint as area from ca group by 1")
def a2(spark, sf_dir):
    return rays.component_areas(triangles(spark, sf_dir)).groupBy("mesh_id").agg(F.sum("area").alias("area"))


@query("a3_ray_allotment", f"{BOXES},\n  {_tri()},\n  {_allot(FACETS)} select mesh_id, component, area, rays from allot")
def a3(spark, sf_dir):
    return rays.allot(triangles(spark, sf_dir), FACETS)


@query("a4_escape_tally", f"{_FACET_CHAIN},\n  {_NEAREST},\n  {_TALLY} select mesh_id, component, front_escapes, back_escapes from tally")
def a4(spark, sf_dir):
    tri, lines = box_lines(spark, sf_dir)
    return casting.tally(casting.nearest_hits(lines, tri)).drop("front_distance", "back_distance")


@query("a5_escape_vote", f"{_FACET_CHAIN},\n  {_NEAREST},\n  {_TALLY},\n  {_VOTE} select * from votes")
def a5(spark, sf_dir):
    tri, lines = box_lines(spark, sf_dir)
    return voting.escape_votes(casting.tally(casting.nearest_hits(lines, tri)))


@query("a6_parity_vote", _CROSSED + " select mesh_id, component, sum(front % 2) > sum(back % 2) as vote from crossed group by 1, 2")
def a6(spark, sf_dir):
    tri, lines = box_lines(spark, sf_dir)
    return voting.parity_votes(casting.tally_odd(casting.crossings(lines, tri)))


_FLIPS = "select f.mesh_id, f.face_id, coalesce(vote, false) as flip, f.face_id as component from f left join votes on votes.mesh_id = f.mesh_id and component = face_id"
_FACET_FLIPS = f"{_FACET_CHAIN},\n  {_NEAREST},\n  {_TALLY},\n  {_VOTE} {_FLIPS}"
_PARITY_FLIPS = f"{_CROSSED}, votes as (select mesh_id, component, sum(front % 2) > sum(back % 2) as vote from crossed group by 1, 2) {_FLIPS}"


@query("a7_flips", _FACET_FLIPS)
def a7(spark, sf_dir):
    v, f = boxes(spark, sf_dir)
    return plans.reorient_facets_raycast(v, f, check=False, rays_total=FACETS.rays_total, rays_minimum=FACETS.rays_minimum, strategy="sql")


@query("a8_bounding_box", f"{FIELDS},\n  {_tri()} select mesh_id, " + ", ".join(f"least(min(a{x}), min(b{x}), min(c{x})) as low_{x}, greatest(max(a{x}), max(b{x}), max(c{x})) as high_{x}" for x in "xyz") + " from tri group by 1")
def a8(spark, sf_dir):
    box = prep.bounding_boxes(prep.gather(*fields(spark, sf_dir)))
    return box.select("mesh_id", *(f"{k}_{x}" for x in "xyz" for k in ("low", "high")))


@query("a9_extent", f"{FIELDS},\n  {_tri()}, b as (select mesh_id, " + ", ".join(f"least(min(a{x}), min(b{x}), min(c{x})) as l{x}, greatest(max(a{x}), max(b{x}), max(c{x})) as h{x}" for x in "xyz") + f" from tri group by 1) select mesh_id, {_q('greatest(hx - lx, hy - ly, hz - lz) * 1.05 / 2.0')} as r, " + ", ".join(_q(f"(l{x} + h{x}) / 2.0") + f" as centre_{x}" for x in "xyz") + " from b")
def a9(spark, sf_dir):
    box = prep.bounding_boxes(prep.gather(*fields(spark, sf_dir)))
    return box.select("mesh_id", *(quantised(F.col(k)).alias(k) for k in ("r", "centre_x", "centre_y", "centre_z")))


_PIXELS = f"""{FIELDS},
  {_tri()},
  b as (select mesh_id, (lx + hx) / 2.0 as mx, (ly + hy) / 2.0 as my, (lz + hz) / 2.0 as mz, greatest(hx - lx, hy - ly, hz - lz) * 1.05 / 2.0 as r from (select mesh_id, {', '.join(f"least(min(a{x}), min(b{x}), min(c{x})) as l{x}, greatest(max(a{x}), max(b{x}), max(c{x})) as h{x}" for x in "xyz")} from tri group by 1)),
  views(view, ex, ey, ez, fx, fy, fz, sx, sy, sz, ux, uy, uz) as (values (0, 1, 0, 0, -1, 0, 0, 0, 0, -1, 0, 1, 0), (1, 0, 1, 0, 0, -1, 0, 0, 0, 1, 1, 0, 0), (2, 0, 0, 1, 0, 0, -1, 1, 0, 0, 0, 1, 0), (3, -1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0), (4, 0, -1, 0, 0, 1, 0, 0, 0, -1, 1, 0, 0), (5, 0, 0, -1, 0, 0, 1, -1, 0, 0, 0, 1, 0)),
  sc as (select t.mesh_id, face_id, view, r, {', '.join(f"(({s}x * ({k}x - (mx + ex * (2.0 * r))) + {s}y * ({k}y - (my + ey * (2.0 * r))) + {s}z * ({k}z - (mz + ez * (2.0 * r)))) / r + 1.0) / 2.0 * 16 as {k}p{p}" for k in CORNERS for s, p in (("s", "x"), ("u", "y")))}, {', '.join(f"fx * ({k}x - (mx + ex * (2.0 * r))) + fy * ({k}y - (my + ey * (2.0 * r))) + fz * ({k}z - (mz + ez * (2.0 * r))) as {k}pz" for k in CORNERS)} from tri t join b on b.mesh_id = t.mesh_id, views where r > 0),
  sa as (select *, (bpx - apx) * (cpy - apy) - (bpy - apy) * (cpx - apx) as area from sc),
  px as (select *, unnest(range(greatest(floor(least(apx, bpx, cpx)), 0)::int, least(ceil(greatest(apx, bpx, cpx)), 16)::int)) as px from sa where area <> 0),
  pp as (select *, unnest(range(greatest(floor(least(apy, bpy, cpy)), 0)::int, least(ceil(greatest(apy, bpy, cpy)), 16)::int)) as py from px),
  fr as (select *, ((bpx - (px + 0.5)) * (cpy - (py + 0.5)) - (bpy - (py + 0.5)) * (cpx - (px + 0.5))) / area as wa, ((cpx - (px + 0.5)) * (apy - (py + 0.5)) - (cpy - (py + 0.5)) * (apx - (px + 0.5))) / area as wb from pp),
  fz as (select *, 1.0 - wa - wb as wc, wa * apz + wb * bpz + (1.0 - wa - wb) * cpz as z from fr),
  pixels as (select mesh_id, view::int as view, py::int as py, px::int as px, arg_min(case when area > 0 then 1 else 2 end, {{'z': z, 'f': face_id}})::int as shows from fz where wa >= 0 and wb >= 0 and wc >= 0 and z >= r and z <= 3.0 * r group by 1, 2, 3, 4)"""


@query("a10_depth_test", _PIXELS + " select * from pixels")
def a10(spark, sf_dir):
    return plans.draw_backfacing_views(*fields(spark, sf_dir), resolution=16)


@query("a11_backfacingness", _PIXELS + ", s as (select mesh_id, count(*) filter (shows = 2) as backs, count(*) as drawn from pixels group by 1) select mesh_id, cast(floor(coalesce(backs / drawn, 0) * 1e6 + 0.5) as bigint) as score from (select distinct mesh_id from v) left join s using (mesh_id)")
def a11(spark, sf_dir):
    return plans.measure_backfacingness(*fields(spark, sf_dir), resolution=16).select("mesh_id", quantised(F.col("backfacingness")).alias("score"))


@query("a12_method_summary", _RESULTS + f" select method, {_q('avg(backfacingness)')} as mean, {_q('stddev_pop(backfacingness)')} as deviation, count(*) as masses from r group by 1")
def a12(spark, sf_dir):
    return evaluate.summary(results(spark, sf_dir)).select("method", quantised(F.col("mean")).alias("mean"), quantised(F.col("deviation")).alias("deviation"), "masses")


@query("a13_ray_budget", f"select l_linenumber as rays, min(l_extendedprice) as seconds, {_q('avg(l_discount)')} as backfacingness from lineitem group by 1")
def a13(spark, sf_dir):
    runs = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("rays"), F.col("l_discount").alias("backfacingness"), F.col("l_extendedprice").alias("seconds"))
    return evaluate.ray_budget(runs).withColumn("backfacingness", quantised(F.col("backfacingness")))


@query("a14_dedupe_faces", BOXES + " select mesh_id, row_number() over (partition by mesh_id order by face_id) - 1 as face_id, a, b, c from f")
def a14(spark, sf_dir):
    return prep.dedupe_faces(doubled(boxes(spark, sf_dir)[1]))


_WELD = FIELDS + ", g as (select mesh_id, vertex_id, round_even(x / 3, 0) as x, round_even(y / 3, 0) as y, round_even(z / 10, 0) as z from v), n as (select *, dense_rank() over (partition by mesh_id order by x, y, z) - 1 as new_id from g)"


def _coarse(spark, sf_dir):
    v, f = fields(spark, sf_dir)
    return v.select("mesh_id", "vertex_id", (F.col("x") / 3).alias("x"), (F.col("y") / 3).alias("y"), (F.col("z") / 10).alias("z")), f


@query("a15_weld_vertices", _WELD + " select distinct mesh_id, new_id as vertex_id, x, y, z from n")
def a15(spark, sf_dir):
    return prep.weld(*_coarse(spark, sf_dir), places=0)[0]


@query("a15_weld_faces", _WELD + " select f.mesh_id, f.face_id, p.new_id as a, q.new_id as b, r.new_id as c from f join n p on p.mesh_id = f.mesh_id and p.vertex_id = f.a join n q on q.mesh_id = f.mesh_id and q.vertex_id = f.b join n r on r.mesh_id = f.mesh_id and r.vertex_id = f.c")
def a15_faces(spark, sf_dir):
    return prep.weld(*_coarse(spark, sf_dir), places=0)[1]


@query("a16_newell_normal", FIELDS + f""", p as (select mesh_id, vertex_id, x, y, z, coalesce(lead(x) over w, first(x) over w2) as nx, coalesce(lead(y) over w, first(y) over w2) as ny, coalesce(lead(z) over w, first(z) over w2) as nz from v
    window w as (partition by mesh_id order by vertex_id), w2 as (partition by mesh_id order by vertex_id rows between unbounded preceding and unbounded following))
  select mesh_id as polygon_id, {_q('sum((y - ny) * (z + nz))')} as nx, {_q('sum((z - nz) * (x + nx))')} as ny, {_q('sum((x - nx) * (y + ny))')} as nz from p group by 1""")
def a16(spark, sf_dir):
    rings = fields(spark, sf_dir)[0].select(F.col("mesh_id").alias("polygon_id"), F.lit(0).alias("ring"), F.col("vertex_id").alias("i"), "x", "y", "z")
    return prep.polygon_normals(rings).select("polygon_id", *(quantised(F.col(k)).alias(k) for k in ("nx", "ny", "nz")))


# --- graph, windows, top-k ---------------------------------------------------------------------------------

@query("g1_components", f"{FIELDS},\n  {_COMPONENTS} select mesh_id, face_id, a, b, c, component from wound", recursive=True)
def g1(spark, sf_dir):
    return components.orient_components(fields(spark, sf_dir)[1])


@query("g1_components_by_rounds", f"{FIELDS},\n  {_COMPONENTS} select mesh_id, face_id, a, b, c, component from wound", recursive=True)
def g1_rounds(spark, sf_dir):
    return components.propagate_components(fields(spark, sf_dir)[1])


@query("a17_component_count", f"{FIELDS},\n  {_COMPONENTS} select mesh_id, max(component) + 1 as components from wound group by 1", recursive=True)
def a17(spark, sf_dir):
    return components.orient_components(fields(spark, sf_dir)[1]).groupBy("mesh_id").agg((F.max("component") + 1).alias("components"))


@query("w1_running_area", f"{_WHOLE_CHAIN} select mesh_id, component, face_id, hi as reach from reach", recursive=True)
def w1(spark, sf_dir):
    return rays.running_areas(whole_field(spark, sf_dir))


@query("w2_weighted_pick", f"{_WHOLE_CHAIN} select mesh_id, component, ray_no, face_id from starts", recursive=True)
def w2(spark, sf_dir):
    tri = whole_field(spark, sf_dir)
    return rays.starts(tri, rays.allot(tri, WHOLE), WHOLE).select("mesh_id", "component", F.col("ray_no").cast("bigint").alias("ray_no"), "face_id")


_WHOLE_VOTE = ",\n  ".join((_WHOLE_CHAIN, _lines(WHOLE), _HITS, _NEAREST, _TALLY, _VOTE))


@query("w3_component_flips", f"{_WHOLE_VOTE} select wound.mesh_id, wound.face_id, coalesce(vote, false) <> (turn = 1) as flip, wound.component from wound left join votes on votes.mesh_id = wound.mesh_id and votes.component = wound.component", recursive=True)
def w3(spark, sf_dir):
    v, f = fields(spark, sf_dir)
    return plans.reorient_facets_raycast(v, f, check=False, rays_total=WHOLE.rays_total, rays_minimum=WHOLE.rays_minimum, facet_wise=False, strategy="sql")


@query("t1_largest_mixed", _RESULTS + " select mass, triangles from wide where published between 0.4 and 0.6 order by triangles desc, mass limit 1")
def t1(spark, sf_dir):
    return evaluate.largest_mixed(evaluate.by_method(results(spark, sf_dir), _METHODS), "published").select("mass", "triangles")


@query("t2_most_improved", _RESULTS + " select mass, published, facets from wide order by facets - published, mass limit 3")
def t2(spark, sf_dir):
    return evaluate.most_improved(evaluate.by_method(results(spark, sf_dir), _METHODS), "published", "facets").select("mass", "published", "facets")


@query("t3_worst_remaining", _RESULTS + " select mass, facets from wide order by facets desc, mass limit 3")
def t3(spark, sf_dir):
    return evaluate.worst(evaluate.by_method(results(spark, sf_dir), _METHODS), "facets").select("mass", "facets")


@query("t4_widest_apart", _RESULTS + " select arg_max(mass, {'d': facets - whole, 'm': mass}) as highest, arg_min(mass, {'d': facets - whole, 'm': mass}) as lowest from wide")
def t4(spark, sf_dir):
    return evaluate.widest_apart(evaluate.by_method(results(spark, sf_dir), _METHODS), "facets", "whole")


@query("t5_largest", _RESULTS + " select mass, triangles from wide order by triangles desc, mass limit 1")
def t5(spark, sf_dir):
    return evaluate.worst(evaluate.by_method(results(spark, sf_dir), _METHODS), "triangles", 1).select("mass", "triangles")


@query("t6_by_score", _RESULTS + " select mass, published, row_number() over (order by published, mass) as place from wide")
def t6(spark, sf_dir):
    return evaluate.placed(evaluate.by_method(results(spark, sf_dir), _METHODS).select("mass", "published"), "published", "mass")


@query("t7_corpus_selection", _RESULTS + """, large as (select mass from wide order by triangles desc, mass limit 10), mixed as (select mass from wide where mass not in (select mass from large) and triangles >= 300 order by least(published, 1 - published) desc, mass limit 50)
  select mass, 'largest' as reason from large union all select mass, 'mixed' from mixed""")
def t7(spark, sf_dir):
    wide = evaluate.by_method(results(spark, sf_dir), _METHODS)
    return evaluate.select_corpus(wide.select("mass", "triangles", F.col("published").alias("backfacingness")))


@query("u1_union_methods", _RESULTS + " select mass, method, triangles from r where method = 'published' union all select mass, method, triangles from r where method <> 'published'")
def u1(spark, sf_dir):
    r = results(spark, sf_dir).select("mass", "method", "triangles")
    return r.where("method = 'published'").unionByName(r.where("method <> 'published'"))


@query("x1_arrow_flips", _FACET_FLIPS)
def x1(spark, sf_dir):
    """The Arrow way on all boxes, open ones too, held against the SQL that casts the same rays."""
    v, f = boxes(spark, sf_dir)
    return plans.reorient_facets_raycast(v, f, check=False, rays_total=FACETS.rays_total, rays_minimum=FACETS.rays_minimum, strategy="arrow")


@query("x2_arrow_flips_all", None)
def x2(spark, sf_dir):
    """The Arrow way on all boxes with five times the rays; a test casts some by brute force."""
    v, f = boxes(spark, sf_dir)
    return plans.reorient_facets_raycast(v, f, check=False, rays_total=600, strategy="arrow").drop("component")


@query("x3_default_flips", None)
def x3(spark, sf_dir):
    """All boxes with the default settings, a hundred rays a face; a test casts some by brute force."""
    return plans.reorient_facets_raycast(*boxes(spark, sf_dir)).drop("component")


@query("x4_arrow_parity", _PARITY_FLIPS)
def x4(spark, sf_dir):
    """The Arrow way with votes by crossings, all boxes, held against the SQL that casts the same rays."""
    v, f = boxes(spark, sf_dir)
    return plans.reorient_facets_raycast(v, f, check=False, rays_total=FACETS.rays_total, rays_minimum=FACETS.rays_minimum, use_parity=True, strategy="arrow")


@query("x5_default_backfacingness", None)
def x5(spark, sf_dir):
    """The score of every height field at the default resolution; a test holds the score against brute force."""
    return plans.measure_backfacingness(*fields(spark, sf_dir))


# --- odd faces, comparators, the whole evaluation -----------------------------------------------------------

#: Height fields with, beside some faces, one that has two equal corners and one more on an edge of theirs.
ODD = FIELDS.replace("f as (", "f1 as (") + """,
  f as (select * from f1 union all select mesh_id, face_id + 100000, a, a, b from f1 where face_id % 10 = 0 union all select mesh_id, face_id + 200000, b, a, (a + b) % 64 from f1 where face_id % 7 = 0)"""


def odd_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, f = fields(spark, sf_dir)
    same = f.where("face_id % 10 = 0").select("mesh_id", (F.col("face_id") + 100000).alias("face_id"), "a", F.col("a").alias("b"), F.col("b").alias("c"))
    third = f.where("face_id % 7 = 0").select("mesh_id", (F.col("face_id") + 200000).alias("face_id"), F.col("b").alias("a"), F.col("a").alias("b"), ((F.col("a") + F.col("b")) % 64).alias("c"))
    corners = v.select("mesh_id", F.col("vertex_id").alias("c"))
    return v, f.unionByName(same).unionByName(third.join(corners, ["mesh_id", "c"], "left_semi").select(*f.columns))


@query("g2_g3_edge_rules", f"{ODD.replace('where face_id % 7 = 0', 'where face_id % 7 = 0 and (mesh_id, (a + b) % 64) in (select mesh_id, vertex_id from v)')},\n  {_PAIRS} select mesh_id, f1, f2 from pairs")
def g2_g3(spark, sf_dir):
    return prep.edge_pairs(odd_fields(spark, sf_dir)[1])


@query("p7_zero_area", f"{ODD.replace('where face_id % 7 = 0', 'where face_id % 7 = 0 and (mesh_id, (a + b) % 64) in (select mesh_id, vertex_id from v)')},\n  {_tri()},\n  {_allot(FACETS)} select mesh_id, component, rays from allot where area = 0")
def p7(spark, sf_dir):
    tri = triangles(spark, sf_dir, odd_fields)
    return rays.allot(tri, FACETS).where("area = 0").select("mesh_id", "component", "rays")


@query("r14_signed_volume", f"{BOXES},\n  {_tri()}, x as (select *, {_cross('b', 'c', 'x')} from tri) select mesh_id, 0 as component, sum({_q(_dot('a', 'x'))}) < 0 as vote from x group by 1")
def r14(spark, sf_dir):
    return voting.volume_votes(triangles(spark, sf_dir).withColumn("component", F.lit(0)))


@query("j9_evaluate_corpus", None)
def j9(spark, sf_dir):
    """Every method on every height field; the SQL of its parts is in a10, a11, a7 and w3, a test holds the whole against them."""
    methods = {"components": {"facet_wise": False, "rays_total": 60}, "facet-wise": {"rays_total": 120, "rays_minimum": 4}}
    return plans.evaluate_corpus(*fields(spark, sf_dir), resolution=16, methods=methods)
