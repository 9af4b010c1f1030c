"""Registered queries about objects, geometry, tiles and surfaces; see ``catalogue``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .catalogue import IMAGE, RASTER, VOLUME, _line, _smooth, query, r6, with_
from .functions.scalar import LATTICE, MIXERS, SHIFTS, compressed_morton, lattice_noise, morton
from .geometry import resample as geo
from .geometry.transforms import Affine, ByDimension, Field, InverseField, Sequence, Swirl, Swirls
from .grid import Grid
from .meta import ArrayMeta, Box
from .operators import aggregate, axes, meshes, overlap, pointwise, registration, segment, stencil, stitching, tracking
from .sources import synthetic, tables
from .storage import stored


def _image(s, d):
    return tables.embedding_image(s, d)


def _mask(s, d, low=0.15):
    return pointwise.threshold(_image(s, d), low)


# components and spots

_CELLS = "msk as (select y, x, y * 64 + x as n from img where v >= 0.15)"


def _labels_sql(steps: str, where: str = "true", least: int = 0) -> str:
    kept = f"when count(*) over (partition by l.l) < {least} then 0" if least else ""
    return (
        f"""with recursive {IMAGE}, {_CELLS},
 e as materialized (select a.n as a, b.n as b from msk a join (values {steps}) o(dy, dx) on true join msk b on b.y = a.y + o.dy and b.x = a.x + o.dx where {where}),
 r(n, m) using key (n) as (select n, n from msk union (select e.a, min(r.m) from r join e on e.b = r.n join recurring.r c on c.n = e.a group by e.a, c.m having min(r.m) < c.m))"""
        + f"select i.y, i.x, (case when l.n is null then 0 {kept} else l.l end)::bigint as v from img i left join (select n, m + 1 as l from r) l on l.n = i.y * 64 + i.x"
    )


_STEPS4 = "(0, 1), (1, 0), (0, -1), (-1, 0)"
_STEPS8 = _STEPS4 + ", (1, 1), (-1, -1), (1, -1), (-1, 1)"
query("label_global", _labels_sql(_STEPS4))(lambda s, d: segment.label(_mask(s, d)))
query("label_diagonal", _labels_sql(_STEPS8))(lambda s, d: segment.label(_mask(s, d), connectivity=2))
query("label_chunk", _labels_sql(_STEPS4, "a.y // 128 = b.y // 128 and a.x // 64 = b.x // 64"))(lambda s, d: segment.label_in_chunks(_mask(s, d)))
query("label_min_size", _labels_sql(_STEPS4, least=4))(lambda s, d: segment.label(_mask(s, d), min_size=4))


def _axis3(source, axis, w, name):
    n = {"z": "7", "y": "100", "x": "84"}[axis]
    return _line(source, axis, n, w, [a for a in "zyx" if a != axis], name)


def _pair3(sig, tag):
    parts, at = [], "vol"
    for a, s in zip("zyx", sig, strict=True):
        parts.append(_axis3(at, a, _smooth(s, 4.0), f"{tag}{a}"))
        at = f"{tag}{a}"
    return parts


_SPOT_ID = "(xor(xor(z * 73856093, y * 19349663), x * 83492791) % 4294967294 + 4294967294) % 4294967294 + 1"
query(
    "spots",
    with_(
        VOLUME,
        *_pair3((0.6, 1.0, 1.0), "n"),
        *_pair3((0.96, 1.6, 1.6), "w"),
        "d as (select z, y, x, n.v - w.v as v from nx n join wx w using (z, y, x))",
        "m1 as (select *, max(v) over (partition by y, x order by z rows between 2 preceding and 2 following) as m from d)",
        "m2 as (select z, y, x, v, max(m) over (partition by z, x order by y rows between 2 preceding and 2 following) as m from m1)",
        "m3 as (select z, y, x, v, max(m) over (partition by z, y order by x rows between 2 preceding and 2 following) as m from m2)",
        f"p as (select z, y, x, {_SPOT_ID} as id from m3 where v = m and v >= 20)",
        "b as (select p.z + dz as z, p.y + dy as y, p.x + dx as x, max(id) as id from p cross join (values (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz, dy, dx) group by all)",
    )
    + "select vol.z, vol.y, vol.x, coalesce(b.id, 0)::bigint as v from vol left join b using (z, y, x)",
)(lambda s, d: segment.spots(tables.shipping_volume(s, d), threshold=20))
query("interest_points")(lambda s, d: segment.interest_points(Grid(_image(s, d).df, _image(s, d).meta), 1.4, 0.01, -0.5, 0.5))
query(
    "measure_labels",
    with_(IMAGE, "l as (select y, x, (floor(abs(v) * 40) % 7)::bigint as v from img)")
    + f"select v as label, count(*) as voxels, {r6('count(*)', 'volume')}, {r6('avg(y)', 'mean_y')}, min(y) as lo_y, max(y) + 1 as hi_y, {r6('avg(x)', 'mean_x')}, min(x) as lo_x, max(x) + 1 as hi_x, max((y = 0 or x = 0 or x = 63 or y = (select max(vec_id) from embeddings))::int)::bigint as touches from l where v > 0 group by v",
)(lambda s, d: segment.measure(_image(s, d).map((F.floor(F.abs("v") * 40) % 7).cast("long"), "int64", "label")))

# blending


def _rechunked(s, d):
    g = _image(s, d)
    return Grid(g.df, replace(g.meta, chunk=(50, 16)))


_BLOCKS = f"""b as (select i.y, i.x, i.v, k.b as ky, l.b as kx, k.b * 50 as sy, least((select max(vec_id) + 1 from embeddings), k.b * 50 + 50) as ty, l.b * 16 as sx, l.b * 16 + 16 as tx
 from img i join range(0, 1000) k(b) on i.y >= k.b * 50 - 4 and i.y < k.b * 50 + 54 and k.b * 50 <= (select max(vec_id) from embeddings)
 join range(0, 4) l(b) on i.x >= l.b * 16 - 4 and i.x < l.b * 16 + 20)"""
_TENT = "greatest(0, least(1, 1 - greatest({s} - {c}, {c} - ({t} - 1), 0) / 5.0))"
_RAMP = "least({c} - greatest(0, {s} - 4) + 0.5, least({n}, {t} + 4) - {c} - 0.5) / ((least({n}, {t} + 4) - greatest(0, {s} - 4)) / 2.0)"
_NY = "(select max(vec_id) + 1 from embeddings)"
for _name, _w in {"overlap_tent": _TENT, "overlap_ramp": _RAMP}.items():
    _weight = _w.format(s="sy", t="ty", c="y", n=_NY) + " * " + _w.format(s="sx", t="tx", c="x", n="64")
    query(_name, with_(IMAGE, _BLOCKS, f"w as (select y, x, v + ky * 0.1 + kx as v, {_weight} as w from b)") + f"select y, x, {r6('sum(v * w) / sum(w)')} from w group by y, x")(
        lambda s, d, k=_name.split("_")[1]: overlap.blend(_rechunked(s, d), 4, k, lambda b: b.withColumn("v", F.col("v") + F.col("b_y") * 0.1 + F.col("b_x")))
    )


def _median3(block):
    import numpy as np

    wide = np.pad(block, 1, mode="edge")
    return np.median([wide[dy : dy + block.shape[0], dx : dx + block.shape[1]] for dy in range(3) for dx in range(3)], axis=0)


query(
    "custom_op",
    with_(IMAGE, "o as (select a.k as dy, b.k as dx from range(-1, 2) a(k), range(-1, 2) b(k))") + f"select a.y, a.x, {r6('median(b.v)')} from img a cross join o join img b on b.y = greatest(0, least({_NY} - 1, a.y + o.dy)) and b.x = greatest(0, least(63, a.x + o.dx)) group by a.y, a.x",
)(lambda s, d: overlap.in_blocks(_rechunked(s, d), _median3, 1))

# geometry: the SQL interpolates in closed form

_CORNERS = """from pts p join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b) on true
 join img i on i.y = greatest(0, least({n} - 1, floor(p.py) + k.a)) and i.x = greatest(0, least(63, floor(p.px) + k.b))
 where p.py >= -0.5 and p.py < {n} - 0.5 and p.px >= -0.5 and p.px < 63.5"""
_LINEAR = "(case when k.a = 1 then p.py - floor(p.py) else 1 - (p.py - floor(p.py)) end) * (case when k.b = 1 then p.px - floor(p.px) else 1 - (p.px - floor(p.px)) end)"


def _resampled(points: str) -> str:
    """Corners first, with whole numbers as keys, so that they meet the image by an equi-join."""
    return (
        with_(
            IMAGE,
            f"pts as materialized ({points})",
            f"""crn as materialized (select p.y, p.x, greatest(0, least({_NY} - 1, floor(p.py) + k.a))::bigint as iy, greatest(0, least(63, floor(p.px) + k.b))::bigint as ix, {_LINEAR} as w
 from pts p, (values (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b) where p.py >= -0.5 and p.py < {_NY} - 0.5 and p.px >= -0.5 and p.px < 63.5)""",
            "s as materialized (select crn.y, crn.x, sum(i.v * crn.w) as v from crn join img i on i.y = crn.iy and i.x = crn.ix group by crn.y, crn.x)",
        )
        + f"select pts.y, pts.x, {r6('coalesce(s.v, 0)')} from pts left join s using (y, x)"
    )


def _warped(s, d, transform, **more):
    image = _image(s, d)
    return geo.resample(image, _target(image), transform, **more)


_TURN = Affine.of([[0.96, 0.28], [-0.28, 0.96]], [3.0, -2.0])


def _target(image: Grid) -> ArrayMeta:
    """As many lines as the source has."""
    return ArrayMeta(("y", "x"), image.meta.shape, "float64", (64, 64))


_LINES = f"range(0, {_NY}) a(y), range(0, 64) b(x)"
_AT = "select y, x, 0.96 * (y + 0.5) + 0.28 * (x + 0.5) + 3.0 - 0.5 as py, -0.28 * (y + 0.5) + 0.96 * (x + 0.5) - 2.0 - 0.5 as px from " + _LINES
query("affine_resample", _resampled(_AT))(lambda s, d: _warped(s, d, _TURN))
query(
    "nearest_resample",
    with_(IMAGE, f"pts as ({_AT})") + f"select p.y, p.x, {r6('coalesce(i.v, 0)')} from pts p left join img i on i.y = floor(p.py + 0.5) and i.x = floor(p.px + 0.5) and p.py >= -0.5 and p.px >= -0.5 and p.px < 63.5 and p.py < {_NY} - 0.5",
)(lambda s, d: _warped(s, d, _TURN, order=0))
_SWIRL = Swirl((60.0, 32.0), 20.0, 0.6)
_SW = f"""select y, x, (dy * cos(a) - dx * sin(a) + 60) - 0.5 as py, (dy * sin(a) + dx * cos(a) + 32) - 0.5 as px
 from (select *, 0.6 * exp(-(dy * dy + dx * dx) / 400.0) as a from (select y, x, y + 0.5 - 60 as dy, x + 0.5 - 32 as dx from {_LINES}))"""
query("warp_swirl", _resampled(_SW))(lambda s, d: _warped(s, d, _SWIRL))
query("warp_sequence", _resampled(_SW.replace("select y, x, (dy", "select y, x, 2.0 + (dy")))(lambda s, d: _warped(s, d, Sequence((_SWIRL, Affine.of([[1, 0], [0, 1]], [2.0, 0.0])))))


def _field(s, d) -> Field:
    """Displacements from the coarse raster of the table itself: 8 x 8 voxels a lattice step."""
    coarse = aggregate.downsample(_image(s, d), [8, 8], "mean")
    lattice = coarse.df.select(F.col("y").alias("g0"), F.col("x").alias("g1"), (F.col("v") * 20).alias("d0"), (F.col("v") * -10).alias("d1"))
    return Field(lattice, coarse.meta.shape, Affine.scale_translation((1 / 8, 1 / 8), (-0.5, -0.5)))


# a last block that is not full repeats its last line
_LATTICE = f"lat as materialized (select y, x, sum(v * w) / sum(w) as v from (select y // 8 as y, x // 8 as x, v, case when y = {_NY} - 1 then 1 + (8 - {_NY} % 8) % 8 else 1 end as w from img) group by y, x)"
_FIELD = f"""pts as materialized (select g.y, g.x, g.y + sum(l.v * w) * 20 as py, g.x - sum(l.v * w) * 10 as px from
 (select g.y, g.x, (case when k.a = 1 then g.gy - fy else 1 - (g.gy - fy) end) * (case when k.b = 1 then g.gx - fx else 1 - (g.gx - fx) end) as w, fy + k.a as ly, fx + k.b as lx from
  (select y, x, gy, gx, least(floor(gy), top - 1)::bigint as fy, least(floor(gx), 6)::bigint as fx from
   (select y, x, top, greatest(0, least(top, (y + 0.5) / 8 - 0.5)) as gy, greatest(0, least(7, (x + 0.5) / 8 - 0.5)) as gx from (select max(y) as top from lat), {_LINES})) g
  join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b) on true) g join lat l on l.y = g.ly and l.x = g.lx group by g.y, g.x)"""
query("warp_field", with_(IMAGE, _LATTICE, _FIELD, f"s as (select p.y, p.x, sum(i.v * {_LINEAR}) as v {_CORNERS.format(n=_NY)} group by p.y, p.x)") + f"select pts.y, pts.x, {r6('coalesce(s.v, 0)', digits=5)} from pts left join s using (y, x)", 5)(
    lambda s, d: _warped(s, d, _field(s, d))
)
query("net_field", with_(IMAGE, _LATTICE, _FIELD) + f"select 0::bigint as c, y, x, {r6('py - y')} from pts union all select 1, y, x, {r6('px - x')} from pts")(lambda s, d: geo.field_of(_field(s, d), _target(_image(s, d)), s))


@query("inverse_field", digits=3)
def _inverse(s, d):
    """Every voxel's middle, brought back through a field and forward again: the error of each, which a test holds near 0."""
    f = _field(s, d)
    points = _image(s, d).df.select("y", "x", (F.col("y") + 0.5).alias("p0"), (F.col("x") + 0.5).alias("p1"))
    there = f.apply(InverseField(f).apply(points))
    return there.select("y", "x", F.greatest(F.abs(F.col("p0") - F.col("y") - 0.5), F.abs(F.col("p1") - F.col("x") - 0.5)).alias("v"))


_PART = Affine.of([[2.0]], [1.0])
query(
    "point_transforms",
    with_(RASTER, "p as (select t, x, v, x * 3.0 + 2 as a, v * 2.0 + 1 as b, t * 1.5 - 4 as c from ras)") + f"select t, x, {r6('a', 'p0', 2)}, {r6('b', 'p1', 2)}, {r6('c', 'p2', 2)} from p",
    2,
)(
    lambda s, d: ByDimension((((0,), (2,), Affine.of([[1.5]], [-4.0])), ((1,), (0,), Affine.of([[3.0]], [2.0])), ((2,), (1,), _PART)))
    .apply(tables.event_raster(s, d).df.select("t", "x", F.col("t").cast("double").alias("p0"), F.col("x").cast("double").alias("p1"), F.col("v").alias("p2")))
    .select("t", "x", "p0", "p1", "p2")
)
_LAT2 = f"lat2 as materialized (select y // 2 as y, x // 2 as x, sum(v * w) / sum(w) as v from (select *, case when y = {_NY} - 1 then 1 + {_NY} % 2 else 1 end as w from img) group by all)"


def _between(table: str, cy: str, ny: str, cx: str, nx: str) -> str:
    """SQL of linear interpolation in ``table`` at (cy, cx) of each voxel of ``out``, edges repeated."""
    return f"""pt as (select y, x, {cy} as py, {cx} as px from out_),
 nb as (select pt.*, a, b, greatest(0, least({ny} - 1, floor(py) + a)) as gy, greatest(0, least({nx} - 1, floor(px) + b)) as gx from pt, range(0, 2) p(a), range(0, 2) q(b)),
 got as (select nb.y, nb.x, sum(l.v * (case when a = 1 then py - floor(py) else 1 - (py - floor(py)) end) * (case when b = 1 then px - floor(px) else 1 - (px - floor(px)) end)) as v from nb join {table} l on l.y = nb.gy and l.x = nb.gx group by nb.y, nb.x)"""


query(
    "stack_onto",
    with_(IMAGE, _LAT2, "out_ as (select y, x from img)", _between("lat2", "(y + 0.5) / 2 - 0.5", f"(({_NY} + 1) // 2)", "(x + 0.5) / 2 - 0.5", "32")) + f"select 0::bigint as c, y, x, {r6('v')} from img union all select 1, y, x, {r6('v')} from got",
)(lambda s, d: axes.stack_onto([_image(s, d), aggregate.downsample(_image(s, d), [2, 2], "mean")]))
query(
    "resampled_level",
    with_(
        IMAGE,
        f"ly as materialized (select y // 2 as y, x, sum(v * w) / sum(w) as v from (select *, case when y = {_NY} - 1 then 1 + {_NY} % 2 else 1 end as w from img) group by all)",
        "out_ as (select y, k as x from (select distinct y from ly), range(0, 128) r(k))",
        _between("ly", "y", f"(({_NY} + 1) // 2)", "(x + 0.5) / 2 - 0.5", "64"),
    )
    + f"select y, x, {r6('v')} from got",
)(lambda s, d: geo.at_voxel_size(_image(s, d), (2.0, 0.5)))
query("warp_swirls", digits=4)(lambda s, d: Swirls.drawn(4, (0, 0, 0), (7, 100, 84), 20, 0.8, 3).apply(tables.shipping_volume(s, d).df.select("z", "y", "x", *[F.col(a).cast("double").alias(f"p{i}") for i, a in enumerate("zyx")])))

# formulas at places that tables give

_T32 = lambda a, k: f"(({a}) * {k & 0xFFFF} + (((({a}) * {k >> 16}) & 65535) << 16)) & 4294967295"


def _hash_steps(seeds: dict[str, str], source: str, keep: str, tag: str, zyx: tuple[str, str, str]) -> list[str]:
    """SQL of the lattice hash, step by step: columns named by ``seeds`` (name to the seed's SQL), from 0 to 1, in ``{tag}4``."""
    z, y, x = zyx
    mask = "& 4294967295"
    first = ", ".join(f"xor(xor(xor({_T32(f'(({x}) {mask})', LATTICE[0])}, {_T32(f'(({y}) {mask})', LATTICE[1])}), {_T32(f'(({z}) {mask})', LATTICE[2])}), {_T32(f'({seed})', LATTICE[3])}) as {n}" for n, seed in seeds.items())
    out = [f"{tag}0 as (select {keep}, {first} from {source})"]
    for i, (shift, k) in enumerate(zip(SHIFTS, (*MIXERS, 1), strict=True)):
        mixed = lambda n, s=shift: f"xor({n}, {n} >> {s})"
        step = ", ".join(f"{_T32(mixed(n), k) if k != 1 else mixed(n)} as {n}" for n in seeds)
        out.append(f"{tag}{i + 1} as (select {keep}, {step} from {tag}{i})")
    return [*out, f"{tag}4 as (select {keep}, {', '.join(f'{n} / 4294967296.0 as {n}' for n in seeds)} from {tag}3)"]


query(
    "lattice_noise",
    with_("p as (select l_linenumber::bigint as z, l_suppkey as y, l_partkey as x from lineitem)", *_hash_steps({"h": "5"}, "p", "z, y, x", "h", ("z", "y", "x"))) + f"select z, y, x, {r6('h')} from h4",
)(lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").cast("long").alias("z"), F.col("l_suppkey").alias("y"), F.col("l_partkey").alias("x")).select("z", "y", "x", lattice_noise(F.col("z"), F.col("y"), F.col("x"), 5).alias("v")))


def _places(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_linenumber") * 37).cast("long").alias("Z"), (F.col("l_suppkey") % 512).alias("Y"), (F.col("l_partkey") % 512).alias("X"))
    return rows.distinct()


_SHAPE = (512, 512, 512)
_PLACES = "pl as materialized (select distinct (l_linenumber * 37)::bigint as Z, l_suppkey % 512 as Y, l_partkey % 512 as X from lineitem)"
_EIGHT = "(values (0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)) e(dz, dy, dx)"


def _spheres_sql(kind: str, seed: int) -> str:
    size, each = synthetic.SPHERES[kind]
    base = ", ".join(f"floor({a} / {size} - 0.5)::bigint + d{a.lower()} as g{a.lower()}" for a in "ZYX")
    cells = f"c as (select Z, Y, X, k, {base} from pl cross join {_EIGHT} cross join range(0, {each}) r(k))"
    seeds = {f"u{i}": f"{seed * 131 + i} + 7 * k" for i in range(5)}
    if kind == "blobs":
        at, r, h, far = "(g{a} + u{i}) * 128.0", f"8 + u3 * ({size / 6 - 8!r})", "90 + u4 * 130", "r * 3"
        value = "h * exp(-d2 / (2 * r * r))"
    else:
        at, r, h, far = "(g{a} + 0.5 + (u{i} - 0.5) * 0.4) * 160.0", "160.0 * (0.22 + 0.15 * u3)", "200.0", "r + 10"
        value = "h * exp(-((sqrt(d2) - r) ** 2) / 12.5) + (case when sqrt(d2) < r then 40 else 0 end)"
    d2 = " + ".join(f"({a} - {at.format(a=a.lower(), i=i)}) ** 2" for i, a in enumerate("ZYX"))
    drawn = f"s as (select Z, Y, X, {d2} as d2, {r} as r, {h} as h from h4)"
    return with_(_PLACES, cells, *_hash_steps(seeds, "c", "Z, Y, X, gz, gy, gx", "h", ("gz", "gy", "gx")), drawn) + f"select Z, Y, X, {r6(f'sum(case when d2 <= ({far}) ** 2 then {value} else 0 end)', digits=4)} from s group by Z, Y, X"


def _noise_sql(seed: int) -> str:
    cell = ", ".join(f"floor({a} / size)::bigint + d{a.lower()} as g{a.lower()}" for a in "ZYX")
    weight = " * ".join(f"(case when d{a.lower()} = 1 then t{a.lower()} else 1 - t{a.lower()} end)" for a in "ZYX")
    part = ", ".join(f"(({a} % size) / size::double) ** 2 * (3 - 2 * (({a} % size) / size::double)) as t{a.lower()}" for a in "ZYX")
    octaves = ", ".join(f"({i}, {size})" for i, size in enumerate(synthetic.NOISE_CELLS))
    return (
        with_(_PLACES, f"t as (select Z, Y, X, o, size, {part} from pl cross join (values {octaves}) v(o, size))", f"c as (select Z, Y, X, o, {weight} * 0.5 ** o as w, {cell} from t cross join {_EIGHT})", *_hash_steps({"u": f"({seed} + o)::bigint"}, "c", "Z, Y, X, w, gz, gy, gx", "h", ("gz", "gy", "gx")))
        + f"select Z, Y, X, {r6('sum(w * u) / 1.5 * 80', digits=4)} from h4 group by Z, Y, X"
    )


def _julia_sql(seed: int) -> str:
    c, at = synthetic.julia_constant(seed), f"/ {max(_SHAPE) / synthetic.JULIA_WIDTH!r} - {synthetic.JULIA_WIDTH / 2!r}"
    parts = [f"j0 as (select Z, Y, X, X {at} as a, Y {at} as b, Z {at} as e, 0.0::double as d, true as near, 0 as n from pl)"]
    for i in range(synthetic.JULIA_STEPS):
        parts.append(f"k{i} as (select Z, Y, X, near, n, a * a - b * b - e * e - d * d + ({c[0]!r}) as a, a * b * 2 + ({c[1]!r}) as b, a * e * 2 + ({c[2]!r}) as e, a * d * 2 + ({c[3]!r}) as d from j{i})")
        parts.append(f"l{i} as (select * replace (near and a * a + b * b + e * e + d * d < 16 as near) from k{i})")
        parts.append(f"j{i + 1} as materialized (select Z, Y, X, near, n + near::int as n, " + ", ".join(f"case when near then {k} else 0 end as {k}" for k in "abed") + f" from l{i})")
    return with_(_PLACES, *parts) + f"select Z, Y, X, {r6(f'n * {255.0 / synthetic.JULIA_STEPS!r}', digits=3)} from j{synthetic.JULIA_STEPS}"


query("synthetic_noise", _noise_sql(3), 4)(lambda s, d: synthetic.with_kind(_places(s, d), "noise", _SHAPE, seed=3))
for _kind in synthetic.SPHERES:
    query(f"synthetic_{_kind}", _spheres_sql(_kind, 3), 4)(lambda s, d, k=_kind: synthetic.with_kind(_places(s, d), k, _SHAPE, seed=3))
query("synthetic_julia", _julia_sql(3), 3)(lambda s, d: synthetic.with_kind(_places(s, d), "julia", _SHAPE, seed=3))
query("synthetic_mandelbulb", digits=3)(lambda s, d: synthetic.with_kind(_places(s, d), "mandelbulb", _SHAPE))


def _morton_sql(cols: list[str], bits: int) -> str:
    n = len(cols)
    return " + ".join(f"(((({c})::bigint >> {b}) & 1) << {b * n + k})" for b in range(bits) for k, c in enumerate(reversed(cols)))


query("morton_order", with_(VOLUME) + f"select z, y, x, {_morton_sql(['z', 'y', 'x'], 7)} as v from vol")(lambda s, d: tables.shipping_volume(s, d).df.select("z", "y", "x", morton([F.col(a) for a in "zyx"], 7).alias("v")))


def _compressed_sql(cols, shape):
    needed, parts, place = [(n - 1).bit_length() for n in shape], [], 0
    for b in range(max(needed)):
        for c, n in zip(reversed(cols), reversed(needed), strict=True):
            if b < n:
                parts.append(f"((({c} >> {b}) & 1) << {place})")
                place += 1
    return " + ".join(parts)


query("compressed_morton", with_(VOLUME) + f"select z, y, x, {_compressed_sql(['z', 'y', 'x'], (7, 100, 84))} as v from vol")(lambda s, d: tables.shipping_volume(s, d).df.select("z", "y", "x", compressed_morton([F.col(a) for a in "zyx"], (7, 100, 84)).alias("v")))

# frames

_FRAMES = "fr as (select t // 24 as t, t % 24 as y, x, (1 + floor(v / 60)::bigint % 5) * (v > 40)::int as v from ras)"


def _frames(s, d) -> Grid:
    """A label image a day: hours down, users across, labels by size of value."""
    g = tables.event_raster(s, d)
    v = ((F.floor(F.col("v") / 60) % 5 + 1) * (F.col("v") > 40).cast("long")).cast("long")
    df = g.df.select(F.floor(F.col("t") / 24).cast("long").alias("day"), (F.col("t") % 24).alias("y"), "x", v.alias("v")).withColumnRenamed("day", "t")
    return Grid(df, ArrayMeta(("t", "y", "x"), (30, 24, 32), "int64", kind="label"))


_SIZES = "sz as (select t, v as label, count(*) as voxels from fr where v > 0 group by all)"
_SHARED = "sh as (select a.t, a.v as a, b.v as b, count(*) as shared from fr a join fr b on b.t = a.t + 1 and b.y = a.y and b.x = a.x where a.v > 0 and b.v > 0 group by all)"
query("track_measures", with_(RASTER, _FRAMES) + f"select t, v as label, count(*) as voxels, {r6('avg(y)', 'mean_y')}, min(y) as lo_y, max(y) + 1 as hi_y, {r6('avg(x)', 'mean_x')}, min(x) as lo_x, max(x) + 1 as hi_x from fr where v > 0 group by t, v")(
    lambda s, d: tracking.measures(_frames(s, d))
)
_STEP = "st as (select sh.t, a, b, shared, s.voxels, (n.voxels <= s.voxels * 0.65)::bigint as divided from (select * from sh qualify row_number() over (partition by t, a order by shared desc, b) = 1) sh join sz s on s.t = sh.t and s.label = a join sz n on n.t = sh.t + 1 and n.label = b where shared >= s.voxels * 0.2)"
query("track_step", with_(RASTER, _FRAMES, _SIZES, _SHARED, _STEP) + "select t, a, b, shared, voxels, divided from st")(lambda s, d: tracking.steps(_frames(s, d)))
_BORN = "nb as (select s.t, s.label, s.voxels from sz s left join (select t + 1 as t, b, max(shared) as shared from sh group by all) c on c.t = s.t and c.b = s.label where s.t > 0 and coalesce(c.shared, 0) < s.voxels * 0.4)"
query("newborns", with_(RASTER, _FRAMES, _SIZES, _SHARED, _BORN) + "select t, label, voxels from nb")(lambda s, d: tracking.newborns(_frames(s, d)))
query(
    "lineage",
    with_(
        RASTER, _FRAMES, _SIZES, _SHARED, _STEP,
        "tr as (select t as t0, label as first, t, label from sz where not exists (select 1 from st where st.t + 1 = sz.t and st.b = sz.label) union all select t0, first, tr.t + 1, st.b from tr join st on st.t = tr.t and st.a = tr.label)",
    )
    + "select t0, first, t, label from tr",
)(lambda s, d: tracking.follow(_frames(s, d)))
query(
    "mothers",
    with_(
        RASTER, _FRAMES, _SIZES, _SHARED, _STEP,
        "tr as (select t as t0, label as first, t, label from sz where not exists (select 1 from st where st.t + 1 = sz.t and st.b = sz.label) union all select t0, first, tr.t + 1, st.b from tr join st on st.t = tr.t and st.a = tr.label)",
        "ts as (select tr.*, sz.voxels from tr join sz using (t, label))",
        "en as (select t0, first, max(t) + 1 as lost, arg_max(voxels, t) as at_last from ts group by t0, first)",
        "mo as (select ts.t0, ts.first, en.lost, en.at_last, ts.t, ts.label, ts.voxels from ts join en using (t0, first) where en.lost < 30 and ts.t >= en.lost - 12 qualify row_number() over (partition by ts.t0, ts.first order by ts.voxels desc, ts.t) = 1)",
    )
    + "select t0, first, lost, t, label, voxels from mo where at_last <= voxels * 0.95",
)(lambda s, d: tracking.mothers(_frames(s, d), divided=0.95))
query("search_boxes", with_(RASTER, _FRAMES) + "select t, v as label, greatest(min(y) - 2, 0) as from_y, least(max(y) + 3, 24) as to_y, greatest(min(x) - 2, 0) as from_x, least(max(x) + 3, 32) as to_x from fr where v > 0 group by t, v")(
    lambda s, d: tracking.boxes_around(tracking.measures(_frames(s, d)), {"y": 24, "x": 32}, 2).select("t", "label", "from_y", "to_y", "from_x", "to_x")
)
_PATHS = "tr as (select t as t0, label as first, t, label from {starts} union all select t0, first, tr.t + 1, st.b from tr join st on st.t = tr.t and st.a = tr.label)"
_BACK = """bs as (select sh.t + 1 as t, b as a, a as b from (select sh.*, row_number() over (partition by t, b order by shared desc, a) as k from sh) sh join sz s on s.t = sh.t + 1 and s.label = b where k = 1 and shared >= s.voxels * 0.2),
 bk as (select t as t0, label as first, t, label from ask union all select t0, first, bk.t - 1, bs.b from bk join bs on bs.t = bk.t and bs.a = bk.label)"""


def _borne(name: str, source: str) -> str:
    """Daughters of the tracks of a table, as ``tracking.lineages`` finds them."""
    return f"""{name}_en as (select t0, first, max(t) + 1 as lost, arg_max(voxels, t) as at_last from {source} group by t0, first),
 {name}_mo as (select p.t0, p.first, e.lost, e.at_last, p.voxels, p.mean_y, p.mean_x from {source} p join {name}_en e using (t0, first) where e.lost < 30 and p.t >= e.lost - 12 qualify row_number() over (partition by p.t0, p.first order by p.voxels desc, p.t) = 1),
 {name} as (select m.t0, m.first, b.t, b.label, row_number() over (partition by m.t0, m.first order by b.t, sqrt((b.mean_y - m.mean_y) ** 2 + (b.mean_x - m.mean_x) ** 2), b.label) as nth
  from {name}_mo m join nbs b on b.t >= m.lost and b.t < least(m.lost + 4, 30) and sqrt((b.mean_y - m.mean_y) ** 2 + (b.mean_x - m.mean_x) ** 2) <= 8 and b.voxels >= m.voxels * 0.1
  where m.at_last <= m.voxels * 0.98 qualify nth <= 2)"""


query(
    "lineage_branches",
    with_(
        RASTER, _FRAMES, _SIZES, _SHARED, _STEP, _BORN,
        "mz as (select t, v as label, count(*) as voxels, avg(y) as mean_y, avg(x) as mean_x from fr where v > 0 group by all)",
        "nbs as (select mz.* from nb join mz using (t, label))",
        "ask as (select t, label from sz where t in (0, 9, 18, 26))",
        "sts as (select t, label from ask union select t, label from nb)",
        _PATHS.format(starts="sts"), _BACK,
        "mn as (select p.*, mz.voxels, mz.mean_y, mz.mean_x from (select tr.* from tr join ask on ask.t = tr.t0 and ask.label = tr.first union all select * from bk where t < t0) p join mz using (t, label))",
        "bt as (select tr.*, mz.voxels, mz.mean_y, mz.mean_x from tr join nb on nb.t = tr.t0 and nb.label = tr.first join mz on mz.t = tr.t and mz.label = tr.label)",
        _borne("dm", "mn"), _borne("db", "bt"),
        "br as (select t0 as rt, first as rl, t as bt, label as bl, 1 as level, [nth] as path from dm union all select rt, rl, db.t, db.label, level + 1, list_append(path, db.nth) from br join db on db.t0 = br.bt and db.first = br.bl where level < 8)",
        "nu as (select *, row_number() over (partition by rt, rl order by level, path) as branch from br)",
    )
    + """select t0, first as label0, 0::bigint as branch, -1::bigint as mother, t, label from mn
 union all select nu.rt, nu.rl, nu.branch, coalesce(mo.branch, 0), bt.t, bt.label from nu join bt on bt.t0 = nu.bt and bt.first = nu.bl
  left join nu mo on mo.rt = nu.rt and mo.rl = nu.rl and mo.path = nu.path[: -2] where nu.branch < 8""",
)(lambda s, d: tracking.lineages(_frames(s, d), _frames(s, d).df.where("v > 0 and t in (0, 9, 18, 26)").select("t", F.col("v").alias("label")), frames=12, divided=0.98, gap=4, within=8.0).na.fill(-1, ["mother"]))
query("daughters")(lambda s, d: tracking.daughters(_frames(s, d), gap=3, within=6.0))

# tiles

_BOXES = "tl as (select o_orderkey as tile, (o_custkey % 1000) * 7.0 as lo_y, (o_custkey % 1000) * 7.0 + 5 + o_totalprice / 50000 as hi_y, (o_orderkey % 997) * 5.0 as lo_x, (o_orderkey % 997) * 5.0 + 6 as hi_x from orders)"


def _boxes(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    y, x = (F.col("o_custkey") % 1000) * 7.0, (F.col("o_orderkey") % 997) * 5.0
    return o.select(F.col("o_orderkey").alias("tile"), y.alias("lo_y"), (y + 5 + F.col("o_totalprice") / 50000).alias("hi_y"), x.alias("lo_x"), (x + 6).alias("hi_x"))


query(
    "tile_overlaps",
    with_(_BOXES) + f"select a.tile as a, b.tile as b, {r6('greatest(a.lo_y, b.lo_y)', 'lo_y')}, {r6('least(a.hi_y, b.hi_y)', 'hi_y')}, {r6('greatest(a.lo_x, b.lo_x)', 'lo_x')}, {r6('least(a.hi_x, b.hi_x)', 'hi_x')} from tl a join tl b on a.tile < b.tile and a.lo_y < b.hi_y and b.lo_y < a.hi_y and a.lo_x < b.hi_x and b.lo_x < a.hi_x",
)(lambda s, d: stitching.tile_overlaps(_boxes(s, d), ("y", "x"), cell=32.0))


def _halves(s, d) -> list:
    """The image's left and right part, with columns in common, the right one brighter."""
    image = _image(s, d)
    n = image.meta.shape[0]
    left, right = image.cropped(Box((0, 0), (n, 40))), image.cropped(Box((0, 28), (n, 64)))
    return [(left, (0, 0)), (Grid(right.df.withColumn("v", F.col("v") * 1.5), right.meta), (0, 28))]


_COS = "(0.5 - 0.5 * cos(greatest(0, least(8, {d})) * pi() / 8))"
query(
    "fuse_tiles",
    with_(
        IMAGE,
        "t as (select y, x, v, 40 as n, x as tx from img where x < 40 union all select y, x, v * 1.5, 36, x - 28 from img where x >= 28)",
        f"w as (select y, x, v, {_COS.format(d=f'least(y + 0.5, {_NY} - 0.5 - y)')} * {_COS.format(d='least(tx + 0.5, n - 0.5 - tx)')} as w from t)",
    )
    + f"select y, x, {r6('sum(v * w) / sum(w)', digits=5)} from w group by y, x",
    5,
)(lambda s, d: stitching.fuse(_halves(s, d)))


query(
    "fuse_box",
    with_(
        IMAGE,
        "t as (select y, x, v, 40 as n, x as tx from img where x < 40 union all select y, x, v * 1.5, 36, x - 28 from img where x >= 28)",
        f"w as (select y, x, v, {_COS.format(d=f'least(y + 0.5, {_NY} - 0.5 - y)')} * {_COS.format(d='least(tx + 0.5, n - 0.5 - tx)')} as w from t)",
    )
    + f"select y, x, {r6('sum(v * w) / sum(w)', digits=5)} from w where x >= 20 and x < 36 group by y, x",
    5,
)(lambda s, d: stitching.fuse(_halves(s, d), box=Box((0, 20), (_image(s, d).meta.shape[0], 36))))


def _points(s, d, tile: int):
    """Points of the plane from orders; tile 1 is tile 0 moved by (12, -7)."""
    o = s.read.parquet(f"{d}/orders.parquet")
    y, x = (F.col("o_totalprice") * 7) % 1000 + 12.0 * tile, (F.col("o_totalprice") * 13) % 1000 - 7.0 * tile
    return o.select(F.lit(tile).alias("tile"), F.col("o_orderkey").alias("id"), y.alias("y"), x.alias("x"))


query("nearest_points", digits=4)(lambda s, d: stitching.nearest(_points(s, d, 0), ("y", "x"), 3, 60.0))


@query("match_translation", digits=3)
def _match(s, d):
    a, b = (stitching.descriptors(_points(s, d, t), ("y", "x"), 3, 60.0) for t in (0, 1))
    return stitching.vote_translation(stitching.match(a, b, ("y", "x")), ("y", "x"))


@query("stitch_run", digits=2)
def _stitch_run(s, d):
    """Four tiles of orders' points, three of them moved: every overlapping pair's matches and errors."""
    o = s.read.parquet(f"{d}/orders.parquet")
    y, x = (F.col("o_totalprice") * 7) % 1000, (F.col("o_totalprice") * 13) % 1000
    corners = s.createDataFrame([(t, 480.0 * (t // 2), 480.0 * (t // 2) + 520.0, 480.0 * (t % 2), 480.0 * (t % 2) + 520.0) for t in range(4)], "tile long, lo_y double, hi_y double, lo_x double, hi_x double")
    own = o.select(F.col("o_orderkey").alias("id"), y.alias("y"), x.alias("x")).join(F.broadcast(corners), (F.col("y") >= F.col("lo_y")) & (F.col("y") <= F.col("hi_y")) & (F.col("x") >= F.col("lo_x")) & (F.col("x") <= F.col("hi_x")))
    moved = own.select("tile", "id", (F.col("y") + F.col("tile") * 1.5).alias("y"), (F.col("x") - F.col("tile") * 2.25).alias("x"))
    placed, report = stitching.stitch(corners, moved, ("y", "x"), margin=10.0, epsilon=1.0)
    ends = placed.select(F.col("tile").alias("b"), F.round("t_y", 2).alias("b_y"), F.round("t_x", 2).alias("b_x"))
    return report.drop("error", "error_max").join(ends, "b", "left").withColumns({c: F.col(c).cast("long") for c in ("kept", "dropped")})


@query("register_pair", digits=3)
def _register_pair(s, d):
    """The image, smoothed, and itself turned about its middle: squared local correlation before and after a fit."""
    image = stencil.gaussian(_image(s, d), 2.5)
    n = image.meta.shape[0]
    fixed = Grid(stored(image.df, "fixed"), image.meta)
    turned = geo.resample(fixed, fixed.meta, Swirl((n / 2, 32.0), 24.0, 0.25))
    moving = Grid(stored(turned.df, "moving"), turned.meta)
    done = registration.register([fixed], [moving], fit=registration.Fit(steps=(12,), spacing=8.0, smooth=0.1), levels=[0])
    (before, after), = done.correlation
    return s.createDataFrame([("before", before), ("after", after)], "what string, correlation double")


# surfaces

query(
    "terrain_mesh",
    with_(IMAGE, "q as (select a.y, a.x, a.v as a, b.v as b, c.v as c, d.v as d from img a join img b on b.y = a.y and b.x = a.x + 1 join img c on c.y = a.y + 1 and c.x = a.x join img d on d.y = a.y + 1 and d.x = a.x + 1)")
    + f"select y, x, 0::bigint as half, {r6('a + b + c', 'height')} from q union all select y, x, 1, {r6('b + c + d', 'height')} from q",
)(lambda s, d: meshes.terrain_mesh(_image(s, d)).select("y", "x", "half", (F.col("p")[0] + F.col("q")[0] + F.col("r")[0]).alias("height")))
query(
    "surface_faces",
    with_(IMAGE, "m as (select y, x from img where v >= 0.15)")
    + "select m.y, m.x, o.axis, o.side::bigint as side from m cross join (values ('y', -1, -1, 0), ('y', 1, 1, 0), ('x', -1, 0, -1), ('x', 1, 0, 1)) o(axis, side, dy, dx) where not exists (select 1 from m n where n.y = m.y + o.dy and n.x = m.x + o.dx)",
)(lambda s, d: meshes.surface_faces(_mask(s, d)))
_BAND = f"bd as (select a.y, a.x from img a cross join range(-2, 3) p(k) cross join range(-2, 3) q(k) left join img b on b.y = a.y + p.k and b.x = a.x + q.k group by a.y, a.x having max(coalesce((b.v >= 0.15)::int, 0)) > min(coalesce((b.v >= 0.15)::int, 0)))"
query("mesh_octree", with_(IMAGE, _BAND, "e as (select l.k as level, y // (8 << l.k) as y, x // (8 << l.k) as x from bd cross join range(0, 3) l(k))") + f"select level::bigint as level, {_morton_sql(['y', 'x'], 16)} as \"order\", y, x, count(*) as surface from e group by all")(
    lambda s, d: meshes.octree_nodes(_mask(s, d), 8, 3)
)


def _solid(s, d) -> Grid:
    return pointwise.threshold(tables.shipping_volume(s, d), 30.0)


def _corners(df):
    return df.select("z", "y", "x", *[F.col(k)[i].alias(f"{k}{a}") for k in "pqr" for i, a in enumerate("zyx")])


_CELL_TRIANGLES = ", ".join("(" + ", ".join(map(str, (code, *[v for p in t for v in p]))) + ")" for code in range(1, 255) for t in meshes.cell_triangles(code))
_NAMES = [f"{k}{a}" for k in "pqr" for a in "zyx"]
query(
    "mesh_surface",
    with_(
        VOLUME,
        "st as materialized (select z, y, x from vol where v >= 30)",
        "cl as (select z - a as z, y - b as y, x - c as x, sum(1 << (4 * a + 2 * b + c)) as code from st, range(0, 2) i(a), range(0, 2) j(b), range(0, 2) k(c) group by all)",
        f"tb(code, {', '.join(f'h{n}' for n in _NAMES)}) as (values {_CELL_TRIANGLES})",
    )
    + f"select z, y, x, {', '.join(f'({n[1]} + h{n} / 2.0)::double as {n}' for n in _NAMES)} from cl join tb using (code)",
)(lambda s, d: _corners(meshes.surface(_solid(s, d))))
query(
    "mesh_fragments",
    with_(
        VOLUME,
        "st as materialized (select z, y, x from vol where v >= 30)",
        "cl as (select z - a as z, y - b as y, x - c as x, sum(1 << (4 * a + 2 * b + c)) as code from st, range(0, 2) i(a), range(0, 2) j(b), range(0, 2) k(c) group by all)",
        f"tb(code, {', '.join(f'h{n}' for n in _NAMES)}) as (values {_CELL_TRIANGLES})",
        f"tr as materialized (select greatest(z, 0) // 7 as chunk_z, greatest(y, 0) // 25 as chunk_y, greatest(x, 0) // 28 as chunk_x, {', '.join(f'2 * {n[1]} + h{n} as {n}' for n in _NAMES)} from cl join tb using (code))",
        "vx as (" + " union ".join(f"select chunk_z, chunk_y, chunk_x, {k}z as z, {k}y as y, {k}x as x from tr" for k in "pqr") + ")",
        "vn as (select chunk_z, chunk_y, chunk_x, count(*) as vertices from vx group by all)",
        "tn as (select chunk_z, chunk_y, chunk_x, count(*) as triangles from tr group by all)",
    )
    + "select chunk_z, chunk_y, chunk_x, vertices, triangles, 4 + 12 * vertices + 12 * triangles as bytes from vn join tn using (chunk_z, chunk_y, chunk_x)",
)(lambda s, d: meshes.fragments(_solid(s, d)).select("chunk_z", "chunk_y", "chunk_x", "vertices", "triangles", F.length("data").alias("bytes")))
