"""Every registered query of the array engine, with the SQL that states the same result.

Queries return whole arrays or tables: coordinates as long, values as double rounded to six digits, NaN as -9999.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession, functions as F

from .grid import Grid, finite_or
from .meta import Box
from .operators import aggregate, axes, combine, pointwise, segment, stencil
from .sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The arrays of ``sources.tables`` in SQL.
IMAGE = "img as materialized (select y, x, v from (select vec_id as y, unnest(range(0, 64)) as x, unnest(embedding)::double as v from embeddings))"
_HOUR = "floor((epoch_us(ts) / 1000000.0 - 1704067200) / 3600)::bigint"
RASTER = f"""ras as materialized (select g.t, g.x, coalesce(e.v, 0.0) as v from (select t, x from range(0, 720) a(t), range(0, 32) b(x)) g
 left join (select {_HOUR} as t, user_id % 32 as x, sum(round(value, 4)) as v from events group by all) e on e.t = g.t and e.x = g.x)"""
CHANNELS = f"""chn as materialized (select g.c, g.t as y, g.x, coalesce(e.v, 0.0) as v
 from (select c, t, x from range(0, (select count(distinct event_type) from events)) k(c), range(0, 720) a(t), range(0, 32) b(x)) g
 left join (select k.c, {_HOUR} as t, user_id % 32 as x, sum(round(value, 4)) as v from events
   join (select event_type, row_number() over (order by event_type) - 1 as c from (select distinct event_type from events)) k using (event_type) group by all) e
 on e.c = g.c and e.t = g.t and e.x = g.x)"""
VOLUME = """vol as materialized (select g.z, g.y, g.x, coalesce(e.v, 0.0) as v from (select z, y, x from range(0, 7) a(z), range(0, 100) b(y), range(0, 84) c(x)) g
 left join (select l_linenumber - 1 as z, l_suppkey % 100 as y, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as x, sum(l_quantity) as v from lineitem group by all) e
 on e.z = g.z and e.y = g.y and e.x = g.x)"""


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """The form that results are compared in."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            cols.append((F.round(finite_or(c.cast("double"), -9999.0), digits) + F.lit(0.0)).alias(name))  # no negative zero
        elif kind in ("int", "smallint", "tinyint"):
            cols.append(c.cast("long").alias(name))
        else:
            cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query that returns a Grid or a DataFrame."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return tidy(out.df if isinstance(out, Grid) else out, digits)

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return put


def with_(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


def r6(x: str, name: str = "v", digits: int = 6) -> str:
    return f"round(case when isnan(({x})::double) then -9999 else ({x})::double end, {digits}) + 0.0 as {name}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table gridded, thresholded, brought to half size, and read in a box."""
    mask = pointwise.threshold(tables.embedding_image(spark, sf_dir), 0.1, 0.2)
    half = aggregate.downsample(Grid(mask.df.withColumn("v", F.col("v").cast("double")), mask.meta), 2, "mean")
    return tidy(half.read(Box((10, 4), (60, 28))).df)


# scans, boxes, axes

query("scan_grid", with_(IMAGE) + f"select y, x, {r6('v')} from img")(lambda s, d: tables.embedding_image(s, d))
query("scan_raster", with_(RASTER) + f"select t, x, {r6('v', digits=3)} from ras", 3)(lambda s, d: tables.event_raster(s, d))
query("scan_volume", with_(VOLUME) + f"select z, y, x, {r6('v')} from vol")(lambda s, d: tables.shipping_volume(s, d))
query("box_read", with_(IMAGE) + f"select y, x, {r6('v')} from img where y >= 100 and y < 300 and x >= 8 and x < 40")(lambda s, d: tables.embedding_image(s, d).read(Box((100, 8), (300, 40))))
query("box_crop", with_(IMAGE) + f"select y - 100 as y, x - 8 as x, {r6('v')} from img where y >= 100 and y < 300 and x >= 8 and x < 40")(lambda s, d: tables.embedding_image(s, d).cropped(Box((100, 8), (300, 40))))
query("select_axis", with_(CHANNELS) + f"select y, x, {r6('v', digits=3)} from chn where c = 2", 3)(lambda s, d: axes.select(tables.event_channels(s, d), {"c": 2}))
query("rechunk", with_(IMAGE) + f"select y, x, y // 50 as chunk_y, x // 16 as chunk_x, {r6('v')} from img")(lambda s, d: axes.rechunk(tables.embedding_image(s, d), (50, 16)))
query("flip_axis", with_(IMAGE) + f"select y, 63 - x as x, {r6('v')} from img")(lambda s, d: axes.flip(tables.embedding_image(s, d), ["x"]))
query("transpose", with_(IMAGE) + f"select x, y, {r6('v')} from img")(lambda s, d: axes.transpose(tables.embedding_image(s, d), ["x", "y"]))


@query("stack_channels", with_(IMAGE) + f"select 0::bigint as c, y, x, {r6('v')} from img union all select 1, y, 63 - x, {r6('v')} from img")
def _stack(s, d):
    image = tables.embedding_image(s, d)
    return axes.stack([image, axes.flip(image, ["x"])])


@query("frames_axis", with_(RASTER) + f"select 0::bigint as c, t, x, {r6('v', digits=3)} from ras union all select 1, t, x, {r6('v * 2', digits=3)} from ras", 3)
def _frames(s, d):
    raster = tables.event_raster(s, d)
    return axes.stack([raster, Grid(pointwise.scale(raster, 2.0).df, raster.meta)])


@query("levels_keep", with_(IMAGE) + f"select y // 4 as y, x // 4 as x, {r6('avg(v)')} from img group by all")
def _levels(s, d):
    return axes.keep_levels(aggregate.pyramid(tables.embedding_image(s, d), 3), [0, 2])[1]


# pointwise

query("threshold", with_(IMAGE) + "select y, x, (case when v >= 0.1 and v < 0.2 then 1 else 0 end)::bigint as v from img")(lambda s, d: pointwise.threshold(tables.embedding_image(s, d), 0.1, 0.2))
query("cast_clip", with_(IMAGE) + "select y, x, trunc(greatest(0, least(255, v * 400 + 100)))::bigint as v from img")(lambda s, d: pointwise.cast(pointwise.scale(tables.embedding_image(s, d), 400, 100), "uint8"))
query("scale", with_(IMAGE) + f"select y, x, {r6('v * 3 - 0.5')} from img")(lambda s, d: pointwise.scale(tables.embedding_image(s, d), 3, -0.5))
query("normalize", with_(IMAGE) + f"select y, x, {r6('greatest(0, least(1, (v + 0.1) / 0.3))')} from img")(lambda s, d: pointwise.normalize(tables.embedding_image(s, d), -0.1, 0.2))
query("nodata", with_(RASTER) + f"select t, x, {r6("case when v = 0 then 'nan'::double else v end", digits=3)} from ras", 3)(lambda s, d: pointwise.nodata(tables.event_raster(s, d), 0.0))
query("decode_packed", with_(RASTER) + f"select t, x, {r6("case when v = 0 then 'nan'::double else v * 0.5 + 270 end", digits=3)} from ras", 3)(lambda s, d: pointwise.decode_packed(tables.event_raster(s, d), 0.5, 270, 0.0))


# stencils; the SQL gathers by clamped index


def _line(source: str, axis: str, n: str, weights: dict[int, float], rest: list[str], name: str, edge: str = "repeat") -> str:
    w = ", ".join(f"({k}, {x!r})" for k, x in weights.items())
    join = "join" if edge == "repeat" else "left join"
    index = f"greatest(0, least({n} - 1, a.{axis} + o.k))" if edge == "repeat" else f"a.{axis} + o.k"
    same = " and ".join([f"b.{r} = a.{r}" for r in rest] + [f"b.{axis} = {index}"])
    cols = ", ".join(f"a.{r}" for r in [*rest, axis])
    return f"{name} as (select {cols}, sum(o.w * coalesce(b.v, 0)) as v from {source} a cross join (values {w}) o(k, w) {join} {source} b on {same} group by {cols})"


_N = "(select max(vec_id) + 1 from embeddings)"
_U3 = {k: 1 / 3 for k in (-1, 0, 1)}


def _smooth(sigma: float, truncate: float = 3.0) -> dict[int, float]:
    radius = int(truncate * sigma + 0.5)
    raw = {k: exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)}
    return {k: w / sum(raw.values()) for k, w in raw.items()}


def _both(weights, source="img", edge="repeat", tag=""):
    return [_line(source, "y", _N, weights, ["x"], f"p{tag}", edge), _line(f"p{tag}", "x", "64", weights, ["y"], f"q{tag}", edge)]


query("uniform3", with_(IMAGE, *_both(_U3)) + f"select y, x, {r6('v')} from q")(lambda s, d: stencil.uniform(tables.embedding_image(s, d), 3))
query("uniform4", with_(IMAGE, *_both({k: 0.25 for k in (-2, -1, 0, 1)})) + f"select y, x, {r6('v')} from q")(lambda s, d: stencil.uniform(tables.embedding_image(s, d), 4))
query("gaussian", with_(IMAGE, *_both(_smooth(1.2))) + f"select y, x, {r6('v')} from q")(lambda s, d: stencil.gaussian(tables.embedding_image(s, d), 1.2))
query("gaussian_zero_pad", with_(IMAGE, *_both(_smooth(1.2), edge="zero")) + f"select y, x, {r6('v')} from q")(lambda s, d: stencil.gaussian(tables.embedding_image(s, d), 1.2, edge="zero"))
query("diff_lag", with_(RASTER) + f"select a.t, a.x, {r6('a.v - b.v', digits=3)} from ras a join ras b on b.x = a.x and b.t = greatest(0, a.t - 2)", 3)(lambda s, d: stencil.diff(tables.event_raster(s, d), "t", 2))
_CLAMP = f"""from img a join img n on n.x = a.x and n.y = least({_N} - 1, a.y + 1) join img s on s.x = a.x and s.y = greatest(0, a.y - 1)
 join img e on e.y = a.y and e.x = least(63, a.x + 1) join img w on w.y = a.y and w.x = greatest(0, a.x - 1)"""
query("gradient", with_(IMAGE) + f"select 0::bigint as c, a.y, a.x, {r6('(n.v - s.v) / 2')} {_CLAMP} union all select 1, a.y, a.x, {r6('(e.v - w.v) / 2')} {_CLAMP}")(lambda s, d: stencil.gradient(tables.embedding_image(s, d)))
query("slope", with_(IMAGE) + f"select a.y, a.x, {r6('degrees(atan(sqrt(((n.v - s.v) * 5) ** 2 + ((e.v - w.v) * 5) ** 2)))', digits=5)} {_CLAMP}", 5)(lambda s, d: stencil.slope(tables.embedding_image(s, d), 10.0))
query(
    "hillshade",
    with_(IMAGE)
    + f"""select y, x, round_even(greatest(0, (sin(radians(45)) - dx * sin(radians(315)) * cos(radians(45)) + dy * cos(radians(315)) * cos(radians(45))) / sqrt(1 + dx * dx + dy * dy)) * 254 + 1, 0)::bigint as v
 from (select a.y, a.x, (n.v - s.v) * 5 as dy, (e.v - w.v) * 5 as dx {_CLAMP})""",
)(lambda s, d: stencil.hillshade(tables.embedding_image(s, d), z_factor=10.0))
query("dog", with_(IMAGE, *_both(_smooth(1.0, 4.0), tag="n"), *_both(_smooth(1.6, 4.0), tag="w")) + "select y, x, trunc(round(greatest(0, least(255, (qn.v - qw.v) * 400 + 128)), 9))::bigint as v from qn join qw using (y, x)")(
    lambda s, d: stencil.dog(tables.embedding_image(s, d), 1.0, 1.6, 400.0)
)
query(
    "local_maxima",
    with_(IMAGE) + "select a.y, a.x, (max(b.v) = any_value(a.v))::bigint as v from img a join img b on b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 group by a.y, a.x",
)(lambda s, d: stencil.local_maxima(tables.embedding_image(s, d), 2))
query("box_mean", with_(IMAGE, "p as (select y, x, avg(v) over (partition by x order by y rows between 2 preceding and 2 following) as v from img)") + f"select y, x, {r6('avg(v) over (partition by y order by x rows between 2 preceding and 2 following)')} from p")(
    lambda s, d: stencil.box_mean(tables.embedding_image(s, d), 5)
)
_MASK = "msk as (select y, x, (v >= 0.1)::bigint as v from img)"
_B2 = "bl as (select a.k as dy, b.k as dx from range(-2, 3) a(k), range(-2, 3) b(k) where a.k * a.k + b.k * b.k <= 4)"


def _ball_sql(source: str, how: str, name: str) -> str:
    return f"{name} as (select a.y, a.x, {how}(b.v) as v from {source} a cross join bl join {source} b on b.y = a.y + bl.dy and b.x = a.x + bl.dx group by a.y, a.x)"


def _mask(s, d):
    return pointwise.threshold(tables.embedding_image(s, d), 0.1)


for _name, _steps in {"dilate": ["max"], "erode": ["min"], "open": ["min", "max"], "close": ["max", "min"]}.items():
    _parts, _from = [], "msk"
    for _i, _how in enumerate(_steps):
        _parts.append(_ball_sql(_from, _how, f"m{_i}"))
        _from = f"m{_i}"
    query(_name, with_(IMAGE, _MASK, _B2, *_parts) + f"select y, x, v::bigint as v from {_from}")(lambda s, d, n=_name: stencil.morphology(_mask(s, d), n, 2))

# aggregations

query(
    "downsample_mean",
    with_(IMAGE, f"w as (select y // 3 as y, x // 5 as x, v, (case when y = {_N} - 1 then 1 + (3 - {_N} % 3) % 3 else 1 end) * (case when x = 63 then 2 else 1 end) as w from img)") + f"select y, x, {r6('sum(v * w) / sum(w)')} from w group by y, x",
)(lambda s, d: aggregate.downsample(tables.embedding_image(s, d), [3, 5], "mean"))
query(
    "downsample_mode",
    with_(IMAGE, "l as (select y // 2 as y, x // 2 as x, floor(v * 10)::bigint as v, (y % 2) * 2 + x % 2 as p from img)", "n as (select y, x, v, count(*) as n, min(p) as p from l group by all)")
    + "select y, x, v from n qualify row_number() over (partition by y, x order by n desc, p) = 1",
)(lambda s, d: aggregate.downsample(tables.embedding_image(s, d).map(F.floor(F.col("v") * 10).cast("long"), "int64", "label"), 2))
query("halve", with_(IMAGE) + f"select y // 2 as y, x // 2 as x, {r6('avg(v)')} from img group by all")(lambda s, d: aggregate.halve(tables.embedding_image(s, d)))
query("chunk_summary", with_(VOLUME) + f"select z // 7 as chunk_z, y // 25 as chunk_y, x // 28 as chunk_x, max((v <> 0)::int)::bigint as filled, count(*) as voxels, {r6('sum(v)', 'total', 3)} from vol group by all", 3)(
    lambda s, d: aggregate.chunk_summary(tables.shipping_volume(s, d))
)
query("percentile_range", with_(IMAGE) + f"select {r6('quantile_cont(v, 0.005)', 'low')}, {r6('quantile_cont(v, 0.995)', 'high')} from img")(lambda s, d: aggregate.percentile_range(tables.embedding_image(s, d)))
query(
    "affine_moments",
    with_(RASTER, "c as (select quantile_cont(v, 0.2) as cut from ras where v <> 0)", "k as (select t, x, v from ras, c where v > cut)", "m as (select sum(v) as m, sum(v * t) / sum(v) as mt, sum(v * x) / sum(v) as mx from k)")
    + f"""select {r6('any_value(m)', 'mass', 2)}, {r6('any_value(mt)', 'mean_t', 2)}, {r6('sum(v * t * t) / any_value(m) - any_value(mt) ** 2', 'cov_tt', 2)},
 {r6('sum(v * t * x) / any_value(m) - any_value(mt) * any_value(mx)', 'cov_tx', 2)}, {r6('any_value(mx)', 'mean_x', 2)}, {r6('sum(v * x * x) / any_value(m) - any_value(mx) ** 2', 'cov_xx', 2)} from k, m""",
    2,
)(lambda s, d: aggregate.intensity_moments(tables.event_raster(s, d)))
query("ncc", with_(IMAGE) + f"select {r6('corr(a.v, b.v)', 'ncc')} from img a join img b on b.y = a.y and b.x = 63 - a.x")(lambda s, d: aggregate.ncc(tables.embedding_image(s, d), axes.flip(tables.embedding_image(s, d), ["x"])))
_W5 = "rows between 2 preceding and 2 following"
query(
    "lncc",
    with_(
        IMAGE,
        "p as (select a.y, a.x, a.v, b.v as w, a.v * a.v as vv, b.v * b.v as ww, a.v * b.v as vw from img a join img b on b.y = a.y and b.x = 63 - a.x)",
        "q as (select y, x, " + ", ".join(f"avg({c}) over (partition by x order by y {_W5}) as {c}" for c in ("v", "w", "vv", "ww", "vw")) + " from p)",
        "r as (select y, x, " + ", ".join(f"avg({c}) over (partition by y order by x {_W5}) as {c}" for c in ("v", "w", "vv", "ww", "vw")) + " from q)",
        "k as (select vv - v * v as a, ww - w * w as b, vw - v * w as c from r)",
    )
    + f"select {r6('avg(c * c / (a * b))', 'lncc', 5)}, count(*) as windows from k where a > 1e-9 and b > 1e-9",
    5,
)(lambda s, d: aggregate.lncc(tables.embedding_image(s, d), axes.flip(tables.embedding_image(s, d), ["x"])))

# channels

query(
    "normalized_difference",
    with_(CHANNELS) + f"""select a.y, a.x, {r6("case when a.v <= 0 or b.v <= 0 or a.v + b.v < 20 then 'nan'::double else (a.v - b.v) / (a.v + b.v) end", digits=5)} from chn a join chn b on b.c = 1 and b.y = a.y and b.x = a.x where a.c = 0""",
    5,
)(lambda s, d: combine.normalized_difference(tables.event_channels(s, d), (0, 1), floor=20))
query(
    "contacts",
    with_(
        CHANNELS,
        "bl as (select a.k as dy, b.k as dx from range(-3, 4) a(k), range(-3, 4) b(k) where a.k * a.k + b.k * b.k <= 9)",
        "n as (select distinct c, y + dy as y, x + dx as x from chn cross join bl where c < 2 and v >= 150)",
        "k as (select y, x, count(*) as n from n group by y, x)",
    )
    + "select g.y, g.x, (coalesce(k.n, 0) = 2)::bigint as v from chn g left join k on k.y = g.y and k.x = g.x where g.c = 0",
)(lambda s, d: combine.contacts(tables.event_channels(s, d), 3, a_low=150, b_low=150))

