"""Registered queries of pipelines, stores and demand; see ``catalogue``."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .catalogue import _N, IMAGE, VOLUME, _both, _smooth, query, r6, with_
from .grid import Grid
from .meta import Box
from .operators import pointwise
from .operators.aggregate import downsample, pyramid
from .plans.pipeline import OPS, Op, Pipeline, Registry, Spec, at_one_size, coverage, coverage_levels, register
from .sources import images, stores, tables
from .storage import shared_folder
from .streaming import demand

_SPEC = {"source": "image", "ops": [{"op": "gaussian", "sigma": 1.2}, {"op": "threshold", "low": 0.05}, {"op": "downsample", "factor": [2, 2], "mode": "mode"}]}


def _image(s, d) -> Grid:
    g = tables.embedding_image(s, d)
    return Grid(g.df, replace(g.meta, chunk=(50, 16)))


_STAGES = with_(
    IMAGE,
    *_both(_smooth(1.2)),
    "m as (select y, x, (v >= 0.05)::int as v from q)",
    f"w as (select y // 2 as y, x // 2 as x, v, (case when y = {_N} - 1 and y % 2 = 0 then 2 else 1 end) as w, (y % 2) * 2 + x % 2 as p from m)",
    "c as (select y, x, v, sum(w) as n, min(p) as p from w group by y, x, v)",
    "k as (select y, x, v::bigint as v from c qualify row_number() over (partition by y, x order by n desc, p) = 1)",
)
query("pipeline_whole", _STAGES + "select y, x, v from k")(lambda s, d: Pipeline(Spec.of(_SPEC), _image(s, d)).read())
query("pipeline_box", _STAGES + "select y, x, v from k where y >= 60 and y < 90 and x >= 10 and x < 20")(lambda s, d: Pipeline(Spec.of(_SPEC), _image(s, d)).read(Box((60, 10), (90, 20))))
query("plan_box")(lambda s, d: Pipeline(Spec.of(_SPEC), _image(s, d)).plan(s, Box((60, 10), (90, 20))).drop("digest"))


@query("dataset_chain", with_(IMAGE) + f"select y, x, {r6('greatest(0, least(1, (v * 2 + 0.5) / 1.0))')} from img")
def _chain(s, d):
    r = Registry(s, lambda name: _image(s, d))
    r.put("chain_base", Spec.of({"source": "image", "ops": [{"op": "scale", "factor": 2.0, "offset": 0.5}]}))
    r.put("chain_top", Spec.of({"source": "dataset://chain_base", "ops": [{"op": "normalize", "low": 0.0, "high": 1.0}]}))
    return r.open("chain_top")


_HELD = "(x >= 2 or y = 2)"
query(
    "coverage_levels",
    f"""with fine as (select y, x, {_HELD}::bigint as held from range(0, (({_N} + 49) // 50)::bigint) a(y), range(0, 4) b(x))
 select 0::bigint as level, y as chunk_y, x as chunk_x, 3 * held as bits from fine
 union all select 1, y // 2, x // 2, (y // 2 = 1)::bigint + 2 * min(held) from fine group by y // 2, x // 2""",
)(lambda s, d: _coverage_levels(s, d))


def _coverage_levels(s, d):
    """The image and its half, some chunks of each held."""
    fine = _image(s, d)
    metas = [replace(g.meta, chunk=(50, 16)) for g in (fine, downsample(fine, [2, 2], "mean"))]
    y, x = F.floor(F.col("y") / 50).cast("long").alias("chunk_y"), F.floor(F.col("x") / 16).cast("long").alias("chunk_x")
    own = fine.df.select(y, x).distinct()
    return coverage_levels(metas, [own.where("chunk_x >= 2 or chunk_y = 2"), own.where("chunk_y = 1 and chunk_x < 2")])


query("coverage", f"select y as chunk_y, x as chunk_x, (x = 1 or y = 2)::bigint as held from range(0, (({_N} + 49) // 50)::bigint) a(y), range(0, 4) b(x)")(
    lambda s, d: coverage(_image(s, d), _image(s, d).df.select(F.floor(F.col("y") / 50).cast("long").alias("chunk_y"), F.floor(F.col("x") / 16).cast("long").alias("chunk_x")).where("chunk_x = 1 or chunk_y = 2"))
)


def _round_trip(form: str, compressor: str):
    def run(s, d):
        g = _image(s, d) if form in ("zarr2", "zarr3", "n5") else tables.shipping_volume(s, d)
        if form == "precomputed":
            g = Grid(g.df, replace(g.meta, dtype="float32"))
        path = f"{shared_folder(s)}/gridloom/{s.sparkContext.applicationId}/store-{uuid.uuid4().hex[:12]}"
        stores.write(g, path, form, compressor)
        return stores.read(s, path, Box((10, 5), (200, 40)) if len(g.axes) == 2 else Box((1, 5, 3), (6, 60, 70)))

    return run


_BOX = with_(IMAGE) + f"select y, x, {r6('v')} from img where y >= 10 and y < 200 and x >= 5 and x < 40"
query("materialize_zarr2", _BOX)(_round_trip("zarr2", "gzip"))
query("materialize_zarr3", _BOX)(_round_trip("zarr3", "zstd"))
query("materialize_n5", _BOX)(_round_trip("n5", "gzip"))

query("materialize_precomputed", with_(VOLUME) + f"select z, y, x, {r6('v')} from vol where z >= 1 and z < 6 and y >= 5 and y < 60 and x >= 3 and x < 70")(_round_trip("precomputed", "none"))


def _mean2(source: str, rows: str, name: str) -> str:
    """SQL of means of 2 x 2 voxels, the last line repeated where lines are odd."""
    return f"{name} as materialized (select y // 2 as y, x // 2 as x, sum(v * w) / sum(w) as v from (select *, case when y = {rows} - 1 then 1 + {rows} % 2 else 1 end as w from {source}) group by all)"


def _pyramid(form: str, compressor: str):
    def run(s, d):
        path = f"{shared_folder(s)}/gridloom/{s.sparkContext.applicationId}/levels-{uuid.uuid4().hex[:12]}"
        images.write_levels(pyramid(_image(s, d), 3), path, form, compressor)
        levels = images.open_levels(s, path)
        # voxel sizes and places come back from the store's metadata
        parts = [g.df.select(F.lit(k).cast("long").alias("level"), (F.col("y") * g.meta.voxel_size[0] + g.meta.translation[0]).alias("at_y"), "y", "x", "v") for k, g in enumerate(levels)]
        return reduce(DataFrame.unionByName, parts)

    return run


_PYRAMID = (
    with_(IMAGE, _mean2("img", _N, "l1"), _mean2("l1", f"(({_N} + 1) // 2)", "l2"))
    + " union all ".join(f"select {k}::bigint as level, (y * {1 << k} + {(1 << k) / 2})::double as at_y, y, x, {r6('v')} from {t}" for k, t in enumerate(("img", "l1", "l2")))
)
query("materialize_levels_zarr2", _PYRAMID)(_pyramid("zarr2", "gzip"))
query("materialize_levels_zarr3", _PYRAMID)(_pyramid("zarr3", "zstd"))
_REQUESTS = "rq as (select event_id as seq, (user_id % 40)::varchar as key, (event_id % 3)::bigint as level, case when event_type = (select max(event_type) from events) then 'cancel' else 'ask' end as kind, (event_id % 4)::varchar as claim from events)"


def _requests(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    last = e.agg(F.max("event_type").alias("m"))
    rows = e.join(F.broadcast(last))  # one row
    return rows.select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).cast("string").alias("key"), (F.col("event_id") % 3).alias("level"), F.when(F.col("event_type") == F.col("m"), "cancel").otherwise("ask").alias("kind"), (F.col("event_id") % 4).cast("string").alias("claim"))


query(
    "demand_order",
    with_(
        _REQUESTS,
        "cn as (select key, claim, max(seq) as c from rq where kind = 'cancel' group by all)",
        "lv as (select rq.key, rq.claim, min(seq) as seq, min_by(level, seq) as level from rq left join cn using (key, claim) where kind = 'ask' and (c is null or seq > c) group by all)",
    )
    + "select key, min_by(level, (level, seq)) as level, min_by(seq, (level, seq)) as seq, count(*) as claims from lv group by key",
)(lambda s, d: demand.wanted_now(_requests(s, d)))


if "two_voxels" not in OPS:
    register(Op("two_voxels", pointwise.scale, voxel_size=(2.0, 2.0)))


@query(
    "pinned_levels",
    with_(IMAGE, _mean2("img", _N, "l1"), "o1 as (select y, x, v * 2 + 0.5 as v from l1)", _mean2("o1", f"(({_N} + 1) // 2)", "o2"))
    + f"select 0::bigint as level, y, x, {r6('-v')} from o1 union all select 1, y, x, {r6('-v')} from o2",
)
def _pinned(s, d):
    """An operator of voxels of 2 x 2 between others: it runs on the pyramid's second level, and the third is made of its result."""
    spec = Spec.of({"source": "image", "ops": [{"op": "two_voxels", "factor": 2.0, "offset": 0.5}, {"op": "scale", "factor": -1.0}]})
    done = at_one_size(spec, pyramid(_image(s, d), 3), coarse="compute")
    return reduce(DataFrame.unionByName, [p.read().df.select(F.lit(k).cast("long").alias("level"), "y", "x", "v") for k, p in enumerate(done)])
