"""Objects followed through label frames (axes ``t``, then space)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..grid import Grid
from ..storage import stored

LEAST_SHARE = 0.2
BORN_SHARE = 0.4
DIVIDED = 0.65


def measures(labels: Grid) -> DataFrame:
    """For each frame and label: voxels, centroid and box."""
    space = [a for a in labels.axes if a != "t"]
    aggs = [F.count("*").alias("voxels")]
    for a in space:
        aggs += [F.avg(a).alias(f"mean_{a}"), F.min(a).alias(f"lo_{a}"), (F.max(a) + 1).alias(f"hi_{a}")]
    return labels.df.where("v > 0").groupBy("t", F.col("v").alias("label")).agg(*aggs)


def overlaps(labels: Grid) -> DataFrame:
    """Voxels that a label shares with each label of the next frame: one equi-join, one count."""
    space = [a for a in labels.axes if a != "t"]
    now = labels.df.where("v > 0").select(*space, "t", F.col("v").alias("a"))
    later = labels.df.where("v > 0").select(*space, (F.col("t") - 1).alias("t"), F.col("v").alias("b"))
    return now.join(later, ["t", *space]).groupBy("t", "a", "b").agg(F.count("*").alias("shared"))


def steps(labels: Grid, least: float = LEAST_SHARE) -> DataFrame:
    """The label of the next frame that overlaps a label most; none where that is under ``least`` of it: lost.

    ``divided`` tells that the follower has shrunk to 0.65 or less.
    """
    sizes = measures(labels).select("t", "label", "voxels")
    best = overlaps(labels).groupBy("t", "a").agg(F.max_by("b", F.struct("shared", (-F.col("b")).alias("first"))).alias("b"), F.max("shared").alias("shared"))
    met = best.join(sizes.select("t", F.col("label").alias("a"), "voxels"), ["t", "a"]).where(F.col("shared") >= F.col("voxels") * least)
    later = sizes.select((F.col("t") - 1).alias("t"), F.col("label").alias("b"), F.col("voxels").alias("next_voxels"))
    return met.join(later, ["t", "b"]).select("t", "a", "b", "shared", "voxels", (F.col("next_voxels") <= F.col("voxels") * DIVIDED).cast("long").alias("divided"))


def newborns(labels: Grid, share: float = BORN_SHARE) -> DataFrame:
    """Labels of a frame that no label of the frame before covers by ``share`` or more; frame 0 bears none."""
    sizes = measures(labels).select("t", "label", "voxels").where("t > 0")
    covered = overlaps(labels).select((F.col("t") + 1).alias("t"), F.col("b").alias("label"), "shared").groupBy("t", "label").agg(F.max("shared").alias("shared"))
    both = sizes.join(covered, ["t", "label"], "left")
    return both.where(F.coalesce("shared", F.lit(0)) < F.col("voxels") * share).select("t", "label", "voxels")


def daughters(labels: Grid, gap: int = 24, within: float = 18.0, least: float = 0.1) -> DataFrame:
    """For each label that ends or divides: the first two newborns near it, by frame and then distance."""
    space = [a for a in labels.axes if a != "t"]
    all_ = measures(labels)
    follow = steps(labels)
    ends = all_.join(follow.where("divided = 0").select("t", F.col("a").alias("label")), ["t", "label"], "left_anti")
    born = newborns(labels).select("t", "label").join(all_, ["t", "label"])
    mothers = ends.select(F.col("t").alias("mt"), F.col("label").alias("mother"), F.col("voxels").alias("mv"), *[F.col(f"mean_{a}").alias(f"m_{a}") for a in space])
    # frames are the equi-join key: a mother looks at each frame of the gap
    asked = mothers.withColumn("t", F.explode(F.sequence(F.col("mt") + 1, F.col("mt") + gap)))
    d2 = sum(((F.col(f"mean_{a}") - F.col(f"m_{a}")) ** 2 for a in space), F.lit(0.0))
    met = asked.join(born, "t").withColumn("distance", F.sqrt(d2)).where((F.col("distance") <= within) & (F.col("voxels") >= F.col("mv") * least))
    nth = F.row_number().over(Window.partitionBy("mt", "mother").orderBy("t", "distance", "label"))
    return met.withColumn("nth", nth).where("nth <= 2").select("mt", "mother", "t", "label", "distance", "nth")


def follow(labels: Grid, max_steps: int = 64, asked: DataFrame | None = None) -> DataFrame:
    """Tracks: every label from its first frame on, or the objects ``asked`` (``t``, ``label``) from theirs, step by step (``t0``, ``first``, ``t``, ``label``).

    Steps are doubled: what is known up to n frames of a track, moved on by the table of n steps, is known up to 2 n. So
    a track of n frames takes log2 n rounds.
    """
    jump = stored(steps(labels).select("t", "a", "b"), "steps")
    known = measures(labels).select("t", F.col("label").alias("a"))
    if asked is None:
        starts = known.join(jump.select((F.col("t") + 1).alias("t"), F.col("b").alias("a")), ["t", "a"], "left_anti")
    else:
        starts = known.join(asked.select("t", F.col("label").alias("a")).distinct(), ["t", "a"], "left_semi")
    out = stored(starts.select(F.col("t").alias("t0"), F.col("a").alias("first"), "t", F.col("a").alias("label")), "tracks")
    far = 1
    while True:
        further = stored(out.join(jump.withColumnRenamed("a", "label"), ["t", "label"]).select("t0", "first", (F.col("t") + far).alias("t"), F.col("b").alias("label")), "tracks")
        if further.isEmpty():
            return out
        if not further.where(F.col("t") - F.col("t0") > max_steps).isEmpty():
            raise RuntimeError(f"tracks go on past {max_steps} frames: raise max_steps")
        out = out.unionByName(further)
        onward = jump.select((F.col("t") - far).alias("t"), F.col("a").alias("b"), F.col("b").alias("end"))
        jump = stored(jump.join(onward, ["t", "b"]).select("t", "a", F.col("end").alias("b")), "steps")
        far *= 2


def boxes_around(found: DataFrame, shape: dict[str, int], margin: int) -> DataFrame:
    """``found`` (as ``measures`` gives it) with the box to look in for each object in the next frame: its own, ``margin`` wider, within the array."""
    grown = {}
    for a, n in shape.items():
        grown[f"from_{a}"] = F.greatest(F.col(f"lo_{a}") - margin, F.lit(0))
        grown[f"to_{a}"] = F.least(F.col(f"hi_{a}") + margin, F.lit(n))
    return found.withColumns(grown)


def mothers(labels: Grid, frames: int = 12, divided: float = DIVIDED, max_steps: int = 64) -> DataFrame:
    """Objects that were lost after they had collapsed, as those do that divide: ``t0``, ``first`` (the track), ``lost``, ``t``, ``label``, ``voxels``.

    A track is lost in the frame after its last, if there is such a frame. It had collapsed if its last volume is ``divided`` of the largest
    in the ``frames`` before, or less; the row is the object at that largest, the earliest of equals.
    """
    last = labels.meta.shape[labels.axes.index("t")]
    sized = follow(labels, max_steps).join(measures(labels).select("t", "label", "voxels"), ["t", "label"])
    ends = sized.groupBy("t0", "first").agg((F.max("t") + 1).alias("lost"), F.max_by("voxels", "t").alias("at_last")).where(F.col("lost") < last)
    recent = sized.join(ends, ["t0", "first"]).where(F.col("t") >= F.col("lost") - frames)
    most = recent.groupBy("t0", "first", "lost", "at_last").agg(F.max_by(F.struct("t", "label", "voxels"), F.struct("voxels", -F.col("t"))).alias("m"))
    return most.where(F.col("at_last") <= F.col("m.voxels") * divided).select("t0", "first", "lost", "m.*")


def _collapsed(sized: DataFrame, last: int, frames: int, divided: float) -> DataFrame:
    """Of tracks (``t0``, ``first``, ``t``, and what ``measures`` gives) those lost after a collapse: ``lost``, and the object ``m`` at its largest in the ``frames`` before."""
    ends = sized.groupBy("t0", "first").agg((F.max("t") + 1).alias("lost"), F.max_by("voxels", "t").alias("at_last")).where(F.col("lost") < last)
    recent = sized.join(ends, ["t0", "first"]).where(F.col("t") >= F.col("lost") - frames)
    row = F.struct(*[c for c in sized.columns if c not in ("t0", "first")])
    most = recent.groupBy("t0", "first", "lost", "at_last").agg(F.max_by(row, F.struct("voxels", -F.col("t"))).alias("m"))
    return most.where(F.col("at_last") <= F.col("m.voxels") * divided)


def lineages(labels: Grid, asked: DataFrame, max_branches: int = 8, frames: int = 12, divided: float = DIVIDED, gap: int = 24, within: float = 18.0, least: float = 0.1, max_steps: int = 64) -> DataFrame:
    """Each object ``asked`` (``t``, ``label``) followed forward and back, and forward through its divisions.

    ``t0``, ``label0`` (the object asked for), ``branch`` (0 is its own), ``mother`` (the branch it came from, null for 0), ``t``, ``label``: the branch's objects. A branch that
    collapses and is lost has as daughters the first two newborns near its largest object, as ``daughters`` finds them, in the ``gap`` frames from its loss on; each is followed in turn. Branches are
    numbered as they are met, generation by generation, and there are ``max_branches`` at most. Objects that are not there have no rows.
    """
    space = [a for a in labels.axes if a != "t"]
    last = labels.meta.shape[labels.axes.index("t")]
    sizes = stored(measures(labels).select("t", "label", "voxels", *[f"mean_{a}" for a in space]), "measures")
    asked = stored(asked.select("t", "label").distinct().join(sizes.select("t", "label"), ["t", "label"], "left_semi"), "asked")
    born = stored(newborns(labels).select("t", "label").join(sizes, ["t", "label"]), "newborns")
    ahead = follow(labels, max_steps, asked.unionByName(born.select("t", "label")))
    turned = Grid(labels.df.withColumn("t", F.lit(last - 1) - F.col("t")), labels.meta)
    back = follow(turned, max_steps, asked.select((F.lit(last - 1) - F.col("t")).alias("t"), "label"))
    back = back.where("t > t0").select((F.lit(last - 1) - F.col("t0")).alias("t0"), "first", (F.lit(last - 1) - F.col("t")).alias("t"), "label")
    own = ahead.join(asked.select(F.col("t").alias("t0"), F.col("label").alias("first")), ["t0", "first"], "left_semi").unionByName(back)
    main, tracks = (stored(x.join(sizes, ["t", "label"]), "tracks") for x in (own, ahead.join(born.select(F.col("t").alias("t0"), F.col("label").alias("first")), ["t0", "first"], "left_semi")))

    def borne(of: DataFrame) -> DataFrame:
        """``t0``, ``first`` of tracks with the ``t``, ``label`` of their daughters, and ``nth``."""
        lost = _collapsed(of, last, frames, divided)
        seen = lost.select("t0", "first", F.col("m.voxels").alias("mv"), *[F.col(f"m.mean_{a}").alias(f"m_{a}") for a in space], F.explode(F.sequence(F.col("lost"), F.least(F.col("lost") + gap, F.lit(last)) - 1)).alias("t"))
        d2 = sum(((F.col(f"mean_{a}") - F.col(f"m_{a}")) ** 2 for a in space), F.lit(0.0))
        met = seen.join(born, "t").withColumn("distance", F.sqrt(d2)).where((F.col("distance") <= within) & (F.col("voxels") >= F.col("mv") * least))
        nth = F.row_number().over(Window.partitionBy("t0", "first").orderBy("t", "distance", "label"))
        return met.withColumn("nth", nth).where("nth <= 2").select("t0", "first", "t", "label", "nth")

    of_main, of_born = stored(borne(main), "daughters"), stored(borne(tracks), "daughters")
    root = [F.col("t0").alias("rt"), F.col("first").alias("rl")]
    front = of_main.select(*root, F.lit(0).cast("long").alias("mother"), "nth", F.col("t").alias("bt"), F.col("label").alias("bl"))
    held = asked.select(F.col("t").alias("rt"), F.col("label").alias("rl"), F.lit(1).cast("long").alias("made"))
    out = main.select(*root, F.lit(0).cast("long").alias("branch"), F.lit(None).cast("long").alias("mother"), "t", "label")
    for _ in range(max_branches - 1):
        number = F.row_number().over(Window.partitionBy("rt", "rl").orderBy("mother", "nth")) - 1 + F.col("made")
        front = stored(front.join(held, ["rt", "rl"]).withColumn("branch", number.cast("long")).where(F.col("branch") < max_branches).drop("made", "nth"), "branches")
        if front.isEmpty():
            break
        out = out.unionByName(front.join(tracks.select(F.col("t0").alias("bt"), F.col("first").alias("bl"), "t", "label"), ["bt", "bl"]).select("rt", "rl", "branch", "mother", "t", "label"))
        held = held.join(front.groupBy("rt", "rl").agg((F.max("branch") + 1).alias("now")), ["rt", "rl"], "left").select("rt", "rl", F.coalesce("now", "made").alias("made"))
        step = of_born.select(F.col("t0").alias("bt"), F.col("first").alias("bl"), "nth", F.col("t").alias("nt"), F.col("label").alias("nl"))
        front = front.join(step, ["bt", "bl"]).select("rt", "rl", F.col("branch").alias("mother"), "nth", F.col("nt").alias("bt"), F.col("nl").alias("bl"))
    return out.withColumnsRenamed({"rt": "t0", "rl": "label0"})
