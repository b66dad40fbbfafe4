"""Which scene points a camera sees, and how much of the scene a path covers.

Points are hashed to grid cells, and cells to a pyramid of cells four times as wide a level.
Cameras meet the few cells at the top of their scene and descend: a cell is tested as a bounding
sphere against the viewing frustum, which never rejects a visible one, and only survivors meet
their children.  The points of surviving cells are joined last, by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import pose
from wayfold.functions.ordering import position_chunk, running
from wayfold.session import materialize


WIDER = 4  # cells of one level along an axis of a cell of the next


def cell_pyramid(points: DataFrame, cell: float) -> tuple[DataFrame, int]:
    """(scene_id, level, gx, gy, gz, px, py, pz, mx, my, mz, rad) of all occupied cells, and the top level.

    ``p`` names the parent a level up, ``m`` and ``rad`` the sphere around the points.  At the top
    a scene has eight cells at most.
    """
    box = [f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    p = points.select("scene_id", *[F.floor(F.col(a) / cell).alias(f"g{a}") for a in "xyz"], "x", "y", "z")
    fine = materialize(p.groupBy("scene_id", "gx", "gy", "gz").agg(*box))
    span = fine.groupBy("scene_id").agg(F.greatest(*[F.max(f"g{a}") - F.min(f"g{a}") for a in "xyz"]).alias("w")).agg(F.max("w")).first()[0]
    top = 0
    while WIDER ** top <= (span or 0):
        top += 1

    def at(level):
        wide = F.lit(WIDER).cast("double") ** level
        return [F.floor(F.col(f"g{a}") / wide) for a in "xyz"]
    c = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    c = c.withColumns({f"p{a}": g for a, g in zip("xyz", at(F.col("level") + 1))} | {f"g{a}": g for a, g in zip("xyz", at(F.col("level")))})
    key = ["scene_id", "level", "gx", "gy", "gz", "px", "py", "pz"]
    c = c.groupBy(*key).agg(*[f(f"{n}{a}").alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    side = [F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"]
    radius = F.sqrt(sum((d * d for d in side), F.lit(0.0))) / 2
    return materialize(c.select(*key, *[((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2).alias(f"m{a}") for a in "xyz"], radius.alias("rad"))), top


def descend(cams: DataFrame, pyramid: DataFrame, top: int, may_see: Column) -> list[DataFrame]:
    """Cells (camera columns, gx, gy, gz) that pass ``may_see``, level by level from the top; the last are the finest."""
    own = cams.columns
    front, levels = None, []
    for level in range(top, -1, -1):
        c = pyramid.filter(F.col("level") == level).drop("level")
        if front is None:
            met = cams.join(c, "scene_id")
        else:
            met = front.withColumnsRenamed({f"g{a}": f"p{a}" for a in "xyz"}).join(c, ["scene_id", "px", "py", "pz"])
        front = met.filter(may_see).select(*own, "gx", "gy", "gz")
        levels.append(front)
    return levels


def visible_points(cameras: DataFrame, points: DataFrame, width: int, height: int, focal: float, cell: float, near: float = 0.05,
                   eps: float = 0.05) -> DataFrame:
    """(cam_id, vid) pairs: in front, inside the image, and within ``eps`` of the nearest depth at the pixel."""
    p = points.select("scene_id", "vid", "x", "y", "z", *[F.floor(F.col(a) / cell).alias(f"g{a}") for a in "xyz"])
    rot = pose.rotation_of("")
    cams = cameras.select("cam_id", "scene_id", *pose.position_of(""), *[rot[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])

    def in_camera(names):
        d = [F.col(n) - F.col(t) for n, t in zip(names, ("tx", "ty", "tz"))]
        return [sum((F.col(f"r{i}{j}") * d[i] for i in range(3)), F.lit(0.0)) for j in range(3)]

    cx, cy, cz = in_camera(("mx", "my", "mz"))
    reach = cz + F.col("rad")
    may_see = (reach > near) & (F.abs(cx) - F.col("rad") <= reach * (width / 2 / focal)) & (F.abs(cy) - F.col("rad") <= reach * (height / 2 / focal))
    near_cells = descend(cams, *cell_pyramid(points, cell), may_see)[-1]
    px, py, pz = in_camera(("x", "y", "z"))
    seen = near_cells.join(p, ["scene_id", "gx", "gy", "gz"]).select("cam_id", "vid", px.alias("px"), py.alias("py"), pz.alias("depth")).filter(F.col("depth") > near)
    seen = seen.select("cam_id", "vid", "depth", F.floor(focal * F.col("px") / F.col("depth") + width / 2).alias("u"), F.floor(focal * F.col("py") / F.col("depth") + height / 2).alias("v"))
    seen = seen.filter((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))
    front = seen.groupBy("cam_id", "u", "v").agg(F.min("depth").alias("front"))
    return seen.join(front, ["cam_id", "u", "v"]).filter(F.abs(F.col("depth") - F.col("front")) < eps).select("cam_id", "vid")


def coverage_curve(visible: DataFrame, cameras: DataFrame, points: DataFrame) -> DataFrame:
    """Per path and turn: distinct points so far, new ones, share of the scene, and the same for the target view.

    ``cameras`` carries (cam_id, traj_id, scene_id, turn, is_target); turn 0 may have several cameras.
    """
    v = materialize(visible.join(cameras.select("cam_id", "traj_id", "turn", "is_target"), "cam_id"))
    target = v.filter("is_target").select("traj_id", "vid", F.lit(1).alias("hit")).distinct()
    first = v.filter("NOT is_target").groupBy("traj_id", "vid").agg(F.min("turn").alias("turn")).join(target, ["traj_id", "vid"], "left")
    new = first.groupBy("traj_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("h"))
    turns = cameras.filter("NOT is_target").select("traj_id", "scene_id", "turn").distinct()
    t = turns.join(new, ["traj_id", "turn"], "left").fillna(0, ["n", "h"])
    t = running(t, ["traj_id"], ["turn"], F.col("n"), "covered", position_chunk("turn"))
    t = running(t, ["traj_id"], ["turn"], F.col("h"), "target_covered", position_chunk("turn"))
    total = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("total"))
    return t.join(total, "scene_id").select("traj_id", "turn", "covered", F.col("n").alias("increment"), (F.col("covered") / F.col("total")).alias("ratio"),
                                            "target_covered", F.col("h").alias("target_increment"))


def visual_overlap(visible: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared points of two views over the first, over the second and over their union, for ``(pair_id, cam_a, cam_b)``."""
    a = pairs.join(visible.withColumnRenamed("cam_id", "cam_a"), "cam_a").select("pair_id", "vid", F.lit(1).alias("in_a"))
    b = pairs.join(visible.withColumnRenamed("cam_id", "cam_b"), "cam_b").select("pair_id", "vid", F.lit(1).alias("in_b"))
    g = a.join(b, ["pair_id", "vid"], "full").groupBy("pair_id").agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count(F.lit(1)).alias("n_any"))
    both = F.col("n_a") + F.col("n_b") - F.col("n_any")
    return g.select("pair_id", both.alias("n_both"), F.coalesce(F.try_divide(both, "n_a"), F.lit(0.0)).alias("over_first"),
                    F.coalesce(F.try_divide(both, "n_b"), F.lit(0.0)).alias("over_second"), F.coalesce(F.try_divide(both, "n_any"), F.lit(0.0)).alias("iou"))


def overlap_value_stats(visible: DataFrame, values: DataFrame) -> DataFrame:
    """Per scene: count and mean value of points seen in several views and in exactly one."""
    n = visible.groupBy("vid").agg(F.count(F.lit(1)).alias("views"))
    many = F.col("views") >= 2
    return n.join(values, "vid").groupBy("scene_id").agg(
        F.count_if(many).alias("n_overlap"), F.count_if(~many).alias("n_single"), F.avg(F.when(many, F.col("value"))).alias("mean_overlap"),
        F.avg(F.when(~many, F.col("value"))).alias("mean_single"))
