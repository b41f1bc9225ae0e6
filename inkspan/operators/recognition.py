"""Recognition: decoding of class scores, boxes of detected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.geometry import rounded, unclip_pad

PROBABILITY, BOX, SIDE = 0.3, 0.6, 3


def ctc_decode(steps: DataFrame, line: list[str], alphabet: list[str], *, scores: str = "scores", step: str = "step") -> DataFrame:
    """line, text: the best class of each step (the first of ties), repeats of the step before and blanks (class 0) dropped.

    Classes beyond the alphabet are dropped too, but part repeats like any other.
    """
    best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    w = Window.partitionBy(*line).orderBy(step)
    rows = steps.select(*line, step, best.alias("class")).withColumn("before", F.lag("class").over(w))
    char = F.try_element_at(F.array(*map(F.lit, alphabet)), F.col("class") + 1)
    shown = F.when((F.col("class") > 0) & (F.col("class") < len(alphabet)) & (F.col("before").isNull() | (F.col("before") != F.col("class"))), char)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct(F.col(step), shown.alias("c"))))), lambda x: x["c"]), "")
    return rows.groupBy(*line).agg(F.btrim(text, F.lit(" \t\n\r")).alias("text"))


def component_boxes(pixels: DataFrame, component: list[str]) -> DataFrame:
    """Of each component's pixels (x, y, p): extents, area, mean probability, pad, and whether it is kept."""
    rows = pixels.groupBy(*component).agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("area"), F.avg("p").alias("p"))
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    return rows.withColumns({"w": w, "h": h, "pad": unclip_pad(F.col("area"), w, h), "kept": (F.col("p") >= BOX) & (w >= SIDE) & (h >= SIDE)})


def component_axes(pixels: DataFrame, component: list[str]) -> DataFrame:
    """component, cx, cy, theta, min_u, max_u, min_v, max_v, min_x, max_x, min_y, max_y: the principal axis by population moments, extents along and across it, and upright ones.

    Pixels of one y reach their extremes along any axis at their least and greatest x, so only
    these ends are joined to the axis; merged, as sizes estimated before a kernel ran would let the
    planner broadcast either side. Moments are taken of all pixels as they come: where a
    component is symmetric, rounding in that order decides the sign of a right angle.
    """
    axis = pixels.groupBy(*component).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("theta"))
    ends = pixels.groupBy(*component, "y").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    rows = ends.join(axis.hint("merge"), component)
    dx, dy = [F.col(x) - F.col("cx") for x in ("first", "last")], F.col("y") - F.col("cy")
    u, v = ([d * F.cos("theta") + dy * F.sin("theta") for d in dx], [dy * F.cos("theta") - d * F.sin("theta") for d in dx])
    rows = rows.select(*component, "cx", "cy", "theta", "first", "last", "y", *(f(*of).alias(f"{n}_{k}") for k, of in (("u", u), ("v", v)) for n, f in (("min", F.least), ("max", F.greatest))))
    extents = {"u": ("min_u", "max_u"), "v": ("min_v", "max_v"), "x": ("first", "last"), "y": ("y", "y")}
    return rows.groupBy(*component, "cx", "cy", "theta").agg(*(f(c).alias(f"{n}_{k}") for k, (low, high) in extents.items() for n, f, c in (("min", F.min, low), ("max", F.max, high))))


def elongated(w: Column, h: Column) -> Column:
    """Whether a component is long enough to be turned upright."""
    return w > 2 * h


def oriented_polygon(pad: Column, scale_x: float, scale_y: float) -> dict[str, Column]:
    """px, py: corners of each component along its axis, ``pad`` beyond its extents, in the source picture."""
    u, v = ("min_u", "max_u", "max_u", "min_u"), ("min_v", "min_v", "max_v", "max_v")
    side = lambda c: F.col(c) + (pad if c.startswith("max") else -pad)
    x = lambda a, b: rounded((F.col("cx") + side(a) * F.cos("theta") - side(b) * F.sin("theta")) * scale_x).cast("int")
    y = lambda a, b: rounded((F.col("cy") + side(a) * F.sin("theta") + side(b) * F.cos("theta")) * scale_y).cast("int")
    return {"px": F.array(*map(x, u, v)), "py": F.array(*map(y, u, v))}
