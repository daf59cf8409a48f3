"""Filling a region from a line to the stops of its rays: a list of border stages, their trace, and their comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.constants import ACROSS_BIN_UM

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(border: DataFrame, stages: list[Stage]) -> DataFrame:
    """The border after every stage in turn; a stage is any function from border to border."""
    for _, stage in stages:
        border = stage(border)
    return border


def staged(border: DataFrame, settings: dict[str, list[Stage]]) -> DataFrame:
    """Diagnostic trace: the border as it leaves each stage of each setting."""
    traces = []
    for setting, stages in settings.items():
        now = border
        for name, stage in stages:
            now = stage(now)
            traces.append(now.select(F.lit(setting).alias("setting"), F.lit(name).alias("stage"), "image", "ray", "stop"))
    out = traces[0]
    for trace in traces[1:]:
        out = out.unionByName(trace)
    return out


def painted(cells: DataFrame, border: DataFrame) -> DataFrame:
    """Pixels in front of their ray's stop."""
    return cells.join(border.select("image", "ray", "stop"), ["image", "ray"]).filter(F.col("step") < F.col("stop")).drop("stop")


def compare_decodes(first: DataFrame, second: DataFrame, truth: DataFrame, judged: Column, least: int) -> DataFrame:
    """Median distance of two decodes from the drawn border on the judged rays, how often the second is closer, and its bias."""
    joined = first.select("image", "ray", F.col("stop").alias("a")).join(second.select("image", "ray", F.col("stop").alias("b")), ["image", "ray"]).join(
        truth, ["image", "ray"]).filter(judged)
    ea, eb = F.abs(F.col("a") - F.col("truth")) * ACROSS_BIN_UM, F.abs(F.col("b") - F.col("truth")) * ACROSS_BIN_UM
    made = joined.groupBy("image").agg(
        F.count("*").alias("rays"), F.percentile(ea, 0.5).alias("first_error"), F.percentile(eb, 0.5).alias("second_error"),
        F.avg((eb < ea).cast("int")).alias("better"), F.percentile((F.col("b") - F.col("truth")) * ACROSS_BIN_UM, 0.5).alias("bias"))
    return made.filter(F.col("rays") >= least)
