"""The raster pipeline as plans: overlaps, registration, adjustment by several methods, mosaics, metrics.

Pixels (scene_id, band, row, col, v) go through; each method's result is a frame, and metrics of all
methods are one plan with the method as a key.  A method that fails is reported and left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjust, graph, mosaic, overlap, quality, refine, register, stencil, tiles
from .config import Config


@dataclass
class Result:
    overlaps: DataFrame | None = None
    tree: list[tuple[int, int]] = field(default_factory=list)
    adjusted: dict[str, DataFrame] = field(default_factory=dict)
    mosaics: dict[tuple[str, str, int], DataFrame] = field(default_factory=dict)
    metrics: DataFrame | None = None
    quality: DataFrame | None = None
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return "failed" if not self.adjusted else "partial" if self.errors else "ok"


def adjusted_by(pixels: DataFrame, scenes: DataFrame, overlaps: DataFrame, n_scenes: int, n_bands: int, config: Config, kept: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> Result:
    """Every method of the configuration; the global stage is made once.  kept(name, make) says how a method's pixels are kept: written, or else in memory and on disk."""
    out = Result(overlaps=overlaps)
    pairs = [(r["i"], r["j"]) for r in overlaps.orderBy("i", "j").collect()]  # a row a pair of scenes
    out.tree = graph.spanning_tree(pairs, config.control_scene)
    first: dict[str, DataFrame] = {}

    def globally() -> DataFrame:
        if "g" not in first:
            first["g"] = adjust.adjust_global(pixels, overlaps, n_scenes, config.control_scene)[0]
        return first["g"]

    c = config.local
    local = lambda px: adjust.adjust_local(px, scenes, n_bands, c.block_size, c.lambda_param, c.rho, c.max_iter, c.tol)[0]
    plans = {
        "original": lambda: pixels,
        "global": globally,
        "global_local": lambda: local(globally()),
        "local": lambda: local(pixels),
        "moment": lambda: adjust.moment_baseline(pixels, overlaps, out.tree, config.control_scene),
        "histogram": lambda: adjust.histogram_baseline(pixels, overlaps, out.tree, config.control_scene),
        "wallis": lambda: adjust.wallis_baseline(pixels, overlaps, config.control_scene),
    }
    keep = kept or (lambda name, make: make().persist(StorageLevel.MEMORY_AND_DISK))
    for m in config.methods:
        if m not in plans:
            raise ValueError(f"unknown method {m!r}")
        try:
            out.adjusted[m] = keep(f"adjusted_{m}", plans[m])  # metrics and mosaics read it again and again
        except (ValueError, ArithmeticError) as e:
            out.errors[m] = str(e)
    return out


def evaluated(result: Result, n_bands: int) -> DataFrame:
    """method, adm, adsd, cd, rdoa, gl, ave: all methods in one plan."""
    tagged = None
    for m, px in result.adjusted.items():
        one = px.withColumn("method", F.lit(m))
        tagged = one if tagged is None else tagged.unionByName(one)
    sides = None
    for m, px in result.adjusted.items():
        one = overlap.sides(px, result.overlaps).withColumn("method", F.lit(m))
        sides = one if sides is None else sides.unionByName(one)
    summary = quality.summary(quality.per_pair_band(sides, "method"), n_bands, "method")
    if "original" not in result.adjusted:
        return summary
    return quality.with_ave(summary, stencil.gl(result.adjusted["original"], tagged, "method"), "method")


def mosaicked(result: Result, scenes: DataFrame, bands: list[int], config: Config) -> None:
    """methods x modes x feather widths."""
    grid = mosaic.canvas(scenes)
    for m, px in result.adjusted.items():
        on = mosaic.reproject(px, scenes, grid, bands)
        for mode in config.mosaic.modes:
            for width in config.mosaic.feather_widths if mode == "narrow_feather" else [0]:
                result.mosaics[m, mode, width] = mosaic.make(on, mode, width)


def matched(pixels: DataFrame, overlaps: DataFrame, band: int = 0, block: int = 512) -> DataFrame:
    """i, j, dx, dy, n_blocks, confidence, rmse, p95 a pair: from its blocks, else from its whole overlap where that is sure enough (0.3)."""
    joint = overlap.joint(pixels.filter(F.col("band") == band), overlaps)
    blocks = register.pair_shift(register.screened(register.block_matches(joint, block)).filter("reason IS NULL"))
    # An overlap is one group here: the last resort for pairs that no three blocks agree on.
    rest = joint.join(blocks.select("i", "j"), ["i", "j"], "left_anti").withColumns({"br": F.lit(0), "bc": F.lit(0)})
    whole = register.screened(rest.groupBy("i", "j", "br", "bc").applyInPandas(register.match_block, register.MATCH), 0.3).filter("reason IS NULL")
    return blocks.unionByName(whole.select("i", "j", "dx", "dy", F.lit(1).cast("long").alias("n_blocks"), "confidence", F.lit(1.0).alias("rmse"), F.lit(1.0).alias("p95")))


def registered(pixels: DataFrame, scenes: DataFrame, overlaps: DataFrame, n_scenes: int, band: int = 0, block: int = 512, control: int = 0, refine_rounds: int = 0) -> DataFrame:
    """pixels moved by the network's shifts: matches on one band, a shift a pair, weighted least squares, one warp.

    With refine_rounds, each scene next to the control is then corrected by what is left against it, from the original pixels.
    """
    pairs = [r.asDict() for r in matched(pixels, overlaps, band, block).collect()]  # a row a pair of scenes
    reached = {control} | {c for _, c in graph.spanning_tree([(p["i"], p["j"]) for p in pairs], control)}
    lost = set(range(n_scenes)) - reached
    if lost:
        raise ValueError(f"scenes {sorted(lost)} can't be matched to scene {control}")
    # A match's shift moves j onto i, so x_j - x_i equals it.
    x, _ = graph.network_adjustment(pairs, n_scenes, control)
    found = {k: (float(x[k, 0]), float(x[k, 1])) for k in range(n_scenes)}
    for k in sorted({p["i"] + p["j"] - control for p in pairs if control in (p["i"], p["j"])}) if refine_rounds else ():
        found, _ = refine.refined_shifts(pixels, scenes, overlaps, found, band, control, k, block, refine_rounds)
    shifts = pixels.sparkSession.createDataFrame([(k, *v) for k, v in found.items()], "scene_id int, dx double, dy double")
    return tiles.pixels(tiles.warp(tiles.cut(pixels), tiles.shifts(shifts), tiles.SIZE))


class Steps:
    """Results of named steps as tables below a folder, each marked when it is written: a resumed run reads what is marked and makes the rest.

    Tables and marks lie in any store that Spark writes; what a step made is read back, so that no later step makes it again.
    """

    def __init__(self, spark: SparkSession, folder: str, resume: bool = False) -> None:
        self.spark, self.folder, self.resume = spark, folder, resume
        self.conf, self.path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path

    def _mark(self, name: str):  # noqa: ANN202
        at = self.path(f"{self.folder}/.checkpoints/{name}.done")
        return at.getFileSystem(self.conf), at

    def done(self, name: str) -> bool:
        fs, at = self._mark(name)
        return bool(fs.exists(at))

    def mark(self, name: str) -> None:
        fs, at = self._mark(name)
        fs.create(at, True).close()

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        at = f"{self.folder}/steps/{name}"
        if not (self.resume and self.done(name)):
            make().write.mode("overwrite").parquet(at)
            self.mark(name)
        return self.spark.read.parquet(at)


def run(pixels: DataFrame, scenes: DataFrame, n_scenes: int, bands: list[int], config: Config, registration_band: int | None = None, steps: Steps | None = None) -> Result:
    """Overlaps, registration on a band if one is named, adjustment, data quality, metrics and mosaics; with steps, each is written and can be resumed."""
    kept = steps.table if steps else lambda name, make: make()
    overlaps = overlap.detect(scenes, config.min_overlap)
    if registration_band is not None:
        source = pixels
        pixels = kept("registered", lambda: registered(source, scenes, overlaps, n_scenes, registration_band, control=config.control_scene))
    result = adjusted_by(pixels, scenes, overlaps, n_scenes, len(bands), config, kept)
    result.metrics = kept("metrics", lambda: evaluated(result, len(bands)))
    raw = None
    for m, px in result.adjusted.items():
        one = px.withColumns({"method": F.lit(m), "nodata": F.lit(None).cast("double")})
        raw = one if raw is None else raw.unionByName(one)
    result.quality = kept("quality", lambda: quality.data_quality(raw, "method"))
    mosaicked(result, scenes, bands, config)
    for (m, mode, width), df in list(result.mosaics.items()):
        result.mosaics[m, mode, width] = kept(f"mosaic_{m}_{mode}_{width}", lambda df=df: df)
    return result
