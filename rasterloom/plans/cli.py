"""Command line: run a configuration, or a part of it, over its GeoTIFF scenes.

Verbs: multiband (everything), ablation (methods compared), sensitivity (one local parameter swept),
scale (the first n scenes), diagnostics (block coefficients), seam (quality along seams and a feather
sweep), spectral (distances), alignment (shifts between scenes), validate (a report of what holds),
sensors (each sensor's scenes by themselves).
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import time
from collections.abc import Callable
from dataclasses import replace

import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import kept, last_int
from ..operators import adjust, diagnostics, graph, mosaic, overlap, quality, refine, register, render, seamreport, spectral, stencil, tiles
from ..operators.mosaic import canvas
from ..sources import geotiff, sinks, tiffsource
from . import config as cfg
from . import pipeline


def scan(spark: SparkSession, config: cfg.Config, n: int | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """Pixels and scene table of the configuration's first n scenes, all common bands; in a smoke run, crops of them.

    Every file holds one band and all have one CRS.  A scene's bands have one shape, or are resampled to the
    registration band's grid if the configuration says so; anything else is a ValueError.
    """
    bands, scenes = cfg.common_bands(config), config.scenes[:n]
    rows = [(k, b, _absolute(cfg.band_path(s, name))) for k, s in enumerate(scenes) for b, name in enumerate(bands)]
    named = spark.createDataFrame(rows, "scene_id int, scene_band int, path string")
    at = lambda df: df.join(F.broadcast(named), "path").drop("path")  # noqa: E731  a row a file
    found = named.select("path").distinct()
    heads = at(geotiff.metadata(found)).withColumnRenamed("scene_band", "band")
    files = [r.asDict() for r in heads.orderBy("scene_id", "band").collect()]  # a row a file
    heads = spark.createDataFrame([tuple(r[c] for c in heads.columns) for r in files], heads.schema)
    resampling = config.common_bands_strategy != "strict"
    grid = bands.index(config.registration_band) if resampling else 0
    odd = _odd_files(files, grid, [s.id for s in scenes], bands, resampling)
    px = at(geotiff.pixels(geotiff.window_tiles(found, [0]))).select("scene_id", F.col("scene_band").alias("band"), "row", "col", "v")
    head = heads.filter(F.col("band") == grid).drop("band")
    if odd:
        which = spark.createDataFrame(odd, "scene_id int, band int")
        source, rest = heads.join(F.broadcast(which), ["scene_id", "band"]), px.join(F.broadcast(which), ["scene_id", "band"], "left_anti")  # a row a file
        px = rest.unionByName(mosaic.regridded(px, source, head))
    if config.smoke:
        points = _smoke_points(head, config)
        px, head = overlap.crop(px, head, points, config.smoke_crop_size), overlap.cropped_scenes(head, points, config.smoke_crop_size)
    return px.persist(StorageLevel.MEMORY_AND_DISK), head, list(range(len(bands)))


def _odd_files(files: list[dict], grid: int, ids: list[str], bands: list[str], resampling: bool) -> list[tuple[int, int]]:
    """(scene, band) of files on another grid than their scene's; what can't be put on one grid raises."""
    crs = {ids[r["scene_id"]]: r["crs"] for r in files}
    if len(set(crs.values())) > 1 or any(crs[ids[r["scene_id"]]] != r["crs"] for r in files):
        raise ValueError(f"scenes have different CRS: {crs}")
    shape, place, odd = ("n_rows", "n_cols"), ("a", "b", "c", "d", "e", "f"), []
    first = {r["scene_id"]: r for r in files if r["band"] == grid}
    for r in files:
        name, own = f"scene {ids[r['scene_id']]}, band {bands[r['band']]}", first[r["scene_id"]]
        if r["n_bands"] != 1:
            raise ValueError(f"{name}: the file has {r['n_bands']} bands, not one")
        same = all(r[k] == own[k] for k in shape)
        if not same and not resampling:
            raise ValueError(f"{name}: {r['n_rows']} x {r['n_cols']} pixels, but band {bands[grid]} has {own['n_rows']} x {own['n_cols']}")
        if resampling and not (same and all(abs(r[k] - own[k]) < 1e-9 * max(1.0, abs(own[k])) for k in place)):
            odd.append((r["scene_id"], r["band"]))
    return odd


def _smoke_points(head: DataFrame, config: cfg.Config) -> DataFrame:
    """scene_id, cx, cy of each crop: the centre of its overlaps on the spanning tree, or of itself where it has none."""
    overlaps = overlap.detect(head, config.min_overlap)
    tree = graph.tree_levels(overlaps, config.control_scene)
    on_tree = overlap.centres(head, overlaps, tree)
    return on_tree.unionByName(overlap.middles(head).join(on_tree, "scene_id", "left_anti"))


def smoke_config(spark: SparkSession, config: cfg.Config) -> cfg.Config:
    """The configuration cut to the smoke_scene_count scenes nearest to the middle of all; a control scene left out gives way to the first kept."""
    band = cfg.common_bands(config)[0]
    named = spark.createDataFrame([(k, _absolute(cfg.band_path(s, band))) for k, s in enumerate(config.scenes)], "scene_id int, path string")
    head = geotiff.metadata(named.select("path").distinct()).join(F.broadcast(named), "path")  # a row a scene
    keep = sorted(r["scene_id"] for r in overlap.nearest_scenes(head, config.smoke_scene_count).collect())
    return replace(config, smoke=True, scenes=[config.scenes[k] for k in keep], control_scene=keep.index(config.control_scene) if config.control_scene in keep else 0)


def found_scenes(spark: SparkSession, folder: str, sensor: str | None = None) -> list[cfg.Scene]:
    """Scenes below a folder, without panchromatic files, of one sensor if it is named.

    A file right in the folder is a scene of one band; files in a folder below are the bands of one scene,
    named by the last integer of their names, or by the name where it has none.
    """
    listed = geotiff.without_pan(geotiff.paths(spark, _absolute(folder)))
    listed = geotiff.of_sensor(listed, sensor) if sensor else listed
    parts = listed.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"))
    local = lambda path: re.sub("^file:/+", "/", path)
    files = [(local(r["folder"]), r["k"], r["name"], local(r["path"])) for r in parts.withColumn("k", last_int(F.col("name"))).collect()]  # a row a file
    top = local(_absolute(folder)).rstrip("/")
    scenes: dict[str, cfg.Scene] = {}
    for at, k, name, path in sorted(files, key=lambda x: (x[0], x[1] if x[1] is not None else -1, x[2])):
        flat = at == top
        scene = scenes.setdefault(path if flat else at, cfg.Scene(name if flat else at.rsplit("/", 1)[-1], sensor=sensor or ""))
        band = "B01" if flat else name if k is None else f"B{k:02d}"
        if band in scene.bands:
            raise ValueError(f"{path} and {scene.bands[band]} are both band {band}")
        scene.bands[band] = path
    out = list(scenes.values())
    twice = {s.id for s in out if sum(s.id == t.id for t in out) > 1}
    for at, s in scenes.items():
        s.id = at if s.id in twice else s.id
    return out


def _absolute(path: str) -> str:
    return path if "://" in path else os.path.abspath(path)


def written(made: DataFrame, head: DataFrame, name: str, folder: str) -> DataFrame:
    """path, bytes of a mosaic's GeoTIFF on the canvas of its scenes.  On a local or network disk all tasks write its tiles; elsewhere it must fit a task.  Parquet has no such bound."""
    grid = canvas(head).select(F.lit(0).alias("scene_id"), F.lit(name).alias("name"), "n_rows", "n_cols", F.col("res").alias("a"), F.lit(0.0).alias("b"), F.col("left").alias("c"), F.lit(0.0).alias("d"), (-F.col("res")).alias("e"), F.col("top").alias("f"))
    first = head.orderBy("scene_id").limit(1).select("crs", "nodata")
    px = made.select(F.lit(0).alias("scene_id"), "band", F.col("gr").alias("row"), F.col("gc").alias("col"), "v")
    whole = F.broadcast(grid.join(F.broadcast(first)))  # one row
    if not folder.startswith("file://"):
        return geotiff.write(px, whole, folder)
    spark = made.sparkSession
    n_bands = (px.agg(F.max("band")).first()[0] or 0) + 1
    tiffsource.register(spark)
    tiles.cut(px).join(whole, "scene_id").withColumn("n_bands", F.lit(n_bands).cast("int")).write.format("geotiff").mode("append").save(folder)
    at = folder.removeprefix("file://") + f"/{name}.tif"
    return spark.createDataFrame([(at, os.path.getsize(at))], "path string, bytes long")


def quicklook(made: DataFrame, head: DataFrame, n_bands: int, path: str, most: int = 1024) -> None:
    """A mosaic as a PNG of at most `most` pixels a side, from one level of its pyramid: bands 2, 1 and 0 as red, green and blue, or band 0 as grey."""
    size = canvas(head).first()  # one row
    px = made.select(F.lit(0).alias("scene_id"), "band", F.col("gr").alias("row"), F.col("gc").alias("col"), "v")
    image = render.png(render.quicklook(tiles.cut(px), [2, 1, 0] if n_bands > 2 else [0, 0, 0], size["n_rows"], size["n_cols"], most))
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(at) as out:
        out.write(image)


def multiband(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    """Registration on the configured band, adjustment, data quality, metrics, spectral distances and mosaics, step by step."""
    log, steps = sinks.logger(c.output_dir), pipeline.Steps(spark, _absolute(c.output_dir), a.resume)
    if a.resume and steps.done("multiband"):
        return {"status": "done before"}
    px, head, bands = scan(spark, c)
    names = cfg.common_bands(c)
    band = names.index(c.registration_band) if c.registration_band in names and not a.registered else None
    log.info("%d scenes, %d bands, registration on %s", len(c.scenes), len(bands), c.registration_band if band is not None else "none")
    result = pipeline.run(px, head, len(c.scenes), bands, c, band, steps)
    sinks.metrics_csv({"summary": result.metrics, "quality": result.quality, **_spectral_tables(result)}, f"{c.output_dir}/metrics")
    folder = f"file://{_absolute(c.output_dir)}/mosaic" if "://" not in c.output_dir else f"{c.output_dir}/mosaic"
    for (m, mode, width), df in result.mosaics.items():
        written(df, head, f"{m}_{mode}_{width}", folder).collect()  # a row a file
        quicklook(df, head, len(bands), f"{folder}/{m}_{mode}_{width}.png")
        log.info("mosaic %s %s %s", m, mode, width)
    steps.mark("multiband")
    failed = [r["method"] for r in result.quality.filter("NOT passed").select("method").distinct().collect()]  # a row a method
    return {"status": result.status, "errors": result.errors, "quality_failed": failed}


def ablation(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    px, head, bands = scan(spark, c)
    result = pipeline.adjusted_by(px, head, overlap.detect(head, c.min_overlap), len(c.scenes), len(bands), c)
    table = pipeline.evaluated(result, len(bands))
    sinks.metrics_csv({"ablation": quality.pivoted(quality.long_form(table, "adm", "adsd", "cd", "rdoa"), list(result.adjusted))}, c.output_dir)
    return {"status": result.status, "errors": result.errors}


def sensitivity(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    """One parameter at a time around the configured values; the best is that of the least rdoa."""
    px, head, bands = scan(spark, c)
    overlaps, runs = overlap.detect(head, c.min_overlap), None
    for param, values in c.sweep.items():
        for v in values:
            local = cfg.Local(**{**c.local.__dict__, param: v})
            one = pipeline.adjusted_by(px, head, overlaps, len(c.scenes), len(bands), cfg.Config(methods=["global_local"], local=local, control_scene=c.control_scene))
            row = pipeline.evaluated(one, len(bands)).select(F.lit(param).alias("param"), F.lit(float(v)).alias("value"), F.col("rdoa").alias("ave"))
            runs = row if runs is None else runs.unionByName(row)
    sinks.metrics_csv({"sensitivity": runs, "best": quality.best_of(runs, "value", "ave", "param")}, c.output_dir)
    return {"status": "ok"}


def scale(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    """Seconds for the first n scenes, for each configured n that there are scenes for."""
    took = {}
    for n in sorted({n for n in c.scale_scene_counts if 2 <= n <= len(c.scenes)}):
        began = time.time()
        px, head, bands = scan(spark, c, n)
        pipeline.evaluated(pipeline.adjusted_by(px, head, overlap.detect(head, c.min_overlap), n, len(bands), c), len(bands)).count()
        took[n] = round(time.time() - began, 3)
    return {"status": "ok", "seconds": took}


def diagnose(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    px, head, bands = scan(spark, c)
    p = c.local
    after, blocks, coef = adjust.adjust_local(px, head, len(bands), p.block_size, p.lambda_param, p.rho, p.max_iter, p.tol)
    where = blocks.select("block_id", "gm", "gn", "cx", "cy").distinct()
    sinks.metrics_csv({"coefficients": diagnostics.coefficient_report(coef), "steps": diagnostics.neighbour_steps(coef, where), "overenhanced": diagnostics.overenhanced(px, after, p.block_size)}, c.output_dir)
    sinks.geojson(diagnostics.coefficient_outliers(coef, where), "cx", "cy", f"{c.output_dir}/outliers")
    return {"status": "ok"}


def seam(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    """Quality along the middle seams of all overlaps, in every band, and what feathering them costs in texture."""
    px, head, _ = scan(spark, c)
    o = kept(overlap.detect(head, c.min_overlap))
    both = tiles.joint_pixels(tiles.joint(tiles.cut(px), o, tiles.SIZE)).persist(StorageLevel.MEMORY_AND_DISK)
    lines = seamreport.middles(o)
    tables = {"seams": seamreport.reports(both, o), "length": lines.select("i", "j", F.col("rows").cast("double").alias("length"))}
    side = lambda k, v: both.select("i", "j", F.lit(k).alias("side"), "band", F.col("r").alias("row"), F.col("c").alias("col"), F.col(v).alias("v"))
    sides = side("i", "vi").unionByName(side("j", "vj"))
    for kind in ("tenengrad", "laplacian"):
        tables[f"sharpness_{kind}"] = stencil.sharpness(sides, kind, ("i", "j", "side", "band"))
    if c.mosaic.feather_widths:
        widths = c.mosaic.feather_widths
        tables["sweep"] = seamreport.sweep(both, o, widths)
        # An overlap and width as a scene of its own.
        as_scene = lambda i, j, k: (F.col(i) * len(c.scenes) + F.col(j)) * len(widths) + k
        place = F.array_position(F.array(*map(F.lit, widths)), F.col("width")).cast("int") - 1
        mixed = seamreport.blended(both, lines, widths).select(as_scene("i", "j", place).alias("scene_id"), "band", F.col("r").alias("row"), F.col("c").alias("col"), "v", "d", "width")
        plain = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(widths) - 1)))).select(as_scene("i", "j", F.col("k")).alias("scene_id"), "band", F.col("r").alias("row"), F.col("c").alias("col"), F.col("vi").alias("v"))
        zone = mixed.filter("band = 0 AND abs(d) <= width").select("scene_id", "row", "col")
        lost, pair, k = stencil.texture_loss(plain, mixed.drop("d", "width"), zone), F.floor(F.col("scene_id") / len(widths)), F.col("scene_id") % len(widths)
        tables["texture_loss"] = lost.select(F.floor(pair / len(c.scenes)).cast("int").alias("i"), (pair % len(c.scenes)).cast("int").alias("j"), "band", F.get(F.array(*map(F.lit, widths)), k.cast("int")).alias("width"), "loss")
    sinks.metrics_csv(tables, c.output_dir)
    both.unpersist()
    return {"status": "ok"}


def _spectral_tables(result: pipeline.Result) -> dict[str, DataFrame]:
    """All spectral distances of each method from the original, where the run has it."""
    vector = lambda df, n: df.groupBy("scene_id", "row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", F.coalesce("v", F.lit(float("nan"))).alias("v")))), lambda x: x["v"]).alias(n))
    tables, first = {}, result.adjusted.get("original")
    for m, df in result.adjusted.items() if first is not None else ():
        if m == "original":
            continue
        pair = spectral.usable(vector(first, "o").join(vector(df, "n"), ["scene_id", "row", "col"])).withColumn("pixel_id", F.struct("scene_id", "row", "col"))
        tables[f"sam_{m}"] = spectral.described(spectral.sam(pair), "sam", "scene_id")
        tables[f"rmse_{m}"] = spectral.described(spectral.rmse(pair), "rmse", "scene_id")
        tables[f"relative_rmse_{m}"] = spectral.described(spectral.relative_rmse(pair), "rel", "scene_id")
        tables[f"correlation_{m}"] = spectral.band_correlation(pair)
        n_bands = pair.select(F.size("o").alias("n")).limit(1).collect()
        if n_bands and n_bands[0]["n"] > 1:
            ratios = [(k, k + 1) for k in range(n_bands[0]["n"] - 1)]
            tables[f"band_ratio_{m}"] = spectral.described(spectral.band_ratio_error(pair, ratios), "err", "a", "b")
            tables[f"structure_{m}"] = spectral.frobenius(spectral.correlation_matrices(pair.select("pixel_id", "o", "n")))
    return tables


def spectra(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    px, head, bands = scan(spark, c)
    result = pipeline.adjusted_by(px, head, overlap.detect(head, c.min_overlap), len(c.scenes), len(bands), c)
    sinks.metrics_csv(_spectral_tables(result), c.output_dir)
    return {"status": result.status}


def alignment(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    """How far the scenes lie apart: shifts of whole patches, and agreement under whole-pixel moves."""
    px, head, _ = scan(spark, c)
    joint = overlap.joint(px.filter("band = 0"), overlap.detect(head, c.min_overlap))
    patches = refine.patch_shifts(joint, a.patch)
    by_pair = patches.groupBy("i", "j").agg(F.median("dx").alias("dx"), F.median("dy").alias("dy"), F.stddev_pop("dx").alias("sd_dx"), F.stddev_pop("dy").alias("sd_dy"), F.count(F.lit(1)).alias("n"))
    sinks.metrics_csv({"patches": patches, "pairs": by_pair, "agreement": refine.difference_by_shift(joint)}, f"{c.output_dir}/alignment")
    return {"status": "ok"}


def validate(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    """A run stage by stage against what each must hold: scenes read, overlaps, one network, registration better than before, finite results, lower errors."""
    log, held = sinks.logger(c.output_dir), {}
    px, head, bands = scan(spark, c)
    overlaps = overlap.detect(head, c.min_overlap)
    pairs = [(r["i"], r["j"]) for r in overlaps.orderBy("i", "j").collect()]  # a row a pair of scenes
    held["scenes"] = head.count() == len(c.scenes)
    held["overlaps"] = bool(pairs)
    held["network"] = len(graph.spanning_tree(pairs, c.control_scene)) == len(c.scenes) - 1
    names = cfg.common_bands(c)
    moved, errors = px, {}
    if held["network"] and c.registration_band in names and not a.registered:
        apart = lambda p: refine.edge_quality(register.screened(register.block_matches(overlap.joint(p.filter(F.col("band") == names.index(c.registration_band)), overlaps), a.patch)).filter("reason IS NULL")).agg(F.avg("magnitude").alias("m")).first()["m"]
        try:
            moved = pipeline.registered(px, head, overlaps, len(c.scenes), names.index(c.registration_band), a.patch, c.control_scene).persist(StorageLevel.MEMORY_AND_DISK)
            before, after = apart(px), apart(moved)
            held["registration"] = after is not None and after <= max(0.5, before or 0.0)
        except ValueError as e:
            held["registration"], errors["registration"] = False, str(e)
    result = pipeline.adjusted_by(moved, head, overlaps, len(c.scenes), len(bands), c)
    errors |= result.errors
    table = {r["method"]: r["rdoa"] for r in pipeline.evaluated(result, len(bands)).collect()}  # a row a method
    held["methods"] = not result.errors
    held["finite"] = all(quality.data_quality(p.withColumn("nodata", F.lit(None).cast("double"))).filter("NOT passed").isEmpty() for p in result.adjusted.values())
    held["adjustment"] = all(v <= table["original"] for m, v in table.items() if m != "local") if "original" in table else True
    pipeline.mosaicked(result, head, bands, c)
    held["mosaics"] = all(df.filter("isnan(v) OR abs(v) = double('inf')").isEmpty() and not df.isEmpty() for df in result.mosaics.values())
    for k, ok in held.items():
        log.info("%s: %s", k, "passed" if ok else "FAILED")
    sinks.record(c.output_dir, "validation", {"held": held, "rdoa": table, "errors": errors})
    return {"status": "ok" if all(held.values()) else "failed", "held": held, "errors": errors}


def sensors(spark: SparkSession, c: cfg.Config, a: argparse.Namespace) -> dict:
    """The comparison of methods for each sensor's scenes by themselves, and one table of all."""
    every, out = None, {}
    for sensor in sorted({s.sensor for s in c.scenes}):
        own = replace(c, scenes=[s for s in c.scenes if s.sensor == sensor], control_scene=0)
        if len(own.scenes) < 2:
            out[sensor] = "too few scenes"
            continue
        px, head, bands = scan(spark, own)
        result = pipeline.adjusted_by(px, head, overlap.detect(head, own.min_overlap), len(own.scenes), len(bands), own)
        table = pipeline.evaluated(result, len(bands)).withColumn("sensor", F.lit(sensor))
        every = table if every is None else every.unionByName(table, allowMissingColumns=True)
        out[sensor] = result.status
    if every is not None:
        sinks.metrics_csv({"sensors": every}, c.output_dir)
    return {"status": "ok" if every is not None else "failed", "sensors": out}


VERBS: dict[str, Callable[[SparkSession, cfg.Config, argparse.Namespace], dict]] = {
    "multiband": multiband, "ablation": ablation, "sensitivity": sensitivity, "scale": scale, "diagnostics": diagnose, "seam": seam, "spectral": spectra,
    "alignment": alignment, "validate": validate, "sensors": sensors,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--output-dir")
    p.add_argument("--methods", help="names, separated by commas")
    p.add_argument("--folder", help="take the scenes found below this folder, not the configured ones")
    p.add_argument("--sensor", help="with --folder: only files whose path names this sensor")
    p.add_argument("--scene-count", help="scale: numbers of scenes, separated by commas")
    p.add_argument("--smoke", action="store_true", help="a trial run: few scenes, cropped around their overlaps")
    p.add_argument("--dry-run", action="store_true", help="validate only")
    p.add_argument("--resume", action="store_true", help="read what an earlier run wrote, step by step")
    p.add_argument("--registered", action="store_true", help="the scenes lie on each other already: no registration")
    p.add_argument("--patch", type=int, default=512, help="size of the patches and blocks that alignment and validate match")
    p.add_argument("verb", choices=list(VERBS))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    c = cfg.load(a.config)
    if a.output_dir:
        c.output_dir = a.output_dir
    if a.methods:
        c.methods = [m.strip() for m in a.methods.split(",") if m.strip()]
    if a.scene_count:
        c.scale_scene_counts = [int(n) for n in a.scene_count.split(",")]
    if a.folder:
        c.scenes = found_scenes(SparkSession.builder.appName("rasterloom").getOrCreate(), a.folder, a.sensor)
    found = cfg.problems(c)
    for x in found:
        print(x, file=sys.stderr)
    if found or a.dry_run:
        return 2 if found else 0
    sinks.record(c.output_dir, "environment", sinks.environment())
    spark = SparkSession.builder.appName("rasterloom").getOrCreate()
    if a.smoke or c.smoke:
        c = smoke_config(spark, c)
    said = VERBS[a.verb](spark, c, a)
    sinks.record(c.output_dir, "summary", said)
    sinks.log_text(c.output_dir, {"verb": a.verb, **said})
    return 1 if said["status"] == "failed" else 0


if __name__ == "__main__":
    sys.exit(main())
