"""CSV, JSON and GeoJSON sinks for metric tables, and the run's own small records."""

from __future__ import annotations

import json
import logging
import math
import platform
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """A CSV folder a table (summary, per_band, per_pair, per_pair_band): header, nulls as empty fields; maps and structs as JSON."""
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(f"{folder}/{name}")


def append_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("append").option("header", True).option("nullValue", "").csv(folder)


def json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def features(df: DataFrame, x: str, y: str) -> DataFrame:
    """value: a GeoJSON point feature a row, other columns as properties."""
    rest = F.struct(*[F.col(c) for c in df.columns if c not in (x, y)])
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), rest.alias("properties"))).alias("value"))


def geojson(df: DataFrame, x: str, y: str, folder: str) -> None:
    """Newline-delimited features, which GeoJSON readers take as a sequence."""
    features(df, x, y).write.mode("overwrite").text(folder)


def environment() -> dict:
    import numpy
    import pyspark

    return {"python": sys.version.split()[0], "platform": platform.platform(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}


def record(folder: str, name: str, content: dict) -> None:
    """A small JSON record on the driver: environment, summary, run log."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / f"{name}.json").write_text(json.dumps(finite(content), indent=2, default=str, allow_nan=False))


def finite(x):  # noqa: ANN001, ANN201
    """x with NaN and infinities as null and numpy numbers as plain ones, as JSON has neither."""
    if isinstance(x, dict):
        return {str(k): finite(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [finite(v) for v in x]
    x = x.item() if hasattr(x, "item") and getattr(x, "ndim", 1) == 0 else x
    return None if isinstance(x, float) and not math.isfinite(x) else x


def logger(folder: str, name: str = "rasterloom", level: int = logging.INFO) -> logging.Logger:
    """A logger to the folder's run.log and to the console; one handler each, however often it is asked for."""
    out = logging.getLogger(name)
    out.setLevel(level)
    Path(folder).mkdir(parents=True, exist_ok=True)
    file = str((Path(folder) / "run.log").resolve())
    for h in [h for h in out.handlers if isinstance(h, logging.FileHandler) and h.baseFilename != file]:
        out.removeHandler(h)
        h.close()
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    if not any(isinstance(h, logging.FileHandler) for h in out.handlers):
        out.addHandler(logging.FileHandler(file))
    if not any(type(h) is logging.StreamHandler for h in out.handlers):
        out.addHandler(logging.StreamHandler())
    for h in out.handlers:
        h.setFormatter(form)
    return out


def log_text(folder: str, content: dict) -> None:
    """The run log for reading: a section a key."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    lines = []
    for k, v in content.items():
        lines += [f"== {k}", *(f"{a}: {b}" for a, b in v.items())] if isinstance(v, dict) else [f"{k}: {v}"]
    (Path(folder) / "run_log.txt").write_text("\n".join(lines) + "\n")
