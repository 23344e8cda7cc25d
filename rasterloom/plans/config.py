"""Run configuration: YAML in and out, coercion with defaults, and validation as a list of messages."""

from __future__ import annotations

import os
import warnings
from dataclasses import asdict, dataclass, field, fields, is_dataclass

import yaml

METHODS = ("original", "global", "global_local", "local", "moment", "histogram", "wallis")
MODES = ("weighted", "source_selection", "narrow_feather")
STRATEGIES = ("strict", "resample_to_registration_grid")


@dataclass
class Scene:
    id: str = ""
    datetime: str = ""
    sensor: str = ""
    bands: dict[str, str] = field(default_factory=dict)


#: Values that the sensitivity verb tries, one parameter at a time.
SWEEP = {"block_size": (200, 400, 600), "lambda_param": (0.1, 0.3, 0.5, 0.7, 0.9), "rho": (0.5, 1.0, 2.0)}


@dataclass
class Local:
    block_size: int = 400
    lambda_param: float = 0.5
    rho: float = 1.0
    max_iter: int = 200
    tol: float = 1e-4


@dataclass
class Mosaic:
    modes: list[str] = field(default_factory=lambda: ["weighted"])
    feather_widths: list[int] = field(default_factory=lambda: [64])


@dataclass
class Config:
    name: str = "run"
    output_dir: str = "out"
    selected_bands: list[str] = field(default_factory=list)
    registration_band: str = ""
    rgb_bands: list[str] = field(default_factory=list)
    control_scene: int = 0
    min_overlap: int = 1000
    strict: bool = True
    methods: list[str] = field(default_factory=lambda: ["original", "global", "global_local"])
    scenes: list[Scene] = field(default_factory=list)
    local: Local = field(default_factory=Local)
    mosaic: Mosaic = field(default_factory=Mosaic)
    sweep: dict[str, list[float]] = field(default_factory=lambda: {k: list(v) for k, v in SWEEP.items()})
    common_bands_strategy: str = "strict"
    scale_scene_counts: list[int] = field(default_factory=lambda: [2, 4, 6])
    smoke: bool = False
    smoke_scene_count: int = 5
    smoke_crop_size: int = 512


def _filled(kind: type, raw: dict | None):  # noqa: ANN202
    """kind from a mapping: known keys coerced to their field's type, unknown ones warned of and left out."""
    out, known = kind(), {f.name: f for f in fields(kind)}
    for k, v in (raw or {}).items():
        if k not in known:
            warnings.warn(f"unknown setting {k!r} in {kind.__name__.lower()}", stacklevel=2)
            continue
        now = getattr(out, k)
        if is_dataclass(now):
            v = _filled(type(now), v)
        elif k == "scenes":
            v = [_filled(Scene, s) for s in v or []]
        elif isinstance(now, bool):
            v = bool(v)
        elif isinstance(now, (int, float, str)) and v is not None:
            v = type(now)(v)
        setattr(out, k, v if v is not None else now)
    return out


def load(path: str) -> Config:
    """An empty file gives the defaults.  control_scene is a place in the list, a scene's id, or auto, the first; an unknown id gets the place -1."""
    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    ids = [str(x.get("id", "")) for x in raw.get("scenes") or []]
    control = raw.get("control_scene")
    if isinstance(control, str):
        raw["control_scene"] = 0 if control in ("", "auto") else ids.index(control) if control in ids else int(control) if control.isdigit() else -1
    return _filled(Config, raw)


def save(config: Config, path: str) -> None:
    with open(path, "w") as f:
        yaml.safe_dump(asdict(config), f, sort_keys=False, allow_unicode=True)


def band_path(scene: Scene, band: str) -> str:
    if band not in scene.bands:
        raise KeyError(f"scene {scene.id} has no band {band}")
    return scene.bands[band]


def common_bands(config: Config) -> list[str]:
    """Bands that all scenes have, in the selected order, or in the first scene's if none are selected.

    Resampling to the registration band's grid needs that band in every scene.
    """
    sets = [set(s.bands) for s in config.scenes]
    if config.common_bands_strategy == STRATEGIES[1]:
        without = [s.id for s in config.scenes if config.registration_band not in s.bands]
        if without:
            raise ValueError(f"scenes {without} have no registration band {config.registration_band!r} to resample to")
    order = config.selected_bands or (list(config.scenes[0].bands) if config.scenes else [])
    return [b for b in order if all(b in s for s in sets)]


def missing_bands(scenes: list[Scene], wanted: list[str]) -> list[str]:
    return [f"scene {s.id}: missing band {b}" for s in scenes for b in wanted if b not in s.bands]


def problems(config: Config, files: bool = True) -> list[str]:
    """What is wrong with a configuration; empty if nothing is."""
    out = [] if config.name else ["name is empty"]
    if len(config.scenes) < 2:
        out.append("at least two scenes are needed")
    ids = [s.id for s in config.scenes]
    out += [f"scene id {i!r} is used twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    if config.selected_bands and config.registration_band and config.registration_band not in config.selected_bands:
        out.append(f"registration band {config.registration_band!r} is not selected")
    if config.rgb_bands and len(config.rgb_bands) != 3:
        out.append("rgb_bands names three bands")
    out += missing_bands(config.scenes, config.selected_bands)
    out += [f"unknown method {m!r}" for m in config.methods if m not in METHODS]
    out += [f"unknown mosaic mode {m!r}" for m in config.mosaic.modes if m not in MODES]
    out += [f"feather width {w} is not positive" for w in config.mosaic.feather_widths if w <= 0]
    limits = {"block_size": config.local.block_size > 0, "lambda_param": config.local.lambda_param > 0, "rho": config.local.rho > 0, "max_iter": config.local.max_iter > 0, "tol": config.local.tol > 0}
    out += [f"local.{k} is out of range" for k, ok in limits.items() if not ok]
    if config.scenes and not 0 <= config.control_scene < len(config.scenes):
        out.append(f"control scene {config.control_scene} does not exist")
    if config.common_bands_strategy not in STRATEGIES:
        out.append(f"unknown common_bands_strategy {config.common_bands_strategy!r}")
    elif config.common_bands_strategy == STRATEGIES[1]:
        out += [f"scene {s.id}: missing registration band {config.registration_band!r}" for s in config.scenes if config.registration_band not in s.bands]
    out += [f"{k} is not positive" for k in ("smoke_scene_count", "smoke_crop_size") if getattr(config, k) <= 0]
    out += [f"scale_scene_counts: {n} is not positive" for n in config.scale_scene_counts if n <= 0]
    if files:
        out += [f"no file {p}" for s in config.scenes for p in s.bands.values() if "://" not in p and not os.path.exists(p)]
    return out


def sample(ids: tuple[str, ...] = ("s0", "s1"), n_bands: int = 4) -> Config:
    """A small valid configuration."""
    bands = [f"B{k + 1:02d}" for k in range(n_bands)]
    return Config(name="sample", selected_bands=bands, registration_band=bands[-1], scenes=[Scene(i, bands={b: f"{i}_{b}.tif" for b in bands}) for i in ids])
