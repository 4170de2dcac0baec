"""Settings of the pipeline: frozen values, overrides as `name=value` words, a smoke variant."""

from __future__ import annotations

import dataclasses
import json
import logging
import os


@dataclasses.dataclass(frozen=True)
class Settings:
    windows: int = 4000
    window: int = 1024
    elements: int = 24
    element: int = 240
    gc: float = 0.42
    seed: int = 0
    d_model: int = 64
    layers: int = 4
    expansion: int = 4
    k: int = 16
    epochs: int = 8
    null_directions: int = 100
    null_pct: float = 0.95
    metric: str = "precision_weighted"
    alts: str = "all"
    summary: str = "max"
    min_active: int = 1
    seeds: int = 3
    replicates: int = 1000
    q: float = 0.10
    match: float = 0.5
    source: str = "synthetic"
    path: str = ""
    release: str = "GRCh38"
    smoke: bool = False

    @property
    def width(self) -> int:
        return self.d_model * self.expansion


SMOKE = {"windows": 300, "window": 256, "elements": 12, "element": 120, "d_model": 32, "layers": 2, "epochs": 2, "k": 8, "null_directions": 40, "replicates": 100}


#: Names the settings file where `load` is given none.
FILE = "HELIXFRAME_SETTINGS"


def read_file(path: str) -> dict:
    """A mapping of settings from a YAML (.yaml, .yml) or JSON file on the driver; an empty file is an empty mapping."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text) if text.strip() else None
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found or {}


def load(words: list[str] = (), base: dict | None = None, path: str | None = None) -> Settings:
    """Defaults, then the file, then the base, then the smoke values if smoke is on, then the words; an unknown name is a ValueError.

    The file is `path`, else the one that the environment's HELIXFRAME_SETTINGS names, else none.  Its `smoke_values`, a mapping,
    stand in for SMOKE's of the same name.  Words that turn smoke on or off count before the smoke values do.
    """
    given = dict(w.split("=", 1) for w in words)
    path = path or os.environ.get(FILE)
    held = read_file(path) if path else {}
    smoke = SMOKE | held.pop("smoke_values", {})
    base = held | (base or {})
    kinds = {f.name: f.type for f in dataclasses.fields(Settings)}
    if unknown := (given.keys() | base.keys() | smoke.keys()) - kinds.keys():
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    read = {"int": int, "float": float, "str": str, "bool": lambda v: str(v).lower() in ("1", "true", "yes")}
    typed = lambda d: {k: read[kinds[k]](v) for k, v in d.items()}
    values = typed(base)
    given = typed(given)
    if {**values, **given}.get("smoke"):
        values |= typed(smoke)
    return Settings(**{**values, **given})


def under(folder: str, *parts: str) -> str:
    """A path below a folder, local or remote; Spark's writers make what folders it needs."""
    return "/".join([folder.rstrip("/"), *(p.strip("/") for p in parts)])


def snapshot(settings: Settings) -> str:
    """The resolved settings as JSON."""
    return json.dumps(dataclasses.asdict(settings), sort_keys=True, indent=1)


def logger(name: str) -> logging.Logger:
    """S3."""
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    return logging.getLogger(f"helixframe.{name}")
