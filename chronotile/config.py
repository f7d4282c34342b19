"""Settings: defaults, and a user's file of JSON over them."""

from __future__ import annotations

import copy
import json
import os
from pathlib import Path

DEFAULTS: dict = {
    "chunk": 256,
    "tables": {"assets": ["tile", "band", "date", "fid", "cloud_cover"], "samples": ["longitude", "latitude", "start_date", "end_date", "label"]},
    "probabilities": {"scale": 0.0001, "least": 1, "most": 10000, "missing": 65535},
    "classes": {"least": 0, "most": 254, "missing": 255},
    "bands": {"INT2S": {"missing": -32768, "least": -10000, "most": 10000, "scale": 0.0001, "offset": 0.0}, "FLT4S": {"missing": None, "least": None, "most": None, "scale": 1.0, "offset": 0.0}},
    "colors": {},
}
VARIABLE = "CHRONOTILE_CONFIG"
_settings: dict | None = None


def _over(base: dict, new: dict) -> dict:
    return {**base, **{k: _over(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in new.items()}}


def load(path: str | None = None) -> dict:
    """The settings, read again from a file or from the one that the environment names."""
    global _settings
    path = path or os.environ.get(VARIABLE)
    _settings = _over(copy.deepcopy(DEFAULTS), json.loads(Path(path).read_text()) if path else {})
    return _settings


def get(*keys: str):
    out = _settings or load()
    for k in keys:
        out = out[k]
    return out


def show() -> str:
    return json.dumps(_settings or load(), indent=2)


def user_file(path: str, overwrite: bool = False) -> None:
    """A copy of the defaults to edit."""
    p = Path(path)
    if p.exists() and not overwrite:
        raise FileExistsError(path)
    p.write_text(json.dumps(DEFAULTS, indent=2))


def colors_set(colors: dict[str, str]) -> None:
    (_settings or load())["colors"].update(colors)


def colors_reset() -> None:
    (_settings or load())["colors"] = {}


def _flag(name: str) -> bool:
    return os.environ.get(name, "").strip().lower() in ("1", "yes", "true", "on")


def run_tests() -> bool:
    """Whether the environment asks for tests that need a network or much time."""
    return _flag("CHRONOTILE_RUN_TESTS")


def run_examples() -> bool:
    """Whether the environment asks for examples that need a network or much time."""
    return _flag("CHRONOTILE_RUN_EXAMPLES")
