"""Engine configuration: defaults, file, environment, checks.

Environment goes over file, file over defaults.  A value of either that cannot
be parsed is reported and what was set before stays.
"""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, fields, replace
from pathlib import Path

from .functions.vectors import is_known, metric_names

ENV_PREFIX = "VECLAKE_"


@dataclass(frozen=True)
class EngineConfig:
    index_type: str = "brute"  # brute or hnsw
    metric: str = "cosine"
    quantization: str = "none"  # none or scalar
    dimensions: int = 0  # 0: the first accepted record sets the width
    hybrid: bool = True
    metadata_index: bool = True
    m: int = 16
    ef_construction: int = 100
    ef_search: int = 100
    level_factor: float = 0.25
    seed: int = 1
    shard_size: int = 32768  # records of one graph
    probes: int = 3  # graphs that a query visits, those with the nearest centres; 0: all
    batch_size: int = 1000
    auto_save_seconds: int = 60
    storage_path: str = ""

    def checked(self) -> EngineConfig:
        """Raise ValueError for the first setting that is out of bounds."""
        if self.index_type not in ("brute", "hnsw"):
            raise ValueError(f"index_type {self.index_type!r}: brute or hnsw")
        if self.quantization not in ("none", "scalar"):
            raise ValueError(f"quantization {self.quantization!r}: none or scalar")
        if not is_known(self.metric):
            raise ValueError(f"metric {self.metric!r}: {' or '.join(metric_names())}")
        for name in ("dimensions", "seed", "probes"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("m", "ef_construction", "ef_search", "shard_size", "batch_size", "auto_save_seconds"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.ef_construction < self.m:
            raise ValueError("ef_construction must be at least m")
        if not 0 < self.level_factor < 1:
            raise ValueError("level_factor must lie between 0 and 1")
        return self


def _read(path: str) -> dict:
    """Flat or ``engine:`` settings of a JSON file, or of simple YAML lines ``key: value``."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text)
        return found.get("engine", found)
    out = {}
    for line in text.splitlines():
        key, sep, value = line.split("#", 1)[0].strip().partition(":")
        if sep and value.strip():
            out[key.strip()] = value.strip().strip("\"'")
    return out


def _parsed(kind: str, value):
    if kind == "bool":
        low = str(value).strip().lower()
        if low not in ("1", "0", "true", "false", "t", "f"):
            raise ValueError(value)
        return low in ("1", "true", "t")
    return {"int": int, "float": float}.get(kind, str)(value)


def load(path: str | None = None, environment: dict | None = None) -> EngineConfig:
    config = EngineConfig()
    kinds = {f.name: f.type for f in fields(EngineConfig)}
    found = {k: (v, k) for k, v in (_read(path) if path and os.path.exists(path) else {}).items()}
    env = os.environ if environment is None else environment
    for source in (found, {k: (env.get(ENV_PREFIX + k.upper()), ENV_PREFIX + k.upper()) for k in kinds}):
        for key, kind in kinds.items():
            raw, name = source.get(key, (None, key))
            if raw in (None, ""):
                continue
            try:
                config = replace(config, **{key: _parsed(kind, raw)})
            except (TypeError, ValueError):
                warnings.warn(f"{name}={raw!r} is no {kind}; {getattr(config, key)!r} stays", stacklevel=2)
    return config.checked()
