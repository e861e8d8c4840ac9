"""Settings of a feature pipeline."""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

#: What a settings file may leave out.
DEFAULTS: dict[str, Any] = {
    "column_names": {"ID": "ID", "t": "t", "var_name": "variable_name", "var_value": "variable_value"},
    "parallel": True,  # accepted for old settings files; Spark decides
    "n_jobs": None,
    "batch_size": None,
    "hierarchical_sep": ":",
    "hierarchical_levels": [0, 1, 2],
    "discretize": True,
    "use_ordinal_encoding": False,
    "value_types": {},
    "lookups": {},
}


@dataclass(frozen=True)
class Settings:
    """T and dt: length and step of the time axis. theta_1: share of entities a
    variable must exceed. theta_2: share below which a feature is near-constant.
    theta_freq: mean recordings per step that make a variable frequent."""

    T: float
    dt: float
    theta_1: float = 0.001
    theta_2: float = 0.001
    theta_freq: float = 1.0
    stats: tuple[str, ...] = ("min", "max", "mean")
    N: int | None = None
    prefilter: bool = True
    postfilter: bool = True
    discretize: bool = True
    use_ordinal_encoding: bool = False
    hierarchical_sep: str = ":"
    hierarchical_levels: tuple[int, ...] = (0, 1, 2)
    value_types: dict[str, str] = field(default_factory=dict)
    S_bins: dict[str, list[float] | None] | None = None
    X_bins: dict[str, list[float] | None] | None = None
    column_names: dict[str, str] = field(default_factory=lambda: dict(DEFAULTS["column_names"]))
    #: Files of the lookup tables of coded hierarchies: paths9, paths10, code_map.
    lookups: dict[str, str] = field(default_factory=dict)
    #: Reproduce the truncation of T to whole numbers and the prefixing of nulls.
    strict_compat: bool = False

    def __post_init__(self):
        if not (self.dt > 0 and self.T >= self.dt):
            raise ValueError(f"T={self.T} must hold at least one step of dt={self.dt}, which must be positive")

    @property
    def L(self) -> int:
        """Number of time bins; a partial last one is none."""
        return math.floor(self.T / self.dt)

    @property
    def until(self) -> float:
        return int(self.T) if self.strict_compat else self.T


def load_settings(path: str | None, read_file: Callable[[str], str] = lambda path: Path(path).read_text(), **arguments: Any) -> Settings:
    """Settings of a YAML file (top-level keys replace the defaults whole) and arguments.

    read_file: gives the text of a file that is named; by default of a local one."""
    given = copy.deepcopy(DEFAULTS)
    if path:
        import yaml

        given.update(yaml.safe_load(read_file(path)) or {})
    read = lambda key: json.loads(read_file(given[key])) if given.get(key) else None
    base = {
        "discretize": bool(given["discretize"]),
        "use_ordinal_encoding": bool(given["use_ordinal_encoding"]),
        "hierarchical_sep": given["hierarchical_sep"],
        "hierarchical_levels": tuple(given["hierarchical_levels"] or ()),
        "value_types": dict(given["value_types"] or {}),
        "column_names": DEFAULTS["column_names"] | (given["column_names"] or {}),
        "S_bins": read("S_discretization_bins"),
        "X_bins": read("X_discretization_bins"),
        "lookups": dict(given["lookups"] or {}),
    }
    return Settings(**(base | {k: v for k, v in arguments.items() if v is not None}))


def with_bins(settings: Settings, s: dict | None, x: dict | None) -> Settings:
    return replace(settings, S_bins=s, X_bins=x)
