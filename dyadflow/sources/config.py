"""Settings: dataclasses with defaults, from YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass
class Ingest:
    raw_dir: str = ""
    legend: str = ""
    out_dir: str = ""
    pattern: str = "^([0-9]+)([A-Z])_.*"
    collapse: dict[str, int] = field(default_factory=lambda: {"Negative": 0, "Neutral": 1, "Positive": 2})
    debounce_enabled: bool = False
    debounce_k: int = 1
    windowing_enabled: bool = False
    window_sec: float = 60.0
    overlap: float = 0.5

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < 1:
            raise ValueError("overlap must lie in [0, 1)")

    def settings(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if k in ("debounce_enabled", "debounce_k", "windowing_enabled", "window_sec", "overlap")}


@dataclass
class Analysis:
    steps: str = ""
    out_dir: str = ""
    manifest: str = ""
    run_coupling: bool = True
    run_directionality: bool = True
    run_therapist_grouped: bool = True
    run_hmm: bool = True
    run_recurrence: bool = True
    run_motifs: bool = True
    selection_metric: str = "ll_per_step"
    save_diagnostics: bool = False
    n_splits: int = 5
    alpha: float = 1.0
    n_states: int = 3
    therapist_map: str = ""
    horizons: list[int] = field(default_factory=lambda: [1, 2, 5, 10])
    k_min: int = 8
    k_max: int = 8
    n_iter: int = 150
    tol: float = 1e-4
    alpha_trans: list[float] = field(default_factory=lambda: [1.0])
    alpha_emit: list[float] = field(default_factory=lambda: [1.0])
    n_restarts: int = 3
    refit_restarts: int = 3
    hmm_k: int = 8
    n_min: int = 10
    theiler: int = 1
    l_min: int = 2
    v_min: int = 2
    n_null: int = 100
    ks: list[int] = field(default_factory=lambda: [2, 3])
    top_n: int = 5
    min_null_windows: int = 15
    min_null_duration: int = 30
    seed: int = 0
    outlier_z: float = 20.0
    survey: str = ""
    survey_code: str = "Session Code"
    survey_primary: list[str] = field(default_factory=list)
    survey_subscales: list[str] = field(default_factory=list)
    survey_client: str = ""
    survey_therapist: str = ""

    def __post_init__(self) -> None:
        if self.selection_metric != "ll_per_step":
            raise ValueError("selection_metric can be ll_per_step only")


def load(kind, path: str | None = None, **given: Any):
    """A settings object from a file (none: defaults) and overrides; None overrides nothing, 0 and False do. Unknown names
    are an error."""
    values: dict[str, Any] = {}
    if path:
        with open(path) as f:
            text = f.read()
        if path.endswith(".json"):
            values = json.loads(text)
        else:
            import yaml

            values = yaml.safe_load(text) or {}
    values |= {k: v for k, v in given.items() if v is not None}
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings {unknown}")
    return kind(**values)
