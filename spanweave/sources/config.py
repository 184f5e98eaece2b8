"""Configuration of a live service: defaults, then a JSON or YAML document, then keyword arguments; checked as a whole."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from ..operators.reconcile import Config, half_life_alpha, windows_of

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(value) -> float:
    """A duration: text such as 30s, 1m30s or 150ms, or whole nanoseconds."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value / 1e9
    text = str(value).strip()
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+"):
        raise ValueError(f"not a duration: {value!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Serve:
    landing: str = ""
    flush_interval: float = 5.0
    window_size: float = 30.0
    max_in_memory_spans: int = 10_000
    max_body_bytes: int = 5 << 20
    late_span_policy: str = "drop"
    sink_dir: str = ""
    latest_path: str = ""
    log_format: str = "text"
    reconciliation_enabled: bool = False
    half_life: float = 600.0
    compaction_interval: float = 150.0
    retired_ttl: float = 86_400.0
    retired_overall: int = 500
    retired_per_kind: int = 200
    minimum_observations: int = 2

    def __post_init__(self):
        for name in ("flush_interval", "window_size", "max_in_memory_spans", "max_body_bytes", "half_life", "compaction_interval", "retired_ttl"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        if self.late_span_policy not in ("drop", "current_window"):
            raise ValueError("late_span_policy is drop or current_window")
        if self.log_format not in ("text", "json"):
            raise ValueError("log_format is text or json")

    def reconciler(self) -> Config:
        return Config(gap_alpha=half_life_alpha(self.half_life, self.window_size), compact_every=windows_of(self.compaction_interval, self.window_size), retired_ttl_s=int(self.retired_ttl), retired_overall=self.retired_overall, retired_per_kind=self.retired_per_kind, min_observations=self.minimum_observations)


def serve_config(document: dict | None = None, **flags) -> Serve:
    """Unknown fields of the document are ignored, unknown flags are not; dashes and nested groups count as underscores."""
    times = {"flush_interval", "window_size", "half_life", "compaction_interval", "retired_ttl"}
    known = {f.name for f in fields(Serve)}
    flat: dict = {}

    def walk(node: dict, prefix: str = "") -> None:
        for k, v in node.items():
            name = prefix + str(k).replace("-", "_")
            if isinstance(v, dict):
                walk(v, "" if name not in ("reconciliation",) else name + "_")
            else:
                flat[name if name in known else name.removeprefix("reconciliation_")] = v

    walk(document or {})
    if unknown := set(flags) - known:
        raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
    given = {k: v for k, v in (flat | {k: v for k, v in flags.items() if v is not None}).items() if k in known}
    return replace(Serve(), **{k: seconds(v) if k in times and not isinstance(v, float) else v for k, v in given.items()})
