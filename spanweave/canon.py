"""Canonical JSON and digests; artifacts are small and are written by the driver."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
from typing import Any


def tidy(value: Any) -> Any:
    """Without absent values (None, '', empty lists and objects in objects); whole floats as integers."""
    if isinstance(value, dict):
        out = {k: tidy(v) for k, v in value.items()}
        return {k: v for k, v in out.items() if v is not None and v != "" and v != {} and v != []}
    if isinstance(value, (list, tuple)):
        return [tidy(v) for v in value]
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number is not finite")
        return int(value) if value == int(value) else value
    return value


def canonical(value: Any) -> str:
    """Sorted keys, two spaces, a line feed at the end; <, >, & and the line separators escaped."""
    text = json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False)
    for char in ("<", ">", "&", chr(0x2028), chr(0x2029)):
        text = text.replace(char, f"\\u{ord(char):04x}")
    return text + "\n"


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def fingerprint(model: dict) -> str:
    """Of the services, edges and endpoints alone, so that times and sources do not change it."""
    return digest({k: model.get(k, []) for k in ("services", "edges", "endpoints")})


def write_atomic(path: str, text: str) -> None:
    """The whole file or none of it: written beside, synced, renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, prefix=".", suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def sidecar_path(path: str) -> str:
    return os.path.splitext(path)[0] + ".signal-quality.json"


def file_stamp(name: str) -> str:
    """A name for a file: letters, digits, - and _ stay, all else becomes -."""
    return "".join(c if c.isalnum() or c in "-_" else "-" for c in name)
