"""Settings with defaults, changed by KEY=VALUE texts or the environment."""

from __future__ import annotations

import json
import os
from pathlib import Path

# Names and defaults; the model and its engine are those of `inference.register`.
DEFAULTS: dict[str, bool | int | float | str | None] = {
    "model_path": "", "BACKEND": "stub", "LAYOUT_MODE": "Detection", "MAX_MODEL_LEN": 16384,
    "GPU_MEMORY_UTILIZATION": 0.95, "PDF_TOOLS": "pypdfium2", "PDF_TOOLS_WORKER_MAX_NUM": 4, "PDF_TOOLS_WORKER_RATIO": 0.7, "MAX_PIXELS": 64_000_000,
}


def cast_like(text: str, default):
    """A text as the type of the default; `none` is null among texts."""
    if isinstance(default, bool):
        return text.lower() in ("true", "1", "yes")
    if isinstance(default, int | float):
        return type(default)(text)
    return None if text.lower() == "none" else text


def updated(changes: list[str], settings: dict | None = None) -> dict:
    """Settings with changes of the form KEY=VALUE, cut at the first equals sign; a change without one
    is a ValueError, an unknown key a KeyError."""
    out = dict(DEFAULTS if settings is None else settings)
    for change in changes:
        key, sign, value = change.partition("=")
        if not sign:
            raise ValueError(f"not KEY=VALUE: {change}")
        if key not in out:
            raise KeyError(f"no such setting: {key}")
        out[key] = cast_like(value, out[key])
    return out


def positive_from_environment(name: str, default: int) -> int:
    """A variable that is a whole number above 0, else the default."""
    try:
        n = int(os.environ.get(name, ""))
    except ValueError:
        return default
    return n if n > 0 else default


def config_file(name: str) -> dict | None:
    """The JSON of a file in the home folder, or of an absolute path; None if there is none."""
    path = Path(name) if os.path.isabs(name) else Path.home() / name
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None
