"""Configuration files of `key = value` lines."""

from __future__ import annotations

from pathlib import Path


def read_config(path: str) -> dict[str, str]:
    return parse_config(Path(path).read_text(encoding="utf-8"), path)


def parse_config(text: str, path: str = "configuration") -> dict[str, str]:
    """Values by key; `#` starts a comment, the last of several equal keys wins, lines without = are errors."""
    out: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.partition("#")[0].strip()
        if line:
            key, sign, value = line.partition("=")
            if not sign or not key.strip():
                raise ValueError(f"{path}:{number}: expected key = value")
            out[key.strip()] = value.strip()
    return out


def spark_settings(config: dict[str, str]) -> dict[str, str]:
    """The keys that are Spark's own settings."""
    return {k: v for k, v in config.items() if k.startswith("spark.")}
