"""Secrets by name: from the environment, else from a file of NAME=value lines that stays out of the repository."""

from __future__ import annotations

import os
import re
from pathlib import Path

LINE = re.compile(r"\s*(?!#)([^=]*[^=\s])\s*=\s*(['\"]?)(.*?)\2\s*")


def keys_file(path: str | Path) -> dict[str, str]:
    """Names and values of a file; lines without =, comments and a missing file give none. Quotes around a value go."""
    try:
        lines = Path(path).expanduser().read_text().splitlines()
    except FileNotFoundError:
        return {}
    return {m[1]: m[3] for m in map(LINE.fullmatch, lines) if m}


def key(name: str, path: str | Path = "~/.trailmark/keys") -> str | None:
    return os.environ.get(name) or keys_file(path).get(name)
