"""Settings: environment over file over defaults."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

PREFIX = "LODESTACK_"
NAME = "lodestack.toml"
DEFAULTS = {"store": {"root": "lodestack-store"}, "embedding": {"dimensions": 64}, "workspace": {"root": ".", "ignore": [".git", "node_modules", "__pycache__", ".venv", "dist", "build"]}, "chunking": {"size": 1024, "overlap": 200}}


def find_file() -> Path | None:
    places = [Path.cwd() / NAME, Path.home() / ".config" / "lodestack" / NAME, Path("/etc/lodestack") / NAME]
    return next((p for p in places if p.is_file()), None)


def _typed(text: str, like):
    if isinstance(like, bool):
        return text.lower() in ("1", "true", "yes")
    if isinstance(like, int):
        return int(text)
    return [x.strip() for x in text.split(",")] if isinstance(like, list) else text


def load(path: Path | None = None, env: dict[str, str] | None = None) -> dict[str, dict]:
    """LODESTACK_SECTION__KEY in the environment outranks the file."""
    env = dict(os.environ) if env is None else env
    at = path or find_file()
    from_file = tomllib.loads(at.read_text()) if at else {}
    out = {s: {**v, **from_file.get(s, {})} for s, v in DEFAULTS.items()}
    for section, values in out.items():
        for key, value in values.items():
            said = env.get(f"{PREFIX}{section}__{key}".upper())
            if said is not None:
                values[key] = _typed(said, value)
    return out
