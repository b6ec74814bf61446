"""Ignore rules as version control writes them; the last rule that matches wins."""

from __future__ import annotations

import re

#: What is ignored if nothing else is said.
DEFAULT = [".git", "node_modules", "__pycache__", ".venv"]
CONFIG_DEFAULT = [*DEFAULT, "dist", "build"]


def read_rules(text: str) -> list[str]:
    return [s for line in text.splitlines() if (s := line.strip()) and not s.startswith("#")]


def rerooted(pattern: str, folder: str) -> str:
    """A rule of a folder's own file as one of the root. A slash at the start or within ties
    it to that folder; one at the end only says that it means folders."""
    if folder in ("", "."):
        return pattern
    back, body = pattern[:1] == "!", pattern.removeprefix("!")
    tied = "/" in body.rstrip("/")
    return "!" * back + "/".join([folder, *([] if tied else ["**"]), body.lstrip("/")])


def compiled(pattern: str) -> tuple[re.Pattern[str], bool]:
    """The expression of a rule, and whether it takes back."""
    back = pattern.startswith("!")
    p = pattern[1:] if back else pattern
    folder_only = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            out, i = out + p[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    head = "" if anchored else "(?:.*/)?"
    return re.compile(f"{head}{out}{'/.+' if folder_only else '(?:/.+)?'}"), back


class Ignore:
    """Whether a path is ignored: the last rule that matches it says so."""

    def __init__(self, rules: list[str] | None = None):
        self.rules = [compiled(r) for r in (rules if rules else DEFAULT)]

    def __call__(self, path: str) -> bool:
        hit = False
        for rx, back in self.rules:
            if rx.fullmatch(path):
                hit = not back
        return hit


def should_ignore(path: str, patterns: list[str]) -> bool:
    return Ignore(patterns)(path)
