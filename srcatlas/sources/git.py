"""What git says of a tree: small answers, read on the driver."""

from __future__ import annotations

import os
import subprocess

from ..config import Settings


def _run(root: str, args: list[str], seconds: int) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def head(root: str) -> str | None:
    out = _run(root, ["rev-parse", "HEAD"], 10)
    return out.strip() if out and out.strip() else None


def in_scope(path: str, settings: Settings) -> bool:
    """The driver-side twin of the scope expression, for lists of changed paths."""
    path = path.replace("\\", "/")
    under = lambda p: path == p or path.startswith(p + "/")
    if any(map(under, settings.exclude_prefixes)):
        return False
    return not settings.include_prefixes or any(map(under, settings.include_prefixes))


def changed(root: str, since: str, extensions: list[str]) -> list[str] | None:
    """Paths that differ between a commit and HEAD; None if git cannot tell."""
    out = _run(root, ["diff", "--no-renames", "--name-only", "-z", since, "HEAD"], 30)
    return None if out is None else sorted(p for p in out.split("\0") if os.path.splitext(p)[1] in extensions)


def dirty(root: str, extensions: list[str], settings: Settings | None = None) -> list[str]:
    """Paths that differ from HEAD or are untracked; of a rename both names."""
    out = _run(root, ["status", "--porcelain=v1", "--untracked-files=all", "-z"], 15)
    found, parts = set(), (out or "").split("\0")
    k = 0
    while k < len(parts):
        entry = parts[k]
        k += 1
        if len(entry) < 4:
            continue
        found.add(entry[3:])
        if entry[0] in "RC" or entry[1] in "RC":
            if k < len(parts):
                found.add(parts[k])
            k += 1
    return sorted(p for p in found if os.path.splitext(p)[1] in extensions and (settings is None or in_scope(p, settings)))
