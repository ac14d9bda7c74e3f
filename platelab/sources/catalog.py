"""Datasets by logical name."""

from __future__ import annotations


def resolve(name: str, places: dict[str, str], root: str) -> str:
    """Path of a logical name: its own place, else the place of its longest prefix, else below the root."""
    if name in places:
        return places[name]
    parts = name.split("/")
    for k in range(len(parts) - 1, 0, -1):
        if (prefix := "/".join(parts[:k])) in places:
            return "/".join([places[prefix], *parts[k:]])
    return f"{root}/{name}"


def version_path(root: str, version: int) -> str:
    """One folder per version of the vocabulary; versions are never rewritten."""
    return f"{root}/v={version:02d}"
