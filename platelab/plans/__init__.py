"""Queries over the driver's tables."""

from . import dishes, flexibility, impact, judgments, menus, nutrition, registry, statistics, storage, vocabulary  # noqa: F401
