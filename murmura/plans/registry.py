"""All core queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("intervals", "notes", "find", "speech", "messages")


def collect(attribute: str) -> dict:
    """The union of ``attribute`` of the query modules."""
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"murmura.plans.{name}"), attribute))
    return out
