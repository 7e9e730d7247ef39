"""Queries over the driver's tables, each beside its SQL."""

from importlib import import_module


def load() -> None:
    for name in ("foundation", "cleaning", "panel", "demand", "models", "hierarchy", "decisions", "runs"):
        import_module(f"registry.{name}")
