"""Every registered query and, where it can be stated, its SQL."""

from importlib import import_module

_PARTS = ["matching", "rules", "store", "outputs"]


def _collect(kind: str) -> dict:
    found: dict = {}
    for part in _PARTS:
        entries = getattr(import_module(f"catalog.{part}"), kind)
        clash = found.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {clash}")
        found.update(entries)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    found = _collect("ORACLE")
    return found | import_module("catalog.outputs").late_oracle(found)
