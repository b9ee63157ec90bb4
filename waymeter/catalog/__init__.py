"""Registered queries by operator id: a Spark function and, where one exists, its SQL twin."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["routing", "logs", "grading", "costs", "recovery", "paired", "windows", "streams"]


def all_entries() -> dict:
    found: dict = {}
    for group in GROUPS:
        found.update(import_module(f"waymeter.catalog.{group}").ENTRIES)
    return found
