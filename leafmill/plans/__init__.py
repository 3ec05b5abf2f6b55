"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("retrieval", "records", "texts", "grids", "lists", "pages")


def _load():
    for name in _MODULES:
        import_module(f"leafmill.plans.{name}")
    return import_module("leafmill.plans.registry")


def registered() -> dict:
    return _load().QUERIES


def oracle() -> dict:
    return _load().ORACLE
