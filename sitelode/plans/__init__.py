"""Queries over the tables of a folder, each with its DuckDB SQL."""

from importlib import import_module

FAMILIES = ("search", "history", "joins", "sessions", "text", "pages", "markup", "inspection", "signals", "readable", "graphs", "entities", "scores", "declarations", "payloads", "answers")


def _all(what: str) -> dict:
    return {k: v for family in FAMILIES for k, v in getattr(import_module(f"sitelode.plans.{family}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
