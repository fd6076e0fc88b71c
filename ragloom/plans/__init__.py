"""Registered queries: one per operator of the survey, each with its DuckDB twin."""

import importlib

_MODULES = ("search", "corpus", "chunks", "answers", "clusters", "evaluation")


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"ragloom.plans.{m}")
