"""Registered queries and end-to-end jobs."""

from __future__ import annotations

from importlib import import_module

AREAS = ["derived", "customers", "segments", "products", "marts", "profiling", "cleaning", "series", "churn", "recommend", "clusters", "lifecycle"]


def load_catalog():
    """The catalogue module with every area's queries registered."""
    for area in AREAS:
        import_module(f"basketry.plans.{area}_queries")
    return import_module("basketry.plans.catalog")
