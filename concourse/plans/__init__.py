"""Registered queries: every operator bound to the driver tables, with an equivalent SQL text."""

from concourse.plans.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
