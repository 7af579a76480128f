"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import image_plans, layout_plans, model_plans, score_plans, service_plans, store_plans, text_plans  # noqa: F401
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
