"""Registered queries: each operator run over the whole test tables, with its SQL equivalent."""

from __future__ import annotations

from flowspark.catalog import (
    arrivals, detection, encoding, evaluation, files, fits, frames, preparation, reports, splits, timelines, windowing,
)
from flowspark.catalog.base import REGISTRY

__all__ = [
    "REGISTRY", "arrivals", "detection", "encoding", "evaluation", "files", "fits", "frames", "preparation", "reports", "splits", "timelines", "windowing",
]
