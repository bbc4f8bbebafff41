"""Claim-graph analytics and text-corpus preparation on PySpark."""

from __future__ import annotations

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark) -> None:
    """Let Python workers on this machine import the package; clusters ship it with --py-files."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
