"""Python workers that find this package."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shipped(rows: DataFrame) -> DataFrame:
    """The same rows; local workers can import this package even if the driver found it by sys.path alone. On a cluster it is installed or sent with --py-files."""
    env = rows.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return rows
