"""A look at physical plans, for tests and for tuning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def nodes(df: DataFrame) -> list[str]:
    """Names of the physical plan's operators, from the top."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", text, re.M)


def shuffles(df: DataFrame) -> int:
    return nodes(df).count("Exchange")


def uses_python(df: DataFrame) -> bool:
    return any(re.search("Python|Pandas|Arrow", n) for n in nodes(df))
