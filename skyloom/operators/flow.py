"""Steps that act on a DataFrame as a whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.plans.staging import stage


def conditional_chain(df: DataFrame, key: str, verdict: Column, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply all ``steps`` in order to the tiles whose aggregate ``verdict`` is true at the start; the others pass unchanged.

    The verdict is one aggregate over all rows of a tile, made once and written, so that neither a later step nor the other
    branch judges anew. Columns that only steps add are null elsewhere; a null verdict counts as false.
    """
    told = df.join(stage(df.groupBy(key).agg(F.coalesce(verdict, F.lit(False)).alias("__verdict")), "verdicts"), key)
    yes, no = told.where("__verdict").drop("__verdict"), told.where("NOT __verdict").drop("__verdict")
    return reduce(lambda rows, step: step(rows), steps, yes).unionByName(no, allowMissingColumns=True)


def conditionally(df: DataFrame, key: str, verdict: Column, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A chain of one step."""
    return conditional_chain(df, key, verdict, step)
