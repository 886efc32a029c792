"""Choices of the best value within a group; `order` tells which came first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import importance_rank


def first_by(value: Column, order: Column) -> Column:
    return F.min_by(F.struct(value.alias("v")), order)["v"]


def best_definition(definition: Column, order: Column) -> Column:
    """Longest that isn't empty and is below 500 characters, the first of those; else the first of all."""
    fits = (F.length(definition) > 0) & (F.length(definition) < 500)
    best = F.min_by(definition, F.when(fits, F.struct(-F.length(definition), order)))
    return F.coalesce(F.when(F.max(fits), best), first_by(definition, order), F.lit(""))


def best_importance(importance: Column, order: Column) -> Column:
    return F.min_by(importance, F.struct(-importance_rank(importance), order))
