"""Category labels of the analytical reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed


def vulnerability_status(high: Column) -> Column:
    return F.when(high, F.lit(fixed.HIGH_STATUS)).otherwise(F.lit(fixed.NOT_HIGH_STATUS))


def vulnerability_category_ordinal(high: Column, count: Column) -> Column:
    return F.when(high, F.lit(1)).when(count > 0, F.lit(2)).otherwise(F.lit(3))


def risk_category(high: Column, count: Column) -> Column:
    top, middle, low = (F.lit(label) for label in fixed.RISK_CATEGORIES)
    return F.when(high, top).when(count > 0, middle).otherwise(low)


def severity_category(score: Column) -> Column:
    chain = F
    for lowest, label in fixed.SEVERITY_CATEGORIES:
        chain = chain.when(score >= lowest, F.lit(label))
    return chain.otherwise(F.lit(fixed.LOWEST_SEVERITY_CATEGORY))


def risk_assessment_ordinal(high: Column, count: Column, dependents: Column) -> Column:
    """1 is worst; a widely used package counts one step worse than others of its kind."""
    wide = F.coalesce(dependents > fixed.MANY_DEPENDENTS_OVER, F.lit(False))
    return (F.when(high, F.when(wide, F.lit(1)).otherwise(F.lit(2)))
            .when(count > 0, F.when(wide, F.lit(3)).otherwise(F.lit(4)))
            .otherwise(F.lit(5)))
