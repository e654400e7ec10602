"""Column expressions without side effects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside other lambdas.

    A plain column reference would be inlined into the lambda by the optimizer and evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]


def rows_of(df: DataFrame, array: str | Column, name: str, *keep: str) -> DataFrame:
    """A row for each element of ``array``, as column ``name``, beside the columns ``keep``.

    The outer form is on purpose: for the inner one the optimizer derives a filter on the array and moves it below the
    steps that make the array, which would then be evaluated twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("element_no", name)).where("element_no is not null").drop("element_no")


def first_where(n: Column, test: Callable[[Column], Column]) -> Column:
    """The first of the positions 0 to ``n`` - 1 for which ``test`` holds, by halving; ``n`` if there is none.

    ``test`` must hold for every position after one for which it holds.
    """
    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.when(test(middle), F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(
            F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))))

    steps = F.sequence(F.lit(1), F.length(F.bin(n)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")), halve)["lo"]
