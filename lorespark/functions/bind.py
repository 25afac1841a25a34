"""Naming an intermediate value inside one expression.

A column that is used several times is copied into every use. `bind` evaluates
it once per row and hands a variable to the function, so that deep chains stay
linear in size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, function: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda item: function(item)), F.lit(0))
