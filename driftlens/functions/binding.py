"""Values that a Column expression uses more than once.

Inside a lambda nothing is shared: an expression that stands twice is evaluated twice, and one that stands in a
lambda over an array once for each element. A lambda's own variable is evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
