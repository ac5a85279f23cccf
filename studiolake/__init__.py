"""studiolake — multi-tenant membership-business analytics on Spark.

Every operator is a lazy function ``f(tables, as_of) -> DataFrame`` over a
dict of canonical DataFrames (see ``sources.model``).  Nothing calls
``current_date()``: "today" is always the explicit ``as_of`` argument, so
results are reproducible and can be checked against a SQL oracle.
"""

from studiolake.session import get_session  # noqa: F401

__all__ = ["get_session"]
