"""All registered queries, by inventory section."""

from driver import q_joins, q_relief, q_scalars, q_shapes, q_streams, q_tables  # noqa: F401
from driver.q_shapes import flagship
from driver.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]
