"""Publication trends."""

from __future__ import annotations

from ..operators import windows
from ..sources import tables
from .catalog import query


@query(
    "trend_yearly_growth",
    """WITH c AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
 s AS (SELECT unnest(generate_series((SELECT min(year) FROM c), (SELECT max(year) FROM c)))::INT AS year),
 j AS (SELECT s.year, coalesce(n, 0)::BIGINT AS count FROM s LEFT JOIN c USING (year))
SELECT year, count, CASE WHEN lag(count) OVER w > 0 THEN round((count - lag(count) OVER w) * 100.0::DOUBLE / lag(count) OVER w, 4) ELSE 0.0::DOUBLE END AS growth_rate,
 (sum(count) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative
FROM j WINDOW w AS (ORDER BY year)""",
)
def trend_yearly_growth(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders")
    return windows.yearly_growth(orders.selectExpr("year(o_orderdate) AS year"))
