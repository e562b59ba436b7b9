"""Queries on skewed keys."""

from __future__ import annotations

from codequarry.operators.hotkeys import per_name_fan_in
from codequarry.session import table

QUERIES = {"p5_found": lambda spark, d: per_name_fan_in(table(spark, d, "function_nodes"))}

ORACLE = {
    "p5_found": """
WITH latest AS (
  SELECT id, name, coalesce(fan_in, 0) AS f FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC NULLS LAST, ingested_at DESC NULLS LAST,
                                 fan_in DESC NULLS LAST, name DESC NULLS LAST) AS rn
    FROM function_nodes WHERE id IS NOT NULL) z WHERE rn = 1),
ranked AS (
  SELECT name, id, count(*) OVER (PARTITION BY name) AS n,
         row_number() OVER (PARTITION BY name ORDER BY f, id) AS up,
         row_number() OVER (PARTITION BY name ORDER BY f DESC, id) AS down
  FROM latest WHERE name IS NOT NULL)
SELECT name, max(CASE WHEN up = (n + 1) // 2 THEN id END) AS median_id,
       max(CASE WHEN down = 1 THEN id END) AS top_id
FROM ranked GROUP BY name"""
}
