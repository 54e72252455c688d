"""The period and amount rules as SQL functions, for queries written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "fiscal_key(d DATE) RETURNS STRING": "format_string('FY%02d-%d', year(add_months(d, -3)) % 100, year(add_months(d, -3)) + 1)",
    "month_key(d DATE) RETURNS STRING": "date_format(d, 'yyyy-MM')",
    "approximate_start(d DATE) RETURNS DATE": "date_add(add_months(d, -1), 1)",
    "balances_match(a DECIMAL(18,2), b DECIMAL(18,2)) RETURNS BOOLEAN": "abs(a - b) <= 0.21",
    "squeeze(t STRING) RETURNS STRING": r"trim(regexp_replace(t, '\\s+', ' '))",
}


def register(spark: SparkSession) -> None:
    """Make ``FUNCTIONS`` known to the session; they are inlined, so the optimiser sees through them."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
