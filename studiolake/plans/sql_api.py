"""A3: the SQL surface - canonical tables and staging projections as temp
views, and the row rules as SQL functions.

``CREATE TEMPORARY FUNCTION ... RETURN expr`` defines SQL functions that the
analyzer inlines into the calling query (no Python, no UDF node), so SQL users
get the same cleaning / rounding rules as the DataFrame operators.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from studiolake.functions import exprs as X
from studiolake.operators import staging as S


def _status_case(arg: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({arg}), '{w}')" for w in ws) + f" THEN '{s}'"
                     for s, ws in X.LEAD_STATUS_WORDS)
    return f"CASE {whens} ELSE 'new' END"


def _digits(arg: str) -> str:
    return f"regexp_replace({arg}, '[^0-9]', '')"


FUNCTIONS = {
    "sl_phone_key": ("s STRING", "STRING",
                     f"CASE WHEN {_digits('s')} = '' THEN NULL WHEN length({_digits('s')}) >= 9 "
                     f"THEN right({_digits('s')}, 9) ELSE {_digits('s')} END"),
    "sl_clean_date": ("s STRING", "DATE",
                      "CASE WHEN s IS NULL OR s = '' OR startswith(s, '0000') OR startswith(s, '-') THEN NULL "
                      "ELSE try_to_date(substring(s, 1, 10), 'yyyy-MM-dd') END"),
    "sl_lead_status": ("s STRING", "STRING", _status_case("s")),
    "sl_dow0": ("d DATE", "INT", "dayofweek(d) - 1"),
    "sl_week_start": ("d DATE", "DATE", "CAST(date_trunc('week', d) AS DATE)"),
    "sl_intl_phone": ("s STRING", "STRING",
                      f"concat('{X.INTL_PREFIX}', regexp_replace(regexp_replace(s, '^0', ''), '[-\\\\s]', ''))"),
    "sl_pct_half_up": ("num BIGINT, den BIGINT", "DOUBLE",
                       "CAST((abs(num) * 2000 + abs(nullif(den, 0))) div (abs(nullif(den, 0)) * 2) "
                       "* CASE WHEN (num < 0) <> (den < 0) THEN -1 ELSE 1 END AS DOUBLE) / 10.0"),
}


def register_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)


def register_views(tables: dict[str, DataFrame], as_of: dt.date, leads_as_of: dt.date | None = None) -> list[str]:
    """Temp views for every canonical table and staging projection."""
    names = []
    for n, df in tables.items():
        df.createOrReplaceTempView(n)
        names.append(n)
    staged = {
        "stg_members": S.stg_members(tables), "stg_memberships": S.stg_memberships(tables, as_of),
        "stg_payments": S.stg_payments(tables), "stg_classes": S.stg_classes(tables),
        "stg_attendance": S.stg_attendance(tables), "stg_bookings": S.stg_bookings(tables),
        "stg_leads": S.stg_leads(tables, leads_as_of or as_of), "stg_freezes": S.stg_freezes(tables, as_of),
    }
    for n, df in staged.items():
        df.createOrReplaceTempView(n)
        names.append(n)
    return names
