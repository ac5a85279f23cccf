"""E2 lifecycle: build the models into a store.

The shared models are materialised first (written, then read back): the
activity model, which four marts read, and the price changes and classified
holds, whose marts carry box totals on every row.  Each is computed once and
its lineage is cut; every mart is
then written as its own box-partitioned table.  A mart's new version is
committed when it is whole; a failed run leaves the earlier one in place.

``refresh_models`` keeps the models of a stored set of tables up to date: it
notes which commit of every table the models stand for, takes the boxes whose
folders changed since, computes the models from these boxes' folders only and
replaces these boxes in every mart.  Every model is computed box by box, so
the rows of other boxes stay what they are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType

from studiolake.operators import activity as A
from studiolake.operators import classes as C
from studiolake.operators import health as H
from studiolake.operators import leads as L
from studiolake.operators import lifecycle as J
from studiolake.operators import money as M
from studiolake.operators import trends as T
from studiolake.sources import tables as S
from studiolake.sources.tables import write_table

def shared(tables: dict[str, DataFrame], as_of: dt.date) -> dict[str, DataFrame]:
    """The models that marts share, lazy."""
    return {
        "int_member_activity": A.member_activity(tables, as_of),
        "int_membership_changes": J.membership_changes(tables, as_of),
        "int_classified_freezes": J.classified_freezes(tables, as_of),
    }


def models(tables: dict[str, DataFrame], as_of: dt.date, la: dt.date, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All marts, lazy, over the shared models as stored."""
    activity = stored["int_member_activity"]
    return {
        "mart_health_scores": H.health_scores(tables, as_of, activity),
        "mart_members_snapshot": H.members_snapshot(tables, as_of, activity),
        "mart_retention": H.retention(tables, as_of, activity),
        "mart_freeze_events": J.freeze_events(tables, as_of, activity),
        "mart_member_trends": T.member_trends(tables, as_of),
        "mart_cohort_retention": T.cohort_retention(tables, as_of),
        "mart_monetization": M.monetization(tables, as_of),
        "mart_classes": C.classes_mart(tables),
        "mart_leads": L.leads_mart(tables, la),
        "mart_leads_upcoming_trials": L.upcoming_trials(tables, la),
        "mart_leads_detail": L.leads_detail(tables, la),
        "mart_leads_weekly_trend": L.leads_weekly(tables, la),
        "mart_leads_monthly_trend": L.leads_monthly(tables, la),
        "mart_plan_changes": J.plan_changes(tables, as_of, stored["int_membership_changes"]),
        "mart_freeze_outcomes": J.freeze_outcomes(tables, as_of, stored["int_classified_freezes"]),
        "mart_ltv_by_plan": J.ltv_by_plan(tables, as_of),
    }


def run_models(spark: SparkSession, tables: dict[str, DataFrame], out: str, as_of: dt.date,
               leads_as_of: dt.date | None = None) -> dict[str, str]:
    """Build every model whole."""
    stored = {n: write_table(df, f"{out}/{n}") for n, df in shared(tables, as_of).items()}
    marts = models(tables, as_of, leads_as_of or as_of, stored)
    for name, df in marts.items():
        write_table(df, f"{out}/{name}")
    return {n: f"{out}/{n}" for n in [*stored, *marts]}


def refresh_models(spark: SparkSession, store: str, out: str, as_of: dt.date, leads_as_of: dt.date | None = None) -> list[str] | None:
    """Bring the models in ``out`` up to the store's tables.  Returns the boxes (as text) that were computed, or None
    where all were: on the first run, for other dates, and where the boxes table itself changed."""
    la, note = leads_as_of or as_of, f"{out}/refreshed"
    now = {n: S.version(spark, f"{store}/{n}") for n in S.CANONICAL_TABLES}
    stamp = spark.createDataFrame([(n, v, as_of, la) for n, v in now.items()], "name string, number long, as_of date, leads_as_of date")
    known = S.read_table(spark, note).collect() if S.version(spark, note) else []  # one row per table
    then = {r.name: r.number for r in known if (r.as_of, r.leads_as_of) == (as_of, la)}
    if set(then) != set(now) or then["boxes"] != now["boxes"]:
        run_models(spark, S.load(spark, store), out, as_of, la)
        write_table(stamp, note)
        return None
    changed = {b for n in now if n != "boxes" and now[n] != then[n] for b in S.changed_boxes(spark, f"{store}/{n}", then[n])}
    if changed:
        kind = S.read_table(spark, f"{store}/members").schema[S.BOX].dataType
        ids = [None if b is None else (b if isinstance(kind, StringType) else int(b)) for b in sorted(changed, key=lambda b: (b is not None, b))]
        tables = S.load(spark, store, boxes=ids)
        for name, df in shared(tables, as_of).items():
            S.replace_boxes(df, f"{out}/{name}", ids)
        stored = {n: S.read_table(spark, f"{out}/{n}", ids) for n in shared(tables, as_of)}
        for name, df in models(tables, as_of, la, stored).items():
            S.replace_boxes(df, f"{out}/{name}", ids)
    write_table(stamp, note)
    return sorted(changed, key=lambda b: (b is not None, b))
