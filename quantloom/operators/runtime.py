"""State, status documents and incidents of paper accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(name: str, value: bool = True) -> Column:
    """Whether a known flag has the value; unknown ones do not."""
    return F.coalesce(F.col(name) == value, F.lit(False))


def state_mode() -> Column:
    """What an account's last run did: being stopped comes before not being ready, that before being blocked.

    Without a broker's answer, the run's own marks (columns advanced and
    existed, if there are any) tell whether the state was made, moved or only previewed.
    """
    return (
        F.when(_is("kill_switch_active"), "broker_killed")
        .when(_is("broker_ready", False), "broker_not_ready")
        .when(F.coalesce("guardrail_violations", F.lit(0)) > 0, "broker_blocked")
        .when(F.col("orders_submitted") > 0, "broker_submitted")
        .when(F.col("orders_submitted") == 0, "broker_idle")
    )


# What to do next, by what an account's last run did.
NEXT_ACTIONS = {
    "broker_killed": "Deactivate or clear the broker kill switch before attempting another paper broker submission.",
    "broker_not_ready": "Resolve the broker readiness failure before attempting another paper broker submission.",
    "broker_blocked": "Resolve the broker guardrail violations before attempting another paper broker submission.",
    "broker": "Inspect the latest paper broker account and fill ledgers before promoting this flow toward a real broker adapter.",
    "orders": "Inspect the latest recommended orders before promoting this paper flow toward broker-backed paper execution.",
    "none": "No rebalance orders were generated; review freshness and wait for the next paper cycle.",
}


def runtime_state(runs: DataFrame) -> DataFrame:
    """One status row for each run of an account, with what it did and what to do next.

    Columns: those of ``incidents``, positions_existed, applied,
    positions_updated and recommended_orders. paper_state_advanced: orders were
    applied, or the broker moved the positions.
    """
    advanced = _is("applied") | _is("positions_updated")
    made = advanced & ~F.coalesce("positions_existed", F.lit(False))
    mode = F.coalesce(state_mode(), F.when(made, "bootstrapped").when(advanced, "advanced").otherwise("preview_only"))
    todo = F.when(F.col("orders_submitted").isNotNull(), NEXT_ACTIONS["broker"]).when(F.coalesce("recommended_orders", F.lit(0)) > 0, NEXT_ACTIONS["orders"]).otherwise(NEXT_ACTIONS["none"])
    for name in ("broker_blocked", "broker_not_ready", "broker_killed"):
        todo = F.when(mode == name, NEXT_ACTIONS[name]).otherwise(todo)
    return runs.withColumns({"paper_state_advanced": advanced, "paper_state_bootstrapped": made, "paper_state_mode": mode, "next_recommended_action": todo})


#: The parts of a status document that summaries read.
STATUS = (
    "struct<latest_market_date:string,paper_state_mode:string,paper_state_advanced:boolean,next_recommended_action:string,recommended_orders:struct<order_count:bigint>,"
    "paper_broker:struct<broker_backend:string,order_count_submitted:bigint,fill_count:bigint,ending_cash:double,ending_total_equity:double>,"
    "paper_broker_kill_switch:struct<active:boolean,reason:string>,paper_broker_readiness:struct<ready:boolean,connectivity_ok:boolean>,"
    "paper_broker_guardrails:struct<violation_count:bigint,ok_to_submit:boolean>,paper_broker_reconciliation:struct<ok:boolean,share_delta_count:bigint>>"
)


def status_documents(states: DataFrame) -> DataFrame:
    """(account, document): the JSON that a run leaves, from rows of ``runtime_state``; parts that are not known stay out."""
    part = lambda when, *fields: F.when(when, F.struct(*fields))
    doc = F.struct(
        F.date_format("market_date", "yyyy-MM-dd").alias("latest_market_date"), "paper_state_mode", "paper_state_advanced", "next_recommended_action",
        F.struct(F.col("recommended_orders").cast("long").alias("order_count")).alias("recommended_orders"),
        part(F.col("orders_submitted").isNotNull(), F.col("orders_submitted").cast("long").alias("order_count_submitted")).alias("paper_broker"),
        part(F.col("kill_switch_active").isNotNull(), F.col("kill_switch_active").alias("active")).alias("paper_broker_kill_switch"),
        part(F.col("broker_ready").isNotNull(), F.col("broker_ready").alias("ready")).alias("paper_broker_readiness"),
        part(F.col("guardrail_violations").isNotNull(), F.col("guardrail_violations").cast("long").alias("violation_count"), (F.col("guardrail_violations") == 0).alias("ok_to_submit")).alias("paper_broker_guardrails"),
        part(F.col("reconciled").isNotNull(), F.col("reconciled").alias("ok")).alias("paper_broker_reconciliation"),
    )
    return states.select("account", F.to_json(doc).alias("document"))


def runtime_summary(documents: DataFrame, latest_market_date: Column) -> DataFrame:
    """``documents`` (document: JSON or null) read back: whether there is one, whether it is of the latest market date, and its figures."""
    d = F.from_json("document", STATUS)
    out = documents.withColumn("__d", d)
    own = F.col("__d.latest_market_date")
    stale = F.when(F.col("document").isNull(), True).otherwise(F.coalesce(latest_market_date != own, latest_market_date.isNotNull()))
    names = {
        "recommended_order_count": "recommended_orders.order_count", "paper_broker_order_count": "paper_broker.order_count_submitted", "paper_broker_fill_count": "paper_broker.fill_count",
        "paper_broker_kill_switch_active": "paper_broker_kill_switch.active", "paper_broker_readiness_ready": "paper_broker_readiness.ready",
        "paper_broker_guardrail_violation_count": "paper_broker_guardrails.violation_count", "paper_broker_ok_to_submit": "paper_broker_guardrails.ok_to_submit", "paper_broker_reconciliation_ok": "paper_broker_reconciliation.ok",
    }
    rest = [c for c in documents.columns if c != "document"]
    return out.select(
        *rest, F.col("document").isNotNull().alias("status_exists"), latest_market_date.alias("latest_market_date"), own.alias("paper_market_date"), stale.alias("stale"),
        *[F.col(f"__d.{c}").alias(c) for c in ("paper_state_mode", "paper_state_advanced", "next_recommended_action")], *[F.col(f"__d.{v}").alias(k) for k, v in names.items()],
    )


def incidents(status: DataFrame) -> DataFrame:
    """``status`` with stale, state_mode, the incidents (code, severity) and the highest severity.

    Columns: account, market_date (null: no status yet), latest_market_date,
    kill_switch_active, broker_ready, guardrail_violations, reconciled,
    orders_submitted. Unknown flags raise nothing.
    """
    stale = F.coalesce(F.col("market_date") != F.col("latest_market_date"), F.lit(False))

    def found(when: Column, code: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    rules = F.array(
        found(F.col("market_date").isNull(), "paper_runtime_missing", "error"),
        found(stale, "paper_runtime_stale", "error"),
        found(_is("kill_switch_active"), "paper_broker_kill_switch_active", "error"),
        found(_is("broker_ready", False), "paper_broker_not_ready", "error"),
        found(F.coalesce("guardrail_violations", F.lit(0)) > 0, "paper_broker_guardrails_blocked", "warning"),
        found(_is("reconciled", False), "paper_broker_reconciliation_failed", "error"),
    )
    out = status.withColumns({"stale": stale, "state_mode": F.coalesce(state_mode(), F.lit("preview_only")), "incidents": F.array_compact(rules)})
    has = lambda s: F.exists("incidents", lambda x: x["severity"] == s)
    return out.withColumn("highest_severity", F.when(has("error"), "error").when(has("warning"), "warning").otherwise("ok"))


def severity_counts(found: DataFrame) -> DataFrame:
    """``incidents`` with how many of each severity, and whether there are none."""
    n = lambda s: F.size(F.filter("incidents", lambda x: x["severity"] == s))
    return found.withColumns({"incident_count": F.size("incidents"), "error_count": n("error"), "warning_count": n("warning"), "ok": F.size("incidents") == 0})
