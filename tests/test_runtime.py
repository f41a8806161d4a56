import datetime as dt

from quantloom.operators.runtime import incidents

SCHEMA = "account int, market_date date, latest_market_date date, kill_switch_active boolean, broker_ready boolean, guardrail_violations int, reconciled boolean, orders_submitted int"


def test_modes_and_incidents(spark):
    d, e = dt.date(2025, 1, 2), dt.date(2025, 1, 3)
    rows = [(1, d, d, False, True, 0, True, 2), (2, d, e, True, False, 1, None, 0), (3, None, d, None, None, None, None, None), (4, d, d, False, True, 2, True, 0), (5, d, d, None, False, None, False, 0)]
    got = {r.account: (r.state_mode, [x.code for x in r.incidents], r.highest_severity) for r in incidents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        1: ("broker_submitted", [], "ok"),
        2: ("broker_killed", ["paper_runtime_stale", "paper_broker_kill_switch_active", "paper_broker_not_ready", "paper_broker_guardrails_blocked"], "error"),
        3: ("preview_only", ["paper_runtime_missing"], "error"),
        4: ("broker_blocked", ["paper_broker_guardrails_blocked"], "warning"),
        5: ("broker_not_ready", ["paper_broker_not_ready", "paper_broker_reconciliation_failed"], "error"),
    }
