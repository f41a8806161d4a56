"""Every usable rebalance date is fitted."""

from quantloom.operators import models
from quantloom.plans import registry, trading

SF = "/root/testdata/sf0.001"


def _usable(spark):
    frame = trading._learning(spark, SF)
    live = frame.where("eligible_universe and enough_history and has_model_features").select("date").distinct()
    return {r.rebalance_date for r in trading._bounds(frame).where("usable").join(live, live["date"] == trading.F.col("rebalance_date")).collect()}


def test_networks_fit_every_usable_date_with_early_stopping(spark, monkeypatch):
    asked = {}
    own = models.network_predictions

    def spy(rows, bounds, kind, live, **options):
        asked[kind] = options
        return own(rows, bounds, kind, live, **options)

    monkeypatch.setattr(models, "network_predictions", spy)
    for q in ("q10_mlp", "q11_tcn", "q12_hybrid", "q13_lstm", "q14_transformer"):
        got = registry.QUERIES[q](spark, SF)
        if q == "q10_mlp":
            assert len(_usable(spark)) > 3
            assert _usable(spark) <= {r.date for r in got.select("date").distinct().collect()}
    assert len(asked) == 5 and not any("epochs" in o for o in asked.values())


def test_trees_fit_every_usable_date(spark):
    got = registry.QUERIES["q9_gradient_trees"](spark, SF)
    assert got.columns == ["date", "ticker", "predicted_return"]
    assert {r.date for r in got.select("date").distinct().collect()} == _usable(spark)
