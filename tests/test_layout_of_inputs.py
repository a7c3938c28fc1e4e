"""How the views over the driver tables are dealt out."""

from panelmill.plans import fixtures as fx


def test_bars_are_dealt_once_and_by_their_number(spark, sf, monkeypatch):
    """Bars, levels and guesses share one shuffle, whose tasks grow with the table."""
    lines = fx.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(fx, "ROWS_PER_TASK", lines // 20)
    for view in (fx.bars, fx.levels, fx.predictions):
        plan = view(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, view.__name__
    assert fx.bars(spark, sf).rdd.getNumPartitions() in (20, 21)


def test_views_sorted_again_take_half_the_line_items(spark, sf, monkeypatch):
    """Fault-marked bars, levels and guesses are sorted and folded several times within a task."""
    lines = fx.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(fx, "ROWS_PER_TASK", lines // 10)
    for view in (fx.faulty_bars, fx.levels, fx.predictions):
        assert view(spark, sf).rdd.getNumPartitions() in (20, 21), view.__name__
    assert fx.bars(spark, sf).rdd.getNumPartitions() in (10, 11)
