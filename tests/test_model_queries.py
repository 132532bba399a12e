"""Model queries run as the operators' defaults say, over all assets."""

import inspect

import __spark_entry__ as entry
from galewatch.operators import boosting
from galewatch.plans.views import predictions


def test_boosting_has_its_default_rounds(spark, monkeypatch):
    train, seen = boosting.fit, []
    default = inspect.signature(train).parameters["rounds"].default

    def quick(rows, columns, rounds=default, **more):
        seen.append(rounds)
        return train(rows, columns, rounds=2, **more)

    monkeypatch.setattr(boosting, "fit", quick)
    assert entry.queries()["m6_boosted"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [default] and default == 250


def test_every_asset_has_a_split(spark):
    sf = "/root/testdata/sf0.01"
    rows = entry.queries()["o8_asset_splits"](spark, sf).collect()
    assert sorted(r.asset_id for r in rows) == sorted(r.asset_id for r in predictions(spark, sf).select("asset_id").distinct().collect())
    assert len(rows) > 22
