"""What the run queries hand to the fit: iterations, stages and vectors."""

from __future__ import annotations

import inspect
import os

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

import queries as named
from pairloom.plans import features, modeling

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
named.load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


class Fitted(Exception):
    pass


def fitted_with(monkeypatch, spark, name: str) -> inspect.BoundArguments:
    """The arguments of the first fit of a query, which ends there."""
    signature = inspect.signature(modeling.fit)

    def stop(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Fitted(bound)

    monkeypatch.setattr(modeling, "fit", stop)
    with pytest.raises(Fitted) as ended:
        named.QUERIES[name](spark, SF)
    return ended.value.args[0]


def test_network_runs_all_its_iterations_and_can_stop_early(spark, monkeypatch):
    bound = fitted_with(monkeypatch, spark, "mlp_scores").arguments
    assert bound["estimator"].getMaxIter() == 40
    assert bound["stages"] == 5 and bound["patience"] < bound["stages"]


@pytest.mark.parametrize("name", ["model_round_trip", "cross_dataset_run", "scenario_run"])
def test_runs_use_the_defaults_of_the_library(spark, monkeypatch, name):
    bound = fitted_with(monkeypatch, spark, name).arguments
    assert bound["estimator"].getMaxIter() == LogisticRegression().getMaxIter() and bound["stages"] == 5
    width = inspect.signature(features.hash_featurize).parameters["dim"].default
    assert bound["pairs"].select(F.size("features").alias("n")).first()["n"] == 2 * width


def test_cross_dataset_run_trains_on_every_order(spark, monkeypatch):
    """Every order reaches the split."""
    from pairloom.plans import pipelines
    from queries import bindings as B

    given = []

    def stop(train, *args, **kwargs):
        given.append(train)
        raise Fitted

    monkeypatch.setattr(pipelines, "cross_eval", stop)
    with pytest.raises(Fitted):
        named.QUERIES["cross_dataset_run"](spark, SF)
    rows = B.order_records(spark, SF).count()
    assert given[0].checked.count() == given[0].tables.relation.count() == rows


def test_scenario_run_writes_every_line_to_the_folds(spark, monkeypatch):
    from pairloom.plans import pipelines
    from queries import bindings as B

    given = []

    def stop(spark, scenario, config, *args, **kwargs):
        given.append(config)
        raise Fitted

    monkeypatch.setattr(pipelines, "scenario_runs", stop)
    with pytest.raises(Fitted):
        named.QUERIES["scenario_run"](spark, SF)
    folds = f"{given[0]['root_path']}/{given[0]['data_path']}"
    assert spark.read.csv(folds, header=True).count() == B.table(spark, SF, "lineitem").count()
