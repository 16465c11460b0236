"""The registered model queries ask for the whole job of their operators; nothing is trained here."""

import pytest

from tablegauge.operators import explain as E, models as K, screens as S, tuning as T
from tablegauge.plans import modeling_run
from tablegauge.queries import models as Q

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


def asked(monkeypatch, module, name, query, spark):
    def stop(*args, **named):
        raise Asked(args, named)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Asked) as found:
        query(spark, SF)
    return found.value.args


@pytest.mark.parametrize("query, wanted", [
    (Q.train_regressors, lambda: K.baselines(S.REGRESSION, 4)),
    (Q.classifier_sweep_and_vote, lambda: K.sweep_candidates(S.BINARY, 100, 3)),
    (Q.train_clusterings, lambda: K.sweep_candidates(S.CLUSTERING, 0, 0)),
])
def test_all_candidates(spark, monkeypatch, query, wanted):
    args, _ = asked(monkeypatch, K, "train_candidates", query, spark)
    assert [c.name for c in args[3]] == [c.name for c in wanted()]


def test_all_draws(spark, monkeypatch):
    args, named = asked(monkeypatch, T, "search", Q.random_search, spark)
    assert args[1:] == (S.BINARY, "random_forest") and not named
    assert args[0].count() == Q._label_rows(spark, SF).count() and T.DRAWS == 30 and len(T.draw("random_forest")) == 30


def test_all_families_and_columns(spark, monkeypatch):
    args, named = asked(monkeypatch, modeling_run, "model_table", Q.modeling_run, spark)
    assert "o_orderdate" in args[0].columns and "families" not in named


@pytest.mark.parametrize("name", ["permutation_importance", "sampled_shapley"])
def test_default_repeats_and_orders(spark, monkeypatch, name):
    _, named = asked(monkeypatch, E, name, getattr(Q, name), spark)
    assert not {"repeats", "orders"} & set(named)
