import pytest
from haulstat.operators import permutations as M
from haulstat.plans import embeddings as E
from haulstat.plans import scorecards
from haulstat.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["i13_residual_signal_probe", "i14_panel_score_probe"])
def test_the_price_frame_is_made_once_for_all_pools(spark, sf_dir, monkeypatch, name):
    made = []
    plain = E.frame
    monkeypatch.setattr(E, "frame", lambda t: made.append(1) or plain(t))
    assert len(QUERIES[name](spark, sf_dir).collect()) == len(E.POOLS) and len(made) == 1


def test_ranked_adverts_are_read_from_tables(spark, sf_dir):
    from haulstat.plans.registry import Tables
    plan = scorecards.rank_frame(Tables(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "lineitem" not in plan


def test_the_random_order_is_not_shuffled(spark):
    df = spark.range(50).selectExpr("id", "cast(id as double) AS v", "1.0 AS x")
    plan = M.permuted_sums(df, "v", ["x"], "id", 5, "s")._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("RepartitionByExpression"):]
    assert "md5(s|" not in sent and "md5(concat_ws(|, s," not in sent
