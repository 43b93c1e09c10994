"""Votes: a task aggregates a bounded number of ids, however many there are."""

from tabloom.operators import automl
from tabloom.plans import QUERIES


def test_tasks_follow_the_rows(spark):
    assert automl.dealt(spark.range(10), "id", 1_000_001).rdd.getNumPartitions() == 11
    assert automl.dealt(spark.range(10), "id", 0).rdd.getNumPartitions() == 1


def test_votes_move_their_rows_once(spark, tiny):
    for name in ("vote_soft", "vote_hard"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name
        assert plan.count("Exchange hashpartitioning") <= (2 if name == "vote_soft" else 1), plan
