"""What the driver is spared: long texts of plans, waves that join nothing, and freed memory that it would keep."""

from riskloom.llm import io, jaccard
from riskloom.llm.io import written


def test_tables_between_steps_describe_their_plans_briefly(spark):
    key = "spark.sql.ui.explainMode"
    before = spark.conf.get(key)
    written(spark.range(10).selectExpr("id % 3 as k").groupBy("k").count(), "brief")
    text = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
    # operators are not listed once more with what they read and are told
    assert "HashAggregate" in text and "\nArguments: " not in text
    assert spark.conf.get(key) == before


def test_a_wave_that_joins_nothing_is_the_last_before_all_pairs(spark, monkeypatch):
    waves, crossing = [], jaccard.crossing
    monkeypatch.setattr(jaccard, "crossing", lambda listed, state, wave: waves.append(wave) or crossing(listed, state, wave))
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(8))) for i in range(6)]
    rows = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == set(range(6)) and waves == [1, 0]


def test_tables_between_steps_return_what_the_driver_has_freed(spark, monkeypatch):
    said, give_back = [], io.give_back
    monkeypatch.setattr(io, "give_back", lambda session: said.append(give_back(session)))
    assert written(spark.range(10), "returned").count() == 10
    # Java 17.0.9 and later with the GNU C library
    assert len(said) == 1 and "Trim native heap: " in said[0]
