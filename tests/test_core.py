import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.casualties import casualties_of, digits
from quillon.operators import entity, retrieval
from quillon.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, killed, injured",
    [
        ("The death toll rose to 12. Over 50 people were hospitalized", 12, 50),
        ("The attack claimed 22 lives", 22, 0),
        ("Forty five soldiers were killed", 45, 0),
        ("Nothing happened", 0, 0),
        ("8 soldiers and 2 civilians were wounded", 0, 16),  # parity: the span pattern and the pair rule both take the 8
        ("In addition to the attacker, 5 people were killed", 6, 0),
    ],
)
def test_casualties(text, killed, injured):
    assert casualties_of(text) == (killed, injured)


def test_number_words():
    assert digits("twenty-five and dozens") == "25 and 24"


def test_detect(spark):
    rows = [(0, "Terrorists attacked an army camp; 5 soldiers were killed."), (1, "The charge sheet names accused persons; hearing on bail."), (2, "Officials met."), (3, None)]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", T.detect(F.col("t"))["class"]).collect())
    assert (got[0], got[1], got[2]) == ("ACCEPT", "REJECT", "NEUTRAL")


def test_dates(spark):
    rows = [("on 2019-04-21",), ("on 13/2/2019",), ("21 April 2019",), ("April 3rd, 2020",), ("none",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.date_of(F.col("t")).cast("string")).collect()]
    assert got == ["2019-04-21", "2019-02-13", "2019-04-21", "2020-04-03", None]


def test_upsert_last_wins(spark):
    old, new = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), spark.createDataFrame([(2, 3), (3, 4)], "k int, v int")
    assert sorted(map(tuple, entity.upsert(old, new, "k").collect())) == [(1, 1), (2, 3), (3, 4)]


def test_budget_cuts_once(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 500), (1, 2, "b" * 800), (1, 3, "c")], "query_id int, rank int, block string")
    got = retrieval.budget(rows, 1000).collect()
    assert [len(r.block) for r in got] == [500, 500 + len("... [TRUNCATED]\n\n")]


@pytest.mark.parametrize("name", ["fx_attack", "fx_casualties", "er_should_merge", "snk_upsert", "r_query", "w_budget", "qf_filters", "ag_mrr"])
def test_oracle(spark, name):
    db = duckdb.connect()
    for table in ("events", "documents", "embeddings", "conversations", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
