"""Routing: one question of our own for every branch of the decision and for the edges of the scores."""

from pyspark.sql import functions as F

from lexgrove.operators import routing
from lexgrove.plans.bindings import QUESTIONS

#: In the order of ``QUESTIONS``.
ROUTES = ["legal", "verdict", "trademark", "trademark", "combined", "combined", "combined", "legal", "legal"]


def routes(spark, questions, rules=None):
    df = spark.createDataFrame(list(enumerate(questions)), "i int, q string")
    return [r["route"] for r in routing.with_route(df, "q", rules).orderBy("i").collect()]


def test_every_branch_of_the_built_in_rules(spark):
    assert routes(spark, QUESTIONS) == ROUTES
    assert routes(spark, [None, "", " \t\n"]) == ["legal"] * 3


def test_edges_of_the_scores(spark):
    rules = routing.RoutingRules(
        verdict=["v1", "v2", "v3"], legal=["l1", "l2", "l3"], trademark=["t1", "t2"], advisory=["advise", "help"]
    )
    expected = {
        "t1 t2 v1 v2 v3 l1 l2": "trademark",  # two marks outweigh all
        "t1 v1 v2 l1": "trademark",
        "t1 v1 v2 v3 l1": "verdict",  # one mark does not, beside three signs of a verdict
        "t1 v1 v2 l1 l2": "combined",
        "advise v1": "combined",
        "help": "legal",  # advice about nothing that was judged
        "v1 v2 l1 l2": "combined",
        "v1 v2 l1": "verdict",
        "v1": "combined",
        "v1 l1": "combined",
        "l1 v1 l2": "legal",
        "l1": "legal",
        "nothing": "legal",
        "V1 v1 v1": "combined",  # a pattern counts once
    }
    assert routes(spark, list(expected), rules) == list(expected.values())


def test_fan_out(spark):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, q string")
    routed = routing.with_route(asked, "q")
    search = lambda name: lambda q: q.select("query_id", F.lit(name).alias("by"))
    out = routing.fan_out(routed, {r: search(r) for r in ("legal", "verdict", "trademark", "combined")})
    assert out.count() == len(QUESTIONS) and out.where("by <> route").count() == 0


def test_turns_of_a_conversation_share_a_search(spark, data, monkeypatch):
    from lexgrove.plans import bindings

    asked, search = [], bindings.vectors.cosine_topk

    def counted(queries, *more):
        asked.append((queries.count(), queries.select("query_id").distinct().count()))
        return search(queries, *more)

    monkeypatch.setattr(bindings.vectors, "cosine_topk", counted)
    rows = bindings.routed_search(spark, data)
    turns = rows.select("query_id").distinct().count()
    assert asked[0][0] == asked[0][1] < turns
