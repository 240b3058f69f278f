import json

import pytest

from polyad.functions.vocabulary import POLITICAL_LEXICON, political_lexicon
from polyad.operators import articles as art
from polyad.sources import lake


@pytest.fixture()
def labelled(spark, tmp_path):
    """Five rows of four articles: one with two topics, one that only repeats another's body, an accent, and a body of blanks."""
    lines = [
        "news_index,id,publish_date,title,body,tema_local",
        "p7,71,2018-11-30,Presupuesto,El ministro defendió el presupuesto.,hacienda",
        "p7,72,2018-11-30,Presupuesto,El ministro defendió el presupuesto.,gobierno",
        "q2,20,2020-02-08,Alcaldía,La alcaldesa niega las críticas.,municipios",
        "q9,90,2020-06-17,Otra vez,La alcaldesa niega las críticas.,municipios",
        "r1,11,2020-09-01,Nada,   ,gobierno",
        "s5,50,2020-12-24,Ñuble,Ñuble elige a su gobernador.,regiones",
    ]
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    root = str(tmp_path / "lake")
    assert lake.build_labelled_lake(spark, str(path), root)["n_articles"] == 3
    return spark.read.parquet(root)


@pytest.fixture()
def news(spark, tmp_path):
    schema = "id string, title string, body string, source string, country string, publish_date string, year int"
    rows = [
        ("w1", "Debate", "Anoche Lagos respondió a Lavín.", "diario", "cl", "2017-03-02", 2017),
        ("w2", "Gira", "Lagos visitó el sur.", "diario", "cl", "2017-03-09", 2017),
        ("w3", "Trámite", "La comisión mixta del congreso revisó el veto.", "radio", "cl", "2016-08-20", 2016),
        ("w4", "Memoria", "Aylwin y Frei en una foto.", "radio", "cl", "2015-01-11", 2015),
        ("w5", None, "   ", "radio", "cl", "sin fecha", None),
    ]
    src, root = str(tmp_path / "src"), str(tmp_path / "news")
    spark.createDataFrame(rows, schema).write.parquet(src)
    assert lake.build_news_lake(spark, src, root)["n_articles"] == 4
    return spark.read.parquet(root)


GAZ = ["lagos", "lavín", "aylwin", "frei"]


def ids(df):
    return {r["src_id"] for r in df.collect()}


def test_lake_from_csv(labelled):
    rows = {r["news_index"]: r for r in labelled.collect()}
    assert set(rows) == {"p7", "q2", "s5"} and rows["s5"]["body"] == "Ñuble elige a su gobernador."
    assert {r["year"]: r["n"] for r in art.counts_by_year(labelled).collect()} == {2018: 1, 2020: 2}
    assert art.top_values(labelled).columns == ["tema_local", "n"]


def test_loading(labelled, news):
    assert {r["news_index"] for r in art.load(labelled, topics=["municipios"]).collect()} == {"q2"}
    assert {r["news_index"] for r in art.load(labelled, (2019, 2022)).collect()} == {"q2", "s5"}
    two, three = ([r["article_id"] for r in art.load(labelled, limit=n).collect()] for n in (2, 3))
    assert len(two) == 2 and three[:2] == two
    with pytest.raises(ValueError):  # the production corpus has no topics
        art.load(news, topics=["gobierno"])


def test_ranked_names(spark):
    ends = spark.createDataFrame([("Ana Tijoux", "Lagos"), ("Lagos", "ana tijoux "), (None, "xy"), ("Lagos", "Frei")], "from_node_label string, to_node_label string")
    assert [(r["name"], r["n"]) for r in art.gazetteer(ends).collect()] == [("lagos", 3), ("ana tijoux", 2), ("frei", 1)]


def test_prefilter(news):
    terms = ["comisión mixta", "congreso", "veto"]
    assert ids(art.political(news, GAZ)) == {"w1", "w4"} and ids(art.political(news, GAZ, years=(2016, 2017))) == {"w1"}
    assert ids(art.political(news, GAZ, min_actors=1)) == {"w1", "w2", "w4"}
    either = art.political(news, GAZ, terms)
    assert ids(either) == {"w1", "w3", "w4"}
    assert ("matched_lexicon" in either.columns, "matched_lexicon" in art.political(news, GAZ).columns) == (True, False)
    assert ids(art.political(news, ["lag"], min_actors=1)) == {"w1", "w2"} and not ids(art.political(news, ["lag"], min_actors=1, word_boundary=True))


def test_lexicon():
    assert len(POLITICAL_LEXICON) == len(set(POLITICAL_LEXICON)) >= 40 and all(t == t.lower() for t in POLITICAL_LEXICON)
    assert political_lexicon(["NUEVO", "nuevo", "senado"])[-1] == "nuevo"


def test_lines_round_trip(spark, tmp_path):
    lines = lake.request_lines(spark.createDataFrame([("k", "a\nb")], "key string, prompt string"), "sys").collect()[0]["value"]
    assert json.loads(lines)["request"]["contents"][0]["parts"][0]["text"] == "a\nb"
    df = spark.createDataFrame([('{"key":"a","response":{"candidates":[{"content":{"parts":[{"text":"x"}]}}]}}',), ('{"key":"b"}',)], "value string")
    assert {tuple(r) for r in lake.response_lines(df).collect()} == {("a", "x"), ("b", "")}
    parts = lake.split_lines(spark.range(10), 3, "id").groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [4, 4, 2]
    assert lake.replace_table(spark.range(3).toDF("id"), str(tmp_path / "t")) == 3
    assert lake.replace_table(spark.range(5).toDF("id"), str(tmp_path / "t")) == 5
    assert lake.cached_by_count(spark.range(5), str(tmp_path / "t")).count() == 5


def test_tables_are_replaced_inserted_and_recovered(spark, tmp_path):
    at = str(tmp_path / "t")
    lake.replace_table(spark.range(4), at)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a crash between the two moves leaves it
    assert lake.recover_table(spark, at) and spark.read.parquet(at).count() == 4 and not lake.recover_table(spark, at)
    assert lake.replace_tables({"t": spark.range(2), "u": spark.read.parquet(at)}, str(tmp_path)) == {"t": 2, "u": 4}
    assert spark.read.parquet(str(tmp_path / "u")).count() == 4
    spark.sql("CREATE TABLE into_me (a int, b string) USING parquet")
    lake.insert_into(spark.createDataFrame([("x",)], "b string"), "into_me")
    lake.insert_into(spark.createDataFrame([("y", 3)], "b string, a long"), "into_me")
    assert {tuple(r) for r in spark.table("into_me").collect()} == {(None, "x"), (3, "y")}
    with pytest.raises(ValueError):
        lake.insert_into(spark.range(1), "into_me")
    spark.sql("DROP TABLE into_me")
    lake.write_json_list(spark, [{"á": 1}, "b"], f"file://{tmp_path}/l.json")
    assert lake.read_json_list(spark, f"file://{tmp_path}/l.json") == [{"á": 1}, "b"]


def test_parts_put_together(spark):
    a, b = (spark.createDataFrame(r, "k string, v int") for r in ([("x", 1), ("y", 2), ("y", 2)], [("x", 9), ("z", 3)]))
    assert {tuple(r) for r in lake.first_of([a, b], "k").collect()} == {("x", 1), ("y", 2), ("z", 3)}
    assert {tuple(r) for r in lake.first_of([a, b], "k", last=True).collect()} == {("x", 9), ("y", 2), ("z", 3)}
    assert lake.union_distinct([a, b]).count() == 4 and lake.round_robin(spark.range(40), 4).rdd.getNumPartitions() == 4
    assert [r["v"] for r in lake.first_rows(a, 2, "v").collect()] == [1, 2]


def test_stream_adds_each_article_once(spark, tmp_path):
    from polyad.streaming import ingest

    schema = "id string, title string, body string, source string, country string, publish_date string, year int"
    src, root, mark = (str(tmp_path / x) for x in ("src", "lake", "mark"))
    for k in range(2):
        spark.createDataFrame([("a", "t", "same body", "s", "cl", "2020-01-01", 2020), (f"b{k}", "t", f"body {k}", "s", "cl", "2021-01-01", 2021)], schema).write.mode("append").parquet(src)
        ingest.into_lake(ingest.read_news(spark, src, schema), root, mark).awaitTermination()
    assert spark.read.parquet(root).count() == 3


def test_plans(spark, smallest):
    from polyad.operators import graph
    from polyad.plans import fixtures as fx

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan(graph.signed_degree_view(fx.nodes(spark, smallest), fx.edges(spark, smallest)))
    assert "TakeOrderedAndProject" in plan(art.load(fx.articles(spark, smallest), limit=5))
