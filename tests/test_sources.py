import pytest
from pyspark.sql import functions as F

from hyperloom.functions import treelets
from hyperloom.operators import incidence
from hyperloom.sources import labelled, text_formats
from hyperloom.streaming.windows import window_incidence, window_incidence_stream


def test_hypergraph_lines(spark, rows, tmp_path):
    (tmp_path / "h.txt").write_text("3 1,1;2\nno digits\n\n10-2\n10-2\n")
    inc = text_formats.read_hypergraph(spark, str(tmp_path / "h.txt"))
    assert sorted(r["value"] for r in text_formats.hypergraph_lines(inc).collect()) == ["1,2,3", "2,10", "2,10"]
    text_formats.write_hypergraph(inc, str(tmp_path / "out"))
    assert text_formats.read_hypergraph(spark, str(tmp_path / "out")).count() == 7


def graph(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line long, value string")


def test_graph_forms(spark, rows):
    adj = text_formats.graph_from_lines(graph(spark, ["2 1 2", "1 0", "1 0"]), "degree", 3, 2)
    want = [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert rows(adj) == want
    assert rows(text_formats.graph_from_lines(graph(spark, ["0 1 2", "1 0", "2 0"]), "node", 3, 2)) == want
    assert rows(text_formats.graph_from_lines(graph(spark, ["0 1", "1 0", "0 2", "2 0"]), "edges", 3, 2)) == want
    assert [r["value"] for r in text_formats.graph_lines(adj).orderBy("u").collect()] == ["2 1 2", "1 0", "1 0"]
    assert text_formats.graph_header(adj, 3).first()[0] == "3 2"


@pytest.mark.parametrize(("lines", "form", "m"), [(["0 3", "3 0"], "edges", 1), (["0 0", "0 0"], "edges", 1), (["0 1", "0 1"], "edges", 1), (["0 1"], "edges", 1), (["2 1"], "degree", 1)])
def test_graph_errors(spark, lines, form, m):
    with pytest.raises(text_formats.GraphFormatError):
        text_formats.graph_from_lines(graph(spark, lines), form, 3, m)


def test_selections_and_trees(spark, tmp_path):
    (tmp_path / "s").write_text("EXCLUDE 2684354560\n3221225472\n")
    assert text_formats.read_selection(spark, str(tmp_path / "s")) == ({2684354560, 3221225472}, False)
    with pytest.raises(ValueError):
        text_formats.selection_from_text("INCLUDE 5")
    assert text_formats.tree_from_text("0 1\n1 2\n") == treelets.path(3)


def test_tables_round_trip(spark, rows, tmp_path):
    t = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 2, 1)], "v long, s long, c int, n long")
    text_formats.write_tables({1: t, 2: t.limit(1)}, str(tmp_path / "t"))
    assert rows(text_formats.read_tables(spark, str(tmp_path / "t"), 2)[1]) == rows(t)


def test_labelled_records(spark, rows):
    articles = spark.createDataFrame([(1, "math.CO cs.DM"), (2, " cs.DM"), (3, None)], "id long, categories string")
    assert rows(labelled.article_records(articles, ["cs"])) == [(1, "cs.DM"), (2, "cs.DM")]
    assert rows(labelled.article_records(articles, primary_only=True)) == [(1, "math.CO"), (2, "cs.DM")]
    codes = spark.createDataFrame([(1, "2024-01-02", "A", "01", "B", "1", "02", "true", None), (2, "1999", "A", "01", "B", "1", "02", "0", "x")], "patent long, date string, section string, `class` string, subclass string, `group` string, subgroup string, inventive string, `primary` string")
    assert rows(labelled.patent_records(codes, "subgroup", years=(2000, 2025))) == [(1, "A01B1/02")]
    assert rows(labelled.patent_records(codes, "class", prefixes=["A0"], inventive=True)) == [(1, "A01")]
    posts = spark.createDataFrame([(1, 1, "<a><b-c>"), (2, 1, "|a|d|"), (3, 2, "<a>"), (10**9, 1, "<a>")], "id long, type int, tags string")
    made = labelled.question_records(posts)
    assert rows(made) == [(1, "a"), (1, "b-c"), (2, "a"), (2, "d")]
    assert rows(labelled.from_labels(made, "tag", "question", 2)) == [("a", 1), ("a", 2)]
    assert rows(labelled.numbered_labels(labelled.from_labels(made, "tag", "question"), by_size=True))[0] == ("a", 2, 1)


def test_patent_codes_and_flags(spark, rows):
    kinds = "patent long, date string, section string, `class` string, subclass string, `group` string, subgroup string, category string, inventive string, sequence string"
    codes = spark.createDataFrame([(1, "2024", "H", "01", "M", "8", "8/02", None, None, "0"), (2, "2024", "H", "01", "M", "8", "", "Inventional", "0", "7"), (3, "2024", "H", "01", "M", None, "10 /05", None, "maybe", "x"), (4, "2024", "H", "01", None, "8", "8/02", None, "yes", None)], kinds)
    assert rows(labelled.patent_records(codes, "subgroup")) == [(1, "H01M8/02"), (2, "H01M8/00"), (3, "H01M10/05")]
    assert rows(labelled.patent_records(codes, "group")) == [(1, "H01M8/00"), (2, "H01M8/00"), (3, "H01M10/05")]
    assert rows(labelled.patent_records(codes, "class", inventive=True)) == [(1, "H01"), (2, "H01"), (4, "H01")]
    assert rows(labelled.patent_records(codes, "class", primary=True)) == [(1, "H01"), (3, "H01"), (4, "H01")]
    posts = spark.createDataFrame([(1, 1, "&lt;c&#43;&#43;&gt;&lt;r&amp;d&gt;"), (2, 1, " |a|d| "), (3, 1, "one"), (4, 1, None), (5, 1, "")], "id long, type int, tags string")
    assert rows(labelled.question_records(posts)) == [(1, "c++"), (1, "r&d"), (2, "a"), (2, "d"), (3, "one")]


def test_digits_and_ids_beyond_their_types(spark, rows):
    lines = spark.createDataFrame([("1 99999999999999999999999 2",), ("9" * 30,)], "value string")
    assert rows(text_formats.hyperedges_from_lines(lines)) == [(0, 1), (0, 2)]
    ids = spark.createDataFrame([(3 * 10**9,), (9 * 10**18,)], "v long")
    from hyperloom.operators import counting

    assert all(0 <= r["color"] < 3 for r in counting.colored(ids, 3).collect())


def test_windows(spark, rows, tmp_path):
    events = spark.createDataFrame([(0, 7), (10, 7), (3599, 8), (3600, 7), (8000, None)], "t long, user_id long").select(F.timestamp_seconds("t").alias("ts"), "user_id")
    want = [(0, 7), (0, 8), (3600, 7)]
    assert rows(window_incidence(events)) == want
    events.write.parquet(str(tmp_path / "e"))
    stream = window_incidence_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windows")) == want


def test_incidence_of_dirty_rows(spark, rows):
    dirty = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (4, None)], "a long, b long")
    assert rows(incidence.incidence(dirty, "a", "b")) == [(1, 2)]
    assert incidence.gaifman(incidence.incidence(dirty.limit(0), "a", "b")).count() == 0
