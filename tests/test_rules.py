"""Rules worked out by hand."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import align, citations, diff, extract, fulltext, graph, incremental, judge, lines, lists, ranges, search
from folio.plans.filters import Filters
from folio.queries import QUERIES
from folio.sources import readers, sinks


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


CATALOGUE = "number int, title string, keywords array<string>, abstract string, status string, is_obsolete boolean"


def test_score(spark):
    rows = [(1, "red widget", [], "", "PS", False), (2, "widget", [], "", "PS", False), (3, "other", [], "about a widget", "INFO", True)]
    df = spark.createDataFrame(rows, CATALOGUE)
    score = lambda q: {r["number"]: r["score"] for r in search.scored(df, q, ("PS",)).collect()}
    assert score("red widget") == {1: 175}
    assert score("widget") == {1: 65, 2: 95, 3: 5}
    assert score("red zzz") == {}
    assert score("") == {1: 1, 2: 2, 3: 3}


def test_number_prefix(spark):
    df = spark.createDataFrame([(99,), (991,), (9910,), (199,)], "number int")
    assert [r["number"] for r in search.by_number(df, "99").collect()] == [99, 9910, 991]


@pytest.mark.parametrize(
    "filters, kept",
    [
        (Filters(years=(2022, 2020)), {1, 2}),
        (Filters(after=(2023, 6)), {4}),
        (Filters(after=(2023, None)), {3, 4}),
        (Filters(before=(2023, 7)), {1, 2, 3}),
        (Filters(within=(1, date(2023, 12, 1))), {3}),
        (Filters(), {1, 2, 3, 4}),
    ],
)
def test_dates(spark, filters, kept):
    rows = [(1, 2020, 1, 1), (2, 2022, 5, None), (3, 2023, None, None), (4, 2023, 7, 2)]
    df = spark.createDataFrame(rows, "number int, year int, month int, day int")
    assert {r["number"] for r in df.where(filters.predicate()).collect()} == kept


def test_text_functions(spark):
    assert one(spark, T.fold(F.col("x")), x="Café ÑANDÚ Straße") == "cafe nandu straße"
    assert one(spark, T.keywords(F.col("x")), x="You MUST NOT stop and SHOULD go; must") == ["MUST NOT", "SHOULD"]
    assert one(spark, T.sentences(F.col("x")), x="See Sec. 4. It holds. e.g. this one? Yes") == ["See Sec. 4.", "It holds. e.g. this one?", "Yes"]
    assert one(spark, T.opening(F.col("x"), 400, 10), x="one two three four") == "one two…"
    assert "".join(one(spark, T.diff_tokens(F.col("x")), x=" a  b\nc ")) == " a  b\nc "
    assert tuple(one(spark, T.document_id(F.col("x")), x="bcp14")) == ("BCP", 14)
    assert one(spark, T.document_id(F.col("x")), x="hello") is None
    assert tuple(one(spark, T.link_target(F.col("x")), x="https://example.org/rfc/rfc9110.html")) == ("RFC", 9110)
    assert one(spark, T.section_anchor(F.col("x")), x="4.2") == "section-4.2"
    assert one(spark, T.place_name(F.col("x")), x="A.1") == "Appendix A.1"
    assert one(spark, T.version_key(F.col("x")), x="2026.10.2") == [2026, 10, 2]
    assert one(spark, T.alignment_words(F.col("x")), x="The -key- words, a re-use of it") == ["key", "words", "re-use"]
    assert one(spark, readers.month_number(F.col("x")), x="Sept") == 9
    assert one(spark, sinks.csv_line(F.col("x"), F.lit(1)), x='a "b", c') == '"a ""b"", c",1'


def test_section_narrowing(spark):
    df = spark.createDataFrame([("section-1", "1"), ("section-1.2", "1.2"), ("section-10", "10")], "anchor string, number string")
    assert {r["number"] for r in fulltext.in_section(df, "1").collect()} == {"1", "1.2"}
    assert {r["number"] for r in lines.subtree(df, "1").collect()} == {"1", "1.2"}


def test_bag_match_and_ratios(spark):
    found = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    expected = spark.createDataFrame([("a",), ("c",)], "k string")
    total = judge.precision_recall(judge.bag_match(found, expected, ["k"]), []).first()
    assert (total["tp"], total["fp"], total["fn"]) == (1, 2, 1)


def test_intervals_touching_stay_apart(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 7, 9)], "k int, lo int, hi int")
    assert {(r["lo"], r["hi"]) for r in ranges.merged(df, ["k"], "lo", "hi").collect()} == {(0, 5), (5, 9)}


def test_eviction(spark):
    df = spark.createDataFrame([(1, i, i, b, False) for i, b in enumerate((5, 4, 3))], "owner int, id int, opened int, bytes int, pinned boolean")
    assert {r["id"] for r in lists.victims(df, 6).collect()} == {0, 1}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (8, 9)], "a int, b int")
    roots = spark.createDataFrame([(1,)], "root int")
    deep = graph.depths(edges, roots)
    assert {(r["node"], r["depth"]) for r in deep.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {(r["node"], r["component"]) for r in graph.components(edges).collect()} == {(n, 1) for n in (1, 2, 3, 4)} | {(8, 8), (9, 8)}


def test_long_path_is_one_component(spark):
    edges = spark.range(40).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in graph.components(edges).select("component").distinct().collect()} == {0}


def test_assumed_is_strictly_more(spark):
    rows = [(i, 1, 0, "normative") for i in range(4)] + [(i, 2, 0, "normative") for i in range(3)] + [(i, 3, 0, "unknown") for i in range(10)]
    df = spark.createDataFrame(rows, "citing int, cited int, place int, kind string")
    assert {r["cited"] for r in citations.assumed(df, 0.3).collect()} == {1}


def test_baseline_and_carry(spark):
    before = spark.createDataFrame([(1, ["a"]), (2, None)], "k int, s array<string>")
    after = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["d"])], "k int, s array<string>")
    assert {(r["k"], r["item"]) for r in incremental.baseline_events(before, after, "k", ["s"]).collect()} == {(1, "b"), (2, "c")}
    listed, new, old = (spark.createDataFrame(x, "k int, v string") for x in ([(1, ""), (2, ""), (3, "")], [(1, "n")], [(1, "o"), (2, "o"), (9, "o")]))
    assert {tuple(r) for r in incremental.carried(listed, new, old, "k", "v").collect()} == {(1, "n", "read"), (2, "o", "carried"), (3, None, "none")}


def test_shrink_guard(spark):
    assert judge.may_publish(spark.range(12), spark.range(6)) and not judge.may_publish(spark.range(12), spark.range(5)) and judge.may_publish(spark.range(9), spark.range(0))


def test_alignment_floor(spark):
    rows = [(1, "old", 0, 0, "alpha", "common words here"), (1, "new", 0, 0, "alpha", "common words here"), (1, "new", 1, 1, "alpha", "nothing alike")]
    df = spark.createDataFrame(rows, "pair int, side string, sec int, pos int, title string, body string")
    assert [(r["old"], r["new"], round(r["score"], 6)) for r in align.aligned(align.candidates(df)).collect()] == [(0, 0, 1.0)]


def test_diff_rebuilds_both_texts(spark):
    row = spark.createDataFrame([("a b  c", "a x  c d")], "old string, new string").select(diff.word_diff()("old", "new").alias("d")).first()["d"]
    assert "".join(x["text"] for x in row if x["kind"] != "added") == "a b  c"
    assert "".join(x["text"] for x in row if x["kind"] != "removed") == "a x  c d"


def test_abbreviations(spark):
    df = spark.createDataFrame([(1, "The Transport Layer Security (TLS) is used. Later Total Loss (TLS)."), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in extract.abbreviations(df).collect()] == [(1, "TLS", "Transport Layer Security")]


def test_xml_catalogue(spark, tmp_path):
    path = tmp_path / "index.xml"
    path.write_text(
        "<index><entry><doc-id>RFC0007</doc-id><title>A  b\n c</title><author><name>N. One</name></author><date><month>May</month><year>1999</year></date>"
        "<obsoleted-by><doc-id>RFC0009</doc-id></obsoleted-by><current-status>ODD</current-status></entry>"
        "<entry><doc-id>RFC0008</doc-id><title>No year</title></entry></index>"
    )
    rows = readers.catalogue(spark, str(path), "entry").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["number"], r["title"], r["date"]["month"], r["current_status"], r["stream"], r["is_obsolete"]) == (7, "A b c", 5, "UNKNOWN", "Legacy", True)


def test_feed_and_registry(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>RFC 12: Title</title><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item><item><title>News</title></item></channel></rss>")
    rows = readers.feed(spark, str(tmp_path / "f.xml")).collect()
    assert [(r["number"], r["title"], str(r["published"])) for r in rows] == [(12, "Title", "2024-03-05 10:00:00")]
    (tmp_path / "r.xml").write_text("<registry><record><value>10-20</value><name>ten</name></record><record><value>21</value><name>Unassigned</name></record></registry>")
    reg = readers.registry(spark, str(tmp_path / "r.xml"))
    terms = spark.createDataFrame([("15",), ("21",), ("0x0F",), ("x",)], "term string")
    assert [(r["term"], r["name"]) for r in ranges.registry_lookup(terms, reg).collect()] == [("15", "ten")]


def test_checks_due_to_the_microsecond(spark, tmp_path):
    at = ["2024-01-19 00:00:00", "2024-01-19 00:00:00.4", "2024-01-13 00:00:00", "2024-01-13 00:00:00.000001"]
    rows = [(i, ts, 1, "view", 0.0) for i, ts in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["key"]: (r["is_due"], r["etag"]) for r in QUERIES["checks_due"](spark, str(tmp_path)).collect()}
    assert got == {0: (True, "view"), 1: (False, "view"), 2: (True, None), 3: (True, "view")}


def test_ranges_meet_few_values_that_they_lack(spark):
    """Narrow ranges go to narrow cells, however wide the cells that were asked for."""
    values = spark.range(4000).select((F.col("id") / 2).alias("v"))
    bands = spark.range(400).select(F.col("id").alias("band"), (F.col("id") * 5.0).alias("lo"), (F.col("id") * 5.0 + 3).alias("hi"))
    points = spark.range(100).select((F.col("id") + 1000).alias("band"), (F.col("id") * 20.0).alias("lo"), (F.col("id") * 20.0).alias("hi"))
    both = bands.unionByName(points)
    found = ranges.in_range(values, both, "v", "lo", "hi", 50.0)
    assert found.count() == values.join(both, (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).count() == 400 * 7 + 100
    assert ranges.candidates(values, both, "v", "lo", "hi", 50.0).count() < 4 * found.count()


def test_steps_of_a_path_read_the_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a int, b int").mapInArrow(counted, "a int, b int")
    found = graph.depths(edges, spark.createDataFrame([(1,)], "root int"))
    assert sorted((x["node"], x["depth"]) for x in found.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert made.value == 4
