"""Leftmost-longest choices, dictionaries, links; batches that come again."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import spans
from folio.streaming import latest


def greedy(rows):
    """The plain rule over one text's (start, end)."""
    out, reach, kept = [], -1, None
    for a, b in sorted(rows, key=lambda r: (r[0], -r[1])):
        if a >= reach or (a, b) == kept:
            out.append((a, b))
            kept, reach = (a, b), b
    return out


def test_leftmost_longest(spark):
    r = random.Random(1)
    texts = {i: [(a, a + r.randrange(1, 6)) for a in (r.randrange(30) for _ in range(r.randrange(0, 25)))] for i in [*range(40), None]}
    df = spark.createDataFrame([(i, a, b, "x") for i, rows in texts.items() for a, b in rows], "id int, start int, end int, reach string").repartition(7)
    got = spans.leftmost_longest(df, "id").collect()
    for i, rows in texts.items():
        assert sorted((x["start"], x["end"]) for x in got if x["id"] == i) == greedy(rows)
    assert spans.leftmost_longest(df.where("false"), "id").count() == 0


def plain_glosses(text, terms):
    words = re.findall(r"[^\W_]+(?:-[^\W_]+)*", text.lower())
    at, out = 0, {}
    known = [(k, t.lower().split()) for k, t in terms]
    while at < len(words):
        best = max((len(t) for _, t in known if t and words[at : at + len(t)] == t), default=0)
        for k, t in known:
            if best and len(t) == best and words[at : at + best] == t:
                out.setdefault(k, (at, best))
        at += best or 1
    return {(k, *v) for k, v in out.items()}


def test_glosses_that_overlap(spark):
    chain = spark.createDataFrame([(1, "a b c d")], "id int, text string")
    terms = spark.createDataFrame([("ab", "a b"), ("bc", "b c"), ("cd", "c d")], "key string, term string")
    assert {x["key"] for x in spans.glossed(chain, terms, "id", "text").collect()} == {"ab", "cd"}
    r = random.Random(7)
    for _ in range(3):
        known = [(f"k{i}", " ".join(r.choice("abcd") for _ in range(r.choice([1, 2, 2, 3, 9])))) for i in range(9)] + [("none", " ,")]
        texts = [(i, " ".join(r.choice("abcde") for _ in range(r.randrange(0, 60)))) for i in range(40)] + [(99, None), (100, "a-b A B")]
        df = spark.createDataFrame(texts, "id int, text string")
        got = spans.glossed(df, spark.createDataFrame(known, "key string, term string"), "id", "text").collect()
        for i, text in texts:
            assert {(x["key"], x["pos"], x["n_words"]) for x in got if x["id"] == i} == plain_glosses(text or "", known)
    # what was marked is passed over whole
    skip = spark.createDataFrame([(1, "ab")], "id int, key string")
    assert {x["key"] for x in spans.glossed(chain, terms, "id", "text", skip).collect()} == {"cd"}
    assert spans.glossed(chain, terms.where("false"), "id", "text").count() == 0


def test_a_small_dictionary_goes_to_the_texts(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"the red fox and the fox {i}") for i in range(20)], "id int, text string")
    terms = spark.createDataFrame([("rf", "Red fox"), ("f", "fox")], "key string, term string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sent = spans.dictionary_hits(texts, terms, "id", "text")
    assert "BroadcastHashJoin" in plan(sent) and "SortMergeJoin" not in plan(sent)
    monkeypatch.setattr(spans, "SENT_TERMS", 1)
    dealt = spans.dictionary_hits(texts, terms, "id", "text")
    assert "BroadcastHashJoin" not in plan(dealt) and sorted(sent.collect()) == sorted(dealt.collect()) and sent.count() == 60


def test_links(spark):
    cases = {
        "RFCs 1, 2 and 3, or RFC 4": [("number", "1"), ("number", "2"), ("number", "3"), ("number", "RFC 4")],
        "Sections 3.2 and 4 of RFC-793": [("section-of", "3.2"), ("section-of", "4"), ("number", "RFC-793")],
        "Section 2 of RFC 2223bis": [],
        "RFC822.SIZE and RFC5322.From": [],
        "Section A.1 of [Foo Bar]; [RFC2582,FF96]": [("section-of", "Section A.1 of [Foo Bar]"), ("number", "RFC2582")],
        "[RFC 2119] (see http://a.b/c).": [("label", "[RFC 2119]"), ("url", "http://a.b/c")],
        "Section 1é Section 12": [("section", "Section 12")],
        "\U0001f600 RFC 7": [("number", "RFC 7")],
    }
    rows = list(enumerate(cases))
    got = spans.link_spans(spark.createDataFrame([*rows, (50, None), (51, "")], "id int, text string"), "id", "text").orderBy("id", "start").collect()
    for i, text in rows:
        own = [x for x in got if x["id"] == i]
        assert [(x["rule"], x["text"]) for x in own] == cases[text], text
        assert all(text[x["start"] : x["end"]] == x["text"] for x in own)
    target = {x["text"]: (x["document"], x["section"]) for x in got}
    assert target["3.2"] == ("793", "3.2") and target["Section A.1 of [Foo Bar]"] == ("Foo Bar", "A.1")
    many = " ".join(f"RFC {i}" for i in range(20_000))
    assert spans.link_spans(spark.createDataFrame([(1, many)], "id int, text string"), "id", "text").count() == 20_000


def test_a_batch_killed_before_its_mark(spark, tmp_path, monkeypatch):
    """Killed between the rows and the mark, or while its rows were written: no row twice, none lost."""
    apply, path = latest.batches(f"{tmp_path}/t"), f"{tmp_path}/t"
    frame = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    apply(frame((1, "a"), (2, "b")), 0)
    real, calls = spark.range, []

    def killed(*args):
        calls.append(args)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(type(spark), "range", killed)
        with pytest.raises(KeyboardInterrupt):
            apply(frame((3, "c")), 1)
    assert calls and real is not None
    assert sorted(tuple(r)[:2] for r in latest.kept(spark, path).collect()) == [(1, "a"), (2, "b")]  # no mark, no rows
    apply(frame((3, "c")), 1)
    apply(frame((3, "c")), 1)
    assert sorted(tuple(r) for r in latest.kept(spark, path).collect()) == [(1, "a", 0), (2, "b", 0), (3, "c", 1)]
    # another digest: built anew
    apply(frame((4, "d"), (3, "c")), 1)
    assert sorted(tuple(r)[:2] for r in latest.kept(spark, path).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert latest.differing(spark, path) == []
    frame((9, "z")).write.mode("overwrite").parquet(f"{path}/data/0")  # somebody else's hand
    assert latest.differing(spark, path) == [0]


def test_complete_batches_stand_for_all(spark, tmp_path):
    apply = latest.batches(f"{tmp_path}/t", complete=True)
    for n in range(3):
        apply(spark.range(n + 1), n)
        apply(spark.range(n + 1), n)
        assert latest.kept(spark, f"{tmp_path}/t").count() == n + 1


def test_update_mode_keeps_the_newest_of_a_key(spark, tmp_path):
    for i, value in enumerate((1, 5, 3)):
        spark.createDataFrame([(7, value)], "k int, v int").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    counts = stream.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [tuple(r) for r in latest.run_to_table(counts, "u", "update", "k").collect()] == [(7, 3)]
