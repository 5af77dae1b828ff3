"""The full-text index: ranked search by blocks, phrases and sections, segments, merges."""

from __future__ import annotations

import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import fulltext
from folio.sources.tables import kept_table

WORDS = ["the", "of", "a", "cafe", "route", "packet", "node", "zone"]


def drawn(seed, n):
    """doc -> [(heading, body)] of random words, some common and some rare, of very unlike lengths."""
    r = random.Random(seed)
    text = lambda most: " ".join(r.choices(WORDS, [40, 20, 20, 5, 4, 3, 2, 1], k=r.randrange(1, most)))
    return {i: [(text(4), text(r.choice([4, 12, 120]))) for _ in range(r.randrange(1, 4))] for i in range(n)}


def frame(spark, docs):
    rows = [(d, o, h, b, f"{['intro', 'scope'][o % 2]}-{o}", f"{o + 1}.{d % 3}") for d, parts in docs.items() for o, (h, b) in enumerate(parts)]
    return spark.createDataFrame(rows, "doc int, ord int, heading string, body string, anchor string, number string")


def scanned(docs, terms, limit, allowed=lambda d, o, h: True):
    """The same search over the plain texts."""
    sections = {(d, o): (h.split(), b.split()) for d, parts in docs.items() for o, (h, b) in enumerate(parts)}
    n, mean = len(sections), sum(len(h) + len(b) for h, b in sections.values()) / len(sections)
    count = lambda s, t: sum(part[i : i + len(t)] == t for part in s for i in range(len(part)))
    score = dict.fromkeys(sections, 0.0)
    for t in terms:
        df = sum(count(s, t) > 0 for s in sections.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for key in list(score):
            tf = count(sections[key], t)
            if not tf:
                del score[key]
                continue
            length = sum(map(len, sections[key]))
            score[key] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    rows = [(k, s) for k, s in score.items() if allowed(*k, sections[k][0])]
    return sorted(rows, key=lambda x: (-float(f"{x[1]:.12g}"), x[0]))[:limit]


def found(df):
    return [((r["doc"], r["ord"]), r["score"]) for r in sorted(df.collect(), key=lambda r: r["rank"])]


def same(got, want):
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = drawn(1, 300)
    held, fulltext.BLOCK_SECTIONS = fulltext.BLOCK_SECTIONS, 8  # many blocks
    try:
        yield docs, fulltext.Index.write(frame(spark, docs), str(tmp_path_factory.mktemp("fts") / "index"), ("heading", "body"))
    finally:
        fulltext.BLOCK_SECTIONS = held


@pytest.mark.parametrize("terms", [[["route"]], [["zone"], ["node"]], [["the"], ["of"], ["cafe"]], [["of", "the"]], [["the", "the"], ["packet"]], [["of", "a"], ["the", "of"]], [["nothing"], ["the"]]])
def test_best_of_blocks_is_best_of_all(built, terms):
    docs, index = built
    for limit in (3, 10_000):
        same(found(index.search(terms, limit=limit)), scanned(docs, terms, limit))


def test_blocks_are_skipped(built):
    docs, index = built
    same(found(index.search([["packet"]], limit=3)), scanned(docs, [["packet"]], 3))
    read, in_all = index.blocks_read
    assert 0 < read < in_all / 2


def test_search_in_sections_and_lists(spark, built):
    docs, index = built
    same(found(index.search([["of"], ["route"]], section="intro", limit=9)), scanned(docs, [["of"], ["route"]], 9, lambda d, o, h: o % 2 == 0))
    same(found(index.search([["of"]], section="2", limit=9)), scanned(docs, [["of"]], 9, lambda d, o, h: o == 1))
    has = lambda h, t: any(h[i : i + len(t)] == t for i in range(len(h)))
    same(found(index.search([["a"]], section="Of The", limit=9)), scanned(docs, [["a"]], 9, lambda d, o, h: has(h, ["of", "the"])))
    within = spark.createDataFrame([(i,) for i in range(0, 300, 7)] + [(7,), (None,)], "doc int")
    same(found(index.search([["the"], ["node"]], within=within, limit=6)), scanned(docs, [["the"], ["node"]], 6, lambda d, o, h: d % 7 == 0))
    listed = sorted(((d, o) for d, parts in docs.items() for o in range(len(parts)) if o == 2), key=lambda k: -k[0])
    assert [(r["doc"], r["ord"]) for r in sorted(index.search([], section="3", limit=12).collect(), key=lambda r: r["rank"])] == listed[:12]
    with pytest.raises(ValueError):
        index.search([])


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_segments(spark, tmp_path):
    docs = drawn(2, 120)
    index = fulltext.Index.write(frame(spark, docs), f"{tmp_path}/i", ("heading", "body"))
    whole = size_of(f"{tmp_path}/i")
    index = index.add(frame(spark, {5: [("zone", "the route of a node")]}))
    assert size_of(f"{tmp_path}/i") - whole < 60_000
    docs[5] = [("zone", "the route of a node")]
    more = drawn(3, 20)
    index = index.add(frame(spark, {k + 110: v for k, v in more.items()}), spark.createDataFrame([(7,), (8,), (999,), (None,)], "doc int"))
    docs |= {k + 110: v for k, v in more.items()}
    del docs[7], docs[8]
    index = index.add(frame(spark, {7: [("of", "the zone again")]}).unionByName(frame(spark, {0: [("x", "y")]}).select(F.lit(None).cast("int").alias("doc"), "ord", "heading", "body", "anchor", "number")))
    docs[7] = [("of", "the zone again")]
    asked = [[["zone"]], [["the"], ["of"]], [["of", "the"], ["a"]]]

    def holds(index):
        for terms in asked:
            same(found(index.search(terms, limit=15)), scanned(docs, terms, 15))
        texts = [w for parts in docs.values() for h, b in parts for w in [*h.split(), *b.split()]]
        assert {r["term"]: r["tf"] for r in index.statistics().collect()} == {w: texts.count(w) for w in set(texts)}
        assert {r["term"]: r["docs"] for r in index.statistics().collect()} == {w: sum(any(w in (h + " " + b).split() for h, b in parts) for parts in docs.values()) for w in set(texts)}
        assert (index.n, index.tokens) == (sum(map(len, docs.values())), len(texts))
        assert {(r["doc"], r["ord"]) for r in index.sections().collect()} == {(d, o) for d, parts in docs.items() for o in range(len(parts))}
        assert [r["reason"] for r in index.refused().collect()] == ["no document"]
        assert tuple(index.coverage(spark.createDataFrame([(7,), (8,), (9,)], "doc int")).first()) == (3, 2)

    assert len(index.segments) == 4
    holds(index)
    part = index.merge(1)
    assert len(part.segments) == 2
    holds(part)
    one = part.merge()
    assert len(one.segments) == 1
    holds(one)
    assert os.listdir(f"{tmp_path}/i/segments") == [one.segments[0][0]]
    holds(fulltext.Index(spark, f"{tmp_path}/i"))


def test_a_batch_that_broke_off_is_none(spark, tmp_path, monkeypatch):
    docs = drawn(4, 30)
    index = fulltext.Index.write(frame(spark, docs), f"{tmp_path}/i", ("heading", "body"))

    def broken(*_):
        raise OSError("no more")

    with monkeypatch.context() as m:
        m.setattr(fulltext, "_commit", broken)
        with pytest.raises(OSError):
            index.add(frame(spark, {1: [("zone", "zone")]}))
    again = fulltext.Index(spark, f"{tmp_path}/i")
    same(found(again.search([["zone"]], limit=9)), scanned(docs, [["zone"]], 9))
    docs[1] = [("zone", "zone")]
    same(found(again.add(frame(spark, {1: docs[1]})).search([["zone"]], limit=9)), scanned(docs, [["zone"]], 9))


def test_many_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "MOST_DELTAS", 2)
    docs = drawn(6, 10)
    index = fulltext.Index.write(frame(spark, docs), f"{tmp_path}/i", ("heading", "body"))
    for i in range(4):
        docs[i] = [("node", f"zone {i}")]
        index = index.add(frame(spark, {i: docs[i]}))
        assert len(index.segments) <= 3
        same(found(index.search([["zone"]], limit=9)), scanned(docs, [["zone"]], 9))


def test_kept_table_follows_its_files(spark, tmp_path):
    source = f"{tmp_path}/t.parquet"
    made = []

    def kept():
        return kept_table(spark, "a test", made.append, source)

    spark.range(3).write.parquet(source)
    assert kept() == kept() and len(made) == 1
    spark.range(4).write.mode("overwrite").parquet(source)
    kept()
    assert len(made) == 2


def test_entries_hold_few_tokens_at_once():
    """However many sections a batch has, rows leave by pieces, and the pieces are what the whole is."""
    r = random.Random(4)
    rows = [[r.choice("abcdef") * r.randrange(1, 4) for _ in range(r.choice([0, 3, 400, 3000]))] for _ in range(200)]
    rows[7], rows[30] = None, ["x"] * (2 * fulltext.PIECE_TOKENS)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(rows, pa.list_(pa.string()))], names=["doc", "__body"])
    out = list(fulltext._entries(("body",))([batch]))
    assert [x for b in out for x in b.column("doc").to_pylist()] == list(range(200))
    assert [x for b in out for x in b.column("len").to_pylist()] == [len(x or ()) for x in rows]
    assert all(b.num_rows == 1 or sum(b.column("len").to_pylist()) <= fulltext.PIECE_TOKENS for b in out)
    for entries, words in zip((x for b in out for x in b.column("entries").to_pylist()), rows):
        assert {e["term"]: e["positions"] for e in entries} == {w: [i for i, x in enumerate(words) if x == w] for w in dict.fromkeys(words or ())}
    assert list(fulltext._entries(("body",))([batch.slice(0, 0)])) == []


def test_phrase_has_a_row_a_section_not_a_position(spark, tmp_path):
    """Words at very many places of a section: what is shuffled is the section's rows."""
    docs = spark.createDataFrame([(1, 0, "of the " * 500 + "of of the"), (2, 0, "the of"), (3, 0, "of the of the")], "doc int, ord int, body string")
    index = fulltext.Index.write(docs, f"file://{tmp_path}/i")
    found = index.phrase(["of", "the"])
    assert {(x["doc"], x["n"]) for x in found.collect()} == {(1, 501), (3, 2)}
    assert {(x["doc"], x["n"]) for x in index.phrase(["of", "the", "of"]).collect()} == {(1, 500), (3, 1)}
    assert "explode(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_count_their_terms(monkeypatch):
    """Frequencies come with the pieces, of sections that aren't refused; a document's sections of one piece count once."""
    monkeypatch.setattr(fulltext, "PIECE_TOKENS", 6)
    rows = [(1, None, ["a", "b", "a"]), (1, None, ["a"]), (None, "no document", ["a"]), (1, None, ["a", "c", "c", "c"]), (2, None, None)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["doc", "__refused", "__body"])
    first, second = fulltext._entries(("body",))([batch])
    told = lambda b: {(e["term"], e["df"], e["docs"], e["tf"]) for row in b.column("counts").to_pylist() for e in row}
    assert told(first) == {("a", 2, 1, 3), ("b", 1, 1, 1)} and told(second) == {("a", 1, 1, 1), ("c", 1, 1, 3)}
    assert set(first.column("unit").to_pylist()).isdisjoint(second.column("unit").to_pylist())


def test_a_document_in_many_tasks_counts_once(spark, tmp_path, monkeypatch):
    """Sections of a document that are read by several tasks; postings of a bucket go to as many files as they need."""
    monkeypatch.setattr(fulltext, "FILE_POSTINGS", 20)
    monkeypatch.setattr(fulltext, "BLOCK_SECTIONS", 8)
    rows = spark.range(0, 200, 1, 8).selectExpr("cast(id % 5 as int) as doc", "cast(id as int) as ord", "concat('zone node', id % 3) as body")
    index = fulltext.Index.write(rows, f"file://{tmp_path}/i")
    assert {(r["term"], r["tf"], r["docs"]) for r in index.statistics().collect()} == {("zone", 200, 5), *((f"node{k}", len(range(k, 200, 3)), 5) for k in range(3))}
    assert sum(f.endswith(".parquet") for _, _, names in os.walk(f"{tmp_path}/i/segments/0-0/postings") for f in names) > 8
