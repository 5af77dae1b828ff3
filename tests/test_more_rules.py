"""Rules of the later operators, worked out by hand or by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import diff, extract, fulltext, graph, lines, lists, outline, ranges, spans
from folio.plans.filters import Filters
from folio.sources import readers
from folio.sources.tables import shared
from folio.streaming import latest


def lcs(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 20])
def test_pairs_are_a_longest_common_subsequence(bits, monkeypatch):
    monkeypatch.setattr(diff, "TABLE_BITS", bits)
    for seed in range(800):
        r = random.Random(seed)
        x, y = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
        pairs = diff._pairs(x, y, 0, 0)
        assert len(pairs) == lcs(x, y) and all(x[a] == y[b] for a, b in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_runs_join_changes_over_white_space():
    assert [(r["kind"], r["text"]) for r in diff.runs_of("the quick brown fox", "the slow red fox jumps")] == [("same", "the "), ("removed", "quick brown"), ("added", "slow red"), ("same", " fox"), ("added", " jumps")]
    assert diff.runs_of(None, "") == [] and [r["kind"] for r in diff.runs_of("a", None)] == ["removed"]
    assert [(r["kind"], r["text"]) for r in diff.runs_of("a b", "a b c")] == [("same", "a b"), ("added", " c")]


def test_longest_increasing():
    for seed in range(300):
        r = random.Random(seed)
        v = r.sample(range(20), r.randrange(9))
        got = diff.longest_increasing(v)
        assert all(v[a] < v[b] and a < b for a, b in zip(got, got[1:]))
        best = max((bin(m).count("1") for m in range(1 << len(v)) if (lambda s: s == sorted(s))([v[i] for i in range(len(v)) if m >> i & 1])), default=0)
        assert len(got) == best


def test_one_moved_section_is_one(spark):
    old = spark.createDataFrame([(1, a, i, a, f"text {a}") for i, a in enumerate("wxyz")], "doc int, anchor string, pos int, title string, body string")
    new = spark.createDataFrame([(1, "x", 0, "x", "text x"), (1, "y2", 1, "y", "other"), (1, "z", 2, "z", "text z"), (1, "w", 3, "w", "text w"), (1, "n", 4, "n", "")], old.schema)
    got = {(r["old_anchor"], r["anchor"]): (r["change"], r["moved"]) for r in diff.section_changes(old, new).collect()}
    assert got == {("x", "x"): ("same", False), ("y", "y2"): ("changed", False), ("z", "z"): ("same", False), ("w", "w"): ("same", True), (None, "n"): ("added", False)}
    aligned = spark.createDataFrame([(1, "a", "b", 0.9), (1, "a", "c", 0.5)], "doc int, a string, b string, rank double")
    one, two = (spark.createDataFrame([(1, x, i, x, "") for i, x in enumerate(s)], old.schema) for s in ("a", "bc"))
    assert {(r["a"], r["b"]) for r in diff.paired(one, two, aligned).collect()} == {("a", "b")}


def test_sections_without_titles_are_read_once(spark, monkeypatch):
    old = spark.createDataFrame([(1, a, i, a) for i, a in enumerate("wxyz")] + [(2, "w", 0, None), (3, "q", 0, "q"), (None, "x", 0, "x")], "doc int, anchor string, pos int, body string")
    new = spark.createDataFrame([(1, "x", 0, "x"), (1, "y", 1, "other"), (1, "w", 3, "w"), (1, "n", 4, ""), (2, "w", 5, None), (4, "q", 0, "q"), (None, "x", 0, "x")], old.schema)
    want = [
        (1, "w", "w", "same", True), (1, "x", "x", "same", False), (1, "y", "y", "changed", False), (1, "z", None, "removed", False), (1, None, "n", "added", False), (2, "w", "w", "same", False),
        (3, "q", None, "removed", False), (4, None, "q", "added", False), (None, "x", None, "removed", False), (None, None, "x", "added", False),
    ]
    titled = diff.section_changes(*(df.withColumn("title", F.lit("")) for df in (old, new)))
    monkeypatch.setattr(diff, "cut", lambda df: pytest.fail("a table was written"))
    got = diff.section_changes(old, new)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) == sorted(map(repr, map(tuple, titled.collect())))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1


def brute_path(edges, root, most, assumed):
    depth, queue, listed, is_cut = {root: 0}, [root], set(), False
    for node in queue:
        for b in edges.get(node, []):
            if b in depth:
                continue
            if b in assumed:
                listed.add(b)
            elif depth[node] < most:
                depth[b] = depth[node] + 1
                queue.append(b)
            else:
                is_cut = True
    steps, entered = [], set()

    def enter(n):
        if n not in entered:
            entered.add(n)
            for b in edges.get(n, []):
                if b in depth:
                    enter(b)
            steps.append(n)

    enter(root)
    return steps, listed, is_cut


def test_reading_path(spark):
    for seed in range(4):
        r = random.Random(seed)
        pairs = [(r.randrange(18), r.randrange(18), k) for k in range(34)]
        pairs = [p for p in pairs if p[0] != p[1]]
        edges: dict[int, list[int]] = {}
        for a, b, _ in pairs:
            edges.setdefault(a, [])
            if b not in edges[a]:
                edges[a].append(b)
        assumed = {3, 7}
        df = spark.createDataFrame(pairs, "a int, b int, pos int")
        path = graph.reading_path(df, spark.createDataFrame([(0,), (1,), (3,)], "root int"), 2, spark.createDataFrame([(x,) for x in assumed], "node int")).orderBy("ord").collect()
        for root in (0, 1, 3):
            steps, listed, is_cut = brute_path(edges, root, 2, assumed)
            mine = [x for x in path if x["root"] == root]
            assert [x["node"] for x in mine if x["kind"] == "step"] == steps
            assert {x["node"] for x in mine if x["kind"] == "assumed"} == listed and any(x["kind"] == "cut" for x in mine) == is_cut


def test_paths_over_many_pieces(spark, monkeypatch):
    """Pieces of few nodes that a task reads again and again, names instead of numbers, a node with two rows of facts: the same paths."""
    monkeypatch.setattr(graph, "PIECE_NODES", 5)
    monkeypatch.setattr(graph, "MOST_PIECES", 40)
    monkeypatch.setattr(graph, "ROOTS_A_TASK", 3)
    r = random.Random(8)
    pairs = [(f"d{r.randrange(60)}", f"d{r.randrange(60)}", k) for k in range(150)]
    pairs = [p for p in pairs if p[0] != p[1]]
    edges: dict[str, list[str]] = {}
    for a, b, _ in pairs:
        edges.setdefault(a, [])
        if b not in edges[a]:
            edges[a].append(b)
    df = spark.createDataFrame(pairs, "a string, b string, pos int")
    roots, assumed = [f"d{i}" for i in range(0, 60, 4)] + ["alone"], {"d3", "d8", "d31"}
    asked, stop = spark.createDataFrame([(x,) for x in [*roots, roots[0]]], "root string"), spark.createDataFrame([(x,) for x in assumed], "node string")
    known = spark.createDataFrame([("d1", "one"), ("d1", "uno"), ("d2", "two")], "node string, title string")
    path = graph.reading_path(df, asked, 3, stop, known)
    assert "CoGroup" not in path._jdf.queryExecution().optimizedPlan().toString()  # edges aren't dealt to every root
    rows = sorted(path.collect(), key=lambda x: x["ord"])
    for root in roots:
        steps, listed, is_cut = brute_path(edges, root, 3, assumed)
        mine = [x for x in rows if x["root"] == root]
        assert [x["node"] for x in mine if x["kind"] == "step"] == [y for x in steps for y in [x] * (1 + (x == "d1"))]
        assert {x["node"] for x in mine if x["kind"] == "assumed"} == listed and any(x["kind"] == "cut" for x in mine) == is_cut
        assert sorted({x["ord"] for x in mine}) == list(range(len(steps) + len(listed) + is_cut))
    assert {(x["node"], x["title"]) for x in rows if x["title"]} == {("d1", "one"), ("d1", "uno"), ("d2", "two")}
    reach = {(x["root"], x["node"]): x["depth"] for x in graph.depths(df, asked, 3, stop).collect()}
    want = {}
    for root in roots:
        front, depth = [root], 0
        want[root, root] = 0
        while front and depth < 3:
            depth += 1
            new = {b for a in front if depth == 1 or a not in assumed for b in edges.get(a, ())} - {n for x, n in want if x == root}
            want |= {(root, b): depth for b in new}
            front = list(new)
    assert reach == want


def test_components_of_any_graph(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {n: find(n) for n in root}


def test_fold_and_decoding(spark):
    rows = [("Čapek Łódź Erdős É é ß",)]
    assert spark.createDataFrame(rows, "x string").select(T.fold(F.col("x"))).first()[0] == "capek łodz erdos e e ß"
    got = spark.createDataFrame([(b"\x93a\x94 \x80 \xe9",), ("é".encode(),)], "c binary").select(readers.decoded(F.col("c"))).collect()
    assert [r[0] for r in got] == ["“a” € é", "é"]
    assert spark.createDataFrame([("a\tb\t\tc",)], "x string").select(T.expanded(F.col("x"))).first()[0] == "a\tb\t\tc".expandtabs(8)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(3)
    docs = [(i, "\n\n".join(" ".join(r.choice(["the", "of", "a", "Café", "x-y", "of"]) for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(1, 4)))) for i in range(40)]
    sections = fulltext.sections_of(spark.createDataFrame(docs, "doc_id int, text string"))
    index = fulltext.Index.write(sections, f"{tmp_path}/index")
    held = {(x["doc"], x["ord"]): [w for w in x["body"].lower().replace("é", "e").replace("-", " ").split()] for x in sections.collect()}
    assert {(x["doc"], x["ord"]): (x["tf0"], x["tf1"]) for x in index.matching(["of", "cafe"]).collect()} == {k: (t.count("of"), t.count("cafe")) for k, t in held.items() if "of" in t and "cafe" in t}
    for words in (["of", "the"], ["of", "of"], ["x", "y", "a"]):
        want = {k: n for k, t in held.items() if (n := sum(t[i : i + len(words)] == words for i in range(len(t))))}
        assert {(x["doc"], x["ord"]): x["n"] for x in index.phrase(words).collect()} == want
    plan = index.bm25(["of"])._jdf.queryExecution().toString()
    assert "body" not in plan and "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan
    assert index.matching(["nothing"]).count() == 0 and index.bm25(["nothing"], limit=3).count() == 0
    changed = index.add(fulltext.sections_of(spark.createDataFrame([(0, "zebra of")], "doc_id int, text string")))
    assert [(x["doc"], x["tf0"]) for x in changed.matching(["zebra"]).collect()] == [(0, 1)]
    assert {x["doc"] for x in changed.matching(["of"]).collect()} == {k[0] for k, t in held.items() if "of" in t and k[0]} | {0}
    assert changed.bm25(["of"], limit=3).count() == 3


def test_wide_and_narrow_ranges(spark):
    r = random.Random(5)
    spans = [(i, lo, lo + r.choice([0, 1, 7, 10**6])) for i in range(40) for lo in [r.randrange(1000)]]
    values = [(v,) for v in range(0, 1100, 7)]
    got = ranges.in_range(spark.createDataFrame(values, "v long"), spark.createDataFrame(spans, "i int, lo long, hi long"), "v", "lo", "hi", 4.0)
    assert sorted((x["v"], x["i"]) for x in got.collect()) == sorted((v, i) for (v,) in values for i, lo, hi in spans if lo <= v <= hi)
    terms = spark.createDataFrame([("0x10",), ("16",), ("zz",)], "term string")
    entries = spark.createDataFrame([("hex", 10, 20, True), ("dec", 10, 20, False)], "name string, lo long, hi long, is_hex boolean")
    assert {(x["term"], x["name"]) for x in ranges.registry_lookup(terms, entries).collect()} == {("0x10", "hex"), ("16", "dec")}


def test_links_leftmost_and_longest(spark):
    df = spark.createDataFrame([(1, "As Section 4.2 of [Foo] says, RFC 12 and Section 3; see https://x.org/a."), (2, None), (3, "none")], "id int, text string")
    got = spans.link_spans(df, "id", "text").orderBy("start").collect()
    assert [(x["rule"], x["text"]) for x in got] == [("section-of", "Section 4.2 of [Foo]"), ("number", "RFC 12"), ("section", "Section 3"), ("url", "https://x.org/a")]
    assert all(df.first()["text"][x["start"] : x["end"]] == x["text"] for x in got)


def test_unknown_values_empty_the_result(spark):
    df = spark.createDataFrame([("HISTORIC", "ietf", "tls")], "status string, stream string, `group` string")
    assert Filters(status=("historic",), group=("TLS",)).narrowed(df).count() == 1
    for f in (Filters(status=("nope",)), Filters(stream=("nope",)), Filters(group=("tls", "nope"))):
        assert f.unknown(df) == ("nope",) and f.narrowed(df).count() == 0


def test_series_at_its_best_hit(spark):
    hits = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id int, rank int")
    series = spark.createDataFrame([("A", 12), ("A", 11), ("B", 99)], "series string, member int")
    got = [(x["rank"], x["id"], x["series"]) for x in lists.at_best_hit(hits, series, hits.where("id != 11")).orderBy("rank").collect()]
    assert got == [(1, 10, None), (2, None, "A"), (3, 12, None)]


def test_section_reader(spark, tmp_path):
    path = tmp_path / "doc.xml"
    path.write_text('<rfc number="7"><middle><section anchor="a"><name>One</name><t>first  text</t><section anchor="b"><name>Two</name></section></section><section anchor="c" title="Three"><t>x</t><t>y</t></section></middle></rfc>')
    rows = readers.document_sections(spark, str(path)).orderBy("pos").collect()
    assert [(r["number"], r["anchor"], r["parent"], r["level"], r["title"], list(r["blocks"])) for r in rows] == [(7, "a", None, 1, "One", ["first text"]), (7, "b", "a", 2, "Two", []), (7, "c", None, 1, "Three", ["x", "y"])]
    files = spark.createDataFrame([("a",), ("b",)], "name string")
    assert readers.selected(files, files.limit(1)).count() == 1
    with pytest.raises(ValueError):
        readers.selected(files, spark.createDataFrame([("z",)], "name string"))


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_streams(spark, tmp_path):
    """Four files, four batches: sessions join over batches, late windows go, histories and tables are kept up."""
    import datetime

    at = lambda h, m=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=m)
    batches = [
        [(1, at(0), 1, "view", 1.0, ""), (2, at(0, 30), 1, "view", 1.0, ""), (3, at(1), 2, "view", 1.0, "")],
        [(4, at(0, 50), 1, "error", 1.0, ""), (5, at(30), 2, "view", 1.0, "")],
        [(7, at(31), 9, "view", 1.0, "")],
        [(6, at(2), 1, "view", 5.0, ""), (3, at(1), 2, "changed", 2.0, "")],  # far behind by now: lateness is that of the batch before the last
    ]
    folder = tmp_path / "events"
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.parquet(f"{folder}/part{i}")
    import os
    import shutil
    import time

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(4):
        name = next(f for f in os.listdir(f"{folder}/part{i}") if f.endswith(".parquet"))
        shutil.copy(f"{folder}/part{i}/{name}", f"{flat}/{i}.parquet")
        os.utime(f"{flat}/{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    stream = lambda: latest.read_events(spark, str(flat))
    found = latest.run_to_table(latest.sessions(stream(), "1 hour", "100 hours", "user_id"), "s").collect()
    assert {(r["user_id"], r["n"]) for r in found} == {(1, 3), (1, 1), (2, 2), (2, 1), (9, 1)}
    # in append mode, a window that ended before the watermark takes nothing more
    kept = latest.run_to_table(latest.windowed(stream(), "1 hour", "1 hour", ["event_type"]), "w", mode="append").collect()
    assert {(r["start"].hour, r["event_type"], r["n"]) for r in kept if r["start"].day == 1} == {(0, "view", 2), (0, "error", 1), (1, "view", 1)}
    last = latest.run_to_table(latest.history(stream()), "h", mode="update").collect()
    assert {(r["user_id"], r["depth"], r["current"]) for r in last} >= {(1, 2, 2), (1, 1, 1), (1, 2, 6)}
    rows = latest.run_upserts(stream().select("event_id", "user_id", "event_type", "value"), "event_id").collect()
    assert {(r["event_id"], r["event_type"]) for r in rows} == {(1, "view"), (2, "view"), (3, "changed"), (4, "error"), (5, "view"), (6, "view"), (7, "view")}
    apply = latest.upserts(f"{shared(spark)}/again-{os.getpid()}", "k")
    for n, df in ((0, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")), (1, spark.createDataFrame([(2, "c")], "k int, v string")), (1, spark.createDataFrame([(2, "c")], "k int, v string"))):
        apply(df, n)  # the last batch comes twice, as after a failure
    assert {tuple(r) for r in latest.current(spark, f"{shared(spark)}/again-{os.getpid()}").collect()} == {(1, "a"), (2, "c")}


def test_relocated_quotes(spark):
    docs = spark.createDataFrame([(1, "a.b a.b c"), (2, "x")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, 1, "a.b", 0), (2, 1, "a.b", 1), (3, 1, "c", 0), (4, 1, "zz", 0), (5, 9, "a", 0), (6, 1, "", 99)], "quote_id int, doc_id int, quote string, at int")
    assert {r["quote_id"]: r["state"] for r in extract.relocated(quotes, docs).collect()} == {1: "exact", 2: "ambiguous", 3: "moved", 4: "detached", 5: "detached", 6: "exact"}


def test_unique_anchors_against_a_walk(spark):
    """Renamed anchors that meet natural ones take the next free number; null stays null."""
    rng = random.Random(5)
    rows = [(d, p, rng.choice(["a", "a-2", "a-2-2", "a-3", "b", "b", "c-9", None])) for d in range(40) for p in range(rng.randrange(1, 14))]
    want = []
    for d in range(40):
        taken = set()
        for _, p, a in (r for r in rows if r[0] == d):
            name, n = a, 2
            while a is not None and name in taken:
                name, n = f"{a}-{n}", n + 1
            taken.add(name)
            want.append((d, p, name))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, pos int, anchor string")
    assert sorted(map(tuple, lines.unique_anchors(df).collect()), key=lambda r: r[:2]) == want
    assert lines.unique_anchors(df.where("false")).count() == 0
