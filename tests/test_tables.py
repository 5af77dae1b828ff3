"""Best-first pairs, registry words, table functions, and rules without caps."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from folio.functions import tables
from folio.functions import text as T
from folio.operators import diff, documents, extract, outline, ranges
from folio.plans.filters import Filters
from folio.sources import tables as written


def test_best_first_is_greedy(spark):
    r = random.Random(3)
    pairs = {(d, a, b): r.choice([0.1, 0.2, 0.2, 0.5]) if d % 2 else r.random() for d in range(12) for a in range(r.randrange(0, 9)) for b in range(r.randrange(0, 9))}
    pairs |= {(50, i // 2, (i + 1) // 2): float(i) for i in range(20)}  # a chain: a round takes one end
    want = set()
    for (d, a, b), _ in sorted(pairs.items(), key=lambda x: (x[0][0], -x[1], x[0][1], x[0][2])):
        if all((d, a) != w[:2] and (d, b) != (w[0], w[2]) for w in want):
            want.add((d, a, b))
    df = spark.createDataFrame([(*k, v) for k, v in pairs.items()] + [(None, 1, 1, 0.5), (1, 1, 1, None)], "doc int, a int, b int, rank double")
    assert {tuple(x) for x in diff.best_first(df).collect()} == want
    assert diff.best_first(df.where("false")).count() == 0


def test_registry_words(spark):
    entries = [("status", "404", "Not Found"), ("status", "0404", None), ("alerts", "40", "handshake_failure"), ("errors", "0x0100-0x01ff", "CRYPTO_ERROR"), ("errors", "0x0a", None), ("fields", "http", "Host"), ("errors", "5-0x9", "mixed"), ("errors", "9-5", "turned"), ("errors", "1-2-3", "three")]
    qualifiers = [("http", "status"), ("http", "fields"), ("http status", "status"), ("TLS", "alerts"), ("quic  error", "errors"), ("quic", "errors")]
    asked = {
        "HTTP 404": {"404"}, "http status  404": {"404"}, "404": {"404"}, "quic error 0x01aF": {"0x0100-0x01ff"}, "quic 10": set(), "quic 0x0a": {"0x0a"}, "0x000a": {"0x0a"}, "host": {"http"}, "http host": {"http"}, "http": {"http"},
        "tls Handshake_Failure": {"40"}, "tls not found": set(), " Not   found ": {"404"}, "http ": {"http"}, "": set(), "quic error": set(), "crypto_error": {"0x0100-0x01ff"}, "0404": {"404", "0404"}, "1": set(), "6": set(),
    }
    got = ranges.registry_matches(spark.createDataFrame([(q,) for q in asked] + [(None,)], "query string"), spark.createDataFrame(entries, "registry string, value string, name string"), spark.createDataFrame(qualifiers, "words string, registry string")).collect()
    number = {"0404": {"404", "0404"}, "404": {"404", "0404"}}
    for q, want in asked.items():
        want = want | (number["404"] if "404" in want and "404" in q else set())
        assert {x["value"] for x in got if x["query"] == q} == want, q


def test_table_functions(spark):
    tables.register(spark)
    got = spark.sql("SELECT kind, text FROM word_runs('a b c', 'a x c') ORDER BY pos").collect()
    assert [tuple(x) for x in got] == [(x["kind"], x["text"]) for x in diff.runs_of("a b c", "a x c")]
    spark.createDataFrame([(1, "Transport Layer Security (TLS) and more"), (2, None), (3, "none")], "id int, text string").createOrReplaceTempView("t_docs")
    assert [tuple(x) for x in spark.sql("SELECT d.id, e.short, e.long FROM t_docs d, LATERAL expansions(d.text) e").collect()] == [(1, "TLS", "Transport Layer Security")]
    r = random.Random(4)
    values = {k: [r.randrange(20) for _ in range(r.randrange(1, 25))] for k in range(8)}
    spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k long, i int, v int").createOrReplaceTempView("t_values")
    rows = spark.sql("SELECT * FROM longest_run(TABLE(SELECT k, v, i FROM t_values) PARTITION BY k ORDER BY i)").collect()
    for k, vs in values.items():
        assert sorted(x["nth"] for x in rows if x["key"] == k and x["kept"]) == diff.longest_increasing(vs)


def test_rows_of_a_table_argument_are_no_batches(spark):
    tables.register(spark)
    spark.createDataFrame([(k, v, i) for k in (1, 2, None) for i, v in enumerate((3, 1, 2, None))], "k long, v long, i int").createOrReplaceTempView("run_rows")
    found = spark.sql("SELECT * FROM longest_run(TABLE(SELECT k, v, i FROM run_rows) PARTITION BY k ORDER BY i)")
    assert "ArrowEvalPythonUDTF" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["key"], r["nth"]) for r in found.where("kept").collect()} == {(k, i) for k in (1, 2, None) for i in (1, 2)}


def test_rules_without_caps(spark):
    tabs = "".join(f"{'x' * (i % 11)}\t" for i in range(59)) + "end"
    got = spark.createDataFrame([(tabs,), (None,), ("",), ("no",), ("\t",)], "l string").select(T.expanded(F.col("l"))).collect()
    assert [x[0] for x in got] == [tabs.expandtabs(8), None, "", "no", " " * 8]
    far = "Very " + "l" * 900 + "ong Name Here (VLNH)"
    assert extract.expansions_of(far) == [{"short": "VLNH", "long": far[: far.index(" (")]}]
    df = spark.createDataFrame([("X-OWN", "mine")], "status string, stream string")
    assert Filters(status=("X-OWN",), stream=("MINE",)).unknown(df) == ()
    assert Filters(status=("F",), stream=("1-urgent",)).unknown(df) == ("F", "1-urgent")


def test_tables_of_more_rows_go_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(written, "ROWS_A_TASK", 10)
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    assert written.dealt(df, 100, "k").rdd.getNumPartitions() == 10 and written.dealt(df, 9, "k").rdd.getNumPartitions() == 4
    records = spark.createDataFrame([(d, d % 3, [1, 2, d], [2]) for d in range(6)] * 2 + [(9, 9, None, None)], "draft long, revision int, obsoletes array<long>, updates array<long>")
    view = documents.published(records, 100)
    assert "Aggregate" not in view._jdf.queryExecution().optimizedPlan().toString() and view.rdd.getNumPartitions() == 10
    rows = {(n, "obsoletes", d, d % 3) for d in range(6) for n in (1, 2, d)} | {(2, "updates", d, d % 3) for d in range(6)}
    want = {(*r, 1 + sum(x < r for x in rows if x[0] == r[0])) for r in rows}
    got = [tuple(r) for r in view.select("number", "relation", "draft", "revision", "ord").collect()]
    assert len(got) == len(want) and set(got) == want


def test_runs_without_a_table_of_them(spark):
    r = random.Random(5)
    docs = {d: [(None if r.random() < 0.3 else p, r.choice(["x", None])) for p in range(r.randrange(1, 9))] for d in [*range(60), None]}
    docs = {d: [(p, v if p is not None else "x") for p, v in rows] for d, rows in docs.items()}  # rows without a place are alike
    got = outline.runs(spark.createDataFrame([(d, p, v) for d, rows in docs.items() for p, v in rows], "doc int, pos int, value string"), "value")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for d, rows in docs.items():
        rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
        for nth, (_, run) in enumerate(itertools.groupby(enumerate(rows), key=lambda x: sum(a[1] != b[1] for a, b in zip(rows[: x[0]], rows[1 : x[0] + 1])))):
            run = [x for _, x in run]
            want.append((d, nth + 1, run[0][1], min((p for p, _ in run if p is not None), default=None), len(run)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
