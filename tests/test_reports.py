"""Reports that merge, defined terms and lookups, against plain versions and by hand."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from folio.operators import lines, nesting, reports, search, terms

METRICS = "doc_id long, gap long, part long, n_lines long, chars long, letters long, capitals long, symbols long, bars long, stops int"


def metrics(rng, docs):
    out = []
    for d in docs:
        for gap in range(rng.randrange(1, 6)):
            chars = rng.choice([10, 38, 80, 200])
            letters = rng.randrange(chars)
            out.append((d, gap, rng.randrange(2), rng.randrange(1, 4), chars, letters, rng.randrange(letters + 1), rng.choice([0, 0, 3, 30]), rng.choice([0, 0, 2, 6]), rng.randrange(2)))
    return list({r[:3]: r for r in out}.values())


def plain_report(rows, sample):
    counts, misses = Counter(), []
    for d, gap, part, n, chars, letters, capitals, symbols, bars, stops in sorted(rows):
        refused = [g for g, no in zip(lines.GUARDS, (chars < 40, symbols * 20 > chars, bars >= 2 * n, capitals * 2 > letters, stops == 0)) if no]
        counts["blocks", ""] += 1
        counts["prose", ""] += not refused
        counts.update(("guard", g) for g in refused)
        tells = {"bars": bars >= 2, "symbols": symbols > 0, "capitals": capitals * 4 > letters}
        odd = [k for k in tells if all(tells[k] != tells[o] for o in tells if o != k)]
        if "no_sentence" in refused and odd:
            counts["dissent", odd[0]] += 1
        if len(refused) == 1:
            counts["near_misses", ""] += 1
            counts["sole", refused[0]] += 1
            misses.append(("sample", refused[0], 1, d, gap, part))
    counts["documents", ""] = len({r[0] for r in rows})
    return {(m, k, n, None, None, None) for (m, k), n in counts.items() if n} | set(misses[:sample])


def report_of(spark, rows, part, sample):
    return reports.partials(lines.refusals(spark.createDataFrame(rows, METRICS)), part, sample=sample)


def test_reports_merge_to_one_pass(spark):
    for seed, parts, sample in ((1, 1, 1000), (2, 5, 1000), (3, 40, 7)):
        rows = metrics(random.Random(seed), range(60))
        found = reports.merged(report_of(spark, rows, F.pmod(F.xxhash64("doc_id"), F.lit(parts)), sample), sample)
        got = found.collect()
        assert set(map(tuple, got)) == plain_report(rows, sample) and len(got) == len(set(got))
        # reports of reports merge as well
        halves = [reports.merged(report_of(spark, [r for r in rows if r[0] % 2 == k], F.lit(0), sample), sample) for k in (0, 1)]
        assert set(map(tuple, reports.merged(halves[0].unionByName(halves[1]), sample).collect())) == plain_report(rows, sample)
    assert reports.merged(report_of(spark, [], F.lit(0), 5), 5).count() == 0


def test_one_part_is_written_anew(spark, tmp_path):
    """Changed documents rewrite their part's report; the merged one is that of the new whole."""
    path, part = f"file://{tmp_path}/reports", F.pmod("doc_id", F.lit(4))
    rows = metrics(random.Random(5), range(40))
    reports.store(report_of(spark, rows, part, 9), path)
    before = spark.createDataFrame(reports.merged(reports.stored(spark, path), 9).collect(), reports.REPORT)
    kept = {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("reports/part=[023]/*.parquet")}
    changed = [r for r in rows if r[0] != 5] + metrics(random.Random(6), [101, 105])
    reports.store(report_of(spark, [r for r in changed if r[0] % 4 == 1], part, 9), path)
    after = reports.merged(reports.stored(spark, path), 9)
    assert set(map(tuple, after.collect())) == plain_report(changed, 9)
    assert kept == {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("reports/part=[023]/*.parquet")}
    moved = {(r["measure"], r["key"]): (r["before"], r["after"]) for r in reports.growth(before, after).collect()}
    assert moved["documents", ""] == (40, 41)


def test_titles(spark):
    names = {
        "Terminology": (True, True), "New Terms": (True, True), "Definition of Terms": (True, True), "Glossary": (True, True), "Definitions": (True, False), "Definitions of Objects": (True, False),
        "Symbols, Abbreviations, and Definitions": (True, True), "Acronyms and Definitions": (True, True), "Conventions and Definitions Used": (True, True), "Conventions and Acronyms": (True, True),
        "Conventions and Notation": (False, False), "Conventions": (False, False), "Field Definitions": (False, False), "Terminal": (False, False), "": (False, False), None: (False, False),
    }
    df = spark.createDataFrame([(t,) for t in names], "title string")
    got = df.select("title", terms.names_terms(F.col("title")), terms.passes_terms_on(F.col("title"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == names


def test_below(spark):
    rng = random.Random(3)
    rows, want = [], []
    for doc in (None, 1, 2, 3):
        for pos in range(60):
            rows.append((doc, pos, rng.randrange(1, 7), rng.choice([True, False, False, None])))
    for doc in (None, 1, 2, 3):
        own = [r for r in rows if r[0] == doc]
        for at, (_, pos, depth, _o) in enumerate(own):
            under, level = False, depth
            for _, _, d, opens in reversed(own[:at]):
                if d < level:
                    level, under = d, under or bool(opens)
            want.append((doc, pos, under))
    got = nesting.below(spark.createDataFrame(rows, "id long, pos int, depth int, opens boolean").repartition(5), "id", "pos", "depth", F.col("opens"))
    assert {(r["id"], r["pos"], r["below"]) for r in got.collect()} == set(want)


def test_defined_terms(spark):
    def section(title, body, anchor="s"):
        return f'<section anchor="{anchor}"><name>{title}</name>{body}</section>'

    one = '<dl><dt>"Red, Blue":</dt><dt>Green –</dt><dd>three colours</dd><dt>Void</dt><dd/></dl>'
    later = '<iref primary="true" item="Void"/><t>A void is it.<iref primary="true" item="Void"/><iref item="No"/></t><t>Gap<iref primary="true" item="cache, private"/></t>'
    docs = [
        (1, "<rfc>" + section("Terminology", one + section("Details", "<dl><dt>Deep</dt><dd><t/><t>down</t><t>more</t></dd><dt>Red</dt><dd>again</dd></dl>", "d")) + section("Other", later, "o") + "</rfc>"),
        (2, "<rfc>" + section("Definitions", section("Variables", one)) + section("Body", one) + "</rfc>"),
        (3, "<rfc/>"), (4, None),
    ]
    found = nesting.nodes(spark.createDataFrame(docs, "id long, xml string"), "id", "xml")
    got = {(r["id"], r["term"]): (r["anchor"], r["meaning"]) for r in terms.defined_terms(found, "id").collect()}
    assert got == {
        (1, "Red"): ("s", "three colours"), (1, "Blue"): ("s", "three colours"), (1, "Green"): ("s", "three colours"), (1, "Void"): ("o", "A void is it."),
        (1, "cache, private"): ("o", "Gap"), (1, "Deep"): ("d", "down"),
    }


def test_lookup(spark):
    catalogue = spark.createDataFrame([(7,), (12,), (9,), (14,)], "number long")
    series = spark.createDataFrame([("BCP", 14, [12, 8, 7]), ("STD", 3, [1]), ("STD", 4, [])], "series string, id int, members array<int>")
    queries = ["RFC 7", "rfc0012", "9", "BCP14", "std 3", "STD 4", "std 5", "RFC 8", "red widget", "", "7 widgets", None, "RFC 7", "99999999999999999999"]
    got = search.looked_up(spark.createDataFrame([(q,) for q in queries], "query string"), catalogue, series).collect()
    words = {(q, "words", 0, None) for q in ("std 5", "RFC 8", "red widget", "", "7 widgets", None, "99999999999999999999")}
    assert set(map(tuple, got)) == {("RFC 7", "document", 0, 7), ("rfc0012", "document", 0, 12), ("9", "document", 0, 9), ("BCP14", "series", 0, 12), ("BCP14", "series", 2, 7)} | words and len(got) == 12
