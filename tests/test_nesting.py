"""Parents by a stack, markup of any depth, headings, pages."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET

import pytest

from folio.operators import nesting
from folio.queries import QUERIES


def test_parents(spark):
    r = random.Random(2)
    texts = {i: [r.randrange(1, 6) for _ in range(r.randrange(0, 30))] for i in [*range(30), None]}
    df = spark.createDataFrame([(i, p, d) for i, depths in texts.items() for p, d in enumerate(depths)], "id int, pos int, depth int").repartition(5)
    got = {(x["id"], x["pos"]): x["parent"] for x in nesting.parents(df, "id", "pos", "depth").collect()}
    for i, depths in texts.items():
        for p, d in enumerate(depths):
            assert got[i, p] == next((q for q in range(p - 1, -1, -1) if depths[q] < d), None)


def drawn(r, depth=0):
    """A random document: sections in sections, blocks with inlines."""
    out = f'<section anchor="s{r.random()}" numbered=\'a>b\'><name>N &amp; <em>x</em>{depth}</name>'
    for _ in range(r.randrange(0, 3)):
        out += r.choice(["<t>one <xref target='t1'/> two &lt;3</t>", "<!-- <t>no</t> --><t/>", "<ul><li>a<ul><li>b</li></ul>c</li></ul>", "<artwork><![CDATA[ <x> ]]></artwork>", "<table><tr><th>h</th><th/></tr><tr><td>1</td><td>2 <eref target='u'>v</eref></td></tr></table>"])
    for _ in range(0 if depth == 14 else r.choice([1, 2]) if depth < 2 else r.choice([0, 1, 1, 1, 1, 1])):
        out += drawn(r, depth + 1)
    return out + "</section>"


def test_markup_against_a_parser(spark):
    r = random.Random(6)
    docs = [(i, f'<?xml version="1.0"?><!DOCTYPE rfc><rfc><middle>{drawn(r)}{drawn(r)}</middle></rfc>') for i in range(12)]
    found = nesting.nodes(spark.createDataFrame([*docs, (90, None), (91, ""), (92, "<a></b>t<c>")], "id int, xml string"), "id", "xml").cache()
    sections = {i: {} for i, _ in docs}
    for x in nesting.sections(found, "id").collect():
        sections.setdefault(x["id"], {})[x["pos"]] = x
    blocks = nesting.blocks(found, "id").orderBy("id", "pos").collect()
    points = nesting.pointers(found, "id").orderBy("id", "pos").collect()
    cells = nesting.cells(found, "id").orderBy("id", "table", "row", "col").collect()
    deepest = 0
    for i, xml in docs:
        tree = ET.fromstring(xml.replace("<!DOCTYPE rfc>", ""))
        above = {c: p for p in tree.iter() for c in p}
        own = [s for s in tree.iter("section")]
        got = [sections[i][p] for p in sorted(sections[i])]
        by_pos = {x["pos"]: x for x in got}
        for s, x in zip(own, got, strict=True):
            up, depth = above[s], 1
            while up.tag != "rfc":
                depth += up.tag == "section"
                up = above[up]
            parent = above[s] if above[s].tag == "section" else None
            assert (x["anchor"], x["depth"], x["title"]) == (s.get("anchor"), depth, " ".join("".join(s.find("name").itertext()).split()))
            assert (by_pos[x["parent"]]["anchor"] if x["parent"] is not None else None) == (parent.get("anchor") if parent is not None else None)
            deepest = max(deepest, depth)

        def text(e):
            """Of a block without the blocks in it."""
            out = e.text or ""
            for c in e:
                out += ("" if c.tag in nesting.BLOCKS else text(c)) + (c.tail or "")
            return out

        want = [(e.tag, text(e) if e.tag == "artwork" else " ".join(text(e).split())) for e in tree.iter() if e.tag in nesting.BLOCKS]
        assert [(b["tag"], b["text"]) for b in blocks if b["id"] == i] == want
        assert [(p["tag"], p["target"]) for p in points if p["id"] == i] == [(e.tag, e.get("target")) for e in tree.iter() if e.tag in ("xref", "eref")]
        rows = [(n + 1, k + 1, c.tag == "th", " ".join("".join(c.itertext()).split())) for t in tree.iter("table") for n, tr in enumerate(t) for k, c in enumerate(tr)]
        assert [(c["row"], c["col"], c["is_head"], c["text"]) for c in cells if c["id"] == i] == rows
    assert deepest >= 12
    assert [(x["kind"], x["tag"], x["depth"]) for x in found.where("id = 92").orderBy("pos").collect()] == [("element", "a", 1), ("fault", "b", 1), ("text", None, 2), ("element", "c", 2)]
    assert found.where("id in (90, 91)").count() == 0


def lines_of(spark, *texts):
    return spark.createDataFrame([(d, p, line) for d, text in enumerate(texts) for p, line in enumerate(text.split("\n"))], "doc_id int, pos int, line string")


def test_headings(spark):
    text = "\n".join([
        "2.  Overview ........ 5", "3.  Scope . . . . 7", "", "Introduction and Aims   1", "Security   12", "",
        "1.  Introduction", "", "   Text of it, long enough.", "", "1.1.  Aims", "   More text here.", "", "Status of This Memo", "", "   And so on.", "", "Ends in a stop.", "", "   Body text.",
        "1.1.2.  Deep 0...255", "   Body text.", "", " " * 29 + "CENTRED TITLE", "", "   x", "A.1.  1992", "   Body text.", "Appendix B.  More", "   x y z.", "", *["   indented line"] * 14, "lower case", "",
    ])
    got = nesting.headings(lines_of(spark, text)).orderBy("pos").collect()
    assert [(x["number"], x["title"], x["depth"]) for x in got] == [
        ("1", "Introduction", 1), ("1.1", "Aims", 2), (None, "Status of This Memo", 1), ("1.1.2", "Deep 0...255", 3), (None, "CENTRED TITLE", 1), ("A.1", "1992", 2), ("B", "More", 1),
    ]
    title = {x["pos"]: x["title"] for x in got}
    assert [title.get(x["parent"]) for x in got] == [None, "Introduction", None, "Status of This Memo", None, "CENTRED TITLE", None]
    # where the body isn't indented, a numbered heading needs blank lines around it
    got = nesting.headings(lines_of(spark, "1. One\n\ntext of a body.\n2. in a list\nmore text,\n\n2. Two\n\nend.")).orderBy("pos").collect()
    assert [x["title"] for x in got] == ["One", "Two"]


def test_pages(spark):
    pages = "\n".join([
        "Title", "", "A paragraph that", "", "Doe            Standards Track        [Page 1]", "\f", "RFC 1            Title            May 1999", "", "goes on here.", "", "Second.", "", "",
        "Doe            Standards Track        [Page 2]", "\fRFC 1            Title            May 1999", "", "Third one.", "Fourth", "", "Doe            Standards Track        [Page 3]",
    ])
    got = nesting.depaginated(lines_of(spark, pages, "no pages\n\n\nat all", "")).orderBy("doc_id", "pos").collect()
    assert [x["line"] for x in got if x["doc_id"] == 0] == ["Title", "", "A paragraph that", "goes on here.", "", "Second.", "", "Third one.", "Fourth"]
    assert [x["line"] for x in got if x["doc_id"] == 1] == ["no pages", "", "", "at all"]
    assert [x["pos"] for x in got if x["doc_id"] == 0] == list(range(9))


@pytest.mark.parametrize("name", ["xml_sections_any_depth", "xml_blocks_and_references", "defined_terms", "text_without_pages", "nested_headings"])
def test_derived_rows_are_never_sent_to_the_driver(spark, data, name):
    """Rows derived from a small file are many: joins of them are shuffles, whatever size Spark takes the file for."""
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_documents_that_share_an_id(spark):
    found = nesting.nodes(spark.createDataFrame([(1, "<a><b>"), (1, "<c/>")], "id int, xml string"), "id", "xml").collect()
    assert sorted((x["tag"], x["depth"]) for x in found) == [("a", 1), ("b", 2), ("c", 1)]
