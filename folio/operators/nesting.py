"""What lies in what: parents by a running stack, markup as rows, headings of plain text, pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..sources.tables import cut


def parents(rows: DataFrame, id_col: str, pos_col: str, depth_col: str) -> DataFrame:
    """``rows`` with ``parent``: the pos of the last row before, of the same id, with a smaller depth; null at the top.

    Depths may skip. A text's rows are read in order by one task that holds a stack as deep as the text is.
    """
    kind = rows.schema[pos_col].dataType.simpleString()
    ordered = rows.repartition(id_col).sortWithinPartitions(F.asc_nulls_first(id_col), pos_col)
    schema = rows.withColumn("parent", F.lit(None).cast(kind)).schema

    def run(batches):
        text, stack, first = None, [], True
        for batch in batches:
            out = []
            for i, pos, depth in zip(*(batch.column(c).to_pylist() for c in (id_col, pos_col, depth_col))):
                if first or i != text:
                    text, stack, first = i, [], False
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                out.append(stack[-1][1] if stack else None)
                stack.append((depth, pos))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, batch.schema.field(pos_col).type)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def below(rows: DataFrame, id_col: str, pos_col: str, depth_col: str, opens: Column) -> DataFrame:
    """``rows`` with ``below``: whether a row for which ``opens`` holds lies above it, at any distance.

    A row lies in the last one before it with a smaller depth. One task reads a text's rows in order and holds the
    depth of the outermost such row that is open.
    """
    ordered = rows.withColumn("below", F.coalesce(opens, F.lit(False))).repartition(id_col).sortWithinPartitions(F.asc_nulls_first(id_col), pos_col)

    def run(batches):
        text, held, first = None, None, True
        for batch in batches:
            out = []
            for i, depth, open_ in zip(*(batch.column(c).to_pylist() for c in (id_col, depth_col, "below"))):
                if first or i != text or (held is not None and depth <= held):
                    text, held, first = i, None, False
                out.append(held is not None)
                if open_ and held is None:
                    held = depth
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.bool_())], names=batch.schema.names)

    return ordered.mapInArrow(run, ordered.schema)


# --- markup -------------------------------------------------------------------------------

_TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?!--|\[)[^>]*+>|</?[A-Za-z_](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
_ATTRIBUTE = r"""([A-Za-z_][\w.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""

#: Elements whose own text is one block, and the inline ones that point somewhere, with the attribute that says where.
BLOCKS = ("t", "name", "sourcecode", "artwork", "li", "dt", "dd", "td", "th", "title")
POINTERS = {"xref": "target", "relref": "target", "eref": "target", "iref": "item"}


def unescaped(text: Column) -> Column:
    """The five entities of XML and decimal references of ASCII characters as what they stand for."""
    out = text
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#38", "&"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


def nodes(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, pos, kind, tag, depth, parent, section, block, attributes, text) of the elements and texts of documents in XML.

    Of any depth, in the order of the document; ``kind`` is ``element`` or ``text``, or ``fault`` for a closing tag
    that closes nothing open. ``section`` and ``block`` are the pos of the nearest section and block that a node lies in
    (itself included). Comments, instructions and the document type are no nodes; CDATA is text. Documents are dealt
    over the tasks whole and split into tags and texts by one expression, which leaves each document's in order; what
    is open is a stack over these rows. Nodes are written once: whatever reads them would parse again.

    Whatever joins nodes with each other must do so by a shuffle (``hint("merge")``): Spark takes them for as small as
    the file that they are derived from, and would send them to the driver.
    """
    dealt = docs.select(id_col, xml_col).repartition(id_col).withColumn("__doc", F.monotonically_increasing_id())
    token = F.posexplode(F.regexp_extract_all(F.col(xml_col), F.lit(_TOKEN), F.lit(0))).alias("pos", "token")
    t = dealt.select(id_col, "__doc", token).where("not startswith(token, '<!--') and not startswith(token, '<?') and not (startswith(token, '<!') and not startswith(token, '<![CDATA['))")
    cdata, closes, opens = F.startswith("token", F.lit("<![CDATA[")), F.startswith("token", F.lit("</")), F.col("token").rlike("^<[A-Za-z_]")
    names = F.regexp_extract_all("token", F.lit(_ATTRIBUTE), F.lit(1))
    values = F.transform(F.regexp_extract_all("token", F.lit(_ATTRIBUTE), F.lit(0)), lambda a: unescaped(F.regexp_replace(F.regexp_replace(a, r"(?s)^[^=]*=\s*", ""), r"(?s)^(['\"])(.*)\1$", "$2")))
    attributes = F.map_from_arrays(F.array_distinct(names), F.slice(values, F.lit(1), F.size(F.array_distinct(names))))
    text = F.when(cdata, F.expr("substring(token, 10, length(token) - 12)")).when(~closes & ~opens, F.when(F.contains("token", F.lit("&")), unescaped(F.col("token"))).otherwise(F.col("token")))
    cut_up = t.select(
        id_col, "__doc", "pos", F.when(closes, "close").when(opens, F.when(F.endswith("token", F.lit("/>")), "empty").otherwise("open")).otherwise("text").alias("what"),
        F.when(opens | closes, F.regexp_extract("token", r"^</?([\w.:-]+)", 1)).alias("tag"), text.alias("text"), F.when(opens & F.contains("token", F.lit("=")), attributes).when(opens, F.create_map().cast("map<string, string>")).alias("attributes"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, pos int, kind string, tag string, depth int, parent int, section int, block int, attributes map<string, string>, text string"
    blocks = frozenset(BLOCKS)

    def run(batches):
        doc, stack = None, []  # (tag, pos, section, block)
        for batch in batches:
            take, kinds, places = [], [], []
            for row, (i, pos, what, tag) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__doc", "pos", "what", "tag")))):
                if i != doc:
                    doc, stack = i, []
                _, parent, section, block = stack[-1] if stack else (None, None, None, None)
                if what == "close":
                    at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
                    if at < 0:
                        take.append(row)
                        kinds.append("fault")
                        places.append((len(stack), parent, section, block))
                    else:
                        del stack[at:]
                    continue
                take.append(row)
                kinds.append("text" if what == "text" else "element")
                depth = len(stack) + 1
                if what != "text":
                    section = pos if tag == "section" else section
                    block = pos if tag in blocks else None if tag == "section" else block
                    if what == "open":
                        stack.append((tag, pos, section, block))
                places.append((depth, parent, section, block))
            if take:
                part = batch.take(pa.array(take, pa.int32()))
                columns = [pa.array(c, pa.int32()) for c in zip(*places)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("pos"), pa.array(kinds), part.column("tag"), *columns, part.column("attributes"), part.column("text")], names=[id_col, "pos", "kind", "tag", "depth", "parent", "section", "block", "attributes", "text"])

    return cut(cut_up.mapInArrow(run, schema))


def sections(found: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, anchor, depth, parent, title) of the sections of ``nodes``, to any depth; depth counts sections."""
    level = F.dense_rank().over(Window.partitionBy(id_col).orderBy("level"))
    own = found.where("tag = 'section' and kind = 'element'").select(id_col, "pos", F.col("attributes")["anchor"].alias("anchor"), F.col("depth").alias("level"), F.col("attributes")["title"].alias("own_title"))
    nested = parents(own, id_col, "pos", "level").withColumn("depth", level)
    # a section's title is the text of its name, or an attribute
    named = blocks(found, id_col).where("tag = 'name'").groupBy(id_col, F.col("section").alias("pos")).agg(F.min_by("text", "pos").alias("title"))
    out = nested.join(named.hint("merge"), [id_col, "pos"], "left")
    return out.select(id_col, "pos", "anchor", "depth", "parent", F.coalesce("title", F.trim(squeezed(F.col("own_title")))).alias("title"))


def blocks(found: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, tag, section, text) of the blocks of ``nodes``: the text of a block and of the inlines in it, white space as one space.

    A block inside another one has its own text. Code and artwork keep their white space.
    """
    is_text = F.col("kind") == "text"
    rows = found.where((is_text & F.col("block").isNotNull()) | (F.col("tag").isin(*BLOCKS) & (F.col("kind") == "element")))
    # a block and the texts in it meet in one group
    part = F.when(is_text, F.struct(F.col("pos").alias("at"), "text"))
    met = rows.select(id_col, F.when(is_text, F.col("block")).otherwise(F.col("pos")).alias("pos"), "tag", F.when(~is_text, F.col("section")).alias("section"), part.alias("part")).groupBy(id_col, "pos")
    texts = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"])
    own = met.agg(F.max("tag").alias("tag"), F.max("section").alias("section"), F.array_join(texts, "").alias("text"))
    plain = F.coalesce("text", F.lit(""))
    return own.withColumn("text", F.when(F.col("tag").isin("sourcecode", "artwork"), plain).otherwise(F.trim(squeezed(plain))))


def pointers(found: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, tag, target, section, block): where inlines of ``nodes`` point, with the section and block they stand in."""
    target = F.coalesce(*[F.when(F.col("tag") == tag, F.col("attributes")[name]) for tag, name in POINTERS.items()])
    return found.where(F.col("tag").isin(*POINTERS) & (F.col("kind") == "element")).select(id_col, "pos", "tag", target.alias("target"), "section", "block")


def cells(found: DataFrame, id_col: str) -> DataFrame:
    """(id, table, row, col, is_head, text) of the cells of tables, rows and columns from 1."""
    rows = found.where("tag = 'tr'").select(id_col, F.col("pos").alias("tr"), "parent")
    tables = found.where("tag = 'table'").select(id_col, F.col("pos").alias("table"), "depth")
    edge = Window.partitionBy(id_col).orderBy("at")
    # the table that a row lies in is the last one that began before it: tables don't nest
    both = rows.select(id_col, F.col("tr").alias("at"), "tr", F.lit(None).cast("int").alias("t")).unionByName(tables.select(id_col, F.col("table").alias("at"), F.lit(None).cast("int").alias("tr"), F.col("table").alias("t")))
    placed = both.withColumn("table", F.last("t", True).over(edge)).where("tr is not null").select(id_col, "tr", "table")
    own = found.where("tag in ('td', 'th') and kind = 'element'").select(id_col, "pos", F.col("parent").alias("tr"), (F.col("tag") == "th").alias("is_head"))
    met = own.join(placed.hint("merge"), [id_col, "tr"]).join(blocks(found, id_col).select(id_col, "pos", "text").hint("merge"), [id_col, "pos"])
    row = F.dense_rank().over(Window.partitionBy(id_col, "table").orderBy("tr"))
    col = F.row_number().over(Window.partitionBy(id_col, "tr").orderBy("pos"))
    return met.select(id_col, "table", row.alias("row"), col.alias("col"), "is_head", "text")


# --- headings of plain text ---------------------------------------------------------------

_LEADER = r"(?:(?:\.\s?){4,}|\s(?:\.\s){3,})\s*(?:\d+|[ivx]+)\s*$"
_PAGE_COLUMN = r"\p{L}{2}.*\S {2,}(?:\d+|[ivx]+)\s*$"
_NUMBERED = r"^((?:Appendix\s+)?(?:\d+|[A-Z])(?:\.\d+)*)[.:)]?\s+(\S.*)$"


def headings(lines: DataFrame, width: int = 72) -> DataFrame:
    """(doc_id, pos, number, title, depth, parent) of the headings of ``lines(doc_id, pos, line)``.

    A heading stands at the start of its line, or in the middle of ``width``, and where the body isn't indented, with
    blank lines around it. A numbered one is as deep as its number; others are of depth 1 and need the blank
    lines anyway, a capital first, no sign of a sentence's end, and ten words at most. Entries of a list of
    contents are none: with a leader and a page, or with a page in a column of its own beside another entry.
    The parent is the last heading before it that is less deep.
    """
    by_line = Window.partitionBy("doc_id").orderBy("pos")
    blank = F.trim("line") == ""
    around = lines.withColumn("open", F.coalesce(F.lag(blank).over(by_line), F.lit(True))).withColumn("shut", F.coalesce(F.lead(blank).over(by_line), F.lit(True))).where(~blank)
    entry = F.col("line").rlike(_LEADER)
    column = F.col("line").rlike(_PAGE_COLUMN)
    beside = F.coalesce(F.lag(entry | column).over(by_line), F.lit(False)) | F.coalesce(F.lead(entry | column).over(by_line), F.lit(False))
    left = F.length("line") - F.length(F.ltrim("line"))
    indented = F.avg((left > 0).cast("int")).over(Window.partitionBy("doc_id")) >= 0.5
    told = around.withColumn("contents", entry | (column & beside)).withColumn("indented", indented).withColumn("bare", F.trim("line")).withColumn("left", left)
    number, title = F.regexp_extract("bare", _NUMBERED, 1), F.regexp_extract("bare", _NUMBERED, 2)
    alone = F.col("open") & F.col("shut")
    words = F.size(F.split("bare", r"\s+"))
    plain = alone & F.col("bare").rlike(r"^\p{Lu}") & ~F.col("bare").rlike(r"[.,;:!?]$") & (words <= 10)
    centred = (F.col("left") >= 8) & (F.abs(2 * F.col("left") + F.length("bare") - width) <= 3)
    at_start = (F.col("left") == 0) & (F.col("indented") | alone)
    kept = told.where(~F.col("contents")).withColumn("n", F.when(at_start, number).otherwise(""))
    found = kept.where(((F.col("n") != "") & (F.length("bare") < 120)) | (plain & ((F.col("left") == 0) | centred)))
    is_numbered = F.col("n") != ""
    bare_number = F.regexp_replace("n", r"^Appendix\s+", "")
    out = found.select("doc_id", "pos", F.when(is_numbered, bare_number).alias("number"), squeezed(F.regexp_replace(F.when(is_numbered, title).otherwise(F.col("bare")), r"\.+$", "")).alias("title"), F.when(is_numbered, F.size(F.split(bare_number, r"\."))).otherwise(1).alias("depth"))
    return parents(out, "doc_id", "pos", "depth")


# --- pages --------------------------------------------------------------------------------


def depaginated(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, pos, line) of ``lines`` without page furniture, pos from 0.

    A page ends at a form feed or at a line that ends in ``[Page n]``. What stands last before such an edge or first
    behind it is tallied by document and side, digits taken as one: a line that stands there at two pages or more
    and at ``share`` of them is furniture, as is the line with the page itself. Blank lines at an edge go; where the
    text before it ends no sentence and goes on in small letters, the paragraph is joined, else one blank line stays.
    """
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    feed, footer = F.contains("line", F.lit("\f")), F.col("line").rlike(r"\[Page\s+\w+\]\s*$")
    bare = lines.withColumn("edge", (feed | footer).cast("int")).withColumn("line", F.translate("line", "\f", "")).withColumn("footer", footer)
    # edges next to each other, with nothing but blank lines between, are one: a page has text
    told = bare.withColumn("blank", F.trim("line") == "").withColumn("content", ~F.col("blank") & ~F.col("footer"))
    so_far = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    edge = told.withColumn("edges", F.sum("edge").over(so_far)).withColumn("n_blank", F.sum(F.col("blank").cast("int")).over(so_far))
    # the line with the footer ends the page that it is on; a feed's line begins the next
    paged = edge.withColumn("page", F.col("edges") - F.when(F.col("footer"), 1).otherwise(0))
    content = paged.where("content")
    page = content.withColumn("p", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page")))
    in_page = Window.partitionBy("doc_id", "p")
    sided = page.withColumn("first", F.row_number().over(in_page.orderBy("pos")) == 1).withColumn("last", F.row_number().over(in_page.orderBy(F.desc("pos"))) == 1).withColumn("n_pages", F.max("p").over(Window.partitionBy("doc_id")))
    key = F.regexp_replace(squeezed(F.col("line")), r"\d+", "#")
    side = F.when(F.col("first") & (F.col("p") > 1), "top").when(F.col("last") & (F.col("p") < F.col("n_pages")), "bottom")
    keyed = sided.withColumn("key", key).withColumn("side", side)
    # told by windows over the same document: a join would send lines to the driver, since Spark takes them for as small as their source
    tally = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "side", "key")))
    running = F.col("side").isNotNull() & (F.col("n") >= 2) & (F.col("n") >= share * (F.col("n_pages") - 1))
    kept = tally.where(~running).select("doc_id", "pos", "line", "p", "n_blank")
    # blank lines: those within a page stay; between the pages' last and first lines one stays, or none where the paragraph goes on
    before, page_before = F.lag("line").over(by_pos), F.lag("p").over(by_pos)
    gaps = kept.withColumn("before", before).withColumn("turned", F.coalesce(page_before != F.col("p"), F.lit(False))).withColumn("prev", F.lag("pos").over(by_pos))
    with_blank = gaps.withColumn("had", F.col("n_blank") - F.lag("n_blank").over(by_pos))
    goes_on = ~F.rtrim("before").rlike(r"[.!?:]$") & F.ltrim("line").rlike(r"^\p{Ll}")
    gap = F.when(F.col("prev").isNull(), 0).when(F.col("turned"), F.when(goes_on, 0).otherwise(1)).otherwise(F.coalesce("had", F.lit(0)))
    both = with_blank.withColumn("out", F.concat(F.array_repeat(F.lit(""), gap.cast("int")), F.array("line")))
    each = both.select("doc_id", "pos", F.posexplode("out").alias("k", "line"))
    return each.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")) - 1).alias("pos"), "line")
