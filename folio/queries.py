"""The queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import tables
from .functions import text as T
from .operators import align, citations, diff, documents, extract, fulltext, graph, incremental, judge, lines, lists, nesting, outline, ranges, reports, search, spans, terms
from .plans.filters import Filters
from .sources import adapters as A
from .sources import sinks
from .sources.tables import cut, dealt, kept_table, shared
from .streaming import latest

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- metadata search and filters ----------------------------------------------------------


@query("""
WITH s AS (
  SELECT p_partkey AS number, p_name AS title,
    CASE WHEN lower(p_name) = 'red' THEN 90 WHEN list_contains(string_split(lower(p_name), ' '), 'red') THEN 60 WHEN contains(lower(p_name), 'red') THEN 45 ELSE 0 END AS a,
    CASE WHEN lower(p_name) = 'widget' THEN 90 WHEN list_contains(string_split(lower(p_name), ' '), 'widget') THEN 60 WHEN contains(lower(p_name), 'widget') THEN 45 ELSE 0 END AS b,
    CASE WHEN contains(lower(p_name), 'red widget') THEN 50 ELSE 0 END + CASE WHEN p_type = 'STANDARD' THEN 5 ELSE 0 END AS bonus
  FROM part)
SELECT number, title, CAST(a + b + bonus AS BIGINT) AS score FROM s WHERE a > 0 AND b > 0 ORDER BY score DESC, number DESC LIMIT 100
""")
def meta_search_two_words(spark, sf_dir) -> DataFrame:
    return search.top(search.scored(A.parts(spark, sf_dir), "red widget", ("STANDARD",))).select("number", "title", "score")


@query("""
SELECT o_orderkey AS number, o_orderstatus AS status, o_orderpriority AS stream, c_mktsegment AS "group"
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'O') AND lower(o_orderpriority) = '1-urgent' AND lower(c_mktsegment) IN ('building', 'machinery')
  AND year(o_orderdate) BETWEEN 1996 AND 1998
""")
def meta_search_filters(spark, sf_dir) -> DataFrame:
    f = Filters(status=("F", "O"), stream=("1-urgent",), group=("building", "machinery"), years=(1998, 1996))
    return A.owned_orders(spark, sf_dir).where(f.predicate()).select("number", "status", "stream", "group")


@query("""
SELECT o_orderkey AS number, CAST(o_orderkey AS VARCHAR) = '12' AS exact FROM orders
WHERE starts_with(CAST(o_orderkey AS VARCHAR), '12') ORDER BY exact DESC, number DESC LIMIT 100
""")
def number_query(spark, sf_dir) -> DataFrame:
    return search.by_number(A.orders(spark, sf_dir), "12").select("number", "exact")


@query("""
SELECT o_orderkey AS number, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders
WHERE (year(o_orderdate) > 1997 OR (year(o_orderdate) = 1997 AND month(o_orderdate) >= 6))
  AND NOT (year(o_orderdate) > 1999 OR (year(o_orderdate) = 1999 AND month(o_orderdate) >= 3))
""")
def year_range_after_before(spark, sf_dir) -> DataFrame:
    return A.orders(spark, sf_dir).where(Filters(after=(1997, 6), before=(1999, 3)).predicate()).select("number", "year", "month")


@query("SELECT o_orderkey AS number FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - 90")
def published_within(spark, sf_dir) -> DataFrame:
    return A.orders(spark, sf_dir).where(Filters(within=(90, date(2001, 8, 1))).predicate()).select("number")


@query("SELECT c_name AS author, c_custkey AS number FROM customer WHERE contains(lower(c_name), '#00000001')")
def author_query(spark, sf_dir) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").select(F.col("c_name").alias("author"), F.col("c_custkey").alias("number"))
    return c.where(Filters(author="#00000001").predicate())


@query("SELECT lower(p_brand) AS name, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def wg_counts(spark, sf_dir) -> DataFrame:
    return search.group_counts(A.parts(spark, sf_dir), "brand#1")


@query("SELECT lower(p_brand) AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 12")
def top_groups(spark, sf_dir) -> DataFrame:
    return search.group_counts(A.parts(spark, sf_dir)).limit(12)


@query("""
SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'stream' WHEN grouping(c_mktsegment) = 0 THEN 'group' ELSE 'all' END AS dimension,
  coalesce(o_orderstatus, o_orderpriority, c_mktsegment, '') AS value, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (c_mktsegment))
""")
def filter_counts_grouping_sets(spark, sf_dir) -> DataFrame:
    return search.filter_counts(A.owned_orders(spark, sf_dir), ("status", "stream", "group"))


@query("""
SELECT c_mktsegment AS "group", count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_obsolete, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def group_summary(spark, sf_dir) -> DataFrame:
    return search.group_card(A.owned_orders(spark, sf_dir).withColumn("is_obsolete", F.col("status") == "F"))


# --- lists --------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS pos FROM orders)
SELECT year, count(*) AS n, min(pos) AS first FROM p GROUP BY 1
""")
def year_sections(spark, sf_dir) -> DataFrame:
    return lists.year_sections(A.orders(spark, sf_dir).select("year", F.col("number").alias("pos")))


@query("""
SELECT r_regionkey AS id, r_name AS name, list(n_name ORDER BY n_nationkey) AS titles, CAST(count(*) AS INTEGER) AS n, max(n_nationkey) AS newest
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def series_rows(spark, sf_dir) -> DataFrame:
    return lists.series_rows(A.series(spark, sf_dir), A.table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query("""
WITH s AS (SELECT 0 AS source, user_id, event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 1, user_id, event_id FROM events WHERE event_type = 'signup' UNION ALL SELECT 2, user_id, event_id FROM events WHERE event_type = 'view')
SELECT user_id, event_id, source FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY source, event_id) = 1
""")
def union_dedup_first_source(spark, sf_dir) -> DataFrame:
    e = A.events(spark, sf_dir)
    return lists.union_first([e.where(F.col("event_type") == k).select("user_id", "event_id") for k in ("purchase", "signup", "view")], "user_id", "event_id")


@query("""
SELECT o_orderkey AS number, r.at AS read_at, row_number() OVER (ORDER BY r.at DESC NULLS LAST, o_orderkey) AS rank FROM orders
LEFT JOIN (SELECT user_id, max(event_id) AS at FROM events WHERE event_type = 'view' GROUP BY 1) r ON r.user_id = o_custkey
""")
def last_read_order(spark, sf_dir) -> DataFrame:
    read = A.events(spark, sf_dir).where("event_type = 'view'").groupBy(F.col("user_id").alias("owner")).agg(F.max("event_id").alias("read_at"))
    rows = A.orders(spark, sf_dir).select("owner", "number", F.col("number").alias("pos"))
    return lists.last_read(rows, read, "owner").select("number", "read_at", "rank")


@query("SELECT o_orderkey AS number, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rank FROM orders")
def newest_order(spark, sf_dir) -> DataFrame:
    return lists.newest_first(A.orders(spark, sf_dir)).select("number", "rank")


@query("SELECT o_orderkey AS number, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS rank FROM orders")
def oldest_order(spark, sf_dir) -> DataFrame:
    return lists.oldest_first(A.orders(spark, sf_dir)).select("number", "rank")


@query("""
WITH h AS (SELECT n_nationkey AS id, n_regionkey, row_number() OVER (ORDER BY n_name DESC) AS rank FROM nation), a AS (SELECT DISTINCT s_nationkey AS id FROM supplier),
u AS (SELECT rank AS hit, id, NULL AS series FROM h SEMI JOIN a USING (id) UNION ALL SELECT min(rank), NULL, n_regionkey FROM h GROUP BY n_regionkey)
SELECT row_number() OVER (ORDER BY hit, series NULLS FIRST) AS rank, id, series FROM u
""")
def series_at_best_hit(spark, sf_dir) -> DataFrame:
    n = A.table(spark, sf_dir, "nation")
    hits = n.select(F.col("n_nationkey").alias("id"), F.row_number().over(Window.orderBy(F.desc("n_name"))).alias("rank"))
    members = n.select(F.col("n_regionkey").alias("series"), F.col("n_nationkey").alias("member"))
    return lists.at_best_hit(hits, members, A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id")))


@query("""
WITH u AS (SELECT p_partkey AS id, 0 AS source FROM part WHERE p_partkey = 7 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_brand = 'Brand#7' UNION ALL SELECT p_partkey, 2 FROM part WHERE contains(p_name, 'red')),
f AS (SELECT id, min(source) AS source FROM u GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY source, id) AS INTEGER) AS rank, id, source FROM f ORDER BY source, id LIMIT 8
""")
def quick_open(spark, sf_dir) -> DataFrame:
    p = A.parts(spark, sf_dir)
    found = [p.where(w).select(F.col("number").alias("id"), F.col("number").alias("ord")) for w in ("number = 7", "`group` = 'Brand#7'", "contains(title, 'red')")]
    return lists.quick_open(*found)


@query("""
WITH n AS (SELECT user_id AS id FROM events WHERE event_type IN ('purchase', 'signup')), o AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(c_nationkey, id) AS id FROM n LEFT JOIN customer ON c_custkey = id UNION SELECT id FROM o
""")
def pinned_set(spark, sf_dir) -> DataFrame:
    e = A.events(spark, sf_dir)
    named = [e.where(F.col("event_type") == k).select(F.col("user_id").alias("id")) for k in ("purchase", "signup")]
    members = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("member"))
    return lists.pinned(named, A.orders(spark, sf_dir).where("status = 'P'").select(F.col("owner").alias("id")), members)


@query("SELECT 'known' AS asked, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) = '1-urgent' UNION ALL SELECT 'unknown', 0")
def unknown_values(spark, sf_dir) -> DataFrame:
    """A value that nothing can have leaves nothing, whatever else is asked for."""
    o = A.owned_orders(spark, sf_dir)
    asked = {"known": Filters(status=("F",), stream=("1-urgent",)), "unknown": Filters(status=("F",), stream=("1-urgent",), group=("building", "no such group"))}
    counts = [f.narrowed(o).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asked"), "n") for name, f in asked.items()]
    return counts[0].unionByName(counts[1])


@query("""
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_key(spark, sf_dir) -> DataFrame:
    return lists.latest(A.events(spark, sf_dir), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""
WITH s AS (SELECT user_id AS owner, event_id AS id, ts AS opened, CAST(round(value * 100) AS BIGINT) AS bytes, event_type = 'purchase' AS pinned FROM events),
t AS (SELECT *, sum(bytes) OVER (PARTITION BY owner) AS total FROM s),
v AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY owner ORDER BY opened, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM t WHERE NOT pinned)
SELECT owner, id, bytes FROM v WHERE total - gone > 20000
""")
def lru_victims(spark, sf_dir) -> DataFrame:
    e = A.events(spark, sf_dir).select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("opened"), F.round(F.col("value") * 100).cast("long").alias("bytes"), (F.col("event_type") == "purchase").alias("pinned"))
    return lists.victims(e, 20_000)


@query("""
SELECT count(*) AS n_all, count(*) FILTER (o_orderstatus <> 'F' AND year(o_orderdate) > 1999) AS n_shown,
  count(*) FILTER (year(o_orderdate) > 1999) AS without_obsolete, count(*) FILTER (o_orderstatus <> 'F') AS without_old FROM orders
""")
def why_hidden(spark, sf_dir) -> DataFrame:
    return lists.hiding(A.orders(spark, sf_dir), {"obsolete": F.col("status") != "F", "old": F.col("year") > 1999})


@query("""
WITH l AS (SELECT p_partkey AS number, p_name AS title, CASE WHEN regexp_matches(upper(p_name[1]), '^[A-Z]$') THEN upper(p_name[1]) ELSE '#' END AS label FROM part)
SELECT number, title, label, row_number() OVER (ORDER BY label = '#', label, lower(title), number) AS rank FROM l
""")
def title_groups(spark, sf_dir) -> DataFrame:
    return lists.index_groups(A.parts(spark, sf_dir), "title").select("number", "title", "label", "rank")


@query("SELECT o_orderkey AS number, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS position FROM orders")
def collection_positions(spark, sf_dir) -> DataFrame:
    return lists.renumbered(A.orders(spark, sf_dir), "owner", ["year", "month", "day", "number"]).select("number", "position")


@query("SELECT o_orderkey AS number FROM orders WHERE EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND event_type = 'purchase')")
def narrowed_list(spark, sf_dir) -> DataFrame:
    allowed = A.events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("owner"))
    return lists.narrowed(A.orders(spark, sf_dir), allowed, "owner").select("number")


@query("""
SELECT p_partkey AS number, p_name || ', "' || p_type || '", RFC ' || p_partkey || ', ' || p_size || '.' AS citation FROM part
""")
def citation_format(spark, sf_dir) -> DataFrame:
    p = A.parts(spark, sf_dir)
    return p.select("number", sinks.citation_text(F.col("number"), F.col("status"), F.col("title"), F.col("page_count")).alias("citation"))


@query("""
SELECT p_partkey AS number, '@misc{rfc' || p_partkey || ', author={' || p_brand || '}, title={' || p_name || '}, number=' || p_partkey || ', year=' || p_size || '}' AS entry FROM part
""")
def bibtex_entries(spark, sf_dir) -> DataFrame:
    p = A.parts(spark, sf_dir)
    return p.select("number", sinks.bibtex(F.col("number"), F.col("title"), F.col("group"), F.col("page_count")).alias("entry"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents")
def corpus_manifest(spark, sf_dir) -> DataFrame:
    return sinks.manifest(A.table(spark, sf_dir, "documents"), "doc_id", "text")


# --- citations and graphs -----------------------------------------------------------------

#: Lines of orders with a place of their own: line numbers repeat.
_LINES = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS place FROM lineitem)"


def _lines(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    l = A.table(spark, sf_dir, "lineitem")  # noqa: E741
    return dealt(l, l.count(), "l_orderkey").withColumn("place", F.row_number().over(order))



@query("""
WITH n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
SELECT l_partkey AS cited, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 HAVING count(DISTINCT l_orderkey) > (SELECT floor(n * 0.0008) FROM n)
""")
def assumed_documents(spark, sf_dir) -> DataFrame:
    return citations.assumed(A.citations(spark, sf_dir), 0.0008)


@query("SELECT l_orderkey AS citing, l_linenumber AS place, l_partkey AS cited, count(*) AS n FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1, 2, 3")
def citation_counts(spark, sf_dir) -> DataFrame:
    return citations.counts(A.citations(spark, sf_dir))


@query("""
SELECT l_orderkey AS citing, l_partkey AS cited, CASE min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'normative' WHEN 1 THEN 'informative' ELSE 'unknown' END AS kind, min(l_linenumber) AS first_place
FROM lineitem GROUP BY 1, 2
""")
def strongest_kind(spark, sf_dir) -> DataFrame:
    return citations.strongest(A.citations(spark, sf_dir))


@query("""
SELECT o_orderkey AS cited, o_custkey AS anchor FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') AND o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
""")
def uncited_bibliography(spark, sf_dir) -> DataFrame:
    by_doc = A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("cited"), F.lit(None).cast("long").alias("anchor"))
    by_anchor = A.events(spark, sf_dir).where("event_type = 'purchase'").select(F.lit(None).cast("long").alias("cited"), F.col("user_id").alias("anchor"))
    entries = A.orders(spark, sf_dir).select(F.col("number").alias("cited"), F.col("owner").alias("anchor"))
    return citations.uncited(entries, by_doc.unionByName(by_anchor), "cited", "anchor")


@query(f"""
WITH e AS (SELECT l_orderkey AS doc, place AS entry, l_partkey AS cited, l_linestatus AS kind FROM {_LINES} WHERE l_returnflag <> 'R'),
x AS (SELECT doc, entry, arg_min(kind, entry) AS k1 FROM e GROUP BY 1, 2), y AS (SELECT doc, cited, arg_min(kind, entry) AS k2 FROM e GROUP BY 1, 2)
SELECT l_orderkey AS doc, place AS entry, l_partkey AS cited, coalesce(k1, k2, 'unknown') AS kind FROM {_LINES} LEFT JOIN x ON x.doc = l_orderkey AND x.entry = place LEFT JOIN y ON y.doc = l_orderkey AND y.cited = l_partkey
""")
def kind_with_fallback(spark, sf_dir) -> DataFrame:
    l = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.col("place").alias("entry"), F.col("l_partkey").alias("cited"), "l_returnflag", "l_linestatus")  # noqa: E741
    entries = l.where("l_returnflag != 'R'").select("doc", "entry", "cited", F.col("entry").alias("ord"), F.col("l_linestatus").alias("kind"))
    return citations.with_kind(l.select("doc", "entry", "cited"), entries).select("doc", "entry", "cited", "kind")


@query("""
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS section, CAST(l_partkey % 7 + 1 AS INTEGER) AS target FROM lineitem)
SELECT l.doc, a.section AS to_section, l.section, count(*) AS n FROM l JOIN l a ON a.doc = l.doc AND a.section = l.target WHERE l.section <> a.section GROUP BY 1, 2, 3
""")
def section_backlinks(spark, sf_dir) -> DataFrame:
    l = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section"), (F.col("l_partkey") % 7 + 1).cast("int").alias("target"))  # noqa: E741
    return citations.backlinks(l, l.select("doc", F.col("section").alias("anchor"), "section"))


@query("""
WITH c AS (SELECT l_orderkey AS citing, l_linenumber AS section, l_partkey AS cited, CASE WHEN l_tax > 0.04 THEN l_suppkey END AS cited_section FROM lineitem), u AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT c.cited, cited_section, c.citing, section FROM c JOIN u ON u.citing = c.citing AND u.cited = c.cited WHERE cited_section IS NOT NULL
""")
def amended_sections(spark, sf_dir) -> DataFrame:
    l = A.table(spark, sf_dir, "lineitem")  # noqa: E741
    cites = l.select(F.col("l_orderkey").alias("citing"), F.col("l_linenumber").alias("section"), F.col("l_partkey").alias("cited"), F.when(F.col("l_tax") > 0.04, F.col("l_suppkey")).alias("cited_section"))
    return citations.amendments(cites, l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")))


@query("SELECT l_orderkey AS doc, l_returnflag AS kind, count(*) AS n, list(l_partkey ORDER BY l_linenumber, l_partkey) AS entries FROM lineitem GROUP BY 1, 2")
def references_by_kind(spark, sf_dir) -> DataFrame:
    l = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("cited"))  # noqa: E741
    return citations.by_kind(l)


@query("""
WITH c AS (SELECT l_suppkey AS citing, l_partkey AS cited, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2)
SELECT citing, cited, n, CAST(row_number() OVER (PARTITION BY citing ORDER BY first, cited) AS INTEGER) AS ord FROM c
""")
def first_cited_order(spark, sf_dir) -> DataFrame:
    l = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("citing"), F.col("l_partkey").alias("cited"), F.col("l_orderkey").alias("place"))  # noqa: E741
    return citations.first_cited(l)


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS target FROM pages)
SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY 1
""")
def html_backlinks(spark, sf_dir) -> DataFrame:
    links = extract.page_links(A.table(spark, sf_dir, "pages")).where("href like '/%'")
    return links.groupBy(F.substring("href", 2, 1_000_000).alias("target")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("""
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading,
  CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS n_items FROM pages
""")
def page_shapes(spark, sf_dir) -> DataFrame:
    return extract.page_sections(A.table(spark, sf_dir, "pages"))


def _part_graph(spark, sf_dir) -> DataFrame:
    """A star for each order: its smallest part cites every other part of it, in the order of lines."""
    l = A.table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select("l_orderkey", F.col("l_partkey").alias("b"), F.col("l_linenumber").alias("pos"))  # noqa: E741
    return l.withColumn("a", F.min("b").over(Window.partitionBy("l_orderkey"))).where("a != b").select("a", "b", "pos")


def _path_edges(spark, sf_dir) -> DataFrame:
    """The same, an edge once: written, as the roots are read from it too."""
    return cut(_part_graph(spark, sf_dir).groupBy("a", "b").agg(F.min("pos").alias("pos")))


_GRAPH_SQL = "SELECT DISTINCT m.a, l_partkey AS b FROM lineitem l JOIN (SELECT l_orderkey, min(l_partkey) AS a FROM lineitem GROUP BY 1) m USING (l_orderkey) WHERE l_partkey <> m.a"


@query(f"""
WITH RECURSIVE e AS ({_GRAPH_SQL}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM s GROUP BY 1
  UNION SELECT s.b, min(c.component) FROM c JOIN s ON s.a = c.node JOIN recurring.c AS r ON r.node = s.b WHERE c.component < r.component GROUP BY 1)
SELECT node, component FROM c
""")
def components(spark, sf_dir) -> DataFrame:
    return graph.components(_part_graph(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS ({_GRAPH_SQL}), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
t AS (SELECT l_partkey AS node FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 HAVING count(DISTINCT l_orderkey) > (SELECT floor(n * 0.0008) FROM n)),
r(root, node, depth) AS (SELECT DISTINCT a, a, 0 FROM e WHERE a % 20 = 0 UNION SELECT r.root, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 4 AND (r.depth = 0 OR r.node NOT IN (SELECT node FROM t)))
SELECT root, node, min(depth) AS depth FROM r GROUP BY 1, 2
""")
def reading_path_depth(spark, sf_dir) -> DataFrame:
    """Every twentieth node is a root: the question, not a sample of the graph. Assumed documents are not followed."""
    e = _path_edges(spark, sf_dir)
    assumed = citations.assumed(A.citations(spark, sf_dir), 0.0008).select(F.col("cited").alias("node"))
    return graph.depths(e, e.where("a % 20 = 0").select(F.col("a").alias("root")).distinct(), stop=assumed)


@query()
def reading_path(spark, sf_dir) -> DataFrame:
    """The paths in order; SQL has no depth-first order, tests hold it against a plain walk."""
    e = _path_edges(spark, sf_dir)
    assumed = citations.assumed(A.citations(spark, sf_dir), 0.0008).select(F.col("cited").alias("node"))
    titles = A.parts(spark, sf_dir).select(F.col("number").alias("node"), "title", F.lit(None).cast("array<long>").alias("obsoleted_by"))
    facts = graph.facts(titles, A.events(spark, sf_dir).select(F.col("user_id").alias("node"))).drop("obsoleted_by")
    path = graph.reading_path(e, e.where("a % 20 = 0").select(F.col("a").alias("root")).distinct(), stop=assumed, known=facts)
    return path.select("node", "root", "ord", "depth", "kind", "title", F.coalesce("is_read", F.lit(False)).alias("is_read"))


# --- full text ----------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents(body)), '[^\\p{L}\\p{N}\\p{Co}]+'), lambda x: x <> '')"
_SECTIONS = "SELECT doc_id AS doc, CAST(i - 1 AS INTEGER) AS ord, s[i] AS body FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i) WHERE trim(s[i]) <> ''"


def _sections(spark, sf_dir) -> DataFrame:
    return fulltext.sections_of(A.table(spark, sf_dir, "documents"))


def _index(spark, sf_dir) -> fulltext.Index:
    """The index of the documents' sections: written once a session, then only read."""
    path = kept_table(spark, f"fts:{sf_dir}", lambda at: fulltext.Index.write(_sections(spark, sf_dir), at), f"{sf_dir}/documents.parquet")
    return fulltext.Index(spark, path)


@query(f"""
WITH s AS ({_SECTIONS}), t AS (SELECT {_TOKENS} AS t FROM s)
SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS tokens FROM t
""")
def fts_index(spark, sf_dir) -> DataFrame:
    """Writes the index, if this session has none yet: sections and tokens in it."""
    index = _index(spark, sf_dir)
    return index.sections().agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens"))


@query(f"""
WITH s AS ({_SECTIONS}), t AS (SELECT doc, ord, {_TOKENS} AS t FROM s)
SELECT doc, ord, CAST(len(t) AS INTEGER) AS len, CAST(len(list_filter(t, lambda x: x = 'the')) AS INTEGER) AS tf0, CAST(len(list_filter(t, lambda x: x = 'and')) AS INTEGER) AS tf1
FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'and')
""")
def fts_all_words(spark, sf_dir) -> DataFrame:
    return _index(spark, sf_dir).matching(["the", "and"]).select("doc", "ord", "len", "tf0", "tf1")


@query(f"""
WITH s AS ({_SECTIONS}), t AS (SELECT doc, ord, {_TOKENS} AS t FROM s),
c AS (SELECT doc, ord, len(t) AS l, len(list_filter(t, lambda x: x = 'der')) AS f0, len(list_filter(t, lambda x: x = 'nicht')) AS f1 FROM t),
g AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c)
SELECT doc, ord, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score
FROM c, g WHERE f0 > 0 AND f1 > 0
""")
def fts_bm25(spark, sf_dir) -> DataFrame:
    return _index(spark, sf_dir).bm25(["der", "nicht"]).withColumn("score", F.round("score", 6))


@query(f"""
WITH s AS ({_SECTIONS}), t AS (SELECT doc, ord, {_TOKENS} AS t FROM s),
c AS (SELECT doc, ord, len(t) AS l, len(list_filter(t, lambda x: x = 'license')) AS f0 FROM t), g AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (f0 > 0) AS d0 FROM c),
r AS (SELECT doc, ord, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM c, g SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON c.doc = d.doc_id WHERE f0 > 0)
SELECT doc, ord, score, CAST(row_number() OVER (ORDER BY score DESC, doc, ord) AS INTEGER) AS rank FROM r ORDER BY score DESC, doc, ord LIMIT 50
""")
def fts_best_in_list(spark, sf_dir) -> DataFrame:
    """The 50 best sections for a word among the documents of a list, with their ranks."""
    listed = A.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    scored = _index(spark, sf_dir).bm25(["license"], listed).withColumn("score", F.round("score", 6))
    return fulltext.ranked(scored, [F.desc("score"), F.asc("doc"), F.asc("ord")], 50)


@query(f"""
WITH s AS ({_SECTIONS}) SELECT doc, ord, CAST(row_number() OVER (ORDER BY doc DESC, ord) AS INTEGER) AS rank FROM s SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'de') d ON s.doc = d.doc_id ORDER BY doc DESC, ord LIMIT 50
""")
def fts_without_words(spark, sf_dir) -> DataFrame:
    return _index(spark, sf_dir).listed(A.table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("doc")), 50)


@query(f"WITH s AS ({_SECTIONS}) SELECT count(*) AS n_allowed, count(*) FILTER (doc_id IN (SELECT doc FROM s)) AS n_indexed FROM (SELECT DISTINCT doc_id FROM labels)")
def fts_coverage(spark, sf_dir) -> DataFrame:
    return _index(spark, sf_dir).coverage(A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc")))


@query(f"""
WITH s AS ({_SECTIONS}), t AS (SELECT doc, ord, {_TOKENS} AS t FROM s), p AS (SELECT doc, ord, t, unnest(range(1, len(t))) AS i FROM t)
SELECT doc, ord, CAST(count(*) AS INTEGER) AS n FROM p WHERE t[i] = 'of' AND t[i + 1] = 'the' GROUP BY 1, 2
""")
def fts_phrase(spark, sf_dir) -> DataFrame:
    return _index(spark, sf_dir).phrase(["of", "the"])


@query(f"""
WITH s AS ({_SECTIONS}), t AS (SELECT doc, ord, {_TOKENS} AS t FROM s), p AS (SELECT doc, ord, t[i] AS term, i - 1 AS pos FROM t, unnest(range(1, len(t) + 1)) AS u(i))
SELECT term, count(*) AS tf, count(DISTINCT doc) AS docs FROM p GROUP BY 1
""")
def fts_term_statistics(spark, sf_dir) -> DataFrame:
    return _index(spark, sf_dir).statistics()


@query("""
WITH w AS (SELECT doc_id, trim(regexp_replace(text[1:400], '\\s+', ' ', 'g')) AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) <= 160 THEN w ELSE (CASE WHEN regexp_extract(w[1:160], '^(.*)\\s', 1) = '' THEN w[1:160] ELSE regexp_extract(w[1:160], '^(.*)\\s', 1) END) || '…' END AS opening FROM w
""")
def snippet_opening(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", T.opening(F.col("text")).alias("opening"))


_BM25 = "greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / m))"


@query(f"""
WITH s AS ({_SECTIONS}), t AS (SELECT doc, ord, {_TOKENS} AS t FROM s),
c AS (SELECT doc, ord, len(t) AS l, len(list_filter(t, lambda x: x = 'der')) AS f0, len(list_filter(t, lambda x: x = 'die')) AS f1 FROM t),
g AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c),
r AS (SELECT doc, ord, {_BM25.format(i=0)} + {_BM25.format(i=1)} AS score FROM c, g WHERE f0 > 0 AND f1 > 0)
SELECT doc, ord, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc, ord) AS INTEGER) AS rank FROM r ORDER BY rank LIMIT 20
""")
def fts_best_blocks(spark, sf_dir) -> DataFrame:
    """The 20 best sections for two common words: only of blocks that could hold one of them are postings read."""
    return _index(spark, sf_dir).search([["der"], ["die"]], limit=20).withColumn("score", F.round("score", 6))


def _turns(spark, sf_dir) -> DataFrame:
    """Turns of conversations as sections: the first words as heading, named by role and number."""
    t = A.table(spark, sf_dir, "conversations")
    heading = F.regexp_extract("text", r"^\S+ \S+ \S+", 0)
    return t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), heading.alias("heading"), F.col("text").alias("body"), F.concat_ws("-", "role", "turn").alias("anchor"), F.col("turn").cast("string").alias("number"))


_OF = "list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')"


@query(f"""
WITH s AS (SELECT conv_id AS doc, turn AS ord, role, {_OF.format(c="regexp_extract(text, '^[^\\s]+ [^\\s]+ [^\\s]+')")} AS h, {_OF.format(c='text')} AS b FROM conversations),
c AS (SELECT doc, ord, role, len(h) + len(b) AS l, len(list_filter(h || b, lambda x: x = 'and')) AS f0,
  len(list_filter(range(1, len(b)), lambda i: b[i] = 'of' AND b[i + 1] = 'the')) + len(list_filter(range(1, len(h)), lambda i: h[i] = 'of' AND h[i + 1] = 'the')) AS f1 FROM s),
g AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c),
r AS (SELECT doc, ord, {_BM25.format(i=0)} + {_BM25.format(i=1)} AS score FROM c, g WHERE f0 > 0 AND f1 > 0 AND role = 'user')
SELECT doc, ord, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc, ord) AS INTEGER) AS rank FROM r ORDER BY rank LIMIT 30
""")
def fts_phrase_and_word_in_section(spark, sf_dir) -> DataFrame:
    """A phrase and a word in one search, in the sections that a name stands for."""
    path = kept_table(spark, f"fts-turns:{sf_dir}", lambda at: fulltext.Index.write(_turns(spark, sf_dir), at, ("heading", "body")), f"{sf_dir}/conversations.parquet")
    return fulltext.Index(spark, path).search([["of", "the"], ["and"]], section="user", limit=30).withColumn("score", F.round("score", 6))


@query(f"""
WITH now AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'The text and the title were withdrawn.' ELSE text END AS text FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0 AND quality = 0)),
s AS ({_SECTIONS.replace('FROM documents', 'FROM now')}), t AS (SELECT doc, ord, {_TOKENS} AS t FROM s),
c AS (SELECT doc, ord, len(t) AS l, len(list_filter(t, lambda x: x = 'the')) AS f0, len(list_filter(t, lambda x: x = 'text')) AS f1 FROM t),
g AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c)
SELECT doc, ord, round({_BM25.format(i=0)} + {_BM25.format(i=1)}, 6) AS score FROM c, g WHERE f0 > 0 AND f1 > 0
""")
def fts_after_batches(spark, sf_dir) -> DataFrame:
    """An index written in batches: German documents come later, some are replaced, some go; searched without a merge."""
    docs, labels = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels")

    def batches(at):
        german = F.col("lang") == "de"
        index = fulltext.Index.write(fulltext.sections_of(docs.where(~german)), at)
        index = index.add(fulltext.sections_of(docs.where(german)))
        toxic = labels.where("toxic = 1").select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), F.lit(0).alias("ord"), F.lit("The text and the title were withdrawn.").alias("body"))
        index.add(toxic, labels.where("toxic = 0 and quality = 0").select(F.col("doc_id").alias("doc")))

    index = fulltext.Index(spark, kept_table(spark, f"fts-batches:{sf_dir}", batches, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"))
    return index.bm25(["the", "text"]).withColumn("score", F.round("score", 6))


@query(f"""
WITH w AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, s FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS s FROM documents)),
r AS (SELECT doc_id AS doc, CAST(i - 1 AS INTEGER) AS ord, list_filter(regexp_split_to_array(s[i], '\\s+'), lambda x: x <> '') AS w FROM w WHERE trim(s[i]) <> ''),
h AS (SELECT doc, ord, w, list_transform(w, lambda x: list_contains({_OF.format(c='x')}, 'license')) AS hit FROM r),
f AS (SELECT *, list_position(hit, true) AS first FROM h WHERE list_contains(hit, true)),
a AS (SELECT *, greatest(1, least(first - 4, len(w) - 15)) AS start FROM f)
SELECT doc, ord, array_to_string(list_transform(range(start, least(len(w), start + 15) + 1), lambda i: CASE WHEN hit[i] THEN '[' || w[i] || ']' ELSE w[i] END), ' ') AS snippet FROM a
""")
def fts_snippets(spark, sf_dir) -> DataFrame:
    """Snippets of the sections that the index finds; only their documents' texts are read."""
    hits = _index(spark, sf_dir).matching(["license"]).select("doc", "ord")
    texts = A.table(spark, sf_dir, "documents").join(hits.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return fulltext.snippet(fulltext.sections_of(texts).join(hits, ["doc", "ord"], "left_semi"), ["license"])


_WORDS = "list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[-''][\\p{L}\\p{N}]+)*'), lambda w: w = lower(w))"


@query(f"""
WITH d AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY 1)
SELECT word, df FROM d WHERE df >= greatest(1, ceil((SELECT count(*) FROM documents) * 0.05))
""")
def doc_frequency_common_words(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return fulltext.common_words(fulltext.document_frequency(d, T.frequency_words), d.agg(F.count(F.lit(1)).alias("n")), 0.05)


@query(f"""
WITH d AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY 1)
SELECT share, count(*) FILTER (df >= greatest(1, ceil((SELECT count(*) FROM documents) * share))) AS n_common FROM d, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.2::DOUBLE)) AS t(share) GROUP BY 1
""")
def word_threshold_report(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return fulltext.threshold_report(fulltext.document_frequency(d, T.frequency_words), d.agg(F.count(F.lit(1)).alias("n")), [0.01, 0.05, 0.2])


# --- text as lines ------------------------------------------------------------------------


@query("""
WITH l AS (SELECT doc_id, regexp_replace(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')), '\\d+', '#', 'g') AS line FROM documents)
SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 2
""")
def line_furniture(spark, sf_dir) -> DataFrame:
    return lines.furniture(A.lines(spark, sf_dir))


@query("SELECT doc_id, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE regexp_matches(text, '(?i)license')")
def license_lines(spark, sf_dir) -> DataFrame:
    return A.lines(spark, sf_dir).where(F.col("line").rlike("(?i)license")).select("doc_id", F.col("line").alias("text"))


_METRICS = """
WITH l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
g AS (SELECT *, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS gap FROM l QUALIFY true),
k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY doc_id, gap ORDER BY pos) - 1) / 8) AS BIGINT) AS part FROM g WHERE trim(line) <> ''),
m AS (SELECT doc_id, gap, part, count(*) AS n_lines, CAST(sum(len(line)) AS BIGINT) AS chars, CAST(sum(len(line) - len(regexp_replace(line, '\\p{L}', '', 'g'))) AS BIGINT) AS letters,
  CAST(sum(len(line) - len(regexp_replace(line, '\\p{Lu}', '', 'g'))) AS BIGINT) AS capitals, CAST(sum(len(line) - len(regexp_replace(line, '[$%&*#|]', '', 'g'))) AS BIGINT) AS symbols,
  CAST(sum(len(line) - len(replace(line, '|', ''))) AS BIGINT) AS bars, max(CAST(regexp_matches(line, '[.!?]') AS INTEGER)) AS stops FROM k GROUP BY 1, 2, 3),
r AS (SELECT *, list_filter([CASE WHEN chars < 40 THEN 'too_short' END, CASE WHEN symbols * 20 > chars THEN 'symbols' END, CASE WHEN bars >= 2 * n_lines THEN 'table' END,
  CASE WHEN capitals * 2 > letters THEN 'capitals' END, CASE WHEN stops = 0 THEN 'no_sentence' END], lambda x: x IS NOT NULL) AS refused FROM m)
"""


@query(_METRICS + "SELECT doc_id, gap, part, n_lines, chars, array_to_string(refused, ' ') AS refused FROM r")
def prose_guards(spark, sf_dir) -> DataFrame:
    r = lines.refusals(lines.block_metrics(A.lines(spark, sf_dir)))
    return r.select("doc_id", "gap", "part", "n_lines", "chars", F.array_join("refused", " ").alias("refused"))


@query(_METRICS + "SELECT guard, count(*) AS n, count(*) FILTER (sole) AS n_sole FROM (SELECT unnest(refused) AS guard, len(refused) = 1 AS sole FROM r) GROUP BY 1")
def guard_histogram(spark, sf_dir) -> DataFrame:
    return lines.histogram(lines.refusals(lines.block_metrics(A.lines(spark, sf_dir))))


@query(_METRICS + """
SELECT doc_id, gap, part, refused[1] AS criterion FROM r WHERE len(refused) = 1 AND CASE refused[1] WHEN 'too_short' THEN chars >= 36 WHEN 'symbols' THEN symbols * 20 < chars * 1.1 WHEN 'table' THEN bars * 10 < 22 * n_lines WHEN 'capitals' THEN capitals * 20 < letters * 11 ELSE false END
""")
def boundary_sample(spark, sf_dir) -> DataFrame:
    return lines.boundary(lines.refusals(lines.block_metrics(A.lines(spark, sf_dir)))).select("doc_id", "gap", "part", "criterion")


_HEADING = r"'^((?:\d+|[A-Z])(?:\.\d+)*)\.?\s+(\S.*)$'"


@query(f"""
WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
h AS (SELECT doc_id, pos, regexp_extract(line, {_HEADING}, 1) AS number, regexp_extract(line, {_HEADING}, 2) AS title FROM l)
SELECT doc_id, pos, number, title, CAST(len(string_split(number, '.')) AS INTEGER) AS depth, nullif(regexp_extract(number, '^(.*)\\.[^.]+$', 1), '') AS parent FROM h WHERE number <> '' AND NOT regexp_matches(title, '[.]{{4}}')
""")
def numbered_headings(spark, sf_dir) -> DataFrame:
    return lines.headings(A.lines(spark, sf_dir))


@query("""
WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, CAST(l_quantity AS INTEGER) || '.' || l_linenumber AS number FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM lineitem)
SELECT doc_id, pos, number FROM s WHERE number = '1' OR starts_with(number, '1.')
""")
def section_subtree(spark, sf_dir) -> DataFrame:
    of = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("int").cast("string").alias("own"))
    numbers = F.array(F.concat("own", F.lit("."), "pos"), "own")
    return lines.subtree(of.select("doc_id", "pos", F.explode(numbers).alias("number")), "1")


def line_anchors(spark, sf_dir) -> DataFrame:
    """(doc_id, pos, anchor): each line's first letters as an anchor."""
    return A.lines(spark, sf_dir).select("doc_id", "pos", F.lower(F.regexp_extract("line", "[A-Za-z]{1,3}", 0)).alias("anchor")).where("anchor != ''")


@query("""
WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lower(regexp_extract(s[i], '[A-Za-z]{1,3}')) AS anchor FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY pos) AS nth FROM l WHERE anchor <> '')
SELECT doc_id, pos, CASE WHEN nth > 1 THEN anchor || '-' || nth ELSE anchor END AS anchor FROM n
""")
def anchors_made_unique(spark, sf_dir) -> DataFrame:
    return lines.unique_anchors(line_anchors(spark, sf_dir))


@query("""
WITH l AS (SELECT doc_id, lower(regexp_extract(s[i], '[A-Za-z]{1,3}')) AS anchor FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i))
SELECT doc_id AS doc, anchor FROM l WHERE anchor <> '' UNION SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL UNION SELECT doc_id, source FROM documents WHERE source IS NOT NULL
""")
def anchors_of_documents(spark, sf_dir) -> DataFrame:
    of = lambda c: A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col(c).alias("anchor"))
    return outline.anchor_set(line_anchors(spark, sf_dir).withColumnRenamed("doc_id", "doc"), of("lang"), of("source"))


@query(r"""
WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\b(e\.g|i\.e|Sec|cf|vs|Fig)\.', '\1' || chr(1), 'g'), '\s+', ' ', 'g')) AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(t, '([.!?]["'')\]]*) ([\p{Lu}\p{N}"''(\[])', '\1' || chr(10) || '\2', 'g') AS t FROM k)
SELECT doc_id, CAST(len(list_filter(string_split(t, chr(10)), lambda x: x <> '')) AS INTEGER) AS n_sentences FROM c
""")
def sentences(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\b(?:License|Licensed|GNU|MIT|Apache)\\b')) AS INTEGER) AS n_found FROM documents WHERE regexp_matches(text, '\\b(?:License|Licensed|GNU|MIT|Apache)\\b')")
def keyword_sentences(spark, sf_dir) -> DataFrame:
    found = extract.requirements(A.table(spark, sf_dir, "documents"), words=("Licensed", "License", "GNU", "MIT", "Apache"))
    return found.groupBy("doc_id").agg(F.sum(F.size("found")).cast("int").alias("n_found"))


def _named_models(spark, sf_dir) -> DataFrame:
    """A text for each part that spells out its name and gives its letters."""
    name = F.initcap(F.col("p_name"))
    letters = F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), ""))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("It is the "), name, F.lit(" Model ("), letters, F.lit("M) of "), F.col("p_brand"), F.lit(". See (it) too.")).alias("text"), "p_brand")


@query("""
SELECT p_partkey AS doc_id, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) || 'M' AS short, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Model' AS long FROM part
""")
def abbreviations(spark, sf_dir) -> DataFrame:
    return extract.abbreviations(_named_models(spark, sf_dir))


@query("""
SELECT upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')) || 'M' AS short, count(DISTINCT p_partkey) AS docs, count(DISTINCT lower(p_name)) AS expansions FROM part GROUP BY 1 ORDER BY docs DESC, short LIMIT 200
""")
def abbreviation_totals(spark, sf_dir) -> DataFrame:
    return extract.abbreviation_totals(extract.abbreviations(_named_models(spark, sf_dir)))


@query(r"""
WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i) UNION ALL SELECT -1 - p_partkey, 0, p_name || ': ' || p_type FROM part),
f AS (SELECT doc_id, pos, regexp_extract(line, '^\s*(\S[^:]{0,60}?):\s+(\S.*)$', 1) AS term, regexp_extract(line, '^\s*(\S[^:]{0,60}?):\s+(\S.*)$', 2) AS meaning FROM l)
SELECT doc_id, pos, term, meaning FROM f WHERE term <> ''
""")
def definitions(spark, sf_dir) -> DataFrame:
    parts = A.table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("doc_id"), F.lit(0).alias("pos"), F.concat("p_name", F.lit(": "), "p_type").alias("line"))
    return extract.definitions(A.lines(spark, sf_dir).unionByName(parts))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line) = '') AS n_blank, CAST(sum(len(line)) AS BIGINT) AS n_chars, CAST(max(len(line)) AS INTEGER) AS longest,
  count(*) FILTER (regexp_matches(line, '^\\d+(\\.\\d+)*\\.?\\s+\\S')) AS n_headings FROM l GROUP BY 1
""")
def document_report(spark, sf_dir) -> DataFrame:
    return outline.document_report(A.lines(spark, sf_dir))


@query(_METRICS + """
SELECT refused[1] AS criterion, count(*) AS n FROM r WHERE len(refused) = 1 AND CASE refused[1] WHEN 'too_short' THEN chars >= 36 WHEN 'symbols' THEN symbols * 20 < chars * 1.1 WHEN 'table' THEN bars * 10 < 22 * n_lines WHEN 'capitals' THEN capitals * 20 < letters * 11 ELSE false END GROUP BY 1
""")
def boundary_counts(spark, sf_dir) -> DataFrame:
    return lines.boundary(lines.refusals(lines.block_metrics(A.lines(spark, sf_dir)))).groupBy("criterion").agg(F.count(F.lit(1)).alias("n"))


@query(_METRICS + """,
t AS (SELECT *, len(refused) = 1 AS near, (bars >= 2)::INT AS b, (symbols > 0)::INT AS s, (capitals * 4 > letters)::INT AS c, list_contains(refused, 'no_sentence') AS gate FROM r),
d AS (SELECT *, CASE WHEN gate AND b + s + c IN (1, 2) THEN CASE WHEN b <> s AND b <> c THEN 'bars' WHEN s <> b AND s <> c THEN 'symbols' ELSE 'capitals' END END AS dissent FROM t),
n AS (SELECT 'documents' AS measure, '' AS key, count(DISTINCT doc_id) AS n FROM d UNION ALL SELECT 'blocks', '', count(*) FROM d UNION ALL SELECT 'prose', '', count(*) FROM d WHERE len(refused) = 0
  UNION ALL SELECT 'near_misses', '', count(*) FROM d WHERE near UNION ALL SELECT 'guard', unnest(refused) AS g, count(*) FROM d GROUP BY g UNION ALL SELECT 'sole', refused[1], count(*) FROM d WHERE near GROUP BY refused[1]
  UNION ALL SELECT 'dissent', dissent, count(*) FROM d WHERE dissent IS NOT NULL GROUP BY dissent)
SELECT measure, key, n, NULL AS doc_id, NULL AS gap, NULL AS block FROM n WHERE n > 0
UNION ALL (SELECT 'sample', refused[1], 1, doc_id, gap, part FROM d WHERE near ORDER BY doc_id, gap, part LIMIT 2000)
""")
def prose_report(spark, sf_dir) -> DataFrame:
    """The report of the whole, from a stored one of each part."""
    path = f"{shared(spark)}/reports-{uuid.uuid4().hex}"
    refused = lines.refusals(lines.block_metrics(A.lines(spark, sf_dir)))
    reports.store(reports.partials(refused, F.pmod("doc_id", F.lit(7))), path)
    return reports.merged(reports.stored(spark, path))


@query("""
WITH q AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'RFC ' || 2 * p_partkey WHEN 1 THEN ' rfc00' || p_partkey WHEN 2 THEN 'bcp-' || p_size % 7 ELSE p_name END AS query, CASE p_size % 4 WHEN 0 THEN 2 * p_partkey WHEN 1 THEN p_partkey END AS n, CASE p_size % 4 WHEN 2 THEN p_size % 7 END AS s FROM part)
SELECT query, CASE WHEN p_partkey IS NULL THEN 'words' ELSE 'document' END AS how, 0 AS pos, p_partkey AS number FROM q LEFT JOIN part ON p_partkey = n WHERE s IS NULL OR s NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT query, 'series', pos, n_nationkey FROM q JOIN (SELECT n_nationkey, n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos FROM nation) ON n_regionkey = s WHERE n_nationkey IN (SELECT p_partkey FROM part)
""")
def document_lookup(spark, sf_dir) -> DataFrame:
    """Labels of parts as documents, series and words: what each names."""
    p, kind = A.table(spark, sf_dir, "part"), F.col("p_size") % 4
    label = F.when(kind == 0, F.concat(F.lit("RFC "), 2 * F.col("p_partkey"))).when(kind == 1, F.concat(F.lit(" rfc00"), "p_partkey")).when(kind == 2, F.concat(F.lit("bcp-"), F.col("p_size") % 7)).otherwise(F.col("p_name"))
    series = A.series(spark, sf_dir).withColumn("series", F.lit("BCP"))
    return search.looked_up(p.select(label.alias("query")), A.parts(spark, sf_dir), series)


# --- sections and headers -----------------------------------------------------------------


def _outline(spark, sf_dir) -> DataFrame:
    """Lines of orders as sections: the first seven are numbered 1, 1.1, 1.1.1, 1.2, 2, 2.1, 2.1.1."""
    numbers = F.array(*map(F.lit, ("1", "1.1", "1.1.1", "1.2", "2", "2.1", "2.1.1")))
    n = A.table(spark, sf_dir, "lineitem").count()
    part = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    l = dealt(dealt(_lines(spark, sf_dir), n, "l_partkey").join(part, "l_partkey"), n, "l_orderkey")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("doc"), F.col("place").alias("pos"), F.get(numbers, F.col("place") - 1).alias("number"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("anchor"), F.col("p_name").alias("title"), (F.col("l_linestatus") == "F").alias("is_appendix"), "l_returnflag")


_OUTLINE_SQL = f"SELECT l_orderkey AS doc, place AS pos, ['1', '1.1', '1.1.1', '1.2', '2', '2.1', '2.1.1'][place] AS number, 's' || l_suppkey AS anchor, p_name AS title, l_linestatus = 'F' AS is_appendix, l_returnflag FROM {_LINES} JOIN part ON p_partkey = l_partkey"


@query(f"""
WITH s AS ({_OUTLINE_SQL}), o AS (SELECT *, CASE WHEN number = '1.1' AND is_appendix THEN 0 ELSE NULL END AS k FROM s)
SELECT doc, pos, number FROM o WHERE k = 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY pos) = 1
""")
def section_lookup_appendix(spark, sf_dir) -> DataFrame:
    return outline.lookup(_outline(spark, sf_dir), "Appendix 1.1.").select("doc", "pos", "number")


@query(f"""
WITH s AS ({_OUTLINE_SQL}), o AS (SELECT *, CASE WHEN number = '2' AND NOT is_appendix THEN 0 WHEN number = '2' THEN 1 END AS k FROM s)
SELECT doc, pos, number FROM o WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY k, pos) = 1
""")
def section_lookup_number(spark, sf_dir) -> DataFrame:
    return outline.lookup(_outline(spark, sf_dir), "§2").select("doc", "pos", "number")


@query(f"WITH s AS ({_OUTLINE_SQL}) SELECT doc, pos, number FROM s WHERE contains(lower(title), 'red') AND contains(lower(title), 'widget')")
def section_lookup_words(spark, sf_dir) -> DataFrame:
    return outline.lookup(_outline(spark, sf_dir), "Widget RED").select("doc", "pos", "number")


@query(f"""
WITH s AS ({_OUTLINE_SQL}), m AS (SELECT * FROM s WHERE contains(lower(title), 'red') OR starts_with(number, 'red')),
a AS (SELECT DISTINCT s.doc, s.pos FROM s JOIN m ON m.doc = s.doc AND (m.pos = s.pos OR m.number = s.number OR starts_with(m.number, s.number || '.')))
SELECT a.doc, a.pos, EXISTS (SELECT 1 FROM m WHERE m.doc = a.doc AND m.pos = a.pos) AS is_match FROM a
""")
def outline_with_context(spark, sf_dir) -> DataFrame:
    return outline.outline(_outline(spark, sf_dir), "red")


@query("SELECT l_orderkey AS doc, l_linenumber AS pos, round(percent_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 6) AS share FROM lineitem")
def relative_position(spark, sf_dir) -> DataFrame:
    return outline.relative_position(A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"))).withColumn("share", F.round("share", 6))


@query(f"""
WITH s AS ({_OUTLINE_SQL}), r AS (SELECT doc, pos, l_returnflag AS value, row_number() OVER (PARTITION BY doc ORDER BY pos) - row_number() OVER (PARTITION BY doc, l_returnflag ORDER BY pos) AS g FROM s)
SELECT doc, value, min(pos) AS first, count(*) AS n FROM r GROUP BY doc, value, g
""")
def section_runs(spark, sf_dir) -> DataFrame:
    return outline.runs(_outline(spark, sf_dir).select("doc", "pos", F.col("l_returnflag").alias("value")), "value").drop("run")


@query("""
SELECT p_partkey AS number, p_size AS stated, s_name AS title, n_name AS "group", CASE WHEN p_size <> p_partkey THEN 'states ' || p_size END AS note FROM part JOIN supplier ON s_suppkey = p_partkey LEFT JOIN nation ON n_nationkey = s_nationkey
""")
def merged_headers(spark, sf_dir) -> DataFrame:
    docs = A.parts(spark, sf_dir).select("number", F.col("page_count").alias("stated"), "title", "group")
    n = A.table(spark, sf_dir, "nation")
    catalogue = A.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("title"), F.col("n_name").alias("group"))
    return outline.merged_headers(docs, catalogue, ("title", "group")).select("number", "stated", "title", "group", "note")


@query("SELECT user_id, list_extract(['view', 'click', 'signup', 'purchase'], CAST(max(list_position(['view', 'click', 'signup', 'purchase'], event_type)) AS BIGINT)) AS stage FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1")
def furthest_stage(spark, sf_dir) -> DataFrame:
    return outline.furthest(A.events(spark, sf_dir).select("user_id", F.col("event_type").alias("state")), "user_id", ("view", "click", "signup", "purchase"))


@query("SELECT s_nationkey AS nation, count(*) AS n, list(s_name ORDER BY s_name) AS names FROM supplier WHERE s_acctbal > 5000 GROUP BY 1")
def group_chairs(spark, sf_dir) -> DataFrame:
    people = A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") > 5000, "chair").otherwise("member").alias("role"), F.col("s_name").alias("name"))
    return outline.leaders(people, "nation")


@query("""
SELECT p_partkey AS number, 'BCP' AS series, p_partkey AS parsed, 'section-' || p_size || '.2' AS anchor, 'Section ' || p_size || '.2' AS place, replace(p_name, ' ', '-') AS slug, 'RFC' AS link_series, p_partkey AS linked, [2026, p_size, 1] AS version,
  rpad(p_name[1:3], 8, ' ') || 'x' AS spaced, starts_with(lower(p_name), 'red') AS prefixed FROM part
""")
def text_rules(spark, sf_dir) -> DataFrame:
    """Ids, anchors, places, slugs, links, versions, tabs and prefixes made of parts."""
    p = A.parts(spark, sf_dir)
    n, size = F.col("number").cast("string"), F.col("page_count").cast("string")
    section = F.concat(size, F.lit(".2"))
    doc, link = T.document_id(F.concat(F.lit("bcp "), n)), T.link_target(F.concat(F.lit("https://example.org/rfc"), n, F.lit(".html#top")))
    return p.select(
        "number", doc["series"].alias("series"), doc["number"].cast("long").alias("parsed"), T.section_anchor(section).alias("anchor"), T.place_name(section).alias("place"), T.slug(F.col("title")).alias("slug"), link["series"].alias("link_series"), link["number"].cast("long").alias("linked"),
        T.version_key(F.concat(F.lit("2026."), size, F.lit(".1"))).alias("version"), T.expanded(F.concat(F.substring("title", 1, 3), F.lit("\tx"))).alias("spaced"), T.starts_with_any_case(F.col("title"), "RED").alias("prefixed"),
    )


@query("""
WITH d AS (SELECT doc_id, lang AS title, text AS body FROM documents), e AS (SELECT *, replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS b FROM d)
SELECT doc_id, md5('# ' || title || chr(10) || chr(10) || body || chr(10)) AS markdown, md5('<h1>' || title || '</h1>' || chr(10) || '<p>' || regexp_replace(b, '\\n\\s*\\n', '</p>' || chr(10) || '<p>', 'g') || '</p>' || chr(10)) AS html FROM e
""")
def rendered_documents(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(sinks.markdown(F.col("lang"), F.col("text"))).alias("markdown"), F.md5(sinks.html(F.col("lang"), F.col("text"))).alias("html"))


@query("""
WITH q AS (SELECT doc_id, text, text[11:40] AS quote, CASE WHEN lang = 'en' THEN 10 ELSE 3 END AS place FROM documents),
n AS (SELECT *, CASE WHEN quote = '' THEN 0 ELSE (len(text) - len(replace(text, quote, ''))) // len(quote) END AS n FROM q)
SELECT doc_id AS quote_id, doc_id, CASE WHEN text[place + 1:place + len(quote)] = quote THEN 'exact' WHEN n = 1 THEN 'moved' WHEN n > 1 THEN 'ambiguous' ELSE 'detached' END AS state FROM n
""")
def relocated_quotes(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    quotes = d.select(F.col("doc_id").alias("quote_id"), "doc_id", F.substring("text", 11, 30).alias("quote"), F.when(F.col("lang") == "en", 10).otherwise(3).alias("at"))
    return extract.relocated(quotes, d)


def _part_texts(spark, sf_dir) -> DataFrame:
    """A text of several lines for each part: a header, a bibliography of two entries, a caption, a definition."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = [F.lit("Obsoletes: "), n, F.lit(", "), size, F.lit("\n\n[A"), n, F.lit("] "), F.col("p_name"), F.lit(",\n   RFC "), size, F.lit(".\n[B] "), F.col("p_type"), F.lit("\n\nFigure "), size, F.lit(": "), F.col("p_name"), F.lit("\nSee Section "), size, F.lit(".1 of RFC "), n, F.lit(" too. End.")]
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(*body).alias("text"))


def _part_lines(spark, sf_dir) -> DataFrame:
    return _part_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("SELECT p_partkey AS doc_id, 0 AS ord, CAST(p_partkey AS INTEGER) AS number FROM part UNION ALL SELECT p_partkey, 1, p_size FROM part")
def header_numbers(spark, sf_dir) -> DataFrame:
    return documents.header_numbers(_part_texts(spark, sf_dir), "obsoletes")


@query("SELECT p_partkey AS doc_id, CAST(1 AS BIGINT) AS ord, 'A' || p_partkey AS label, p_name || ', RFC ' || p_size || '.' AS entry, p_size AS number FROM part UNION ALL SELECT p_partkey, 2, 'B', p_type, NULL FROM part")
def bibliography_entries(spark, sf_dir) -> DataFrame:
    return documents.bibliography(_part_lines(spark, sf_dir))


@query("SELECT p_partkey AS doc_id, 6 AS pos, 'figure' AS kind, p_size AS number, p_name AS caption FROM part")
def captions(spark, sf_dir) -> DataFrame:
    return documents.captions(_part_lines(spark, sf_dir))


@query("SELECT p_partkey AS doc_id, 'See too.' AS \"window\" FROM part")
def citing_windows(spark, sf_dir) -> DataFrame:
    t = _part_texts(spark, sf_dir).select("doc_id", F.regexp_extract("text", r"(See Section .*)$", 1).alias("text"))
    return documents.citing_windows(t, spans.link_spans(t, "doc_id", "text"), "doc_id", "text").select("doc_id", "window")


@query("""
SELECT p_partkey AS number, [p_size || '.2', 'A.' || p_size] AS sections, [p_name, p_type] AS spellings, p_size >= 25 AS is_boilerplate,
  CASE WHEN p_type = 'STANDARD' THEN 'grammar' WHEN p_type = 'SMALL' THEN 'code' END AS artwork FROM part
""")
def term_and_section_rules(spark, sf_dir) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    field = F.concat(F.lit("Section "), size, F.lit(".2, Appendix A."), size, F.lit(" and 7.1 of RFC 9"))
    term = F.concat(F.lit('"'), F.col("p_name"), F.lit('" ('), F.col("p_type"), F.lit(") [X]"))
    rule = F.when(F.col("p_size") >= 25, 'The words "MUST" and so on are interpreted so').otherwise("You MUST go")
    kind = F.when(F.col("p_type") == "STANDARD", " ABNF").when(F.col("p_type") == "SMALL", "json").otherwise("other")
    return p.select(
        F.col("p_partkey").alias("number"), documents.errata_sections(field).alias("sections"), documents.term_spellings(term).alias("spellings"), documents.is_boilerplate(rule, F.lit(True)).alias("is_boilerplate"), documents.artwork_kind(kind).alias("artwork")
    )


@query("""
WITH w AS (SELECT p_partkey AS doc_id, string_split(p_name || ' of ' || p_name, ' ') AS w FROM part), k(key, a, b) AS (VALUES ('rw', 'red', 'widget'), ('r', 'red', NULL)),
m AS (SELECT doc_id, i - 1 AS pos, CASE WHEN w[i + 1] = 'widget' THEN 'rw' ELSE 'r' END AS key, CASE WHEN w[i + 1] = 'widget' THEN 2 ELSE 1 END AS n_words FROM w, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] = 'red')
SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, key, CAST(min(n_words) AS INTEGER) AS n_words FROM m GROUP BY doc_id, key
""")
def glossed_terms(spark, sf_dir) -> DataFrame:
    t = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" of "), "p_name").alias("text"))
    terms = spark.range(1).select(F.explode(F.array(F.struct(F.lit("rw").alias("key"), F.lit("Red Widget").alias("term")), F.struct(F.lit("r").alias("key"), F.lit("red").alias("term")))).alias("t")).select("t.*")
    return spans.glossed(t, terms, "doc_id", "text")


@query("""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:-[\\p{L}\\p{N}]+)*') AS w FROM documents),
k(key, n, t) AS (VALUES ('ot', 2, ['of', 'the']), ('ta', 2, ['the', 'and']), ('an', 2, ['and', 'of']), ('tao', 3, ['the', 'and', 'of']), ('to', 2, ['the', 'of']), ('i', 1, ['in']), ('it', 2, ['in', 'the']), ('al', 4, ['apache', 'license', 'version', '2']), ('li', 1, ['license'])),
h AS (SELECT doc_id, i - 1 AS pos, key, n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), k WHERE w[i] = t[1] AND w[i:i + n - 1] = t),
best AS (SELECT doc_id, pos, max(n) AS n FROM h GROUP BY ALL),
g AS (SELECT doc_id, min(pos) AS pos FROM best GROUP BY doc_id UNION ALL
  SELECT doc_id, next FROM (SELECT g.doc_id, min(b.pos) AS next FROM g JOIN best own ON own.doc_id = g.doc_id AND own.pos = g.pos JOIN best b ON b.doc_id = g.doc_id AND b.pos >= own.pos + own.n GROUP BY g.doc_id, g.pos))
SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, key, CAST(min(h.n) AS INTEGER) AS n_words FROM g JOIN best USING (doc_id, pos) JOIN h USING (doc_id, pos) WHERE h.n = best.n GROUP BY doc_id, key
""")
def glossed_overlapping(spark, sf_dir) -> DataFrame:
    """Terms that overlap and contain each other, in all texts."""
    terms = [("ot", "of the"), ("ta", "The and"), ("an", "and of"), ("tao", "the and of"), ("to", "the of"), ("i", "in"), ("it", "in the"), ("al", "Apache License, Version 2"), ("li", "license")]
    return spans.glossed(A.table(spark, sf_dir, "documents"), spark.createDataFrame(terms, "key string, term string"), "doc_id", "text")


@query("""
WITH t AS (SELECT p_partkey AS id, p_size % 6 AS shape, p_size AS n FROM part),
m(shape, rule, shown, document, section) AS (VALUES
  (0, 'number', '{n}', '{n}', NULL), (0, 'number', '7', '7', NULL), (0, 'number', '90', '90', NULL),
  (1, 'section-of', '3.2', '{n}', '3.2'), (1, 'section-of', '4', '{n}', '4'), (1, 'number', 'RFC {n}', '{n}', NULL),
  (2, 'section-of', 'Section {n}.1 of [Foo-{n}]', 'Foo-{n}', '{n}.1'), (2, 'url', 'https://x.org/{n}', 'https://x.org/{n}', NULL),
  (3, 'section', 'Section {n}', NULL, '{n}'), (3, 'label', '[RFC {n}]', 'RFC {n}', NULL),
  (4, 'section', 'Section 2', NULL, '2'), (5, 'number', 'RFC-{n}', '{n}', NULL))
SELECT id, rule, replace(shown, '{n}', CAST(n AS VARCHAR)) AS text, replace(document, '{n}', CAST(n AS VARCHAR)) AS document, replace(section, '{n}', CAST(n AS VARCHAR)) AS section FROM t JOIN m USING (shape)
""")
def links_of_many_shapes(spark, sf_dir) -> DataFrame:
    """Lists, sections of other documents, labels, names that are no citation, addresses."""
    shapes = [
        "RFCs {n}, 7, and 90 say so", "see Sections 3.2 and 4 of RFC {n}.", "Section {n}.1 of [Foo-{n}] (https://x.org/{n}).", "Section {n} and [RFC {n}]",
        "RFC822.SIZE, Section 3 of RFC {n}bis and Section 2", "RFC-{n}; [a,b] none",
    ]
    p = A.table(spark, sf_dir, "part")
    shape = F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_size") % 6 + 1).cast("int"))
    texts = p.select(F.col("p_partkey").alias("id"), F.replace(shape, F.lit("{n}"), F.col("p_size").cast("string")).alias("text"))
    return spans.link_spans(texts, "id", "text").drop("start", "end")


@query("SELECT DISTINCT lower(p_type) AS key FROM part WHERE lower(p_type) NOT IN (SELECT lower(p_type) FROM part WHERE p_size = 1 AND p_type = 'SMALL')")
def missing_keys(spark, sf_dir) -> DataFrame:
    p = A.table(spark, sf_dir, "part").select(F.lower("p_type").alias("key"), "p_size", "p_type")
    return documents.missing_keys(p, p.where("p_size = 1 and p_type = 'SMALL'"))


@query("""
WITH r AS (SELECT DISTINCT l_partkey AS number, CASE l_returnflag WHEN 'R' THEN 'obsoletes' ELSE 'updates' END AS relation, l_suppkey AS draft, l_linenumber AS revision FROM lineitem)
SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY relation, draft, revision) AS INTEGER) AS ord FROM r
""")
def published_view(spark, sf_dir) -> DataFrame:
    l = A.table(spark, sf_dir, "lineitem")  # noqa: E741
    n = l.count()
    records = dealt(l, n, "l_suppkey", "l_linenumber").groupBy(F.col("l_suppkey").alias("draft"), F.col("l_linenumber").alias("revision")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("obsoletes"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))).alias("updates"))
    return documents.published(records, n)


@query("SELECT event_id AS key, ts <= TIMESTAMP '2024-01-19' AS is_due, CASE WHEN ts > TIMESTAMP '2024-01-13' THEN event_type END AS etag FROM events")
def checks_due(spark, sf_dir) -> DataFrame:
    checks = A.events(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("ts").alias("checked_at"), F.col("event_type").alias("etag"))
    return documents.due(checks, datetime(2024, 1, 20)).select("key", "is_due", "etag")


@query("SELECT event_type AS tier, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def storage_usage(spark, sf_dir) -> DataFrame:
    return documents.usage(A.events(spark, sf_dir).select(F.col("event_type").alias("tier"), F.round(F.col("value") * 100).cast("long").alias("bytes")))


@query("""
SELECT doc_id AS doc, CASE WHEN lang = 'en' THEN 'retained' WHEN quality IS NULL THEN 'gone' WHEN quality > 0 THEN 'stale' ELSE 'current' END AS state FROM documents LEFT JOIN labels USING (doc_id)
""")
def retained_documents(spark, sf_dir) -> DataFrame:
    indexed = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (F.col("lang") == "en").alias("retained"), F.lit(0).alias("written"))
    return documents.retained(indexed, A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), F.col("quality").alias("written")))


@query("""
SELECT l_orderkey AS doc, string_agg('> ' || l_partkey || CASE WHEN l_returnflag <> 'N' THEN chr(10) || chr(10) || l_returnflag ELSE '' END, chr(10) || chr(10) ORDER BY place) AS text FROM """ + _LINES + """ GROUP BY 1
""")
def exported_annotations(spark, sf_dir) -> DataFrame:
    l = _lines(spark, sf_dir)  # noqa: E741
    return documents.exported(l.select(F.col("l_orderkey").alias("doc"), F.col("place").alias("pos"), F.col("l_partkey").cast("string").alias("quote"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("note")))


@query("""SELECT '{"n":' || count(*) || ',"name":"' || p_brand || '"}' AS json FROM part GROUP BY p_brand""")
def json_report(spark, sf_dir) -> DataFrame:
    counts = A.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return documents.as_json(counts)


# --- revisions, alignment and differences -------------------------------------------------


def _pairs(spark, sf_dir) -> DataFrame:
    """A conversation's user turns (old) beside its assistant turns (new), each turn a section."""
    t = A.turns(spark, sf_dir)
    side = F.when(F.col("role") == "user", "old").otherwise("new")
    return t.select(F.col("doc").alias("pair"), side.alias("side"), F.col("revision").alias("sec"), F.col("revision").alias("pos"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@query(f"""
WITH s AS (SELECT conv_id AS pair, CASE WHEN role = 'user' THEN 'old' ELSE 'new' END AS side, turn AS sec, text AS body FROM conversations),
w AS (SELECT pair, side, sec, unnest(list_filter(list_transform(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}-]+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: len(x) > 1 AND NOT list_contains({_STOP}, x))) AS term FROM s),
tf AS (SELECT pair, side, sec, term, count(*) AS tf FROM w GROUP BY 1, 2, 3, 4), df AS (SELECT pair, term, count(*) AS df FROM tf GROUP BY 1, 2), n AS (SELECT pair, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT tf.*, tf * ln(1 + n::DOUBLE / df) AS w FROM tf JOIN df USING (pair, term) JOIN n USING (pair)), v AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY pair, side, sec)) AS u FROM x),
d AS (SELECT o.pair, o.sec AS old, n.sec AS new, sum(o.u * n.u) AS prose FROM v o JOIN v n ON o.pair = n.pair AND o.term = n.term WHERE o.side = 'old' AND n.side = 'new' GROUP BY 1, 2, 3),
k AS (SELECT *, CASE WHEN prose < 0.1 THEN 0 ELSE prose END AS score, CASE WHEN prose < 0.1 THEN 0 ELSE prose END - 1e-6 * abs(old - new) AS rank FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY pair, old ORDER BY rank DESC, new) AS a, row_number() OVER (PARTITION BY pair, new ORDER BY rank DESC, old) AS b FROM k WHERE score >= 0.1)
SELECT pair, old, new, round(score, 6) AS score FROM r WHERE a = 1 OR b = 1
""")
def align_pairs(spark, sf_dir) -> DataFrame:
    return align.aligned(align.candidates(_pairs(spark, sf_dir)), keep=0.1).withColumn("score", F.round("score", 6))


@query()
def word_diff(spark, sf_dir) -> DataFrame:
    return diff.diff_counts(diff.revisions(A.turns(spark, sf_dir)))


@query("""
WITH t AS (SELECT conv_id AS doc, turn, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT doc, turn AS revision, h <> p AS changed FROM t WHERE p IS NOT NULL
""")
def revision_changes(spark, sf_dir) -> DataFrame:
    return diff.revisions(A.turns(spark, sf_dir)).select("doc", "revision", (F.sha2("old", 256) != F.sha2("new", 256)).alias("changed"))


@query(f"""
WITH o AS (SELECT l_orderkey AS doc, place AS anchor, l_quantity AS pos, l_returnflag AS body FROM {_LINES} WHERE place <= 4),
n AS (SELECT l_orderkey AS doc, place AS anchor, l_extendedprice AS pos, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS body FROM {_LINES} WHERE place >= 3),
k AS (SELECT o.doc, o.anchor, row_number() OVER (PARTITION BY o.doc ORDER BY o.pos, o.anchor) AS r1, row_number() OVER (PARTITION BY o.doc ORDER BY n.pos, n.anchor) AS r2 FROM o JOIN n ON o.doc = n.doc AND o.anchor = n.anchor)
SELECT coalesce(o.doc, n.doc) AS doc, o.anchor AS old_anchor, n.anchor AS anchor, CASE WHEN o.body IS NULL THEN 'added' WHEN n.body IS NULL THEN 'removed' WHEN o.body <> n.body THEN 'changed' ELSE 'same' END AS change, coalesce(r1 <> r2 AND r2 = 1, false) AS moved
FROM o FULL JOIN n ON o.doc = n.doc AND o.anchor = n.anchor LEFT JOIN k ON k.doc = o.doc AND k.anchor = o.anchor AND n.doc IS NOT NULL
""")
def section_changes(spark, sf_dir) -> DataFrame:
    """At most two sections are on both sides, so the longest run in order leaves out the first where they changed places."""
    l = _lines(spark, sf_dir)  # noqa: E741
    side = lambda where, pos, body: l.where(where).select(F.col("l_orderkey").alias("doc"), F.col("place").alias("anchor"), F.col(pos).alias("pos"), body.alias("body"))
    return diff.section_changes(side("place <= 4", "l_quantity", F.col("l_returnflag")), side("place >= 3", "l_extendedprice", F.when(F.col("l_linestatus") == "O", "N").otherwise("R")), rows=A.table(spark, sf_dir, "lineitem").count())


@query("""
SELECT l_partkey AS old, l_orderkey AS pair FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey) = 1
""")
def home_edges(spark, sf_dir) -> DataFrame:
    found = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("old"), F.col("l_orderkey").alias("pair"), F.col("l_extendedprice").alias("rank"))
    return align.home_edge(found).select("old", "pair")


# --- evaluation ---------------------------------------------------------------------------


@query("""
WITH p AS (SELECT doc_id, CASE WHEN contains(text, '!!') OR contains(text, '###') OR contains(text, '|') THEN 0 ELSE 1 END AS quality FROM documents SEMI JOIN labels USING (doc_id)),
b AS (SELECT l.quality AS kind, CASE WHEN p.quality = l.quality THEN 1 ELSE 0 END AS tp, CASE WHEN p.quality = l.quality THEN 0 ELSE 1 END AS fn FROM labels l JOIN p USING (doc_id)),
f AS (SELECT p.quality AS kind, count(*) AS fp FROM labels l JOIN p USING (doc_id) WHERE p.quality <> l.quality GROUP BY 1)
SELECT b.kind, CAST(sum(tp) AS BIGINT) AS tp, coalesce(any_value(f.fp), 0) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp)::DOUBLE / (sum(tp) + coalesce(any_value(f.fp), 0)), 6) AS precision, round(sum(tp)::DOUBLE / (sum(tp) + sum(fn)), 6) AS recall
FROM b LEFT JOIN f ON f.kind = b.kind GROUP BY 1
""")
def precision_recall(spark, sf_dir) -> DataFrame:
    labels = A.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("kind"))
    odd = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("###")) | F.contains("text", F.lit("|"))
    docs = A.table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    found = docs.select("doc_id", F.when(odd, 0).otherwise(1).alias("kind"))
    scores = judge.precision_recall(judge.bag_match(found, labels, ["doc_id", "kind"]), ["kind"])
    return scores.select("kind", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""
WITH f AS (SELECT lang AS kind, count(*) AS f FROM documents GROUP BY 1), e AS (SELECT lang AS kind, count(*) AS e FROM documents d JOIN labels USING (doc_id) GROUP BY 1)
SELECT coalesce(f.kind, e.kind) AS kind, least(coalesce(f, 0), coalesce(e, 0)) AS tp, coalesce(f, 0) - least(coalesce(f, 0), coalesce(e, 0)) AS fp, coalesce(e, 0) - least(coalesce(f, 0), coalesce(e, 0)) AS fn FROM f FULL JOIN e ON f.kind = e.kind
""")
def bag_match(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"))
    return judge.bag_match(d, d.join(A.table(spark, sf_dir, "labels").select("doc_id"), "doc_id"), ["kind"])


@query(r"""
WITH i AS (SELECT item_id AS query, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}._-]*')) AS w, text AS wanted FROM benchmark),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}._-]*')) AS w, text FROM documents),
q AS (SELECT query, unnest(w) AS word FROM i), h AS (SELECT doc_id, unnest(w) AS word FROM d), f AS (SELECT word, count(*) AS df FROM h GROUP BY 1),
r AS (SELECT query, word FROM q JOIN f USING (word) WHERE df <= greatest(1, (SELECT count(*) FROM d) * 0.05) QUALIFY row_number() OVER (PARTITION BY query ORDER BY df, word) <= 12),
s AS (SELECT query, doc_id, count(*) AS shared FROM r JOIN h USING (word) GROUP BY 1, 2), b AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY shared DESC, doc_id) AS rank FROM s QUALIFY rank <= 50),
k AS (SELECT query, min(rank) AS rank FROM b JOIN i USING (query) JOIN d USING (doc_id) WHERE contains(text, wanted) GROUP BY 1)
SELECT count(*) AS n, avg(coalesce(1 / rank, 0)) AS mrr, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_in_top FROM i LEFT JOIN k USING (query)
""")
def mrr_at_k(spark, sf_dir) -> DataFrame:
    """For every benchmark item: the rank, by its rare words, of the first document that holds it."""
    items = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(T.content_words(F.col("text"))).alias("w"), F.col("text").alias("wanted"))
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.content_words(F.col("text"))).alias("w"), "text")
    return judge.mean_reciprocal_rank(judge.reciprocal_ranks(items, docs, F.contains("text", F.col("wanted"))))


@query("""
WITH a AS (SELECT doc_id, quality = 1 AS was, NOT (contains(text, '!!') OR contains(text, '###') OR contains(text, '|')) AS now FROM labels JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN was THEN 'stopped' ELSE 'started' END AS change FROM a WHERE was <> now
""")
def report_regressions(spark, sf_dir) -> DataFrame:
    odd = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("###")) | F.contains("text", F.lit("|"))
    before = A.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return judge.regressions(before, A.table(spark, sf_dir, "documents").select("doc_id", (~odd).alias("ok")), "doc_id", "ok")


@query("""
WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS causes FROM events GROUP BY 1)
SELECT cause, count(*) AS n, count(*) FILTER (len(causes) = 1) AS n_only FROM (SELECT causes, unnest(causes) AS cause FROM u) GROUP BY 1
""")
def cause_counts(spark, sf_dir) -> DataFrame:
    return judge.cause_counts(A.events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("causes")), "causes")


@query("""
SELECT kind, fp, fn, fp + fn AS errors, CAST(row_number() OVER (ORDER BY fp + fn DESC, kind) AS INTEGER) AS rank FROM (
  SELECT lang AS kind, count(*) - count(l.doc_id) AS fp, count(*) FILTER (quality = 0) AS fn FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
""")
def worst_first(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind")).join(A.table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("has")), "doc_id", "left")
    scores = d.groupBy("kind").agg(F.count_if(F.col("has").isNull()).alias("fp"), F.count_if(F.col("quality") == 0).alias("fn"))
    return judge.worst_first(scores, "kind").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("errors"), "kind")))


@query("""
WITH w AS (SELECT doc_id AS id, lang, list_sort(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}._-]*')) AS w FROM documents),
g AS (SELECT id, array_to_string(w, ' ')[1:120] AS near, CASE WHEN lang <> 'en' THEN 'language' WHEN len(w) < 8 THEN 'short' END AS dropped FROM w)
SELECT id, CASE WHEN dropped IS NULL AND row_number() OVER (PARTITION BY near, dropped IS NULL ORDER BY id) > 1 THEN 'repeated' ELSE dropped END AS dropped FROM g
""")
def judgment_set(spark, sf_dir) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return judge.judgment_set(d, "text", {"language": F.col("lang") != "en"}).select("id", "dropped")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':11'), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir) -> DataFrame:
    return judge.seeded_sample(A.table(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id")


# --- ranges -------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT p_partkey AS band, p_retailprice * 40 AS lo, p_retailprice * 40 + 3 AS hi FROM part)
SELECT l_orderkey AS number, l_linenumber AS place, band FROM lineitem JOIN r ON l_extendedprice BETWEEN lo AND hi
""")
def range_lookup(spark, sf_dir) -> DataFrame:
    bands = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("band"), (F.col("p_retailprice") * 40).alias("lo"), (F.col("p_retailprice") * 40 + 3).alias("hi"))
    values = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_linenumber").alias("place"), "l_extendedprice")
    return ranges.in_range(values, bands, "l_extendedprice", "lo", "hi", 50.0).select("number", "place", "band")


@query("""
WITH a AS (SELECT user_id, ts, event_id AS anchor FROM events WHERE event_type = 'signup'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT e.event_id, a.anchor AS last_anchor FROM e ASOF LEFT JOIN a ON e.user_id = a.user_id AND e.ts >= a.ts
""")
def asof_anchor(spark, sf_dir) -> DataFrame:
    e = A.events(spark, sf_dir)
    anchors = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("anchor"))
    return ranges.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), anchors, ["user_id"], "ts", "anchor").select("event_id", "last_anchor")


@query("""
WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 3600 + CAST(floor(value * 600) AS BIGINT) AS hi FROM events),
f AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY user_id, run
""")
def interval_merge(spark, sf_dir) -> DataFrame:
    at = F.unix_seconds("ts")
    spans = A.events(spark, sf_dir).select("user_id", at.alias("lo"), (at + 3600 + F.floor(F.col("value") * 600)).alias("hi"))
    return ranges.merged(spans, ["user_id"], "lo", "hi")


@query("""
WITH r AS (SELECT p_name AS name, p_partkey * 10 AS lo, p_partkey * 10 + p_size AS hi FROM part), t AS (SELECT DISTINCT CAST(floor(o_totalprice / 10) AS BIGINT) AS code FROM orders)
SELECT CAST(code AS VARCHAR) AS term, name, lo FROM t JOIN r ON code BETWEEN lo AND hi
""")
def registry_terms(spark, sf_dir) -> DataFrame:
    entries = A.parts(spark, sf_dir).select(F.col("title").alias("name"), (F.col("number") * 10).alias("lo"), (F.col("number") * 10 + F.col("page_count")).alias("hi"), F.lit(False).alias("is_hex"))
    terms = A.table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 10).cast("string").alias("term")).distinct()
    return ranges.registry_lookup(terms, entries).select("term", "name", "lo")


# --- what lies in what --------------------------------------------------------------------


def _part_xml(spark, sf_dir) -> DataFrame:
    """A document of nested sections for each part: as deep as its size says, up to 12, then one beside the first."""
    p = A.table(spark, sf_dir, "part")
    depth = (F.col("p_size") % 12 + 1).cast("int")
    own = lambda i: F.concat(F.lit('<section anchor="s'), i, F.lit('"><name>'), F.col("p_name"), F.lit(" &amp;\n  "), i, F.lit("</name><!-- <t>none</t> --><t>See <xref target=\"s"), i + 1, F.lit("\"/> of "), F.col("p_type"), F.lit(".</t>"))
    shape = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<artwork><![CDATA[ <a>"), F.col("p_brand"), F.lit(" ]]></artwork>"))).when(F.col("p_size") % 3 == 1, F.lit("<ul><li>x<ul><li>y</li></ul> z</li></ul>")).otherwise(F.concat(F.lit("<table><tr><th>k</th><th>v</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td><eref target='u'>w</eref></td></tr></table>")))
    nested = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), depth), own), ""), shape, F.repeat(F.lit("</section>"), depth))
    xml = F.concat(F.lit('<?xml version="1.0"?><rfc><middle>'), nested, F.lit("<section title='last  one' anchor=\"z\"><t/></section></middle></rfc>"))
    return p.select(F.col("p_partkey").alias("id"), xml.alias("xml"))


@query("""
WITH p AS (SELECT *, p_size % 12 + 1 AS k FROM part)
SELECT p_partkey AS id, 's' || i AS anchor, CAST(i AS INTEGER) AS depth, CASE WHEN i > 1 THEN 's' || (i - 1) END AS parent, p_name || ' & ' || i AS title FROM p, unnest(range(1, k + 1)) AS u(i)
UNION ALL SELECT p_partkey, 'z', 1, NULL, 'last one' FROM p
""")
def xml_sections_any_depth(spark, sf_dir) -> DataFrame:
    found = nesting.sections(nesting.nodes(_part_xml(spark, sf_dir), "id", "xml"), "id")
    up = found.select("id", F.col("pos").alias("parent"), F.col("anchor").alias("p_anchor"))
    return found.join(up.hint("merge"), ["id", "parent"], "left").select("id", "anchor", "depth", F.col("p_anchor").alias("parent"), "title")


@query("""
WITH p AS (SELECT *, p_size % 12 + 1 AS k, p_size % 3 AS shape FROM part)
SELECT p_partkey AS id, 's' || i AS section, 'name' AS tag, p_name || ' & ' || i AS text, NULL AS target FROM p, unnest(range(1, k + 1)) AS u(i)
UNION ALL SELECT p_partkey, 's' || i, 't', 'See of ' || p_type || '.', 's' || (i + 1) FROM p, unnest(range(1, k + 1)) AS u(i)
UNION ALL SELECT p_partkey, 's' || k, 'artwork', ' <a>' || p_brand || ' ', NULL FROM p WHERE shape = 0
UNION ALL SELECT p_partkey, 's' || k, 'li', x, NULL FROM p, (VALUES ('x z'), ('y')) AS v(x) WHERE shape = 1
UNION ALL SELECT p_partkey, 's' || k, tag, coalesce(x, p_brand), target FROM p, (VALUES ('th', 'k', NULL), ('th', 'v', NULL), ('td', NULL, NULL), ('td', 'w', 'u')) AS v(tag, x, target) WHERE shape = 2
UNION ALL SELECT p_partkey, 'z', 't', '', NULL FROM p
""")
def xml_blocks_and_references(spark, sf_dir) -> DataFrame:
    """Blocks with the text of their inlines, and what these point to."""
    found = nesting.nodes(_part_xml(spark, sf_dir), "id", "xml")
    anchors = found.where("tag = 'section'").select("id", F.col("pos").alias("section"), F.col("attributes")["anchor"].alias("anchor"))
    to = nesting.pointers(found, "id").select("id", F.col("block").alias("pos"), "target")
    return nesting.blocks(found, "id").join(to.hint("merge"), ["id", "pos"], "left").join(anchors.hint("merge"), ["id", "section"]).select("id", F.col("anchor").alias("section"), "tag", "text", "target")


def _glossary_xml(spark, sf_dir) -> DataFrame:
    """A document for each part: titles of six kinds, lists in lists and in items, an index entry."""
    p = A.table(spark, sf_dir, "part")
    titles = F.array(*map(F.lit, ("Terminology", "Definitions", "Symbols, Abbreviations, and Definitions", "Field Definitions", "Conventions and Acronyms", "Overview")))
    core = F.when(F.col("p_partkey") % 2 == 0, "Core Terms").otherwise("Details")
    opening = F.concat(F.lit('<rfc><section anchor="a"><name>'), F.get(titles, (F.col("p_size") % 6).cast("int")), F.lit("</name><dl><dt>"), F.col("p_brand"), F.lit(", "), F.concat(F.lit("Maker "), F.col("p_size").cast("string")), F.lit(":</dt><dd>first of "), F.col("p_name"), F.lit("<dl><dt>inner</dt><dd>part</dd></dl></dd><dt>void</dt><dd/></dl>"))
    nested = F.concat(F.lit('<section anchor="b"><name>'), core, F.lit("</name><ul><li><dl><dt>"), F.col("p_type"), F.lit("</dt><dd><t>"), F.col("p_name"), F.lit(" one</t><t>two</t></dd><dt>"), F.col("p_brand"), F.lit("</dt><dd>second</dd></dl></li></ul></section></section>"))
    last = F.concat(F.lit('<section anchor="c"><name>Body</name><dl><dt>x</dt><dd>y</dd></dl><t>The '), F.col("p_name"), F.lit(' is.<iref primary="true" item="'), F.col("p_name"), F.lit('"/><iref item="other"/></t></section></rfc>'))
    return p.select(F.col("p_partkey").alias("id"), F.concat(opening, nested, last).alias("xml"))


@query("""
WITH p AS (SELECT p_partkey AS id, *, p_size % 6 IN (0, 1, 2, 4) AS named, p_size % 6 IN (0, 2, 4) OR p_partkey % 2 = 0 AS core FROM part),
d AS (SELECT id, p_brand AS term, 'a' AS anchor, 'first of ' || p_name AS meaning, 1 AS nth FROM p WHERE named UNION ALL SELECT id, 'Maker ' || p_size, 'a', 'first of ' || p_name, 1 FROM p WHERE named
  UNION ALL SELECT id, p_type, 'b', p_name || ' one', 2 FROM p WHERE core UNION ALL SELECT id, p_brand, 'b', 'second', 2 FROM p WHERE core UNION ALL SELECT id, p_name, 'c', 'The ' || p_name || ' is.', 0 FROM p)
SELECT id, term, anchor, meaning FROM d QUALIFY row_number() OVER (PARTITION BY id, term ORDER BY nth) = 1
""")
def defined_terms(spark, sf_dir) -> DataFrame:
    return terms.defined_terms(nesting.nodes(_glossary_xml(spark, sf_dir), "id", "xml"), "id")


def _paged_lines(spark, sf_dir) -> DataFrame:
    """Plain text in pages of several shapes, one for each part: contents, numbered, plain and centred headings, page furniture."""
    p = A.table(spark, sf_dir, "part")
    n, shape = F.col("p_size").cast("string"), F.col("p_size") % 3
    head = F.concat(F.lit("1.  Opening ........ 2\n2.  Middle ........ "), n, F.lit("\n\n1.  Opening\n\n   The "), F.col("p_name"), F.lit(" goes"))
    foot = lambda k: F.concat(F.lit("\n\nDoe                                  [Page "), F.lit(k), F.lit("]\n\f\nRFC "), n, F.lit("                     Title\n\n"))
    goes_on = F.when(shape == 0, "   on and on.\n").when(shape == 1, "   Or stops.\n").otherwise("   (And so.)\n")
    title = F.when(shape == 0, "1.1.  Below").when(shape == 1, "Acknowledgements").otherwise(F.concat(F.lit(" " * 31), F.lit("APPENDICES")))
    text = F.concat(head, foot("1"), goes_on, F.lit("\n"), title, F.lit("\n\n   More text.\n   More text.\n   More text."), foot("2"), F.lit("2.1.1.  Deep\n\n   The end.\n   It is."))
    return p.select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


@query("""
WITH p AS (SELECT p_partkey AS doc_id, p_size AS n, p_name, p_size % 3 AS shape FROM part),
t AS (SELECT doc_id, ['1.  Opening ........ 2', '2.  Middle ........ ' || n, '', '1.  Opening', '', '   The ' || p_name || ' goes'] || CASE shape WHEN 0 THEN ['   on and on.'] WHEN 1 THEN ['', '   Or stops.'] ELSE ['', '   (And so.)'] END
  || ['', CASE shape WHEN 0 THEN '1.1.  Below' WHEN 1 THEN 'Acknowledgements' ELSE repeat(' ', 31) || 'APPENDICES' END, '', '   More text.', '   More text.', '   More text.', '', '2.1.1.  Deep', '', '   The end.', '   It is.'] AS l FROM p)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS line FROM t, unnest(range(1, len(l) + 1)) AS u(i)
""")
def text_without_pages(spark, sf_dir) -> DataFrame:
    return nesting.depaginated(_paged_lines(spark, sf_dir))


@query("""
SELECT p_partkey AS doc_id, number, title, CAST(depth AS INTEGER) AS depth, parent FROM part, (VALUES
  (0, '1', 'Opening', 1, NULL), (0, '1.1', 'Below', 2, 'Opening'), (0, '2.1.1', 'Deep', 3, 'Below'), (1, '1', 'Opening', 1, NULL), (1, NULL, 'Acknowledgements', 1, NULL), (1, '2.1.1', 'Deep', 3, 'Acknowledgements'),
  (2, '1', 'Opening', 1, NULL), (2, NULL, 'APPENDICES', 1, NULL), (2, '2.1.1', 'Deep', 3, 'APPENDICES')) AS h(shape, number, title, depth, parent) WHERE p_size % 3 = shape
""")
def nested_headings(spark, sf_dir) -> DataFrame:
    """Headings of the text without its pages, each below the last one that is less deep."""
    found = cut(nesting.headings(nesting.depaginated(_paged_lines(spark, sf_dir))))
    up = found.select("doc_id", F.col("pos").alias("parent"), F.col("title").alias("p_title"))
    return found.join(up.hint("merge"), ["doc_id", "parent"], "left").select("doc_id", "number", "title", "depth", F.col("p_title").alias("parent"))


@query("""
WITH q AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'Std  ' || p_partkey % 400 WHEN 1 THEN 'std small ' || p_partkey % 400 WHEN 2 THEN '0x' || lower(to_hex(p_partkey % 400)) WHEN 3 THEN 'std ' || p_name ELSE p_name END AS query FROM part),
n AS (SELECT query, regexp_replace(lower(query), '\\s+', ' ', 'g') AS t FROM q), k(words, registry) AS (VALUES ('std', 'STANDARD'), ('std', 'MEDIUM'), ('std small', 'SMALL')),
w AS (SELECT query, t, max(len(words)) AS m FROM n, k WHERE starts_with(t, words || ' ') GROUP BY 1, 2),
r AS (SELECT query, substr(t, m + 2) AS rest, registry AS sole FROM w JOIN k ON len(words) = m AND starts_with(t, words || ' ') UNION ALL SELECT query, t, NULL FROM n WHERE query NOT IN (SELECT query FROM w)),
e AS (SELECT p_type AS registry, CASE WHEN p_size % 2 = 0 THEN '0x' || lower(to_hex(p_partkey)) || '-0x' || lower(to_hex(p_partkey + p_size)) ELSE CAST(p_partkey AS VARCHAR) END AS value, p_name AS name, p_partkey AS lo, CASE WHEN p_size % 2 = 0 THEN p_partkey + p_size ELSE p_partkey END AS hi, p_size % 2 = 0 AS hex FROM part)
SELECT DISTINCT query, registry, value, name FROM r JOIN e ON (sole IS NULL OR sole = registry) AND (rest = lower(name) OR rest = value OR (NOT hex AND rest NOT LIKE '0x%' AND try_cast(rest AS BIGINT) = lo) OR (hex AND rest LIKE '0x%' AND try_cast(rest AS BIGINT) BETWEEN lo AND hi))
""")
def registry_longest_qualifier(spark, sf_dir) -> DataFrame:
    """Entries by name, value, number or range, in the registries that the longest qualifier names."""
    p = A.table(spark, sf_dir, "part")
    key, low = F.col("p_partkey"), lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    shape, small = F.col("p_size") % 5, (F.col("p_partkey") % 400)
    asked = F.when(shape == 0, F.concat(F.lit("Std  "), small)).when(shape == 1, F.concat(F.lit("std small "), small)).when(shape == 2, low(small)).when(shape == 3, F.concat(F.lit("std "), "p_name")).otherwise(F.col("p_name"))
    value = F.when(F.col("p_size") % 2 == 0, F.concat(low(key), F.lit("-"), low(key + F.col("p_size")))).otherwise(key.cast("string"))
    qualifiers = spark.createDataFrame([("std", "STANDARD"), ("std", "MEDIUM"), ("std small", "SMALL")], "words string, registry string")
    return ranges.registry_matches(p.select(asked.alias("query")), p.select(F.col("p_type").alias("registry"), value.alias("value"), F.col("p_name").alias("name")), qualifiers)


@query("""
WITH RECURSIVE e AS (SELECT o_custkey % 50 AS doc, 'a' || o_orderkey % 7 AS a, 'b' || o_custkey % 11 AS b, max(o_totalprice) AS rank FROM orders GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank DESC, a, b) AS n FROM e),
g AS (SELECT DISTINCT doc, 0::BIGINT AS n, []::VARCHAR[] AS used, []::VARCHAR[] AS taken FROM e UNION ALL
  SELECT g.doc, o.n, CASE WHEN list_has_any(used, [a, b]) THEN used ELSE used || [a, b] END, CASE WHEN list_has_any(used, [a, b]) THEN taken ELSE taken || [a || '|' || b] END FROM g JOIN o ON o.doc = g.doc AND o.n = g.n + 1),
l AS (SELECT doc, unnest(taken) AS t FROM g QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) = 1)
SELECT doc, split_part(t, '|', 1) AS a, split_part(t, '|', 2) AS b FROM l
""")
def pairs_best_first(spark, sf_dir) -> DataFrame:
    """A one to one choice of scored pairs, the best first, in each of many groups."""
    o = A.table(spark, sf_dir, "orders")
    pairs = o.select((F.col("o_custkey") % 50).alias("doc"), F.concat(F.lit("a"), F.col("o_orderkey") % 7).alias("a"), F.concat(F.lit("b"), F.col("o_custkey") % 11).alias("b"), F.col("o_totalprice").alias("rank"))
    return diff.best_first(pairs)


@query("""
WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth, value FROM events),
w AS (SELECT user_id AS key, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1)
SELECT key, n, 0 AS wrong FROM w
""")
def table_function_longest_run(spark, sf_dir) -> DataFrame:
    """A table function over a partitioned, ordered table argument, called from SQL: every kept value is above the kept one before it."""
    tables.register(spark)
    A.table(spark, sf_dir, "events").select("user_id", F.floor(F.col("value")).alias("value"), "ts", "event_id").createOrReplaceTempView("folio_events")
    found = spark.sql("SELECT * FROM longest_run(TABLE(SELECT user_id, value, ts, event_id FROM folio_events) PARTITION BY user_id ORDER BY (ts, event_id))")
    e = A.table(spark, sf_dir, "events").withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).select(F.col("user_id").alias("key"), "nth", F.floor("value").alias("value"))
    met = found.join(e, ["key", "nth"])
    before = F.last(F.when(F.col("kept"), F.col("value")), ignorenulls=True).over(Window.partitionBy("key").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    wrong = F.count_if(F.col("kept") & (F.col("before") >= F.col("value"))).cast("int")
    return met.withColumn("before", before).groupBy("key").agg(F.count(F.lit(1)).alias("n"), wrong.alias("wrong"))


# --- incremental --------------------------------------------------------------------------


@query("""
WITH o AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1), n AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1)
SELECT n.user_id, 'kinds' AS kind, unnest(list_filter(n.kinds, lambda x: NOT list_contains(o.kinds, x))) AS item FROM n JOIN o ON o.user_id = n.user_id
""")
def baseline_events(spark, sf_dir) -> DataFrame:
    e = A.events(spark, sf_dir)
    kinds = lambda df: df.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return incremental.baseline_events(kinds(e.where("ts < timestamp'2024-01-02'")), kinds(e), "user_id", ["kinds"])


@query("""
WITH l AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, max(event_id) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-28' GROUP BY 1), p AS (SELECT user_id, max(event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT l.user_id, coalesce(r.v, p.v) AS reading, CASE WHEN r.v IS NOT NULL THEN 'read' WHEN p.v IS NOT NULL THEN 'carried' ELSE 'none' END AS origin FROM l LEFT JOIN r ON r.user_id = l.user_id LEFT JOIN p ON p.user_id = l.user_id
""")
def scan_carry_over(spark, sf_dir) -> DataFrame:
    e = A.events(spark, sf_dir)
    last = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("reading"))
    return incremental.carried(e.select("user_id").distinct(), last(e.where("ts >= timestamp'2024-01-28'")), last(e.where("ts < timestamp'2024-01-10'")), "user_id", "reading")


@query("""
WITH h AS (SELECT doc_id, quality AS v FROM labels), w AS (SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS v FROM documents WHERE lang = 'en')
SELECT coalesce(h.doc_id, w.doc_id) AS doc_id, CASE WHEN h.doc_id IS NULL THEN 'add' WHEN w.doc_id IS NULL THEN 'remove' WHEN h.v IS NOT DISTINCT FROM w.v THEN 'keep' ELSE 'replace' END AS action FROM h FULL JOIN w ON h.doc_id = w.doc_id
""")
def plan_diff(spark, sf_dir) -> DataFrame:
    held = A.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("version"))
    wanted = A.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("version"))
    return incremental.plan(held, wanted, "doc_id", "version")


@query("SELECT user_id, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def streaming_latest_per_key(spark, sf_dir) -> DataFrame:
    """The same as a batch would say, by a stream over the events' files."""
    stream = latest.read_events(spark, f"{sf_dir}/events.parquet")
    return latest.run_to_table(latest.latest_per_key(stream, ["user_id"]), "latest").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streaming_daily_counts(spark, sf_dir) -> DataFrame:
    stream = latest.read_events(spark, f"{sf_dir}/events.parquet")
    out = latest.run_to_table(latest.windowed(stream, "1 day", "1 day", ["event_type"]), "daily")
    return out.withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, run
""")
def streaming_sessions(spark, sf_dir) -> DataFrame:
    stream = latest.read_events(spark, f"{sf_dir}/events.parquet")
    out = latest.run_to_table(latest.sessions(stream, "6 hours", "1 day", "user_id"), "sessions")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, ts, value FROM events")
def streaming_batches_once(spark, sf_dir) -> DataFrame:
    """Events kept by batches, each of which comes twice, as after a failure: no row is there twice."""
    root = f"{shared(spark)}/folio-once-{uuid.uuid4().hex}"
    keep = latest.batches(root)

    def twice(batch, n):
        keep(batch, n)
        keep(batch, n)

    stream = latest.read_events(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(twice).trigger(availableNow=True).start().awaitTermination()
    return latest.kept(spark, root, stream.schema).drop("batch")


@query("SELECT event_id, user_id, event_type, value FROM events")
def streaming_upserts(spark, sf_dir) -> DataFrame:
    """Events kept by batches as a table by event."""
    stream = latest.read_events(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return latest.run_upserts(stream, "event_id")


@query("""
WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS path, lang FROM documents)
SELECT path, CASE WHEN lang = 'fr' THEN 'missing' ELSE 'size' END AS failure FROM m WHERE lang IN ('fr', 'de') UNION ALL SELECT 'item-' || item_id, 'extra' FROM benchmark
""")
def manifest_failures(spark, sf_dir) -> DataFrame:
    """Files held against their manifest: French ones are gone, German ones have grown, benchmark items are extra."""
    d = A.table(spark, sf_dir, "documents")
    extra = A.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("path"), "text")
    there = d.where("lang != 'fr'").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text")).unionByName(extra)
    return incremental.verified(sinks.manifest(d, "doc_id", "text"), sinks.manifest(there, "path", "text"))


# --- extension over the embeddings table --------------------------------------------------


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 20
""")
def vector_rerank(spark, sf_dir) -> DataFrame:
    v = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = v.where("vec_id = 0").select(F.col("e").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot("e", "q") / F.sqrt(dot("e", "e") * dot("q", "q"))
    # the query is one row
    return v.join(F.broadcast(q)).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20).withColumn("score", F.round("score", 6))
