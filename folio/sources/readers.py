"""Sources: XML catalogues, feeds, JSON files and registries as DataFrames, by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IDS = T.StructType([T.StructField("doc-id", T.ArrayType(T.StringType()))])
CATALOGUE = T.StructType(
    [
        T.StructField("doc-id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("title", T.StringType())]))),
        T.StructField("date", T.StructType([T.StructField("month", T.StringType()), T.StructField("day", T.IntegerType()), T.StructField("year", T.IntegerType())])),
        T.StructField("format", T.StructType([T.StructField("file-format", T.ArrayType(T.StringType()))])),
        T.StructField("page-count", T.IntegerType()),
        T.StructField("keywords", T.StructType([T.StructField("kw", T.ArrayType(T.StringType()))])),
        T.StructField("abstract", T.StructType([T.StructField("p", T.ArrayType(T.StringType()))])),
        T.StructField("is-also", _IDS),
        T.StructField("obsoletes", _IDS),
        T.StructField("obsoleted-by", _IDS),
        T.StructField("updates", _IDS),
        T.StructField("updated-by", _IDS),
        T.StructField("current-status", T.StringType()),
        T.StructField("publication-status", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("wg_acronym", T.StringType()),
        T.StructField("errata-url", T.StringType()),
        T.StructField("doi", T.StringType()),
    ]
)

#: The statuses and streams that a catalogue knows.
STATUSES = ("INTERNET STANDARD", "DRAFT STANDARD", "PROPOSED STANDARD", "BEST CURRENT PRACTICE", "INFORMATIONAL", "EXPERIMENTAL", "HISTORIC", "UNKNOWN")
STREAMS = ("IETF", "IAB", "IRTF", "INDEPENDENT", "Editorial", "Legacy")
MONTHS = "january february march april may june july august september october november december".split()


def month_number(name):
    """1 to 12 of a number or of a name of at least three letters, either of which starts the other."""
    low = F.lower(F.trim(name))
    out = F.when(low.rlike(r"^(0?[1-9]|1[0-2])$"), low.try_cast("int"))
    for i, month in enumerate(MONTHS, 1):
        out = out.when((F.length(low) >= 3) & (F.startswith(F.lit(month), low) | low.startswith(month)), i)
    return out


def catalogue(spark: SparkSession, path: str, row_tag: str = "rfc-entry") -> DataFrame:
    """The documents of a catalogue in XML; rows without id or year go, unknown statuses become UNKNOWN, streams Legacy."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(CATALOGUE).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    ids = lambda c: F.coalesce(F.col(f"`{c}`.`doc-id`"), F.array().cast("array<string>"))
    status = lambda c: F.when(F.col(f"`{c}`").isin(list(STATUSES)), F.col(f"`{c}`")).otherwise("UNKNOWN")
    out = raw.select(
        F.regexp_extract("doc-id", r"^([A-Z]+)", 1).alias("series"),
        F.regexp_extract("doc-id", r"0*(\d+)$", 1).try_cast("int").alias("number"),
        squeeze(F.col("title")).alias("title"),
        F.coalesce(F.transform("author", lambda a: F.struct(a["name"].alias("name"), a["title"].alias("role"))), F.array().cast("array<struct<name:string,role:string>>")).alias("authors"),
        F.struct(F.col("date.year").alias("year"), month_number(F.col("date.month")).alias("month"), F.col("date.day").alias("day")).alias("date"),
        F.coalesce(F.col("format.file-format"), F.array().cast("array<string>")).alias("formats"),
        F.col("page-count").alias("page_count"),
        F.coalesce(F.col("keywords.kw"), F.array().cast("array<string>")).alias("keywords"),
        F.array_join(F.transform("abstract.p", squeeze), "\n\n").alias("abstract"),
        ids("is-also").alias("is_also"), ids("obsoletes").alias("obsoletes"), ids("obsoleted-by").alias("obsoleted_by"), ids("updates").alias("updates"), ids("updated-by").alias("updated_by"),
        status("current-status").alias("current_status"),
        status("publication-status").alias("publication_status"),
        F.when(F.col("stream").isin(list(STREAMS)), F.col("stream")).otherwise("Legacy").alias("stream"),
        F.col("wg_acronym").alias("working_group"),
        F.col("errata-url").alias("errata_url"),
        "doi",
    )
    return out.where("number is not null and date.year is not null").withColumn("is_obsolete", F.size("obsoleted_by") > 0)


def series(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """(id, members): a series' entries (``bcp-entry``, ``std-entry``, ``fyi-entry``) in order."""
    schema = T.StructType([T.StructField("doc-id", T.StringType()), T.StructField("is-also", _IDS)])
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return raw.select(F.col("doc-id").alias("id"), F.coalesce(F.col("`is-also`.`doc-id`"), F.array().cast("array<string>")).alias("members"))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """(number, title, link, published, description) of a feed's items titled ``RFC n: title``; others go."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "pubDate", "description")])
    raw = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    pattern = r"^\s*RFC\s*(\d+)\s*:\s*(.*?)\s*$"
    # the day's name says nothing that the date doesn't
    when = F.regexp_replace(F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT|Z)\s*$", " +0000")
    return raw.select(
        F.regexp_extract("title", pattern, 1).try_cast("int").alias("number"), F.regexp_extract("title", pattern, 2).alias("title"), "link", F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"), "description"
    ).where("number is not null")


ERRATUM = "errata_id string, `doc-id` string, errata_status_code string, errata_type_code string, section string, orig_text string, correct_text string, notes string, submit_date string"


def errata(spark: SparkSession, path: str) -> DataFrame:
    """Errata of a JSON array; entries without id or document go."""
    raw = spark.read.schema(ERRATUM).option("multiLine", True).json(path)
    rows = raw.where("errata_id is not null and `doc-id` is not null")
    return rows.select("errata_id", F.regexp_extract("doc-id", r"0*(\d+)$", 1).try_cast("int").alias("number"), F.col("errata_status_code").alias("status"), F.col("errata_type_code").alias("type"), "section", "orig_text", "correct_text", "notes", F.try_to_date("submit_date").alias("submitted"))


def errata_lists(rows: DataFrame) -> DataFrame:
    """(number, errata): those of each document by (submitted, id)."""
    item = F.struct("submitted", "errata_id", "status", "type", "section")
    return rows.groupBy("number").agg(F.array_sort(F.collect_list(item)).alias("errata"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(value, name, lo, hi, is_hex) of a registry's records, without unassigned and reserved ones."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("value", "name", "description")])
    raw = spark.read.format("xml").option("rowTag", "record").schema(schema).load(path)
    name = F.coalesce("name", "description")
    low, high = F.regexp_extract("value", r"^(0x[0-9A-Fa-f]+|\d+)", 1), F.regexp_extract("value", r"(0x[0-9A-Fa-f]+|\d+)$", 1)
    number = lambda c: F.when(F.lower(c).startswith("0x"), F.conv(F.substring(c, 3, 30), 16, 10)).otherwise(c).try_cast("long")
    return raw.where(F.col("value").isNotNull() & ~F.lower(F.coalesce(name, F.lit(""))).rlike("^(unassigned|reserved)")).select("value", name.alias("name"), number(low).alias("lo"), number(high).alias("hi"), F.lower("value").startswith("0x").alias("is_hex"))


#: What Windows-1252 has where ISO-8859-1 has controls; its five gaps stay as they are.
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "ignore")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, else as Windows-1252."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(F.decode(content, "ISO-8859-1"), _CONTROLS, _WINDOWS))


def documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(name, text, damaged): whole files in any order; bytes that aren't UTF-8 are read as Windows-1252."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    damaged = F.try_validate_utf8(F.col("content").cast("string")).isNull()
    return raw.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), decoded(F.col("content")).alias("text"), damaged.alias("damaged"))


def selected(files: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """Files that ``wanted(key)`` names; a name without a file is an error when this is called."""
    missing = [r[key] for r in wanted.join(files, key, "left_anti").limit(20).collect()]
    if missing:
        raise ValueError(f"no file for {', '.join(map(str, missing))}")
    return files.join(wanted.select(key).distinct(), key, "left_semi")


def parted(catalogue: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(with an XML source, with text alone) of ``catalogue(number, formats)``: the first ``limit`` by number of each."""
    has = F.array_contains("formats", "XML")
    both = catalogue.where(has), catalogue.where(~has)
    return both if limit is None else tuple(x.orderBy("number").limit(limit) for x in both)


SECTION = "section"
#: A section of a document in XML as Spark's XML reader gives it; nested ones are below it, to the depth asked for.


def _section(depth: int) -> T.StructType:
    text = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_anchor", T.StringType())])
    fields = [T.StructField("_anchor", T.StringType()), T.StructField("_numbered", T.StringType()), T.StructField("name", T.StringType()), T.StructField("_title", T.StringType()), T.StructField("t", T.ArrayType(text))]
    if depth:
        fields.append(T.StructField(SECTION, T.ArrayType(_section(depth - 1))))
    return T.StructType(fields)


def document_sections(spark: SparkSession, path: str, depth: int = 6) -> DataFrame:
    """(number, anchor, parent, path, pos, level, title, blocks) of the sections of documents in XML, parents first.

    ``number`` is the document's (the attribute of its root element); ``path`` the ordinals from the top, which
    order a document's sections as they stand; ``pos`` the place in that order. Sections deeper than ``depth``
    are not read. Blocks are the texts of the section's own paragraphs, white space as one space.
    """
    schema = T.StructType([T.StructField("_number", T.StringType()), T.StructField("middle", T.StructType([T.StructField(SECTION, T.ArrayType(_section(depth)))]))])
    raw = spark.read.format("xml").option("rowTag", "rfc").schema(schema).load(path)
    at = raw.select(F.col("_number").try_cast("int").alias("number"), F.posexplode(f"middle.{SECTION}").alias("i", "s"), F.lit(None).cast("string").alias("parent"))
    at = at.withColumn("path", F.array("i"))
    levels = []
    for level in range(depth + 1):
        title = F.coalesce("s.name", "s._title")
        blocks = F.filter(F.transform(F.coalesce("s.t", F.array().cast("array<struct<_VALUE:string,_anchor:string>>")), lambda t: F.trim(F.regexp_replace(t["_VALUE"], r"\s+", " "))), lambda t: t != "")
        levels.append(at.select("number", F.col("s._anchor").alias("anchor"), "parent", "path", F.lit(level + 1).alias("level"), F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"), blocks.alias("blocks")))
        if level < depth:
            at = at.select("number", F.col("s._anchor").alias("parent"), "path", F.posexplode(f"s.{SECTION}").alias("i", "s")).withColumn("path", F.concat("path", F.array("i")))
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("number").orderBy("path")) - 1)


def versioned(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """A JSON file with a ``version``; another version than asked for is an error when it is read."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.where(F.assert_true(F.col("version") == version, F.lit("unknown version")).isNull())
