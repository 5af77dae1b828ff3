"""Full-text search over sections: an inverted index as tables by segments, BM25, phrases, snippets."""

from __future__ import annotations

import math
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import cut, remove, shared

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def sections_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ord, body): runs of lines between blank ones, in order."""
    blocks = F.split(F.col(text_col), r"\n\s*\n")
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(blocks).alias("ord", "body")).where("trim(body) != ''")


#: Postings in one bucket's files, about; a bucket is a folder that a search for other terms never opens.
BUCKET_POSTINGS = 4_000_000
#: Postings that one task sorts and writes as a file, about.
FILE_POSTINGS = 1_000_000
#: Sections of one block, about: what a ranked search skips or reads.
BLOCK_SECTIONS = 128
#: Tokens that a Python worker holds at once, about; a longer section is worked on alone.
PIECE_TOKENS = 50_000
#: Bytes of a batch that goes to a Python worker, where the session leaves the default.
BATCH_BYTES = 4 << 20
#: Segments besides the first that a search puts up with.
MOST_DELTAS = 8


def _pieces(batch: pa.RecordBatch, columns: tuple[str, ...]):
    """``batch`` in runs of rows of PIECE_TOKENS tokens at most, a row at least."""
    sizes = [sum(n or 0 for n in row) for row in zip(*(pc.list_value_length(batch.column(f"__{c}")).to_pylist() for c in columns))]
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and held + size > PIECE_TOKENS:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _entries(columns: tuple[str, ...]):
    """Adds to rows of token lists: len, terms and tfs of a section, and an entry (term, col, positions, tf, total) a term and column.

    Also the piece's number as unit and, with its first row, counts (term, df, docs, tf) of its sections that aren't refused.

    A batch is worked through by pieces. A piece's tokens are numbered, and one sort of these numbers by
    section and column brings a term's places together: no token becomes an object of Python's.
    """

    def run(batches):
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 32
        for unit, batch in enumerate((piece for whole in batches for piece in _pieces(whole, columns)), first):
            n = batch.num_rows
            lists = [batch.column(f"__{c}") for c in columns]
            sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            codes, known = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
            part = np.concatenate([np.repeat(np.arange(n) * len(columns) + i, size) for i, size in enumerate(sizes)])  # section and column
            places = np.concatenate([np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) for size in sizes])
            keys = part * known + codes
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            begins = np.flatnonzero(np.diff(keys, prepend=-1))
            tf, part, term = np.diff(begins, append=len(keys)), keys[begins] // known, keys[begins] % known
            section = part // len(columns)
            every, back = np.unique(section * known + term, return_inverse=True)  # a term and section, whatever the column
            totals = np.bincount(back, tf, len(every)).astype(np.int32)
            text = words.dictionary.take
            entry = pa.StructArray.from_arrays(
                [text(pa.array(term)), pa.array(columns).take(pa.array(part % len(columns))), pa.ListArray.from_arrays(pa.array(np.append(begins, len(keys)), pa.int32()), pa.array(places[order], pa.int32())), pa.array(tf, pa.int32()), pa.array(totals[back])],
                names=["term", "col", "positions", "tf", "total"],
            )
            good = np.ones(n, bool) if "__refused" not in batch.schema.names else batch.column("__refused").is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(good[every // known])
            docs = batch.column("doc").dictionary_encode().indices.fill_null(0).to_numpy().astype(np.int64)
            in_docs = np.bincount(np.unique(docs[every[at] // known] * known + every[at] % known) % known, minlength=known)
            counted = np.flatnonzero(in_docs)
            each = lambda weights=None: pa.array(np.bincount(every[at] % known, weights, known)[counted].astype(np.int64))  # noqa: B023, E731
            counts = pa.StructArray.from_arrays([text(pa.array(counted)), each(), pa.array(in_docs[counted]), each(totals[at])], names=["term", "df", "docs", "tf"])
            of = lambda rows: pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())  # noqa: B023, E731
            owned = of(every // known)
            kept = [c for c in batch.schema.names if c.removeprefix("__") not in columns or not c.startswith("__")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(np.sum(sizes, axis=0), pa.int32()), pa.ListArray.from_arrays(owned, text(pa.array(every % known))), pa.ListArray.from_arrays(owned, pa.array(totals)), pa.ListArray.from_arrays(of(section), entry), pa.repeat(pa.scalar(unit, pa.int64()), n), pa.ListArray.from_arrays(pa.array([0] + [len(counted)] * n, pa.int32()), counts)],
                names=[*kept, "len", "terms", "tfs", "entries", "unit", "counts"],
            )

    return run


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _length_class(length: Column) -> Column:
    """Sections of like lengths: four classes to a doubling."""
    return F.floor(4 * F.log2(length + 1.0)).cast("int")


class Index:
    """A full-text index as written tables, kept by segments.

    A segment has, of its sections ``(doc, ord, ...)``: *postings* by bucket of the term, each with its
    section's length; *blocks*, the greatest count and the least length of each term among some
    BLOCK_SECTIONS sections of like length; *terms* with their frequencies; *sections* and *documents* by
    bucket of the document; and *refused*, what could not be indexed. A commit is a row a segment, written
    last, so a batch that broke off is none. A document counts where its newest segment has it; what that
    takes from the frequencies is in the newer segment's terms, so searches give the same before a merge
    and after.

    A ranked search bounds what a block can score from the blocks' rows, reads the postings of the best
    ones, and then only of blocks that could still beat the last of the best ``limit``: the same rows as
    a full scan. A search never reads a text.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.number = max(commits(spark, self.path))
        rows = sorted(spark.read.parquet(f"{self.path}/commits/{self.number}").collect(), key=lambda r: r["place"])
        self.segments = [(r["name"], r["buckets"], r["doc_buckets"]) for r in rows]
        self.n, self.tokens, self.columns = rows[0]["n"], rows[0]["tokens"], tuple(rows[0]["columns"].split())
        #: (blocks read, blocks that have every word) of the last ranked search
        self.blocks_read = (0, 0)

    # --- writing ---

    @classmethod
    def write(cls, sections: DataFrame, path: str, columns: tuple[str, ...] = ("body",)) -> Index:
        """A new index of ``sections(doc, ord, ...)``; further columns are kept as they are, ``columns`` are searched and not kept."""
        spark, path = sections.sparkSession, path.rstrip("/")
        staged, held = _staged(sections, columns)
        n, tokens, buckets = _segment(spark, f"{path}/segments/0-0", staged, None)
        remove(spark, held)
        _commit(spark, path, 0, [("0-0", *buckets)], n, tokens, columns)
        return cls(spark, path)

    def add(self, sections: DataFrame, gone: DataFrame | None = None) -> Index:
        """The documents of ``sections`` are these from now on, those of ``gone(doc)`` are no more; all others as they were.

        Writes one segment, of the size of the batch. A section without document or without any text column is
        refused and told in ``refused()``. Many segments are merged.
        """
        staged, held = _staged(sections, self.columns)
        named = staged.select("doc").where("doc is not null").distinct()
        named = cut(named if gone is None else named.unionByName(gone.select("doc").where("doc is not null")).distinct())
        old = self._superseded(named)
        lost = old.groupBy().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
        name = f"{self.number + 1}-0"
        n, tokens, buckets = _segment(self.spark, f"{self.path}/segments/{name}", staged, (named, old))
        remove(self.spark, held)
        _commit(self.spark, self.path, self.number + 1, [*self.segments, (name, *buckets)], self.n - lost["n"] + n, self.tokens - lost["tokens"] + tokens, self.columns)
        out = Index(self.spark, self.path)
        return out.merge(1) if len(out.segments) > MOST_DELTAS + 1 else out

    def merge(self, first: int = 0) -> Index:
        """Segments from ``first`` on as one; with 0, all of them, and documents that are gone leave no trace."""
        rest = self.segments[first:]
        if len(rest) < 2:
            return self
        name, folder = f"{self.number + 1}-0", f"{self.path}/segments/{self.number + 1}-0"
        live = lambda table: self._live(self._read(table, first), first)
        remove(self.spark, folder)  # left by a merge that broke off
        frequencies = self._read("terms", first).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "tf")])
        newest = self._read("documents", first).groupBy("doc").agg(F.max_by(F.struct("sections", "tokens"), "segment").alias("held")).select("doc", "held.*")
        if first == 0:
            frequencies, newest = frequencies.where("df != 0"), newest.where("sections > 0")
        buckets = _write(self.spark, folder, live("sections").drop("block", "doc_bucket"), live("postings").drop("block", "bucket"), frequencies, newest)
        self._read("refused", first).drop("segment").write.parquet(f"{folder}/refused")
        _commit(self.spark, self.path, self.number + 1, [*self.segments[:first], (name, *buckets)], self.n, self.tokens, self.columns)
        for old, _, _ in rest:
            remove(self.spark, f"{self.path}/segments/{old}")
        for n in sorted(commits(self.spark, self.path))[:-1]:
            remove(self.spark, f"{self.path}/commits/{n}")
        return Index(self.spark, self.path)

    def _superseded(self, named: DataFrame) -> DataFrame:
        """The sections that the documents of ``named`` have so far; only the folders of their buckets are read."""
        out = None
        for i, (name, _, doc_buckets) in enumerate(self.segments):
            at = [r[0] for r in named.select(_bucket(F.col("doc").cast("string"), doc_buckets)).distinct().collect()]  # at most one a bucket
            one = self.spark.read.parquet(f"{self.path}/segments/{name}/sections").where(F.col("doc_bucket").isin(at)).select("doc", "ord", "len", "terms", "tfs").withColumn("segment", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return self._live(out.join(named, "doc", "left_semi"))

    # --- reading ---

    def _read(self, table: str, first: int = 0, words: list[str] | None = None) -> DataFrame:
        out = None
        for i, (name, buckets, _) in list(enumerate(self.segments))[first:]:
            one = self.spark.read.parquet(f"{self.path}/segments/{name}/{table}")
            if words is not None:  # literals after folding: other folders aren't listed, other row groups aren't read
                one = one.where(F.col("bucket").isin(*[_bucket(F.lit(w), buckets) for w in words]) & F.col("term").isin(words))
            one = one.withColumn("segment", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out

    def _live(self, rows: DataFrame, first: int = 0) -> DataFrame:
        """``rows(doc, segment, ...)`` without those that a newer segment replaces; the documents of the newer segments are few."""
        if len(self.segments) - first < 2:
            return rows
        newer = self._read("documents", first + 1).groupBy("doc").agg(F.max("segment").alias("__newest"))
        return rows.join(newer, "doc", "left").where(F.coalesce(F.col("__newest"), F.lit(first)) <= F.col("segment")).drop("__newest")

    def postings(self) -> DataFrame:
        """(term, doc, ord, col, positions, tf, len) of all sections."""
        return self._live(self._read("postings")).select("term", "doc", "ord", "col", "positions", "tf", "len")

    def sections(self) -> DataFrame:
        """(doc, ord, len, ...) of all sections."""
        return self._live(self._read("sections")).drop("segment", "block", "doc_bucket", "terms", "tfs")

    def refused(self) -> DataFrame:
        return self._read("refused").drop("segment")

    def statistics(self) -> DataFrame:
        """(term, tf, docs): how often a term is, and in how many documents."""
        return self._read("terms").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("docs").alias("docs")).where("tf > 0")

    def _of(self, words: list[str], within: DataFrame | None = None) -> DataFrame:
        """The postings of ``words`` that count; of the documents of ``within(doc)`` if given."""
        hits = self._live(self._read("postings", words=words))
        return hits if within is None else hits.join(within.select("doc").distinct(), "doc", "left_semi")

    def matching(self, words: list[str], within: DataFrame | None = None) -> DataFrame:
        """(doc, ord, len, tf0, tf1, ...) of sections with every word; of the documents of ``within(doc)`` if given."""
        return _every(self._of(words, within), words).drop("segment", "block")

    def _frequencies(self, words: list[str]) -> dict[str, int]:
        return {r["term"]: r["df"] for r in self._read("terms", words=words).groupBy("term").agg(F.sum("df").alias("df")).collect()}

    def _weight(self, df: int) -> float:
        return max(math.log((self.n - df + 0.5) / (df + 0.5)), LEAST_IDF)

    def _scored(self, count: Column, length: Column, df: int) -> Column:
        mean = self.tokens / self.n if self.n else 1.0
        return F.lit(self._weight(df)) * count * (K1 + 1) / (count + K1 * (1 - B + B * length / F.lit(mean or 1.0)))

    def bm25(self, words: list[str], within: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """(doc, ord, score) of sections that have every word, larger scores better.

        Statistics are over all sections; a word in more than half of them has a least weight. With
        ``limit``, the best are kept, with their rank from 1; equal scores by document and place.
        """
        if limit is not None:
            return self.search([[w] for w in words], within=within, limit=limit)
        frequent = self._frequencies(words)
        score = F.lit(0.0)
        for i, w in enumerate(words):
            score = score + self._scored(F.col(f"tf{i}").cast("double"), F.col("len"), frequent.get(w, 0))
        return self.matching(words, within).select("doc", "ord", score.alias("score"))

    def phrase(self, words: list[str], within: DataFrame | None = None, column: str | None = None) -> DataFrame:
        """(doc, ord, n): sections where the words follow each other in one column, and how often."""
        return self._phrase(words, within, column).select("doc", "ord", "n")

    def _phrase(self, words: list[str], within: DataFrame | None = None, column: str | None = None) -> DataFrame:
        hits = self._of(words, within)
        if column is not None:
            hits = hits.where(F.col("col") == column)
        section = ["segment", "block", "doc", "ord", "len"]
        # one row a word and section, never one a position; a section's rows meet in one task, which sorts them by section
        each = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"w{i}") for i, w in enumerate(dict.fromkeys(words))]
        held = hits.select(*section, "col", "term", "positions").repartition(*section).groupBy(*section, "col").agg(*each)
        at = list(dict.fromkeys(words))
        shifted = lambda positions, k: F.transform(positions, lambda p: p - F.lit(k))
        # a word may stand at several places of the phrase
        starts = None
        for k, w in enumerate(words):
            own = shifted(F.col(f"w{at.index(w)}"), k)
            starts = own if starts is None else F.array_intersect(starts, own)
        return held.withColumn("m", F.size(starts)).where("m > 0").groupBy(*section).agg(F.sum("m").cast("int").alias("n"))

    def named(self, wanted: str) -> DataFrame:
        """(doc, ord) of the sections that ``wanted`` names: its heading has it as a phrase, or by anchor or number, or below those."""
        own = in_section(self.sections(), wanted).select("doc", "ord")
        words = _tokens_of(self.spark, wanted)
        if not words or re.fullmatch(r"[\d.]+", wanted) or "heading" not in self.columns:
            return own
        return own.unionByName(self.phrase(words, column="heading").select("doc", "ord")).distinct()

    def search(self, terms: list[list[str]], section: str | None = None, within: DataFrame | None = None, limit: int = 50) -> DataFrame:
        """(doc, ord, score, rank): the best ``limit`` sections that have every one of ``terms``.

        A term is a phrase, a word being one of one word; a phrase counts as often as it stands there. ``section``
        keeps what ``named`` finds, ``within(doc)`` documents. Without terms, the sections that are named,
        the newest document first. Phrases are found first; words are looked up in the blocks that may matter.
        """
        named = None if section is None else self.named(section)
        if not terms:
            if named is None:
                raise ValueError("neither terms nor a section")
            rows = named if within is None else named.join(within.select("doc").distinct(), "doc", "left_semi")
            return ranked(rows, [F.desc("doc"), F.asc("ord")], limit)
        words = list(dict.fromkeys(t[0] for t in terms if len(t) == 1))
        phrases = [cut(self._phrase(t)) for t in terms if len(t) > 1]
        frequent = self._frequencies(words)
        keys = ["segment", "block"]
        blocks, n = None, len(words)
        if words:  # what a block can score at most
            most = F.lit(0.0)
            for w in words:
                most = most + F.when(F.col("term") == w, self._scored(F.col("most").cast("double"), F.col("least"), frequent.get(w, 0))).otherwise(0.0)
            every = self._read("blocks", words=words).groupBy(*keys).agg(F.sum(most).alias("bound"), F.count(F.lit(1)).alias("m"))
            blocks = every.where(F.col("m") == n).drop("m")
        for found in phrases:
            df = found.count()
            top = found.groupBy(*keys).agg(F.max(self._scored(F.col("n").cast("double"), F.col("len"), df)).alias("more"))
            blocks = top.withColumnRenamed("more", "bound") if blocks is None else blocks.join(top, keys).withColumn("bound", F.col("bound") + F.col("more")).drop("more")
        blocks = cut(blocks.withColumn("bound", F.col("bound") * (1 + 1e-9)))  # rounding is no reason to skip
        in_all, read = blocks.count(), 0
        best, above, floor, step = None, None, None, max(8, limit // 8)
        while above is None or floor is None:
            rest = blocks if above is None else blocks.where(F.col("bound") < above)
            if read >= in_all:
                break
            below = rest.orderBy(F.desc("bound")).limit(step).agg(F.min("bound")).first()[0]
            taken = rest.where(F.col("bound") >= below)
            best, floor = self._round(taken, best, terms, words, frequent, phrases, named, within, limit)
            read += taken.count()
            above, step = below, step * 8
        if floor is not None and above is not None:  # enough rows: only blocks that could still beat the last of them
            taken = blocks.where((F.col("bound") < above) & (F.col("bound") >= floor))
            more = taken.count()
            if more:
                best, _ = self._round(taken, best, terms, words, frequent, phrases, named, within, limit)
                read += more
        self.blocks_read = (read, in_all)
        if best is None:
            best = self.spark.createDataFrame([], self._read("postings").select("doc", "ord", F.lit(0.0).alias("score")).schema)
        return ranked(best, [F.desc("score"), F.asc("doc"), F.asc("ord")], limit)

    def _round(self, blocks: DataFrame, best, terms, words, frequent, phrases, named, within, limit: int):
        """(the best rows so far with those of ``blocks``, the score of the last one if there are enough)."""
        keys, section = ["segment", "block"], ["segment", "block", "doc", "ord", "len"]
        at = blocks.select(*keys)
        found, score = None, F.lit(0.0)
        if words:
            found = _every(self._live(self._read("postings", words=words).join(at, keys, "left_semi")), words)
            for t in terms:
                if len(t) == 1:
                    i = words.index(t[0])
                    score = score + self._scored(F.col(f"tf{i}").cast("double"), F.col("len"), frequent.get(t[0], 0))
        for i, (hits) in enumerate(phrases):
            one = hits.join(at, keys, "left_semi").withColumnRenamed("n", f"n{i}")
            found = one if found is None else found.join(one, section)
            score = score + self._scored(F.col(f"n{i}").cast("double"), F.col("len"), hits.count())
        for kept, by in ((named, ["doc", "ord"]), (None if within is None else within.select("doc").distinct(), ["doc"])):
            if kept is not None:
                found = found.join(kept, by, "left_semi")
        rows = found.select("doc", "ord", score.alias("score"))
        rows = cut((rows if best is None else best.unionByName(rows)).orderBy(F.desc("score"), "doc", "ord").limit(limit))
        told = rows.agg(F.count(F.lit(1)), F.min("score")).first()
        return rows, told[1] if told[0] >= limit else None

    def listed(self, within: DataFrame, limit: int) -> DataFrame:
        """(doc, ord, rank): without words, the sections of ``within(doc)``: newest document first, each in its order."""
        return ranked(self.sections().join(within.select("doc").distinct(), "doc", "left_semi").select("doc", "ord"), [F.desc("doc"), F.asc("ord")], limit)

    def coverage(self, allowed: DataFrame) -> DataFrame:
        """One row: how many documents are allowed, and how many of them are indexed."""
        have = self._live(self._read("documents")).where("sections > 0").select("doc").withColumn("has", F.lit(True))
        return allowed.select("doc").distinct().join(have, "doc", "left").agg(F.count(F.lit(1)).alias("n_allowed"), F.count("has").alias("n_indexed"))


def _every(hits: DataFrame, words: list[str]) -> DataFrame:
    """(segment, block, doc, ord, len, tf0, ...) of the sections of ``hits`` that have every word."""
    each = [F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).cast("int").alias(f"tf{i}") for i, w in enumerate(words)]
    found = hits.groupBy("segment", "block", "doc", "ord", "len").agg(*each)
    for i in range(len(words)):
        found = found.where(F.col(f"tf{i}") > 0)
    return found


def _tokens_of(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"]


def _staged(sections: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, str]:
    """Sections with their terms, written once, and where: texts are tokenised once."""
    cores = sections.sparkSession.sparkContext.defaultParallelism
    if sections.sparkSession.conf.get(_BATCH_CONF, "64MB") == "64MB":  # the default
        sections.sparkSession.conf.set(_BATCH_CONF, BATCH_BYTES)
    if sections.rdd.getNumPartitions() < cores:  # a few large files; a table of many is worked on where it is read
        sections = sections.repartition(cores)
    kept = [c for c in sections.columns if c not in columns]
    told = sections.withColumn("__refused", F.when(F.col("doc").isNull(), "no document").when(F.coalesce(*columns).isNull(), "no text"))
    rows = told.select(*kept, "__refused", *[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias(f"__{c}") for c in columns])
    own = rows.select(*kept, "__refused").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    told = rows.mapInArrow(_entries(columns), f"{fields}, len int, terms array<string>, tfs array<int>, entries array<struct<term: string, col: string, positions: array<int>, tf: int, total: int>>, unit long, counts array<struct<term: string, df: long, docs: long, tf: long>>")
    spark, path = sections.sparkSession, f"{shared(sections.sparkSession)}/folio-staged-{uuid.uuid4().hex}"
    told.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(told.schema).parquet(path), path


def _segment(spark: SparkSession, folder: str, staged: DataFrame, before) -> tuple[int, int, tuple[int, int]]:
    """Writes a segment; (sections, tokens, (buckets, buckets of documents)).

    ``before``: (doc) of all documents that the segment decides on, and the sections they had.
    """
    remove(spark, folder)  # left by a batch that broke off
    good = staged.where("__refused is null").drop("__refused")
    staged.where("__refused is not null").select(F.col("doc").cast("string").alias("doc"), F.col("ord").cast("string").alias("ord"), F.col("__refused").alias("reason")).coalesce(1).write.parquet(f"{folder}/refused")
    total = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
    counted = staged.select(F.explode("counts").alias("e")).select("e.*")
    # documents are counted by piece; of one that several pieces have, each piece but one is too much
    several = good.groupBy("doc").agg((F.min("unit") != F.max("unit")).alias("more")).where("more").select("doc")
    twice = good.join(several, "doc", "left_semi").select("doc", "unit", F.explode("terms").alias("term")).distinct().groupBy("term", "doc").agg((1 - F.count(F.lit(1))).alias("docs"))
    counted = counted.unionByName(twice.where("docs < 0").select("term", F.lit(0).cast("long").alias("df"), "docs", F.lit(0).cast("long").alias("tf")))
    held = good.groupBy("doc").agg(F.count(F.lit(1)).alias("sections"), F.sum("len").cast("long").alias("tokens"))
    if before is not None:
        old = before[1].select("doc", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).groupBy(F.col("e.terms").alias("term"), "doc").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("e.tfs")).alias("tf"))
        counted = counted.unionByName(old.select("term", "df", F.lit(-1).cast("long").alias("docs"), "tf"))
        held = before[0].join(held, "doc", "left").select("doc", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    frequencies = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "tf")])
    postings = good.select("doc", "ord", "len", F.explode("entries").alias("e")).select("doc", "ord", "len", "e.*")
    return total["n"], total["tokens"], _write(spark, folder, good.drop("entries", "unit", "counts"), postings, frequencies, held)


def _write(spark: SparkSession, folder: str, sections: DataFrame, postings: DataFrame, frequencies: DataFrame, documents: DataFrame) -> tuple[int, int]:
    """Writes the tables of a segment; (buckets, buckets of documents), by the size of the segment."""
    sections, postings = sections.drop("segment"), postings.drop("segment")
    sized = sections.groupBy(_length_class(F.col("len"))).agg(F.count(F.lit(1)), F.sum(F.size("terms"))).collect()  # four rows to a doubling of the length
    classes, n_sections, n_postings = {r[0]: r[1] for r in sized}, sum(r[1] for r in sized), sum(r[2] for r in sized)
    buckets = max(1, -(-n_postings // BUCKET_POSTINGS), min(8, n_postings // 50_000))
    doc_buckets = max(1, -(-n_sections // 100_000), min(8, n_sections // 2_000))
    # a block: a length class, and a part of it by hash
    parts = F.create_map(*[F.lit(x) for c, n in classes.items() for x in (c, max(1, n // BLOCK_SECTIONS))]) if classes else F.create_map(F.lit(0), F.lit(1))
    own_class = _length_class(F.col("len"))
    block = (own_class.cast("long") * (1 << 32) + F.pmod(F.xxhash64(F.col("doc").cast("string"), F.col("ord")), F.element_at(parts, own_class).cast("long"))).alias("block")

    def by_term():
        frequencies.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/terms")
        # a bucket's files follow its size, a task a file, so the commonest term's bucket doesn't wait for a few tasks
        held = spark.read.parquet(f"{folder}/terms").groupBy("bucket").agg(F.sum(F.greatest("df", F.lit(1)))).collect()  # a row a bucket
        files = [1] * buckets
        for bucket, size in held:
            files[bucket] = -(-size // FILE_POSTINGS)
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
        file = of([sum(files[:i]) for i in range(buckets)]) + F.pmod(F.xxhash64("block"), of(files))
        dealt = postings.select("*", block, _bucket(F.col("term"), buckets).alias("bucket"))
        placed = dealt.repartitionById(sum(files), file.cast("int")).sortWithinPartitions("bucket", "term", "block", "doc", "ord")
        placed.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/postings")
        most = spark.read.schema(placed.schema).parquet(f"{folder}/postings").groupBy("bucket", "term", "block").agg(F.max("total").alias("most"), F.min("len").alias("least"))
        most.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/blocks")

    def by_document():
        by_doc = _bucket(F.col("doc").cast("string"), doc_buckets).alias("doc_bucket")
        spread = F.pmod(F.xxhash64("doc", "ord"), F.lit(4))
        sections.select("*", block, by_doc).repartition("doc_bucket", spread).sortWithinPartitions("doc_bucket", "doc", "ord").write.partitionBy("doc_bucket").option("compression", "zstd").parquet(f"{folder}/sections")
        documents.coalesce(max(1, doc_buckets)).write.parquet(f"{folder}/documents")

    with ThreadPoolExecutor(2) as pool:  # two jobs at a time; neither needs the other
        for done in [pool.submit(by_term), pool.submit(by_document)]:
            done.result()
    return buckets, doc_buckets


def _commit(spark: SparkSession, path: str, number: int, segments: list[tuple[str, int, int]], n: int, tokens_: int, columns: tuple[str, ...]) -> None:
    rows = [(i, *s, int(n), int(tokens_), " ".join(columns)) for i, s in enumerate(segments)]
    spark.createDataFrame(rows, "place int, name string, buckets int, doc_buckets int, n long, tokens long, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{number}")


def commits(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the commits that were finished."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [int(x.getPath().getName()) for x in files.listStatus(root) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]


def ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows by ``order``, each with its rank from 1; the rank is worked out on these alone."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def snippet(sections: DataFrame, words: list[str], column: str = "body", around: int = 16) -> DataFrame:
    """(doc, ord, snippet): ``around`` words that start near the first hit, hits between ``[`` and ``]``."""
    raw = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
    is_hit = lambda w: F.arrays_overlap(tokens(w), F.array(*map(F.lit, words)))
    s = sections.select("doc", "ord", raw.alias("w")).withColumn("first", F.array_position(F.transform("w", is_hit), True)).where("first > 0")
    start = F.greatest(F.lit(1), F.least(F.col("first") - around // 4, F.size("w") - around + 1)).cast("int")
    marked = F.transform(F.slice("w", start, around), lambda w: F.when(is_hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return s.select("doc", "ord", F.concat_ws(" ", marked).alias("snippet"))


def in_section(sections: DataFrame, wanted: str) -> DataFrame:
    """Sections that ``wanted`` names: by anchor or number, or below them, never by a longer number."""
    low = wanted.lower()
    anchor, number = F.lower("anchor"), F.lower("number")
    return sections.where((anchor == low) | anchor.startswith(low + ".") | anchor.startswith(low + "-") | (number == low) | number.startswith(low + "."))


def document_frequency(docs: DataFrame, words_of, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, df): in how many documents each word is."""
    return docs.select(id_col, F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count_distinct(id_col).alias("df"))


def common_words(df: DataFrame, n_docs: DataFrame, share: float) -> DataFrame:
    """Words in at least ceil(share of all documents), one at least. ``n_docs(n)`` is one row."""
    return df.join(F.broadcast(n_docs)).where(F.col("df") >= F.greatest(F.lit(1), F.ceil(F.col("n") * share))).select("word", "df")


def threshold_report(df: DataFrame, n_docs: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_common): for each threshold how many words are common; one pass over the words."""
    at = [F.count_if(F.col("df") >= F.greatest(F.lit(1), F.ceil(F.col("n") * s))).alias(str(i)) for i, s in enumerate(shares)]
    one = df.join(F.broadcast(n_docs)).agg(*at)
    pairs = F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"`{i}`").alias("n_common")) for i, s in enumerate(shares)])
    return one.select(F.explode(pairs).alias("r")).select("r.share", "r.n_common")
