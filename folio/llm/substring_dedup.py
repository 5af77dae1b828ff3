"""Substring deduplication with suffix automata of reference shards.

The reference is every repeated window (of 50 words) where it first stands. It is found so: a window
that two documents share also shares its least 25-word run (by hash), as the 26 runs of equal windows
are equal. Such runs that several documents have are the anchors, and an anchor's owner is the smallest
document with it. Around the anchors, passages are cut out of each document, by owner. Their windows'
hashes, summed by window before they are shuffled, say which windows truly repeat and in which
document each of them is first; the rest of the passages is not part of the reference.

Passages are cut, with an overlap of 49 words, so none is longer than ``PIECE`` windows. The reference's
passages are dealt to shards by owner. An owner with more words than a shard has several, and a window's
least 25-word run says in which of them it is, so a passage goes only where its windows can be. Each
shard's suffix automata (one, or several of bounded size) are built once, as flat arrays in a written
table, and go to all the tasks that stream the passages of its owners. Matching statistics of 50 or more
there, at places where the document isn't the first itself, are the words to remove. A shard that very
many documents meet is streamed in many tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bloom_of, bytes_of, in_slices, light, maybe_in, mixed, rolled, row_key, word_hashes

#: Words of a reference shard, and of the passages that one task streams past one.
SHARD_WORDS, STREAM_WORDS = 60_000, 400_000
#: Hits of one anchor in a task of the join by anchor; those with more are dealt over several.
ANCHOR_ROWS = 20_000
#: Windows of a passage that are streamed as one.
CHUNK = 512
#: Windows of one row of passages.
PIECE = 1 << 16


class SuffixAutomaton:
    """All runs of words of the passages added so far; a word is an integer."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def add(self, words: list[int]) -> None:
        """A passage; runs over its ends are not made."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            at, cur = last, -1
            known = nxt[last].get(word)
            if known is None:
                cur = self._state(length[last] + 1, 0, {})
                while at >= 0 and word not in nxt[at]:
                    nxt[at][word] = cur
                    at = link[at]
                if at < 0:
                    last = cur
                    continue
                known = nxt[at][word]
            if length[known] == length[at] + 1:
                target = known
            else:
                target = self._state(length[at] + 1, link[known], dict(nxt[known]))
                link[known] = target
                while at >= 0 and nxt[at].get(word) == known:
                    nxt[at][word] = target
                    at = link[at]
            if cur >= 0:
                link[cur] = target
                last = cur
            else:
                last = target

    def flat(self) -> "Flat":
        """The automaton as arrays: sorted (state, word) edges and where they lead."""
        symbols, order = np.unique(np.fromiter((w for out in self.next for w in out), np.uint64), return_inverse=True)
        sizes = np.fromiter(map(len, self.next), np.int64, len(self.next))
        edges = np.repeat(np.arange(len(self.next)), sizes) * max(1, len(symbols)) + order
        to = np.fromiter((t for out in self.next for t in out.values()), np.int32)
        by = np.argsort(edges)
        return Flat(symbols, edges[by], to[by], np.array(self.link, np.int32), np.array(self.length, np.int32))


@dataclass
class Flat:
    """A suffix automaton in five arrays."""

    symbols: np.ndarray
    edges: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray

    def matches(self, passages: list[np.ndarray], width: int) -> list[np.ndarray]:
        """For each place of each passage, whether the ``width`` words that end there are in the reference.

        All passages take a step at a time, the longest first; a word that doesn't follow is looked up
        again from the suffix link.
        """
        if not passages:
            return []
        sizes = np.fromiter(map(len, passages), np.int64, len(passages))
        words = np.concatenate(passages) if sizes.sum() else np.zeros(0, np.uint64)
        hit = np.zeros(len(words), bool)
        if len(self.edges) and len(words):
            at = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
            symbol = np.where(self.symbols[at] == words, at, -1)
            starts = np.cumsum(sizes) - sizes
            by = np.argsort(-sizes, kind="stable")
            live = np.searchsorted(-sizes[by], -np.arange(sizes.max()), "left")  # passages longer than each step
            state, size = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
            for step in range(int(sizes.max())):
                n = live[step]
                word = symbol[starts[by[:n]] + step]
                state[:n][word < 0], size[:n][word < 0] = 0, 0
                open_ = np.flatnonzero(word >= 0)
                while len(open_):
                    edge = state[open_] * len(self.symbols) + word[open_]
                    found = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                    ok = self.edges[found] == edge
                    state[open_[ok]] = self.to[found[ok]]
                    size[open_[ok]] += 1
                    open_ = open_[~ok]
                    root = state[open_] == 0
                    size[open_[root]] = 0
                    open_ = open_[~root]
                    state[open_] = self.link[state[open_]]
                    size[open_] = self.length[state[open_]]
                hit[starts[by[:n]] + step] = size[:n] >= width
        return np.split(hit, np.cumsum(sizes)[:-1])


#: Low bits of a code that give way to the place, and so the most windows that are looked at together.
_PLACE_BITS = 20


def _least(codes: np.ndarray, span: int) -> np.ndarray:
    """Places of the codes that are the least of some ``span`` consecutive ones (of equal ones the last), ascending.

    Codes count as equal by their high bits; the low ones hold the place, the last the least.
    """
    n = len(codes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mask = (1 << _PLACE_BITS) - 1
    out = []
    for start in range(0, n, mask + 1 - span):
        part = codes[start : start + mask]
        low = (part & ~np.uint64(mask)) | np.arange(mask, mask - len(part), -1, dtype=np.int64).astype(np.uint64)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        at = mask - (low & np.uint64(mask)).astype(np.int64)
        out.append(start + at[np.r_[True, at[1:] != at[:-1]]])
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def _anchors(run: int, width: int):
    """Distinct (anchor, doc_id, row, place) of every document."""

    def go(batches):
        for batch in batches:
            codes, ids, rows, places = [], [], [], []
            docs, keys = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for first, texts in in_slices(bytes_of(batch.column("text"))):
                for i, key, h in zip(docs[first:], keys[first:], word_hashes(texts)):
                    each = rolled(h, run)
                    at = _least(each, width - run + 1)
                    if len(at):
                        codes.append(each[at])
                        places.append(at)
                        ids.append(np.full(len(at), i, np.int64))
                        rows.append(np.full(len(at), key, np.int64))
            if codes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (ids, rows, places))], names=["anchor", "doc_id", "row", "place"])

    return go


def _cut(run: int, width: int):
    """Passages of each document around its anchors, joined where they touch and have one owner, in pieces."""

    def go(batches):
        for batch in batches:
            ids, keys, hits = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("hits")
            for first, texts in in_slices(bytes_of(batch.column("text"))):
                out = []
                for i, key, h, own in zip(ids[first:], keys[first:], word_hashes(texts), hits.slice(first, len(texts)).to_pylist()):
                    by: dict[int, list] = {}
                    for hit in sorted(own, key=lambda x: x["place"]):
                        a, b = max(0, hit["place"] + run - width), min(len(h), hit["place"] + width)
                        spans = by.setdefault(hit["owner"], [])
                        if spans and a <= spans[-1][1] - (width - 1):  # nothing between two spans' windows is lost or gained
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    for owner, spans in by.items():
                        for a, b in spans:
                            out += [(owner, i, key, at, h[at : min(b, at + PIECE + width - 1)].tobytes()) for at in range(a, b - width + 1, PIECE)]
                yield _rows(out, PASSAGE)

    return go


PASSAGE = "owner long, doc_id long, row long, start long, words binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


WINDOW = "owner long, code long, doc_id long"


def _windows(width: int):
    """(owner, code, doc_id) of every window of the passages."""

    def go(batches):
        for batch in batches:
            parts = [rolled(np.frombuffer(w, np.uint64), width) for w in batch.column("words").to_pylist()]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            each = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("owner", "doc_id")]
            codes = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            for at in range(0, len(codes), 200_000):
                cut = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(each[0][cut]), pa.array(codes[cut]), pa.array(each[1][cut])], names=["owner", "code", "doc_id"])

    return go


FIRST = "owner long, doc_id long, row long, base long, start long, n long, words binary"


def _reference(width: int):
    """Of the passages (from ``base``) of documents that are first somewhere, the runs of ``n`` windows that are.

    ``words`` is null where the passage has had these windows before: once is enough for the reference.
    """

    def go(batches):
        for batch in batches:
            out = []
            held = batch.column("codes")
            codes, ends = held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())
            for owner, doc, row, base, words, end, n in zip(*(batch.column(c).to_pylist() for c in ("owner", "doc_id", "row", "start", "words")), ends, np.diff(ends, prepend=0)):
                words = np.frombuffer(words, np.uint64)
                first = np.sort(codes[end - n : end])
                here = rolled(words, width).view(np.int64)
                known = first[np.minimum(np.searchsorted(first, here), n - 1)] == here
                new = np.zeros(len(here), bool)
                new[np.unique(here, return_index=True)[1]] = True
                for held_, of in ((True, known & new), (False, known & ~new)):
                    out += [(owner, doc, row, base, base + a, b - a, words[a : b + width - 1].tobytes() if held_ else None) for a, b in _runs(np.flatnonzero(of))]
            yield _rows(out, FIRST)

    return go


DEALT = "bucket long, part long, owner long, doc_id long, row long, base long, start long, words binary"


def _dealt(run: int, width: int):
    """Passages of owners with several ``parts``, to each part what its windows take.

    A window's part follows from the least of its runs of ``run`` words, so it is the same wherever the
    window stands. Gaps that are shorter than a new start's words are carried along.
    """

    def go(batches):
        for batch in batches:
            out = []
            for bucket, parts, owner, doc, row, base, start, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "parts", "owner", "doc_id", "row", "base", "start", "words"))):
                words = np.frombuffer(words, np.uint64)
                low, span, size = rolled(words, run), width - run + 1, 1
                while 2 * size <= span:
                    low = np.minimum(low[:-size], low[size:])
                    size *= 2
                if size < span:
                    low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
                part = mixed(low) % np.uint64(parts)
                by = np.argsort(part, kind="stable")
                cut = np.flatnonzero((np.diff(part[by]) != 0) | (np.diff(by) > width - 1)) + 1
                for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(by)].tolist()):
                    first, last = int(by[a]), int(by[b - 1])
                    out.append((bucket, int(part[first]), owner, doc, row, base, start + first, words[first : last + width].tobytes()))
            yield _rows(out, DEALT)

    return go


AUTOMATON = "shard long, symbols binary, edges binary, to binary, link binary, length binary"


def _build(shard_words: int, width: int):
    """A shard's automata: as many as it takes for none to hold more than ``shard_words`` words."""

    def go(key, table):
        step = max(1, shard_words // 2 - (width - 1))  # windows of one passage
        out, automaton, held = [], SuffixAutomaton(), 0

        def done():
            flat = automaton.flat()
            parts = (flat.symbols.astype(np.uint64), flat.edges.astype(np.int64), flat.to, flat.link, flat.length)
            out.append((key[0].as_py(), *(p.tobytes() for p in parts)))

        for words in table.column("words").to_pylist():
            words = np.frombuffer(words, np.uint64)
            for at in range(0, len(words) - width + 1, step):
                piece = words[at : at + step + width - 1].tolist()
                if held and held + len(piece) > shard_words:
                    done()
                    automaton, held = SuffixAutomaton(), 0
                automaton.add(piece)
                held += len(piece)
        done()
        return pa.Table.from_batches([_rows(out, AUTOMATON)])

    return go


def _stream(width: int):
    """Passages past a shard's automata: the words of windows in one, but for those where the document is the first."""

    def go(key, left, right):
        if not right.num_rows or not left.num_rows:
            return _table([])
        out = []
        docs, rows, starts, first = (left.column(c).to_pylist() for c in ("doc_id", "row", "start", "first"))
        chunks, of = [], []
        for n, words in enumerate(left.column("words").to_pylist()):
            words = np.frombuffer(words, np.uint64)
            for at in range(0, len(words) - width + 1, CHUNK):
                chunks.append(words[at : at + CHUNK + width - 1])
                of.append((n, at))
        for r in range(right.num_rows):
            held = [np.frombuffer(right.column(c)[r].as_py(), t) for c, t in zip(("symbols", "edges", "to", "link", "length"), (np.uint64, np.int64, np.int32, np.int32, np.int32))]
            for (n, at), hit in zip(of, Flat(*held).matches(chunks, width)):
                places = np.flatnonzero(hit[width - 1 :]) + starts[n] + at  # starts of windows
                if first[n] and len(places):
                    places = places[~np.isin(places, np.concatenate([np.arange(f["start"], f["end"]) for f in first[n]]))]
                out += [(docs[n], rows[n], a, b + width - 1) for a, b in _runs(places)]
        return _table(out)

    def _table(rows):
        return pa.Table.from_batches([_rows(rows, SPAN)])

    return go


SPAN = "doc_id long, row long, start long, end long"


def _spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of ascending [start, end) spans."""
    out: list[list[int]] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive integers as [first, last + 1)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + 1).tolist()))


def _judged(with_text: bool):
    def run(batches):
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans") if "spans" in batch.schema.names else pa.nulls(batch.num_rows)
            for first, texts in in_slices(bytes_of(batch.column("text"))):
                totals, gone, digests, bodies = [], [], [], []
                for text, removed in zip(texts, spans.slice(first, len(texts)).to_pylist()):
                    words = text.split()
                    n = 0
                    kept, at = [], 0
                    for a, b in _spans(*np.array(sorted((s["start"], s["end"]) for s in removed)).T) if removed else []:
                        kept += words[at:a]
                        n += b - a
                        at = b
                    kept += words[at:]
                    body = b" ".join(kept)
                    totals.append(len(words))
                    gone.append(n)
                    digests.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        bodies.append(body)
                columns = [ids.slice(first, len(texts)), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(bodies, pa.binary()).cast(pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_spans(docs: DataFrame, width: int = 50, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """doc_id, row, start and end of the words to remove from ``docs(doc_id, row, text)``; spans may overlap.

    ``row`` tells documents of one id apart.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    run = (width + 1) // 2
    known = docs.where("doc_id is not null")
    anchors = scratch.save(known.mapInArrow(light(_anchors(run, width)), "anchor long, doc_id long, row long, place long"), "anchors")
    counts = anchors.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    owners = scratch.save(counts.where("owner < last").select("anchor", "owner", "n"), "owners")
    # anchors with very many hits, fewer than one in ``most`` rows: they and their owners are dealt over several tasks
    most = max(anchor_rows, anchors.count() // 10_000)
    heavy = F.broadcast(owners.where(F.col("n") > most).select("anchor", F.ceil(F.col("n") / most).alias("deals")))
    deal = F.pmod(F.xxhash64("doc_id", "place"), F.coalesce("deals", F.lit(1)))
    dealt = anchors.join(heavy, "anchor", "left").select("anchor", deal.alias("deal"), "doc_id", "row", "place")
    spread = owners.select("anchor", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > most, F.ceil(F.col("n") / most)).otherwise(F.lit(1).cast("long")) - 1)).alias("deal"))
    hits = scratch.save(dealt.join(spread, ["anchor", "deal"]).select("doc_id", "row", "place", "owner"), "hits")
    scratch.drop("anchors")
    # only texts with hits move
    by_doc = hits.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set(F.struct("place", "owner")).alias("hits"))
    marked = maybe_in(known, "doc_id", bloom_of(hits.select("doc_id").distinct())).join(by_doc, (F.col("doc_id") == F.col("__id")) & (F.col("row") == F.col("__row"))).select("doc_id", "row", "text", "hits")
    cut = scratch.save(marked.mapInArrow(light(_cut(run, width)), PASSAGE), "cut")
    scratch.drop("hits")

    # each repeated window's first document
    windows = cut.mapInArrow(light(_windows(width)), WINDOW).groupBy("owner", "code").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = windows.where("first < last").groupBy("owner", "first").agg(F.collect_list("code").alias("codes"))
    reference = cut.join(firsts.withColumnRenamed("first", "doc_id"), ["owner", "doc_id"]).mapInArrow(light(_reference(width)), FIRST)
    reference = scratch.save(reference, "reference")

    # shards: a large owner has several of its own, small ones are put together
    size = F.octet_length("words") / 8
    loads = reference.groupBy("owner").agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("m"))
    total = loads.agg(F.sum("m").alias("m")).first()["m"] or 0
    buckets = max(1, int(total // shard_words))
    parts = F.ceil(F.col("m") / shard_words)
    # where windows are dealt to very many parts, their passages come in short pieces of some four times the words
    parts = F.greatest(F.lit(1).cast("long"), F.when(parts <= 4, parts).otherwise(4 * parts))
    own = F.when(F.col("m") > shard_words, F.xxhash64("owner")).otherwise(F.pmod(F.xxhash64("owner"), F.lit(buckets)))
    loads = scratch.save(loads.select("owner", parts.alias("parts"), own.alias("bucket")), "loads")

    def dealt_out(passages: DataFrame) -> DataFrame:
        met = passages.join(loads, "owner")
        whole = met.where("parts = 1").select("bucket", F.lit(0).cast("long").alias("part"), "owner", "doc_id", "row", "base", "start", "words")
        several = met.where("parts > 1").select("bucket", "parts", "owner", "doc_id", "row", "base", "start", "words")
        return whole.unionByName(several.mapInArrow(light(_dealt(run, width)), DEALT)).withColumn("shard", F.xxhash64("bucket", "part"))

    built = dealt_out(reference.where("words is not null").drop("n"))
    automata = scratch.save(built.select("shard", "words").groupBy("shard").applyInArrow(_build(shard_words, width), AUTOMATON), "automata")

    # passages by the shards of their owner, each with the windows where its document is the first
    own_runs = reference.groupBy("owner", "doc_id", "row", "base").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("first"))
    asked = dealt_out(cut.withColumn("base", F.col("start"))).join(own_runs, ["owner", "doc_id", "row", "base"], "left").select("shard", "doc_id", "row", "start", "words", "first")
    met = asked.groupBy("shard").agg(F.sum(F.octet_length("words") / 8).alias("m")).select("shard", F.ceil(F.col("m") / stream_words).alias("tasks"))
    met = scratch.save(met, "met")
    left = asked.join(met, "shard").withColumn("task", F.pmod(F.xxhash64("doc_id", "start"), F.col("tasks"))).drop("tasks")
    right = automata.join(met, "shard").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).drop("tasks")
    spans = left.groupBy("shard", "task").cogroup(right.groupBy("shard", "task")).applyInArrow(_stream(width), SPAN)
    return scratch.save(spans, "spans")


def without_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, with_text: bool = True, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are runs other than white space, unchanged. A word is removed if a window of ``width``
    consecutive words that covers it also occurs, as it stands in the input, in a document of
    smaller id. Null, empty and short texts lose nothing. Rows that repeat an id are documents of
    which neither is smaller; each comes back, judged by its own text. A null id is neither
    smaller nor larger than any and loses nothing. An empty table gives no rows. Other columns play
    no part.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.select("doc_id", row_key(F.col("text")).alias("row"), "text")
    spans = repeated_spans(rows, width, shard_words, **how)
    by_doc = spans.distinct().groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    # texts that lose nothing are judged where they are
    bloom = bloom_of(spans.select("doc_id").distinct())
    joined = maybe_in(rows, "doc_id", bloom).join(by_doc, (F.col("doc_id") == F.col("__id")) & (F.col("row") == F.col("__row")), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.mapInArrow(light(_judged(with_text)), schema).unionAll(maybe_in(rows, "doc_id", bloom, False, _judged(with_text), schema))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p WHERE i + 49 <= len(w)),
f AS (SELECT h, min(doc_id) AS first FROM s GROUP BY h),
g AS (SELECT DISTINCT s.doc_id, s.i FROM s JOIN f ON s.h = f.h AND f.first < s.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g),
k AS (SELECT doc_id, list(i ORDER BY i) AS gone FROM c GROUP BY doc_id),
o AS (SELECT t.doc_id, w, gone, coalesce(len(gone), 0) AS n FROM t LEFT JOIN k ON k.doc_id = t.doc_id),
r AS (SELECT p.doc_id, string_agg(p.w[p.i], ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY 1)
SELECT o.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o LEFT JOIN r ON r.doc_id = o.doc_id
"""


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
