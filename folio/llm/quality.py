"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

A text is the stream of its words, a space around each; digits count as 0. The model predicts each byte
from up to four bytes before it, over the ends of words as within them, with orders one to five. Trusted
text is text labelled good and not toxic. Most of it trains: its n-grams are counted in every task and
summed by n-gram, and the orders, their contexts and continuations are joined shard by shard. The rest
is held out, and a document's perplexity is held against a high and a low quantile of its language's
held-out documents. A word that repeats the one before it costs what such repeats cost in trusted text,
if that is less: text that says one word over and over becomes far too easy.

Documents become places in the word list of their unit, one row a unit; the distinct n-grams of all units'
texts meet the model's counts shard by shard. The scores are written by unit, and the task that sums a
unit's documents opens its own. Nothing grows with the model but tables, and texts are never shuffled.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, decided, light, row_key

ORDER = 5
#: A unit of documents ends at so many bytes of text or distinct words; its group is scored in one task.
UNIT_BYTES, UNIT_WORDS = 16 << 20, 500_000  # places have three bytes
#: Above this many label rows they are joined by a shuffle, not a broadcast.
BROADCAST_LABELS = 4_000_000
#: Bytes of trusted average that each document's own average is drawn towards: short texts vary widely.
PRIOR_BYTES = 60
QUANTILE, MARGIN_BITS = 0.995, 0.4
#: One trusted document in so many, by a hash of its id, doesn't train but sets the limits.
HELD_OUT = 5
#: Bytes of text whose n-grams are worked out at once.
STEP = 1 << 18
#: Codes beside those of n-grams: words in all, and words that repeat the one before.
WORDS, REPEATS = -1, -2
_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)


def split(text: bytes) -> list[bytes]:
    return text.translate(_DIGITS).split()


def repeats(words: list[bytes]) -> list[bytes]:
    return [w for w, before in zip(words[1:], words) if w == before]


def _longest(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The longest n-gram that ends at each byte: the order, then the bytes. ``starts`` are the first bytes of texts.

    What comes out at the starts themselves means nothing.
    """
    one = text.astype(np.int64)
    two = one.copy()
    two[1:] |= one[:-1] << 8
    code = two.copy()
    code[2:] |= two[:-2] << 16
    code[4:] |= one[:-4] << 32
    code |= ORDER << 40
    for order in range(2, ORDER):
        at = starts + order - 1
        at = at[at < len(text)]
        code[at] = code[at] & ((1 << 8 * order) - 1) | (order << 40)
    return code


def _codes(texts: list[list[bytes]]):
    """Codes of the longest n-grams of texts given as words, in parts of bounded size; the space before a text is given."""
    held, size = [], 0

    def out():
        begins = np.cumsum([0, *(len(part) for part, _ in held)])[:-1]
        skips = np.array([skip for _, skip in held])
        codes = _longest(np.frombuffer(b"".join(part for part, _ in held), np.uint8), begins[skips == 1])
        keep = np.ones(len(codes), bool)
        for back in range(int(skips.max())):
            keep[begins[skips > back] + back] = False
        return codes[keep]

    for words in texts:
        if not words:
            continue
        stream = b" " + b" ".join(words) + b" "
        for at in range(0, len(stream), STEP):
            # of a text's start the first byte is no n-gram; a later part brings what stands before it
            held.append((stream[max(0, at - ORDER) : at + STEP], ORDER if at else 1))
            size += len(held[-1][0])
            if size >= STEP:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _count(batches):
    """Counts of the n-grams of trusted text: the longest at each byte (of ORDER bytes, or from the text's start)."""
    n_words = n_repeats = 0
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        texts = [split(t) for t in bytes_of(batch.column("text"))]
        n_words += sum(map(len, texts))
        n_repeats += sum(len(repeats(ws)) for ws in texts)
        for codes in _codes(texts):
            new, n = np.unique(codes, return_counts=True)
            both, back = np.unique(np.r_[grams, new], return_inverse=True)
            grams, counts = both, np.bincount(back, np.r_[counts, n], len(both)).astype(np.int64)
            if len(grams) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])
                grams, counts = grams[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([WORDS, REPEATS], pa.int64()), pa.array([n_words, n_repeats], pa.int64())], names=["gram", "n"])


def _order(gram):
    return F.shiftright(gram, 40)


def _context(gram):
    """The n-gram without its last byte."""
    n = _order(gram)
    low = F.shiftright(gram.bitwiseAND(F.lit((1 << 40) - 1)), 8)
    return ((n - 1) * F.lit(1 << 40)) + low


def _suffix():
    """The n-gram of the column ``gram`` without its first byte."""
    return F.expr("shiftleft(shiftright(gram, 40) - 1, 40) + (gram & (shiftleft(1L, cast((shiftright(gram, 40) - 1) * 8 as int)) - 1))")


def trained(trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """The model of ``trusted(text)`` as a table: gram, logp (base 2), backoff (base 2; 0 unless it is a context).

    Orders above the first come from counts, or from the number of distinct bytes before where
    more could stand before. Three discounts an order follow from its counts of counts. Every n-gram
    counted is in the model.
    """
    counted = scratch.save(trusted.mapInArrow(light(_count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "raw")
    seen = {r["gram"]: r["n"] for r in counted.where("gram < 0").collect()}
    rate = (seen.get(REPEATS, 0) + 1) / (seen.get(WORDS, 0) + 2)
    raw = counted.where("gram >= 0")
    levels = {ORDER: raw.where(_order(F.col("gram")) == ORDER)}
    for order in range(ORDER - 1, 0, -1):
        longer = levels[order + 1]
        # those that start a text have nothing before them: their own counts; the others, their distinct predecessors
        inner = longer.select(_suffix().alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        level = inner.unionByName(raw.where(_order(F.col("gram")) == order)) if order > 1 else inner
        levels[order] = scratch.save(level.groupBy("gram").agg(F.sum("n").alias("n")), f"level{order}")
    below = None
    parts = []
    for order in range(1, ORDER + 1):
        level = levels[order]
        c = {r["n"]: r["m"] for r in level.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
        n1, n2, n3, n4 = (c.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [min(max(x, 0.05), float(i)) for i, x in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        keyed = level.withColumn("context", _context(F.col("gram"))).withColumn("d", discount)
        contexts = keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("off"))
        joined = keyed.join(contexts, "context")
        gamma = F.col("off") / F.col("total")
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if below is None:
            p = own + gamma / 256
            level_p = joined.select("gram", p.alias("p"))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            level_p = joined.withColumn("suffix", _suffix()).join(lower, "suffix", "left").select("gram", (own + gamma * F.coalesce("lower", F.lit(1 / 256))).alias("p"))
        below = scratch.save(level_p, f"p{order}")
        weights = contexts.select(F.col("context").alias("gram"), F.log2(gamma).alias("backoff"))
        parts.append((below, weights))
    probabilities = parts[0][0].unionByName(parts[1][0])
    weights = parts[0][1].unionByName(parts[1][1])
    for p, w in parts[2:]:
        probabilities, weights = probabilities.unionByName(p), weights.unionByName(w)
    table = probabilities.join(weights, "gram", "full").select("gram", F.log2("p").cast("float").alias("logp"), F.coalesce("backoff", F.lit(0.0)).cast("float").alias("backoff"))
    table = scratch.save(table, "model")
    return table.select("gram", "logp", "backoff").unionByName(table.sparkSession.range(1).select(F.lit(REPEATS).cast("long").alias("gram"), F.lit(math.log2(rate)).cast("float").alias("logp"), F.lit(0.0).cast("float").alias("backoff")))


class Model:
    """A model's table, or a shard of it, in a task."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        by = np.argsort(grams)
        self.grams, self.logp, self.backoff = grams[by], logp[by], backoff[by]

    def _find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.grams, codes), max(len(self.grams) - 1, 0))
        return at, (self.grams[at] == codes) if len(self.grams) else np.zeros(len(codes), bool)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Minus the base-2 logarithm of the last byte's probability after the others, for each n-gram."""
        orders, low = codes >> 40, codes & ((1 << 40) - 1)
        total = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            here = open_[orders[open_] >= order]
            gram = low[here] & ((1 << 8 * order) - 1)
            at, found = self._find(gram | (order << 40))
            found &= ~np.isnan(self.logp[at]) if len(self.logp) else False
            total[here[found]] -= self.logp[at[found]]
            # the context of a single byte is the empty n-gram, 0
            at, known = self._find((gram[~found] >> 8) | ((order - 1) << 40))
            total[here[~found][known]] -= self.backoff[at[known]]
            done = np.zeros(len(codes), bool)
            done[here[found]] = True
            open_ = open_[~done[open_]]
        total[open_] += 8.0  # a byte never seen
        return total

    def bits(self, text: bytes) -> float:
        """Minus the base-2 logarithm of a text's probability."""
        return float(sum(self.of(codes).sum() for codes in _codes([split(text)])))


#: One row a unit: columns of its documents, the places of all their words as three planes of bytes, its words, its n-grams.
_UNITS = "unit long, doc_id array<long>, row_key array<long>, lang array<string>, n_bytes array<long>, n_words array<int>, places binary, words binary, grams array<long>"
_UNIT_TYPES = [pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32())), pa.binary(), pa.binary(), pa.list_(pa.int64())]
_UNIT_SCHEMA = pa.schema([(field.split(" ")[0], t) for field, t in zip(_UNITS.split(", "), _UNIT_TYPES)])


def _units(batches):
    """Documents by unit: a unit ends at so many bytes or distinct words, and with the task."""
    known, docs, planes, grams, size = {}, [], ([], [], []), [], 0

    def row():
        every = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        columns = [pa.array([list(c)], t) for c, t in zip(zip(*docs), _UNIT_TYPES[1:6])]
        rest = [pa.array([b"".join(b"".join(plane) for plane in planes)], pa.binary()), pa.array([b" ".join(known)], pa.binary()), pa.ListArray.from_arrays([0, len(every)], pa.array(every))]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), *columns, *rest], schema=_UNIT_SCHEMA)

    for batch in batches:
        texts = bytes_of(batch.column("text"))
        ids, keys, langs = (batch.column(c).to_pylist() for c in ("doc_id", "row_key", "lang"))
        held, seen = [], 0
        for i, text in enumerate(texts):
            ws = split(text)
            held.append(ws)
            places = np.fromiter((known.setdefault(w, len(known)) for w in ws), "<i4", len(ws)).view(np.uint8).reshape(-1, 4)
            for k, plane in enumerate(planes):
                plane.append(places[:, k].tobytes())
            docs.append((ids[i], keys[i], langs[i], sum(map(len, ws)) + len(ws), len(ws)))
            size, seen = size + len(text), seen + len(text)
            full = size >= UNIT_BYTES or len(known) >= UNIT_WORDS or len(docs) >= UNIT_WORDS
            if full or seen >= 4 * STEP or i + 1 == len(texts):
                grams += map(np.unique, _codes(held))
                if len(grams) > 16:
                    grams = [np.unique(np.concatenate(grams))]
                held, seen = [], 0
            if full:
                yield row()
                known, docs, planes, grams, size = {}, [], ([], [], []), [], 0
    if docs:
        yield row()


def _shard(gram, last: int):
    """Of n-grams of three bytes or more, the two bytes of which the second is ``last`` bytes from the end."""
    return F.shiftright(gram, 8 * last).bitwiseAND(F.lit(0xFFFF))


def _shard_scores(short):
    """Scores of a shard's n-grams: all longer n-grams and contexts that they can back off to are in the shard, the rest in ``short``."""

    def run(key, left, right):
        grams, logp, backoff = (np.concatenate([a, right.column(n).to_numpy()]) for a, n in zip(short.value, ("gram", "logp", "backoff")))
        codes = left.column("gram").to_numpy()
        return pa.table({"gram": pa.array(codes), "bits": pa.array(Model(grams, logp, backoff).of(codes))})

    return run


def gram_scores(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, bits) of distinct ``grams(gram)`` under ``model``.

    An n-gram of three bytes or more and all that it can back off to share the two bytes before
    its last one, or are contexts that end in them, or have at most two bytes. Of the last there
    are no more than 256 * 257 + 1, whatever the input: only they are broadcast.
    """
    at = F.col("gram")
    few = model.where((at >= 0) & (_order(at) <= 2)).toArrow()
    short = grams.sparkSession.sparkContext.broadcast(tuple(few[n].to_numpy() for n in ("gram", "logp", "backoff")))
    longer = model.where(_order(at) >= 3)
    sides = F.explode(F.array_distinct(F.array(_shard(at, 1), _shard(at, 0))))
    held = longer.withColumn("held", sides).select("held", "gram", "logp", "backoff")
    # those of two bytes have a shard too, in which the broadcast part is all they need
    asked = grams.select(_shard(at, 1).alias("asked"), "gram")
    return asked.groupBy("asked").cogroup(held.groupBy("held")).applyInArrow(_shard_scores(short), "gram long, bits double")


#: Words of a document, or of several, that are scored at once.
SCORED_WORDS = 40_000
#: Units whose scores are in one folder.
UNITS_A_FOLDER = 8
_SUMS = "doc_id long, row_key long, lang string, bits double, n_bytes long"


class _Scores:
    """Bits of a unit's n-grams, found by a table of hashed codes; where two have one slot, by a search."""

    def __init__(self, grams: np.ndarray, bits: np.ndarray):
        by = np.argsort(grams)
        self.grams, self.bits = grams[by], bits[by]
        self.shift = np.uint64(64 - max(10, (8 * len(grams)).bit_length()))
        slots = self._slot(self.grams)
        self.table = np.zeros(1 << (64 - int(self.shift)), np.float32)
        self.table[slots] = self.bits
        values, counts = np.unique(slots, return_counts=True)
        self.table[values[counts > 1]] = np.nan

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Bits of codes, all of which the unit has; of others some number."""
        out = self.table[self._slot(codes)].astype(np.float64)
        open_ = np.flatnonzero(np.isnan(out))
        if len(open_):
            out[open_] = self.bits[np.minimum(np.searchsorted(self.grams, codes[open_]), len(self.grams) - 1)]
        return out


def _document_bits(n_words: np.ndarray, places: np.ndarray, names: bytes, scores: _Scores, repeat: float) -> np.ndarray:
    """Bits of a unit's documents, from the places of their words among ``names``, which single spaces part."""
    # word 0 is the space that a text starts with, every other word ends with one
    flat = np.frombuffer(b" " + names + b" ", np.uint8)
    starts = np.r_[0, np.flatnonzero(flat == 32) + 1]
    sizes = np.diff(starts)
    starts = starts[:-1]
    bits = np.zeros(len(n_words))
    held, size = [], 0

    def add():
        """Scores the parts of documents that are held: (document, words, how many of them are context)."""
        words = np.concatenate([w for _, w, _ in held])
        n = np.fromiter((len(w) for _, w, _ in held), np.int64, len(held))
        context = np.fromiter((c for _, _, c in held), np.int64, len(held))
        lens = sizes[words]
        ends = np.cumsum(lens)
        text = flat[np.repeat(starts[words] - (ends - lens), lens) + np.arange(ends[-1])]
        first = np.cumsum(n) - n  # the first word of each part
        begins = (ends - lens)[first][context == 0]
        each = scores.of(_longest(text, begins))
        each[begins] = 0.0
        each = np.add.reduceat(each, ends - lens)
        again = np.flatnonzero(words[1:] == words[:-1]) + 1
        each[again] = np.minimum(each[again], repeat)
        for back in range(int(context.max())):
            each[first[context > back] + back] = 0.0
        np.add.at(bits, np.fromiter((d for d, _, _ in held), np.int64, len(held)), np.add.reduceat(each, first))

    end = 0
    for doc, n in enumerate(n_words.tolist()):
        words = np.r_[np.int64(0), places[end : end + n] + 1]
        end += n
        if not n:
            continue
        for at in range(0, len(words), SCORED_WORDS):
            context = min(at, ORDER)
            held.append((doc, words[at - context : at + SCORED_WORDS], context))
            size += len(held[-1][1])
            if size >= SCORED_WORDS:
                add()
                held, size = [], 0
    if held:
        add()
    return bits


def _folder(unit: int, folders: int) -> int:
    return unit % folders


def _sums(root: str, folders: int, repeat: float):
    """Bits of each document of the units that come by; a unit's scores are opened in the shared folder."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                unit = batch.column("unit")[i].as_py()
                value = lambda c: batch.column(c)[i].values  # noqa: E731, B023
                planes = np.frombuffer(batch.column("places")[i].as_buffer(), np.uint8).reshape(3, -1)
                places = planes[2].astype(np.int32)
                for plane in planes[1::-1]:
                    places <<= 8
                    places |= plane
                if len(places):
                    system, path = fs.FileSystem.from_uri(f"{root}/folder={_folder(unit, folders)}")
                    held = pq.read_table(path, columns=["gram", "bits"], filters=[("unit", "=", unit)], filesystem=system, partitioning=None, use_threads=False, pre_buffer=False)
                    scores = _Scores(held["gram"].to_numpy(), held["bits"].to_numpy())
                    del held
                    bits = _document_bits(value("n_words").to_numpy(), places, batch.column("words")[i].as_py(), scores, repeat)
                else:
                    bits = np.zeros(len(value("n_words")))
                yield pa.RecordBatch.from_arrays([value("doc_id"), value("row_key"), value("lang"), pa.array(bits), value("n_bytes")], names=["doc_id", "row_key", "lang", "bits", "n_bytes"])

    return run


def perplexities(docs: DataFrame, model: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, row_key, lang, bits, n_bytes (of words, with a space each) of ``docs(doc_id, row_key, lang, text)``."""
    units = scratch.save(docs.select("doc_id", "row_key", "lang", "text").mapInArrow(light(_units), _UNITS), "units")
    asked = units.select("unit", F.explode("grams").alias("gram"))
    scored = scratch.save(gram_scores(asked.select("gram").distinct(), model), "grams")
    folders = max(1, units.count() // UNITS_A_FOLDER)
    own = asked.join(scored, "gram").select(F.pmod("unit", F.lit(folders)).alias("folder"), "unit", "gram", F.col("bits").cast("float").alias("bits"))
    own = own.repartition("folder", "unit").sortWithinPartitions("folder", "unit", "gram")
    # row groups of about a unit each, so that a task reads little beside its own
    own.write.option("parquet.block.size", 4 << 20).option("compression", "zstd").partitionBy("folder").parquet(scratch.path("unit-scores"))
    repeat = -float(model.where(F.col("gram") == REPEATS).first()["logp"])
    return units.drop("grams").mapInArrow(light(_sums(scratch.path("unit-scores"), folders, repeat)), _SUMS)


def classified(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin_bits: float = MARGIN_BITS, prior_bytes: int = PRIOR_BYTES, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a byte), lowest, highest, kept, row_key.

    ``labels(doc_id, quality, toxic)``: documents with quality 1 and not toxic are trusted, and one in
    ``held_out`` of them sets the limits instead of training. A document is rejected if its bits a
    byte, drawn towards its language's trusted average by ``prior_bytes``, lie over the ``quantile``
    of its language's held-out documents (of the trained ones where none is held out), or under the
    opposite one, by more than ``margin_bits``. A null language is a language of its own. In one
    without trusted documents there is nothing to judge by: all are kept. Null and empty texts have no
    bits, get the prior and are kept. Without any trusted text everything is kept. Repeated rows are
    judged each; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    own_id, text, own_lang = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    rows = docs.select(own_id.alias("doc_id"), row_key(own_id, text, own_lang).alias("row_key"), own_lang.alias("lang"), text.alias("text"))
    good = scratch.save(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct(), "good")
    good = F.broadcast(good) if good.count() <= BROADCAST_LABELS else good
    trains = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(held_out)) > 0
    trusted = rows.join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    some = not trusted.where(trains).select("doc_id").isEmpty()  # of very few, all train
    model = trained((trusted.where(trains) if some else trusted).select("text"), scratch)
    scores = scratch.save(perplexities(rows, model, scratch), "scores")

    lang = F.coalesce("lang", F.lit("\0"))
    marked = scores.withColumn("l", lang)
    of_good = scratch.save(marked.join(good, F.col("doc_id") == F.col("good_id"), "left_semi").where("n_bytes > 0").withColumn("out", ~trains), "of_good")
    parts = of_good.groupBy("l", "out").agg((F.sum("bits") / F.sum("n_bytes")).alias("mean"))
    # a language's held-out documents where there are some (true is larger), else those that trained
    averages = parts.groupBy("l").agg(F.max("out").alias("out"), F.max_by("mean", "out").alias("mean"))
    drawn = (F.col("bits") + prior_bytes * F.col("mean")) / (F.col("n_bytes") + prior_bytes)
    both = F.percentile_approx("drawn", [1 - quantile, quantile], 10_000)
    limits = of_good.join(averages, ["l", "out"]).withColumn("drawn", drawn).groupBy("l").agg(both.alias("q"))
    rules = scratch.save(averages.join(limits, "l").select("l", "mean", (F.col("q")[0] - margin_bits).alias("low"), (F.col("q")[1] + margin_bits).alias("high")), "rules")
    # rules has one row a language that has trusted text
    two = F.lit(2.0)
    own = F.coalesce(drawn, F.col("bits") / F.greatest("n_bytes", F.lit(1)))
    fits = F.coalesce(drawn.between(F.col("low"), F.col("high")), F.lit(True)) | (F.col("n_bytes") == 0)
    return marked.join(rules, "l", "left").select("doc_id", "lang", "n_bytes", F.pow(two, own).alias("perplexity"), F.pow(two, "low").alias("lowest"), F.pow(two, "high").alias("highest"), fits.alias("kept"), "row_key")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with all its columns, without rejected rows; rows of one id are judged each by its own text."""
    bad = classified(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col).where("not kept")
    named = bad.groupBy("doc_id", "row_key").agg(F.lit(False).alias("keep"), F.count(F.lit(1)).alias("n"))
    key = row_key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string"))
    return decided(docs, Scratch(docs.sparkSession, "quality-stage").save(named, "named"), id_col, key)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classified(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row_key")
