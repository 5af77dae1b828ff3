"""Similarity self-join on word shingles by set relations, lossless for its components.

Three relations between sets save work without losing a link:

* Equal sets are one set (by a 64-bit id; where two unlike sets have one id, as their second ids show, both take those).
* A set very close to one the task has seen (its leader) is attached to it with its exact
  distance; its index entries become its leader's. As 1 - Jaccard is a metric, answers of the leader
  give most answers of the attached set: leaders farther apart than the threshold plus both radii
  have no linked members, and leaders that are linked need no look at their members.
* Index lists (one a shingle, holding sets whose prefix has it) are read by blocks of equal
  position: two blocks whose positions leave too little room for the needed overlap are skipped,
  and within a block only the sizes in reach are read. Of what is left, pairs whose signatures
  (parities of hashed slots) differ in more bits than linked sets can are never sent on.

Lists are read twice: first each leader is held against its list's first one only, then leaders
that are still not connected against each other. A group of near copies, however large, is
connected after the first look.

Prefixes take the rarest shingles first, by a sketch of fixed size that counts all documents, so
that common passages fall out of prefixes. Candidate pairs of leaders are dealt to blocks of
bounded size together with the texts they need, and verified exactly there.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bloom_of, bytes_of, components, decided, in_slices, joined_components, light, maybe_in, row_key, shingles, tidy, word_hashes

SKETCH_SLOTS = 1 << 19
SKETCH_CHUNKS = 64
#: Bytes of leaders' sets that a task remembers; a leader that it forgot only costs work.
LEADER_BYTES = 48 << 20
#: Words of the texts that one block of pairs brings together (about 20 MB of hashes).
BLOCK_WORDS = 1_000_000
#: Most (block, document) rows, of 16 bytes, that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_PLACES = 1_000_000
#: Bits of a set's signature: the parities of its shingles by hashed slot.
SIGNATURE_BITS = 512


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any linked set."""
    return -(-percent * n // 100)


def _linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _set_id(values: np.ndarray, odd: frozenset = frozenset(), seed: int = 0) -> int:
    """A set's id; one of the few ids of ``odd``, which unlike sets have, gives way to the second id."""
    first = xxhash.xxh3_64_intdigest(values.tobytes(), seed) - (1 << 63)
    return _set_id(values, seed=1) if first in odd else first


#: Most ids of unlike sets: some 10 are expected of 2 * 10^10 sets. They are sent with the code.
MOST_ODD = 10_000


def _signature(s: np.ndarray) -> bytes:
    """A set's parities. Two sets' signatures differ in no more bits than the sets differ in shingles."""
    slots = ((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(SIGNATURE_BITS)
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=SIGNATURE_BITS) & 1).tobytes()


def _may_link(sig, n, radius, x, y, percent: int):
    """Of pairs of leaders (rows ``x``, ``y``): can members of both be linked, by their signatures.

    Linked members are at most 1 - percent / 100 apart, their leaders the radii more; a distance d
    of sets with n and m shingles is a difference of d (n + m) / (2 - d) shingles.
    """
    far = np.minimum(1.0, 1 - percent / 100 + radius[x] + radius[y])
    differ = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1, dtype=np.int64)
    return differ <= far * (n[x] + n[y]) / (2 - far) + 1e-6


def _measure(width: int):
    """Each document's set size, set id and signature; then the task's sketch of shingle counts."""

    def run(batches):
        counts = np.zeros(SKETCH_SLOTS, np.int64)
        names = ["doc_id", "row_key", "n", "sid", "second", "signature", "chunk", "counts"]
        for batch in batches:
            sizes, sids, seconds, signatures = [], [], [], []
            for _, texts in in_slices(bytes_of(batch.column("text"))):
                held = [shingles(h, width) for h in word_hashes(texts, lower=True)]
                sizes += map(len, held)
                sids += map(_set_id, held)
                seconds += (_set_id(h, seed=1) for h in held)
                signatures += map(_signature, held)
                counts += np.bincount((np.concatenate(held) & np.uint64(SKETCH_SLOTS - 1)).astype(np.int64), minlength=SKETCH_SLOTS)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(seconds, pa.int64()), pa.array(signatures, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if counts.any():
            parts = np.split(np.minimum(counts, 2**32 - 1).astype(np.uint32), SKETCH_CHUNKS)
            k = SKETCH_CHUNKS
            yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 5, pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return run


def _add(batches):
    """Sums of counts by chunk, of rows that come sorted by chunk: one chunk is held at a time."""
    held, total = None, None
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            counts = np.frombuffer(counts, np.uint32 if len(counts) == 4 * SKETCH_SLOTS // SKETCH_CHUNKS else np.int64)
            if chunk != held:
                if held is not None:
                    yield _chunk(held, total)
                held, total = chunk, np.zeros(len(counts), np.int64)
            total += counts
    if held is not None:
        yield _chunk(held, total)


def _chunk(chunk, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])


def _ranks(total: np.ndarray) -> np.ndarray:
    """Order of the sketch's slots, in 20 bits: finer where counts are small."""
    return np.minimum(np.log2(1.0 + total) * 16_384, (1 << 20) - 1).astype(np.uint64)


def _prefix(s: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The set's rarest shingles, as many as a linked set must share one of, in order."""
    keys = (ranks[(s & np.uint64(SKETCH_SLOTS - 1)).astype(np.int64)] << np.uint64(44)) | (s >> np.uint64(20))
    return s[np.argsort(keys, kind="stable")[: len(s) - _need(len(s), percent) + 1]]


class Leaders:
    """The leaders that a task has seen last, by three minhashes."""

    def __init__(self, percent: int):
        self.near = (100 + percent) // 2  # attached sets are at least so similar
        self.by: dict[tuple[int, int], int] = {}
        self.sets: OrderedDict[int, tuple[np.ndarray, list]] = OrderedDict()
        self.size = 0

    def attach(self, sid: int, s: np.ndarray) -> tuple[int, float]:
        """(leader, distance) of a set: itself and 0 where none is near."""
        with np.errstate(over="ignore"):
            keys = [(i, int((s * np.uint64(m)).min())) for i, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))]
        for key in keys:
            leader = self.by.get(key)
            if leader is None:
                continue
            other = self.sets[leader][0]
            if 100 * min(len(s), len(other)) < self.near * max(len(s), len(other)):
                continue
            common = len(np.intersect1d(s, other, assume_unique=True))
            if _linked(common, len(s), len(other), self.near):
                return leader, 1 - common / (len(s) + len(other) - common)
        keys = [k for k in keys if k not in self.by]
        self.sets[sid] = (s, keys)
        self.by.update(dict.fromkeys(keys, sid))
        self.size += s.nbytes
        while self.size > LEADER_BYTES and len(self.sets) > 1:
            old, gone = self.sets.popitem(last=False)[1]
            self.size -= old.nbytes
            for k in gone:
                del self.by[k]
        return sid, 0.0


#: One index entry (value: sizes and place), or, with a radius, the attachment of a set (value: its id) to a leader.
ENTRY = "token long, leader long, value long, radius double"


def _index(held, width: int, percent: int, odd: frozenset):
    def run(batches):
        ranks, leaders, seen = held.value, Leaders(percent), set()
        for batch in batches:
            rows, stars = [], []
            for _, texts in in_slices(bytes_of(batch.column("text"))):
                for h in word_hashes(texts, lower=True):
                    s = shingles(h, width)
                    if not len(s):
                        continue
                    sid = _set_id(s, odd)
                    if sid in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sid)
                    leader, distance = leaders.attach(sid, s)
                    if leader != sid:
                        stars.append((leader, leader, sid, distance))
                    rows.append((_prefix(s, ranks, percent), leader, len(s)))
            if rows:
                counts = np.array([len(p) for p, _, _ in rows])
                token = np.concatenate([p for p, _, _ in rows]).view(np.int64)
                leader = np.repeat(np.array([r[1] for r in rows], np.int64), counts)
                n = np.repeat(np.array([r[2] for r in rows], np.int32), counts)
                place = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
                # one entry for a leader's sets that have the shingle
                by = np.lexsort((leader, token))
                token, leader, n, place = token[by], leader[by], n[by], place[by]
                at = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (leader[1:] != leader[:-1])])
                yield _entries(token[at], leader[at], _packed(np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.minimum.reduceat(place, at)))
            if stars:
                token, leader, sid, distance = zip(*stars)
                yield _entries(token, leader, sid, distance)

    return run


def _entries(token, leader, value, radius=None) -> pa.RecordBatch:
    radius = pa.nulls(len(token), pa.float64()) if radius is None else pa.array(radius, pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(leader, pa.int64()), pa.array(value, pa.int64()), radius], names=["token", "leader", "value", "radius"])


def _packed(low, high, place) -> np.ndarray:
    """Smallest and largest size of a leader's sets and their first place, in one number (sizes up to 2**22 exactly)."""
    most = (1 << 22) - 1
    # a size beyond is as good as this one for the bounds below: the low end falls, the high end is open
    return (np.minimum(low, most).astype(np.int64) << 41) | (np.minimum(high, most).astype(np.int64) << 19) | np.minimum(place, (1 << 19) - 1).astype(np.int64)


def _unpacked(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    most = (1 << 22) - 1
    high = (value >> 19) & most
    return value >> 41, np.where(high == most, np.int64(1) << 40, high), value & ((1 << 19) - 1)


def _room(low_a, high_a, place_a, low_b, high_b, place_b, percent: int):
    """Can sets of these sizes that first share a shingle at these places be linked."""
    needed = percent * (low_a + low_b) / (100 + percent)
    return (100 * np.minimum(high_a, high_b) >= percent * np.maximum(low_a, low_b)) & (np.minimum(high_a - place_a, high_b - place_b) >= needed - 1e-9)


FOUND = "token long, a long, b long, value long, radius double"


def _found(token, a, b, value=None, radius=None) -> pa.RecordBatch:
    n = len(a)
    part = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([part(token, pa.int64()), pa.array(a, pa.int64()), part(b, pa.int64()), part(value, pa.int64()), part(radius, pa.float64())], names=["token", "a", "b", "value", "radius"])


def _whole_lists(batches, key: str):
    """Tables of whole lists out of batches that are sorted by ``key``."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if left is not None:
            table = pa.concat_tables([left, table]).combine_chunks()
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        edge = int(np.searchsorted(keys, keys[-1], "left"))
        if edge:
            yield table.slice(0, edge)
        left = table.slice(edge)
    if left is not None and left.num_rows:
        yield left


def _first_pairs(percent: int):
    """First look at the lists: each entry with the list's first leader, and lists of several leaders.

    Rows come sorted by token, place and a hash of the leader, so a list's first one leads it: the one
    with the fewest rarer shingles has the fewest changes of its own, most others are near it. What is
    linked through first leaders needs no other pair. Only a list's first entry is held.
    """

    def run(batches):
        head = None  # token, leader and value of the list at hand; and whether it is known to have several leaders
        for batch in batches:
            star = np.asarray(batch.column("radius").is_valid())
            token, leader, value = (batch.column(c).to_numpy() for c in ("token", "leader", "value"))
            if star.any():
                yield _found(None, leader[star], value[star], radius=batch.column("radius").to_numpy(zero_copy_only=False)[star])
                token, leader, value = token[~star], leader[~star], value[~star]
            if not len(token):
                continue
            carried = head is not None and head[0] == token[0]
            if carried:  # the list goes on: its head stands before this batch
                token, leader, value = (np.r_[np.array([h], np.int64), x] for h, x in zip(head, (token, leader, value)))
            first = np.r_[True, token[1:] != token[:-1]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
            more = leader != leader[at]
            several = np.zeros(len(token), bool)
            several[at[more]] = True
            known = carried and head[3]
            several[0] |= known
            last = at[-1]
            head = (token[last], leader[last], value[last], bool(several[last]))
            told = several[at]
            told[0] &= not known  # the head went out with an earlier batch
            if more.any():
                x, to = np.flatnonzero(more), at[more]
                ok = _room(*_unpacked(value[x]), *_unpacked(value[to]), percent)
                a, b = leader[x[ok]], leader[to[ok]]
                if len(a):
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield _found(None, both[0], both[1])
            if told.any():
                yield _found(token[told], leader[told], None, value[told])

    return run


def _pairs(leader, root, low, high, place, starts, ends, percent):
    """Pairs of leaders of different roots that may be linked, list by list."""
    sizes = ends - starts
    for size in np.unique(sizes):
        if size < 2:
            continue
        lists = starts[sizes == size]
        if size <= 32:
            i, j = np.triu_indices(size, 1)
            step = max(1, 200_000 // len(i))
            for at in range(0, len(lists), step):
                a = (lists[at : at + step, None] + i).ravel()
                b = (lists[at : at + step, None] + j).ravel()
                ok = (root[a] != root[b]) & _room(low[a], high[a], place[a], low[b], high[b], place[b], percent)
                yield leader[a[ok]], leader[b[ok]]
        else:
            for start in lists:
                rows = np.arange(start, start + size)
                if (root[rows] != root[start]).any():
                    yield from _blocks(leader, root, low, high, place, rows, percent)


def _blocks(leader, root, low, high, place, rows, percent):
    """A long list: blocks of equal place, each sorted by size; whole blocks out of reach are skipped."""
    rows = rows[np.lexsort((low[rows], place[rows]))]
    parts = np.split(rows, np.flatnonzero(np.diff(place[rows]) != 0) + 1)
    for x, a in enumerate(parts):
        most_a, least_a = high[a].max(), low[a].min()
        for b in parts[x:]:
            if not _room(least_a, most_a, place[a[0]], low[b].min(), high[b].max(), place[b[0]], percent):
                continue
            widest = (high[b] - low[b]).max()
            first = np.searchsorted(low[b], percent * low[a] / 100 - widest - 1, "left")
            for row, f in zip(a, first):
                c = b[f:]
                ok = (root[c] != root[row]) & _room(low[row], high[row], place[row], low[c], high[c], place[c], percent)
                if ok.any():
                    yield np.full(int(ok.sum()), leader[row]), leader[c[ok]]


def _other_pairs(percent: int):
    """Second look at the lists: pairs of leaders that are not linked yet."""

    def run(batches):
        for table in _whole_lists(batches, "token"):
            token, leader, root = (table.column(c).to_numpy() for c in ("token", "a", "root"))
            low, high, place = _unpacked(table.column("value").to_numpy())
            n, radius = (table.column(c).to_numpy() for c in ("n", "radius"))
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64).reshape(len(token), -1)
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            rows = np.arange(len(token))
            got = []
            for x, y in _pairs(rows, root, low, high, place, starts, np.append(starts[1:], len(token)), percent):
                ok = _may_link(sig, n, radius, x, y, percent)
                got.append((leader[x[ok]], leader[y[ok]]))
            if got:
                a, b = (np.concatenate(x) for x in zip(*got))
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                if both.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return run


def _verify(width: int, percent: int, odd: frozenset):
    """A block's pairs, with the texts of their sets: links found, and pairs whose members may be linked."""

    def run(key, left, right):
        sets, root = {}, {}
        for _, texts in in_slices(bytes_of(right.column("text"))):
            for h in word_hashes(texts, lower=True):
                s = shingles(h, width)
                sets[_set_id(s, odd)] = s

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for a, b, reach in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), left.column("reach").to_pylist()):
            if a not in sets or b not in sets or find(a) == find(b):
                continue  # linked already, through others
            x, y = sets[a], sets[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if _linked(common, len(x), len(y), percent):
                root[find(a)] = find(b)
            elif reach > 0 and (d := 1 - common / (len(x) + len(y) - common)) <= 1 - percent / 100 + reach + 1e-9:
                out.append((a, b, False, d))
        # the block's links as stars, which components() likes best
        out += [(find(x), x, True, None) for x in list(root) if find(x) != x]
        cols = list(zip(*out)) or [[], [], [], []]
        sets.clear()
        tidy()
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "linked": pa.array(cols[2], pa.bool_()), "distance": pa.array(cols[3], pa.float64())})

    return run


def _checked(pairs: DataFrame, sizes: DataFrame, rows: DataFrame, scratch: Scratch, name: str, width: int, percent: int, odd: frozenset) -> DataFrame:
    """``pairs(a, b, reach)`` verified: a, b, linked, distance (where members may still be linked).

    ``sizes(sid, n, row_key)`` has a row for each set. A pair's block follows its first set; one whose
    partners have more words than a block takes is dealt over several blocks by the partner.
    """
    of = lambda end: sizes.select(F.col("sid").alias(end), F.col("n").alias(f"n_{end}"))
    sized = scratch.save(pairs.join(of("a"), "a").join(of("b"), "b"), f"{name}-sized")
    many = sized.groupBy("a").agg((F.sum("n_b") + F.max("n_a")).alias("m"))
    split = F.pmod(F.xxhash64("b"), F.ceil(2 * F.col("m") / BLOCK_WORDS))
    blocks = max(1, -(-(many.agg(F.sum("m")).first()[0] or 0) // BLOCK_WORDS))
    dealt = sized.join(many, "a").select("a", "b", "reach", F.pmod(F.xxhash64("a", split), F.lit(blocks)).alias("block"))
    dealt = scratch.save(dealt, f"{name}-dealt")
    # blocks by document first, so that texts move once, to the blocks, or twice where the list is long
    where = dealt.select(F.col("block").alias("at"), F.explode(F.array("a", "b")).alias("sid")).distinct()
    where = scratch.save(where.join(sizes.select("sid", F.col("row_key").alias("__key")), "sid").select("at", "__key").distinct(), f"{name}-where")
    if where.count() <= BROADCAST_PLACES:
        asked, where = rows, F.broadcast(where)
    else:
        asked = maybe_in(rows, "row_key", bloom_of(where.select("__key")))
    brought = asked.join(where, F.col("row_key") == F.col("__key")).select("at", "text")
    out = dealt.groupBy("block").cogroup(brought.groupBy("at")).applyInArrow(_verify(width, percent, odd), "a long, b long, linked boolean, distance double")
    return scratch.save(out, f"{name}-checked")


#: Entries of a list that are held together; longer lists are read as pairs of parts.
LIST_ROWS = 20_000


def _in_parts(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """``entries`` by list, where a list is a token's or, of a token with very many entries, a pair of its parts."""
    entries = scratch.save(entries, "open-lists")
    most = max(LIST_ROWS, entries.count() // 10_000)
    # fewer than one long list in ``most`` entries
    long = F.broadcast(entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select("token", F.ceil(2 * F.col("m") / most).alias("parts")))
    mine = F.pmod(F.xxhash64("a"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.xxhash64("token", F.least(mine, k), F.greatest(mine, k)))
    return entries.join(long, "token", "left").withColumn("token", F.explode(F.when(F.col("parts").isNull(), F.array("token")).otherwise(cells))).drop("parts")


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id; and group (null without words) and row_key.

    Words are runs other than white space, A-Z lowered; a document's set is its distinct shingles of
    ``width`` words, or its whole sequence where it has fewer. Two documents are linked when the
    Jaccard similarity of their sets is at least ``percent`` / 100, and component_id is the
    smallest id reachable. Null, empty and blank texts have no shingles, no links and their own id.
    Rows that repeat an id or a set share its component; a null id (of a text with words) takes
    its set's component, and is never one's name while another id is there: component_id is null, and
    ``group`` tells such components apart, where no row has an id. An empty table gives no rows.
    Other columns play no part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    own_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(own_id.alias("doc_id"), text.alias("text"), row_key(own_id, text).alias("row_key"))
    measured = scratch.save(rows.mapInArrow(light(_measure(width)), "doc_id long, row_key long, n long, sid long, second long, signature binary, chunk int, counts binary"), "measured")
    unlike = measured.where("n > 0").groupBy("sid").agg(F.min("second").alias("s1"), F.max("second").alias("s2")).where("s1 != s2").select("sid")
    odd = frozenset(r["sid"] for r in unlike.limit(MOST_ODD).collect())
    if odd:
        measured = scratch.save(measured.withColumn("sid", F.when(F.col("sid").isin(list(odd)), F.col("second")).otherwise(F.col("sid"))), "measured-again")
    documents = measured.where("chunk is null").select("doc_id", "row_key", "n", "sid")
    sets = measured.where("n > 0").groupBy("sid")
    sizes = scratch.save(sets.agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("signature").alias("signature")), "sizes")

    added = measured.where("chunk is not null").select("chunk", "counts")
    for key in (["chunk", F.spark_partition_id() % 16], ["chunk"]):  # first in sixteen parts each, then the parts
        added = added.repartition(*key).sortWithinPartitions("chunk").mapInArrow(_add, "chunk int, counts binary")
    chunks = added.toArrow().sort_by("chunk")
    total = np.frombuffer(b"".join(chunks.column("counts").to_pylist()), np.int64) if chunks.num_rows else np.zeros(SKETCH_SLOTS, np.int64)
    ranks = spark.sparkContext.broadcast(_ranks(total))

    entries = rows.mapInArrow(light(_index(ranks, width, percent, odd)), ENTRY)
    lists = entries.repartition("token").sortWithinPartitions("token", F.col("value").bitwiseAND(F.lit((1 << 19) - 1)), F.xxhash64("leader"), "leader")
    found = scratch.save(lists.mapInArrow(light(_first_pairs(percent)), FOUND), "found")
    stars = scratch.save(found.where("radius is not null").groupBy(F.col("a").alias("leader"), F.col("b").alias("sid")).agg(F.min("radius").alias("radius")), "stars")
    radii = stars.groupBy("leader").agg(F.max("radius").alias("r"))

    def checked(pairs, name):
        """Pairs of leaders, verified; reach is how far linked members may be from unlinked leaders."""
        reach = (
            pairs.join(radii.select(F.col("leader").alias("a"), F.col("r").alias("ra")), "a", "left")
            .join(radii.select(F.col("leader").alias("b"), F.col("r").alias("rb")), "b", "left")
            .select("a", "b", (F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))).alias("reach"))
        )
        return _checked(scratch.save(reach, name), sizes, rows, scratch, name, width, percent, odd)

    first = found.where("radius is null and b is not null").select("a", "b").distinct()
    links_1 = checked(first, "first")
    links = links_1.where("linked").select("a", "b").unionAll(stars.select(F.col("leader").alias("a"), F.col("sid").alias("b")))
    roots = components(links, scratch, "roots1")

    facts = sizes.select(F.col("sid").alias("a"), "n", "signature").join(roots.select(F.col("node").alias("a"), "root"), "a", "left").join(radii.select(F.col("leader").alias("a"), "r"), "a", "left")
    open_lists = found.where("b is null").select("token", "a", "value").join(facts, "a").select(
        "token", "a", "value", F.coalesce("root", "a").alias("root"), "n", "signature", F.coalesce("r", F.lit(0.0)).alias("radius")
    )
    other = _in_parts(open_lists, scratch).repartition("token").sortWithinPartitions("token").mapInArrow(light(_other_pairs(percent)), "a long, b long").distinct()
    other = other.join(found.where("radius is null and b is not null").select("a", "b").distinct(), ["a", "b"], "left_anti")
    links_2 = checked(scratch.save(other, "other"), "second")
    roots = joined_components(roots, links_2.where("linked").select("a", "b"), scratch, "roots2")

    open_ = links_1.unionByName(links_2).where("not linked").select("a", "b", "distance")
    open_ = (
        open_.join(roots.select(F.col("node").alias("a"), F.col("root").alias("xa")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("xb")), "b", "left")
        .where(~F.coalesce("xa", "a").eqNullSafe(F.coalesce("xb", "b")))
        .select("a", "b", "distance")
    )
    open_ = scratch.save(open_, "open")
    if not open_.isEmpty():
        # members of leaders that are near but not linked; the triangle inequality leaves few
        members = stars.select("leader", "sid", "radius").unionAll(stars.select("leader", F.col("leader").alias("sid"), F.lit(0.0).alias("radius")).distinct())
        leaders = open_.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
        alone = leaders.join(radii, "leader", "left_anti").select("leader", F.col("leader").alias("sid"), F.lit(0.0).alias("radius"))
        members = members.unionAll(alone)
        more = (
            open_.join(members.select(F.col("leader").alias("a"), F.col("sid").alias("x"), F.col("radius").alias("dx")), "a")
            .join(members.select(F.col("leader").alias("b"), F.col("sid").alias("y"), F.col("radius").alias("dy")), "b")
            .where((F.col("dx") + F.col("dy") >= F.col("distance") - (1 - percent / 100) - 1e-9) & (F.col("dx") + F.col("dy") > 0))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(0.0).alias("reach"))
            .distinct()
        )
        more = scratch.save(more, "member-pairs")
        roots = joined_components(roots, _checked(more, sizes, rows, scratch, "members", width, percent, odd).where("linked").select("a", "b"), scratch, "roots3")

    named = sizes.select("sid", "doc_id").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    names = named.join(least, "root").select("sid", "component", "root")
    alone = F.col("n") == 0
    return documents.join(names, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.when(~alone, F.col("root")).alias("group"), "row_key"
    )


def keep_one_per_group(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns; of each group of similar documents one row stays: one with the smallest id.

    The decision is by row: a row without id stays only where its group has none with one, and of equal
    rows one stays. Rows without words are in no group and stay.
    """
    scratch = Scratch(docs.sparkSession, "ngram-stage")
    found = similar_groups(docs, width, percent, id_col, text_col).where("`group` is not null")
    rows = scratch.save(found.groupBy("group", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    best = rows.groupBy("group").agg(F.min(order).alias("best"), F.sum("n").alias("all")).where("`all` > 1")
    named = rows.join(best, "group").select("doc_id", "row_key", order.eqNullSafe(F.col("best")).alias("keep"), "n")
    own_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return decided(docs, scratch.save(named, "named"), id_col, row_key(own_id, text))


OP6_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
k AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, other) AS (SELECT DISTINCT a, a FROM k UNION SELECT r.node, k.b FROM r JOIN k ON k.a = r.other),
m AS (SELECT node, min(other) AS least FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least, t.doc_id) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN m ON m.node = t.doc_id
"""


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90).drop("group", "row_key")
