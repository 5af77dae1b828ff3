"""Repair of the turns of conversations, at the least cost.

A conversation is its rows by turn; with what is wrong with each row it is a signature, one letter
a row. The signatures are sorted and dealt by ranges, so a task meets them as the walk of a prefix
trie: the layers of the dynamic programme of the path it is on are a stack, a prefix shared with
the signature before keeps its layers, and a signature's answer is read off where it ends. Equal
signatures are one place of the trie, however many conversations have them.

Nothing is gathered by conversation: rows get places by one sort by ranges and are cut into pieces
of at most 1024 rows. A conversation of several pieces has an answer a piece for every state that
it may start in, and a pass over these small answers picks the states.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, light

#: A piece has at most two to the power of this rows.
PIECE_BITS = 10

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1

# States: 0 nothing yet, 1 behind system, 2 behind user, 3 behind assistant; 0 and 3 may end.
_INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}  # the state behind the one role that may be put in
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_ENDS = {0: "", 1: "II", 2: "I", 3: ""}
_ROLE = {2: "user", 3: "assistant"}

# --- the dynamic programme ----------------------------------------------------------------

# A layer's shape: for each state that can be reached (state, cost above the least one, rank). Ranks are
# the order of the states' edits as text. No state's edits are the start of another's, as all end with a
# row's letter, so the order of two continuations is that of the ranks and of the new letters.


@lru_cache(maxsize=1 << 16)
def next_layer(shape: tuple, letter: str) -> tuple[tuple, int, dict[int, tuple[int, str]]]:
    """(shape, cost to add, back) after one more row: back has for each state the state before and the row's edits.

    ``letter`` is ``-`` for a row that must go; else the role's initial, a capital where the text is cut off.
    """
    found: dict[int, tuple] = {}
    cut = CUT if letter.isupper() else 0
    for state, cost, rank in shape:
        at = state
        for inserts in ("", "I", "II"):
            if inserts:
                at, cost = _INSERTED[at], cost + INSERT
            ways = [(at, cost + DELETE, "D")]
            if letter != "-":
                ways.append((_INSERTED[at], cost + REROLE + cut, "R"))
                if (at, letter.lower()) in _KEPT:
                    ways.append((_KEPT[at, letter.lower()], cost + cut, "K"))
            for to, paid, edit in ways:
                way = (paid, rank, inserts + edit, state)
                if to not in found or way < found[to]:
                    found[to] = way
    least = min(way[0] for way in found.values())
    order = sorted(found, key=lambda s: found[s][1:3])
    return tuple((s, found[s][0] - least, order.index(s)) for s in sorted(found)), least, {s: (found[s][3], found[s][2]) for s in found}


class Walk:
    """The path of the trie from its root to the signature seen last, for one state at the start."""

    def __init__(self, start: int):
        self.signature = ""
        self.layers = [(((start, 0, 0),), 0, {})]

    def to(self, signature: str) -> None:
        """Goes to ``signature``; layers of the prefix shared with the last one stay."""
        shared, n = 0, min(len(signature), len(self.signature))
        while shared < n and signature[shared] == self.signature[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for letter in signature[shared:]:
            shape, cost, _ = self.layers[-1]
            shape, more, back = next_layer(shape, letter)
            self.layers.append((shape, cost + more, back))
        self.signature = signature

    def edits(self, state: int) -> str:
        out = []
        for _, _, back in reversed(self.layers[1:]):
            state, letters = back[state]
            out.append(letters)
        return "".join(reversed(out))

    def ends(self) -> list[tuple[int, int, int]]:
        """(state, cost, rank) of each state that the signature may end in."""
        shape, cost, _ = self.layers[-1]
        return [(s, cost + more, rank) for s, more, rank in shape]


def best_end(ends) -> tuple[int, int]:
    """(cost, state) of the best whole conversation of ``(state, cost, rank)``."""
    cost, _, state = min((cost + INSERT * len(_ENDS[s]), rank, s) for s, cost, rank in ends)
    return cost, state


def _whole(batches):
    walk, answer, at = Walk(0), None, None
    for batch in batches:
        costs, audits = [], []
        for signature in batch.column("signature").to_pylist():
            if signature != at:
                walk.to(signature)
                cost, state = best_end(walk.ends())
                answer, at = (cost, walk.edits(state) + _ENDS[state]), signature
            costs.append(answer[0])
            audits.append(answer[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=[*batch.schema.names, "cost", "audit"])


def _parts(batches):
    """Answers of a piece from each state to each: costs, ranks and edits at 4 * start + end, null where there is no way."""
    walks = [Walk(s) for s in range(4)]
    for batch in batches:
        out: list[list] = [[], [], []]
        for signature in batch.column("signature").to_pylist():
            row = [[None] * 16 for _ in out]
            for start, walk in enumerate(walks):
                walk.to(signature)
                for state, cost, rank in walk.ends():
                    for held, value in zip(row, (cost, rank, walk.edits(state))):
                        held[4 * start + state] = value
            for held, value in zip(out, row):
                held.append(value)
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out, kinds)], names=[*batch.schema.names, "costs", "ranks", "ways"])


def _fields(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def _walked(rows: DataFrame, keys: list[str], run, more: str) -> DataFrame:
    """``rows`` sorted by signature, parts being ranges of (signature, keys), through a walk of the trie."""
    return rows.repartitionByRange("signature", *keys).sortWithinPartitions("signature").mapInArrow(light(run), f"{_fields(rows, *rows.columns)}, {more}")


# --- rows, faults and pieces --------------------------------------------------------------


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``place``, which rises in the order (conv_id, turn, role, text), nulls first; rows alike are dealt too."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("row")]
    sorted_ = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    text, role = F.col("text"), F.col("role")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), role, text), 256))
    out = sorted_.select(
        "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place"), digest.alias("digest"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias(BLANK), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias(TRUNCATED),
    )
    return scratch.save(out, "placed")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _pieces(placed: DataFrame, piece_bits: int) -> DataFrame:
    """(conv_id, chunk, signature, initials, counts of faults) of every piece.

    A row is no duplicate if its place is the first of its role and text in the conversation. Places are
    unique, so that join has no hot key, and the first places are found by a partial aggregation.
    """
    first = placed.where(f"not {BLANK}").groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    met = placed.select("conv_id", "place", _initial(F.col("role")).alias("initial"), BLANK, TRUNCATED).join(first, "place", "left")
    fault = F.when(F.col(BLANK), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col(TRUNCATED), TRUNCATED)
    signed = met.withColumn("fault", fault)
    letter = F.when(F.col("fault").isin(BLANK, DUPLICATE), "-").when(F.col("fault") == TRUNCATED, F.upper("initial")).otherwise(F.col("initial"))
    listed = F.array_sort(F.collect_list(F.struct("place", letter.alias("letter"), "initial")))
    counts = [F.count_if(F.col("fault") == name).alias(name) for name in (BLANK, DUPLICATE, TRUNCATED)]
    rows = signed.groupBy("conv_id", F.shiftright("place", piece_bits).alias("chunk")).agg(listed.alias("rows"), *counts)
    joined = lambda name: F.array_join(F.transform("rows", lambda x: x[name]), "")
    return rows.select("conv_id", "chunk", joined("letter").alias("signature"), joined("initial").alias("initials"), BLANK, DUPLICATE, TRUNCATED)


def _folded(names: list[str]):
    """Picks the states of the pieces of each conversation; rows come by conversation and chunk."""

    def finish(key, chunks, backs, layer, crossings):
        cost, state = best_end(layer)
        tail, chosen = _ENDS[state], []
        for chunk, back in zip(reversed(chunks), reversed(backs)):
            start = back[state]
            chosen.append((key, chunk, start, state, tail, cost, crossings))
            state, tail = start, ""
        return chosen

    def run(batches):
        none = object()
        key, chunks, backs, layer, last, crossings = none, [], [], [], "", 0
        for batch in batches:
            out = []
            for conv, chunk, costs, ranks, initials in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "costs", "ranks", "initials"))):
                if conv != key or key is none:
                    if key is not none:
                        out += finish(key, chunks, backs, layer, crossings)
                    key, chunks, backs, layer, last, crossings = conv, [], [], [(0, 0, 0)], "", 0
                if last and last + initials[0] not in ("su", "ua", "au"):
                    crossings += 1
                last = initials[-1]
                found: dict[int, tuple] = {}
                for start, cost, rank in layer:
                    for end in range(4):
                        if costs[4 * start + end] is not None:
                            way = (cost + costs[4 * start + end], rank, ranks[4 * start + end], start)
                            if end not in found or way < found[end]:
                                found[end] = way
                order = sorted(found, key=lambda s: found[s][1:3])
                layer = [(s, found[s][0], order.index(s)) for s in found]
                chunks.append(chunk)
                backs.append({s: found[s][3] for s in found})
            if out:
                yield table(out, batch)
        if key is not none:
            yield table(finish(key, chunks, backs, layer, crossings), batch)

    def table(rows, like):
        kinds = {"conv_id": like.schema.field("conv_id").type, "tail": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(name, pa.int64())) for name, c in zip(names, zip(*rows))], names=names)

    return run


def _chosen(parts: DataFrame) -> DataFrame:
    """(conv_id, chunk, start, end, tail, cost, crossings) of ``parts``: the way through the pieces of each conversation.

    A task holds four small numbers a piece of the conversation it is at.
    """
    rows = parts.select("conv_id", "chunk", "costs", "ranks", "initials")
    more = "chunk long, start long, end long, tail string, cost long, crossings long"
    names = ["conv_id", *(f.split()[0] for f in more.split(", "))]
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "chunk")
    return dealt.mapInArrow(light(_folded(names)), f"{_fields(rows, 'conv_id')}, {more}")


class Repairs:
    """Faults and least edits of the conversations of ``rows(conv_id, turn, role, text)``.

    A conversation's rows stand by turn (nulls first), then role and text. The first of these holds
    for a row: *blank* (no character but white space), *duplicate* (its role and text occurred
    before), *truncated* (its last character but white space is none of ``.!?``). Keeping a row
    costs 0, giving it the role user or assistant 2, deleting it 3, which blank and duplicate rows
    must be; putting in a row of either role without text costs 2; a truncated row that stays costs
    1. The edits are the cheapest ones whose roles' initials read ``(s?(ua)+)?``, and of these the
    least by their letters K, R, D, I as text.

    A null role or text is one space; a null conv_id is a conversation. Repeated rows each count;
    an empty table has no conversations. Other columns play no part. A conversation's edits are one
    value of a letter a row.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_bits: int = PIECE_BITS):
        spark: SparkSession = rows.sparkSession
        self.scratch, self.piece_bits = Scratch(spark, "conversations"), piece_bits
        text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
        own = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
        self.placed = _placed(own, self.scratch)
        self.pieces = self.scratch.save(_pieces(self.placed, piece_bits), "pieces")
        legal = F.regexp_count("initials", F.lit("(?=su|ua|au)."))
        sums = [F.sum(c).alias(c) for c in (BLANK, DUPLICATE, TRUNCATED)]
        convs = self.pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("chunk"), F.min("signature").alias("signature"), *sums, F.sum(F.length("initials") - 1 - legal).alias("illegal"))
        self.convs = self.scratch.save(convs, "convs")
        self.edits = self._edits()

    def _edits(self) -> DataFrame:
        """(conv_id, chunk, start, audit, cost, crossings) of every piece."""
        one = self.convs.where("n = 1").select("conv_id", "chunk", "signature")
        whole = _walked(one, ["conv_id"], _whole, "cost long, audit string").select("conv_id", "chunk", F.lit(0).cast("long").alias("start"), "audit", "cost", F.lit(0).cast("long").alias("crossings"))
        several = self.convs.where("n > 1").select(F.col("conv_id").alias("many"))
        cut = self.pieces.join(several, F.col("conv_id").eqNullSafe(F.col("many")), "left_semi").select("conv_id", "chunk", "signature", "initials")
        parts = self.scratch.save(_walked(cut, ["conv_id", "chunk"], _parts, "costs array<long>, ranks array<long>, ways array<string>"), "parts")
        ways = parts.select(F.col("chunk").alias("c"), F.col("conv_id").alias("v"), "ways")
        met = _chosen(parts).join(ways, (F.col("chunk") == F.col("c")) & F.col("conv_id").eqNullSafe(F.col("v")))
        audit = F.concat(F.element_at("ways", (4 * F.col("start") + F.col("end") + 1).cast("int")), F.col("tail"))
        return self.scratch.save(whole.unionByName(met.select("conv_id", "chunk", "start", audit.alias("audit"), "cost", "crossings")), "edits")

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

        ``gaps``: turns missing between the least and the greatest, nulls apart. ``illegal``: neighbours
        whose roles' initials are none of su, ua, au.
        """
        turns = self.placed.where("turn is not null").groupBy(F.col("conv_id").alias("t_conv")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
        pieces = F.array_sort(F.collect_list(F.struct("chunk", "audit")))
        audits = self.edits.groupBy(F.col("conv_id").alias("e_conv")).agg(F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"), F.max("cost").alias("cost"), F.max("crossings").alias("crossings"))
        met = self.convs.join(audits, F.col("conv_id").eqNullSafe(F.col("e_conv"))).join(turns, F.col("conv_id").eqNullSafe(F.col("t_conv")), "left")
        return met.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), BLANK, DUPLICATE, TRUNCATED, (F.col("illegal") + F.col("crossings")).alias("illegal"), "cost", "audit")

    def _streamed(self, by: list[str], run, schema: str) -> DataFrame:
        """Rows behind the edits of their piece, piece after piece, through ``run``."""
        heads = self.edits.select("conv_id", "chunk", F.lit(-1).cast("long").alias("place"), F.col("audit").alias("role"), F.col("start").cast("string").alias("text"))
        rows = self.placed.select("conv_id", F.shiftright("place", self.piece_bits).alias("chunk"), "place", "role", "text")
        dealt = heads.unionByName(rows).repartition(*by).sortWithinPartitions(F.asc_nulls_first("conv_id"), "chunk", "place")
        return dealt.mapInArrow(light(run), schema)

    def rows(self) -> DataFrame:
        """The repaired conversations: (conv_id, position, part, edit, role, text), in order of (position, part).

        ``position`` is the place of the row an edit is at, or of the row before which one was put in.
        Pieces are worked on apart from each other.
        """

        def run(batches):
            for batch in batches:
                found = [x for x in _repaired(batch, state) if x[3] != "D"]
                if found:
                    columns = list(zip(*found))
                    kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "position", "part", "edit", "role", "text"])

        state: dict = {}
        return self._streamed(["conv_id", "chunk"], run, f"{_fields(self.placed, 'conv_id')}, position long, part long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): of the repaired rows as ``role:text``, joined by line feeds.

        Such a hash is computed from the first byte to the last, so a conversation's rows stream through one
        task, which holds a batch at a time.
        """

        def run(batches):
            state: dict = {}
            none = object()
            conv, sha, empty = none, None, True
            for batch in batches:
                out = []
                for key, _, _, edit, role, text in _repaired(batch, state, True):
                    if conv is none or key != conv:
                        if conv is not none:
                            out.append((conv, sha.hexdigest()))
                        conv, sha, empty = key, hashlib.sha256(), True
                    if edit not in ("D", ""):
                        sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                        empty = False
                if out:
                    yield table(out, batch.schema.field("conv_id").type)
            if conv is not none:
                yield table([(conv, sha.hexdigest())], batch.schema.field("conv_id").type)

        def table(rows, kind):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])

        return self._streamed(["conv_id"], run, f"{_fields(self.placed, 'conv_id')}, repaired_sha256 string")


def _repaired(batch, held: dict, heads: bool = False):
    """(conv_id, place, part, edit, role, text) of each edit of the rows of a batch; ``held`` goes over to the next batch.

    What follows the last row of a piece comes with that row. With ``heads``, a piece's edits come as a row without an edit.
    """
    for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
        if place < 0:
            held.update(edits=role, at=0, state=int(text))
            if heads:
                yield conv, place, 0, "", "", ""
            continue
        edits, at, state, part, done = held["edits"], held["at"], held["state"], 0, False
        while at < len(edits):
            edit = edits[at]
            if edit != "I" and done:
                break
            if edit == "I" and done and edits[at:].strip("I"):
                break  # it belongs to the next row
            at += 1
            if edit == "D":
                yield conv, place, part, edit, role, text
            elif edit == "K":
                state = _KEPT[state, role[:1]]
                yield conv, place, part, edit, role, text
            else:
                state = _INSERTED[state]
                yield conv, place, part, edit, _ROLE[state], text if edit == "R" else ""
            part += 1
            done |= edit != "I"
        held.update(at=at, state=state)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats it, 4 sets the role user. Nulls are one space.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")), "UTF-8")) % 20
    told = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("time")).drop("time")


def _sql() -> str:
    """The same in SQL. A state's cost and edits are one text, the cost in front, so the least text is the best way."""
    paid = lambda state, cost, edits: f"(printf('%09d', substr(k{state}, 1, 9)::BIGINT + {cost}) || substr(k{state}, 10) || '{edits}')"
    step = lambda state, cost, edits: f"(printf('%09d', substr(m{state}, 1, 9)::BIGINT + {cost}) || substr(m{state}, 10) || '{edits}')"
    before = f"""k0 AS m0, k1 AS m1, least({paid(0, 2, 'I')}, {paid(1, 2, 'I')}, k2, {paid(3, 2, 'I')}) AS m2,
      least({paid(0, 4, 'II')}, {paid(1, 4, 'II')}, {paid(2, 2, 'I')}, k3) AS m3"""
    kept = lambda state, initial: f"CASE WHEN letter = '{initial}' THEN {step(state, 'cut', 'K')} END"
    rerole = lambda state: f"CASE WHEN letter != '-' THEN {step(state, '2 + cut', 'R')} END"
    gone = lambda state: step(state, 3, "D")
    to_user = ", ".join(f"{kept(s, 'u')}, {rerole(s)}" for s in (0, 1, 3))
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS kind FROM told, crc_table
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE kind != 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair FROM o
), s AS (
  SELECT conv_id, n, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' ELSE left(role, 1) END AS letter, (fault IS NOT DISTINCT FROM 'truncated')::INT AS cut FROM f
), dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, '000000000' AS k0, NULL::VARCHAR AS k1, NULL::VARCHAR AS k2, NULL::VARCHAR AS k3 FROM s
  UNION ALL
  SELECT conv_id, n + 1, {gone(0)}, least({gone(1)}, {kept(0, 's')}), least({gone(2)}, {to_user}), least({gone(3)}, {kept(2, 'a')}, {rerole(2)})
  FROM (SELECT s.conv_id, dp.n, letter, cut, {before} FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.n + 1)
), best AS (
  SELECT conv_id, least(k0, k3, {paid(2, 2, 'I')}, {paid(1, 4, 'II')}) AS k FROM dp JOIN (SELECT conv_id AS c, max(n) AS n FROM s GROUP BY 1) z ON z.c IS NOT DISTINCT FROM conv_id AND z.n = dp.n
), e AS (
  SELECT conv_id, i, substr(k, 9 + i, 1) AS edit, len(replace(substr(k, 10, i), 'I', '')) AS n, len(replace(substr(k, 10, i), 'D', '')) - 1 AS nth FROM best, unnest(range(1, len(k) - 8)) u(i)
), r AS (
  SELECT e.conv_id, i, nth, CASE edit WHEN 'I' THEN '' ELSE text END AS text, role, edit,
    max((edit = 'K' AND nth = 0 AND left(role, 1) = 's')::INT) OVER (PARTITION BY e.conv_id) AS has_s
  FROM e JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = greatest(e.n, 1) WHERE edit != 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - has_s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS repaired_sha256 FROM r GROUP BY conv_id
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(substr(k, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(k, 10), '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP12_SQL = _sql()


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repairs = Repairs(damaged(rows))
    report, digests = repairs.report(), repairs.digests().withColumnRenamed("conv_id", "d_conv")
    every = rows.groupBy(F.col("conv_id").alias("conv")).agg(F.lit(1).alias("one"))
    met = every.join(report, F.col("conv").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("conv").eqNullSafe(F.col("d_conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return met.select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
