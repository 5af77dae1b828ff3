"""Byte-level BPE: exact encoding in linear time, and decoding.

The vocabulary is a trie over Latin-1 characters, one for each byte, with failure links
(pyahocorasick); one pass over a piece of text finds the longest token from every place. The ids
are then found from left to right: take the longest token, go to the next shorter one where it
doesn't fit behind its neighbour, and step back where none does. A place that was stepped back
from is never tried again, so the work is linear. Two tokens fit where merging their bytes by
rank gives the two of them, and a run of tokens is what merging gives just where every two
neighbours fit; what is known of neighbours is kept.
"""

from __future__ import annotations

import base64
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, Scratch, bytes_of, light

#: Entries of each of a worker's memories; a full one is emptied.
MOST_KEPT = 400_000
#: Longer pieces and units aren't kept.
MOST_KEPT_CHARS = 48
#: Characters of a text that are split at once; a longer unbroken piece stays whole.
SLICE_CHARS = 1 << 19

_WHITE_TWICE = regex.compile(r"\s\s")
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Bounded(dict):
    """A memory that is emptied when it is full."""

    def put(self, key, value):
        if len(self) >= MOST_KEPT:
            self.clear()
        self[key] = value
        return value


class Splitter:
    """The matches of a pattern, with letters and numbers as the tiktoken library's Unicode tables have them.

    The regex library's tables are of another version of Unicode. Characters on which the two differ
    are matched as another character of the right kind, and cut out as they are.
    """

    def __init__(self, pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        kinds = []
        for kind in (r"\p{L}", r"\p{N}"):
            # what doesn't match is left out of the ids, which are bytes here
            table = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            kinds.append((set(bytes(table.encode_ordinary(every)).decode()), set(regex.findall(kind, every))))
        (letters, own_letters), (numbers, own_numbers) = kinds
        odd = (letters ^ own_letters) | (numbers ^ own_numbers)
        self.shown = {ord(c): "a" if c in letters else "1" if c in numbers else "\u2603" for c in odd}
        self.odd = frozenset(odd)

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.shown))]


class BytePairs:
    """Ids of pieces of text by the ranks of a byte-level vocabulary, which has every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.edges, self.shorter = {}, {}  # an entry a token at most
        self.fits, self.pieces, self.units = Bounded(), Bounded(), Bounded()

    def merges(self, data: bytes):
        """The parts of ``data`` before and after each merge, with its rank: of neighbours that a token has, the first of the lowest rank."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], -1
        while True:
            yield parts, rank
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not ranked:
                return
            rank, i = min(ranked)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    def edge(self, token: int, end: int) -> list[tuple[bytes, int, float]] | None:
        """What stands at the start (0) or end (-1) of a token while it is merged: (bytes, rank that made it, rank that takes it in).

        None where the merges' ranks don't rise, or don't give the token.
        """
        if (token, end) not in self.edges:
            out: list[tuple[bytes, int, float]] = []
            last, rising, parts = -2, True, []
            for parts, rank in self.merges(self.tokens[token]):
                rising &= rank >= last
                last = rank
                if not out or out[-1][0] != parts[end]:
                    if out:
                        out[-1] = (*out[-1][:2], rank)
                    out.append((parts[end], rank, float("inf")))
            self.edges[token, end] = out if rising and len(parts) == 1 else None
        return self.edges[token, end]

    def fit(self, left: int, right: int) -> bool:
        """Does merging the bytes of both give the two tokens: no merge reaches over the border.

        One does where, when it is due, both parts at the border are still there. Of equal ranks the left one comes first.
        """
        known = self.fits.get((left, right))
        if known is None:
            ranks, ends, starts = self.ranks, self.edge(left, -1), self.edge(right, 0)
            if ends is None or starts is None:
                a, b = self.tokens[left], self.tokens[right]
                known = [parts for parts, _ in self.merges(a + b)][-1] == [a, b]
            else:
                known = True
                for x, made_x, taken_x in ends:
                    for y, made_y, taken_y in starts:
                        due = ranks.get(x + y)
                        if due is not None and taken_x > (due := max(due, made_x, made_y)) and taken_y >= due:
                            known = False
            self.fits.put((left, right), known)
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 for a single byte."""
        if token not in self.shorter:
            data = self.tokens[token]
            self.shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return self.shorter[token]

    def piece(self, text: str) -> bytes:
        """The ids (unsigned little-endian 32 bit) of one piece."""
        known = self.pieces.get(text)
        if known is None:
            ids = self.search(text.encode())
            if sys.byteorder == "big":
                ids.byteswap()
            known = ids.tobytes()
            if len(text) < MOST_KEPT_CHARS:
                self.pieces.put(text, known)
        return known

    def search(self, data: bytes) -> array:
        if data in self.ranks:
            return array("I", [self.ranks[data]])
        sizes, fits, n = self.sizes, self.fits, len(data)
        longest = array("i", bytes(4 * n))
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token  # later ends are longer
        dead, out, at, token, last = bytearray(n + 1), array("I"), 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fit = fits.get((last, token))
                    if self.fit(last, token) if fit is None else fit:
                        break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            elif last < 0:
                raise ValueError("no tokens give this piece")
            else:  # nothing leads on from here: step back, and try what is shorter there
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                token = self.next_shorter(token)
        return out

    def encode(self, text: str, splitter: Splitter) -> bytes:
        out = []
        for part in slices(text):
            for unit in units(part, splitter):
                known = self.units.get(unit)
                if known is None:
                    known = b"".join(map(self.piece, splitter.pieces(unit)))
                    if len(unit) < MOST_KEPT_CHARS:
                        self.units.put(unit, known)
                out.append(known)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as unknown:
            raise ValueError(f"the vocabulary has no id {unknown}") from None


def slices(text: str):
    """Consecutive parts of a text, cut before a single blank between two other characters: no match crosses that."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + SLICE_CHARS) if at + SLICE_CHARS < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def units(part: str, splitter: Splitter) -> list[str]:
    """A part as units that no match crosses: words with the blank before them, or else the matches themselves."""
    if _WHITE_TWICE.search(part):
        return splitter.pieces(part)
    first, *rest = part.split(" ")
    return [first, *(" " + word for word in rest)] if first else [" " + word for word in rest]


_KNOWN: dict = CACHES.setdefault("byte_bpe", {})


def _known(kind, key: str):
    if (kind, key) not in _KNOWN:
        _KNOWN[kind, key] = BytePairs(read_ranks(key)) if kind is BytePairs else kind(key)
    return _KNOWN[kind, key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text, packed as unsigned little-endian 32-bit numbers.

    Each match of ``pattern`` is encoded by itself; it must be one whose matches take in a blank in
    front of a word only as their first character, as those of public byte-level vocabularies do.
    A null or empty text has no ids. Special tokens aren't known: their strings are text. Rows that
    repeat are encoded each, a null id stays, an empty table gives no rows; other columns play no part.
    A text's ids are one value, so they are held whole; nothing else grows with the text.
    """
    Scratch(docs.sparkSession, "bpe")  # small batches to the workers
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        pairs, split = _known(BytePairs, ranks_path), _known(Splitter, pattern)
        for batch in batches:
            ids = [pairs.encode(text.decode(), split) for text in bytes_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(light(run, "byte_bpe"), "doc_id long, ids binary")


def decoded(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that their packed ids stand for; null ids give null, an unknown id fails."""
    at, schema = rows.columns.index(ids_col), rows.withColumn(out_col, F.lit(None).cast("binary")).schema

    def run(batches):
        pairs = _known(BytePairs, ranks_path)
        for batch in batches:
            out = [None if ids is None else pairs.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(light(run, "byte_bpe"), schema)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)
    hashed = rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decoded(hashed, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
