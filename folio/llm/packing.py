"""Packing documents into sequences by bounded-space online best-fit.

A task keeps a fixed number of open bins. A bitset, one bit per free length, says which free
lengths some open bin has; the fitting bin with the least free space is the lowest set bit from
the piece's length on. When too many bins are open, the fullest closes. Pieces meet the bins in
a hashed order, which mixes long and short ones in every task.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, Scratch, bytes_of, light

OPEN_BINS = 8192
TOKENS_PER_TASK = 1 << 25  # 16,384 sequences of 2048: what stays open at a task's end is little beside them

#: White space other than spaces and line feeds.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary, keyed by the byte."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _splits_at_blanks(tokenizer) -> bool:
    """Is this a byte-level BPE without normaliser that splits text by the usual pattern."""
    told = json.loads(tokenizer.to_str())
    before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(plain) and not told.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")


class UnitIds(dict):
    """Ids of the units of a text (unsigned little-endian 32 bit), kept from text to text.

    A byte-level BPE with the usual split pattern never merges over a single space or line feed
    between words, nor between a letter or digit and the punctuation behind it. So a text is the
    concatenation of its units: "\\nx" stands for a line feed and x, any other "x" for a space and
    x. Texts with other white space are encoded whole. So are all texts of a tokenizer with other
    settings: its own, read from it, say whether this holds.
    """

    def __init__(self, tokenizer, most: int = 450_000):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.line_feed = tokenizer.encode("\n", add_special_tokens=False).ids
        self.in_units = _splits_at_blanks(tokenizer) and len(self.line_feed) == 1
        self.letters = _byte_letters()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, units: list[str]) -> None:
        """Ids of new units: all in one text, a line each."""
        for at in range(0, len(units), 20_000):
            part = units[at : at + 20_000]
            ids = np.asarray(self.tokenizer.encode("\n".join(u[1:] if u[0] == "\n" else " " + u for u in part), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_feed[0]), len(ids))
            if len(ends) != len(part):  # a unit took in a line feed: each by itself
                for u in part:
                    ids = self.tokenizer.encode(u if u[0] == "\n" else " " + u, add_special_tokens=False).ids
                    self[u] = np.asarray(ids, "<u4").tobytes()
                continue
            start, code, feed = 0, ids.tobytes(), np.asarray(self.line_feed, "<u4").tobytes()
            for u, end in zip(part, ends.tolist()):
                self[u] = (feed if u[0] == "\n" else b"") + code[4 * start : 4 * end]
                start = end + 1

    def _words(self, units: list[str], lead: str, feed: bytes) -> None:
        """Ids of new units that the split pattern leaves whole (letters behind ``lead``), by the model alone."""
        if not units:
            return
        # the bytes' printable characters, for all units in one go
        shown = "\n".join(lead + u.removeprefix("\n") for u in units).encode().decode("latin-1").translate(self.letters)
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], []
        for text in shown.split(self.letters[10]):
            ids += [t.id for t in tokenize(text)]
            ends.append(4 * len(ids))
        code = np.asarray(ids, "<u4").tobytes()
        self.update((u, feed + code[a:b]) for u, a, b in zip(units, [0, *ends], ends))

    def _missing(self, new: set[str]) -> None:
        """Adds units; those with punctuation behind a known word need no new encoding."""
        words = set(filter(str.isalpha, new))  # most of them
        split, rest = [], set()
        for u in new - words:
            base = u.rstrip(".,;:!?$&%*#|")
            if base and base != u and base[-1].isalpha():
                tail = "\n" + u[len(base) :]
                split.append((u, base, tail))
                if base not in self:
                    (words if base.isalpha() else rest).add(base)
                if tail not in self:
                    rest.add(tail)
            else:
                rest.add(u)
        starts = [u for u in rest if u[0] == "\n" and u[1:].isalpha()]
        self._words(list(words), " ", b"")
        self._words(starts, "", np.asarray(self.line_feed, "<u4").tobytes())
        self._learn(list(rest.difference(starts)))
        for u, base, tail in split:
            self[u] = self[base] + self[tail][4:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts; equal to encoding each in one go."""
        if not self.in_units:
            return [self.whole(t) for t in texts]
        odd = {i for i, t in enumerate(texts) if not t or _ODD.search(t)}
        units = [[] if i in odd else ("\n" + t).replace("\n", " \n").split(" ")[1:] for i, t in enumerate(texts)]
        every = set().union(*units)
        if "" in every or "\n" in every:  # white space that isn't single
            for i, us in enumerate(units):
                if "" in us or "\n" in us:
                    odd.add(i)
                    units[i] = []
            every = set().union(*units)
        new = every - self.keys()
        if len(self) + len(new) > self.most:  # what this text has stays: common words are in it
            kept = {u: self[u] for u in every - new}
            self.clear()
            self.update(kept)
        if new:
            self._missing(new)
        out = [b"".join(map(self.__getitem__, us))[4:] for us in units]
        for i in odd:
            out[i] = self.whole(texts[i])
        return out


def _known(path: str) -> UnitIds:
    if path not in _KNOWN:
        _KNOWN[path] = UnitIds(load_tokenizer(path))
    return _KNOWN[path]


def load_tokenizer(path: str):
    """A tokenizer file as the public ``tokenizers`` library reads it; special strings in a text are text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: One for each tokenizer in a Python worker, which serves many tasks.
_KNOWN: dict[str, UnitIds] = CACHES.setdefault("packing", {})


def _pieces(path: str, size: int, end_id: int):
    def run(batches):
        known, end = _known(path), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [t.decode() for t in bytes_of(batch.column("text"))]
            out: list[tuple] = []
            step, held = [], 0
            for i, text in enumerate(texts):  # at most about 4 MB of text at a time
                step.append(i)
                held += len(text)
                if held < 4_000_000 and i + 1 < len(texts):
                    continue
                for j, code in zip(step, known.encode([texts[j] for j in step])):
                    code += end
                    n = len(code) // 4
                    first = n if n <= size else (n % size or size)
                    starts = [0, *range(first, n, size)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        out.append((ids[j], k, a, b - a, zlib.crc32(code[4 * a : 4 * b])))
                step, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Bins:
    """Open bins of one task."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
        self.bits, self.open, self.made = 0, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece: best fit among the open bins, or a new bin."""
        fitting = self.bits >> length
        if fitting:
            space = length + ((fitting & -fitting).bit_length() - 1)
            place = self.free[space].pop()
            if not self.free[space]:
                self.bits ^= 1 << space
        else:
            space, place = self.size, self.made
            self.made += 1
            self.open += 1
        left = space - length
        if left:
            self.free[left].append(place)
            self.bits |= 1 << left
            if self.open > self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.free[fullest].pop()
                if not self.free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
        else:
            self.open -= 1
        return place, self.size - space


def _pack(size: int, most: int):
    def run(batches):
        bins, task = Bins(size, most), TaskContext.get().partitionId()
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            if placed:
                made, offset = zip(*placed)
                sequence = pa.array((np.asarray(made, np.int64) | (task << 40)))
                yield pa.RecordBatch.from_arrays([*batch.columns, sequence, pa.array(offset, pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, size: int, open_bins: int = OPEN_BINS, tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """``pieces`` (doc_id, piece, length <= size, ...) with sequence_id and offset."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // tokens_per_task))
    order = F.xxhash64("doc_id", "piece")
    dealt = pieces.repartition(tasks, order).sortWithinPartitions(order, "doc_id", "piece", "start", "ids_crc32")
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"
    return dealt.mapInArrow(light(_pack(size, open_bins)), schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, tokens_per_task: int = TOKENS_PER_TASK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and one ``end_id``; one longer than ``size`` is cut into pieces of
    ``size``, the first of which may be shorter. A null or empty text is the end id alone. A null
    id is packed like any other; rows that repeat a document are packed each. An empty table
    gives no rows. Other columns play no part.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return pack(scratch.save(rows.mapInArrow(light(_pieces(tokenizer_path, size, end_id), "packing"), PIECES), "pieces"), size, open_bins, tokens_per_task)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
