"""Importance resampling, repair of conversations, byte-level BPE."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from folio.llm import byte_bpe, conversations, queries, resampling

TABLES = ["documents", "benchmark", "conversations"]


def held_against(spark, name, tables, tmp_path):
    """Runs a query and its SQL on small tables."""
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    df = queries.QUERIES[name](spark, str(tmp_path))
    got = sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        found = db.execute(queries.ORACLE_SQL[name])
        at = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
        want = sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
    assert got == want
    return got


# --- importance resampling ----------------------------------------------------------------


def test_runs_of_words():
    """The ring gives the CRC-32 of every run of 1 to n words, also where a text is worked on in slices."""
    text = " ".join(f"Wörd{i % 7}, x{i}" for i in range(500)).encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    for n in (1, 2, 4):
        got = [s for _, states in resampling.ring_states(resampling.words_in(text), n) for s in states]
        want = [zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]
        assert sorted(got) == sorted(want)
    held = resampling.SLICE_BYTES
    try:
        resampling.SLICE_BYTES = 11
        assert [s for _, states in resampling.ring_states(resampling.words_in(text), 3) for s in states] == [
            zlib.crc32(b" ".join(words[i - k + 1 : i + 1])) for i in range(len(words)) for k in (3, 2, 1) if i - k + 1 >= 0
        ]
    finally:
        resampling.SLICE_BYTES = held


def test_resampling_small(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Alpha", "beta", "Gamma9", "é", "x_y"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(60, None, 1), (61, "", 1), (62, " .;", 1), (None, texts[3] + " more words", 1), (3, texts[3], 1), (3, texts[3], 1), (63, "word " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(5)
    target = spark.createDataFrame([("beta beta",), (None,), ("é",)], "text string")
    for n in (1, 3):
        buckets = 50
        runs = lambda t: [zlib.crc32(b" ".join(w[i : i + k])) % buckets for w in [re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())] for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]  # noqa: E731, B023
        own = {r: runs(r) for r in {t for _, t, _ in rows}}
        s, t = np.zeros(buckets), np.bincount(runs("beta beta") + runs("é"), minlength=buckets)
        for _, text, _ in rows:
            s += np.bincount(np.array(own[text], int), minlength=buckets)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
        want = []
        for i, text, _ in rows:
            h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
            weight = sum(gain[b] for b in own[text]) // len(own[text]) if own[text] else 0
            n_words = len(re.findall(r"[0-9a-zA-Zé]+", text or ""))
            want.append((i, len(own[text]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words))
        able = sorted((x for x in want if x[4] >= 10), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
        most = 30 * len(able) // 100
        got = [tuple(r) for r in resampling.resampled(docs, target, n, buckets, share=30, least_words=10, seed=7).collect()]
        assert sorted(map(str, (r[:4] for r in got))) == sorted(map(str, (x[:4] for x in want)))
        assert [(r[0], r[3]) for r in sorted((r for r in got if r[4]), key=lambda r: r[4])] == [(x[0], x[3]) for x in able[:most]]
        assert sorted(r[4] for r in got if r[4]) == list(range(1, most + 1))


def test_resampling_against_sql(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("The quick brown Fox jumps Über the 3rd lazy-dog, o'clock".split()) for _ in range(rng.randrange(0, 50)))) for i in range(200)] + [(200, None), (201, ""), (202, "a_b\tc\nd")]
    got = held_against(spark, "op11_importance_resampling", {"documents": spark.createDataFrame(rows, "doc_id long, text string"), "benchmark": spark.createDataFrame([(1, "lazy fox"), (2, None)], "item_id long, text string")}, tmp_path)
    assert len(got) == 203


def test_resampling_prefers_the_target(spark):
    """Of documents of two kinds, those of the target's words are drawn."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"] if i % 10 == 0 else ["one", "two", "three"]) for _ in range(40))) for i in range(400)]
    got = resampling.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("red green blue blue green red " * 30,)], "text string"), share=10).where("rank is not null").collect()
    assert len(got) == 40 and sum(r["doc_id"] % 10 == 0 for r in got) >= 36


def test_resampling_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none).count() == 0
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in resampling.resampled(one, none, share=100).collect()] == [(1, 30, math.floor(1000 * math.log(10030 / (31 * 10000))))]


# --- repair of conversations --------------------------------------------------------------


def brute_repair(rows):
    """The cheapest edits of [(role, text, fault)] by trying them all, and the repaired rows."""
    best = None
    n = len(rows)
    for inserts in range(0, 5):
        for letters in itertools.product("KRD", repeat=n):
            if any(f in ("blank", "duplicate") and e != "D" for e, (_, _, f) in zip(letters, rows)):
                continue
            for gaps in itertools.combinations_with_replacement(range(n + 1), inserts):
                edits = "".join("I" * gaps.count(i) + (letters[i] if i < n else "") for i in range(n + 1))
                cost = 2 * inserts + sum({"K": 0, "R": 2, "D": 3}[e] + (e != "D" and f == "truncated") for e, (_, _, f) in zip(letters, rows))
                if best and (cost, edits) >= best[:2]:
                    continue
                out, row = [], iter(rows)
                for e in edits:
                    role, text, _ = next(row) if e != "I" else ("", "", "")
                    if e == "D":
                        continue
                    if e != "K":
                        starts = [x for x in out if not x[0].startswith("s")]
                        role = "assistant" if len(starts) % 2 else "user"
                        text = text if e == "R" else ""
                    out.append((role, text))
                if re.fullmatch("(s?(ua)+)?", "".join((r or "-")[0] for r, _ in out)):
                    best = (cost, edits, out)
    return best


def brute_report(rows):
    """Of one conversation's [(turn, role, text)]."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, told = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        told.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    counts = [sum(f == name for _, _, f in told) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    cost, edits, out = brute_repair(told)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, edits, sha)


@pytest.mark.parametrize("piece_bits", [10, 1])
def test_repairs_against_all_edits(spark, piece_bits):
    rng = random.Random(piece_bits)
    roles, texts = ["system", "user", "assistant", "tool", "", "ai"], ["Yes.", "No!", "cut off", "", " \n", "Well?  "]
    convs = {i: [(rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(roles[: 3 + i % 4]), rng.choice(texts)) for _ in range(rng.randrange(1, 6))] for i in range(60)}
    convs[None] = [(1, "user", "a."), (1, "user", "a.")]
    data = [(c, *r, 7) for c, rows in convs.items() for r in rows]
    rng.shuffle(data)
    repairs = conversations.Repairs(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, place int").repartition(3), piece_bits=piece_bits)
    sha = {r[0]: r[1] for r in repairs.digests().collect()}
    got = {r["conv_id"]: (*tuple(r)[1:], sha[r["conv_id"]]) for r in repairs.report().collect()}
    assert got == {c: brute_report(rows) for c, rows in convs.items()}
    out = {}
    for r in sorted(repairs.rows().collect(), key=lambda r: (r["position"], r["part"])):
        out.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(out.get(c, [])).encode()).hexdigest() for c in convs} == sha


def test_layers_are_shared():
    """A prefix's layers are computed once; the order of edits is that of the text, prefix or not."""
    walk = conversations.Walk(0)
    walk.to("suaua")
    held = walk.layers[:]
    walk.to("suaUu")
    assert walk.layers[:4] == held[:4] and len(walk.layers) == 6
    for signature in map("".join, itertools.product("suA-o", repeat=4)):
        walk.to(signature)
        cost, state = conversations.best_end(walk.ends())
        kinds = [("system" if x == "s" else "user" if x == "u" else "assistant" if x in "aA" else "o", "t", {"-": "blank", "A": "truncated"}.get(x)) for x in signature]
        assert (cost, walk.edits(state) + conversations._ENDS[state]) == brute_repair(kinds)[:2], signature


def test_one_hot_conversation(spark):
    """A conversation of very many rows is worked on in pieces, dealt over the tasks; a long text is no matter."""
    data = [(1, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(30_000)] + [(2, 0, "user", "x" * 2_000_000 + "."), (2, 1, "assistant", "y.")]
    repairs = conversations.Repairs(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in repairs.report().collect()}
    assert got[1]["audit"].count("K") == 30_000 and got[1]["audit"] == "I" + "K" * 30_000 + "I"
    assert (got[2]["audit"], got[2]["cost"]) == ("KK", 0)
    assert repairs.pieces.where("conv_id = 1").count() >= 29
    assert repairs.rows().where("conv_id = 1").count() == 30_002


def test_repairs_against_sql(spark, tmp_path):
    rng = random.Random(9)
    data = [(c if c else None, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", None]), rng.choice(["Yes. Go!", "cut", None, " ", "Ünder?", f"{c}!"])) for c in range(150) for _ in range(rng.randrange(1, 12))]
    assert len(held_against(spark, "op12_conversation_repair", {"conversations": spark.createDataFrame(data, "conv_id long, turn long, role string, text string")}, tmp_path)) == 150


def test_conversations_empty(spark, tmp_path):
    assert held_against(spark, "op12_conversation_repair", {"conversations": spark.createDataFrame([], "conv_id long, turn long, role string, text string")}, tmp_path) == []


# --- byte-level BPE -----------------------------------------------------------------------


def vocabulary(name):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path(name))
    return P.path(name), P.PATTERN, ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(rng, tokens, n):
    for i in range(n):
        kind = i % 6
        if kind == 0:
            yield "".join(chr(rng.choice([32, 32, 9, 10, 0xA0, 97, 98, 99, 0x3B1, 0x4E2D, 39, 115, 46, 48, 0x1C, 0x85])) for _ in range(rng.randint(0, 40)))
        elif kind == 1:
            yield "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))
        elif kind == 2:
            yield b"".join(rng.choice(tokens) for _ in range(rng.randint(0, 12))).decode("utf-8", "replace")
        elif kind == 3:
            yield "".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 20)))
        elif kind == 4:
            yield rng.choice("aAé=- \n") * rng.randint(0, 300) + rng.choice("ab ") * rng.randint(0, 9)
        else:
            yield "<|endoftext|>".join(rng.choice(["", "I'll", " don't", "don'T x"]) for _ in range(3))


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_is_tiktokens(name):
    _, pattern, ranks, public = vocabulary(name)
    pairs, splitter, rng = byte_bpe.BytePairs(ranks), byte_bpe.Splitter(pattern), random.Random(5)
    for text in odd_texts(rng, list(ranks), 6000):
        ids = pairs.encode(text, splitter)
        assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(text), repr(text)
        assert pairs.decode(ids) == text.encode()


def test_bpe_of_vocabularies_with_odd_ranks():
    """Neighbours are right also where merges don't come by rising ranks, or a token isn't reached by merging."""
    import tiktoken

    rng = random.Random(8)
    for turn in range(40):
        made = {bytes([b]) for b in range(256)}
        while len(made) < 256 + 25:
            made.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))))
        order = sorted(made, key=lambda t: (len(t) > 1, rng.random()))
        ranks = {t: i for i, t in enumerate(order)}
        public = tiktoken.Encoding(f"odd{turn}", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        pairs = byte_bpe.BytePairs(ranks)
        for _ in range(150):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
            want = public.encode_ordinary(text)
            try:
                got = pairs.search(text.encode()).tolist()
            except ValueError:
                got = None
            # the search stands on merges that give the same for a part as for the whole
            if got is not None and all(pairs.fit(a, b) for a, b in zip(want, want[1:])):
                assert got == want, (text, got, want)


def test_bpe_long_piece_in_linear_time():
    import time

    _, pattern, ranks, public = vocabulary("byte_bpe_multi_50k.tiktoken")
    pairs, splitter = byte_bpe.BytePairs(ranks), byte_bpe.Splitter(pattern)
    rng = random.Random(3)
    text = "".join(rng.choice("aehinst") for _ in range(200_000))
    took = []
    for part in (text[:50_000], text):
        began = time.time()
        pairs.encode(part, splitter)
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 1  # four times the text; the first one also fills the memory of neighbours
    assert np.frombuffer(pairs.encode(text[:3000], splitter), "<u4").tolist() == public.encode_ordinary(text[:3000])
    spread = ("word " * 300_000)[:1_200_001]
    assert np.frombuffer(pairs.encode(spread, splitter), "<u4").tolist() == public.encode_ordinary(spread)


def test_bpe_rows(spark):
    path, pattern, _, public = vocabulary("byte_bpe_multi_50k.tiktoken")
    texts = ["", None, "Hello  world", "x" * 50_000, "<|endoftext|>", "né \U0003f9ec룾"]
    rows = [(i, t, b"z") for i, t in enumerate(texts)] + [(None, "again", b"z"), (2, "Hello  world", b"z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    out = byte_bpe.decoded(byte_bpe.encoded(df, path, pattern), path).collect()
    assert sorted((str(r[0]), np.frombuffer(bytes(r[1]), "<u4").tolist(), bytes(r[2])) for r in out) == sorted((str(i), public.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert byte_bpe.encoded(df.where("false"), path, pattern).count() == 0
    ids = spark.createDataFrame([(1, None), (2, b"")], "n int, ids binary")
    assert sorted((r[0], r[2]) for r in byte_bpe.decoded(ids, path).collect()) == [(1, None), (2, b"")]
    with pytest.raises(Exception, match="no id"):
        byte_bpe.decoded(spark.createDataFrame([(1, b"\xff\xff\xff\xff")], "n int, ids binary"), path).collect()


def test_op13_against_tiktoken(spark, data):
    _, _, _, public = vocabulary("byte_bpe_multi_50k.tiktoken")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_byte_bpe"](spark, data).collect()}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{data}/documents.parquet'").fetchall():
        ids = public.encode_ordinary(text)
        assert got[doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# --- pseudonyms ---------------------------------------------------------------------------


@pytest.mark.parametrize("unit", ["a", "aB3", "0", "f0", "A", "+", "-", ".", "a.", "@", "a@", "a@1.", " ", "1 ", "12-", "token", "token ", "AKIA", "(", "/", "=", "é", "_", "AB12 ", "1.", "x-"])
def test_patterns_are_linear(unit):
    """A megabyte of one class of characters, as base64, hex or a line of signs has it, takes about four times what a quarter takes."""
    import time

    from folio.llm.pseudonyms import pseudonymised

    took = []
    for size in (1 << 18, 1 << 20):
        text = (unit * (size // len(unit) + 1))[:size] + " end a.b@example.org"
        began = time.process_time()
        new, counts = pseudonymised(text, b"k" * 32)
        took.append(time.process_time() - began)
        assert counts.get("mail", 0) >= 1 and len(new) == len(text)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 12


def test_key_is_kept_in_the_shared_folder(spark):
    from folio.llm import pseudonyms

    key = pseudonyms.key_of(spark)
    assert len(key) == 32 and pseudonyms.key_of(spark) == key
    spark.conf.set(pseudonyms.KEY_CONF, "own")
    try:
        assert pseudonyms.key_of(spark) == b"own"
    finally:
        spark.conf.unset(pseudonyms.KEY_CONF)


# --- archives -----------------------------------------------------------------------------


def test_archives_are_read_once():
    """Records in ranges: each once, and little more than the file's bytes read."""
    import gzip
    import io
    import os

    from folio.llm import warc

    r = random.Random(5)
    blocks = [os.urandom(r.choice([10, 900, 4000])) + b"x" * r.choice([0, 200_000]) for _ in range(1500)] + [os.urandom(3_000_000)]
    file = b"".join(gzip.compress(b"WARC/1.1\r\nWARC-Record-ID: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(b)) + b + b"\r\n\r\n", mtime=0) for i, b in enumerate(blocks))

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            out = super().read(size)
            Counted.n += len(out)
            return out

    for step in (len(file), 1 << 22):
        Counted.n = 0
        got = [x for a in range(0, len(file), step) for x in warc.records_in(Counted(file), a, min(a + step, len(file)))]
        assert [int(h["warc-record-id"]) for _, h, _ in got] == list(range(len(blocks)))
        assert [b for _, _, b in got] == blocks
        assert Counted.n < (1.1 if step == len(file) else 2.5) * len(file)  # a record over a range's end is read by its owner too
