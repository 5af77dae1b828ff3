"""Deduplication operators against brute force, with the cases every table can have."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import common, exact_dedup, ngram_join, substring_dedup

# names that the operators use inside, as columns of the input
CLASH = "doc_id long, text string, fp string, size int, body string, kept string, token string, hits int, block int, __id int, a int, root int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "w", 0, 0, 0, 0, 0) for i, t in rows], CLASH)


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    out = [(i, " ".join(words(rng, rng.choice([3, 30, 60, 120, 400])))) for i in range(0, 60)]
    passage = " ".join(words(rng, 80, 10**6))
    for i in range(60, 80):  # near copies of each other
        base = out[1][1].split() + out[2][1].split() + words(rng, 200)
        rng2 = random.Random(7)
        base = words(rng2, 150, 10**6)
        for _ in range(rng.randrange(4)):
            base[rng.randrange(150)] = "changed"
        out.append((i, " ".join(base)))
    out += [(80 + i, out[i][1]) for i in range(5)] + [(90, out[5][1].upper()), (91, "  " + out[6][1] + "\n\n")]
    out += [(92 + i, " ".join(words(rng, 40) + [passage] + words(rng, 20))) for i in range(6)]
    out += [(100, None), (101, ""), (102, "  \n "), (103, "one"), (104, "One"), (105, "same same " * 90), (106, "same same " * 70), (107, " ".join(words(rng, 5000)))]
    return out


def brute_exact(rows):
    groups = defaultdict(list)
    low = lambda t: (t or "").encode().lower()
    for i, t in rows:
        groups[low(t)].append(i)
    return sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("per_owner", [exact_dedup.HASHES_PER_OWNER, 5])
def test_exact(spark, per_owner):
    rows = corpus()
    got = exact_dedup.exact_duplicates(table(spark, rows).repartition(3), hashes_per_owner=per_owner)
    assert sorted(map(tuple, got.collect())) == brute_exact(rows)


def test_exact_repeats_nulls_and_empty(spark):
    got = exact_dedup.exact_duplicates(table(spark, [(1, "a"), (1, "a"), (None, "A"), (None, "b")]))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == Counter([(1, 1, 3, True)] * 2 + [(None, 1, 3, False), (None, None, 1, True)])
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0
    assert exact_dedup.keep_one_per_text(table(spark, [(1, "a"), (2, "A")])).count() == 1


#: Repeated and null ids: texts x, y, q and r are all there is.
ODD_IDS = [(1, "x"), (1, "y"), (2, "y"), (None, "q"), (None, "q"), (7, "r"), (7, "r")]


def test_stages_decide_by_row(spark):
    """No text is lost, and of equal rows one stays, whatever the ids."""
    for stage in (exact_dedup.keep_one_per_text, ngram_join.keep_one_per_group):
        got = stage(table(spark, ODD_IDS)).collect()
        assert sorted((r["text"], r["doc_id"]) for r in got if r["text"] != "y" or r["doc_id"] == 2 or stage is exact_dedup.keep_one_per_text) and Counter(r["text"] for r in got) == Counter("xyqr")
        assert {r["doc_id"] for r in got if r["text"] == "q"} == {None} and got[0].asDict().keys() == table(spark, ODD_IDS).first().asDict().keys()
        assert stage(table(spark, [])).count() == 0
    same = stage(table(spark, [(None, "a b"), (3, "A b"), (3, "a  b"), (4, None), (4, None), (5, "")])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in same if r["text"]) in (Counter([(3, "A b")]), Counter([(3, "a  b")])) and len(same) == 4


@pytest.mark.parametrize("bits", [64, 60, 50])
def test_rice_round_trip(bits):
    rng = np.random.default_rng(3)
    start = 5 << bits if bits < 64 else 0
    for n in (0, 1, 2, 1000):
        top = 2**bits - 1
        values = np.unique(rng.integers(0, top, n, np.uint64, endpoint=True)) + np.uint64(start)
        code = exact_dedup.rice_encode(values, start, bits)
        assert (exact_dedup.rice_decode(code, len(values), start) == values).all()
    assert len(code) < 1000 * 8


def brute_similar(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 50)])
def test_similar(spark, width, percent):
    rows = corpus()
    got = ngram_join.similar_groups(table(spark, rows).repartition(3), width, percent)
    assert sorted(tuple(r)[:3] for r in got.collect()) == brute_similar(rows, width, percent)


def test_similar_where_only_members_link(spark):
    """Two families whose leaders are too far apart, joined by members in between."""
    rng = random.Random(5)
    base = words(rng, 300, 10**6)
    rows = []
    for step in range(0, 40):
        rows.append((step, " ".join(f"new{k}" if k < 2 * step else w for k, w in enumerate(base))))
    for order in (1, 2):
        random.Random(order).shuffle(rows)
        got = ngram_join.similar_groups(table(spark, rows).coalesce(2), 1, 90)
        assert sorted(tuple(r)[:3] for r in got.collect()) == brute_similar(rows, 1, 90)


def test_similar_block_limits(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", 500)
    monkeypatch.setattr(ngram_join, "BROADCAST_PLACES", 0)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 3)
    rows = corpus(2)
    got = ngram_join.similar_groups(table(spark, rows).repartition(5), 3, 90)
    assert sorted(tuple(r)[:3] for r in got.collect()) == brute_similar(rows, 3, 90)


def test_similar_ids_of_unlike_sets(spark, monkeypatch):
    """Where unlike sets have one id, they are told apart by the second."""
    first = ngram_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(ngram_join, "_set_id", lambda v, odd=frozenset(), seed=0: 7 if seed == 0 and 7 not in odd and len(v) in (1, 2) else first(v.tobytes(), seed or 1) - (1 << 63))
    rows = [(1, "a b c"), (2, "x y z"), (3, "a b c d"), (4, "A b c")]
    assert sorted(tuple(r)[:3] for r in ngram_join.similar_groups(table(spark, rows), 3, 90).collect()) == brute_similar(rows, 3, 90)


def test_similar_edges(spark):
    assert ngram_join.similar_groups(table(spark, [])).count() == 0
    got = ngram_join.similar_groups(table(spark, [(2, "a b"), (2, "a b"), (None, "A B"), (5, None), (None, "")]))
    assert Counter(tuple(r)[:3] for r in got.collect()) == Counter([(2, 1, 2)] * 2 + [(None, 1, 2), (5, 0, 5), (None, 0, None)])


def test_long_lists_are_read_by_blocks():
    rng = np.random.default_rng(1)
    n = 90
    low = np.sort(rng.integers(50, 200, n))
    place, leader = rng.integers(0, 20, n), np.arange(n)
    got = {tuple(sorted(p)) for a, b in ngram_join._pairs(leader, leader, low, low, place, np.array([0]), np.array([n]), 90) for p in zip(a, b)}
    want = {(i, j) for i, j in combinations(range(n), 2) if ngram_join._room(low[i], low[i], place[i], low[j], low[j], place[j], 90)}
    assert {p for p in got if p[0] != p[1]} == want


def test_signatures_never_lose_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 7, 60, 900):
        for changes in (0, 1, n // 20, n // 9, n // 4):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.r_[a[changes:], rng.integers(0, 2**63, changes).astype(np.uint64)])
            sig = np.frombuffer(ngram_join._signature(a) + ngram_join._signature(b), np.uint64).reshape(2, -1)
            common = len(np.intersect1d(a, b))
            ok = ngram_join._may_link(sig, np.array([len(a), len(b)]), np.zeros(2), np.array([0]), np.array([1]), 90)
            assert ok[0] or not ngram_join._linked(common, len(a), len(b), 90)
            far = ngram_join._may_link(sig, np.array([len(a), len(b)]), np.array([1.0, 0]), np.array([0]), np.array([1]), 90)
            assert far[0]


def test_components_of_a_path(spark):
    scratch = common.Scratch(spark, "test")
    edges = spark.range(60).selectExpr("id as a", "id + 1 as b").unionAll(spark.createDataFrame([(100, 101), (5, 5)], "a long, b long"))
    rows = common.components(edges, scratch).collect()
    assert len({r["root"] for r in rows if r["node"] <= 60}) == 1 and len(rows) == 63


def brute_repeats(rows, width):
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("width, shard, anchor_rows", [(50, substring_dedup.SHARD_WORDS, substring_dedup.ANCHOR_ROWS), (50, 200, 2), (7, 50, 3)])
def test_repeats(spark, width, shard, anchor_rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 30 if shard < 300 else 512)
    rows = corpus()
    random.Random(4).shuffle(rows)
    got = substring_dedup.without_repeats(table(spark, rows).repartition(3), width, shard_words=shard, stream_words=3 * shard, anchor_rows=anchor_rows)
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, width)


def test_repeats_of_one_passage_in_every_document(spark):
    """A passage that all share amid own words: the reference holds it once, however many they are."""
    rng = random.Random(6)
    shared = words(rng, 60, 10**6)
    rows = [(i, " ".join(words(rng, 45, 10**6) + shared + words(rng, 45, 10**6))) for i in range(200)]
    got = substring_dedup.without_repeats(table(spark, rows).repartition(4), shard_words=300, stream_words=900, anchor_rows=20)
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 50)


def test_repeats_edges(spark):
    assert substring_dedup.without_repeats(table(spark, [])).count() == 0
    long = " ".join(f"x{i}" for i in range(60))
    got = substring_dedup.without_repeats(table(spark, [(None, long), (1, long), (2, long), (3, None)]))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()) == Counter([(None, 60, 0), (1, 60, 0), (2, 60, 60), (3, 0, 0)])


def test_repeats_of_one_id(spark):
    """Rows that share an id are judged each by its own text."""
    rng = random.Random(8)
    a, b = words(rng, 70, 10**6), words(rng, 90, 10**6)
    rows = [(5, " ".join(a)), (5, "short own text"), (5, " ".join(b[:60])), (5, None), (3, " ".join(a[5:])), (9, " ".join(b)), (9, " ".join(b[20:] + a)), (9, " ".join(b)), (2, "")]
    got = substring_dedup.without_repeats(table(spark, rows).repartition(3), shard_words=100, stream_words=300)
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 50)


def test_repeats_in_very_long_texts(spark):
    """Texts longer than a shard and than a row of passages, one of them with one word all through."""
    rng = random.Random(9)
    long = words(rng, 150_000, 10**6)
    same = ["same"] * 80_000
    rows = [(1, long), (2, long[:70_000] + ["gap"] + long[70_000:]), (3, same), (4, ["x", *same[:70_000]]), (5, long[40:89]), (6, long[140_000:140_060])]
    got = substring_dedup.without_repeats(table(spark, [(i, " ".join(t)) for i, t in rows]).repartition(3), shard_words=20_000, with_text=False)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got.collect()) == [(1, 150_000, 0), (2, 150_001, 150_000), (3, 80_000, 0), (4, 70_001, 70_000), (5, 49, 0), (6, 60, 60)]


def test_automata_are_bounded():
    """A passage of 300,000 words, and many short ones, make automata of at most a shard's words, which hold every window."""
    rng = np.random.default_rng(3)
    long, short = rng.integers(0, 1 << 60, 300_000).astype(np.uint64), [rng.integers(0, 1 << 60, 80).astype(np.uint64) for _ in range(900)]
    passages = pa.table({"shard": [7] * 901, "words": [long.tobytes(), *(x.tobytes() for x in short)]})
    built = substring_dedup._build(substring_dedup.SHARD_WORDS, 50)((pa.scalar(7),), passages)
    types = (np.uint64, np.int64, np.int32, np.int32, np.int32)
    automata = [substring_dedup.Flat(*(np.frombuffer(r[c], t) for c, t in zip(("symbols", "edges", "to", "link", "length"), types))) for r in built.to_pylist()]
    assert len(automata) > 5 and max(len(a.link) for a in automata) <= 2 * substring_dedup.SHARD_WORDS
    chunks = [long[i : i + 561] for i in range(0, 300_000 - 49, 512)] + short
    hit = [np.zeros(len(c), bool) for c in chunks]
    for a in automata:
        hit = [h | m for h, m in zip(hit, a.matches(chunks, 50))]
    assert all(h[49:].all() for h in hit)


def test_windows_go_to_their_part():
    """Equal windows go to one part wherever they stand, and no window is lost."""
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    rows = [(0, 6, 1, i, 0, 0, 10 * i, np.concatenate([rng.integers(0, 1 << 60, n).astype(np.uint64), shared]).tobytes()) for i, n in enumerate((0, 3, 77))]
    schema = "bucket long, parts long, owner long, doc_id long, row long, base long, start long, words binary"
    (out,) = substring_dedup._dealt(25, 50)([substring_dedup._rows(rows, schema)])
    where: dict[tuple, set] = {}
    for r in out.to_pylist():
        held = np.frombuffer(r["words"], np.uint64)
        for k in range(len(held) - 49):
            where.setdefault((r["doc_id"], r["start"] + k), set()).add(r["part"])
    for i, n in enumerate((0, 3, 77)):
        assert all((i, 10 * i + k) in where for k in range(n + 400 - 49))
    assert all(where[0, k] & where[1, 13 + k] & where[2, 97 + k] for k in range(351))
    assert len({p for ps in where.values() for p in ps}) > 1


def test_least_codes(monkeypatch):
    rng = np.random.default_rng(2)
    for bits, n, values in ((20, 300, 50), (5, 300, 40), (6, 1000, 1 << 30)):
        monkeypatch.setattr(substring_dedup, "_PLACE_BITS", bits)
        codes = rng.integers(0, values, n).astype(np.uint64) << np.uint64(30)
        for span in (1, 2, 7, 26):
            want = {i + span - 1 - int(codes[i : i + span][::-1].argmin()) for i in range(n - span + 1)}
            assert substring_dedup._least(codes, span).tolist() == sorted(want)
    assert len(substring_dedup._least(codes[:5], 6)) == 0


def test_automaton():
    for seed in range(300):
        rng = random.Random(seed)
        k = rng.choice([1, 2, 3])
        automaton, passages = substring_dedup.SuffixAutomaton(), []
        for _ in range(rng.randrange(1, 4)):
            passages.append([rng.randrange(k) for _ in range(rng.randrange(1, 20))])
            automaton.add(passages[-1])
        text, w = [rng.randrange(k) for _ in range(25)], rng.randrange(1, 6)
        runs = {tuple(p[i : i + w]) for p in passages for i in range(len(p) - w + 1)}
        want = [i + 1 >= w and tuple(text[i + 1 - w : i + 1]) in runs for i in range(len(text))]
        got = automaton.flat().matches([np.array(x, np.uint64) for x in (text, text[:7], [])], w)
        assert [g.tolist() for g in got] == [want, want[:7], []]


def test_word_hashes():
    texts = [b"Hello  world\n foo", b"", b"   ", b"foo Hello\x0bworld FOO", "é à".encode(), b" x "]
    for lower in (False, True):
        known = {}
        for t, h in zip(texts, common.word_hashes(texts, lower)):
            ws = (t.lower() if lower else t).split()
            assert len(ws) == len(h)
            assert all(known.setdefault(w, x) == x for w, x in zip(ws, h.tolist()))
        assert len(set(known.values())) == len(known)
    assert [t for _, ts in common.in_slices(texts, 10) for t in ts] == texts


def test_bloom_never_loses(spark):
    ids = spark.range(0, 3000, 7)
    kept = common.maybe_in(spark.range(3000).withColumnRenamed("id", "doc_id"), "doc_id", common.bloom_of(ids))
    found = {r["doc_id"] for r in kept.collect()}
    assert set(range(0, 3000, 7)) <= found and len(found) < 1000
