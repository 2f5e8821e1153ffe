"""Training-data operators against brute force, and on nulls, ties, repeated rows, empty tables and long texts."""

import base64
import collections
import datetime
import hashlib
import html.parser
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from glossweave.llm import bpe, chat, common, components, decontaminate, exact_dedup, html_text, near_dup, pii, pretokens, queries, token_files, toxicity, url_filter, words

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, score double, ids string, leaks string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, None, "x", "y") for i, t in rows], DOCS).repartition(parts)


ODD = [(1, "a b c d e"), (2, None), (3, ""), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "x" * 300_000), (6, "é 🙂 \u2028 <|endoftext|>"), (7, " \n\t "), (8, ("lorem ipsum dolor sit amet " * 5000))]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.randint(3, 120))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(60, 220):
        t = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        rows.append((k, " ".join(t).upper() if k % 9 == 0 else " ".join(t)))
    shared = " ".join(r.choices(vocabulary, k=60))
    rows += [(k, " ".join(r.choices(vocabulary, k=100)) + " " + shared) for k in range(220, 260)]
    return rows


# --- token files and BPE


def _whole(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("name, end", [("byte_bpe_50k.json", 0), ("word_bpe_49k.json", None)])
def test_token_files(spark, name, end):
    path = public_tokenizers.path(name)
    out = common.shared_dir(spark, "t")
    manifest = token_files.write_token_files(docs(spark, ODD), out, path, end_id=end)
    assert manifest["dtype"] == "<u2"
    got = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_token_files(spark, out).collect()]
    encode = _whole(path)
    want = collections.Counter((i, tuple(encode(t or "") + ([] if end is None else [end]))) for i, t in ODD)
    assert collections.Counter((i, tuple(ids)) for i, _, _, ids in got) == want
    got.sort(key=lambda g: g[1])
    assert [g[1] for g in got if g[2]] == [int(x) for x, g in zip(np.concatenate([[0], np.cumsum([g[2] for g in got])]), got) if g[2]]
    keys = [g[0] for g in got if g[2]]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)


def test_token_files_of_nothing(spark):
    out = common.shared_dir(spark, "t")
    token_files.write_token_files(docs(spark, []), out, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, out).count() == 0


def test_op1_against_whole_encoding(spark):
    encode, at, want = _whole(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.asarray(encode(r.text or "") + [0], "<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_files(spark, SF).collect()} == want


def test_matches_agree_with_whole_texts(monkeypatch):
    ids = token_files.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    encode, r = _whole(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    for letters in ("ab Z'sre\n\t 0½²é×_.,!\u00a0\u2003\u0301中🙂\x1c\x85", "a 'srevmtld\n\t9.x", "'sl t", "é' r"):
        texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(500)] + ["", "a", " ", "'", "it's", "x" * 3000]
        for size in (1 << 20, 10):
            monkeypatch.setattr(pretokens, "PIECE", size)
            found, counts = ids.of(texts)
            assert [p.tolist() for p in np.split(found, np.cumsum(counts)[:-1])] == [encode(t) for t in texts]
            ids._forget()


def test_token_files_of_a_failed_attempt(spark):
    out = common.shared_dir(spark, "t")
    fs, root = common.filesystem(out)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/part-000000-999999.bin") as f:
        f.write(b"left by a lost executor")
    rows = [(-(2**63), "least id"), (None, "no id"), (2, "b")]
    token_files.write_token_files(docs(spark, rows), out, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(r.doc_id for r in token_files.read_token_files(spark, out).collect() if r.doc_id is not None) == [-(2**63), 2]
    assert not any("999999" in f.base_name for f in fs.get_file_info(token_files.pafs.FileSelector(root)))


def _tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    rank_file, enc = public_tokenizers.path("byte_bpe_50k.tiktoken"), _tiktoken()
    rows = bpe.bpe_decode(bpe.bpe_encode(docs(spark, ODD), rank_file, piece=1000), rank_file).collect()
    got = collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows)
    assert got == collections.Counter((i, np.asarray(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in ODD)
    assert bpe.bpe_encode(docs(spark, []), rank_file).count() == 0


def test_pieces_end_where_matches_do():
    enc, r = _tiktoken(), random.Random(2)
    for _ in range(300):
        t = "".join(r.choices("ab  \n\t'sé0!\u2003\x1c", k=200))
        assert "".join(bpe.safe_pieces(t, 20)) == t
        assert bpe.encode_text(t, public_tokenizers.path("byte_bpe_50k.tiktoken"), piece=20) == enc.encode_ordinary(t)


def test_ids_inside_a_character_decode(spark):
    df = spark.createDataFrame([(1, np.asarray(_tiktoken().encode_ordinary("🙂")[:1], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.bpe_decode(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert "🙂".encode().startswith(got[1]) and got[1] and got[2] == b""


# --- exact dedup


@pytest.mark.parametrize("memtable, digest_bytes, keep", [(1 << 20, 32, "smallest"), (300, 32, "largest"), (300, 1, "largest")])
def test_exact_dedup(spark, memtable, digest_bytes, keep):
    rows = ODD + [(k, f"t{k % 37}") for k in range(100, 400)] + [(900, "")]
    got = exact_dedup.exact_dedup(docs(spark, rows, 5), keep=keep, memtable_bytes=memtable, digest_bytes=digest_bytes).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    want = collections.Counter()
    for t, ids in groups.items():
        k = pick((i for i in ids if i is not None), default=None)
        want.update((i, k, len(ids), i == k, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert collections.Counter(map(tuple, got)) == want


def test_exact_dedup_of_nothing_and_of_nulls(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in exact_dedup.exact_dedup(docs(spark, [(None, None)])).collect()] == [(None, None, 1, True)]


def test_filter_has_no_false_negatives():
    words_of = lambda name, n: exact_dedup._words(pa.array([hashlib.sha256(f"{name}{k}".encode()).digest() for k in range(n)]))
    own = words_of("", 500)
    f = exact_dedup.Bloom.of(own)
    assert f.has(own).all() and f.has(words_of("x", 1000)).sum() < 60


@pytest.mark.parametrize("fan, digest_bytes", [(8, 32), (2, 32), (2, 1)])
def test_an_index_of_batches_is_one_of_all(spark, monkeypatch, fan, digest_bytes):
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    r = random.Random(12)
    rows = [(k, f"t{r.randrange(150)}" * r.randint(1, 2)) for k in range(500)] + ODD
    r.shuffle(rows)
    folder = common.shared_dir(spark, "index")
    for k in range(0, len(rows), 100):
        index = exact_dedup.DedupIndex(spark, folder, "largest", 2000)  # as a later job opens it
        index.add(exact_dedup.members(docs(spark, rows[k : k + 100]), digest_bytes=digest_bytes))
    if fan == 2:
        assert len(index.state["levels"]) > 2 and all(len(level) < 2 for level in index.state["levels"])
    got = exact_dedup.told(exact_dedup.members(docs(spark, rows), digest_bytes=digest_bytes), exact_dedup.DedupIndex(spark, folder, "largest"))
    want = exact_dedup.exact_dedup(docs(spark, rows), keep="largest")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        exact_dedup.DedupIndex(spark, folder, "smallest")


def test_different_bodies_with_one_digest_stay_apart(spark):
    index = exact_dedup.DedupIndex(spark, common.shared_dir(spark, "index"))
    rows = [(1, b"a", b"d", b"1"), (2, b"b", b"d", b"2"), (3, b"a", b"d", b"1"), (4, b"", b"d", b"3")]
    for part in (rows[:2], rows[2:]):
        index.add(spark.createDataFrame(part, "key long, body binary, digest binary, check binary"))
    assert sorted((bytes(e.check), e.keep_id, e.copies) for e in index.entries().collect()) == [(b"1", 1, 2), (b"2", 2, 1), (b"3", 4, 1)]


# --- n-gram Jaccard join


def brute_classes(rows, k=5, percent=75):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return collections.Counter((i, len(s), least.get(find(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("options", [{}, {"chunk": 4, "sample_sets": 1}, {"chunk": 4, "star": 2, "part": 3}, {"chunk": 32, "star": 4, "part": 20, "sample_sets": 100}])
def test_jaccard_join(spark, corpus, options):
    rows = corpus + [(1000 + k, t) for k, (_, t) in enumerate(ODD)] + [(None, corpus[0][1]), (2000, "five words are not here"), (2001, "Five WORDS are not here"), (2002, "two words"), (2003, "TWO  words")]
    got = near_dup.jaccard_classes(docs(spark, rows, 6), **options).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows)
    assert all(r.text_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i == r.doc_id} for r in got)
    firsts = collections.Counter(r.component_id for r in got if r.first and r.n_shingles)
    assert set(firsts) == {r.component_id for r in got if r.n_shingles} and firsts[0] == 1


def test_op5_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op5_jaccard_join(spark, SF)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_classes(rows)


def test_a_group_of_near_copies_in_two_halves(spark):
    """Two large classes that share a shingle in every set: their blocks hold two classes, and nothing links them."""
    r = random.Random(9)
    words_of = lambda n: [f"q{r.randrange(10**6)}" for _ in range(n)]
    first, second, common_part = words_of(60), words_of(60), words_of(50)
    rows = [(k, " ".join([*common_part, *(first if k % 2 else second), *words_of(2)])) for k in range(300)] + [(400, " ".join(first)), (401, " ".join([*first, "more"]))]
    for options in ({}, {"chunk": 16, "part": 50}):
        got = near_dup.jaccard_classes(docs(spark, rows), **options)
        assert collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute_classes(rows)


def test_words_that_differ_everywhere_do_not_meet(spark):
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    got = near_dup.jaccard_classes(docs(spark, [(1, a), (2, b)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}


def test_sets_of_a_second_attempt(spark, monkeypatch, tmp_path):
    class Context:
        number = 0

        @classmethod
        def get(cls):
            return cls

        @classmethod
        def taskAttemptId(cls):
            return cls.number

    monkeypatch.setattr(near_dup, "TaskContext", Context)
    texts = [f"text {k} has these words and no others" for k in range(20)]

    def attempt(number, order):
        Context.number = number
        column = pa.array([texts[k].encode() for k in order])
        batch = pa.RecordBatch.from_arrays([pa.array(order), column, column], names=["key", "sha", "body"])
        return {k: g for b in near_dup._store(f"file://{tmp_path}/s", 5)([batch]) for k, g in zip(b.column(0).to_pylist(), b.column(4).to_pylist())}

    once, again = attempt(3, list(range(20))), attempt(8, list(range(19, -1, -1)))
    sets = near_dup.Sets(f"file://{tmp_path}/s")
    assert all(np.array_equal(sets[once[k]], sets[again[k]]) and once[k] != again[k] for k in range(20))
    sets.fs, sets.files = type("Remote", (), {"type_name": "other", "open_input_file": staticmethod(sets.fs.open_input_file)})(), {}
    sets.FIRST_READ = 16
    mapped = near_dup.Sets(f"file://{tmp_path}/s")
    assert all(np.array_equal(sets[g], mapped[g]) for g in once.values())


def test_hot_keys_join_like_others(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 30 > 0, F.col("id") % 11).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    want = sorted((r.k or -1, r.id, r.most) for r in left.join(right.where("k is not null"), "k", "left").collect() if r.k)
    for least in (100, 10_000):
        got = common.hot_join(left, right.where("k is not null"), "k", "n", least=least)
        assert sorted((r.k, r.id, r.most) for r in got.collect() if r.k) == want and got.count() == 3000


def test_jaccard_join_of_nothing(spark):
    assert near_dup.jaccard_classes(docs(spark, [])).count() == 0
    assert near_dup.jaccard_classes(docs(spark, [(1, None)])).collect()[0][:3] == (1, 0, 1)


def test_tree_search_finds_all_that_the_bound_allows():
    r = np.random.default_rng(3)
    for _ in range(20):
        points = r.integers(0, 6, (300, 16)).astype(np.uint16)
        sizes = points.sum(1).astype(np.int64)
        tree = near_dup.CountRTree(points, sizes)
        q = int(r.integers(300))
        bound = np.minimum(points, points[q]).sum(1)
        want = np.flatnonzero((175 * bound >= 75 * (sizes + sizes[q])) & (100 * sizes >= 75 * sizes[q]) & (100 * sizes[q] >= 75 * sizes))
        assert sorted(tree.search(points[q], int(sizes[q]), 75).tolist()) == want.tolist()


def test_word_hashes():
    texts = ["A b\tc", "", "a", " B  c ", "é É", "x" * 5000 + " b"]
    got = []
    for row, bounds, h, s, e in words.word_hashes(pa.array([t.encode() for t in texts])):
        for k in range(len(bounds) - 1):
            got.append([(int(x), int(a), int(b)) for x, a, b in zip(h[bounds[k] : bounds[k + 1]], s[bounds[k] : bounds[k + 1]], e[bounds[k] : bounds[k + 1]])])
    assert [[w[1:] for w in ws] for ws in got] == [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", t.encode())] for t in texts]
    long = [c * n for n in (7, 8, 9, 16, 17, 63, 64, 65, 72, 200) for c in "abA"]
    (_, _, h, _, _), = words.word_hashes(pa.array([" ".join(long).encode()]))
    assert len(set(h.tolist())) == 20 and all(h[k] == h[k + 2] for k in range(0, 30, 3))
    assert got[0][0][0] == got[2][0][0] and got[0][1][0] == got[3][0][0] == got[5][1][0] and got[4][0][0] != got[4][1][0]


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    up = {n: n for p in pairs for n in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs + [(7, None)], "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in pairs for n in (a, b) if a != b}


# --- decontamination


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of rare herbs".split()


def test_leaks(spark):
    r = random.Random(1)
    noise = lambda n: " ".join(f"n{r.randrange(5000)}" for _ in range(n))
    edited = ITEM.copy()
    edited[4], edited[11] = "leaps", "twenty"
    del edited[8]
    rows = [(1, noise(50) + " " + " ".join(ITEM).upper() + "! " + noise(9)), (2, noise(400) + " " + " ".join(edited)), (3, noise(80)), (4, None), (None, ", ".join(ITEM)), (5, "the lazy dog " + noise(30)), (6, " ".join(ITEM) + " " + noise(3000) + " " + " ".join(ITEM))]
    items = spark.createDataFrame([(10, " ".join(ITEM), None), (11, " ".join(ITEM), None), (12, None, None), (13, "two words", None), (14, "never seen in any text at all", None)], "item_id long, text string, leaks string")
    for block in (1 << 20, 100):
        got = {r.doc_id: {x.item_id: x for x in r.leaks} for r in decontaminate.find_leaks(docs(spark, rows), items, ["doc_id"], block_chars=block).collect()}
        assert {k for k, v in got.items() if v} == {1, 2, None, 6} and len(got) == 7
        assert all(set(v) == {10, 11} for v in got.values() if v)
        assert got[1][10].score == got[None][11].score == 1.0 and got[6][10].first_byte == 0
        assert 0.5 < got[2][10].score < 1 and got[2][10].matches == 15
        t = rows[0][1].encode()[got[1][10].first_byte : got[1][10].end_byte].decode()
        assert t.lower() == " ".join(ITEM)
    kept = decontaminate.find_leaks(docs(spark, rows), items, ["doc_id", "text", "leaks"])
    assert kept.columns == ["doc_id", "text", "leaks_carried", "leaks"] and {r.leaks_carried for r in kept.collect()} == {"y"}
    assert decontaminate.find_leaks(docs(spark, rows), items.limit(0), ["doc_id"]).where(F.size("leaks") > 0).count() == 0
    assert decontaminate.find_leaks(docs(spark, []), items, ["doc_id"]).count() == 0


def test_every_ngram_is_a_seed(spark):
    copies = [ITEM.copy() for _ in range(8)]
    for k, words in enumerate(copies[:4]):
        words[k::4] = [f"x{k}"] * len(words[k::4])  # every fourth word replaced
    for k, words in enumerate(copies[4:]):
        words[k::4] = [f"y{k}"] * len(words[k::4])
    rows = [(k, " ".join(words)) for k, words in enumerate(copies)] + [(k, " ".join(ITEM)) for k in range(8, 10)]
    items = spark.createDataFrame([(10, " ".join(ITEM))], "item_id long, text string")
    for own in (rows, *([r] for r in rows)):
        got = {r.doc_id: r.leaks for r in decontaminate.find_leaks(docs(spark, own), items, ["doc_id"]).collect()}
        assert len(got) == len(own) and all(x and x[0].score > 0.5 for x in got.values())


def test_windows_of_seeds_reach_left():
    words = np.arange(1, 21, dtype=np.uint64)
    items = decontaminate.Items.of([1], [b"a b c d e f g h i j a b c k l m n o p q"], 3)
    item = items.item(0)
    text = np.concatenate([words, item[10:], words])
    hits = np.array([20, 20 + 1, 20 + 4])
    which = np.searchsorted(items.seeds, decontaminate.shingles(text, 3)[hits])
    assert decontaminate.leaks_of(items, text, hits, which, 0.5, 8)[0][1:] == (10, 20, 30)


def test_alignment_against_plain_dynamic_programming():
    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = r.integers(0, 5, int(r.integers(1, 12))).astype(np.uint64), r.integers(0, 5, int(r.integers(1, 15))).astype(np.uint64)
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                best = max(best, h[i, j])
        assert decontaminate.align(a, b)[0] == best


# --- toxicity


def test_marginals_against_enumeration():
    r = np.random.default_rng(2)
    transition, start = r.normal(size=(2, 2)), 0.3
    emission, bounds = r.normal(size=11), np.array([0, 4, 4, 5, 11])
    p, pairs, log_z = toxicity.marginals(emission, bounds, transition, start)
    want, total, zs = np.zeros(11), np.zeros((2, 2)), 0.0
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a == b:
            continue
        z, own, trans = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            s = start * y[0] + sum(emission[a + k] * y[k] for k in range(b - a)) + sum(transition[u, v] for u, v in zip(y, y[1:]))
            z += np.exp(s)
            own += np.exp(s) * np.array(y)
            for u, v in zip(y, y[1:]):
                trans[u, v] += np.exp(s)
        want[a:b] = own / z
        total += trans / z
        zs += np.log(z)
    assert np.allclose(p, want) and np.allclose(pairs, total) and np.isclose(log_z, zs)
    long = r.normal(size=5000) * 3
    assert np.allclose(toxicity.whole_marginals(long, np.array([0, 5000]), transition, start, 64), toxicity.marginals(long, np.array([0, 5000]), transition, start)[0], atol=1e-12)


def _toxic_table(spark, n=600):
    r = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("na", "ki", "po", "ves", "dar", "lun")]
    rows, labels = [], []
    for k in range(n):
        t = r.choices(vocabulary, k=r.randint(1, 60))
        if k % 5 == 0:
            for _ in range(r.randint(1, 3)):
                t.insert(r.randrange(len(t) + 1), "grub" + r.choice(["ba", "zo", "ti"]))
        rows.append((k, " ".join(t)))
        labels.append((k, 1, int(k % 5 == 0)))
    return rows, spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    rows, labels = _toxic_table(spark)
    df = docs(spark, rows + [(9000, None), (9001, ""), (None, "grubba")])
    model = toxicity.fit_on(df, labels, where=lambda k: k % 3 != 0)
    got = {r.doc_id: r for r in toxicity.score(df, model, ["doc_id"]).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    wrong = [k for k, _ in rows if k % 3 == 0 and (got[k].score >= 0.5) != (k % 5 == 0)]
    assert len(wrong) <= 2
    text = dict(rows)[15]
    spans = [text[s.first : s.end] for s in got[15].spans]
    assert spans and all("grub" in s for s in spans)
    assert got[None].score >= 0.5 and got[9000].score < 0.5 and got[9000].spans == []


def _labels(rows):
    return rows, "doc_id long, quality int, toxic int"


LONG_TOXIC = "grubba grubzo " * 2_400_000  # more than 32 MB


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)], [(1, 1, 1), (2, 0, 1), (4, 0, 1)], [(1, None, None), (None, 1, 1)], [(777_001, 1, 1), (777_002, 1, 0)], [(1, 1, 1), (2, 0, 1), (4, 0, 1), (8, 1, 0)]])
def test_toxic_stage_without_usable_labels(spark, tmp_path, labels):
    """Where labels tell nothing, every document stays."""
    import corpus_pipeline as cp

    spark.createDataFrame(*_labels(labels)).write.parquet(f"{tmp_path}/labels.parquet")
    df = _odd_docs(spark, ODD)
    model = toxicity.fit_on(df, common.table(spark, str(tmp_path), "labels"))
    assert all(0 <= r.score < 0.5 for r in toxicity.score(df, model, ["doc_id"]).collect())
    kept = cp.drop_toxic(spark, df, str(tmp_path))
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(ODD)
    assert toxicity.score(docs(spark, []), toxicity.Model(), ["doc_id"]).count() == 0


def test_toxic_stage_with_a_long_labelled_text(spark, tmp_path):
    """A labelled text longer than what a fit may hold is left out of the fit alone."""
    import corpus_pipeline as cp

    rows, labels = _toxic_table(spark)
    labels.unionByName(spark.createDataFrame(*_labels([(7000, 1, 1), (7001, 1, 0)]))).write.parquet(f"{tmp_path}/labels.parquet")
    df = _odd_docs(spark, [*rows, (7000, LONG_TOXIC), (7001, "lona mipo " * 100)])
    kept = {r.doc_id for r in cp.drop_toxic(spark, df, str(tmp_path)).select("doc_id").collect()}
    toxic = {k for k, _ in rows if k % 5 == 0} | {7000}
    assert len(toxic & kept) <= 3 and len({k for k, _ in rows} - toxic - kept) <= 3 and 7001 in kept and 7000 not in kept


# --- chat


def test_chat_tree(spark):
    rows = [("t", "1", None, 0.0, "user", "q"), ("t", "2", "1", 2.0, "assistant", "good"), ("t", "3", "1", 1.0, "assistant", "bad"), ("t", "4", "2", 3.0, "user", "more"), ("t", "5", "absent", 9.0, "user", "other root")]
    rows += [("c", "1", "2", 0.0, "user", "x"), ("c", "2", "1", 0.0, "user", "y"), ("c", "3", "2", 0.0, "user", "on a cycle"), (None, "1", None, 0.0, "user", "z"), ("t", "4", "2", 3.0, "user", "more")]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, score double, role string, text string").withColumn("leaf", F.lit(1)).withColumn("depth", F.lit(2))
    got = {(r.tree, r.leaf): r.conversation for r in chat.chat_format(df).collect()}
    assert set(got) == {("t", "4"), ("t", "3"), ("t", "5")}
    assert got["t", "4"] == "### user: q</turn>\n### assistant: good</turn>\n### user: more</turn>\n"
    best = [r.leaf for r in chat.chat_format(df, top_k=2).orderBy("leaf").collect()]
    assert best == ["4", "5"]
    assert chat.chat_format(df.limit(0)).count() == 0


def test_chat_reads_back(spark):
    r = random.Random(7)
    said = ["".join(r.choices(["\\", "#", "</", "turn>", "</turn>\n", "### Assistant: ", "a", "é", "\n", "🙂", ":", " "], k=12)) for _ in range(60)]
    rows = [(k // 6, k % 6, ["user", "assistant", None, "sy:st\\em"][k % 4], t) for k, t in enumerate(said)] + [(77, None, "assistant", None), (None, 1, "user", "lost"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = common.shared_dir(spark, "chat")
    chat.chat_format(chat.linear_messages(df)).write.parquet(out)
    got = {r.c: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat.read_chat(spark, out).withColumn("c", chat.conversation_id(F.col("tree"))).collect()}
    want = collections.defaultdict(list)
    for c, _, role, t in rows:
        want[c].append((role or "", t or ""))
    assert {c: v[0] for c, v in got.items()} == dict(want)
    assert {c: v[1] for c, v in got.items()} == {c: "".join(t for role, t in v if role == "assistant") for c, v in want.items()}


def test_long_roles_texts_and_conversations(spark):
    long = "a:\\#</ " * 130_000
    rows = [(1, 0, long, "x"), (1, 1, "assistant", long), (2, 0, "user", "\\" * 100_001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.unionByName(spark.range(100_000).select(F.lit(3).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")))
    out = common.shared_dir(spark, "chat")
    chat.chat_format(chat.linear_messages(df)).write.parquet(out)
    got = {r.tree: r for r in chat.read_chat(spark, out).collect()}
    assert [(t.role, t.text) for t in got["c1"].turns] == [(long, "x"), ("assistant", long)] and got["c1"].loss_text == long
    assert got["c2"].turns[0].text == "\\" * 100_001 and got["c2"].loss_text == ""
    assert [t.text for t in got["c3"].turns] == [f"t{k}" for k in range(100_000)]
    assert got["c3"].loss_text == "".join(f"t{k}" for k in range(1, 100_000, 2))
    for r in spark.read.parquet(out).collect():
        assert all(s is None or r.conversation[s.start + s.length :].startswith("</turn>") for s in r.loss[:50])


def test_leaves_on_a_cycle_have_no_path(spark):
    rows = [("t", "a", "b"), ("t", "b", "a"), *(("t", f"leaf{k}", "a") for k in range(1000)), ("t", "root", None), ("t", "reply", "root")]
    df = spark.createDataFrame(rows, "tree string, node string, parent string").select("*", F.lit(0.0).alias("score"))
    got = sorted((r.leaf, r.depth, r.node) for r in chat.reply_paths(df).collect())
    assert got == [("reply", 0, "root"), ("reply", 1, "reply")]


def test_chat_runs_without_python_workers(spark):
    df = spark.createDataFrame([("t", "1", None, 0.0, "user", "q")], "tree string, node string, parent string, score double, role string, text string")
    plan = chat.chat_format(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_deep_chain(spark):
    df = spark.range(70).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.chat_format(chat.linear_messages(df)).collect()
    assert len(got) == 1 and got[0].conversation.count("</turn>") == 70


# --- URLs


def test_url_parts_and_rules(spark):
    urls = {"HTTP://WWW.Ex.NET/en/x?q#f": ("www.ex.net", "/en/x", "net/", "block"), "http://example.net/en/": ("example.net", "/en/", "example.net/en/", "allow"), "x://example.net": ("example.net", "", None, "allow"), "http://a.org?x": ("a.org", "", None, "allow"), "http://a.org/fr/://b": ("a.org", "/fr/://b", "org/fr/", "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "": ("", "", None, "allow")}
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, "http://example.com/de/1", None)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, n long, x long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, none, queries.RULES).collect()}
    assert got == {k: v for k, v in enumerate(urls.values())} | {None: ("example.com", "/de/1", "example.com/de/", "block")}
    assert url_filter.judge(pages.limit(0), none, queries.RULES).count() == 0


def test_reputation_shrinks(spark):
    outcomes = spark.createDataFrame([("bad.a.com", 60, 0), ("one.a.com", 1, 0), *((f"h{k}.b{k}.com", 20, 18) for k in range(20)), (None, 3, 0)], "host string, n long, x long")
    means = {(r.level, r.name): r for r in url_filter.reputations(outcomes).collect()}
    assert means["host", "bad.a.com"].mean < means["host", "one.a.com"].mean < 0.5 < means["host", "h1.b1.com"].mean
    pages = spark.createDataFrame([(1, "http://bad.a.com/"), (2, "http://h1.b1.com/"), (3, "http://new.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, outcomes, []).collect()} == {1: "block", 2: "allow", 3: "allow"}
    assert [(r.a, r.b) for r in spark.createDataFrame([("x.y.co.uk",), ("localhost",)], "h string").select(url_filter.suffix_of(F.col("h"), ("co.uk",)).alias("a"), url_filter.domain_of(F.col("h"), url_filter.suffix_of(F.col("h"), ("co.uk",))).alias("b")).collect()] == [("co.uk", "y.co.uk"), ("localhost", "localhost")]


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="post-ad-free"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p><b>One</b>  two&nbsp;three<br>four<p>Five</p><aside>Buy</aside><div class="ad">Advert</div><form><input value=x>Send</form><ul><li>six<li>seven</ul><footer>tags</footer></article>
<section id="comments"><p>Nice article, thank you very much for this long and thoughtful text that I enjoyed a lot.</p></section><footer>&copy; me</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Head & tail\nOne two three four\nFive\nsix\nseven"


def test_page_without_article():
    p = "This paragraph is long enough to be the text of an article, with several words. " * 2
    page = f"<div><a href=x>One link</a> <a href=y>Another link of the menu</a></div><div id=c><h2>Title</h2><p>{p}</p><p>Short.</p><p>{p}</p><p>End.</p></div><div class='sidebar'>More</div><div><a href=z>{p}</a></div>"
    assert html_text.main_text(page) == "\n".join(["Title", p.strip(), "Short.", p.strip(), "End."])


def test_windows_decide_on_marked_pages():
    p = "This paragraph is long enough to be the text of an article, with several words."
    links = "".join(f"<div><a href=x>{p}</a></div>" for _ in range(4))
    marked = f"<div>Unlisted notice.</div><main><article>{links}<h1>Title</h1><p>{p}</p><p>End.</p>{links}</article><article><p>Teaser.</p></article></main><div>Below.</div>"
    assert html_text.main_text(marked) == "\n".join(["Title", p, "End."])
    assert html_text.main_text(f"<article><p>Teaser.</p></article>{links}<div><p>{p}</p><p>{p}</p></div>") == "\n".join([p, p])


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div>" * 20_000 + "</p>" * 20_000, "<article>" * 20_000 + "x", "<p " + "a" * 400_000 + ">", "<script>" + "</script" * 100_000, "<script>x</script " * 50_000 + ">", "<a '\">" * 150_001, "<b class=ad>" * 100_000 + "</b>" * 100_000, "<!" * 300_000, "<p a" + " " * 300_000 + "b>"])
def test_broken_markup_takes_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 2


def test_raw_text_and_quotes():
    p = "This paragraph is long enough to be the text of an article, with several words."
    page = f"<p>{p}</p><script>if (a < b) {{ document.write('<p>{p}</p>') }}</script><p title='a > b'>{p}</p><textarea><p>{p}</p></textarea><p>a < b and {p}"
    assert html_text.main_text(page) == "\n".join([p, p, f"a < b and {p}"])
    assert html_text.main_text(f'<p>{p}</p><p class="x>{p}</p><p>{p}</p>') == "\n".join([p, p, p])


def test_windows_against_brute_force(spark):
    """surge_and_dive by trying every window, on the lines of all pages and on random lengths."""

    def brute(lengths, window=3, surge=60):
        starts = [k for k in range(len(lengths)) if sum(lengths[k : k + window]) >= surge]
        if not starts:
            return None
        first = next(k for k in range(starts[0], len(lengths)) if lengths[k])
        last = starts[-1]
        while last + 1 < len(lengths) and lengths[last + 1]:
            last += 1
        while not lengths[last]:
            last -= 1
        return first, last + 1

    r = random.Random(6)
    for _ in range(2000):
        lengths = [r.choice([0, 0, 5, 20, 40, 90]) for _ in range(r.randint(0, 15))]
        assert html_text.surge_and_dive(lengths) == brute(lengths)
    decided = 0
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        own = [x for x in html_text.lines_of(page.html or "") if not x.outside]
        lengths = [0 if 2 * x.linked > len(x.text) else len(x.text) - x.linked for x in own]
        assert html_text.surge_and_dive(lengths) == brute(lengths)
        decided += brute(lengths) is not None
    assert decided >= 0.9 * spark.read.parquet(f"{SF}/pages.parquet").count()  # the others have no window of 60 characters


class _Article(html.parser.HTMLParser):
    """Blocks within article elements, by another parser: what the pages of the test tables hold as main text."""

    BLOCKS = {"h1", "h2", "h3", "p", "li", "ul", "div", "section", "blockquote", "article", "td", "tr", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.parts, self.blocks = 0, [], [], []

    def block(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        self.parts = []
        if text and self.inside and not self.skipped:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.block()
        if tag == "br":
            self.parts.append(" ")
        if tag in ("nav", "footer", "aside", "script", "style", "form") or dict(attrs).get("class") == "ad":
            self.block()
            self.skipped.append(tag)
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS or tag in self.skipped:
            self.block()
        if self.skipped and self.skipped[-1] == tag:
            self.skipped.pop()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_op8_against_another_parser(spark):
    html_of = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op8_html_text(spark, SF).collect()
    assert len(got) == len(html_of)
    for r in got:
        page = _Article()
        page.feed(html_of[r.page_id] or "")
        page.close()
        page.block()
        assert r.text == "\n".join(page.blocks) and r.n_chars == len(r.text)


DENSE = "The quick brown fox jumps over the lazy dog and runs on through the forest until night, {}."


@pytest.mark.parametrize("name", "share-price alert-level related-work banner-year comment-on-law social-policy form-letter menu-of-the-day skip-a-beat login-history cookie-recipe banner alert search".split())
def test_class_words_do_not_drop_article_text(name):
    lines = [DENSE.format(k) for k in range(3)]
    assert html_text.main_text(f'<article><h1>T</h1><p>{lines[0]}</p><p class="{name}">{lines[1]}</p><p>{lines[2]}</p></article>') == "\n".join(["T", *lines])
    assert html_text.main_text(f'<nav><a href="/">x</a></nav><div><p>{lines[0]}</p><p class="{name}">{lines[1]}</p><p>{lines[2]}</p></div>') == "\n".join(lines)
    assert html_text.main_text(f'<article><p>{lines[0]}</p><section class="search-and-rescue"><p>{lines[1]}</p></section><div class="article-header"><p>{lines[2]}</p></div></article>') == "\n".join(lines)


@pytest.mark.parametrize("name", "ad ads ad-slot comments comment-list user-comments article-comments sidebar sidebar-left cookie-notice site-header related-posts share-buttons newsletter-signup nav navbar menu footer adBox top-notice".split())
def test_class_words_of_boilerplate(name):
    lines = [DENSE.format(k) for k in range(5)]
    for page in ("<article><p>{0}</p><div class='{n}'><p>{4}</p></div><p>{1}</p><p>{2}</p></article>", "<article><p>{0}</p><p>{1}</p><p>{2}</p></article><div id='{n}'><p>{4}</p><p>{4}</p></div>", "<div><p>{0}</p><p>{1}</p><p>{2}</p></div><div class='x {n}'><p>{4}</p><p>{4}</p></div>"):
        assert html_text.main_text(page.format(*lines, n=name)) == "\n".join(lines[:3])


def test_windows_drop_what_no_mark_tells():
    """Lists of links and short lines around text, without any name that tells what they are."""
    lines = [DENSE.format(k) for k in range(3)]
    links = "".join(f'<div><a href="/{k}">Section number {k}</a></div>' for k in range(6))
    page = f"<div>{links}</div><div><p>{lines[0]}</p><p>Short.</p><p>{lines[1]}</p><p>{lines[2]}</p></div><div>{links}</div>"
    assert html_text.main_text(page) == "\n".join([lines[0], "Short.", *lines[1:]])


def test_windows_cut_most_pages(spark):
    cut = 0
    pages = [r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for page in pages:
        lines = html_text.lines_of(page)
        found = html_text.surge_and_dive([html_text.weight(x) for x in lines])
        cut += bool(found) and found[1] - found[0] < len(lines)
    assert cut >= 0.9 * len(pages)


def test_window_edges():
    assert html_text.surge_and_dive([0, 0, 80, 5, 0, 90, 0, 0]) == (2, 6)
    assert html_text.surge_and_dive([5, 5]) is None and html_text.surge_and_dive([]) is None


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "v", "<p>only"), (4, "w", "<<<>&#0;&bogus; <p"), (5, "x", "<article>" + "<p>w</p>" * 20_000)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[2] == got[None] == "" and got[3] == "only" and len(got[5]) == 39_999 and len(got) == 6
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- PII


KEY = b"k"


def test_feistel_is_a_permutation():
    seen = {tuple(pii.feistel([a, b, c], [5, 7, 3], KEY, "t")) for a in range(5) for b in range(7) for c in range(3)}
    assert len(seen) == 105
    assert len({pii.feistel([a], [10], KEY, "t")[0] for a in range(10)}) == 10


def test_formats_stay_valid():
    t = "card 4111 1111 1111 1111 and 4111111111111112, ssn 123-45-6789, not 000-12-3456, ip 10.1.2.3 not 300.1.1.1, +1 (415) 555-2671, IBAN DE89 3704 0044 0532 0130 00, on 2020-02-29 not 2021-02-29, a.B1@ex.org"
    new, values = pii.pseudonymized(t, KEY)
    kinds = {v["kind"]: v["pseudonym"] for v in values}
    assert set(kinds) == {"card", "ssn", "ip", "phone", "iban", "date", "email"} and len(values) == 7
    assert all(new[v["first"] : v["end"]] == v["pseudonym"] for v in values)
    assert pii.luhn(kinds["card"].replace(" ", "")) and kinds["card"][0] == "4" and kinds["card"] != "4111 1111 1111 1111"
    assert pii._ssn_valid(kinds["ssn"]) and pii._iban_number(kinds["iban"].replace(" ", "")) % 97 == 1
    assert all(int(p) < 256 for p in kinds["ip"].split(".")) and re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", kinds["phone"])
    assert datetime.date.fromisoformat(kinds["date"]).year // 100 == 20 and re.fullmatch(r"[a-z]\.[A-Z]\d", kinds["email"])
    for kept in ("4111111111111112", "000-12-3456", "300.1.1.1", "2021-02-29", "@ex.org"):
        assert kept in new


def test_values_beside_other_numbers():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    for value, text in ((card, f"pay {card} 123"), (card, f"order 12345 {card}"), (card, f"77 {card} 123."), (iban, f"{iban} WITH"), (iban, f"from {iban} ON 4 MAY"), ("2020-02-29", "4111 1111 2020-02-29")):
        alone = pii.pseudonymized(value, KEY)[0]
        new, values = pii.pseudonymized(text, KEY)
        assert alone != value and new == text.replace(value, alone) and [v["pseudonym"] for v in values] == [alone]
        assert new[values[0]["first"] : values[0]["end"]] == alone
    for kept in ("3 17 25 8 19 44 2 31 7 12 5 9 14 28", "4111 1111 1111 1112 123"):
        assert pii.pseudonymized(kept, KEY) == (kept, [])


def test_equal_values_stay_linked_and_others_apart():
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(k) for k in range(3000)]
    new = [pii.pseudonymized(d.isoformat(), KEY)[0] for d in days]
    assert len(set(new)) == len(days)
    assert [pii.pseudonymized(f"{d.day:02d}.{d.month:02d}.{d.year}", KEY)[0] for d in days[:50]] == [".".join(reversed(n.split("-"))) for n in new[:50]]
    assert pii.pseudonymized(days[0].isoformat(), b"other")[0] != new[0]


def _all_apart(values):
    new = [pii.pseudonymized(v, KEY)[0] for v in values]
    assert len(set(new)) == len(values)
    return new


def test_different_values_have_different_pseudonyms():
    assert pii.pseudonymized("979-660-7737", KEY)[0] != pii.pseudonymized("073-295-2745", KEY)[0]
    phones = [f"{a}-{b}-{n:04d}" for a in ("079", "199", "200", "979") for b in ("093", "660") for n in range(1000)]
    new = _all_apart(phones)
    assert all((p[0] >= "2" and p[4] >= "2") == (q[0] >= "2" and q[4] >= "2") for p, q in zip(phones, new))
    _all_apart([f"{a}@ex.org" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{b}@ex.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"])
    _all_apart([f"10.{a}.{b}.7" for a in range(40) for b in range(40)])
    _all_apart([f"123-45-{n:04d}" for n in range(1, 2000)])
    _all_apart([f"2001:db8::{n:x}:1" for n in range(1, 500)])
    body = [f"411111111{n:06d}" for n in range(1500)]
    _all_apart([b + next(c for c in "0123456789" if pii.luhn(b + c)) for b in body])
    letters = [pii.feistel([k], [26], KEY, "t")[0] for k in range(26)]
    assert sorted(letters) == list(range(26)) and len({(b - a) % 26 for a, b in enumerate(letters)}) > 5  # no constant shift


def test_one_permutation_of_days_for_all_spellings():
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(k) for k in range(36525)]
    new = [pii._date(d.isoformat(), KEY) for d in days]
    assert len(set(new)) == len(days) and set(new) == {d.isoformat() for d in days}  # the whole century onto itself
    for d, n in list(zip(days, new))[:400]:
        moved, name = datetime.date.fromisoformat(n), pii.MONTHS[d.month - 1].capitalize()
        to = pii.MONTHS[moved.month - 1].capitalize()
        assert pii._date(f"{d.day} {name} {d.year}", KEY).split()[::2] == [str(moved.day), str(moved.year)]
        assert pii.pseudonymized(f"{name} {d.day}, {d.year}", KEY)[0].startswith(to)
        assert pii.pseudonymized(f"on {name[:3]} {d.day}, {d.year}.", KEY)[0] == f"on {to[:3] if d.month != 5 else to} {moved.day}, {moved.year}."
        assert pii._date(f"{d.day:02d}/{d.month:02d}/{d.year}", KEY) == f"{moved.day:02d}/{moved.month:02d}/{moved.year}"
        if d.day > 12:
            assert pii._date(f"{d.month:02d}/{d.day:02d}/{d.year}", KEY) == f"{moved.month:02d}/{moved.day:02d}/{moved.year}" and moved.day > 12
    assert re.fullmatch(r"[A-Z][a-z]+ \d+(st|nd|rd|th), 20\d\d", pii.pseudonymized("January 5th, 2020", KEY)[0])


def test_numbers_with_and_without_their_country_stay_linked():
    plain = pii.pseudonymized("415-555-2671", KEY)[0]
    assert pii._digits(pii.pseudonymized("+1 415-555-2671", KEY)[0]) == "1" + pii._digits(plain)
    assert pii._digits(pii.pseudonymized("+353 1 234 5678", KEY)[0]) == pii._digits(pii.pseudonymized("+35312345678", KEY)[0])


def test_long_ip_addresses():
    one, two = (pii.pseudonymized(f"from {a} to", KEY)[0].split()[1] for a in ("2001:db8:0:0:0:0:2:1", "2001:db8::2:1"))
    assert one == two != "2001:db8::2:1" and pii.pseudonymized("std::cout at 12:30:45, face::bed", KEY)[1] == []


def test_op3_against_one_text_at_a_time(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_pii_pseudonyms(spark, SF).collect():
        text, values = pii.pseudonymized(texts[r.doc_id] or "", queries.DEMO_KEY)
        assert (r.text or "") == text and r.n_values == len(values) and all(text[v.first : v.end] == v.pseudonym for v in r["values"])


def test_pseudonymize(spark):
    got = {r.doc_id: r for r in pii.pseudonymize(docs(spark, ODD + [(50, "1.2.3.4 and 1.2.3.4"), (51, "call 4111111111111111")]), KEY).collect()}
    assert got[2].text is None and got[2].values == [] and got[3].text == "" and got[1].text == "a b c d e" and len(got[5].text) == 300_000
    assert got[50].text.split(" and ")[0] == got[50].text.split(" and ")[1] != "1.2.3.4"
    assert pii.pseudonymize(docs(spark, []), KEY).count() == 0


# --- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    from compare import same

    same(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    table = common.table(spark, SF, "documents")
    kept = common.written(cp.drop_toxic(spark, table, SF), "t")
    assert kept.columns == table.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    last = {t: i for i, t in sorted(texts.items())}
    texts = {i: t for t, i in last.items()}
    classes = {i: c for (i, _, c) in brute_classes(sorted(texts.items()))}
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    items = [re.findall(r"[a-z0-9\u0080-\uffff]+", r.text.lower()) for r in common.table(spark, SF, "benchmark").collect()]
    leaked = {i for i, t in texts.items() for w in items if " ".join(w) in " ".join(re.findall(r"[a-z0-9\u0080-\uffff]+", t.lower()))}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    enc = _tiktoken()
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = np.asarray(enc.encode_ordinary(t), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


CLASHES = "doc_id long, text string, score string, spans int, leaks string, row int, __body string, __leaks string, keep_id long, kept string, component_id long, verdict int, text_sha256 string, sha int, id int, first string, `a b.c` int"


def _odd_docs(spark, rows):
    extra = ("s", 1, "l", 2, "b", "k", 3, "no", 4, 5, "h", 6, 7, "f", 8)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], CLASHES).repartition(3)


def test_pipeline_stages_judge_rows(spark):
    import corpus_pipeline as cp

    item = common.table(spark, SF, "benchmark").first().text
    near = " ".join(f"z{k}" for k in range(60))
    rows = [*ODD, (4, "A a a a"), (4, "B b b b"), (9, "B b b b"), (10, "C c"), (10, "C c"), (None, "B b b b"), (None, "D d"), (None, "D d")]
    rows += [(20, near), (21, near + " more"), (21, near + " more"), (22, "wholly other text of id 22"), (22, near + " and more"), (None, near + " less"), (30, "so " + item), (30, "not " + near), (None, item), (40, None), (40, None)]
    df = _odd_docs(spark, rows)
    stay = lambda name: collections.Counter((r.doc_id, r.text) for r in stages[name](spark, df, SF).collect())
    stages = dict(cp.STAGES)
    assert all(stages[n](spark, df, SF).columns == df.columns for n, _ in cp.STAGES[:-1])
    model = toxicity.fit_on(df, common.table(spark, SF, "labels"), where=lambda key: ~queries.held_out(key))
    clean = {(r.doc_id, r.text) for r in toxicity.score(df, model, ["doc_id", "text"]).where("score < 0.5").collect()}
    assert stay("toxicity") == collections.Counter(r for r in rows if r in clean)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append((i, t))
    got = stay("exact dedup")
    assert collections.Counter((i, t or "") for i, t in got.elements()) == collections.Counter((max((i for i, _ in g if i is not None), default=None), t) for t, g in groups.items())
    classes = collections.defaultdict(set)
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    for k, n, c in brute_classes(numbered):
        classes[c if n else -k - 1].add(k)
    want = collections.Counter()
    for members in classes.values():
        i, t = min((rows[k] for k in members), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
        want[i, t] += 1
    assert stay("n-gram Jaccard join") == want
    assert stay("benchmark decontamination") == collections.Counter(r for r in rows if item not in (r[1] or ""))
    ids = cp.encode(spark, df, SF).collect()
    assert collections.Counter(r.doc_id for r in ids) == collections.Counter(i for i, _ in rows)


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline as cp

    df = _odd_docs(spark, [])
    for _, stage in cp.STAGES:
        assert stage(spark, df, SF).count() == 0


def test_op4_against_full_alignment(spark):
    """Every document against every item, all its words: a leak by the full alignment is found by seeds."""
    items = [(r.item_id, next(decontaminate.word_hashes(pa.array([r.text.encode()]), decontaminate.PUNCTUATION))[2]) for r in common.table(spark, SF, "benchmark").collect()]
    found = collections.defaultdict(set)
    for r in queries.op4_decontaminate(spark, SF).collect():
        found[r.doc_id].add(r.item_id)
    for d in common.table(spark, SF, "documents").collect():
        words_of = next(decontaminate.word_hashes(pa.array([(d.text or " ").encode()]), decontaminate.PUNCTUATION))[2]
        for i, item in items:
            if np.isin(item, words_of).sum() >= 0.5 * len(item):
                score, matches, _, _ = decontaminate.align(item, words_of)
                assert (i in found[d.doc_id]) == (score >= len(item) and matches >= min(8, len(item))), (d.doc_id, i)


def test_recall_on_edited_items(spark):
    """Of edited copies that the full alignment takes for leaks at least nine in ten are found."""
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows, items = [], []
    for k in range(40):
        item = r.choices(vocabulary, k=r.randint(12, 60))
        items.append((k, " ".join(item)))
        for share in (0.1, 0.2, 0.25, 0.3):
            for _ in range(3):
                edited = []
                for w in item:
                    x = r.random()
                    edited += [r.choice(vocabulary)] if x < share * 0.6 else [] if x < share * 0.8 else [w, r.choice(vocabulary)] if x < share else [w]
                rows.append((len(rows), " ".join([*r.choices(vocabulary, k=30), *edited, *r.choices(vocabulary, k=30)])))
    hashes = lambda t: next(decontaminate.word_hashes(pa.array([t.encode()]), decontaminate.PUNCTUATION))[2]
    leaks = {n for n, t in rows if decontaminate.align(hashes(items[n // 12][1]), hashes(t))[0] >= len(items[n // 12][1].split())}
    got = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_chars=2000).collect()
    found = {x.doc_id for x in got if x.doc_id // 12 in {y.item_id for y in x.leaks}}
    print(len(found & leaks), len(leaks))
    assert len(leaks) > 300 and len(found & leaks) >= 0.97 * len(leaks)


def test_op7_against_whole_passes(spark):
    """Scores by one pass of plain forward-backward over each whole text."""
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    texts = {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").collect()}
    model = toxicity.fit_on(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"), where=lambda key: ~queries.held_out(key))
    for r in queries.op7_toxicity(spark, SF).collect():
        emission = np.array([model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in re.findall(r"[^\W\d_]+", texts[r.doc_id])])
        bounds = np.array([0, len(emission)])
        p = toxicity.marginals(emission, bounds, model.transition, model.start)[0]
        assert abs(model.scores(p, bounds)[0] - r.score) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id)


def test_op9_against_the_library(spark):
    enc = _tiktoken()
    texts = {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").collect()}
    got = queries.op9_bpe_roundtrip(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.asarray(enc.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_a_fit_is_bounded(spark, monkeypatch):
    rows, labels = _toxic_table(spark)
    df = docs(spark, rows + rows[:50] + [(3, "x " * 100_000)])
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: seen.append(texts) or fit(texts, marks))
    assert isinstance(toxicity.fit_on(df, labels, most=200, most_chars=3000), toxicity.Model)
    assert 1 < len(seen[0]) <= 200 and sum(map(len, seen[0])) <= 3000 and max(map(len, seen[0])) <= 3000 // 16
