"""Language-model scores, BPE and language identification."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelgrove.llm import bpe, ctw, langid

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, key long, block int, value double"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class PlainCTW:
    """Context-tree weighting as in the books: one tree per binary node of a byte, by recursion."""

    def __init__(self, streams, depth):
        self.depth, self.n = depth, Counter()
        for s in streams:
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    for j in range(8):
                        self.n[s[i - d : i], (1 << j) | s[i] >> (8 - j), s[i] >> (7 - j) & 1] += 1
        self.kids = {}
        for c, p, _ in self.n:
            if c:
                self.kids.setdefault((c[1:], p), set()).add(c)
        self.memo = {}

    def kt(self, c, p):
        a, b = self.n[c, p, 0], self.n[c, p, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, p):
        if (c, p) not in self.memo:
            pe = self.kt(c, p)
            if len(c) == self.depth:
                self.memo[c, p] = pe
            else:
                below = sum(self.weighted(k, p) for k in self.kids[c, p])
                self.memo[c, p] = math.log(0.5) + np.logaddexp(pe, below)
        return self.memo[c, p]

    def one(self, context, p, d=0):
        """Probability that the bit at node p is 1, mixed from depth d on."""
        c = context[len(context) - d :]
        a, b = self.n[c, p, 0], self.n[c, p, 1]
        if a + b == 0:
            return None
        est = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return est
        w = math.exp(math.log(0.5) + self.kt(c, p) - self.weighted(c, p))
        deeper = self.one(context, p, d + 1)
        return w * est + (1 - w) * (est if deeper is None else deeper)

    def log10(self, s):
        total = 0.0
        for i in range(self.depth, len(s)):
            for j in range(8):
                p1 = self.one(s[i - self.depth : i], (1 << j) | s[i] >> (8 - j))
                p1 = 0.5 if p1 is None else p1
                total += math.log10(p1 if s[i] >> (7 - j) & 1 else 1 - p1)
        return total


def test_scores_equal_plain_context_tree_weighting(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "Solo", "çà É"] + [" ".join(rng.choice(("the", "cat", "Sat", "on", "mats", "énorme")) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    rows = [(i, t, "en", 1, 2, 0.5) for i, t in enumerate(texts)]
    for block_bytes, depth in ((1 << 26, 3), (200, 3), (1 << 26, ctw.DEPTH)):
        got = {r["doc_id"]: r for r in ctw.score_documents(spark.createDataFrame(rows, SCHEMA), depth=depth, block_bytes=block_bytes).collect()}
        assert len(got) == len(rows)
        held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))]
        stream = [b"\n" * depth + " ".join(words(t)).encode() + b"\n" for t in texts]
        model = PlainCTW([s for s, h in zip(stream, held) if not h], depth)
        counts = Counter()
        for t, h in zip(texts, held):
            if not h:
                counts.update([*words(t), None])
        n, v = sum(counts.values()), len(counts)
        for i, t in enumerate(texts):
            tokens = [*words(t), None]
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), n)
            assert r["base_score"] == pytest.approx(base, abs=1e-8) and r["score"] == pytest.approx(model.log10(stream[i]), abs=1e-6)


def test_probabilities_of_all_bytes_sum_to_one():
    text = b"\n\n\nabracadabra alakazam\n"
    keys, n = np.unique(ctw.grams(np.frombuffer(text, np.uint8), 3), return_counts=True)
    for context in (b"abr", b"zzz", b"xbr"):
        every = np.concatenate([ctw.grams(np.frombuffer(context + bytes([x]), np.uint8), 3) for x in range(256)])
        both, at = np.unique(np.concatenate([keys, every]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([n, np.zeros(256)]), len(both))
        assert (10 ** ctw.Subtrees(both, counts, 3, 0).log10({})[np.searchsorted(both, every)]).sum() == pytest.approx(1)


def test_grams_read_the_context_nearest_first():
    for depth in (3, 5, 6):
        low = np.frombuffer(bytes(range(60, 80)), np.uint8)
        got = ctw.grams(low, depth)
        for i, key in enumerate(got.tolist(), depth):
            assert key.to_bytes(8, "big").lstrip(b"\0") == b"\x01" + bytes(low[i - depth : i][::-1]) + bytes([low[i]])
    assert len(ctw.grams(np.frombuffer(b"ab", np.uint8), 3)) == 0


def test_tallies_and_lookups():
    rng = np.random.default_rng(1)
    tally, plain = ctw.Tally(), Counter()
    tally.merged = 500
    for k in range(40):
        keys = rng.integers(1, 3000, 700, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        tally.add(keys, k % 3 > 0)
        plain.update({x: (k % 3 > 0) * c for x, c in Counter(keys.tolist()).items()})
    keys, n = tally.items()
    assert dict(zip(keys.tolist(), n.tolist())) == dict(plain)
    table = ctw.Lookup(keys, n.astype(float) + 1)
    asked = np.concatenate([keys, np.arange(1, 5000, dtype=np.uint64)])
    assert table.get(asked).tolist() == [float(plain[x] + 1) if x in plain else 0.0 for x in asked.tolist()]
    assert ctw.Tally().items()[0].size == 0 and ctw.Lookup(*ctw.Tally().items()).get(keys).sum() == 0


def test_slices_cut_between_contexts_and_lose_nothing():
    grams = np.unique(ctw.grams(np.random.default_rng(2).integers(97, 103, 4000).astype(np.uint8), 5)).view(np.int64)
    nodes = np.unique(grams >> 32) << 32 | 7 << 24
    rows = sorted([(k >> 32, 0, k, -1) for k in nodes.tolist()] + [(k >> 32, 1, k, 1) for k in grams.tolist()])
    keys, n = (np.array([r[i] for r in rows], np.int64) for i in (2, 3))
    for size in (7, 30, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(n[i : i + size])], names=["key", "n"]) for i in range(0, len(keys), size)]
        parts = list(ctw._slices(iter(batches), 5, 50))
        assert np.array_equal(np.concatenate([p[0] for p in parts]), keys) and np.array_equal(np.concatenate([p[1] for p in parts]), n)
        assert size == 5000 or len(parts) > 5 and max(len(p[0]) for p in parts) < 500
        heads = [set((k[m > 0] >> 24).tolist()) for k, m in parts]
        assert sum(map(len, heads)) == len(set().union(*heads))
    assert list(ctw._slices(iter([]), 5)) == []


def test_scores_are_the_same_in_small_slices(spark):
    """Nodes are carried from slice to slice."""
    counts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).toPandas()["text"].fillna("")
    keys, n = np.unique(np.concatenate([ctw.grams(np.frombuffer(b"\n" * 5 + t.encode()[:300] + b"\n", np.uint8), 5) for t in counts]), return_counts=True)
    table = spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), n.tolist())), "key long, n long")
    whole = dict(ctw.predictions(table, 5).collect())
    assert len(whole) == len(keys)
    small = dict(ctw.predictions(table.repartition(3), 5, 40).collect())
    assert small.keys() == whole.keys() and all(small[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def test_scores_beat_the_base_on_held_out_texts(spark):
    rows = ctw.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


def test_scores_of_nothing_null_ids_and_one_text_twice(spark):
    assert ctw.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    got = ctw.score_documents(spark.createDataFrame([(None, "a b", "", 0, 0, 0.0), (5, "a b", "", 0, 0, 0.0), (5, "a b", "", 0, 0, 0.0)], SCHEMA)).collect()
    assert len(got) == 3 and len({round(r["score"], 9) for r in got}) == 1 and {r["train_tokens"] for r in got} == {6}


def test_long_texts_cross_buffers(spark):
    from voxelgrove.llm.common import words_of

    text = ("word " * 150_000 + "x" * 700_000 + " end") .encode()
    hashes = words_of([text, b"word", b"end"])
    assert len(hashes[0]) == 150_002 and hashes[0][0] == hashes[1][0] and hashes[0][-1] == hashes[2][0]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="ab \n", max_size=400), st.integers(1, 3000).map(lambda n: "=-" * n)))
def test_bpe_equals_the_library_and_round_trips(text):
    coder = bpe.coder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and coder.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_bpe_encodings_form_a_monoid(a, b):
    coder = bpe.coder(RANKS, public_tokenizers.PATTERN)
    assert coder.join(coder.leaf(a) if a else [], coder.leaf(b) if b else []) == (coder.leaf(a + b) if a + b else [])


def test_token_digests(spark):
    texts = [None, "", "Hello  world", "<|endoftext|> é\n\n", "x" * 40_000]
    coder = bpe.coder(RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in bpe.token_digests(spark.createDataFrame([(i, t, "", 0, 0, 0.0) for i, t in enumerate(texts)], SCHEMA), RANKS, public_tokenizers.PATTERN).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.token_digests(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).collect() == []


def test_backpropagation_equals_finite_differences():
    rng = np.random.default_rng(1)
    net = langid.ByteBiGRU(["a", "b", "c"], hidden=3, seed=2)
    x, y = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = net.loss_and_grads(x, y)
    for name, g in grads.items():
        for at in list(np.ndindex(*g.shape))[:: max(1, g.size // 7)][:9]:
            keep, eps = net.p[name][at], 1e-5
            net.p[name][at] = keep + eps
            up, _ = net.loss_and_grads(x, y)
            net.p[name][at] = keep - eps
            down, _ = net.loss_and_grads(x, y)
            net.p[name][at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=1e-7)


def test_reader_predicts_what_the_network_says():
    net = langid.ByteBiGRU(["a", "b"], hidden=4, seed=3)
    text = b"hello there, general"
    x = np.frombuffer(text, np.uint8)[:, None]
    hf = np.stack([s[0] for s in net._forward(x, "f")[1:]])
    hb = np.stack([s[0] for s in net._forward(x[::-1], "b")[1:]])[::-1]
    logits = hf @ net.p["Wf"] + hb @ net.p["Wb"] + net.p["b"]
    prob = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    got = langid.predict(net.reader(), [text, b"", text * 40])
    assert got[0] == pytest.approx(prob.mean(axis=(0, 1)), abs=1e-4) and got[1].sum() == 0 and got[2].sum() == pytest.approx(1)


def plain_language(net, text):
    """The mean of every position's probabilities, window by window, one byte at a time, in float64."""
    total, h = np.zeros(len(net.classes)), net.h
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(window, d):
        state, out = np.zeros(h), []
        for x in window if d == "f" else window[::-1]:
            e, u = net.p["E" + d][x], state @ net.p["U" + d]
            z, r = sigmoid(e[:h] + u[:h]), sigmoid(e[h : 2 * h] + u[h : 2 * h])
            state = (1 - z) * np.tanh(e[2 * h :] + r * u[2 * h :]) + z * state
            out.append(state)
        return out if d == "f" else out[::-1]

    for at in range(0, len(text), langid.STEP):
        window = text[at : at + langid.STEP]
        for f, b in zip(states(window, "f"), states(window, "b")):
            logits = f @ net.p["Wf"] + b @ net.p["Wb"] + net.p["b"]
            total += np.exp(logits) / np.exp(logits).sum()
    return total / len(text)


def test_texts_of_many_windows_equal_a_plain_network():
    net = langid.ByteBiGRU(["a", "b", "c"], hidden=8, seed=7)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 127, 128, 129, 700, 5000)]
    got = langid.predict(net.reader(), texts)
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain_language(net, text), abs=2e-4)


def test_query_of_languages_equals_a_plain_network(spark):
    """Every row of the query, from the network that the same sample trains."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = langid.part_of("doc_id", 4) == 2
    langs, x, y = langid.training_sample(docs, ~held, "doc_id", "text", "lang")
    net = langid.ByteBiGRU(langs)
    net.fit(x, y)
    got = {r["doc_id"]: r for r in langid.identify_languages(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["text"] is None or not re.search(r"[^\W\d_]", r["text"]):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
        else:
            prob = plain_language(net, r["text"].encode()[: 40 * langid.STEP]) if len(r["text"]) < 5000 else None
            if prob is not None:
                assert g["score"] == pytest.approx(prob.max(), abs=1e-3) and prob[langs.index(g["lang_pred"])] > prob.max() - 1e-3


def test_a_sample_of_too_many_languages_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    monkeypatch.setattr(langid, "PER_LANG", 3)
    some = [(i, "words of a text " * 3, f"l{i % 4}") for i in range(40)]
    with pytest.raises(ValueError, match="over 2 languages"):
        langid.identify_languages(spark.createDataFrame(some, "doc_id long, text string, lang string"))


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_corner_cases(spark):
    schema = "doc_id long, text string, lang string, held_out int, lang_pred string"
    assert langid.identify_languages(spark.createDataFrame([], schema)).collect() == []
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_languages(spark.createDataFrame([(1, None, "en", 1, ""), (2, "12 !?", "en", 1, ""), (3, "alpha beta gamma " * 9, None, 1, "")], schema)).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0)}
    some = [(i, ("der die das " if i % 2 else "the of and ") * 20, "de" if i % 2 else "en", 0, "") for i in range(40)] + [(None, "the of and " * 20, "en", 0, "")]
    got = langid.identify_languages(spark.createDataFrame(some, schema)).collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] is None or r["doc_id"] % 2 == 0 else "de") for r in got) and len(got) == 41


def test_short_labelled_texts_are_learned(spark):
    rows = [(i, "niño", "es") if i % 2 else (i, "the ", "en") for i in range(200)] + [(900 + i, "x", "y") for i in range(3)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = dict((r[0], r[2]) for r in rows)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == want


def test_memory_of_pieces_is_bounded_in_bytes(monkeypatch):
    coder = bpe.TreeBPE(bpe.coder(RANKS, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    text = " ".join("ab" * (5000 + i) for i in range(3)) + " short words"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert max(map(len, coder.known)) <= bpe.PIECE
    monkeypatch.setattr(bpe, "HELD", 20_000)
    for i in range(400):
        text = " ".join(f"w{i * 7 + k}{'é' * (k % 60)}" for k in range(7))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        assert coder.held <= 20_000 and sum(sys.getsizeof(k) + sys.getsizeof(v) for d in (coder.known, coder.older) for k, v in d.items()) < 60_000


def test_short_pieces_of_several_texts_are_merged_side_by_side(monkeypatch):
    """One call for the pieces of many texts gives what the plain merge loop gives of each."""
    coder = bpe.TreeBPE(bpe.coder(RANKS, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcehtß漢é1!\n", k=rng.randint(1, 22))) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "x" * 500, "\U0001f600" * 9]
    pieces = {p.encode() for t in texts for p in coder.split.findall(t)}
    short = [p for p in pieces if len(p) <= bpe.LEAF and p not in coder.ranks]
    monkeypatch.setattr(bpe, "SIDE", 1000)
    assert len(short) > 3000 and coder.leaves(short) == [np.array(coder.leaf(p), "<u4").tobytes() for p in short] and coder.leaves([]) == []
    want = [np.array([i for p in coder.split.findall(t) for i in coder.encode_piece(p.encode())], "<u4").tobytes() for t in texts]
    calls = []
    monkeypatch.setattr(coder, "leaf", lambda p, leaf=coder.leaf: calls.append(p) or leaf(p))
    apart = [k for k, t in enumerate(texts) if all(len(p.encode()) <= bpe.LEAF for p in coder.split.findall(t))]
    assert len(apart) > 50 and list(coder.encode_all(texts[k] for k in apart)) == [want[k] for k in apart] and not calls
    assert list(coder.encode_all(texts)) == want
    assert [coder.decode(x).decode() for x in want] == texts
