"""Encoding by shared chunks against the library on whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrivener.llm import bpe
from scrivener.llm.common import read
from scrivener.llm.tokens import default_path

PATHS = [default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def whole(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def got(docs, path=None):
    return collections.Counter(tuple(r) for r in bpe.encode_decode(docs, path).collect())


def odd_texts(n, seed):
    rng = random.Random(seed)
    bits = ["the ", "Word", "İ", "Σ", "ς", "don't", "'S", "it's ", "\n\n", "  ", "\t", "\xa0", "\x85", "\x1c", "é", "e\u0301", "\u0308", "日本語", "\U0001f600", "123", "½", "<|endoftext|>", "<|startoftext|>", "<|", "!!", "...", "ŉ", "Ǆ", "a" * 40, "'", "\u200b", "ﬁ", "K", "\x00", "-"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("path", PATHS)
def test_codec_is_the_library(spark, path):
    t, c = library(path), bpe.codec(path)
    texts = odd_texts(1500, 1) + [r.text or "" for r in read(spark, "/root/testdata/sf0.001", "documents").collect()]
    for x in texts:
        ids = c.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
        assert c.decode(ids) == t.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("path", PATHS)
def test_joins_at_any_cut(spark, path):
    """Whatever the cuts, joined pieces have the ids of the whole text, and a long text is not encoded again."""
    c, rng = bpe.codec(path), random.Random(2)
    texts = odd_texts(300, 3) + [r.text for r in read(spark, "/root/testdata/sf0.001", "documents").limit(100).collect() if r.text]
    for x in texts:
        cuts = sorted({0, len(x), *(rng.randint(0, len(x)) for _ in range(rng.choice([1, 3, 9])))})
        pieces = [bpe.Piece(x[a:b], c.encode(x[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert bpe.assemble(pieces, c.encode) == c.encode(x), x
    asked = []
    long = " ".join(f"word{k}" for k in range(20_000))
    pieces = [bpe.Piece(x, c.encode(x)) for x in (long[:60_001], long[60_001:])]
    assert bpe.join(*pieces, lambda x: (asked.append(len(x)), c.encode(x))[1]).ids == c.encode(long) and sum(asked) < 1000


def test_chunks_are_the_text_and_follow_content(spark):
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 10**6)}é" for _ in range(3000)]
    for x in ("", "a", "a" * 5000, "日本" * 3000, " ".join(words)):
        assert b"".join(bpe.chunks(x)).decode() == x
        assert all(len(y.decode()) for y in bpe.chunks(x))
    passage = " ".join(words)
    a, b = set(bpe.chunks("other begin " + passage)), set(bpe.chunks("another one " * 3 + passage + " and end"))
    assert len(a & b) > 0.8 * len(a) > 10


def test_operator_on_documents(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    t = library(PATHS[0])
    assert got(docs) == collections.Counter((r.doc_id, *whole(t, r.text)) for r in docs.collect())


def test_operator_hard(spark):
    """Nulls, empty and very long texts, copies, shared passages, texts without white space, special strings, clashing names."""
    rng = random.Random(5)
    passage = " ".join(f"passage{rng.randint(0, 9999)}" for _ in range(300))
    solid = "".join(rng.choice("日本語中文字abc") for _ in range(3000))
    rows = [(1, None), (2, ""), (None, passage), (3, passage), (3, passage), (4, "x " + passage), (5, passage + " y<|endoftext|> z"), (6, passage.replace(" ", "\n", 9) + passage), (7, "ab c " * 40_000), (8, solid), (9, "q" + solid), (10, solid + " " + passage), (11, " \n"), (1 << 60, "x")]
    rows += [(100 + k, x + passage[k * 7 :]) for k, x in enumerate(odd_texts(60, 6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("text_key", "pos", "digest", "ids", "runs", "n_tokens")}).repartition(3)
    for path in PATHS:
        t = library(path)
        assert got(docs, path) == collections.Counter((i, *whole(t, x)) for i, x in rows)
    assert got(docs.limit(0)) == collections.Counter()


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    """What is asked of the codec for shared chunks is each of them once, whatever the number of documents."""
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(2000))
    docs = spark.createDataFrame([(k, f"begin {k} " + passage) for k in range(40)], "doc_id long, text string").repartition(4)
    made = []
    own = bpe.materialize
    monkeypatch.setattr(bpe, "materialize", lambda df, label, **k: (made.append((label, out := own(df, label, **k))), out)[1])
    monkeypatch.setattr(bpe, "scratch", lambda spark: __import__("contextlib").nullcontext())
    bpe.encode_decode(docs).collect()
    chunks = dict(made)["bpe-chunks"]
    assert chunks.count() == chunks.select("digest").distinct().count() < 60
    assert chunks.agg(F.sum(F.length("text"))).first()[0] > 0.9 * len(passage)
