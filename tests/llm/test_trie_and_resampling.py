"""Prefix trie and importance resampling against brute force, and on hard rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scrivener.llm import resample, trie
from scrivener.llm.common import read

CLASH = ["pos", "depth", "node", "parent", "range", "row", "n", "h", "base", "turn_key", "chars", "ends", "length", "total"]


def rebuild(rows, group, heads):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append(((turn is not None, turn or 0), key, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    return {c: own.get(c - int(math.fmod(c, group)), [])[: zlib.crc32(str(c).encode()) % heads] + own[c][zlib.crc32(str(c).encode()) % heads :] for c in own}


def brute_trie(rows, group=100, heads=6):
    convs = rebuild(rows, group, heads)
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got_trie(df, **options):
    return sorted((tuple(r) for r in trie.prefix_trie(df, **options).select(*trie.COLUMNS).collect()), key=str)


def test_trie_of_the_table(spark):
    table = read(spark, "/root/testdata/sf0.01", "conversations")
    assert got_trie(table) == brute_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_shared_turns(spark, monkeypatch):
    """Copies, shared fronts, a conversation that spans ranges, ids of both signs, groups of ids over one block."""
    rng = random.Random(5)
    monkeypatch.setattr(trie, "BLOCK", 8)
    rows = []
    for c in [*range(-30, 60), *range(200, 230)]:
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "bé", "", None, "\U0001f600x"])) for t in range(rng.choice([1, 2, 3, 5, 7]))]
    for c in (300, 301, 302, 303):
        rows += [(c, t, "user", f"turn {t}" if c < 303 or t < 5 else "other") for t in range(8)]
    rows += [(400, t, "user", f"long {t % 7}") for t in range(500)] + [(1 << 40, 0, "user", "far")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert got_trie(df) == brute_trie(rows)


def test_trie_hard(spark):
    rows = [(None, 0, "user", "x"), (0, None, "user", "first"), (0, 2, "user", "third"), (0, 1, None, None), (0, 1, None, None), (0, 1, "b", "tie"), (7, 0, "user", "w " * 200_000), (8, 1, "", ""), (9, 5, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASH})
    assert got_trie(df) == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0 and trie.prefix_trie(df.filter("conv_id is null")).count() == 0


def test_trie_levels_end_where_conversations_part(spark):
    """Long conversations that share two turns take three levels, and equal ones none beyond their own."""
    rows = [(c, t, "user", f"{t}" if t < 2 else f"{c} {t}") for c in (1, 2) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = []
    own = trie.materialize
    trie.materialize = lambda df, label, **k: (made.append(label), own(df, label, **k))[1]
    try:
        assert got_trie(df, group=1000, heads=1) == brute_trie(rows, 1000, 1)
    finally:
        trie.materialize = own
    assert made.count("trie-level") == 3


# resampling ------------------------------------------------------------------------


def runs(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, percent=10, least=20, longest=1, n_buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in runs(t, longest)[1])
    t = collections.Counter(bucket(f) for x in target for f in runs(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + n_buckets) / ((s[b] + 1) * (t_all + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for i, x in docs:
        w, f = runs(x, longest)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = [(*r[:4], n if n <= percent * len(able) // 100 else None) for n, r in enumerate(able, 1)]
    return sorted([*drawn, *((*r[:4], None) for r in rows if not r[4])], key=str)


def got_resample(docs, target, **options):
    return sorted((tuple(r) for r in resample.resample(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resample_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, target = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    rows, texts = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    assert got_resample(docs, target) == brute_resample(rows, texts)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_options_and_hard_rows(spark, longest):
    rng = random.Random(longest)
    rows = [(k % 90, " ".join(rng.choice(["Aa", "b", "É", "x1", "-", "\x7f", "日本", "The"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(None, None), (None, "a b " * 30), (None, "a b " * 30), (500, ""), (501, " \n"), (502, "word " * 200_000), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("b", "w", "s", "t", "n_words", "weight", "score", "row", "range", "total", "part")})
    target = spark.createDataFrame([(1, "the b b É"), (2, None)], "item_id long, text string")
    options = {"longest": longest, "n_buckets": 50, "percent": 33}
    assert got_resample(docs, target, least_words=5, **options) == brute_resample(rows, ["the b b É", None], least=5, **options)
    assert resample.resample(docs.limit(0), target).count() == 0
    assert got_resample(docs, target.limit(0), **options) == brute_resample(rows, [], **options)


def test_resample_scores_without_generate(spark):
    """Words are exploded for the totals alone: gains reach the scores as one literal."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = docs.select(F.aggregate(resample.buckets(resample.words(), 1, 10), F.lit(0).cast("long"), lambda a, x: a + F.element_at(F.split(F.lit("1,2"), ",").cast("array<bigint>"), x + 1)).alias("x"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "split(" not in text and "Exchange" not in text
