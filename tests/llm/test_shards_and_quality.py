"""Sharding and quality rules against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm import quality, queries, sharding
from rows import ODD, frame


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, n = 0, 1
        for s in sizes:
            if used + s > mid:
                used, n = 0, n + 1
            used += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def groups(spark, sizes):
    hashes = [(k * 0x9E3779B97F4A7C15 + 12345) % 2**64 for k in range(len(sizes))]
    rows = [(h - 2**64 if h >= 2**63 else h, s) for h, s in zip(hashes, sizes)]
    ordered = [s for _, s in sorted(zip(hashes, sizes))]
    return spark.createDataFrame(rows, "h long, size long"), ordered


@pytest.mark.parametrize("sizes", [[5], [3, 3], [1] * 40, [10, 1, 1, 1, 30, 1, 2, 2, 9, 9, 9, 1], [1000] + [1] * 100, list(range(1, 400))])
def test_capacity_is_minimal(spark, sizes):
    df, ordered = groups(spark, sizes)
    for first, fan in ((2, 2), (12, 8)):
        capacity, cuts = sharding.minimax_cuts(df.cache(), 8, first, fan)
        assert capacity == brute_capacity(ordered, 8)
        assert len(cuts) <= 7 and cuts == sorted(cuts)


def check_shards(docs, rows, shards=8):
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in rows) == Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    of = defaultdict(set)
    for r in rows:
        of[(r.text_crc32, r.size)].add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_shards(spark, odd, none, small):
    check_shards(ODD, sharding.shard_by_bytes(odd).collect())
    assert sharding.shard_by_bytes(none).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.op4_sharding(spark, small).collect()
    check_shards([(d.doc_id, d.text) for d in docs.collect()], rows)
    total, most = sum(r.size for r in rows), max(Counter({s: sum(r.size for r in rows if r.shard == s) for s in range(8)}).values())
    group = Counter()
    for r in rows:
        group[r.text_crc32] += r.size
    assert most <= total / 8 + max(group.values())


def test_a_third_of_all_rows_alike(spark):
    docs = [(i, "the same text" if i % 3 == 0 else f"text number {i} " * (i % 7)) for i in range(600)]
    check_shards(docs, sharding.shard_by_bytes(frame(spark, docs)).collect())


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def measured(df):
    return Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect())


TEXTS = ["a b c d e a b c d e", "a b c d e f a b c d e f g", "x x x x x x x", "a b\x1cc d e", "l1\nl1\n\n \nl1\r\nl1\r", "#*$%&|<> ab|cd", "one", "a a a a", "w " * 50 + "\nq", "a\x0bb\x0cc d e a\tb c d e", "trailing ", " leading", "é ü 日本"]


def test_measurements(spark, odd, none):
    docs = [*ODD, *[(100 + i, t) for i, t in enumerate(TEXTS)]]
    want = Counter((str(i), *brute_quality(t)) for i, t, *_ in docs)
    assert measured(quality.ledger(frame(spark, docs))) == want
    assert quality.ledger(none).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\t", "|", "é", " "]), max_size=40).map(" ".join), min_size=1, max_size=12))
def test_measurements_of_random_texts(spark, texts):
    docs = list(enumerate(texts))
    assert measured(quality.measurements(frame(spark, docs))) == Counter((str(i), *brute_quality(t)) for i, t in docs)


def test_policies_and_ablations(spark, small):
    rows = quality.ledger(frame(spark, [(i, t) for i, t in enumerate(["good words " + " ".join(f"w{k}" for k in range(20)), "too few", "| alpha | beta | gamma | delta | epsilon | zeta | eta | theta | iota | kappa |", "same line of words here\n" * 10, None])])).cache()
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.apply_policy(rows, 2).collect()}
    assert kept == {0: (False, True), 1: (True, False), 2: (False, False), 3: (True, False), 4: (True, False)}
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(rows, 2).collect()}
    assert found["few_words"] == (2, 2, 3) and found["symbols"] == (1, 1, 2) and found["repeated_lines"] == (1, 0, 1)
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    done = queries.op8_quality_rules(spark, small)
    assert done.count() == n and "Python" not in done._jdf.queryExecution().toString()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.base_failed or not r.kept) for r in done.collect())


def test_open_segments_are_split_by_their_own_width(spark, monkeypatch):
    """Heavy groups close together, light ones far apart: most of the light ones never come to the driver."""
    rows = [(i << 20, 5) for i in range(4096)] + [((1 << 62) + (i << 50), 7) for i in range(2048)]
    df = spark.createDataFrame([(h, s) for h, s in rows], "h long, size long").cache()
    segments = []
    walk = sharding._walk
    monkeypatch.setattr(sharding, "_walk", lambda found, *a: (segments.append(len(found)), walk(found, *a))[1])
    capacity, cuts = sharding.minimax_cuts(df, 8, 2, 4)
    assert capacity == brute_capacity([s for _, s in sorted(rows)], 8) and len(cuts) <= 7 and max(segments) < len(rows) / 4


def test_a_hot_text_is_numbered_in_parts(spark):
    docs = [(i, "the same text") for i in range(300)] + [(i, f"text {i}") for i in range(300, 340)] + [(None, "the same text")] * 3
    check_shards(docs, sharding.shard_by_bytes(frame(spark, docs), sorted_rows=20).collect())
