"""Repeats, decontamination, licenses and near-duplicates against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from larkspan.llm import decontamination as DC
from larkspan.llm import licenses, near_duplicates, queries, repeats
from larkspan.llm.common import durable
from rows import LONG, ODD, frame

# repeats


def brute_repeats(docs, length=50):
    starts = defaultdict(lambda: 2**62)
    for i, t, *_ in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                g = b[p : p + length]
                starts[g] = min(starts[g], i)
    out = Counter()
    for i, t, *_ in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and starts[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[(str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


def got_repeats(df, **options):
    return Counter((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(df, **options).collect())


def mixed(seed, n=60):
    """Documents that share passages, are copies, repeat themselves, or hold odd bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé\0") for _ in range(rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        docs.append((rng.randint(0, 40) if rng.random() < 0.2 else i, "".join(parts)))
    return docs + [(999, docs[3][1]), (-5, docs[4][1]), (1000, "z" * 400), (1001, "z" * 300)]


@pytest.mark.parametrize("options", [{}, {"batch_bytes": 700, "bucket_bytes": 400, "level": 64}, {"batch_bytes": 300, "bucket_bytes": 2000, "hot": 1, "level": 16}])
def test_repeats(spark, options):
    docs = mixed(len(options))
    assert got_repeats(frame(spark, docs).repartition(5), **options) == brute_repeats(docs)


def test_repeats_of_odd_rows(spark, odd, none):
    docs = [d for d in ODD if d[1] != LONG]
    assert got_repeats(frame(spark, docs)) == brute_repeats(docs)
    assert repeats.removed(odd).count() == len(ODD)
    assert repeats.removed(none).count() == 0 and repeats.without_repeats(none).columns == none.columns


def test_repeats_with_other_lengths(spark):
    docs = mixed(9, 30)
    assert got_repeats(frame(spark, docs), length=24, gram=8) == brute_repeats(docs, 24)


@pytest.mark.parametrize("hot", [1, 2000])
def test_an_index_takes_further_batches(spark, tmp_path, hot):
    """Batch after batch gives what all documents at once do; levels stay few and grow geometrically."""
    docs = sorted((i, t) for i, t in mixed(4, 90) if i >= 0)
    docs = [(k, t) for k, (_, t) in enumerate(docs)] + [(None, docs[3][1])]
    path, got, at = str(tmp_path / "index"), Counter(), 0
    for n in (30, 10, 10, 0, 20, len(docs)):
        index = repeats.Index(spark, path, 16, batch_bytes=900, hot=hot, level=64)  # reopened each time
        rows = index.add(frame(spark, docs[at : at + n]).repartition(2)).collect()
        assert len(rows) == len(docs[at : at + n])
        got += Counter((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
        at += n
    assert got == brute_repeats(docs)
    sizes = index.levels()
    assert sum(sizes) == sum(len(t.encode()) for _, t in docs) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    with pytest.raises(ValueError):
        index.add(frame(spark, [(5, "an id from before")]))


def test_the_largest_id_is_an_id(spark):
    passage = "a passage of more than fifty bytes that two of the documents hold"
    docs = [(2**63 - 1, passage), (2**63 - 2, passage), (None, passage), (-(2**63), "x" + passage)]
    assert got_repeats(frame(spark, docs)) == brute_repeats(docs)


def test_hot_windows_are_folded(spark, monkeypatch):
    """A passage that every batch has; no bucket of hot windows may hold more of it than a few batches."""
    passage = "".join(random.Random(7).choices("abcdef ", k=140))
    docs = [(i, f"{i:05d} {passage} {i * i:09d}") for i in range(240)]
    options = {"batch_bytes": 400, "bucket_bytes": 4000, "hot": 4, "level": 64}
    assert got_repeats(frame(spark, docs).repartition(6), **options) == brute_repeats(docs)
    docs += [(i, passage[i % 30 :] + "é" * (i % 90)) for i in range(300, 380)]
    assert got_repeats(frame(spark, docs).repartition(3), **options) == brute_repeats(docs)


def shuffled(spark):
    """Bytes that all stages so far wrote for a shuffle."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_strings_shared_by_chance_do_not_travel(spark):
    """Of words like these every 16 bytes are in many documents, but hardly any 33 are."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=16)) for _ in range(60)]
    docs = [(i, "".join(rng.choices(words, k=40))) for i in range(200)]
    before = shuffled(spark)
    assert got_repeats(frame(spark, docs).repartition(4), batch_bytes=8000) == brute_repeats(docs)
    assert shuffled(spark) - before < 1.6 * sum(len(t) for _, t in docs)


def test_only_hot_windows_are_written_on_the_way(spark, monkeypatch):
    """Copies that two batches share aren't written again because all batches share a line."""
    rng = random.Random(6)
    line = "a line of a license that is in each and every one of the documents"
    texts = ["".join(rng.choices("abcdefgh ", k=500)) for _ in range(30)]
    docs = [(i, texts[i % 30] + line + str(i)) for i in range(60)]
    made = []
    monkeypatch.setattr(repeats, "durable", lambda df: made.append(durable(df)) or made[-1])
    assert got_repeats(frame(spark, docs).repartition(6), batch_bytes=1200, bucket_bytes=1 << 30, hot=8) == brute_repeats(docs)
    written = [df for df in made if df.columns == ["bucket", "batch", "blob"]]
    assert written and all(df.where("bucket >= 8").count() for df in written)
    assert sum(df.where("bucket between 0 and 7").count() for df in written) == 0


@pytest.mark.parametrize(("length", "gram"), [(50, 16), (24, 8), (17, 16), (16, 16)])
def test_equal_windows_have_equal_contexts(length, gram):
    """Each window is in one run, and its bytes alone decide anchor and context."""
    rng = random.Random(length)
    texts = [t.encode() for _, t in mixed(2)] + [b"ab" * 90, b"abc" * 50, b"z" * 120, bytes(rng.choices(b"ab", k=3000)), b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    seen, told = [], {}
    for value, context, first, last, owner in zip(*(x.tolist() for x in repeats.anchors(data, starts, length, gram))):
        for w in range(first, last + 1):
            assert starts[owner] <= w and w + length <= starts[owner + 1]
            assert told.setdefault(data[w : w + length].tobytes(), (value, context)) == (value, context)
            seen.append(w)
    assert seen == [p for a, b in zip(starts, starts[1:]) for p in range(a, b - length + 1)]


def test_strings_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(repeats, "string_hashes", lambda data, begin, size: np.zeros(len(begin), np.uint64))
    data = np.frombuffer(b"abcdefghi" * 2 + b"abcdefgxx" + b"abcdefghi", np.uint8)
    begin, size = np.array([0, 9, 18, 27, 0]), np.array([9, 9, 9, 9, 8])
    assert repeats._earlier(data, begin, size, np.array([1, 2, 3, 4, 5])).tolist() == [False, True, False, True, False]


def test_texts_without_repeats(spark):
    passage = "é" * 60
    df = frame(spark, [(1, passage + " one"), (2, "two " + passage), (3, passage), (4, None)])
    rows = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert rows[1].text == passage + " one" and rows[2].text == "two " and 3 not in rows and rows[4].text is None and rows[2].shard == "x"


def test_suffix_levels_grow_geometrically():
    index = repeats.SuffixLevels(4, 8)
    data = np.frombuffer(bytes(random.Random(1).choices(range(97, 101), k=4000)), np.uint8)
    seen, raw = set(), data.tobytes()
    for k in range(0, 3900, 50):
        at = np.arange(k, k + 50)
        hits = index.add(data, at, np.full(50, k))
        assert hits.tolist() == [raw[p : p + 4] in seen for p in at]
        seen |= {raw[p : p + 4] for p in at}
    assert len(index.levels) <= 8 and all(len(a) > 2 * len(b) for a, b in zip(index.levels, index.levels[1:]))


# decontamination


def distance_in(item, text):
    """Least edits from the item to any substring."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for j, c in enumerate(item, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != ch)))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_matching_is_exact(spark):
    rng = random.Random(2)
    items = ["".join(rng.choice("abcd ") for _ in range(rng.randint(30, 70))) for _ in range(8)]
    docs = []
    for i in range(60):
        s = list(rng.choice(items))
        for _ in range(rng.randint(0, 7)):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice(["", rng.choice("abcd"), rng.choice("abcd") * 2])
        pad = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 20)))
        docs.append((i, pad() + "".join(s).upper() + pad()))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: {m.item_id: (m.distance, m.begin, m.end) for m in r.matches} for r in DC.contamination(frame(spark, docs), table, 0.1).collect()}
    for i, t in docs:
        text = DC.normalise(t)
        want = {k: d for k, x in enumerate(items) if (n := DC.normalise(x)) and (d := distance_in(n, text)) <= int(0.1 * len(n))}
        assert set(got[i]) == set(want), i
        for k, (d, a, b) in got[i].items():
            assert want[k] == d and distance_in(DC.normalise(items[k]), text[a:b]) == d


def test_decontamination_rows(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "seven  EIGHT nine ten eleven"), (2, None), (3, ""), (1, "seven eight nine ten eleven"), (4, "dolor sit amet consectetur lorem")], "item_id long, text string")
    rows = DC.contamination(odd, items).collect()
    assert len(rows) == len(ODD) and sorted(str(r.doc_id) for r in rows if r.contaminated) == ["1", "6", "7", "7"]
    monkeypatch.setattr(DC, "BLOCK_CHARS", 10)  # one item a block
    again = DC.contamination(odd.where("doc_id = 6"), items).collect()
    assert [[m.item_id for m in r.matches] for r in again] == [[4]]
    assert DC.contamination(none, items).count() == 0 and not any(r.contaminated for r in DC.contamination(odd, items.limit(0)).collect())
    left = DC.without_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == len(ODD) - 4


def test_blocks_of_items_change_no_row(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, "seven eight nine ten eleven"), (2, "dolor sit amet consectetur lorem"), (3, "only where the id is null")], "item_id long, text string")
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(None, "only where the id is null"), (None, "another"), (7, "another")], "doc_id long, text string"))
    found = lambda: Counter((str(r.doc_id), r.contaminated, str(r.matches)) for r in DC.contamination(docs, items).collect())
    whole = found()
    monkeypatch.setattr(DC, "BLOCK_CHARS", 10)  # one item a block
    assert found() == whole and sum(whole.values()) == len(ODD) + 3


def test_blocks_of_items_drop_the_same_rows(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, "seven eight nine ten eleven"), (2, "dolor sit amet consectetur lorem")], "item_id long, text string")
    left = lambda: Counter(str(r) for r in DC.without_contaminated(odd, items).collect())
    whole = left()
    monkeypatch.setattr(DC, "BLOCK_CHARS", 10)  # one item a block
    assert left() == whole and sum(whole.values()) == len(ODD) - 4 and DC.without_contaminated(odd, items).columns == odd.columns


def test_decontamination_query(spark, small):
    items = [DC.normalise(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = {r.doc_id: r.contaminated for r in queries.op7_decontamination(spark, small).collect()}
    assert all(rows[d.doc_id] for d in docs if any(x in DC.normalise(d.text) for x in items)) and len(rows) == len(docs)


# licenses


def test_licenses(spark, odd, none, small):
    grant = dict((i, t) for i, (_, t) in enumerate(licenses.TEMPLATES))
    edited = grant[0].replace("free of charge,", "").replace("publish", "publish and show").upper()
    docs = [(1, f"Some words.\n{edited}\nMore words."), (2, "This one is licensed to nobody under the sun."), (3, "ah " * 10 + "Released under the MIT License. " + "Licensed under CC BY-SA 4.0."), (4, " ".join(grant[0].split()[:20]))]
    rows = {r.doc_id: r.matches for r in licenses.scan(frame(spark, docs)).collect()}
    (m,) = rows[1]
    assert m.license == "MIT" and 0.95 < m.coverage < 1 and docs[0][1][m.begin : m.end].startswith("PERMISSION IS") and docs[0][1][m.begin : m.end].endswith("SOFTWARE")
    assert rows[2] == [] and rows[4] == []
    assert [(x.license, docs[2][1][x.begin : x.end]) for x in rows[3]] == [("MIT", "Released under the MIT License"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0")]
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0
    got = {r.doc_id: r.n_matches for r in queries.op5_license_scans(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    whole = [t for _, t in licenses.TEMPLATES]
    assert all((got[d.doc_id] > 0) == any(t in d.text for t in whole) for d in docs)


def test_license_lines_of_the_documents(spark, small):
    """The lines as documents hold them, read off sf0.1 and not taken from the templates."""
    lines = {"All rights reserved.": "proprietary", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    scanner = licenses.Scanner(list(licenses.TEMPLATES))
    for line, license in lines.items():
        text = f"Some words of a text.\n{line}\nand more"
        assert [(m[0], text[m[3] : m[4]]) for m in scanner.scan(text)] == [(license, line.rstrip("."))]
    got = {r.doc_id: r.n_matches for r in queries.op5_license_scans(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert any("All rights reserved." in d.text for d in docs) and all((got[d.doc_id] > 0) == any(x in d.text for x in lines) for d in docs)


def common_words(a, b):
    """Most words of ``a`` in order in ``b``."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(row[j], new[j - 1], row[j - 1] + (x == y)))
        row = new
    return row[-1]


def test_every_edit_of_a_template_is_found():
    """One-word deletions, insertions and replacements, and each fifth word gone, against full alignment."""
    for name, template in licenses.TEMPLATES:
        words = licenses._WORD.findall(template.lower())
        scanner = licenses.Scanner([(name, template)])
        edits = [[*words[:i], *put, *words[i + cut :]] for i in range(len(words)) for put, cut in (((), 1), (("new",), 0), (("new",), 1))]
        edits += [[w for j, w in enumerate(words) if j % 5 != r] for r in range(5)]
        for edited in edits:
            share = common_words(words, edited) / len(words)
            got = scanner.scan("before it " + " ".join(edited) + " and after")
            assert [m[2] for m in got] == ([round(share, 4)] if share >= licenses.MIN_COVERAGE else []), edited
    scanner = licenses.Scanner(list(licenses.TEMPLATES))
    for text, license in (("Released under MIT License", "MIT"), ("Released under the new MIT License", "MIT"), ("Licensed under Creative CC new BY 4.0", "CC-BY-4.0")):
        assert license in {m[0] for m in scanner.scan(text)}


def test_random_edits_of_whole_texts_against_full_alignment():
    rng = random.Random(12)
    for name, template in licenses.TEXTS:
        words = licenses._WORD.findall(template.lower())
        scanner = licenses.Scanner([(name, template)])
        for rate in (0, 0.05, 0.12, 0.17, 0.3):
            edited = [x for w in words for x in (([], ["new"], [w, "new"])[rng.randrange(3)] if rng.random() < rate else [w])]
            text = "before it, " + " ".join(edited).upper() + "; and after"
            share = common_words(words, edited) / len(words)
            got = scanner.scan(text)
            assert [m[2] for m in got] == ([round(share, 4)] if share >= licenses.MIN_COVERAGE else []), (name, rate)
            for m in got:
                part = licenses._WORD.findall(text[m[3] : m[4]].lower())
                assert common_words(words, part) == round(share * len(words)) and part[0] in words and part[-1] in words


def test_repeated_notices_and_spans_in_any_case():
    scanner = licenses.Scanner(list(licenses.TEMPLATES + licenses.TEXTS))
    line = "Released under the MIT License."
    for gap in ("", "one ", "one two three ", "mit license the " * 2):
        text = (line + " " + gap) * 40
        got = scanner.scan(text)
        assert len(got) == 40 and all(text[m[3] : m[4]] == line[:-1] for m in got), gap
    worse = "Released under MIT License. "
    assert len(scanner.scan((line + " " + worse) * 30)) == 60
    text = "İstanbul. Licensed under CC BY-NC 4.0. İ İ All rights reserved. İ"
    assert [(m[0], text[m[3] : m[4]]) for m in scanner.scan(text)] == [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("proprietary", "All rights reserved")]
    assert [m[2:] for m in licenses.Scanner([("A", "two words")]).scan("these two words")] == [(1.0, 6, 15)]
    with pytest.raises(ValueError):
        licenses.Scanner([("A", "...")])


def test_many_matches_take_no_square():
    import time

    scanner = licenses.Scanner(list(licenses.TEMPLATES + licenses.TEXTS))

    def took(n):
        at = time.perf_counter()
        assert len(scanner.scan("All rights reserved. Released under the MIT License. " * n)) == 2 * n
        return time.perf_counter() - at

    took(100)
    assert took(4000) < 12 * max(took(1000), 0.05)


# near-duplicates


def brute_classes(docs, similarity=0.8):
    s = near_duplicates.Shingles()
    sets = [s.set(t or "") for _, t, *_ in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            same = (docs[a][1] or "") == (docs[b][1] or "") or near_duplicates.jaccard(sets[a], sets[b]) >= similarity
            if same and docs[a][0] is not None and docs[b][0] is not None:
                parent[root(a)] = root(b)
    least = {}
    for a, (i, *_) in enumerate(docs):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return Counter((str(i), str(least[root(a)] if i is not None else None)) for a, (i, *_) in enumerate(docs))


def families(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    docs, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            text = rng.choice(base).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = word()
            docs.append((i, " ".join(text)))
        else:
            base.append(" ".join(word() for _ in range(rng.randint(60, 160))))
            docs.append((i, base[-1]))
    return docs


@pytest.mark.parametrize(("bucket", "cap"), [(512, 4096), (8, 4096), (16, 24)])
def test_classes(spark, bucket, cap):
    docs = families(bucket, 260)
    got = Counter((str(r.doc_id), str(r.class_id)) for r in near_duplicates.near_duplicate_classes(frame(spark, docs), bucket=bucket, cap=cap).collect())
    assert got == brute_classes(docs)


def test_dense_borderline_groups_lose_no_link(spark):
    """Variants of one text, many linked only through others; edges are sent for one neighbour at first."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    docs = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
        docs.append((i, " ".join(text)))
    got = Counter((str(r.doc_id), str(r.class_id)) for r in near_duplicates.near_duplicate_classes(frame(spark, docs), few=0).collect())
    assert got == brute_classes(docs) and 1 < len({c for _, c in got}) < 60


@pytest.mark.parametrize("cap", [16, 4096])
def test_a_hot_group_beyond_the_cap_loses_no_pair(spark, cap):
    """All texts share boilerplate, so buckets hold about half of them; each has one near copy."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    boiler = [word() for _ in range(150)]
    docs = []
    for i in range(0, 400, 2):
        own = [word() for _ in range(44)]
        copy = boiler + own[:26] + [word() for _ in range(18)]
        docs += [(i, " ".join(boiler + own)), (i + 1, " ".join(copy))]
    got = Counter((str(r.doc_id), str(r.class_id)) for r in near_duplicates.near_duplicate_classes(frame(spark, docs), cap=cap).collect())
    want = brute_classes(docs)
    assert len({c for _, c in want}) == 200 and got == want


def test_classes_of_odd_rows(spark, odd, none):
    got = Counter((str(r.doc_id), str(r.class_id)) for r in near_duplicates.near_duplicate_classes(odd).collect())
    assert got == brute_classes(ODD)
    assert near_duplicates.near_duplicate_classes(none).count() == 0
    turned = odd.select(*reversed(odd.columns))
    kept = near_duplicates.one_of_each_class(turned)
    assert kept.columns == turned.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["-3", "1", "2", "4", "5", "6", "8", "9", "None"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 9), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict((r.node, r.label) for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 9: 5, 8: 5, 5: 5, 20: 20, 21: 20, **{100 + i: 100 for i in range(41)}}


def test_plan_keeps_the_recall():
    for n in (1, 1000, 10**6, 10**9):
        bits, tables, near = near_duplicates.plan(n)
        p = near_duplicates.agreement(0.8)
        assert (1 - p**bits) ** tables <= near_duplicates.MISS and n / 2**bits <= near_duplicates.BUCKET and near < 80


def at_the_threshold(pairs, low=0.8, high=0.84, seed=5):
    """Pairs of texts, unlike all others, of a Jaccard similarity from ``low`` to ``high``."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    s, docs = near_duplicates.Shingles(), []
    while len(docs) < 2 * pairs:
        one = [word() for _ in range(rng.randint(8, 160))]
        two = list(one)
        for _ in range(rng.randint(1, 4)):
            two[rng.randrange(len(two))] = word()
        if rng.random() < 0.5:
            two = one[: int(len(one) * rng.uniform(0.8, 1)) + 1]
        if low <= near_duplicates.jaccard(s.set(" ".join(one)), s.set(" ".join(two))) <= high:
            docs += [(len(docs), " ".join(one)), (len(docs) + 1, " ".join(two))]
    return docs


@pytest.mark.parametrize("partitions", [1, 4, 32, 200])
def test_recall_at_the_threshold_whatever_the_partitions(spark, partitions):
    docs = at_the_threshold(300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(frame(spark, docs), bucket=300).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(classes[i] in (i, i - 1) for i in classes) and sum(classes[i + 1] == i for i in range(0, 600, 2)) >= 0.99 * 300


def test_recall_of_texts_of_few_words(spark):
    """Sets of 4 to 12 shingles, of which the larger has one or two more; ties make their bits agree less."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    docs = []
    for i in range(0, 1600, 2):
        n = rng.choice([4, 5, 8, 9, 10, 12])
        text = [word() for _ in range(n + 4)]
        docs += [(i, " ".join(text)), (i + 1, " ".join([*text, *(word() for _ in range(n // 4))]))]
    classes = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(frame(spark, docs), bucket=64).collect()}
    assert sum(classes[i + 1] == i for i in range(0, 1600, 2)) >= 0.995 * 800 and all(classes[i] in (i, i - 1) for i in classes)


def test_no_more_edges_than_rows_in_a_table(spark):
    """Variants of one text under the threshold: forests, not pairs, leave the buckets and the groups."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    edges = {}
    for n in (150, 300, 600):
        docs = []
        for i in range(n):
            text = list(base)
            for at in rng.sample(range(150), 5):
                text[at] = f"new{rng.randrange(10**6)}"
            docs.append((i, " ".join(text)))
        s = near_duplicates.Shingles()
        rows = [(hash_, s.fingerprint(x), len(x)) for hash_, (_, t) in enumerate(docs) for x in [s.set(t)]]
        prints = spark.createDataFrame(rows, "node long, print binary, n int")
        edges[n] = near_duplicates._near_edges(prints, 1, 4, 58, 4096, 0.8).count()
        assert edges[n] <= 8 * n
    assert edges[600] < 3 * edges[300] < 9 * edges[150]
    got = Counter((str(r.doc_id), str(r.class_id)) for r in near_duplicates.near_duplicate_classes(frame(spark, docs[:200])).collect())
    assert got == brute_classes(docs[:200])


@pytest.mark.parametrize("block_rows", [16, 2048])
def test_groups_in_blocks_lose_no_link(spark, block_rows):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    docs = []
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 3, 4])):
            text[at] = f"new{rng.randrange(10**6)}"
        docs.append((i, " ".join(text)))
    got = Counter((str(r.doc_id), str(r.class_id)) for r in near_duplicates.near_duplicate_classes(frame(spark, docs), few=0, block_rows=block_rows).collect())
    assert got == brute_classes(docs) and 1 < len({c for _, c in got}) < 150


@pytest.mark.parametrize("middle", [None, 30])
def test_shared_shingles_are_counted_exactly(middle):
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(60 if rng.random() < 0.5 else 3000) for _ in range(rng.randint(1, 80))], np.uint64)) for _ in range(400)]
    got = near_duplicates.shared_shingles(sets, middle)
    left, right = (sets, sets) if middle is None else (sets[:middle], sets[middle:])
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if middle is not None or i < j:
                assert got[i, j] == len(np.intersect1d(a, b)), (i, j)


def test_rows_of_one_id_with_unlike_texts_both_stay(spark):
    docs = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "one two three four five six seven eight nine"), (2, "one two three four five six seven eight nine"), (3, "alpha beta gamma delta epsilon zeta eta theta"), (1, "one two three four five six seven eight nine")]
    kept = Counter((r.doc_id, r.text[:3]) for r in near_duplicates.one_of_each_class(frame(spark, docs)).collect())
    assert kept == {(1, "alp"): 1, (1, "one"): 1}
