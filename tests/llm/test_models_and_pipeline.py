"""Language identification, scoring, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from larkspan.llm import language_id, lm_scoring, queries
from rows import ODD, frame

SYLLABLES = {"aa": ["ka", "to", "mi", "ra"], "bb": ["schn", "ung", "ver", "eit"], "cc": ["é", "ç", "ou", "tion"]}


def sentence(rng, lang, words=12):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    return frame(spark, [(i, sentence(rng, lang, rng.randint(2, 60)), lang) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]])


@pytest.fixture(scope="module")
def net(docs):
    return language_id.fit(docs, steps=60, batch=64)


def test_gradients_are_exact():
    rng = np.random.default_rng(1)
    net = language_id.train({"a": [b"x"], "b": [b"y"]}, hidden=3, steps=0)
    data, mask = rng.integers(0, 256, (5, 4)), np.arange(5)[:, None] < np.array([5, 3, 5, 1])
    target = np.eye(2)[:, [0, 1, 1, 0]].astype(float)
    grads = language_id._gradients(net, data, mask, target)

    def loss():
        total = 0.0
        for lane in range(4):
            n = int(mask[:, lane].sum())
            p = language_id.Reader(net).positions(data[:n, lane].astype(np.uint8).tobytes())
            total -= np.log(p[:, target[:, lane].argmax()]).sum()
        return total / mask.sum()

    for k in ("u", "v", "x", "b"):
        w = getattr(net, k)
        at = np.unravel_index(np.abs(grads[k]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 0.01
        up = loss()
        w[at] = old - 0.01
        down = loss()
        w[at] = old
        assert abs((up - down) / 0.02 - grads[k][at]) < 1e-3, k


def test_documents_pool_their_positions(net):
    reader = language_id.Reader(net, lanes=3)
    texts = [sentence(random.Random(k), "aa", 3).encode() for k in range(7)]
    pooled = reader.documents([*texts, b""])
    for t, row in zip(texts, pooled):
        assert np.allclose(reader.positions(t).mean(0), row, atol=1e-5)
    assert not pooled[-1].any()
    long = sentence(random.Random(9), "bb", 400).encode()
    assert np.allclose(reader.documents([long])[0], reader.positions(long).mean(0), atol=0.05)  # segments warm up by their context


def test_held_out_accuracy_and_fold(docs, net):
    rows = language_id.identify(docs, net).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_rows_teach_nothing(docs):
    from pyspark.sql import functions as F

    spoilt = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert language_id.training_windows(spoilt) == language_id.training_windows(docs)


def test_odd_rows(odd, none, net):
    rows = {}
    for r in language_id.identify(odd, net).collect():
        rows.setdefault(r.doc_id, r)
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (2, 3, 4, 5)) and rows[8].lang_pred in net.languages
    assert language_id.identify(odd, net).count() == len(ODD) and language_id.identify(none, net).count() == 0
    nothing = language_id.fit(none)
    assert nothing.languages == [] and {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    left = language_id.identified(odd, net, 0.0)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, *_ in ODD if i not in (2, 3, 4, 5))


def test_language_query(spark, small):
    rows = {r.doc_id: r for r in queries.op10_language_id(spark, small).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [i for i in truth if rows[i].held_out]
    assert set(rows) == set(truth) and sum(rows[i].lang_pred == truth[i] for i in held) / len(held) > 0.9


def test_only_letters_count_as_letters(spark, net):
    texts = ["½", "²", "Ⅷ", "①", "٣", "_", "\u0301", "a", "½a", "日", "ª"]
    assert [language_id.has_letter(t) for t in texts] == [any(c.isalpha() for c in t) for t in texts]
    rows = {r.doc_id: r for r in language_id.identify(frame(spark, list(enumerate(texts))), net).collect()}
    assert all((rows[i].lang_pred == "und") != language_id.has_letter(t) for i, t in enumerate(texts))


def test_segments_predict_what_whole_texts_do(spark, small):
    """Against the states run through each whole text, byte by byte."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = language_id.fit(docs)
    reader = language_id.Reader(net)
    texts = [r.text.encode() for r in docs.orderBy("doc_id").collect() if r.text and language_id.has_letter(r.text) and len(r.text) < 20_000][:60]
    slow, fast = np.stack([reader.positions(t).mean(0) for t in texts]), reader.documents(texts)
    assert (slow.argmax(1) == fast.argmax(1)).all() and np.abs(slow - fast).max() < 0.02


def test_scores_are_compressed_sizes(spark, odd, none):
    import zstandard

    inside, general = b"one two three four five " * 5, b"lorem ipsum dolor " * 5
    size = lambda t, d: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None, write_content_size=False, write_dict_id=False).compress(t))
    rows = lm_scoring.score(odd, inside, general).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next((t or "" for i, t, *_ in ODD if i == r.doc_id)).encode()
        if not text:
            assert r.score is None and r.in_bits is None and r.n_bytes == 0
        else:
            a, b, c = (size(text, d) for d in (inside, general, None))
            assert abs(r.score - (b - a) / c) < 1e-9 and abs(r.in_bits - 8 * a / len(text)) < 1e-9
    assert lm_scoring.score(none, b"", b"").count() == 0


def test_dictionaries_count_everything(spark):
    docs = [(i, "common words here " * 3 + ("signal topic " * 4 if i < 3 else "noise chatter " * 6)) for i in range(12)]
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (2, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    inside, general = lm_scoring.dictionaries(frame(spark, docs), labels)
    assert b"signal" in inside and b"noise" not in inside and b"noise" in general and general.rstrip().endswith((b"chatter", b"noise"))
    rows = {r.doc_id: r.score for r in lm_scoring.score(frame(spark, docs), inside, general).collect()}
    assert min(rows[i] for i in range(3)) > max(rows[i] for i in range(3, 12))
    small = lm_scoring.dictionaries(frame(spark, docs), labels, size=30)
    assert all(len(d) <= 30 for d in small)


def test_pipeline(spark, small, odd, none, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(docs.columns) == sorted(columns)
            now = {r.doc_id: r.text for r in docs.collect()}
            assert set(now) <= set(kept) and len(now) == docs.count()
            if name != "suffix_array_dedup":
                assert all(kept[i] == t for i, t in now.items())
            kept = now
    assert {r.doc_id for r in docs.collect()} == set(kept) and 100 < len(kept) < 200
    for table in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, small)
            assert out.count() <= table.count()


def test_dictionaries_grow_with_the_corpus(spark, monkeypatch):
    from larkspan.llm import lm_scoring

    docs = spark.createDataFrame([(i, " ".join(f"word{i * 500 + j:07d}" for j in range(1000))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    monkeypatch.setattr(lm_scoring, "CORPUS_BYTES", 2)
    good, all_ = lm_scoring.dictionaries(docs, labels)
    assert min(len(good), len(all_)) > lm_scoring.DICTIONARY_BYTES
    rows = lm_scoring.score(docs, good, all_).collect()
    assert len(rows) == 40 and all(0 < r.in_bits < 8 for r in rows)


def brute_pieces(word):
    import xxhash

    if len(word) <= lm_scoring.WORD_CHARS:
        return [word]
    n, step = lm_scoring.WINDOW_CHARS, 504
    return [word[p : p + n] for p in range(len(word) - n + 1) if p % step == 0 or xxhash.xxh64_intdigest(word[p : p + 3].encode(), 42) % lm_scoring.EVERY == 0]


def test_all_words_are_counted(spark, odd):
    """Long words by their windows, one-character words, scripts without spaces; against a count of its own."""
    import re
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(3)
    sign = lambda n: "".join(chr(0x3042 + rng.randrange(40)) for _ in range(n))
    common = sign(30)
    docs = [(i, sign(rng.randint(0, 40)) + common + sign(rng.randint(0, 900)) + "\n\ta b\r\n" + "x" * rng.randint(0, 1200)) for i in range(12)] + ODD
    want, good = Counter(), Counter()
    for i, t, *_ in docs:
        for w in re.split("[ \t\n\x0b\f\r]+", t or ""):
            for piece in brute_pieces(w) if w else ():
                want[piece] += 1
                good[piece] += i is not None and i < 4
    got = lm_scoring.word_counts(frame(spark, docs).where("text is not null"), F.col("doc_id") < 4).collect()
    assert {r.word: (r.n, r.n_in) for r in got} == {w: (n, good[w]) for w, n in want.items()}
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    inside, general = lm_scoring.dictionaries(frame(spark, docs[:12]), labels)
    assert any(common[p : p + 8].encode() in inside and common[p : p + 8].encode() in general for p in range(23))


def test_dictionary_keeps_the_words_that_save_most(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))): rng.randint(1, 60) for _ in range(300)}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    ranked = sorted((w for w, n in words.items() if n > 1), key=lambda w: (-words[w] * len(w), w))
    for size in (0, 40, 500, 10**6):
        held, want = 0, []
        for w in ranked:
            if held + len(w) + 1 > size:
                break
            want.append(w)
            held += len(w) + 1
        assert lm_scoring.dictionary(counts, "n", size).decode().split() == want[::-1]


def test_pipeline_against_brute_force(spark, small):
    """All five stages at once, each followed slowly: whole-text states, all pairs, all windows, all items, the library."""
    import sentencepiece

    import corpus_pipeline
    from larkspan.llm import decontamination as DC
    from larkspan.llm import near_duplicates as N

    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    reader = language_id.Reader(language_id.fit(spark.read.parquet(f"{small}/documents.parquet")))
    docs = [(r.doc_id, r.text) for r in rows if r.text and language_id.has_letter(r.text)]
    sure = {i: reader.positions(t.encode()).mean(0).max() for i, t in docs}
    assert all(abs(p - 0.5) > 0.03 for p in sure.values())  # none is so near the bar that segments could decide
    docs = [(i, t) for i, t in docs if sure[i] >= 0.5]
    sets = [N.Shingles().set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if docs[a][1] == docs[b][1] or N.jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = [d for k, d in enumerate(docs) if root(k) == k]
    seen, left = set(), []
    for i, t in docs:
        raw = t.encode()
        own = [raw[p : p + 50] for p in range(len(raw) - 49)]
        gone = bytearray(len(raw))
        for p, g in enumerate(own):
            if g in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, g in zip(raw, gone) if not g).decode("utf-8", "ignore") if any(gone) else t
        if kept:
            left.append((i, kept))
    items = [n for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if (n := DC.normalise(r.text or ""))]
    vectors = [(DC._peq(x), len(x), int(DC.MAX_ERROR_RATE * len(x))) for x in items]
    docs = [(i, t) for i, t in left if not any(DC._myers(peq, m, DC.normalise(t))[0] <= budget for peq, m, budget in vectors)]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    found = corpus_pipeline.run(spark, small)
    ids = next(f.name for f in found.schema if f.dataType.simpleString().startswith("array"))
    got = {r.doc_id: list(r[ids]) for r in found.collect()}
    assert got == {i: library.encode(t) for i, t in docs} and len(docs) > 100


def test_dictionaries_hold_what_tells_the_sides_apart(spark):
    """More common words than a dictionary holds; rare ones of either side decide, on documents not used for it."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common, good, bad = [word(7) for _ in range(900)], [word(6) for _ in range(60)], [word(6) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(common if rng.random() < 0.8 else good if i % 2 else bad) for _ in range(120))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    inside, general = lm_scoring.dictionaries(frame(spark, docs), labels, size=3000)
    assert sum(w.encode() in inside for w in good) > 50 > 5 > sum(w.encode() in inside for w in bad) and sum(w.encode() in general for w in bad) > 50
    scores = {r.doc_id: r.score for r in lm_scoring.score(frame(spark, docs), inside, general).collect()}
    rest = sorted(range(100, 300), key=scores.get)
    assert sum(i % 2 for i in rest[100:]) >= 95
    everything = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    alike = lm_scoring.dictionaries(frame(spark, docs), everything, size=3000)
    assert alike[0] == alike[1] != b""
