"""Jaccard components, containment, language ID, SentencePiece and the pipeline against brute force."""

import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, jaccard_join, langid, sentencepiece_viterbi, shared
from veilspark.llm.shingle_kernel import runs, shingle_sets
from veilspark.llm.voronoi_kernel import Region

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéÉXY") for _ in range(rnd.randrange(1, 5)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "one two three four", "a b c d e", "a  b\tc\nd e"]
    base = [[word() for _ in range(rnd.randrange(5, 120))] for _ in range(n // 6)]
    for _ in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w) + (" " + passage if rnd.random() < 0.3 else ""))
    return texts


def test_kernel_equals_words():
    texts = corpus(1, 80) + ["é" * 3000 + " x y z w v", "\x0b a\x0cb c d e f"]
    got = []
    for _, data, offsets in runs(pa.array(texts)):
        got += shingle_sets(data, offsets)
    want = [shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


@pytest.mark.parametrize("seed", range(4))
def test_region_join(seed):
    rnd = np.random.default_rng(seed)
    sets, hubs = [], [rnd.integers(0, 4000, 80) for _ in range(12)]
    for _ in range(220):
        keep = rnd.random(80) < rnd.choice([0.7, 0.85, 0.95, 1.0])
        sets.append(np.unique(np.concatenate((hubs[rnd.integers(12)][keep], rnd.integers(0, 4000, rnd.integers(0, 12))))).astype(np.uint64))
    want = components([set(s.tolist()) for s in sets])
    assert Region(sets).join().tolist() == want
    halves = Region(sets)
    halves.prefix_join(np.arange(110))
    halves.prefix_join(np.arange(110, 220))
    halves.prefix_join(np.arange(110), np.arange(110, 220))
    assert halves.roots(np.arange(220)).tolist() == want


@pytest.mark.parametrize("chunk,retire", [(24_000_000, 48), (6_000, 8)])
def test_jaccard_components(make, monkeypatch, chunk, retire):
    """The second case forces retired shingles and chunked groups."""
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(jaccard_join, "RETIRE", retire)
    texts = corpus(7, 220)
    rows = [(1000 - i, t, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(make(rows).repartition(5)).collect()}
    sets = [shingles(t) for t in reversed(texts)]
    root, ids = components(sets), [r[0] for r in reversed(rows)]
    assert got == {ids[i]: (len(sets[i]), ids[root[i]]) for i in range(len(ids))}


def test_groups_around_common_passages_are_split(make, monkeypatch):
    """Texts of their own words around a few passages of a pool are one group over the corpus, but link with their near copies only."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    pool = [[word() for _ in range(20)] for _ in range(30)]
    texts = []
    for _ in range(150):
        w = sum(([*rnd.choice(pool), *(word() for _ in range(rnd.randrange(8, 16)))] for _ in range(4)), [])
        texts += [" ".join(w), " ".join([*w[:-1], word()])][: 1 + (rnd.random() < 0.3)]

    def large_regions(rows, percent):
        raise AssertionError("a group was not split")

    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(jaccard_join, "large_regions", large_regions)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(make([(i, t, None) for i, t in enumerate(texts)]).repartition(3)).collect()}
    assert got == dict(enumerate(components([shingles(t) for t in texts])))


def stages(spark):
    """Rows that each stage so far wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x := listed.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(listed.size())}


def test_blocks_of_a_group_that_nothing_splits_ship_it_in_waves(spark, monkeypatch):
    """Every block meets every chunk, but no stage ships the group more than a few times, however many blocks there are."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, 80, replace=False)) for _ in range(80)]
    sets += [np.unique(np.concatenate((s[:-4], rng.integers(0, 2**63, 4, dtype=np.uint64)))) for s in sets[:10]]  # sets and near copies
    rows = [(1, *jaccard_join._digest(s), bytearray(s.tobytes())) for s in sets]
    monkeypatch.setattr(jaccard_join, "CHUNK_BYTES", 8_000)
    monkeypatch.setattr(jaccard_join, "WAVE_BYTES", 1, raising=False)

    before = stages(spark)
    links = jaccard_join.large_regions(spark.createDataFrame(rows, "comp long, d1 long, d2 long, shingles binary").repartition(3), 75).collect()
    shipped = max(n for k, n in stages(spark).items() if k not in before)
    at, root = {(r[1], r[2]): i for i, r in enumerate(rows)}, list(range(len(rows)))
    for r in links:
        a, b = (root[at[x]] for x in ((r["a1"], r["a2"]), (r["b1"], r["b2"])))
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == components([set(s.tolist()) for s in sets])
    assert shipped < 6 * len(rows), shipped / len(rows)


@pytest.mark.parametrize("block", [1000, 7])
def test_linked_pairs_are_all_links(make, monkeypatch, block):
    """Every link, also between sets that others connect already; the second case deals groups into blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = corpus(9, 160)
    made = []
    for _, data, offsets in runs(pa.array(texts)):
        made += shingle_sets(data, offsets)
    sets = {jaccard_join._digest(m): shingles(t) for m, t in zip(made, texts, strict=True) if len(m)}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [((r["a1"], r["a2"]), (r["b1"], r["b2"])) for r in jaccard_join.linked_pairs(make([(1, t, None) for t in texts]).repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    root = {a: a for a in sets}
    for a, b in sorted(want):  # there are more links than connectivity needs
        root[b] = min(root[b], root[a])
    assert len(want) > sum(root[a] != a for a in sets)


def test_many_keys_do_not_shuffle_the_texts(spark, make, monkeypatch):
    """Where the rows that meet their keys are too many to broadcast, only these are shuffled, and a few others."""
    words = np.random.default_rng(5).integers(0, 10**9, (900, 12)).astype(str)
    texts = [" ".join(w) for w in words]
    rows = [(i, t, None) for i, t in enumerate(texts + texts[:40] + [" ".join([*w[:-1], "x"]) for w in words[40:60]])]
    rows += [(None, None, None), (None, "", None), rows[7], rows[7], rows[300], rows[300]]
    docs = make(rows).repartition(3).cache()
    few = sorted(map(tuple, jaccard_join.keep_one(docs).collect()), key=str)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)
    many = jaccard_join.keep_one(docs)
    assert many.columns == docs.columns and sorted(map(tuple, many.collect()), key=str) == few and len(few) == 902
    keys = shared.kept(spark.createDataFrame([(i, 0) for i in range(0, 2000, 100)], "k long, l long"), "keys")
    wide = spark.range(2000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("l"), F.lit("text").alias("t"))
    before = stages(spark)
    for how, want in (("inner", {*range(0, 2000, 100)}), ("left_semi", {*range(0, 2000, 100)}), ("left_anti", {i for i in range(2000) if i % 100})):
        found = shared.among(wide, keys, ["k", "l"], how)
        assert sorted(r["k"] for r in found.collect()) == sorted(want)
    assert max(n for k, n in stages(spark).items() if k not in before) < 200


def test_jaccard_edges_of_tables(make):
    assert jaccard_join.jaccard_components(make([(1, "x", None)]).limit(0)).count() == 0
    rows = [(1, "a b c d e f", None), (1, "a b c d e f", None), (None, "a b c d e f", None), (2, None, None), (3, "", None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(make(rows)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (3, 3)], key=str)
    kept = jaccard_join.keep_one(make(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3] and kept.columns == make(rows).columns


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_keep_one_decides_by_row(make):
    """Different texts under one id and under null; an id that represents one of its texts but not the other."""
    a, b, c, d = ("{0}a {0}b {0}c {0}d {0}e {0}f".format(k) for k in "pqrs")
    near = [" ".join([*(f"w{i}" for i in range(60)), last]) for last in "xy"]
    rows = [(None, a, None), (None, b, None), (None, b.upper(), None), (None, None, None), (None, None, None), (5, c, None), (5, d, None), (5, d, None)]
    rows += [(7, "k l m n o p", None), (8, "k l m n o p", None), (9, "k  l m n o p", None), (7, near[0], None), (3, near[1], None), (4, "", None), (4, "", None)]
    kept = rows_of(jaccard_join.keep_one(make(rows).repartition(3)))
    b_kept = [r for r in kept if r[0] is None and r[1] in (b, b.upper())]
    assert len(b_kept) == 1
    kept.remove(b_kept[0])
    want = [(None, a), (None, None), (None, None), (5, c), (5, d), (7, "k l m n o p"), (3, near[1]), (4, ""), (4, "")]
    assert kept == sorted(want, key=str)


def test_keep_one_equals_brute_force_where_ids_repeat(make):
    texts = corpus(11, 150)
    rnd = random.Random(11)
    rows = [(rnd.choice([None, *range(40)]), t, None) for t in texts]
    root = components([shingles(t) for t in texts])
    of = {}
    for (i, t, _), r in zip(rows, root, strict=True):
        of.setdefault((r, bool(shingles(t))), []).append((i, t))
    kept = rows_of(jaccard_join.keep_one(make(rows).repartition(4)))
    want = 0
    for (_, linked), group in of.items():
        least = min(group, key=lambda g: (g[0] is None, g[0] or 0))[0]
        want += 1 if linked else len(group)
        assert not linked or len([k for k in kept if k in group and k[0] == least]) >= 1
    assert len(kept) == want


def test_decontaminate_decides_by_row(spark, make):
    item = "one two three four five six seven"
    rows = [(1, f"x {item} y", None), (1, "clean text under the same id", None), (None, item, None), (None, "clean text without an id", None), (None, None, None), (2, "clean", None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(make(rows), bench)
    assert rows_of(kept) == sorted([(r[0], r[1]) for r in rows if item not in (r[1] or "")], key=str) and kept.columns == make(rows).columns
    assert decontaminate.decontaminate(make(rows), bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("small", [200_000, 1])
def test_contained(spark, make, monkeypatch, small):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", small)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 5, 8, 12, 20, 40, 40])] + [(20, None)]
    docs = [None, ""]
    for _ in range(120):
        w = [word() for _ in range(rnd.randrange(1, 300))]
        if rnd.random() < 0.6:
            leak = items[rnd.randrange(9)][1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if leak:
                    leak[rnd.randrange(len(leak))] = word()
            at = rnd.randrange(len(w))
            w[at:at] = leak
        docs.append(", ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    words = lambda t: [x for x in re.split(r"[^a-z0-9]+", (t or "").lower()) if x]
    want = set()
    for i, t in items:
        w = words(t)
        width = min(5, len(w))
        own = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if w else set()
        for d, text in enumerate(docs):
            dw = words(text)
            n = len(own & {tuple(dw[k : k + width]) for k in range(len(dw) - width + 1)})
            if own and n >= math.ceil(0.75 * len(own)):
                want.add((d, i, len(own), n))
    frame, bench = make([(i, t, None) for i, t in enumerate(docs)]), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in decontaminate.contained(frame, bench).collect()}
    assert got == want and len(want) > 20
    kept = decontaminate.decontaminate(frame, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {d for d, *_ in want} and kept.columns == frame.columns
    assert decontaminate.contained(frame, bench.limit(0)).count() == 0 and decontaminate.contained(frame.limit(0), bench).count() == 0


def test_langid(make):
    rnd = random.Random(5)
    vocabulary = {"aa": ["the", "and", "thing", "of"], "bb": ["der", "und", "nicht", "ß"], "cc": ["año", "que", "los", "niño"]}
    rows = [(i, " ".join(rnd.choice(vocabulary[lang]) for _ in range(rnd.randrange(2, 30))), lang) for i in range(400) for lang in [rnd.choice("abc") * 2]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (1003, "\U0001f642", None), (None, "the and", "aa"), (1004, "und " * 20_000, None)]
    docs = make(rows).repartition(3)
    got = langid.identify(docs, langid.train(docs)).withColumn("out", langid.held_out(F.col("doc_id"))).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)} == {"und"} and by_id[1004]["lang_pred"] == "bb"
    held = [r for r in got if r["out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 60 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(unlabelled) is None and {r["lang_pred"] for r in langid.identify(unlabelled, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0
    assert langid.keep_identified(docs, langid.train(docs)).columns == docs.columns


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(sentencepiece_viterbi.MODEL):
        pytest.skip("no model file")
    return sentencepiece_viterbi.Vocabulary()


def odd_texts(seed, n):
    rnd = random.Random(seed)
    return ["", " ", "  a  b ", "\n\t", "ﬁ½①日本語\U0001f642", "<s> </s> <unk> <0x0A>", "a" * 400, "x" * 3000 + " y", *("".join(rnd.choice("abcdefghiouetn  theingé1.,\n日") for _ in range(rnd.randrange(80))) for _ in range(n))]


def test_ids_equal_the_library(vocabulary):
    import sentencepiece

    texts = odd_texts(1, 1500)
    encoder = sentencepiece_viterbi.Encoder(vocabulary)
    ids = encoder.encode(pa.array([*texts, None]))
    assert ids.to_pylist() == [*sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL).encode(texts), None]
    assert encoder.decode(ids).to_pylist() == [*texts, None]


def test_unigram_viterbi_is_optimal():
    if not os.path.exists(sentencepiece_viterbi.MODEL):
        pytest.skip("no model file")
    v = sentencepiece_viterbi.Vocabulary(bpe=False)
    score = dict(zip(v.keys.tolist(), v.score[v.ids], strict=True))
    encoder = sentencepiece_viterbi.Encoder(v)
    for word in ["hello", "theinthing", "aaaa", "élan"]:
        text = "▁" + word
        best = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - v.longest), j):
                s = score.get(sentencepiece_viterbi._hash_of(text[i:j]))
                if s is not None:
                    best[j] = max(best[j], best[i] + s)
        ids = encoder.encode(pa.array([word])).to_pylist()[0]
        assert sum(v.score[i] for i in ids) == pytest.approx(best[-1])


def test_encode_decode_frames(make, vocabulary):
    texts = [None, *odd_texts(2, 60)]
    rows = make([(i, t, None) for i, t in enumerate(texts)])
    done = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(rows, vocabulary), vocabulary)
    assert done.columns == [*rows.columns, "token_ids", "decoded"]
    assert all(r["decoded"] == r["text"] for r in done.collect())
    assert all(r["round_trip"] for r in sentencepiece_viterbi.digests(rows, vocabulary).collect())
    assert sentencepiece_viterbi.encode(rows.limit(0), vocabulary).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("tables absent")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] and set(out) <= {r["doc_id"] for r in docs.collect()}
    from collections import Counter

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    strip = " \t\n\x0b\x0c\r"
    counts = Counter(k for t in texts.values() for k in {x.strip(strip).translate(LOWER) for x in t.split("\n")} if k)
    kept = {i: "\n".join(x for x in t.split("\n") if counts[x.strip(strip).translate(LOWER)] < 10) for i, t in texts.items()}
    ids = sorted(kept)
    root = components([shingles(kept[i]) for i in ids])
    first = {ids[i] for i in range(len(ids)) if root[i] == i}
    items = [re.split(r"[^\w]+", r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ([x for x in i if x] for i in items)]
    words = {i: [x for x in re.split(r"[^\w]+", kept[i].lower()) if x] for i in first}
    own = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    want = {i for i in first if not any(len(g & own[i]) >= math.ceil(0.75 * len(g)) for g in grams)}
    assert set(out) == want  # every document of this table has letters and a clear language
    assert all(r["text"] == kept[i] and r["n_tokens"] == len(r["token_ids"]) for i, r in out.items())


def test_pipeline_keeps_one_stage(spark, monkeypatch):
    """When a stage's result is written, that of the stage before goes; only the last stage's input is left."""
    import glob

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("tables absent")
    there = lambda: set(glob.glob(f"{shared.shared_dir(spark).removeprefix('file:').replace('//', '/')}/veilspark-stage*"))
    before = there()
    passed = [("all", lambda spark, docs, sf_dir: docs)] * 4
    monkeypatch.setattr(corpus_pipeline, "STAGES", passed)
    out = corpus_pipeline.run(spark, sf)
    assert [p.rsplit("/")[-1].split("-")[1] for p in there() - before] == ["stage2"]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
