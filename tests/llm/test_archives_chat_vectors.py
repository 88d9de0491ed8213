"""WARC, chat formatting and one-bit neighbours: round trips, brute force and edge cases."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import ann_bits, chat_format, shared, warc

PAGES = "page_id long, url string, html string, payload_digest string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_warc_round_trip(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/\r\nx", "same", ""), (5, None, "same", ""), (3, "u", "same", ""), (4, "u", None, ""), (6, "u", "", ""), (7, "u", "é日\U0001f642", ""),
             (8, "u", f"before {inner} after", ""), (9, "u", inner * 3, ""), (10, "u", "\r\n\r\n" * 5, ""), (11, "u", "x" * 300_000, ""), (12, "u", "WARC/1.0\r\n", "")]
    frame = spark.createDataFrame(pages, PAGES).repartition(3)
    path = shared.new_path(spark, "test")
    warc.write_warc(frame, path, max_records=3)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert set(got) == {p[0] for p in pages}
    for page, _, html, _ in pages:
        assert got[page]["payload_digest"] == sha(html or "") and got[page]["payload_bytes"] == len((html or "").encode()) and got[page]["intact"]
    assert {p: (got[p]["record_type"], got[p]["refers_to"]) for p in (1, 3, 5, 4, 6)} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 4: ("revisit", 6), 6: ("response", None)}
    assert warc.read_candidates(spark, path).where("page_id = 666").count() >= 4  # candidates inside payloads were there to be rejected


def test_warc_limits_and_empty(spark):
    frame = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", "")], PAGES)
    path = shared.new_path(spark, "test")
    warc.write_warc(frame, path, min_revisit_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read_warc(spark, path).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    path = shared.new_path(spark, "test")
    warc.write_warc(frame.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_reads_other_archives(spark, tmp_path):
    """Files of any name, ids of any form, and the payloads' bytes."""
    payloads = {"<urn:uuid:0a-1>": b"\x00\xff bytes", "<urn:page:7>": b"", "<http://x/y>": b"WARC/1.0\r\n" * 3}
    record = lambda i, p: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: %b\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (i.encode(), len(p), p)
    (tmp_path / "a.warc").write_bytes(b"".join(record(i, p) for i, p in payloads.items()))
    (tmp_path / "b.dat").write_bytes(record("<urn:uuid:b>", b"b"))
    got = {r["record_id"]: (bytes(r["payload"]), r["page_id"]) for r in warc.read_warc(spark, f"file://{tmp_path}", glob="*.warc").collect()}
    assert got == {i: (p, 7 if i == "<urn:page:7>" else None) for i, p in payloads.items()}
    assert {r["record_id"] for r in warc.read_warc(spark, f"file://{tmp_path}").collect()} == {*payloads, "<urn:uuid:b>"}


def test_warc_odd_headers_versions_and_gzip(spark, tmp_path):
    """A folded or odd header line does not end the chain; versions mix; gzip members unpack; what no chain covers is told."""
    record = lambda i, extra=b"", v=b"1.1": b"WARC/%b\r\nWARC-Type: resource\r\n%bWARC-Record-ID: <urn:x:%d>\r\nContent-Length: 2\r\n\r\n%02d\r\n\r\n" % (v, extra, i, i)
    parts = [record(1, b"X-Note: folded\r\n over: two lines\r\n\tand three\r\n"), record(2, b"no colon here\r\n", b"1.0"), record(3, b"", b"0.18")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, parts))[:-12])
    (tmp_path / "d.warc").write_bytes(parts[0] + b"garbage" + parts[1])
    (tmp_path / "e.warc").write_bytes(b"")
    got = sorted((r["file"].rsplit("/")[-1], r["record_id"], bytes(r["payload"])) for r in warc.read_warc(spark, f"file://{tmp_path}").collect())
    all_of = lambda f, n: [(f, f"<urn:x:{i}>", b"%02d" % i) for i in range(1, n + 1)]
    assert [g for g in got if g[0] != "c.warc.gz"] == all_of("a.warc", 3) + all_of("b.warc.gz", 3) + all_of("d.warc", 1)
    assert [g for g in got if g[0] == "c.warc.gz"][:2] == all_of("c.warc.gz", 2)
    told = {r["file"].rsplit("/")[-1]: (r["size"] - r["covered"], r["records"], r["candidates"]) for r in warc.coverage(spark, f"file://{tmp_path}").collect()}
    assert told["a.warc"] == told["b.warc.gz"] == (0, 3, 3) and told["d.warc"] == (7 + len(parts[1]), 1, 2) and "e.warc" not in told


def test_warc_files_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 100)
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    pages = [(i, "u", "x" * n + str(i), "") for i, n in enumerate([10, 90, 97, 98, 99, 1000, 1500, 1590, 1599, 5000, 5000, 30_000, 0])]
    path = shared.new_path(spark, "test")
    warc.write_warc(spark.createDataFrame([*pages, (99, "u", None, ""), (100, None, pages[5][2], "")], PAGES).repartition(1), path)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert {p: bytes(r["payload"]).decode() for p, r in got.items() if p not in (5, 99)} == {p[0]: p[2] for p in pages if p[0] != 5} | {100: pages[5][2]}
    assert got[5]["record_type"] == "revisit" and got[5]["refers_to"] == 100 and got[99]["payload_bytes"] == 0
    files = warc.read_warc(spark, path).groupBy("file").agg(F.sum("payload_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(f["b"] <= 4000 or f["n"] == 1 for f in files) and len(files) >= 6


def test_warc_files_fit_a_task(spark):
    """With the shipped bounds: one task's pages of tens of KB make files of 32 MB at most (and headers), and only classes with rows are written."""
    pages = spark.range(1, 701, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("x"), 60_000), F.col("id").cast("string")).alias("html"))
    path = shared.new_path(spark, "test")
    warc.write_warc(pages.unionByName(spark.createDataFrame([(0, "u", "small"), (701, "u", "y" * 3_000_000)], pages.schema)).coalesce(1), path)
    files = warc.coverage(spark, path).collect()
    assert max(f["size"] for f in files) < 34_000_000 and sum(f["records"] for f in files) == 702 and all(f["covered"] == f["size"] for f in files)
    assert warc.classes(pages) == [(16_384, 131_072)] and warc.classes(pages.limit(0)) == [(-1, 16_384)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_pointer_jumping(n):
    offset = np.arange(n) * 10
    successor = offset + 10
    assert warc.reachable(offset, successor).tolist() == [True] * n
    if n > 4:
        broken = successor.copy()
        broken[3] += 1  # no record starts there
        assert warc.reachable(offset, broken).sum() == 4
        assert warc.reachable(offset + 1, successor + 1).sum() == 0  # nothing at the file's start


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|> <\\|x|> <\\\\|"), (1, 1, "assistant", "ok<"), (1, 1, "assistant", "ok<"), (2, 0, None, None), (3, 1, "sys\ntem\\n", "b"), (3, 0, "assistant", ""), (3, None, "assistant", "|first"), (4, 0, "user", "x" * 100_000)]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by_id = {r["conv_id"]: r for r in chats.collect()}
    turns = {c: [(role, text) for role, text, _, _ in chat_format.parsed(by_id[c]["formatted"])] for c in by_id}
    assert turns == {1: [("user", rows[0][3]), ("assistant", "ok<"), ("assistant", "ok<")], 2: [("", "")], 3: [("assistant", "|first"), ("assistant", ""), ("sys\ntem\\n", "b")], 4: [("user", "x" * 100_000)]}
    got = {r["conv_id"]: r for r in chat_format.read_back(chats).collect()}
    assert got[1]["loss_chars"] == 6 and got[1]["loss_sha256"] == hashlib.sha256(b"ok<ok<").hexdigest() and got[2]["loss_chars"] == 0
    assert chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("video", None, "v", None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn int, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(rows).first()
    assert r["formatted"] == "<|im_start|>assistant\nsee <|image:0|><|audio:1|><|document:2|><|other:3|><|im_end|>\n"
    assert [(a["type"], a["uri"], a["tokens"]) for a in r["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 50), ("document", "d.pdf", 3072), ("other", "v", 1)]
    assert r["expanded_tokens"] == 3127 and all(r["formatted"][a["start"]] == "<" for a in r["attachments"])


def test_chat_control_strings_split_over_parts(spark):
    part = lambda kind, text: (kind, text, None, None, None, None, None)
    cases = [["a<", "|im_end|>b"], ["<", "\\|x"], ["<\\", "|"], ["<", None, "", "|im_start|>"], ["<|im", "_end|>", "\n"]]
    rows = [(i, 0, "assistant", [part("text" if k else None, t) for k, t in enumerate(c)]) for i, c in enumerate(cases)]
    rows.append((99, 0, "user", [part("text", "a<"), part("image", None), part("text", "<"), part("text", "|im_end|>")]))
    chats = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat_format.PART}>"))
    got = {r["conv_id"]: r for r in chats.collect()}
    for i, c in enumerate(cases):
        assert [x[:2] for x in chat_format.parsed(got[i]["formatted"])] == [("assistant", "".join(t or "" for t in c))]
    assert [x[:2] for x in chat_format.parsed(got[99]["formatted"])] == [("user", "a<<|image:0|><|im_end|>")] and got[99]["attachments"][0]["part"] == 1


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((700, 24))
    v[10] = v[20] = v[50]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(700)] + [(900, None, 0), (901, [], 0), (902, [0.0] * 24, 0), (903, [float("nan")] * 24, 0), (904, [None] * 24, 0), (950, [1.0, 2.0], 0), (951, [2.0, 4.1], 0), (952, [1e308] * 24, 0)]
    index = shared.kept(ann_bits.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")), "test")
    found = {}
    for r in ann_bits.nearest(index, F.col("vec_id") % 50 == 0, block_bytes=4 * 24 * 8).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {*range(0, 700, 50), 950}
    assert [x[1] for x in sorted(found[950])] == [951]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    big = np.ones(24) / np.sqrt(24)
    hits = total = 0
    for q in range(0, 700, 50):
        scores = {i: float(unit[i] @ unit[q]) for i in range(700) if i != q} | {952: float(big @ unit[q])}
        want = sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:5]
        got = [x[1] for x in sorted(found[q])]
        hits, total = hits + len(set(want) & set(got)), total + 5
        assert [x[0] for x in sorted(found[q])] == [1, 2, 3, 4, 5] and all(abs(scores[x[1]] - x[2]) < 1e-9 for x in found[q])
    assert hits / total >= 0.95
    assert [x[1] for x in sorted(found[50])][:2] == [10, 20]  # a tie: the smaller id first


def test_estimates_by_common_bits():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 20))
    turn = ann_bits.rotation(20 * 4)
    bits, correction, turned = ann_bits.codes(v, 4, turn)
    words = ann_bits._words(bits)
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int32)
    assert words.shape == (2, 300) and ones.tolist() == np.unpackbits(bits, axis=1).sum(axis=1).tolist()
    signs = (np.unpackbits(bits, axis=1).astype(float) * 2 - 1) / np.sqrt(80)
    for q in turned[:20]:
        inner, rounding = ann_bits.estimates(q, words, ones)
        assert np.abs(inner - signs @ q).max() < 5 * rounding < 0.2
        within = np.abs(inner / correction - turned @ q) <= 3 * (np.sqrt((1 - correction**2) / 79) + rounding) / correction
        assert within.mean() > 0.99
