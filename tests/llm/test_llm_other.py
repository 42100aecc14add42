"""Vector, token and WARC operators against brute force, the libraries, and exact round trips."""

import base64
import collections
import hashlib
import json
import random
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scanlens.llm import mtree, piece_codec, record_files, vector_dedup, warc_derive
from scanlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int"


def clustered(n, dims=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.12, 0.2, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], int(i % 6 // 2)))
    return out


ODD = [(900, None, 0), (901, [0.0] * 12, 0), (902, [float("nan")] * 12, 0), (903, [None, 1.0], 0), (904, [1.0, 2.0], None),
       (905, [], 0), (906, [float("inf")] * 12, 1), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0)]


def brute_vectors(rows, cosine=0.98):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None for x in v)]
    ok = [(i, v, lab) for i, v, lab in ok if np.isfinite(v).all() and v.any()]
    links, up = collections.Counter(), {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, v, la) in enumerate(ok):
        for b, w, lb in ok[n + 1:]:
            if la == lb and len(v) == len(w) and v @ w >= cosine * np.sqrt((v @ v) * (w @ w)):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in up}


@pytest.mark.parametrize("chunk", [512, 5])
def test_near_vectors_equal_brute_force(spark, chunk):
    rows = clustered(240) + ODD
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, VEC), vector_dedup.SignHashOptions(chunk=chunk)).collect()
    want = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert max(n for n, _ in want.values()) > 20


def test_near_vectors_recall_just_above_the_threshold(spark):
    """11,000 vectors; 3,000 pairs planted between 0.98 and 0.99, 2,000 just below."""
    rng = np.random.default_rng(17)
    base = rng.normal(size=(6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(5000, 32))
    other -= (other * base[:5000]).sum(axis=1, keepdims=True) * base[:5000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = np.r_[rng.uniform(0.9801, 0.99, 3000), rng.uniform(0.97, 0.9799, 2000)][:, None]
    x = np.r_[base, c * base[:5000] + np.sqrt(1 - c * c) * other] * rng.uniform(0.5, 2, (11000, 1))
    label = np.r_[np.arange(6000) % 3, np.arange(5000) % 3]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    rows = spark.createDataFrame([(i, v, int(la)) for i, (v, la) in enumerate(zip(x.tolist(), label))], VEC)
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(rows).collect()}
    assert want.sum() >= 6000 and [got[i] for i in range(11000)] == want.tolist()


def test_near_vectors_edge_rows(spark):
    rows = [(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.0], 3), (2, [1.0, 0.0], 4)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, VEC)).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 0, 2, True)], key=repr)
    assert vector_dedup.near_vectors(spark.createDataFrame([], VEC)).count() == 0


def brute_top(rows, every, k, scale=256):
    ok = [(i, np.floor(scale * np.array(v, float))) for i, v, _ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % every == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("opt", [mtree.MTreeOptions(), mtree.MTreeOptions(pivots=5, shard=40, page=4, block=3), mtree.MTreeOptions(k=400, page=8)])
def test_top_k_equals_brute_force(spark, opt):
    rows = clustered(260, seed=2) + [(1000 + i, [0.5] * 12, 0) for i in range(30)] + ODD + [(None, [1.0] * 12, 0)]
    got = mtree.top_k(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, opt).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 20, opt.k)
    assert mtree.top_k(spark.createDataFrame([], VEC), F.col("vec_id") % 20 == 0, opt).count() == 0


def test_top_k_with_one_long_vector_and_repeated_queries(spark):
    rows = clustered(300, seed=5) + [(5000, [40.0] * 12, 0), (5001, [0.0] * 12, 0), (5002, [1e-4] * 12, 0)] + [(20, [0.25] * 11, 0)]
    got = mtree.top_k(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, mtree.MTreeOptions(pivots=6, shard=30, page=8)).collect()
    want = brute_top([r for r in rows if (r[0], len(r[1])) != (20, 12)], 20, 5)
    # of two vectors under one query id the shorter one asks; both are candidates
    want = {w for w in want if w[0] == 20} | {w for w in brute_top(rows[:-1], 20, 5) if w[0] != 20}
    assert {tuple(r) for r in got} == want


def test_vectors_at_one_distance_are_spread_over_rings(spark):
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 else [float(i), 1.0, 0.0], 0) for i in range(900)]
    opt = mtree.MTreeOptions(pivots=4, shard=50, page=8)
    _, rings, _ = mtree.build(mtree.written(mtree.quantised(spark.createDataFrame(rows, VEC), opt), "t"), opt)
    assert rings.where("low = high").count() >= 8
    got = mtree.top_k(spark.createDataFrame(rows, VEC), F.col("vec_id") % 60 == 0, opt).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 60, 5)


def test_block_search_leaves_entries_out():
    """Bounds must save scores: clusters that cannot hold a better entry are not scored."""
    rng = np.random.default_rng(1)
    pts = np.floor(256 * (rng.normal(size=(8, 6))[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 6)) * 0.01))
    sq = np.einsum("ij,ij->i", pts, pts)
    lifted = mtree._lifted(pts, sq, sq.max())
    nodes = []
    mtree._subtree(np.arange(2000), lifted, lifted[0], 32, nodes, -1)
    below = {}
    for n, v in enumerate(nodes):
        below.setdefault(v[0], []).append(n)
    asks = np.arange(0, 2000, 100)
    q = np.hstack([pts[asks], np.zeros((len(asks), 1))])
    best, computed = mtree.search_block(nodes, below, q, asks, np.linalg.norm(q - lifted[0], axis=1), sq[asks] + sq.max(), np.full(len(asks), -np.inf), 5)
    for r, a in enumerate(asks):
        want = sorted((-float(pts[a] @ pts[i]), i) for i in range(2000) if i != a)[:5]
        assert list(zip(-best.score[r], best.vec[r])) == want
    assert computed < 0.6 * len(asks) * 2000


# ------------------------------------------------------------------ token records

def records_of(spark, rows, **kw):
    opt = record_files.RecordOptions(tokenizer=public_tokenizers.path("byte_bpe_50k.json"), **kw)
    return record_files.encoded(spark.createDataFrame(rows, "doc_id long, text string, offset string"), opt).collect()


def reference_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


TEXTS = ["a b", "", None, " ", "  a  b\n c ", "x \n y\t\t z", "it's 12 3  4", "日本 語　x", "é ê  f", "<|endoftext|> a<|endoftext|>b", "\x1c a \x1c",
         "á b ́c", "w " * 20_000, "q" * 5_000]


@pytest.mark.parametrize("size", [64 << 20, 100])
def test_records_round_trip(spark, size):
    rows = [(10 * i, t, "clash") for i, t in enumerate(TEXTS)] + [(10, "", "c"), (None, "no id", "c")]
    got = sorted(records_of(spark, rows, file_bytes=size), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    want = collections.Counter((r[0], tuple(i)) for r, i in zip(rows, reference_ids([r[1] for r in rows])))
    ids = [tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in got]
    assert collections.Counter((r.doc_id, i) for r, i in zip(got, ids)) == want
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert all(r.n_tokens == len(i) and r.ids_crc32 == zlib.crc32(np.array(i, "<u4").tobytes()) for r, i in zip(got, ids))
    assert (len({r.file for r in got}) > 4) if size == 100 else True
    assert records_of(spark, []) == []


def test_records_on_disk_follow_the_format(spark, tmp_path):
    opt = record_files.RecordOptions(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    manifest = record_files.write_records(docs, str(tmp_path), opt).collect()
    (tmp_path / "left-behind.rec").write_bytes(b"from a lost task")
    seen = {}
    for m in manifest:
        raw = open(m.file.removeprefix("file://") + ".rec", "rb").read()
        index = np.frombuffer(open(m.file.removeprefix("file://") + ".idx", "rb").read(), "<u8").reshape(-1, 3)
        assert index[:, 1].sum() == len(raw) and len(index) == m.records
        for off, size, n in index[::-1]:  # any order
            payload = record_files.unframed([raw[off:off + size]])[0]
            doc, null, width = struct.unpack_from("<qBB", payload)
            assert (null, width, len(payload)) == (0, 2, 10 + 2 * n)
            seen[doc] = np.frombuffer(payload, "<u2", offset=10).tolist()
    assert seen == dict(enumerate(reference_ids([f"text number {i}" for i in range(20)])))


def test_damage_is_noticed():
    good = record_files.frames([b"payload of some length", b""])
    assert record_files.unframed(good) == [b"payload of some length", b""]
    for at in (0, 9, 14, len(good[0]) - 1):
        bad = bytearray(good[0])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            record_files.unframed([bytes(bad)])
    with pytest.raises(ValueError):
        record_files.unframed([good[0][:-3]])


def test_crc32c_values():
    def plain(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    data = np.random.default_rng(0).bytes(3000)
    parts = [b"123456789", *[data[:n] for n in (0, 1, 3, 4, 5, 255, 256, 257, 511, 512, 513, 3000)]]
    assert record_files.crc32c_many(parts).tolist() == [0xE3069283, *map(plain, parts[1:])]


# ------------------------------------------------------------------ SentencePiece

def test_pieces_equal_the_library(spark):
    import sentencepiece as spm

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = spm.SentencePieceProcessor(model_file=path)
    rnd = random.Random(3)
    vocabulary = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    texts = ["", " ", "   ", "a ", " a", "▁▁x ▁ y▁", "<s></s><unk><0x0A>", "\x00\n\t", "日本語😀�́", "ab" * 3000, "the " * 5000]
    texts += ["".join(rnd.choice("abAB  \n▁éü日😀\x00'012.,thein ") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += ["".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 12))) for _ in range(1500)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (None, "a b")], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r.doc_id: r for r in piece_codec.pieces(docs, piece_codec.PieceOptions(path, remembered=50), ["doc_id"]).collect()}
    for i, t in [*enumerate(texts), (-1, ""), (None, "a b")]:
        ids = [*sp.encode(t), 2]
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (ids, len(ids), sp.decode(ids)), t
    model = piece_codec.memory(piece_codec.PieceOptions(path)).model
    for _ in range(300):  # decoding of any ids, broken byte sequences among them
        ids = [rnd.randrange(1, 259) for _ in range(6)] + [rnd.randrange(259, 32000)]
        assert model.decode(ids) == sp.decode(ids)


def test_piece_digests(spark):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op8_pieces(spark, SF).collect():
        ids = [*sp.encode(text[r.doc_id]), 2]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


# ------------------------------------------------------------------ WARC

class Reader(HTMLParser):
    """Text and links of well-formed pages by the standard parser."""

    HIDDEN, BREAK = {"script", "style", "head", "noscript", "template"}, set("br p div li ul h1 h2 nav article body html td tr table".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.links, self.title, self.in_title = 0, [], [], None, False

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        self.in_title = tag == "title"
        if tag in self.BREAK:
            self.parts.append("\n")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN
        self.in_title = False
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title = " ".join(((self.title or "") + data).split())
        if not self.depth:
            self.parts.append(data)


@pytest.mark.parametrize("page,text,links,title", [
    ('<p title="a > b">x</p>', "x", [], None),
    ('<a onclick="if(a>b){go()}" href="/u">link</a>', "link", ["/u"], None),
    ('p <img alt="1<2"> q', "p q", [], None),
    ("<a title='<br>' data-x=1 href='/v?a=1&amp;b'>v</a>", "v", ["/v?a=1&b"], None),
    ('<svg><title>drawing</title></svg><title>page</title>', "drawingpage", [], "page"),
    ('one <a href="/x>two', "one two", ["/x"], None),
    ("one <p two", "one <p two", [], None),
    ('<a class=k"x href=/y>z</a> 1 < 2 > 1', "z 1 < 2 > 1", ["/y"], None),
    ("<script>var a='<a href=\"/no\">';</script><a HREF = /w>w</a>", "w", ["/w"], None)])
def test_tags_know_their_quotes(page, text, links, title):
    assert warc_derive.page_text(page).replace("\n", " ") == text
    assert warc_derive.page_facts(page) == (title, links)


def test_pages_of_the_tables_equal_the_standard_parser():
    import duckdb

    for (page,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall():
        r = Reader()
        r.feed(page)
        r.close()
        want = "\n".join(x for x in (" ".join(y.split()) for y in "".join(r.parts).split("\n")) if x)
        got = warc_derive.page_text(page)
        assert got.replace("\n", " ").split() == want.replace("\n", " ").split()
        assert warc_derive.page_facts(page) == (r.title, r.links)


def test_tag_scanner_is_linear():
    import time

    for part in ("<", '<a "', "<a href='", '="', "<p <a =", "<!--", "<svg>", "<title>"):
        took = []
        for n in (1_000_000, 4_000_000):
            begun = time.time()
            warc_derive.page_text(part * (n // len(part)))
            took.append(time.time() - begun)
        assert took[1] < 10 * max(took[0], 0.2), part


def test_page_text_equals_the_standard_parser():
    page = ("<!DOCTYPE html><html><head><title>A &amp; B </title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></li>"
            "<li><a class=k href=\"/y?a=1&amp;b\">y</a></li></ul></nav><!-- gone --><p>one  two<br>three &lt;tag&gt; 1 &lt; 2</p>"
            "<p><b>bo</b>ld &eacute;</p></body></html>")
    r = Reader()
    r.feed(page)
    want = "\n".join(x for x in (" ".join(y.split()) for y in "".join(r.parts).split("\n")) if x)
    assert warc_derive.page_text(page) == want
    assert warc_derive.page_facts(page) == (r.title, r.links)


def test_page_text_of_broken_pages():
    assert warc_derive.page_text("a < b <!-- never closed") == "a < b"
    assert warc_derive.page_text("x<script>unclosed <p>") == "x"
    assert warc_derive.page_text("<p" * 50_000) == "<p" * 50_000
    assert warc_derive.page_text("") == "" and warc_derive.page_facts("") == (None, [])


def test_page_text_without_end_tags():
    text = warc_derive.page_text
    assert text("<html><head><title>t</title><body><p>all of the text</p></body></html>") == "all of the text"
    assert text("<head><meta charset=x><title>t</title><style>p{}</style><!-- <p> --><link rel=y><p>one</p><p>two") == "one\ntwo"
    assert text("<head><title>t</title> bare text<p>more") == "bare text\nmore"
    assert text("<head><title>never closed<body><p>x") == "never closed\nx"
    assert text("<head><script>'</head><p>'</script><title>a<b></title></head>x") == "x"
    assert text("<head><title>t</title></body>x") == "x"
    assert text("<head><noscript><img src=p><p>no</p></noscript><title>t</title></head><p>yes") == "yes"
    for name in ("noscript", "template"):
        assert text(f"a<{name}>b<p>c</p>") == "ab\nc"
        assert text(f"<p>a</p><{name}>b<p>c</p><{name}>gone</{name}><p>d") == "a\nb\nc\nd"
        assert text(f"<p>a</p><{name}>gone</{name}>d<{name}-view>e</{name}-view>") == "a\nde"
        assert text(f"<head><{name}><title>t</title><body><p>c") == "c"
        assert text(f"<{name}>" * 100_000 + "x") == "x"
    assert text("<template>a<template>b</template>c</template>d") == "d"
    assert text("<head>" * 50_000 + "x") == "x" and text("<head" * 50_000) == "<head" * 50_000


def test_derived_records(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-1, None, "<p>x"), (-2, "u", None), (None, "u", "y"), (-1, None, "<p>x")], pages.schema)
    pages = pages.unionByName(odd).withColumn("block", F.lit(1))
    source = {r.record_id: r for r in warc_derive.responses(pages).collect()}
    records = warc_derive.derive(warc_derive.responses(pages), ["page_id"])
    rows = records.collect()
    assert len(rows) == 2 * pages.count()
    by = {r.record_id: r for r in rows}
    for r in rows:
        s, other = source[r.refers_to], by[r.concurrent_to]
        data = r.block.encode()
        assert (other.refers_to, other.concurrent_to) == (r.refers_to, r.record_id) and other.warc_type != r.warc_type
        assert (r.target_uri, r.date, r.page_id) == (s.target_uri, s.date, s.page_id)
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(s.payload.encode()).digest()).decode()
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode() and r.content_length == len(data)
        if r.warc_type == "metadata":
            facts = json.loads(r.block)
            assert facts["conversion"] == r.concurrent_to and facts["headers"] == [["Content-Type", "text/html; charset=utf-8"]]
        else:
            p = Reader()
            p.feed(s.payload)
            want = "\n".join(x for x in (" ".join(y.split()) for y in "".join(p.parts).split("\n")) if x)
            if s.page_id in (0, 1, 2):
                assert r.block == want
    # files: exact round trip, and files that no successful task returned are not read
    manifest = warc_derive.write_warc(records, str(tmp_path))
    (tmp_path / "left-behind.warc.gz").write_bytes(b"junk")
    back = warc_derive.read_warc(spark, manifest)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(back.collect(), key=key) == sorted(records.drop("page_id").collect(), key=key)
    assert warc_derive.derive(warc_derive.responses(pages.limit(0)), ["page_id"]).count() == 0


def test_foreign_records_are_read():
    import io

    raw = (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Other: y\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
           b"WARC/1.1\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    got = list(warc_derive.parse_records(io.BytesIO(raw)))
    assert [(r["warc_type"], r["record_id"], r["block"]) for r in got] == [("warcinfo", None, "abcd"), ("response", "<urn:x>", "")]
    with pytest.raises(ValueError):
        list(warc_derive.parse_records(io.BytesIO(raw[:-40] + b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab")))


def test_responses_of_real_files_keep_bytes_and_headers(spark, tmp_path):
    import gzip

    pages = {"<urn:a>": ("Content-Type: text/html; charset=iso-8859-1\r\nX-Odd: \u00e9".encode("latin-1"), "<head><title>\u00e9t\u00e9</title><p>caf\u00e9 \u2013 x".encode("cp1252")),
             "<urn:b>": (b"Server: y\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n  two", b"<p>\xff\xfe\r\n\r\n\x00 end"),
             "<urn:c>": (b"Content-Type: text/html; charset=no-such", "<meta charset='koi8-r'><p>\u0434\u0430".encode("koi8-r"))}
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for rid, (head, body) in pages.items():
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        raw += (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: " + rid.encode() + b"\r\nWARC-IP-Address: 10.0.0.1\r\nX-Note: one\r\n\ttwo"
                b"\r\nWARC-Concurrent-To: <urn:x>\r\nWARC-Concurrent-To: <urn:y>\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(raw))
    files = spark.createDataFrame([(str(tmp_path / "in.warc.gz"),)], "file string")
    records = warc_derive.read_warc(spark, files, raw=True)
    one = {r.record_id: r for r in records.collect()}
    assert len(one) == 4 and bytes(one[None].block) == b"ab"
    for rid, (head, body) in pages.items():
        assert bytes(one[rid].block).endswith(head + b"\r\n\r\n" + body)
        assert {("WARC-IP-Address", "10.0.0.1"), ("X-Note", "one two"), ("WARC-Concurrent-To", "<urn:x>")} <= {tuple(h) for h in one[rid].headers}
    # written and read again: the same bytes and headers
    again = warc_derive.read_warc(spark, warc_derive.write_warc(records, str(tmp_path / "out")), raw=True).collect()
    plain = lambda r: (r.warc_type, r.record_id, r.concurrent_to, bytes(r.block), sorted(map(tuple, r.headers)))
    assert sorted(map(plain, again), key=repr) == sorted(map(plain, one.values()), key=repr)
    source = warc_derive.split_responses(records)
    assert {r.record_id: bytes(r.payload) for r in source.collect()} == {k: v for k, (_, v) in pages.items()}
    rows = warc_derive.derive(source, []).collect()
    assert all(r.payload_digest == warc_derive.digest(pages[r.refers_to][1]) for r in rows) and len(rows) == 6
    facts = {r.refers_to: json.loads(r.block) for r in rows if r.warc_type == "metadata"}
    assert facts["<urn:a>"]["headers"][1] == ["X-Odd", "\u00e9"] and facts["<urn:a>"]["title"] == "\u00e9t\u00e9"
    assert facts["<urn:b>"]["headers"] == [["Server", "y"], ["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"], ["X-Long", "one two"]]
    assert all(f["payload_length"] == len(pages[k][1]) for k, f in facts.items())
    text = {r.refers_to: r.block for r in rows if r.warc_type == "conversion"}
    assert (text["<urn:a>"], text["<urn:c>"]) == ("caf\u00e9 \u2013 x", "\u0434\u0430") and text["<urn:b>"].endswith("end")


def test_payload_text_and_blocks_of_odd_form():
    text, split = warc_derive.payload_text, warc_derive.split_block
    assert text("\ufeffé".encode(), None) == "é" and text("é".encode("utf-16"), "Content-Type: text/html; charset=utf-8") == "é"
    assert text(b"\xe9", None) == "é" and text(b"", None) == "" and text(b"x", "Content-Type: a; charset=hex") == "x"
    assert split(b"HTTP/1.0 204 x") == ("HTTP/1.0 204 x", b"") and split(b"HTTP/1.0 200 x\n\na\r\n\r\nb") == ("HTTP/1.0 200 x", b"a\r\n\r\nb")
    assert split(b"20240101 dns") == (None, b"20240101 dns") and split(b"") == (None, b"")


def test_decoded_text_comes_from_the_ids():
    opt = piece_codec.PieceOptions(model=public_tokenizers.path("piece_bpe_32k.model"))
    mem = piece_codec.WordMemory(piece_codec.PieceModel(opt.model), opt.remembered)
    text = pa.array(["the cat sat on the mat", "", "  two  spaces "])
    whole = mem.encode(text)
    assert [t for _, t in whole] == text.to_pylist()
    mem.known["cat"] = mem.known["mat"]
    assert [t for _, t in mem.encode(text)] == ["the mat sat on the mat", "", "  two  spaces "]


def test_records_are_read_by_as_many_tasks_as_files(spark, tmp_path):
    opt = record_files.RecordOptions(tokenizer=public_tokenizers.path("byte_bpe_50k.json"), file_bytes=600)
    docs = spark.createDataFrame([(i % 7 if i % 3 else None, f"some text {i} " * 20) for i in range(200)], "doc_id long, text string")
    manifest = record_files.write_records(docs, str(tmp_path / "a"), opt)
    assert manifest.count() > 50
    back = record_files.read_records(spark, manifest, with_ids=False)
    busy = back.select(F.spark_partition_id().alias("p")).distinct().count()
    assert busy > 25
    # rows of one doc_id keep their places when the input comes in another order
    first = sorted((r.start, str(r.doc_id), r.ids_crc32) for r in back.collect())
    other = record_files.encoded(docs.orderBy(F.rand(3)), opt, with_ids=False)
    assert sorted((r.start, str(r.doc_id), r.ids_crc32) for r in other.collect()) == first
