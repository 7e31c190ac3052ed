import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riverbed.llm.packing import pack_documents
from riverbed.llm.token_counts import count_tokens
from riverbed.llm.warc import read_archives, record, records, write_archives, _member

ODD = [
    None, "", " ", "\n\n", "The cat,  sat. On\tthe MAT.\r\n", "x" * 5000, "é" * 300 + " É. Ünder, straße.", "İstanbul. ΣΑΣ. ΟΔΟΣ, ὀδός", "<|endoftext|> a<|startoftext|>. b <|endoftext|>x",
    "don't it's. 'tis, 42, 3.14. a.b,c. ...", "a\u00a0b \u2003 c\u3000d", "e\u0301. n\u0303, a\u0301b.", "漢字。かな, カナ. 한국어.", "emoji 😀. 👍🏽, ok", "a\x0bb\x0cc\x1cd\x85e", "##  code();\n\n\n   if x:\n\ty  ", "trail   ", "   lead",
    "a\t  b \t\t c\r\n\r\n d\t\n\n\te", "x\u00a0  y\u3000\n\nz\x85 \n w",
]


def sample(n=150):
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id limit {n}").fetchall()]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, id string").repartition(3)


def test_counts_equal_the_library(spark):
    rng = random.Random(1)
    alphabet = "aB. ,\n\té'İσΣ<|endoftext|>1-"
    texts = ODD + sample() + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in count_tokens(frame(spark, texts), public_tokenizers.path("word_bpe_49k.json"), limit=20).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 20), (t, n, got[i])


def test_counts_of_an_empty_table(spark):
    assert count_tokens(frame(spark, ["x"]).filter("false"), public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("ranks", [None, "byte_bpe_50k.tiktoken"])
def test_packing_round_trip(spark, ranks):
    rng = random.Random(2)
    texts = ODD + sample() + ["word " * 20000] + ["".join(rng.choice("aB. \n\té'<|endoftext|>1") for _ in range(60)) for _ in range(300)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack_documents(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), ranks and public_tokenizers.path(ranks)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)), t
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # nothing is padded


def test_packing_of_an_empty_table(spark):
    assert pack_documents(frame(spark, ["x"]).filter("false"), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_archives_round_trip(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", big), (7, "u", big), (None, "u", big), (None, "n", "only" * 500), (8, "x\r\ny", "z" * 300000), (9, "e", "W\r\n\r\nC" * 400)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    back = read_archives(write_archives(pages), with_payload=True).collect()
    assert len(back) == len(rows)
    want = sorted(
        (p or -1, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and p != 7 else "response", 7 if h == big and p != 7 else None) for p, _, h in rows
    )
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == want
    for r in back:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    assert read_archives(write_archives(pages.filter("false"))).collect() == []


def test_a_broken_archive_is_refused():
    raw = record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    assert [r["payload"] for r in records(_member(raw) * 2)] == [b"hello"] * 2
    for bad in (_member(raw)[:-9], _member(raw.replace(b"hello", b"hellO")), _member(raw[:-4]), _member(raw + b"x")):
        with pytest.raises((ValueError, zlib.error)):
            list(records(bad))


def test_foreign_records_need_no_digests():
    """A warcinfo, a Base32 digest and a response without a length, in one archive."""
    import base64
    import gzip
    import hashlib

    from riverbed.llm.warc import records

    def member(kind, block, **more):
        lines = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", f"Content-Length: {len(block)}", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items())]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    payload = b"<p>x</p>"
    b32 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    reply = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload
    got = list(records(member("warcinfo", b"software: x\r\n") + member("response", reply, WARC_Payload_Digest=f"sha1:{b32}")))
    assert [(r["record_type"], r["page_id"], r["payload_bytes"]) for r in got] == [("warcinfo", None, 13), ("response", None, 8)]
    import pytest

    with pytest.raises(ValueError):
        list(records(member("response", reply, WARC_Payload_Digest="sha1:" + "A" * 32)))
