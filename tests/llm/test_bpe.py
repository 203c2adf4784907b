"""BPE and token files over a whole table, against the library."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, token_files
from ledgerloom.llm.common import scratch, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def expected():
    t, rows = Tokenizer.from_file(bpe.default_path()), {}
    t.no_padding()
    t.no_truncation()
    d = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    for i, text in zip(d["doc_id"], d["text"]):
        ids = t.encode(text or "", add_special_tokens=False).ids
        rows[i] = (ids, t.decode(ids, skip_special_tokens=False))
    return rows


def test_digests(spark, expected):
    got = bpe.op8(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(ids) for i, (ids, _) in expected.items()}
    for r in got:
        ids, text = expected[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.n_joins for r in got) > 100  # long texts come through tree concatenation


def test_leaves_of_any_size(monkeypatch):
    t, c, rng = Tokenizer.from_file(bpe.default_path()), bpe.Codec(), np.random.default_rng(8)
    parts = [" a", " bc", "'ll", " don't", "é", "b", "!", "1", " \n", "x ", "\n", "  ", " 漢", " ", " ...", "'", " l'été", "<|endoftext|>"]
    for leaf in (4, 9, 50):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        for _ in range(200):
            s = "".join(rng.choice(parts, rng.integers(1, 120)))
            assert np.frombuffer(c.encode(s), np.uint32).tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)
    assert c.joins > 1000


def test_token_files(spark, expected):
    docs = table(spark, SF)
    manifest = token_files.write(docs, scratch(spark, "t"))
    at = 0
    got = {r.doc_id: r for r in token_files.read(manifest).collect()}
    for i in sorted(expected):
        ids = np.array([*expected[i][0], 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = spark.createDataFrame([(5, "one"), (5, "two"), (4, None)], "doc_id long, text string").coalesce(1)
    reader = token_files.Reader(token_files.write(some, scratch(spark, "t")).orderBy("first").collect()[-1].path)
    assert [reader.doc(5, k).tolist() for k in (0, 1)] == [[*bpe.codec().lib.encode(x, add_special_tokens=False).ids, 0] for x in ("one", "two")]
