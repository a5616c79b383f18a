"""Byte-level BPE against the library that the rank file is for."""

import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from cohortry.llm import byte_bpe
from cohortry.llm.catalog import CATALOG
from tests.conftest import SMALL

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = [" ", "\n", "\t", "a", "b", "th", "e", "ing", " ", "　", "\x1c", "\x85", " ", "é", "日本", "1", "23", "!", "?", "...", "'s", "'ll", "😀",
         "́", "  ", "\r\n", "z" * 300, "qx" * 200, "\0", "À", "à", "​", "＇", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def wanted(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def odd_texts():
    rng = random.Random(1)
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 50))) for _ in range(3000)]
    long = ["z" * 30_000, "ab" * 5_000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "日" * 9_000, " " * 50_000, "\n" * 5_000 + "x"]
    return [None, "", *mixed, *long, *mixed[:50]]


def test_odd_texts(spark, library):
    texts = odd_texts()
    table = spark.createDataFrame([(None if i == 7 else i // 2, i, t, "x", "y") for i, t in enumerate(texts)],
                                  "doc_id long, n long, text string, ids string, n_tokens string").repartition(6)
    out = byte_bpe.digests(table, RANKS, PATTERN, id_col="n")
    assert out.columns == ["n", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.n: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()}
    assert got == {i: wanted(library, t) for i, t in enumerate(texts)}
    nulls = byte_bpe.digests(table, RANKS, PATTERN).where("doc_id is null").collect()
    assert [r.n_tokens for r in nulls] == [wanted(library, texts[7])[0]]


def test_ids_and_bytes(spark, library):
    texts = odd_texts()[:400]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    encoded = byte_bpe.encode(table, RANKS, PATTERN)
    for r in byte_bpe.decode(encoded, RANKS, PATTERN).collect():
        assert (r.ids, r.decoded) == ((None, None) if r.text is None else (library.encode_ordinary(r.text), bytearray(r.text.encode())))


def test_forgetting_changes_nothing(library, monkeypatch):
    import pyarrow as pa

    from cohortry.llm import words as W

    monkeypatch.setattr(byte_bpe, "REMEMBERED", 300)
    encoder, texts = byte_bpe.Encoder(RANKS, PATTERN), odd_texts()[:1500]
    for chunk in W.chunks(pa.array(texts, pa.string()), 4000):
        ids, first = encoder.encode(chunk)
        for k, i in enumerate(chunk.rows):
            assert ids[first[k]: first[k + 1]].tolist() == library.encode_ordinary(texts[i] or "")


def test_long_match_costs_little():
    merges = byte_bpe.Merges(byte_bpe.read_ranks(RANKS))
    rng, seconds = random.Random(2), []
    for n in (50_000, 200_000):
        piece = "".join(rng.choice("abcdefgh") for _ in range(n)).encode()
        begin = time.process_time()
        merges.alone(piece)
        seconds.append(time.process_time() - begin)
    assert seconds[1] < 10 * seconds[0]


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in CATALOG["op11_byte_bpe"](spark, SMALL).collect()}
    assert got == {i: wanted(library, t) for i, t in texts.items()}


def test_no_rows(spark, no_docs):
    assert byte_bpe.digests(no_docs, RANKS, PATTERN).count() == 0
