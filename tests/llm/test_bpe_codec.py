import hashlib
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lorespark.llm import bpe_codec

RANKS = bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
CODEC = bpe_codec.BytePairCodec(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})

TEXTS = [
    None, "", " ", "\n\n  \t a", "It's we'll 'quoted' don'T", "naïve Ünïcödé 漢字 かな \U0001f600\U0001f468‍\U0001f469", "a" * 5000, "ab" * 3000 + "!" * 777,
    " " * 300 + "x", "\x1c\x1d\x85 　z​", "12345 ½ Ⅷ ٣", "<|endoftext|> plain", "\x00\x01\x7f", "zq" * 40 + "éè" * 60, "é́ ﻿",
]


def test_ids_and_bytes_are_those_of_the_library(spark):
    frame = spark.createDataFrame([(n, text, "x") for n, text in enumerate(TEXTS)] + [(None, "twice", "y")] * 2, "doc_id long, text string, ids string")
    encoded = bpe_codec.encode(frame, RANKS, public_tokenizers.PATTERN, with_bytes=True)
    rows = encoded.collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        text = "twice" if row.doc_id is None else TEXTS[row.doc_id] or ""
        assert row.ids == LIBRARY.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    again = bpe_codec.decode(encoded.select("doc_id", "ids"), RANKS).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, encoded.select("doc_id", "decoded").collect()))
    row = bpe_codec.digests(encoded).filter("doc_id = 4").first()
    ids = LIBRARY.encode_ordinary(TEXTS[4])
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TEXTS[4].encode()).hexdigest())


def test_random_bytes_backtrack_to_the_merges():
    import random

    chance = random.Random(5)
    for _ in range(3000):
        data = bytes(chance.choice(b"aethn s\xc3\xa9\xff!1") for _ in range(chance.randint(1, 24)))
        assert CODEC.encode_piece(data) == CODEC.merged(data)


def test_empty_table_and_bad_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.digests(bpe_codec.encode(empty, RANKS, public_tokenizers.PATTERN, with_bytes=True)).collect() == []
    with pytest.raises(ValueError):
        bpe_codec.BytePairCodec(b"YQ== 0", public_tokenizers.PATTERN)


def test_all_documents_as_the_library_gives_them(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = {r.doc_id: LIBRARY.encode_ordinary(r.text or "") for r in frame.collect()}
    assert {r.doc_id: r.ids for r in bpe_codec.encode(frame, RANKS, public_tokenizers.PATTERN).collect()} == wanted


def test_a_worker_decodes_in_small_slices(spark):
    """What one slice needs is bounded: decoding holds some thirty bytes for a byte of text."""
    frame = spark.range(40).selectExpr("id AS doc_id", "repeat('word and more ', 2000) AS text").coalesce(1)
    rows = bpe_codec.encode(frame, RANKS, public_tokenizers.PATTERN, with_bytes=True).collect()
    assert {bytes(row.decoded) for row in rows} == {b"word and more " * 2000} and len(rows) == 40
    texts = pa.array(["word and more " * 2000] * 40)
    held = [len(data) for _, data, _ in bpe_codec.text_slices(texts, bpe_codec.OUTPUT_BYTES)]
    tracemalloc.start()
    _, ids, bounds = bpe_codec._encoded(CODEC, texts.slice(0, 40 // len(held)))
    bpe_codec._decoded(CODEC, ids, bounds)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(held) == 40 * 28000 and most < 8 << 20
