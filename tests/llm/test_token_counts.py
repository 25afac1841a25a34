import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorespark.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
CONTENT = token_counts.read_vocabulary(PATH)
LIBRARY = Tokenizer.from_file(PATH)

TEXTS = [
    None, "", " \n\t ", "aaaaaaa aaaaaa aa a", "Hello, It's WE'LL don'T!!", "é é Å İstanbul ΣΑΣ ς ß ẞ", "漢字 かな \U0001f600\U0001f468‍\U0001f469 한글", "x<|endoftext|>y <|startoftext|><|endoftext|> <|ENDOFTEXT|>",
    "abcabc" * 2000, "12345 ½ Ⅷ ٣", "\x1c\x1d\x85 　z​", "\x00\x01\x7f", "zq" * 40 + "!?" * 300,
]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_those_of_the_library(spark):
    frame = spark.createDataFrame([(n, text, 5) for n, text in enumerate(TEXTS)] + [(None, "twice", 1)] * 2, "doc_id long, text string, n_tokens int")
    rows = token_counts.count_tokens(frame, CONTENT).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        text = "twice" if row.doc_id is None else TEXTS[row.doc_id]
        assert (row.n_bytes, row.n_tokens) == (len((text or "").encode()), library(text)), text


def test_all_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = {row.doc_id: library(row.text) for row in frame.collect()}
    assert {row.doc_id: row.n_tokens for row in token_counts.count_tokens(frame, CONTENT).collect()} == wanted


def test_more_pieces_than_are_remembered(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED_PIECES", 3)
    counter = token_counts.MergeCounter(CONTENT)
    texts = ["one two three four five", "five six one", ""]
    assert counter.count(texts).tolist() == [library(text) for text in texts]
    assert counter.count(texts).tolist() == [library(text) for text in texts]


def test_empty_table_and_other_vocabulary(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), CONTENT).collect() == []
    with pytest.raises((ValueError, KeyError)):
        token_counts.MergeCounter('{"model": {"type": "WordPiece"}, "pre_tokenizer": {"pretokenizers": []}, "normalizer": {"normalizers": []}, "added_tokens": []}')
