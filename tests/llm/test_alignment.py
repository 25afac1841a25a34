import hashlib
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lorespark.llm import alignment

SCHEMA = "doc_id long, text string, slot string, pair string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def files():
    return alignment.read_tokenizers(A, public_tokenizers.PATTERN, B)


def brute(rows):
    """The contract, token by token, with the libraries themselves."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letters = alignment.byte_letters()
    documents, counts = [], Counter()
    for key, text, *_ in rows:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        a_bytes = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        ends_a, ends_b = [sum(map(len, a_bytes[: i + 1])) for i in range(len(a))], [sum(map(len, b_bytes[: i + 1])) for i in range(len(b))]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([i for i, end in zip(a, ends_a) if low < end <= high], [i for i, end in zip(b, ends_b) if low < end <= high]) for low, high in zip([0, *cuts], cuts)]
        links = [(i, j) for i, end in zip(a, ends_a) for j, other in zip(b, ends_b) if end == other]
        counts.update(links)
        documents.append((key, len(a), len(b), groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for key, n_a, n_b, groups, links in documents:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return out, counts, documents


ROWS = [
    (1, "The cat sat on the mat. The cat  sat.", "a", "b"),
    (2, "The cat sat on the mat. The cat  sat.", None, None),
    (3, "Éauouon — schöne Grüße, 漢字 🙂 and\ttabs\n\nlines", "", ""),
    (4, None, "", ""),
    (5, "", "", ""),
    (6, "<s> </s> <unk> <|endoftext|> ▁ <0x41>", "", ""),
    (None, "a", "", ""),
    (7, " leading and trailing ", "", ""),
    (8, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 1234567890 " * 3, "", ""),
    (1, "mat the cat \x00 \x7f  x", "", ""),
]


def key(row):
    return tuple(str(x) for x in row)


def test_against_the_libraries(spark, files):
    rows = ROWS + [(100 + n, f"number {n % 7} of the words and of der Hund {n % 3}", "", "") for n in range(40)]
    wanted, counts, documents = brute(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, alignment.align(frame, files).collect()), key=key) == sorted((row[:8] for row in wanted), key=key)
    assert sorted(map(tuple, alignment.groups(frame, files).collect()), key=key) == sorted(((row[0], row[8]) for row in wanted), key=key)
    pairs = {(row.a_id, row.b_id): (row.n_docs, row.n_links) for row in alignment.pair_counts(alignment.aligned_table(frame, files)).collect()}
    assert pairs == {pair: (sum(pair in links for *_, links in documents), n) for pair, n in counts.items()}


def test_many_small_segments(spark, files, monkeypatch):
    rows = [(n, "the the cat " * (n % 9) + f"tail {n % 11}", "", "") for n in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    monkeypatch.setattr(alignment, "text_slices", partial(alignment.text_slices, limit=300))
    monkeypatch.setattr(alignment, "SEGMENT_LINKS", 200)
    assert alignment.aligned_table(frame, files).select("segment").distinct().count() > 10
    assert sorted(map(tuple, alignment.align(frame, files).collect()), key=key) == sorted((row[:8] for row in brute(rows)[0]), key=key)


def test_planes_give_back_what_went_in():
    chance = np.random.default_rng(2)
    slots = np.concatenate([np.repeat(np.arange(9000), chance.integers(1, 6, 9000)), chance.integers(0, 65536, 3000)])
    pairs = np.concatenate([np.full(len(slots) - 3000, 77 << 31 | 5), chance.integers(1, 50, 3000) << 31 | 9])
    found, planes = alignment.posting_lists(pairs, slots)
    assert any(len(cell.as_py()) == 8192 for cell in planes.flatten())
    for view in (planes, pa.concat_arrays([planes.slice(0, 10), planes.slice(10)]), pa.concat_arrays([planes, planes]).slice(len(planes))):
        row, plane, slot = alignment.members(view)
        counted = Counter()
        for r, p, s in zip(found[row].tolist(), plane.tolist(), slot.tolist()):
            counted[r, s] += 1 << p
        assert counted == Counter(zip(pairs.tolist(), slots.tolist()))
    empty, none = alignment.posting_lists(np.empty(0, np.int64), np.empty(0, np.int64))
    assert len(empty) == len(none) == 0 and all(len(x) == 0 for x in alignment.members(none))


def test_empty_table_and_a_text_beyond_a_slice(spark, files):
    assert alignment.align(spark.createDataFrame([], SCHEMA), files).collect() == []
    long = "Ouwhea the of rend and threlyes. " * 6000
    rows = [(1, long, "", ""), (2, "the of", "", "")]
    one, two = sorted(alignment.align(spark.createDataFrame(rows, SCHEMA), files).collect())
    assert one.n_a > 40000 and one.n_links == one.n_groups >= one.n_best > 0 and two.count_sum > 6000


def test_same_ids_as_the_json_library_for_every_class_of_letters(files):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    aligner = alignment.Aligner(files)
    texts = [f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}!  {chr(c)} {chr(c)}{chr(c)}" for c in range(0, 0x30000, 13) if not 0xD800 <= c < 0xE000]
    assert [x.ids for x in first.encode_batch(texts, add_special_tokens=False)] == aligner.a.encode_ordinary_batch(texts)
