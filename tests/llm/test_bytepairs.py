import hashlib
import random

import numpy as np
import pytest
import tiktoken

from courtside.llm import bytepairs as bp
from llm.rows import AWKWARD, documents

LETTERS = [*"theionrsa", " ", "  ", "\n", "1", "é", "ß", "漢", "😀", "'s", "\t", "!", "\x1c", "\x85", "՘", "\U000323b0", "\U00011de0"]


@pytest.fixture(scope="module")
def vocabulary():
    return bp.BytePairs.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=bp.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def random_texts(count, seed):
    rng = random.Random(seed)
    anything = lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
    return ["".join(rng.choice([anything(), rng.choice(LETTERS)]) for _ in range(rng.randrange(30))) for _ in range(count)]


def test_ids_are_the_librarys(vocabulary, library):
    texts = [text or "" for text in AWKWARD] + random_texts(4000, 3) + ["<|endoftext|>", "ab" * 5000, " " * 5000]
    for text, ids in zip(texts, bp.Encoder(vocabulary).encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert vocabulary.decode(ids.tolist()) == text.encode()


def test_every_code_point_is_classed_as_the_library_does(vocabulary, library):
    for first in range(0, 0x110000, 0x4000):
        points = [chr(point) for point in range(first, first + 0x4000) if not 0xD800 <= point < 0xE000]
        text = "".join(f"a{point}1{point} {point} " for point in points)
        assert bp.Encoder(vocabulary).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_perfect_hash_is_minimal_and_names_every_entry(vocabulary):
    entries = list(vocabulary.ranks)
    slots = vocabulary.whole.slots(entries)
    assert sorted(slots.tolist()) == list(range(len(entries)))
    assert vocabulary.encode_words(entries) == [[vocabulary.ranks[entry]] for entry in entries]
    for keys in ([], [b""], [b"a", b"b"], [b"x" * n for n in range(40)]):
        assert sorted(bp.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_merges_equal_a_scan_for_the_least_pair():
    rng = random.Random(5)
    ranks = {bytes([value]): value for value in range(256)}
    while len(ranks) < 400:
        parts = rng.choices([entry for entry in ranks if set(entry) <= set(b"abc")], k=2)
        ranks.setdefault(b"".join(parts), len(ranks))
    vocabulary = bp.BytePairs(ranks)
    for _ in range(300):
        word = bytes(rng.choices(b"abc", k=rng.randrange(1, 40)))
        pieces = [word[i : i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        assert vocabulary.merge(word) == [ranks[piece] for piece in pieces]


def test_forgetting_and_long_texts_change_nothing(vocabulary, monkeypatch):
    texts = random_texts(200, 9) + ["word " * 2000]
    want = [ids.tolist() for ids in bp.Encoder(vocabulary).encode(texts)]
    monkeypatch.setattr(bp, "REMEMBERED", 50)
    monkeypatch.setattr(bp, "LONG_TEXT", 100)
    encoder = bp.Encoder(vocabulary)
    assert [encoder.encode([text])[0].tolist() for text in texts] == want


def test_a_run_of_letters_takes_no_square_time(vocabulary):
    text = "".join(random.Random(2).choices("abcdefgh", k=400_000))
    ids = bp.Encoder(vocabulary).encode([text])[0]
    assert vocabulary.decode(ids.tolist()) == text.encode()


def test_columns_and_digests(spark, vocabulary, library):
    texts = [*AWKWARD, "repeat", "repeat"]
    docs = documents(spark, texts).selectExpr("*", "1 AS key", "2 AS ids_sha256", "3 AS n_tokens")
    rows = docs.select("doc_id", "text", bp.encode_column("text").alias("ids")).withColumn("raw", bp.decode_column("ids")).collect()
    for row in rows:
        assert row.ids == (None if row.text is None else library.encode_ordinary(row.text))
        assert row.raw == (None if row.text is None else row.text.encode())
    found = {row.doc_id: row for row in bp.digests(docs).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bp.digests(docs.limit(0)).collect() == []


def test_query_equals_the_library_on_the_given_table(spark, library):
    folder = "/root/testdata/sf0.01"
    texts = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = bp.query(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
