import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from courtside.llm import alignment as al
from llm.rows import AWKWARD, documents


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(al.BYTE_MODEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=al.PIECE_MODEL)


def brute_tokens(text, libraries):
    """(ids, token bytes) of both, or nothing where the bytes are not those of the text."""
    a, b = libraries
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = al.byte_letters()
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    return ids_a, ids_b, bytes_a, bytes_b


def brute_document(text, libraries):
    ids_a, ids_b, bytes_a, bytes_b = brute_tokens(text, libraries)
    ends_a, ends_b = (np.cumsum([len(t) for t in tokens]).tolist() for tokens in (bytes_a, bytes_b))
    common = set(ends_a) & set(ends_b)
    groups, at = [], [0, 0]
    for end in sorted(common):
        sides = []
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            upto = ends.index(end, at[side]) + 1
            sides.append(",".join(map(str, ids[at[side] : upto])))
            at[side] = upto
        groups.append("|".join(sides))
    links, first = [], 0
    for i, (end, token) in enumerate(zip(ends_a, bytes_a)):
        while ends_b[first] <= end - len(token):
            first += 1
        at = first
        while at < len(ends_b) and ends_b[at] - len(bytes_b[at]) < end:
            links.append((ids_a[i], ids_b[at]))
            at += 1
    return len(ids_a), len(ids_b), ";".join(groups), links


def brute(texts, libraries):
    documents_ = [brute_document(text, libraries) for text in texts]
    counts = Counter(pair for *_, links in documents_ for pair in set(links))
    most = {}
    for (a, _), count in counts.items():
        most[a] = max(most.get(a, 0), count)
    return [
        (
            n_a, n_b, groups.count(";") + 1 if n_a else 0, len(links), sum(counts[pair] == most[pair[0]] for pair in links),
            sum(counts[pair] for pair in links), hashlib.sha256(groups.encode()).hexdigest() if n_a else "",
        )
        for n_a, n_b, groups, links in documents_
    ]


def result(frame):
    return sorted((row.doc_id, tuple(row[1:])) for row in frame.collect())


TEXTS = [
    *AWKWARD, "plain words", "plain words", "own ▁ mark", "<|endoftext|> and </s>", "naïve café 漢字かな 🎉👩‍👩‍👧", "tab\tand\r\n lines ",
    " ", "   ", "ﬁ ligature Å", "x" * 3000, "don't  we'll", "՘ \U000323b0",
]


@pytest.mark.parametrize("hot_pairs", [al.HOT_PAIRS, 40, 1])
def test_awkward_texts_by_either_way_of_meeting_counts(spark, libraries, hot_pairs):
    docs = documents(spark, TEXTS).selectExpr("*", "1 AS pair", "2 AS docs", "3 AS _row", "4 AS best")
    found = result(al.alignment_scores(docs, hot_pairs=hot_pairs))
    assert found == list(enumerate(brute(TEXTS, libraries)))


def test_query_equals_brute_force(spark, libraries):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = sorted((row.doc_id, found) for row, found in zip(rows, brute([row.text for row in rows], libraries)))
    assert result(al.query(spark, folder)) == want


def test_rows_without_id_and_empty_tables(spark, libraries):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None)], "doc_id bigint, text string")
    found = sorted(tuple(row) for row in al.alignment_scores(docs).fillna(-1, ["doc_id"]).collect())
    assert found == sorted((i, *row) for i, row in zip((-1, -1, 3), brute(["one two", "one two", None], libraries)))
    assert al.alignment_scores(docs.limit(0)).collect() == []


def test_galloping_gives_ranks():
    rng = random.Random(4)
    for _ in range(200):
        size = rng.randrange(1, 400)
        into = np.array(sorted(rng.sample(range(1, 1000), size)))
        ends = np.array(sorted(rng.sample(range(1, 1000), rng.randrange(1, 400))))
        want = np.searchsorted(into, ends, side="right")
        assert al.ranks(ends, into, np.zeros(len(ends), np.int64)).tolist() == want.tolist()
        assert al.gallop(ends, into, want // 2).tolist() == want.tolist()


def test_groups_of_one_text():
    assert al.groups_of("Hello world") == "18435|22557;995|1526"
    assert al.groups_of("") == al.groups_of(None) == ""
