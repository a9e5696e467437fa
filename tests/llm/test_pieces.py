import random

import pytest

from courtside.llm import pieces
from llm.rows import AWKWARD, documents

TEXTS = [
    *AWKWARD, "Hello  world", " leading and trailing ", "tab\tand\nlines\r\n", "own ▁ marks ▁▁ here▁", "﷐ ﷐", "▁", "﷐",
    "x" * 5000, "naïve café 漢字かな 🎉👩‍👩‍👧 ퟿", "a ﷐ b▁c",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load()


@pytest.mark.parametrize("together", [200_000, 1])
def test_round_trip_of_every_text(vocabulary, monkeypatch, together):
    monkeypatch.setattr(pieces, "_TOGETHER", together)
    ids = pieces.encode_batch(TEXTS, vocabulary)
    assert [pieces.decode(None if i is None else i.tolist(), vocabulary) for i in ids] == TEXTS


def brute_best(word, vocabulary):
    """The best total over all segmentations, from the back."""
    from functools import cache

    @cache
    def best(at):
        if at == len(word):
            return 0.0
        found = []
        for end in range(at + 1, min(at + vocabulary.longest, len(word)) + 1):
            score = vocabulary.scores.get(word[at:end], vocabulary.unknown if end == at + 1 else None)
            if score is not None:
                found.append(score + best(end))
        return max(found)

    return best(0)


def test_paths_are_best_and_do_not_depend_on_the_order(vocabulary):
    rng = random.Random(6)
    words = sorted({pieces.MARK + "".join(rng.choice("theionrsa") for _ in range(rng.randrange(1, 12))) for _ in range(400)})
    walk = pieces.TrieViterbi(vocabulary)
    by_id = {i: p for p, i in vocabulary.ids.items()}
    for word in words:
        ids = walk.encode(word)
        assert ids == pieces.TrieViterbi(vocabulary).encode(word)
        assert "".join(by_id[i] for i in ids) == word
        assert sum(vocabulary.scores[by_id[i]] for i in ids) == brute_best(word, vocabulary)


def test_same_ids_as_the_library_for_a_unigram_model(vocabulary):
    """The library's own Viterbi, on the vocabulary with scores that its 32-bit sums can hold."""
    model_pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    held = pieces.Pieces(
        vocabulary.ids, {p: max(s, -40000.0) for p, s in vocabulary.scores.items()}, vocabulary.byte_ids,
        vocabulary.texts, vocabulary.longest, -40010.0,
    )
    rng = random.Random(8)
    for _ in range(150):
        text = " ".join("".join(rng.choice("theionrsaézñ") for _ in range(rng.randrange(1, 9))) for _ in range(6))
        assert pieces.encode_batch([text], held)[0].tolist() == library.encode(text)


def test_query_form(spark):
    rows = {r.doc_id: r for r in pieces.encode_documents(documents(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    assert all(rows[i].exact for i in rows)
    assert rows[0].ids is None and rows[1].ids == [] and rows[0].n_tokens == 0
    assert pieces.encode_documents(documents(spark, TEXTS).limit(0)).count() == 0
