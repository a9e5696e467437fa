"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes one leading mark and its characters, each space written as the mark. It is cut
before every run of marks into marked words; no piece of the vocabulary has a mark behind another
character, so the best segmentation of a text is that of its words in turn. The distinct words of
many texts are sorted, which lays them out as a trie walked depth first: neighbours share
their longest common prefix, and the forward scores of that prefix are kept, so only the rest
of a word is scored. The best path has the largest sum of piece scores; characters no piece covers
are written as byte pieces. Equal sums take the longer last piece.

Decoding turns pieces and bytes back and gives the very text: a mark that stands in the text
itself is written as bytes, so it never reads as a space.

Defined cases: null has no ids and decodes to null; an empty text has no ids; rows are independent,
so repeated rows and empty tables need nothing; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from courtside.llm.shared import source

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Stands for a mark of the text itself while it is segmented; a private-use code point may
# stand in a text too, so it is itself written as bytes.
_OWN_MARK = "﷐"
_MARKED_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Texts are segmented together until they hold this many distinct words.
_TOGETHER = 200_000
# Far below any sum of scores.
NO_PIECE = -1e300


@dataclass
class Pieces:
    """The vocabulary: ids and scores of ordinary pieces, ids of the byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: list[bytes]  # by id: the bytes a piece stands for, marks as spaces
    longest: int
    unknown: float
    # Score of every string that ends a piece; NO_PIECE for those that are none themselves.
    endings: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.endings = {piece[k:]: NO_PIECE for piece in self.scores for k in range(1, len(piece))} | self.scores

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids, texts = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                ids[piece], scores[piece] = i, model.get_score(i)
                texts.append(piece.replace(MARK, " ").encode())
        longest = max(map(len, ids), default=1)
        return cls(ids, scores, byte_ids, texts, longest, min(scores.values(), default=0.0) - 10.0)


class TrieViterbi:
    """Segments words given in sorted order, sharing work along common prefixes."""

    def __init__(self, vocabulary: Pieces):
        self.vocabulary = vocabulary
        self.word = ""
        self.best: list[float] = [0.0]
        self.back: list[int] = [0]

    def encode(self, word: str) -> list[int]:
        """Ids of the best path. Candidates for the last piece are tried from the shortest on, and no
        longer than some piece still ends so."""
        vocabulary, endings = self.vocabulary, self.vocabulary.endings
        best, back, unknown, longest = self.best, self.back, vocabulary.unknown, vocabulary.longest
        shared = 0
        for a, b in zip(word, self.word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            # A single character always leads on, if need be as bytes.
            came = end - 1
            known = endings.get(word[came])
            score = best[came] + (unknown if known is None or known == NO_PIECE else known)
            if known is not None:
                for start in range(end - 2, max(end - longest, 0) - 1, -1):
                    known = endings.get(word[start:end])
                    if known is None:
                        break
                    if best[start] + known >= score:
                        score, came = best[start] + known, start
            best.append(score)
            back.append(came)
        self.word = word
        path, end = [], len(word)
        while end:
            path.append(word[back[end] : end])
            end = back[end]
        ids: list[int] = []
        for piece in reversed(path):
            known = vocabulary.ids.get(piece)
            if known is not None:
                ids.append(known)
            else:
                raw = MARK if piece == _OWN_MARK else piece
                ids += [vocabulary.byte_ids[value] for value in raw.encode("utf-8")]
        return ids


def marked_words(text: str) -> list[str]:
    """Marked words of a text; their concatenation is the marked text."""
    if _OWN_MARK in text:
        # Kept apart so that it cannot be taken for a mark of the text.
        pieces = [part for part in re.split(f"({_OWN_MARK})", text)]
        words: list[str] = []
        for number, part in enumerate(pieces):
            if number % 2:
                words.append("\0" + part)
            elif part or not number:
                marked = part.replace(MARK, _OWN_MARK).replace(" ", MARK)
                words += _MARKED_WORD.findall(marked if number else MARK + marked)
        return words
    return _MARKED_WORD.findall(MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK))


def encode_batch(texts: list[str | None], vocabulary: Pieces) -> list[np.ndarray | None]:
    """Ids of each text. The distinct words are segmented once, in sorted order."""
    number: dict[str, int] = {}
    held, out = [], []
    for text in texts:
        words = marked_words(text) if text else []
        held.append(None if text is None else np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        if len(number) >= _TOGETHER:
            out += _assemble(held, number, vocabulary)
            number, held = {}, []
    return out + _assemble(held, number, vocabulary)


def _assemble(held: list[np.ndarray | None], number: dict[str, int], vocabulary: Pieces) -> list[np.ndarray | None]:
    flat: list[int] = []
    begin, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    walk = TrieViterbi(vocabulary)
    for word in sorted(number):
        at = number[word]
        begin[at] = len(flat)
        if word == "\0" + _OWN_MARK:
            flat += [vocabulary.byte_ids[value] for value in _OWN_MARK.encode()]
        else:
            flat += walk.encode(word)
        size[at] = len(flat) - begin[at]
    ids, out = np.array(flat, dtype=np.int32), []
    for words in held:
        if words is None:
            out.append(None)
            continue
        sizes = size[words]
        ends = np.cumsum(sizes)
        shift = np.repeat(begin[words] - ends + sizes, sizes)
        out.append(ids[shift + np.arange(len(shift))])
    return out


def decode(ids: list[int] | None, vocabulary: Pieces) -> str | None:
    if ids is None:
        return None
    raw = b"".join([vocabulary.texts[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    if not rows:
        return pa.array([], pa.list_(pa.int32()))
    if any(row is None for row in rows):
        return pa.array(rows, pa.list_(pa.int32()))
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


_loaded: dict[str, Pieces] = {}


def _vocabulary(path: str) -> Pieces:
    """Loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Pieces.load(path)
    return _loaded[path]


def encode_column(text: Column | str, model: str = MODEL) -> Column:
    """The ids of each text as array<int>."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(model)
        for texts in batches:
            yield _lists(encode_batch([text.as_py() for text in texts], vocabulary))

    return encode(text)


def decode_column(ids: Column | str, model: str = MODEL) -> Column:
    @F.arrow_udf(T.StringType())
    def undo(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(model)
        for rows in batches:
            yield pa.array([decode(row, vocabulary) for row in _as_lists(rows)], pa.string())

    return undo(ids)


def _as_lists(rows: pa.Array) -> Iterator[list[int] | None]:
    for row in rows:
        yield None if not row.is_valid else row.values.to_numpy(zero_copy_only=False).tolist()


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, the hash of the text and of its decoding, and whether the round trip is exact."""
    encoded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), encode_column("text", model).alias("ids"))
    decoded = encoded.withColumn("decoded", F.xxhash64(decode_column("ids", model)))
    return decoded.select(
        "doc_id",
        "ids",
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_tokens"),
        (F.col("decoded") == F.col("text_hash")).alias("exact"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(source(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)
