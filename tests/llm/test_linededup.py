import random

import numpy as np
import pytest

from courtside.llm import linededup as ld, linetext
from llm.rows import AWKWARD, documents


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(70))) for _ in range(2))
        exact = table_distance(a, b)
        assert ld.edit_distance(a, b) == exact <= ld.stepwise_edits(a, b, 99)
        assert (ld.edit_distance(a, b, 9) <= 9) == (exact <= 9)


def plain_mix(value):
    value = (value ^ (value >> 32)) * 0xFF51AFD7ED558CCD % 2**64
    value = (value ^ (value >> 29)) * 0xC4CEB9FE1A85EC53 % 2**64
    return value ^ (value >> 32)


def plain_print(form):
    """Straight from the definition: a vote per bit and word."""
    votes, words = [0] * 64, form.encode().split(b" ")
    words = [w for w in words if len(w) >= 4] or words
    for word in words:
        code = plain_mix(sum(byte * pow(linetext._BYTE_FACTOR, i, 2**64) for i, byte in enumerate(word)) % 2**64)
        for bit in range(linetext.BITS):
            votes[bit] += code >> bit & 1
    return sum(1 << bit for bit in range(linetext.BITS) if 2 * votes[bit] > len(words))


def test_lines_of_a_chunk_follow_the_definition(monkeypatch):
    texts = [t for t in AWKWARD if not t or len(t) < 9999] + ["A-b 12\n\n  x_y\n", " ".join(f"v{i}" for i in range(1000)), "last\nline"]
    for stretch in (1 << 20, 10):
        monkeypatch.setattr(linetext, "STRETCH", stretch)
        found = {}
        for lines in linetext.read_lines(texts):
            for i in range(len(lines.rows)):
                found[int(lines.rows[i]), int(lines.numbers[i])] = (lines.text(i), int(lines.prints[i]), int(lines.forms[i]))
        expected_ = {}
        for row, text in enumerate(texts):
            for number, line in enumerate((text or "").split("\n")):
                if linetext.normal_form(line):
                    expected_[row, number] = (linetext.normal_form(line), plain_print(linetext.normal_form(line)))
        assert {k: v[:2] for k, v in found.items()} == expected_
        assert len({v[2] for v in found.values()}) == len({v[0] for v in found.values()})


def expected(texts):
    """Lines to keep, by comparing every pair of distinct normalised lines."""
    places = {}
    for doc_id, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            form = linetext.normal_form(line)
            if form:
                places.setdefault(form, []).append((doc_id, number))
    forms = sorted(places)
    prints = {form: plain_print(form) for form in forms}
    root = {f: f for f in forms}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(forms):
        for b in forms[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= ld.REACH and ld.similar(a, b):
                root[find(b)] = find(a)
    groups = {}
    for f in forms:
        groups.setdefault(find(f), []).extend(places[f])
    gone = {place for held in groups.values() for place in sorted(held)[1:]}
    out = []
    for doc_id, text in enumerate(texts):
        lines = (text or "").split("\n")
        kept = [line for n, line in enumerate(lines) if (doc_id, n) not in gone]
        out.append(None if text is None else "\n".join(kept))
    return out


def variants(rng, base, count):
    words = base.split()
    for _ in range(count):
        copy = list(words)
        copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}y"
        yield " ".join(copy)


def corpus():
    rng = random.Random(5)
    bases = [" ".join(f"word{rng.randrange(300)}" for _ in range(40)) for _ in range(6)]
    texts = list(AWKWARD)
    for _ in range(12):
        lines = [line for base in rng.sample(bases, 3) for line in variants(rng, base, 2)]
        texts.append("\n".join([*lines, "Page 12 of 90", "", bases[0].upper() + " !!", f"unique{rng.random()} line"]))
    return texts


def test_whole_operator_equals_brute_force(spark):
    texts = corpus()
    docs = documents(spark, texts)
    found = {r.doc_id: r for r in ld.drop_lines(docs).collect()}
    assert [found[i].text for i in range(len(texts))] == expected(texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.values())
    assert set(ld.drop_lines(docs).columns) == {*docs.columns, "_lines_removed"}


def test_linked_but_unlike_lines_stay():
    assert not ld.similar("a" * 10, "b" * 10) and ld.similar("abcdefghij", "abcdefghiX") and not ld.similar("abc", "")


@pytest.mark.parametrize("size", [40, 900])
def test_neighbours_of_a_bucket(size):
    rng = random.Random(size)
    free = ld.BITS - ld.BLOCK_BITS
    centres = [rng.getrandbits(free) for _ in range(size // 3)]
    keys = sorted({c ^ sum(1 << b for b in rng.sample(range(free), rng.randrange(6))) for c in centres for _ in range(3)})
    found = ld.has_neighbour(np.array(keys, dtype=np.uint64))
    for k, one in enumerate(keys):
        assert found[k] == any(j != k and (one ^ other).bit_count() <= ld.REACH for j, other in enumerate(keys))


def test_empty_table_and_repeated_rows(spark):
    docs = documents(spark, ["alpha beta gamma\nalpha beta gamma", "delta"])
    assert ld.drop_lines(docs.limit(0)).count() == 0
    twice = ld.drop_lines(docs.unionByName(docs)).collect()
    assert sorted(r.text for r in twice) == ["alpha beta gamma", "alpha beta gamma", "delta", "delta"]
