import random

import numpy as np
import pytest
import xxhash

from courtside.llm import simhash
from llm.rows import AWKWARD, documents


def plain_fingerprint(text):
    """Straight from the definition: one vote a bit and shingle."""
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def plain_components(prints):
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    items = sorted(label)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {p: root(p) for p in items}


def test_words_within_two_bits_share_an_index():
    rng = random.Random(3)
    words = [rng.getrandbits(23) for _ in range(400)]
    near = [w ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23)) for w in words]
    a, n = simhash.codeword_indices(np.array(words))
    b, m = simhash.codeword_indices(np.array(near))
    assert set(n.tolist()) == {1, 6}
    assert all(set(a[i, : n[i]].tolist()) & set(b[i, : m[i]].tolist()) for i in range(len(words)))


def test_prints_within_four_bits_share_a_key():
    rng = random.Random(4)
    one = [rng.getrandbits(64) for _ in range(500)]
    other = [p ^ sum(1 << b for b in rng.sample(range(64), 4)) for p in one]
    keys = []
    for prints in (one, other):
        rows, found = simhash.fuzzy_keys(np.array(prints, dtype=np.uint64))
        keys.append([set(found[rows == i].tolist()) for i in range(len(prints))])
    assert all(a & b for a, b in zip(*keys))


@pytest.mark.parametrize("text", AWKWARD)
def test_fingerprint_follows_the_definition(text):
    found = simhash.fingerprint(text.encode() if text is not None else None)
    assert found == plain_fingerprint(text)


def near_copies(seed, size=60):
    rng = random.Random(seed)
    base = [f"word{rng.randrange(900)}" for _ in range(size)]
    for _ in range(12):
        copy = list(base)
        copy[rng.randrange(size)] = f"changed{rng.randrange(50)}"
        yield " ".join(copy)


def test_whole_query_equals_brute_force(spark):
    texts = [*AWKWARD, *near_copies(1, 300), *near_copies(2, 500), *near_copies(2, 500), "Tail words differ"]
    docs = documents(spark, texts, start=5)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {5 + i: plain_fingerprint(t) for i, t in enumerate(texts)}
    roots = plain_components(set(prints.values()))
    for doc_id, print_ in prints.items():
        smallest = min(d for d, p in prints.items() if roots[p] == roots[print_])
        assert found[doc_id].print % (1 << 64) == print_ and found[doc_id].component_id == smallest
    assert len(found) == len(texts)


def test_dense_group_gives_a_forest_not_all_pairs():
    from courtside.llm.linking import spanning_links

    rng = random.Random(9)
    prints = np.array(sorted({rng.getrandbits(11) for _ in range(1500)}), dtype=np.uint64)
    left, right = spanning_links(prints, 4)
    assert len(left) == len(prints) - 1  # one component, each link needed
    assert all(int(prints[i] ^ prints[j]).bit_count() <= 4 for i, j in zip(left, right))


def test_centres_find_the_same_components_as_all_pairs(monkeypatch):
    from courtside.llm import linking

    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centres for _ in range(60)})
    roots = plain_components(prints)
    monkeypatch.setattr(linking, "MATRIX", 1)
    left, right = linking.spanning_links(np.array(prints, dtype=np.uint64), 4)
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for i, j in zip(left, right):
        a, b = root(prints[i]), root(prints[j])
        label[max(a, b)] = min(a, b)
    assert {p: root(p) for p in prints} == roots


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    texts = ["same text here for all"] * 3 + ["another text of its own", None, ""]
    docs = documents(spark, texts).unionByName(documents(spark, texts[:1]))
    kept = simhash.stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]
    assert simhash.stage(spark, docs.limit(0), sf_dir).count() == 0
    no_ids = docs.selectExpr("cast(null as bigint) doc_id", *docs.columns[1:])
    assert simhash.stage(spark, no_ids, sf_dir).count() == 3


def test_hot_keys_are_cut_into_pairs_of_blocks(spark):
    from courtside.llm.linking import spread_groups

    rows = spark.createDataFrame([(7, i) for i in range(40)] + [(i, 1) for i in range(100, 130)], "key int, print bigint")
    found = spread_groups(rows, "key", "print", limit=10).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.group, set()).add((r.key, r.print))
    assert max(len(g) for g in groups.values()) < 30 and all(len({k for k, _ in g}) == 1 for g in groups.values())
    met = {frozenset((a, b)) for g in groups.values() for a in g for b in g if a != b}
    assert len(met) == 40 * 39 // 2
    assert {k for g in groups.values() for k in g} == {(r.key, r.print) for r in rows.collect()}


def test_query_form_with_hot_keys_cut(spark, monkeypatch):
    from courtside.llm import linking

    monkeypatch.setattr(linking.spread_groups, "__defaults__", (3,))
    monkeypatch.setattr(linking, "SLOTS", 1 << 20)
    texts = [*near_copies(3, 300), *near_copies(4, 200)]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    roots = plain_components({plain_fingerprint(t) for t in texts})
    for doc_id, text in enumerate(texts):
        root = roots[plain_fingerprint(text)]
        assert found[doc_id] == min(d for d, t in enumerate(texts) if roots[plain_fingerprint(t)] == root)
