import glob
import pickle
import re
import random

import pyarrow.parquet as pq
import pytest

from courtside.llm import decontam
from courtside.workspace import scratch_path
from llm.rows import AWKWARD, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(len(w) - 12, min(1, len(w)))):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    for text in texts:
        words, hit, found = plain_words(text), set(), set()
        for window, held in windows.items():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= held
        yield len(words), hit, found


def case():
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(60)] + ["Été", "ñandú"]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (40, 13, 5, 12, 30)]
    items = [(i, p) for i, p in enumerate(passage)] + [(7, passage[0]), (8, None), (9, "..."), (None, "t1 t2"), (2, passage[2])]
    texts = [*AWKWARD[:6], *AWKWARD[7:]]
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(120))]
        cut = passage[rng.randrange(5)].split()
        low = rng.randrange(len(cut))
        words[10:10] = cut[low : low + rng.randrange(30)]
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else ", ".join(words))
    return texts, items


@pytest.mark.parametrize("block_bytes", [8 << 20, 150])
def test_all_matches_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 2000)
    texts, items = case()
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    found = {r.doc_id: r for r in decontam.decontamination(documents(spark, texts), benchmark).collect()}
    for doc_id, (n, hit, held) in enumerate(plain(texts, [i for i in items if i[0] is not None])):
        r = found[doc_id]
        assert (r.n_words, set(r.hit_words), set(r.items), r.n_hit) == (n, hit, held, len(hit))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
    assert any(r.contaminated for r in found.values()) and not all(r.contaminated for r in found.values())


def test_proximity(spark):
    docs = documents(spark, ["c x b y a", "a b", "b z z z z z a z c", "a b c"])
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    index = decontam.build_index(docs, scratch_path(spark, "index"))
    near = {r.doc_id: (r.hit_words, r.items) for r in decontam.matches(index, items, span=5).collect()}
    assert near == {0: ([0], [1]), 1: ([], []), 2: ([], []), 3: ([0], [1])}
    exact = {r.doc_id: r.items for r in decontam.matches(index, items).collect()}
    assert exact == {0: [], 1: [], 2: [], 3: [1]}


def test_empty_tables(spark, sf_dir):
    docs = documents(spark, ["a b c"])
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in decontam.decontamination(docs, none).collect()] == [0]
    assert decontam.decontamination(docs.limit(0), none).count() == 0
    assert decontam.stage(spark, docs, sf_dir).columns == docs.columns


def test_stage_drops_contaminated_rows_only(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    docs = documents(spark, [f"before it {item} and after", "clean words only", None, ""])
    assert sorted(r.doc_id for r in decontam.stage(spark, docs, sf_dir).collect()) == [1, 2, 3]


def test_a_row_group_of_the_index_is_bounded(spark):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, k=370_000)) for _ in range(12)]
    path = scratch_path(spark, "index")
    index = decontam.build_index(documents(spark, texts).coalesce(1), path)
    assert index.count() == len(texts)
    groups = [file.row_group(i) for f in glob.glob(f"{path}/*.parquet") for file in [pq.ParquetFile(f).metadata] for i in range(file.num_row_groups)]
    assert len(groups) > 1
    for group in groups:
        assert sum(group.column(c).total_uncompressed_size for c in range(group.num_columns)) <= 2 * decontam.ROW_GROUP_BYTES
        assert max(group.column(c).num_values for c in range(group.num_columns)) <= 1000
    words = " ".join(texts[7].split()[5000:5020])
    found = decontam.matches(index, spark.createDataFrame([(1, words)], "item_id bigint, text string")).collect()
    assert {r.doc_id: (sorted(r.hit_words), r.items) for r in found if r.items} == {7: (list(range(5000, 5020)), [1])}


def test_a_block_of_windows_takes_a_few_bytes_a_word():
    rng = random.Random(7)
    items = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(60))) for i in range(2000)]
    block = decontam.test_block([*items, (2000, items[5][1]), (2001, "t1"), (2002, ""), (2003, "t1 t2")])
    assert len(block.starts) == 2000 * 48 + 2
    assert len(pickle.dumps(block)) <= 40 * len(block.words)
    held = {tuple(block.terms[block.window(n)].tolist()): block.held_by(n) for n in range(len(block.starts))}
    term = [decontam.term_hash(w.encode()) for w in items[5][1].split()]
    assert all(held[tuple(term[i : i + 13])] == [5, 2000] for i in range(48))
    assert held[(decontam.term_hash(b"t1"),)] == [2001]
    assert held[(decontam.term_hash(b"t1"), decontam.term_hash(b"t2"))] == [2003]
