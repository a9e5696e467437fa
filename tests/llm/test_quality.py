import random
import re

import numpy as np

from courtside.llm import quality
from llm.rows import AWKWARD, documents


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 2000 else None
    hit = {i + k for i, w in enumerate(windows) if often and w in often for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, hit


def test_counts_equal_the_definition():
    rng = random.Random(3)
    texts = [t for t in AWKWARD if not t or len(t) < 9999]
    texts += [" ".join(rng.choice(["a", "b|", "c\n", "d#"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    for text in texts:
        n, chars, symbols, dup, hit = plain(text)
        assert quality.statistics(text)[:5] == (n, chars, symbols, dup, len(hit))


def test_query_columns_over_awkward_rows(spark):
    judged = quality.judge(documents(spark, AWKWARD), [])
    rows = {r.doc_id: r for r in judged.collect()}
    assert len(rows) == len(AWKWARD) and not rows[0]._judged.kept and rows[0]._judged.n_words == 0
    assert rows[6]._judged.base_failed and rows[6]._judged.n_words == 60_000
    assert judged.columns == [*documents(spark, []).columns, "_judged"]


def test_learns_interpretable_rules(spark):
    rng = random.Random(7)
    good = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(150)]
    loud = [" ".join(f"W{rng.randrange(500)}!!" for _ in range(60)) for _ in range(60)]
    marked = [" ".join(f"w{rng.randrange(500)}###" for _ in range(60)) for _ in range(60)]
    texts = good + loud + marked
    docs = documents(spark, texts)
    labels = spark.createDataFrame(
        [(i, int(i < 150), None) for i in range(len(texts))] + [(None, 0, None), (3, None, None)],
        "doc_id bigint, quality int, text string",
    )
    rules = quality.learn_rules(docs, labels)
    assert rules and all(1 <= len(tests) <= quality.MOST_TESTS for tests in rules)
    kept = {r.doc_id for r in quality.judge(docs, rules).where("_judged.kept").collect()}
    assert kept == set(range(150))


def test_without_labels_only_the_base_rule_decides(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = documents(spark, ["w " * 10, " ".join(f"x{i}" for i in range(30))])
    assert quality.learn_rules(docs, none) == []
    one_class = spark.createDataFrame([(0, 1), (1, 1)], "doc_id bigint, quality int")
    assert quality.learn_rules(docs, one_class) == []
    assert [r.doc_id for r in quality.judge(docs, []).where("_judged.kept").collect()] == [1]


def test_pruning_drops_tests_that_do_not_hold_elsewhere():
    values = np.zeros((40, len(quality.RATIOS)))
    values[:20, 0] = 9
    bad = values[:, 0] == 9
    tests = [quality.Test("words", True, 5.0), quality.Test("word_length", True, 1.0)]
    assert quality._prune(tests, values, bad) == tests[:1]
