from collections import Counter

import pytest
from pyspark.sql import functions as F

from courtside.llm import tokencounts as tc
from llm.rows import AWKWARD, documents

CHANGES = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, deleted boolean, seq int"


@pytest.fixture
def rollup(spark, tmp_path):
    return tc.TokenRollup(spark, f"file://{tmp_path}/rollup")


def changes(spark, *rows):
    return spark.createDataFrame([(i, s, "en", "v1", n, gone, seq) for i, s, n, gone, seq in rows], CHANGES)


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_inserts_revisions_and_deletes(spark, rollup):
    assert totals(rollup) == {}
    assert rollup.commit("one", changes(spark, (1, "a", 10, False, 0), (2, "a", 5, False, 0), (3, "b", 7, False, 0), (None, "b", 1, False, 0)))
    assert totals(rollup) == {("a", "en", "v1"): (2, 15), ("b", "en", "v1"): (2, 8)}
    # 1 moves to another source, 2 goes, 9 was never there, 3 is revised twice in one batch.
    batch = changes(spark, (1, "b", 12, False, 1), (2, "a", 0, True, 1), (9, "a", 0, True, 1), (3, "b", 99, False, 1), (3, "b", 8, False, 2))
    assert rollup.commit("two", batch)
    assert totals(rollup) == {("b", "en", "v1"): (3, 21)}
    assert not rollup.commit("two", batch)
    assert totals(rollup) == {("b", "en", "v1"): (3, 21)}
    assert rollup.commit("three", changes(spark))
    assert rollup.ledger().agg(F.sum("tokens")).first()[0] == 21


def test_older_changes_that_come_later_are_ignored(spark, rollup):
    rollup.commit("new", changes(spark, (1, "a", 50, False, 5), (2, "a", 0, True, 5), (3, "a", 4, False, 5)))
    rollup.commit("old", changes(spark, (1, "a", 10, False, 1), (2, "a", 9, False, 4), (3, "a", 0, True, 4)))
    assert totals(rollup) == {("a", "en", "v1"): (2, 54)}
    rollup.commit("same", changes(spark, (1, "b", 7, False, 5), (2, "b", 1, False, 6)))
    assert totals(rollup) == {("a", "en", "v1"): (1, 4), ("b", "en", "v1"): (2, 8)}


def test_an_interleaved_writer_gives_the_totals_of_turns(spark, tmp_path):
    batches = {"x": [(1, "a", 20, False, 0), (2, "a", 1, False, 0)], "y": [(1, "b", 30, False, 1), (3, "b", 2, False, 0)]}
    found = []
    for order in ("xy", "yx", "both"):
        rollup = tc.TokenRollup(spark, f"file://{tmp_path}/{order}")
        if order == "both":
            # The other writer commits between this one's settling and its publishing.
            other, publish = tc.TokenRollup(spark, rollup.root), rollup._publish

            def interrupted(number, batch, name, whole):
                rollup._publish = publish
                assert other.commit("y", changes(spark, *batches["y"]))
                return publish(number, batch, name, whole)

            rollup._publish = interrupted
            assert rollup.commit("x", changes(spark, *batches["x"]))
        else:
            assert all(rollup.commit(name, changes(spark, *batches[name])) for name in order)
        found.append(totals(rollup))
    assert found[0] == found[1] == found[2] == {("a", "en", "v1"): (1, 1), ("b", "en", "v1"): (2, 32)}


def test_compaction_keeps_totals_batches_and_order(spark, rollup):
    rollup.commit("one", changes(spark, (1, "a", 10, False, 3), (2, "a", 5, False, 3), (4, "c", 1, False, 0)))
    rollup.commit("two", changes(spark, (2, "a", 0, True, 4)))
    before = totals(rollup)
    rollup.compact()
    assert totals(rollup) == before and len(rollup.commits()) == 3
    assert not rollup.commit("one", changes(spark, (1, "a", 99, False, 9)))
    rollup.commit("three", changes(spark, (2, "a", 8, False, 2), (1, "a", 11, False, 3)))
    assert totals(rollup) == {("a", "en", "v1"): (1, 11), ("c", "en", "v1"): (1, 1)}


def test_documents_without_an_id_count_by_their_text(spark, rollup):
    docs = documents(spark, ["one two", "one two", "three", None]).withColumn("doc_id", F.lit(None).cast("bigint"))
    rollup.commit("arrival", tc.changes_of(docs))
    assert sum(row.docs for row in rollup.totals().collect()) == 3


def test_unpublished_rows_do_not_count(spark, rollup):
    rollup.commit("one", changes(spark, (1, "a", 10, False, 0)))
    changes(spark).select("doc_id", "source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("docs"), "tokens").write.parquet(
        f"{rollup.root}/sums/left-behind"
    )
    assert totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_token_counts_of_awkward_texts(spark):
    encoder = tc._encoder(tc.TOKENIZERS, tc.VERSION)
    texts = [*AWKWARD, "word " * 40_000, "x" * 70_000, "a  b   c\n\n d" * 9_000]
    rows = documents(spark, texts).select("doc_id", tc.token_count("text").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {i: len(encoder.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_query_equals_a_recount(spark, sf_dir):
    encoder = tc._encoder(tc.TOKENIZERS, tc.VERSION)
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    seen, expected = set(), {}
    for r in docs:
        if r.text in seen:
            continue
        seen.add(r.text)
        lines = list(dict.fromkeys(r.text.split("\n")))
        held = expected.setdefault((r.source, r.lang, tc.VERSION), Counter())
        held["docs"] += 1
        held["tokens"] += len(encoder.encode_ordinary("\n".join(lines)))
    found = {(r.source, r.lang, r.tokenizer): {"docs": r.docs, "tokens": r.tokens} for r in tc.query(spark, sf_dir).collect()}
    assert found == {k: dict(v) for k, v in expected.items()}
