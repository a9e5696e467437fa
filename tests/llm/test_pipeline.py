"""The pipeline against its stages done by brute force, on the smallest tables and on awkward rows."""

import corpus_pipeline
from courtside.llm import pieces, quality
from courtside.llm.queries import QUERIES, SQL
from courtside.llm.shared import source
from llm.rows import AWKWARD, documents
from llm.test_decontam import plain as plain_matches
from llm.test_linededup import expected as plain_lines
from llm.test_simhash import plain_components, plain_fingerprint


def test_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(QUERIES)
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_stages_equal_brute_force(spark, sf_dir):
    docs = source(spark, sf_dir, "documents")
    rules = quality.learn_rules(docs, source(spark, sf_dir, "labels"))
    kept = {r.doc_id for r in quality.judge(docs, rules).where("_judged.kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    ids = sorted(texts)
    texts = dict(zip(ids, plain_lines([texts[i] for i in ids])))
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    roots = plain_components(set(prints.values()))
    first = {}
    for i in ids:
        first.setdefault(roots[prints[i]], i)
    ids = sorted(first.values())
    items = [(r.item_id, r.text) for r in source(spark, sf_dir, "benchmark").collect()]
    clean = [i for i, (n, hit, _) in zip(ids, plain_matches([texts[i] for i in ids], items)) if not (hit and 20 * len(hit) >= n)]
    vocabulary = pieces.Pieces.load()
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(found) == clean
    assert all(pieces.decode(found[i].ids, vocabulary) == texts[i] for i in clean)


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    docs = documents(spark, AWKWARD)
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as bigint) doc_id", *docs.columns[1:]))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, sf_dir).columns == docs.columns, name
            stage(spark, rows, sf_dir).collect()
        corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()


def test_extra_columns_that_bear_inner_names_pass_every_stage(spark, sf_dir):
    names = ["_kept_id", "_kept_hash", "_row_hash", "_gone", "_gone_id", "_gone_hash", "_lines_removed", "_bad_id", "_bad_hash", "_judged"]
    texts = [*AWKWARD, "one line\nanother line here\none line", "another line here"]
    docs = documents(spark, texts).selectExpr("*", *[f"concat('{name}', doc_id) AS {name}" for name in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns, name
        assert all(row[column] == f"{column}{row.doc_id}" for row in found.collect() for column in names), name
