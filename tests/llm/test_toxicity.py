import random

import pytest

from courtside.llm import toxicity as tx
from llm.rows import AWKWARD, documents


@pytest.mark.parametrize(
    "text, words",
    [("You L0SER!", ["you", "loser"]), ("ｉｄｉｏｔ", ["idiot"]), ("іdіоt", ["idiot"]), ("st​upid", ["stupid"]), ("5cum 2021", ["scum", "2021"]),
     (None, []), ("", []), ("a_b c-d", ["a", "b", "c", "d"])],
)
def test_folding(text, words):
    assert tx.folded_words(text) == words


def test_exceptions_and_weights():
    lexicon = tx.Lexicon({" trash ": 3.0, " loser ": 2.0, " lose": 1.0}, ("trash can",))
    matcher = tx.Matcher(lexicon)
    assert sorted(w for _, w in matcher.hits("the trash can is trash loser losers".split())) == [1.0, 2.0, 3.0]
    assert matcher.hits([]) == [] and tx.Matcher(tx.Lexicon()).hits(["x"]) == []
    short, long = (matcher.evidence(["loser"] + ["w"] * n) for n in (3, 300))
    assert short[0] == long[0] and short[1] > long[1]


def labelled(spark, rng, count):
    bad = ["loser", "idiot", "scum", "pathetic"]
    texts, toxic = [], []
    for i in range(count):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 80))]
        if i % 4 == 0:
            for _ in range(2):
                word = rng.choice(bad)
                words.insert(rng.randrange(len(words)), word.replace("o", "0") if rng.random() < 0.3 else word.upper())
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    docs = documents(spark, texts)
    return docs, spark.createDataFrame([(i, t, "text") for i, t in enumerate(toxic)], "doc_id bigint, toxic int, text string"), toxic


def test_learns_and_holds_on_rows_kept_out(spark):
    docs, labels, toxic = labelled(spark, random.Random(5), 400)
    lexicon = tx.learn_lexicon(docs, labels)
    assert {" loser ", " idiot "} <= set(lexicon.entries)
    rows = docs.select("doc_id", tx.held_out(docs.doc_id).alias("h"), tx.score_column(lexicon, "text").alias("s")).collect()
    out = [r for r in rows if r.h]
    assert 40 < len(out) < 120 and all((r.s >= 0.5) == (toxic[r.doc_id] == 1) for r in out)
    # A row kept out teaches nothing.
    kept_out = [r.doc_id for r in out]
    flipped = labels.where(~labels.doc_id.isin(kept_out)).unionByName(
        labels.where(labels.doc_id.isin(kept_out)).selectExpr("doc_id", "1 - toxic as toxic", "text")
    )
    assert tx.learn_lexicon(docs, flipped) == lexicon


def test_awkward_rows_and_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = documents(spark, AWKWARD)
    lexicon = tx.learn_lexicon(docs, none)
    scores = [r[0] for r in docs.select(tx.score_column(lexicon, "text")).collect()]
    assert lexicon == tx.Lexicon() and scores == [0.0] * len(AWKWARD)
    trained = tx.Lexicon({" one ": 4.0}, (), (-3.0, 2.0, 0.5))
    scores = [r[0] for r in docs.select("doc_id", tx.score_column(trained, "text").alias("s")).select("s").collect()]
    assert all(0.0 <= s <= 1.0 for s in scores) and scores[3] > 0.5 > scores[0] == scores[1]


def test_held_out_rates_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = tx.query(spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == label] for label in (1, 0))
    # Measured: 84 of 97; none of the 13 others holds any entry of the lexicon.
    assert len(toxic) > 50 and sum(toxic) / len(toxic) >= 0.85
    assert len(clean) > 500 and sum(clean) / len(clean) <= 0.01


def brute_hits(lexicon, words):
    """Every entry tried at every place of the line of words."""
    line = f" {' '.join(words)} "
    free = [(i, i + len(p) + 1) for p in lexicon.exceptions for i in range(len(line)) if line.startswith(f" {p} ", i)]
    found = {}
    for i in range(len(line)):
        weights = [w for entry, w in lexicon.entries.items() if line.startswith(entry, i) and w > 0]
        if weights and not any(low <= i < high for low, high in free):
            found[i] = max(weights)
    return sorted(found.items())


def test_hits_equal_a_plain_scan():
    rng = random.Random(7)
    lexicon = tx.Lexicon({" trash ": 3.0, " loser ": 2.0, " lose": 1.0, " can ": 1.5, " tra": 0.5}, ("trash can", "can loser", "loser"))
    vocabulary = ["trash", "can", "loser", "losers", "losing", "tram", "x"]
    for _ in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))]
        assert sorted(tx.Matcher(lexicon).hits(words)) == brute_hits(lexicon, words)


def test_lexicon_does_not_depend_on_the_order_or_on_repeated_ids(spark):
    docs, labels, _ = labelled(spark, random.Random(6), 200)
    more = docs.unionByName(docs.limit(40).withColumn("text", docs.text.substr(1, 30)))
    both = labels.unionByName(labels.limit(20).selectExpr("doc_id", "1 - toxic as toxic", "text"))
    turned = [rows.orderBy("doc_id", ascending=False).repartition(3) for rows in (more, both)]
    assert tx.learn_lexicon(more, both) == tx.learn_lexicon(*turned)
