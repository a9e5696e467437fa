"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters are trained from labelled samples: random strings
(the values of the base patterns) and ordinary identifiers (words long enough to be one, of which no
secret is known). A candidate is a run of token characters; it is reported when, per step, the
random model explains it better than the ordinary one by a margin. Of a run that is not, such as a
name or path joined to a secret, the stretches of whole parts between ``+ / _ = -`` that score best are
reported if they are long enough and above the margin themselves. All of it is built-in functions.

Defined cases: null text has no spans; without random or without ordinary samples no candidate is
reported and the base spans stay; of a run that overlaps base spans what lies outside them is judged;
repeated rows are judged alike and count as samples again; ties cannot occur, since spans of one kind
never overlap; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtside.llm.shared import source
from courtside.workspace import staged

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_CANDIDATE = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
LETTER = r"[A-Za-z]"
# Signs of a candidate that stand in no ordinary word.
CUTTING = "+/="
# What joins the parts of a run; stretches begin and end at parts.
JOINS = r"[+/_=-]"
# Ordinary identifiers: words without a known secret in them.
ORDINARY = r"[A-Za-z0-9_-]{6,}"
# Labelled words per class, and documents they come from, that the models are trained on, at most.
SAMPLE_WORDS = 50_000
SAMPLE_DOCS = 4_000
# Mean log-likelihood ratio a step, above which a candidate counts as random.
MARGIN = 0.25
BACKING = 5.0
# A stretch ends where its score has fallen this far below its best, so that a later secret starts afresh.
DROP = 4.0
# Character codes the models tell apart; all others are one.
CODES = 128


_NO_SPANS = "cast(array() as array<struct<start:int,end:int>>)"
_NO_PIECES = "cast(array() as array<struct<start:int,end:int,word:string>>)"
# Items that are gathered before their results are laid aside, so that no array grows item by item.
BLOCK = 512


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scanned(
    items: Column, carry: Column, nothing: Column, advance: Callable[[Column, Column], tuple[Column, Column]]
) -> Column:
    """(carry, out): walks an array from left to right, and gathers the arrays that ``advance(carry, item)`` gives beside
    the next carry. Takes time in proportion to the array."""

    def step(state: Column, item: Column) -> Column:
        after, given = advance(state["carry"], item)
        return F.struct(after.alias("carry"), F.concat(state["out"], given).alias("out"))

    def walk(held: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.greatest(F.size(held), F.lit(1)) - 1) / BLOCK).cast("int")),
            lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK)),
        )

        def block(state: Column, part: Column) -> Column:
            inside = F.aggregate(part, F.struct(state["carry"].alias("carry"), nothing.alias("out")), step)
            return _held(
                inside, lambda x: F.struct(x["carry"].alias("carry"), F.concat(state["outs"], F.array(x["out"])).alias("outs"))
            )

        start = F.struct(carry.alias("carry"), F.array(nothing).alias("outs"))
        return F.aggregate(
            blocks, start, block, lambda s: F.struct(s["carry"].alias("carry"), F.flatten(s["outs"]).alias("out"))
        )

    return _held(items, walk)


def _ends(text: Column, pattern: str, found: Column) -> Column:
    """(start, end) of each match, from the lengths of the matches and of what lies between them."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.zip_with(gaps, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size")))

    def advance(at: Column, step: Column) -> tuple[Column, Column]:
        begin = at + step["gap"]
        end = begin + step["size"]
        return end, F.array(F.struct(begin.alias("start"), end.alias("end")))

    return _scanned(steps, F.lit(0), F.expr(_NO_SPANS), advance)["out"]


def matches_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pattern_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end>>, in code points."""
    found = matches_of(text, pattern)
    return F.when(F.size(found) > 0, _ends(text, pattern, found)).otherwise(F.expr(_NO_SPANS))


def assign_spans(text: Column) -> Column:
    """Spans of assignments whose value is long enough; shorter ones still use up their text."""
    found = matches_of(text, ASSIGN)
    sizes = F.transform(found, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)))
    paired = F.zip_with(_ends(text, ASSIGN, found), sizes, lambda span, size: F.struct(span.alias("span"), size.alias("size")))
    kept = F.transform(F.filter(paired, lambda x: x["size"] >= LEAST_ASSIGN), lambda x: x["span"])
    return F.when(F.size(found) > 0, kept).otherwise(F.expr(_NO_SPANS))


def base_spans(text: Column) -> Column:
    """Every base span as array<struct<start, kind, end>>, ordered by start and kind."""

    def of(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.array_sort(
        F.concat(of(0, assign_spans(text)), of(1, pattern_spans(text, ACCESS)), of(2, pattern_spans(text, HEX)))
    )


def with_base_spans(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_base", base_spans(F.coalesce("text", F.lit(""))))


def labelled_words(docs: DataFrame, most: int = SAMPLE_WORDS, most_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(word, random): at most ``most`` distinct words a class, drawn by a hash of the word.

    Random strings are the base values of all documents; ordinary identifiers are the words of
    at most ``most_docs`` documents, drawn by a hash of id and text.
    """
    text = F.coalesce("text", F.lit(""))
    values = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= LEAST_ASSIGN),
        matches_of(text, ACCESS),
        matches_of(text, HEX),
    )
    # Runs of digits alone are numbers as often as secrets.
    random = docs.select(F.explode(values).alias("word")).where(F.col("word").rlike(LETTER))
    # Only hashes are ranked; at most most_docs of them are broadcast.
    place = F.xxhash64("doc_id", "text")
    picked = docs.select(place.alias("_picked")).distinct().orderBy("_picked").limit(most_docs)
    some = docs.select("text", place.alias("_place")).join(F.broadcast(picked), F.col("_place") == F.col("_picked"), "left_semi")
    # Words with digits may be secrets that are not known yet.
    rest = text
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = some.select(F.explode(matches_of(rest, ORDINARY)).alias("word")).where(~F.col("word").rlike("[0-9]"))

    def drawn(words: DataFrame, label: int) -> DataFrame:
        distinct = words.groupBy("word").agg(F.lit(label).alias("random"))
        return distinct.orderBy(F.xxhash64("word"), "word").limit(most)

    return drawn(random, 1).unionByName(drawn(ordinary, 0))


def _code(char: Column) -> Column:
    code = F.ascii(char)
    return F.when(code.between(1, CODES - 1), code).otherwise(F.lit(0))


def log_ratios(words: DataFrame) -> DataFrame:
    """One row with ``ratio``: by 128 * previous + next character, log P(random) - log P(ordinary).

    A step's probability is its count drawn towards the next character's own share by BACKING counts,
    so a step neither model has seen is judged by the characters in it. At most CODES * CODES numbers.
    """
    steps = words.select(
        "random",
        F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"),
        "word",
    ).select(
        "random",
        _code(F.substring(F.col("word"), F.col("i"), F.lit(1))).alias("a"),
        _code(F.substring(F.col("word"), F.col("i") + 1, F.lit(1))).alias("b"),
    )
    counts = steps.groupBy("a", "b").agg(
        F.count_if(F.col("random") == 1).alias("r"), F.count_if(F.col("random") == 0).alias("o")
    )
    codes = counts.sparkSession.range(CODES)
    grid = codes.select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(CODES - 1))).alias("b"))
    rows = counts.groupBy("a").agg(F.sum("r").alias("row_r"), F.sum("o").alias("row_o"))
    shares = counts.groupBy("b").agg(F.sum("r").alias("col_r"), F.sum("o").alias("col_o"))
    both = counts.agg(F.struct(F.sum("r").alias("r"), F.sum("o").alias("o"))).scalar()
    cells = grid.join(counts, ["a", "b"], "left").join(rows, "a", "left").join(shares, "b", "left").fillna(0)

    def log_p(kind: str) -> Column:
        share = (F.col(f"col_{kind}") + 0.5) / (F.coalesce(both[kind], F.lit(0)) + 0.5 * CODES / 2)
        return F.log((F.col(kind) + BACKING * share) / (F.col(f"row_{kind}") + BACKING))

    # Signs that ordinary words are cut at are no evidence either way.
    cutting = [ord(sign) for sign in CUTTING]
    silent = F.col("a").isin(cutting) | F.col("b").isin(cutting)
    cells = cells.withColumn("ratio", F.when(silent, F.lit(0.0)).otherwise(log_p("r") - log_p("o")))
    # A model without samples says nothing.
    trained = counts.agg((F.sum("r") > 0).alias("has_r"), (F.sum("o") > 0).alias("has_o"))
    table = cells.groupBy().agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((F.col("a") * CODES + F.col("b")).alias("k"), F.col("ratio").alias("v")))), lambda x: x["v"]
        ).alias("ratio")
    )
    usable = trained.select(F.coalesce(F.col("has_r") & F.col("has_o"), F.lit(False))).scalar()
    return table.select(F.when(usable, F.col("ratio")).alias("ratio"))


def randomness(word: Column, ratio: Column) -> Column:
    """Mean log-likelihood ratio over the steps of a word."""

    def mean(chars: Column) -> Column:
        total = F.aggregate(
            F.sequence(F.lit(1), F.size(chars) - 1),
            F.lit(0.0),
            lambda sum_, i: sum_ + F.get(ratio, _code(F.get(chars, i - 1)) * CODES + _code(F.get(chars, i))),
        )
        return F.when(F.size(chars) > 1, total / (F.size(chars) - 1)).otherwise(F.lit(0.0))

    return _held(F.slice(F.split(word, ""), 1, F.length(word)), mean)


def stretches(word: Column, ratio: Column, margin: float) -> Column:
    """Spans of the best-scoring stretches of whole parts, each of LEAST_CANDIDATE characters or more.

    A running maximum sum over what each step's ratio has above the margin: it starts anew at a part
    where what came before adds nothing, or has fallen DROP below its best.
    """
    chars = F.slice(F.split(word, ""), 1, F.length(word))
    # The characters and their number are worked out once a word, not once a step.
    held = F.struct(chars.alias("chars"), F.length(word).alias("n"))

    def steps_of(held: Column) -> Column:
        chars, n = held["chars"], held["n"]

        def step(i: Column) -> Column:
            here = ~F.get(chars, i).rlike(JOINS)
            score = F.when(i > 0, F.get(ratio, _code(F.get(chars, i - 1)) * CODES + _code(F.get(chars, i))) - margin)
            opens = here & F.coalesce(F.get(chars, i - 1).rlike(JOINS), F.lit(True))
            closes = here & F.coalesce(F.get(chars, i + 1).rlike(JOINS), F.lit(True))
            return F.struct(
                i.alias("at"), F.coalesce(score, F.lit(0.0)).alias("score"), opens.alias("opens"), closes.alias("closes")
            )

        return F.transform(F.sequence(F.lit(0), n - 1), step)

    steps = F.flatten(F.transform(F.array(held), steps_of))

    def emitted(state: Column) -> Column:
        span = F.struct(state["begin"].alias("start"), state["end"].alias("end"))
        return F.when(state["end"] > 0, F.array(span)).otherwise(F.expr(_NO_SPANS))

    def state_of(begin: Column, total: Column, end: Column, best: Column) -> Column:
        return F.struct(begin.alias("begin"), total.alias("total"), end.alias("end"), best.alias("best"))

    zero, nought = F.lit(0), F.lit(0.0)

    def advance(state: Column, step: Column) -> tuple[Column, Column]:
        total = state["total"] + step["score"]
        anew = step["opens"] & ((total <= 0) | ((state["end"] > 0) & (state["best"] - total > DROP)))
        better = step["closes"] & (step["at"] + 1 - state["begin"] >= LEAST_CANDIDATE) & (total > state["best"])
        after = (
            F.when(anew, state_of(step["at"], nought, zero, nought))
            .when(better, state_of(state["begin"], total, step["at"] + 1, total))
            .otherwise(state_of(state["begin"], total, state["end"], state["best"]))
        )
        return after, F.when(anew, emitted(state)).otherwise(F.expr(_NO_SPANS))

    walked = _scanned(steps, state_of(zero, nought, zero, nought), F.expr(_NO_SPANS), advance)
    return _held(walked, lambda w: F.concat(w["out"], emitted(w["carry"])))


def outside(runs: Column, words: Column, base: Column) -> Column:
    """(start, end, word): the pieces of runs that no base span covers, long enough to be candidates.

    Runs and base spans are merged by their starts and walked once. ``words`` are the runs' texts.
    """
    kinds = "array<struct<start:int,kind:int,end:int,word:string>>"
    far = F.lit(2**31 - 1)

    def event(start: Column, kind: int, end: Column, word: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), word.alias("word"))

    events = F.array_sort(
        F.concat(
            F.transform(base, lambda b: event(b["start"], 0, b["end"], F.lit(None).cast("string"))).cast(kinds),
            F.zip_with(runs, words, lambda r, w: event(r["start"], 1, r["end"], w)).cast(kinds),
            F.array(event(far, 1, far, F.lit(""))).cast(kinds),
        )
    )

    def state_of(at: Column, cover: Column, until: Column, begin: Column, word: Column) -> Column:
        return F.struct(at.alias("at"), cover.alias("cover"), until.alias("until"), begin.alias("begin"), word.alias("word"))

    def piece(state: Column, end: Column) -> Column:
        size = end - state["at"]
        word = F.substring(state["word"], state["at"] - state["begin"] + 1, size)
        found = F.struct(state["at"].alias("start"), end.alias("end"), word.alias("word"))
        return F.when(size >= LEAST_CANDIDATE, F.array(found)).otherwise(F.expr(_NO_PIECES))

    def advance(state: Column, e: Column) -> tuple[Column, Column]:
        begins = e["kind"] == 1
        after = F.when(begins, state_of(F.greatest(e["start"], state["cover"]), state["cover"], e["end"], e["start"], e["word"])).otherwise(
            state_of(
                F.greatest(state["at"], e["end"]), F.greatest(state["cover"], e["end"]), state["until"], state["begin"], state["word"]
            )
        )
        # A run ends at its own end, or a part of it where a base span begins.
        return after, piece(state, F.when(begins, state["until"]).otherwise(F.least(state["until"], e["start"])))

    zero = F.lit(0)
    return _scanned(events, state_of(zero, zero, zero, zero, F.lit("")), F.expr(_NO_PIECES), advance)["out"]


def random_spans(run: Column, word: Column, ratio: Column, margin: float) -> Column:
    """The whole run, if it is random as a whole; else its random stretches.

    What has no letter is a number, a date or a divider as often as a secret, and is not reported.
    """
    lettered = F.filter(
        stretches(word, ratio, margin), lambda s: F.substring(word, s["start"] + 1, s["end"] - s["start"]).rlike(LETTER)
    )
    shifted = F.transform(
        lettered,
        lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end")),
    )
    return (
        F.when(ratio.isNull() | ~word.rlike(LETTER), F.expr(_NO_SPANS))
        .when(randomness(word, ratio) > margin, F.array(F.struct(run["start"].alias("start"), run["end"].alias("end"))))
        .when(word.rlike(JOINS), shifted)
        .otherwise(F.expr(_NO_SPANS))
    )


def scan(docs: DataFrame, ratios: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``_base`` and ``_found``: arrays of (start, kind, end); kind 3 is the models' own."""
    text = F.coalesce("text", F.lit(""))
    # The one row of at most 16,384 numbers is broadcast.
    sized = with_base_spans(docs).withColumn("_runs", matches_of(text, CANDIDATE))
    pieces = outside(_ends(text, CANDIDATE, F.col("_runs")), F.col("_runs"), F.col("_base"))
    sized = sized.withColumn("_candidates", F.when(F.size("_runs") > 0, pieces).otherwise(F.expr(_NO_PIECES)))
    ratio = ratios.select("ratio").scalar()
    judged = sized.withColumn("_ratio", F.when(F.size("_candidates") > 0, ratio))
    random = F.flatten(F.transform("_candidates", lambda c: random_spans(c, c["word"], F.col("_ratio"), margin)))
    extra = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return judged.withColumn("_found", F.array_sort(F.concat("_base", extra))).drop("_ratio", "_candidates", "_runs")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in (*KINDS, "random")])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, log_ratios(staged(labelled_words(docs), "labelled-words")))

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)],
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.col("_found")).alias("spans"),
    )
