import random
from collections import defaultdict
from datetime import datetime, timedelta

from courtside.operators.ordered import counter_increase, running_count, running_sum

START = datetime(2024, 1, 1)


def skewed(n=4000, seed=3):
    """Half of all rows belong to one series; times span several days and repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        series = "hot" if rng.random() < 0.5 else f"s{rng.randrange(5)}"
        rows.append((series, START + timedelta(minutes=rng.randrange(6000)), i))
    return rows


def test_running_count_of_a_hot_series(spark):
    rows = skewed()
    frame = spark.createDataFrame(rows, "series string, ts timestamp_ntz, id bigint").repartition(6)
    found = {r.id: r.n for r in running_count(frame, ["series"], ["ts", "id"], "n").collect()}
    expected, seen = {}, defaultdict(int)
    for series, _, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[series] += 1
        expected[i] = seen[series]
    assert found == expected


def test_running_sum_over_days(spark):
    rows = {(s, t): i % 9 for s, t, i in skewed()}
    flat = [(s, t, v) for (s, t), v in rows.items()]
    frame = spark.createDataFrame(flat, "series string, ts timestamp_ntz, v bigint")
    found = {(r.series, r.ts): r.total for r in running_sum(frame, ["series"], "ts", "v", "total").collect()}
    expected, total = {}, defaultdict(int)
    for s, t, v in sorted(flat):
        total[s] += v
        expected[(s, t)] = total[s]
    assert found == expected


def test_counter_increase_with_resets(spark):
    rng, rows, expected = random.Random(9), [], {}
    for series in ("a", "b", "c"):
        value, previous, gained = 0, None, 0
        for step in range(300):
            value = 0 if rng.random() < 0.05 else value + rng.randrange(4)
            if rng.random() < 0.2:
                continue
            rows.append((series, START + timedelta(hours=step), value))
            if previous is not None:
                gained += value - previous if value >= previous else value
            previous = value
        expected[series] = gained
    rows.append(("single", START, 42))
    expected["single"] = 0
    frame = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value bigint")
    assert {r.series: r.increase for r in counter_increase(frame, ["series"]).collect()} == expected
