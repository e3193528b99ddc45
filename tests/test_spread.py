import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperloom.plans import spread

RANDOM = random.Random(3)
# Key 0 and the null key hold most rows; positions have gaps.
ROWS = [
    (key, position, RANDOM.randint(0, 3), RANDOM.choice("xy"))
    for key, count in ((0, 400), (None, 200), (1, 5), (2, 1))
    for position in RANDOM.sample(range(2000), count)
]
SCHEMA = "key long, position long, value int, label string"


def by_key():
    groups = {}
    for row in sorted(ROWS, key=lambda row: row[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_running_sum(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for width in (1, 7, 100, 100_000):
        summed = spread.running_sum(
            frame, ["key"], spread.by_number(F.col("position"), width), ["position"], F.col("value"), "total"
        )
        found = {(row.key, row.position): row.total for row in summed.collect()}
        expected = {}
        for key, rows in by_key().items():
            total = 0
            for row in rows:
                total += row[2]
                expected[key, row[1]] = total
        assert found == expected


def test_next_row(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for width in (1, 7, 100, 100_000):
        followed = spread.next_row(
            frame,
            ["key"],
            spread.by_number(F.col("position"), width),
            ["position"],
            ["position", "label"],
            "next",
        )
        found = {(row.key, row.position): row.next for row in followed.collect()}
        assert len(found) == len(ROWS)
        for key, rows in by_key().items():
            for row, after in zip(rows, [*rows[1:], None]):
                got = found[key, row[1]]
                assert (got and tuple(got)) == (after and (after[1], after[3]))


def test_by_hour_does_not_decrease(spark):
    start = datetime(2024, 3, 30, 22)
    moments = [(i, start + timedelta(minutes=13 * i)) for i in range(300)]
    for kind in ("timestamp", "timestamp_ntz"):
        frame = spark.createDataFrame(moments, f"i int, at {kind}")
        hours = [r[0] for r in frame.orderBy("i").select(spread.by_hour(F.col("at"))).collect()]
        assert hours == sorted(hours) and len(set(hours)) > 60


def test_negative_positions_share_the_first_segment(spark):
    frame = spark.createDataFrame([(-5,), (-1,), (0,), (9,), (10,)], "p long")
    found = [r[0] for r in frame.orderBy("p").select(spread.by_number(F.col("p"), 10)).collect()]
    assert found == [0, 0, 0, 0, 1]


def test_input_partitioned_by_key_is_spread_again(spark, plan):
    """Both sides of the union then share a partitioning, which must not be kept."""
    frame = spark.createDataFrame([("hot", i) for i in range(40)], "key string, position long")
    wanted = spark.createDataFrame([("hot",)], "key string")
    by_key = frame.join(wanted.distinct(), "key", "left_semi").distinct()
    summed = spread.running_sum(
        by_key, ["key"], spread.by_number(F.col("position"), 5), ["position"], F.lit(1), "total"
    )
    assert "REPARTITION_BY_COL" in plan(summed)
    assert sorted((r.position, r.total) for r in summed.collect()) == [(i, i + 1) for i in range(40)]
    followed = spread.next_row(
        by_key, ["key"], spread.by_number(F.col("position"), 5), ["position"], ["position"], "next"
    )
    found = {r.position: r.next and r.next.position for r in followed.collect()}
    assert found == {i: i + 1 if i < 39 else None for i in range(40)}
