import pytest
from pyspark.sql import functions as F

from scanlytics.functions import columns as C
from scanlytics.plans.capacity import thresholds
from scanlytics.schema import BLOCK_STARTS, block_label


def one(spark, **named):
    return spark.range(1).select(*[c.alias(n) for n, c in named.items()]).first()


@pytest.mark.parametrize(
    "state, won, lost",
    [
        ("completed", True, False), ("Success", True, False), ("COMPLETE", True, False),
        ("error", False, True), ("failed", False, True), ("Failure", False, True), ("cancelled", False, True),
        ("IN_PROGRESS", False, False), (None, False, False),
    ],
)
def test_states(spark, state, won, lost):
    col = F.lit(state).cast("string")
    assert tuple(one(spark, a=C.is_success(col), b=C.is_failure(col))) == (won, lost)


@pytest.mark.parametrize(
    "kind, expected", [("SNIPPET", True), ("snippet_scan", True), ("SIGNATURE", False), (None, False)]
)
def test_snippet(spark, kind, expected):
    assert one(spark, a=C.is_snippet(F.lit(kind).cast("string"))).a is expected


@pytest.mark.parametrize("part, whole, expected", [(1, 16, 6.3), (1, 8, 12.5), (1, 3, 33.3), (2, 3, 66.7), (0, 5, 0.0), (7, 7, 100.0), (1, 0, None)])
def test_percent(spark, part, whole, expected):
    assert one(spark, a=C.percent(F.lit(part).cast("bigint"), F.lit(whole).cast("bigint"))).a == expected


def test_blocks(spark):
    hours = spark.sql("select make_timestamp_ntz(2024, 1, 1, cast(id as int), 0, 0) ts from range(24)")
    start = C.block_start(F.col("ts"))
    rows = hours.select(F.hour("ts"), start, C.block_order(start), C.block_name(start)).collect()
    for hour, begin, order, name in rows:
        assert begin <= hour < begin + 3
        assert BLOCK_STARTS[order] == begin
        assert name == block_label(begin)
    assert [block_label(s) for s in BLOCK_STARTS] == [
        "06-09", "09-12", "12-15", "15-18", "18-21", "21-00", "00-03", "03-06",
    ]


def test_parse_hour(spark):
    texts = ["2024-03-10 02:00:00", "2024-03-10T02:00:00Z", "10/03/2024 02:00", "junk", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    parsed = C.parse_hour(F.col("h"), ["dd/MM/yyyy HH:mm"])
    got = [r[0] for r in df.select(C.iso_hour(parsed)).collect()]
    assert got == ["2024-03-10 02:00:00"] * 3 + [None] * 3


def test_hours_are_whole_dates_with_offsets(spark):
    texts = ["12345", "2024", "2024-03", "2024-03-10", "2024-03-10T02:30:00+02:00", "2024-03-10 22:15:00.5-0330", "2024-03-10 02", "2024-13-10 00:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(C.iso_hour(C.parse_hour(F.col("h")))).collect()]
    assert got == [None, None, None, "2024-03-10 00:00:00", "2024-03-10 00:30:00", "2024-03-11 01:45:00", "2024-03-10 02:00:00", None]


@pytest.mark.parametrize("text, whole", [("3", True), ("3.0", True), ("3.7", False), ("x", False), (None, False)])
def test_is_whole(spark, text, whole):
    assert one(spark, a=C.is_whole(F.lit(text).cast("string"))).a is whole


def test_floor_hour_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        # 02:30 does not exist there on this day
        ts = F.lit("2024-03-10 02:30:15").cast("timestamp_ntz")
        assert one(spark, a=C.iso_hour(C.floor_hour(ts))).a == "2024-03-10 02:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("text, number", [("3", 3), ("3.0", 3), ("x", None), ("", None), (None, None)])
def test_whole_number(spark, text, number):
    assert one(spark, a=C.whole_number(F.lit(text).cast("string"))).a == number


def test_safe_name(spark):
    assert one(spark, a=C.safe_name(F.lit("Team 1/Ü-x_y.z"))).a == "Team_1_Ü-x_y_z"


@pytest.mark.parametrize(
    "capacity, pct, expected",
    [(60, 80, (48, 48)), (60, 100, (None, 60)), (60, 150, (None, 60)), (None, 80, (None, None)), (7, 50, (3, 3))],
)
def test_thresholds(capacity, pct, expected):
    assert thresholds(capacity, pct) == expected


@pytest.mark.parametrize("pct, colour", [(50.0, "red"), (49.9, "amber"), (25.0, "amber"), (24.9, "green"), (None, "none")])
def test_snippet_severity(spark, pct, colour):
    assert one(spark, a=C.snippet_severity(F.lit(pct).cast("double"))).a == colour
