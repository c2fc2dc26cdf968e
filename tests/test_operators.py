import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logs import activity, row, values
from scanlytics.functions.enrich import enrich
from scanlytics.operators import cube as K
from scanlytics.operators.filters import (
    filter_projects,
    filter_years,
    page,
    page_after,
    project_retention,
    retention,
    slice_metrics,
    slice_of,
)
from scanlytics.operators.groups import projects_in_group
from scanlytics.operators.quantiles import exact_quantiles, with_code
from scanlytics.operators.ranking import row_positions, stride_sample, top_k
from scanlytics.plans import totals


@pytest.mark.parametrize("n", [1, 99, 100, 101, 199, 200, 250])
def test_stride_sample(spark, n):
    series = spark.range(n).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour_ts"),
        "id",
    )
    got = [r.id for r in stride_sample(series, [], 100).orderBy("id").collect()]
    assert got == list(range(0, n, n // 100 if n > 100 else 1))


def test_stride_sample_keeps_forced_points(spark):
    series = spark.range(1500).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour_ts"),
        F.when(F.col("id") == 700, 99).otherwise(1).alias("sph"),
        "id",
    )
    got = [r.id for r in stride_sample(series, [], 500, keep=F.col("sph") >= 60).orderBy("id").collect()]
    assert got == sorted({*range(0, 1500, 3), 700})


def test_row_positions(spark):
    rows = [(f"f{i % 3}", i * 7919 % 100_003) for i in range(5000)]
    df = spark.createDataFrame(rows, "f string, id bigint")
    got = row_positions(df, ["f"], "id", F.floor(F.col("id") / 1000)).toPandas()
    want = pd.DataFrame(rows, columns=["f", "id"])
    want["row_no"] = want.groupby("f")["id"].rank().astype(int) - 1
    merged = got.merge(want, on=["f", "id"])
    assert len(merged) == 5000 and (merged.row_no_x == merged.row_no_y).all()


def test_top_k_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("d", 5), ("b", 7), ("c", 5), ("a", 3)], "name string, n int")
    got = top_k(df, [], [F.desc("n"), F.asc("name")], 2).orderBy("rank").collect()
    assert [(r.name, r["rank"]) for r in got] == [("b", 1), ("c", 2)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.one_of(st.integers(-5, 5), st.integers(-(10**12), 10**12), st.none())),
        min_size=1,
        max_size=60,
    )
)
def test_quantiles_match_pandas(spark, rows):
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {(r.k, r.fraction): r.quantile for r in exact_quantiles(df, ["k"], "v", [0.25, 0.5, 0.75]).collect()}
    frame = pd.DataFrame(rows, columns=["k", "v"]).dropna().astype({"v": "float64"})
    want = frame.groupby("k").v.quantile([0.25, 0.5, 0.75]).to_dict() if len(frame) else {}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-12, abs=1e-9)


def test_quantiles_on_skewed_group(spark):
    rng = random.Random(1)
    data = [("hot", rng.randrange(1000, 1010) if i % 3 else rng.randrange(10**9)) for i in range(20_000)]
    df = spark.createDataFrame(data + [("cold", 4)], "k string, v bigint")
    got = {(r.k, r.fraction): r.quantile for r in exact_quantiles(df, ["k"], "v", [0.25, 0.5, 0.75]).collect()}
    want = pd.DataFrame(data + [("cold", 4)], columns=["k", "v"]).groupby("k").v.quantile([0.25, 0.5, 0.75]).to_dict()
    assert got == want


def test_codes_are_the_bits_of_doubles(spark):
    import struct

    rng = random.Random(9)
    edges = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    edges += [sign * 2.0**e * (1 + d) for e in range(-1070, 1024, 7) for d in (-1.1e-16, 0, 2.3e-16, 0.5) for sign in (1, -1)]
    edges += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    edges = [v for v in edges if v == v]
    table = spark.createDataFrame([(v,) for v in edges], "v double")
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert all(r.code == bits(r.v) for r in with_code(table, "v", "code").collect())
    nan = with_code(spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double"), "v", "code").collect()
    assert nan[0].code > nan[1].code


def test_quantiles_with_one_value_far_out(spark):
    """A million close values and one far away: no window sees more than the cells of one prefix."""
    close = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.lit(1e9) + F.col("id") / 1e4).alias("v"))
    rows = close.unionByName(spark.createDataFrame([("g", 1e300), ("g", -1e300)], "g string, v double"))
    got = {r.fraction: r.quantile for r in exact_quantiles(rows, ["g"], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    whole = sorted([-1e300, 1e300, *[1e9 + i / 1e4 for i in range(1_000_000)]])
    assert got[0.0] == -1e300 and got[1.0] == 1e300 and got[0.5] == (whole[500_000] + whole[500_001]) / 2
    place = 0.25 * (len(whole) - 1)
    low = int(place)
    assert got[0.25] == whole[low] + (whole[low + 1] - whole[low]) * (place - low)
    cells = with_code(close, "v", "c")
    for digits in (16, 32, 48):
        parents = cells.groupBy(F.shiftright("c", digits).alias("p"), F.shiftright("c", digits - 16).alias("k")).count().groupBy("p").count()
        assert parents.agg(F.max("count")).first()[0] <= 65_536


def test_quantiles_of_close_values_far_from_zero(spark):
    """They share the first bits of their codes; the last passes tell them apart."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") + 10**12).alias("v"))
    got = {r.fraction: r.quantile for r in exact_quantiles(df, ["k"], "v", [0.25, 0.5]).collect()}
    assert got == {0.25: 10**12 + 49_999.75, 0.5: 10**12 + 99_999.5}


TREE = [
    ("bu", None, "Business Unit A", False),
    ("t1", "bu", "Team 1", False), ("a", "t1", "Project A", True), ("b", "t1", "Project B", True),
    ("t2", "bu", "Team 2", False), ("s", "t2", "Subteam 2.1", False), ("c", "s", "Project C", True),
    ("d", "t2", "Project D", True), ("e", "bu", "Project E", True), ("e2", "s", "Project E", True),
    ("o", None, "Other", False), ("x", "o", "Project X", True),
]


def closure(spark, tree, group, **how):
    df = spark.createDataFrame(tree, "id string, pid string, name string, isProject boolean")
    return sorted(r.projectName for r in projects_in_group(df, group, **how).collect())


def test_group_includes_nested_projects_once(spark):
    assert closure(spark, TREE, "Business Unit A") == [f"Project {x}" for x in "ABCDE"]
    assert closure(spark, TREE, "Team 2") == ["Project C", "Project D", "Project E"]
    assert closure(spark, TREE, "Team", contains=True) == [f"Project {x}" for x in "ABCDE"]
    assert closure(spark, TREE, "Nobody") == []


def test_deep_groups_take_few_jobs(spark):
    chain = [(f"g{i}", f"g{i - 1}" if i else None, f"G{i}", False) for i in range(12)] + [("p", "g11", "Deep", True)]
    spark.sparkContext.setJobGroup("closure", "closure")
    try:
        assert closure(spark, chain, "G0") == ["Deep"]
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("closure")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 12 * 6


def test_group_with_a_cycle_ends(spark):
    assert closure(spark, [*TREE, ("bu", "s", "Business Unit A", False)], "Team 2") == [f"Project {x}" for x in "ABCDE"]


def test_year_filter_keeps_null_years_only_without_bounds(spark):
    a = activity(spark, [row(hour="2022-12-31 23"), row(hour="2023-01-01 00"), row(hour="2024-06-01 05"), row(hour=None)])
    assert filter_years(a).count() == 4
    assert filter_years(a, 2023).count() == 2
    assert filter_years(a, None, 2022).count() == 1
    assert filter_years(a, 2023, 2023).count() == 1


def test_project_filter(spark):
    a = activity(spark, [row(project="x"), row(project="y"), row(project=None)])
    only = spark.createDataFrame([("x",), ("x",), ("zz",)], "projectName string")
    assert values(filter_projects(a, only), "projectName") == [("x",)]
    assert filter_projects(a, only.where("false")).count() == 0


def test_project_filter_keeps_files_without_the_column(spark):
    rows = [(["projectName", "hour"], "x"), (["projectName", "hour"], "y"), (["hour"], None), (["projectName"], None)]
    df = enrich(spark.createDataFrame(rows, "header array<string>, projectName string"))
    only = spark.createDataFrame([("x",)], "projectName string")
    assert filter_projects(df, only).count() == 2
    assert filter_projects(df, only.where("false")).count() == 0
    assert tuple(project_retention(df, only).first()) == (4, 2, 50.0)
    assert tuple(project_retention(df, only.where("false")).first()) == (4, 0, 0.0)


def test_retention(spark):
    df = spark.range(8)
    assert tuple(retention(df, F.col("id") < 3).first()) == (8, 3, 37.5)


def test_slices_pick_one_grain(spark):
    a = activity(spark, [row("a.csv", "2023-01-01 00", "x", 2), row("b.csv", "2024-01-01 00", "x", 3)])
    table = totals.totals_by_grain(a)
    scans = lambda **c: values(slice_metrics(table, **c), "total_scans")
    assert scans() == [(5,)]
    assert scans(file="a.csv") == [(2,)]
    assert scans(year=2024) == [(3,)]
    assert scans(project="x") == [(5,)]
    assert scans(file="b.csv", year=2024, project="x") == [(3,)]
    assert scans(file="b.csv", year=2023) == []


def test_pages_cover_everything_once(spark):
    df = spark.range(25)
    got = [r.id for n in range(4) for r in page(df, [F.asc("id")], n, 10).collect()]
    assert got == list(range(25))


@pytest.mark.parametrize("order", [[("n", True), ("k", False)], [("k", True)], [("n", False), ("k", True)]])
def test_seek_pages_are_the_sorted_table(spark, order):
    rows = [(i * 7 % 50, None if i % 11 == 0 else i % 4) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, n int")
    whole = [tuple(r) for r in df.orderBy(*[F.desc(c) if falling else F.asc(c) for c, falling in order]).collect()]
    got, after = [], None
    while page_rows := page_after(df, order, after, 8).collect():
        got += [tuple(r) for r in page_rows]
        after = [page_rows[-1][c] for c, _ in order]
    assert got == whole
    plan = page_after(df, order, after, 8)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "offset" not in plan.lower()


def test_slice_computes_one_grain(spark):
    a = activity(spark, [row(), row(file="b.csv", project="q", scans=3), row(hour="2023-01-01 00", scans=5)])
    for choice in ({}, {"file": "b.csv"}, {"year": 2024}, {"file": "a.csv", "year": 2023, "project": "p"}, {"project": "none"}):
        want = slice_metrics(totals.totals_by_grain(a), **choice)
        if choice.get("project") != "none":
            assert slice_of(totals.totals_by_grain, a, **choice).exceptAll(want).isEmpty() and not want.isEmpty()
        got = slice_of(totals.totals_by_grain, a, **choice)
        assert got.count() == want.count()
    plan = slice_of(totals.totals_by_grain, a, file="a.csv", year=2024)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[source_file") >= 1 and len([x for x in plan.splitlines() if "Expand" in x and x.count("null,") > 0]) == 0


def test_name_index(spark, tmp_path):
    from scanlytics.operators.name_index import build_name_index, search_names

    names = ["Alpha", "alphabet", "beta", "x", "", "ÄLPHA", "per%cent_", "aaaa", "a" * 60, "Alpha"]
    build_name_index(activity(spark, [row(project=n) for n in names] + [row(project=None)]), str(tmp_path))
    for text in ("a", "AL", "alp", "lpha", "ph", "%c", "_", "aaaaa", "a" * 40, "a" * 61, "zzz", "ä", "x", "pha alpha"):
        want = sorted({n for n in names if text.lower() in n.lower()})
        assert values(search_names(spark, str(tmp_path), text), "projectName") == [(n,) for n in want], text
    assert search_names(spark, str(tmp_path), "").count() == len(set(names))
    plan = search_names(spark, str(tmp_path), "lpha")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan


def test_chain_of_a_thousand_groups_takes_few_rounds(spark):
    chain = [(f"g{i}", f"g{i - 1}" if i else None, f"G{i}", False) for i in range(1000)]
    chain += [(f"p{i}", f"g{i}", f"P{i}", True) for i in (0, 1, 499, 999)] + [("side", "g3", "Side", False), ("q", "side", "Q", True)]
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        assert closure(spark, chain, "G0") == ["P0", "P1", "P499", "P999", "Q"]
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 12 * 12
    assert closure(spark, chain, "G4") == ["P499", "P999"]


def test_groups_with_many_parents_and_cycles(spark):
    rng = random.Random(4)
    for count in (5, 12, 25):
        links = [(f"g{i}", f"g{rng.randrange(count)}", f"G{i}", False) for i in range(count) for _ in range(rng.choice([1, 1, 2]))]
        projects = [(f"p{i}", f"g{i}", f"P{i:02d}", True) for i in range(count)]
        for start in (0, 1):
            reached, todo = {f"g{start}"}, [f"g{start}"]
            while todo:
                at = todo.pop()
                more = {i for i, pid, _, _ in links if pid == at} - reached
                reached |= more
                todo += more
            assert closure(spark, links + projects, f"G{start}") == sorted(n for _, pid, n, _ in projects if pid in reached)


def test_null_keys_are_no_group_but_count_in_totals(spark):
    a = activity(spark, [row(project=None, scans=4), row(project="x", scans=2), row(project="x", scans=1, hour=None)])
    got = values(totals.totals_by_grain(a), "grain", "total_scans")
    assert ("global", 7) in got and ("project", 3) in got and ("year", 6) in got
    assert len([g for g in got if g[0] == "project"]) == 1


def test_unknown_grain_is_an_error(spark):
    with pytest.raises(ValueError):
        K.by_grains(spark.range(1), ["galaxy"], [F.count(F.lit(1)).alias("n")])
