"""The feature engine on small tables with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempofeat.config import Settings, load_settings
from tempofeat.functions.values import NUMERIC, interval_labels, time_bin, to_double
from tempofeat.operators import hierarchy, invariant, postfilter, prefilter, temporal, value_types
from tempofeat.operators.discretize import column_profile, edges_by_column, predetermined
from tempofeat.operators.lookup import look_up, lookup
from tempofeat.operators.numbering import numbered
from tempofeat.plans.pipeline import FeaturePipeline, dense, row_labels
from tempofeat.plans.queries import QUERIES, SQL, _kept_s
from tempofeat.storage import stored, trim

SCHEMA = "ID long, t double, var string, val string, row_idx long"
HR = {1: [(0.1, 70), (0.9, 71), (1.5, 72), (1.9, 73), (2.9, 74), (3.5, 75)], 2: [(0.1, 60), (0.8, 60), (0.9, 61), (2.1, 73), (2.9, 78), (3.5, 75)], 3: [(1.7, 90)], 4: [(0.7, 80), (2.5, 62), (3.9, 73)]}


def events_of(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, None, "AGE", str(v)) for i, v in ((1, 50), (2, 33), (3, 40))]
    rows += [(i, None, "SEX", v) for i, v in ((1, "M"), (2, "M"), (3, "F"))]
    rows += [(i, None, "ROOM", str(100 + i)) for i in (1, 2, 3)]
    rows += [(i, t, "HR", str(v)) for i, seen in HR.items() for t, v in seen]
    rows += [(1, 2.3, "RATE", "48"), (2, 3.4, "RATE", "48"), (1, 2.3, "ROUTE", "Oral"), (2, 3.4, "ROUTE", "IV"), (3, 1.0, "ROUTE", "Bolus"), (1, 2.3, "LAB", "<1"), (3, 2.7, "LAB", "5")]
    return events_of(spark, rows), spark.createDataFrame([(3,), (4,), (1,), (2,)], "ID long")


def run(small, **how):
    settings = Settings(T=4, dt=1, prefilter=False, postfilter=False, value_types={"ROOM": "Categorical"}, **how)
    return FeaturePipeline(settings).run(*small), settings


def test_plain_features(small):
    result, settings = run(small, discretize=False)
    s = dense(result.S, result.population.select(F.col("id_idx").alias("row_id"), "ID")).orderBy("row_id").collect()
    assert s[0].asDict().keys() == {"row_id", "ID", "AGE_value", "ROOM_value:_101", "ROOM_value:_102", "ROOM_value:_103", "SEX_value:F", "SEX_value:M"}
    assert [r["AGE_value"] for r in s] == [50, 33, 40, 41] and s[3]["SEX_value:F"] == 0
    x = dense(result.X, row_labels(result.population, settings)).orderBy("row_id").collect()
    assert list(x[0].asDict())[4:] == ["HR_mask", "LAB_value", "RATE_value", "ROUTE_value:Bolus", "ROUTE_value:IV", "ROUTE_value:Oral", "HR_delta_time", "HR_value", "HR_min", "HR_max", "HR_mean", "LAB_value_str:<1"]
    assert [r["t_range"] for r in x[:2]] == ["[0.0, 1.0)", "[1.0, 2.0)"]
    assert [r["HR_delta_time"] for r in x[8:12]] == [0, 0, 1, 2]
    assert [r["HR_value"] for r in x[4:8]] == [61, 61, 78, 75]
    assert math.isclose(x[8]["HR_value"], 75.53333333333333) and math.isclose(x[8]["HR_mean"], 75.25555555555556)
    assert {r["LAB_value"] for r in x} == {5.0} and [r["LAB_value_str:<1"] for r in x].count(1) == 1


def test_edges_and_names(small):
    result, _ = run(small)
    assert edges_by_column(result.S.profile) == {"AGE_value": [33, 35.8, 38.6, 42, 46, 50], "SEX_value": None, "ROOM_value": None}
    x = edges_by_column(result.X.profile)
    assert x["HR_value"] == [61.0, 69.2, 73.6, 76.2, 82.00000000000001, 90.0] and x["HR_delta_time"] == [0, 1, 2] and x["LAB_value"] is None
    names = [r.name for r in result.S.features.orderBy("feature_id").collect()]
    assert names == ["AGE_value_(32.999, 35.8]", "AGE_value_(38.6, 42.0]", "AGE_value_(46.0, 50.0]", "ROOM_value__101", "ROOM_value__102", "ROOM_value__103", "SEX_value_F", "SEX_value_M"]
    ordinal, _ = run(small, use_ordinal_encoding=True)
    names = [r.name for r in ordinal.S.features.orderBy("feature_id").collect()]
    assert names[:5] == ["AGE_value>33.0", "AGE_value>35.8", "AGE_value>38.6", "AGE_value>42.0", "AGE_value>46.0"]


def test_frozen_edges(small):
    result, settings = run(small)
    again = FeaturePipeline(settings).frozen(result).run(*small)
    assert again.X.cells.exceptAll(result.X.cells).isEmpty()
    with pytest.raises(ValueError, match="no predetermined edges"):
        predetermined(result.X.profile, {"HR_value": [0.0, 1.0]})


def test_only_frequent_variables(spark, small):
    events, people = small
    settings = Settings(T=4, dt=1, prefilter=False, postfilter=False)
    result = FeaturePipeline(settings).run(events.where("var = 'HR'"), people)
    assert result.S is None and result.X.features.count() > 0


def test_numbers_in_text(spark):
    texts = {"5": 5.0, " 5 ": 5.0, "1e5": 1e5, "1_000": 1000.0, ".5": 0.5, "-3.": -3.0, "5d": None, "<1": None, "": None, "_1": None, "1__0": None, "nan": None}
    got = {r.v: r.n for r in spark.createDataFrame([(v,) for v in texts], "v string").select("v", to_double(F.col("v")).alias("n")).collect()}
    assert got == texts
    assert spark.sql("select 'nan' as v").select(F.col("v").rlike(NUMERIC)).head()[0]


def test_time_bins_at_edges(spark):
    rows = [(k * 0.1, k) for k in range(50)] + [(-0.01, None), (5.0, None)]
    got = spark.createDataFrame(rows, "t double, k int").select("k", time_bin(F.col("t"), 0.1, 50).alias("b")).collect()
    assert all(r.k == r.b for r in got)


def test_interval_labels():
    assert interval_labels([33.0, 35.8, 50.0]) == ["(32.999, 35.8]", "(35.8, 50.0]"]
    assert interval_labels([0.0, 0.0001, 0.0002]) == ["(-0.001, 0.0001]", "(0.0001, 0.0002]"]


def test_prefilter(spark):
    people = spark.range(1000).withColumnRenamed("id", "ID")
    rows = [(i, 0.5, "at", "1") for i in range(10)] + [(i, 0.5, "over", "1") for i in range(11)] + [(5000, 0.5, "over", "1"), (1, 9.0, "over", "1")]
    settings = Settings(T=4, dt=1, theta_1=0.01)
    kept = prefilter.prefilter(events_of(spark, rows), people, 1000, settings)
    assert {(r["var"], r["count"]) for r in kept.groupBy("var").count().collect()} == {("over", 11)}
    with pytest.raises(ValueError, match="inconsistent"):
        prefilter.require_consistent(events_of(spark, [(1, None, "a", "1"), (1, None, "a", "x")]), settings)
    prefilter.require_consistent(events_of(spark, [(1, None, "a", "y"), (1, None, "a", "x")]), settings)


def test_types_and_duplicates(spark):
    rows = [(1, 1.0, "n", "1"), (1, 1.0, "c", "x"), (1, 1.0, "c", "y"), (2, 1.0, "c", "x"), (1, 2.0, "m", "<1"), (1, 3.0, "m", "2"), (1, None, "none", None)]
    events = events_of(spark, rows)
    types = value_types.detect(events)
    assert {r["var"]: r.value_type for r in types.collect()} == {"n": "Numeric", "c": "Categorical", "m": "Numeric + Categorical", "none": "None"}
    mapped = {(r.ID, r["var"], r.val) for r in value_types.premap_duplicates(events, types).collect()}
    assert {(1, "c:x", "1"), (1, "c:y", "1"), (2, "c", "x")} <= mapped and len(mapped) == len(rows)
    forced = value_types.force_categorical(events_of(spark, [(1, None, "r", "7"), (2, None, "r", None), (3, None, "q", "a")]), {"r": "Categorical", "q": "Categorical"})
    assert {r.val for r in forced.collect()} == {"_7", None, "a"}


def test_hierarchy(spark):
    events = events_of(spark, [(1, None, "h", "a:b:c"), (1, None, "h", "a:x"), (2, None, "o", "z")])
    got = hierarchy.expand(events, {"h": "hierarchical"}, ":", (0, 2))
    assert sorted((r.ID, r.val) for r in got.collect()) == [(1, "a"), (1, "c"), (1, "x"), (2, "z")]
    paths = spark.createDataFrame([("001", ["top", "00", "001"])], "code string, path array<string>")
    coded = hierarchy.expand(events_of(spark, [(1, None, "d", "001")]), {"d": "hierarchical_ICD9"}, ":", (0, 1), {"paths9": paths})
    assert sorted(r.val for r in coded.collect()) == ["00", "top"]
    with pytest.raises(ValueError, match="unknown codes"):
        hierarchy.expand(events_of(spark, [(1, None, "d", "9")]), {"d": "hierarchical_ICD9"}, ":", (0,), {"paths9": paths})
    with pytest.raises(NotImplementedError):
        hierarchy.expand(events, {"h": "hierarchical_ICD"}, ":", (0,))


def test_codes_of_version_10(spark):
    paths = lambda rows: spark.createDataFrame(rows, "code string, path array<string>")
    nine, ten = paths([("001", ["t9", "00", "001"]), ("002", ["t9", "00", "002"]), ("003", ["t9", "003"])]), paths([("A01", ["tA", "A01"]), ("B", ["tB", "B"])])
    moves = spark.createDataFrame([("00", "B")], "code9 string, code10 string")
    events = events_of(spark, [(k, None, "d", c) for k, c in enumerate(("A01", "001", "003"))])
    got = hierarchy.expand(events, {"d": "hierarchical_ICD10"}, ":", (0, 5), {"paths9": nine, "paths10": ten, "code_map": moves})
    # its own path, that of the parent's converted code, and the old version's
    assert sorted((r.ID, r.val) for r in got.collect()) == [(0, "A01"), (0, "tA"), (1, "B"), (1, "tB"), (2, "003"), (2, "t9")]
    alone = hierarchy.expand(events.where("ID = 0"), {"d": "hierarchical_ICD10"}, ":", (1,), {"paths10": ten})
    assert [r.val for r in alone.collect()] == ["A01"]


def test_large_dictionaries_are_salted(spark, small, monkeypatch):
    from tempofeat.operators import lookup as module

    result, _ = run(small)
    want = sorted(map(str, result.X.cells.collect())), sorted(map(str, result.S.features.collect()))
    monkeypatch.setattr(module, "MOST", 0)
    large, _ = run(small)
    assert (sorted(map(str, large.X.cells.collect())), sorted(map(str, large.S.features.collect()))) == want


def test_ids_and_sources(spark, tmp_path):
    from tempofeat.sources.readers import read_events, read_population, with_common_ids

    (tmp_path / "data.csv").write_text("ID,t,variable_name,variable_value\n1,0.5,HR,7\n02,0.5,HR,8\n")
    (tmp_path / "pop.csv").write_text("ID\n1\n2\n")
    (tmp_path / "mixed.csv").write_text("ID\n1\nA3\n")
    events = read_events(spark, str(tmp_path / "data.csv"))
    both = with_common_ids(events, read_population(spark, str(tmp_path / "pop.csv")))
    assert [dict(df.dtypes)["ID"] for df in both] == ["bigint", "bigint"] and sorted(r.ID for r in both[0].collect()) == [1, 2]
    both = with_common_ids(events, read_population(spark, str(tmp_path / "mixed.csv")))
    assert [dict(df.dtypes)["ID"] for df in both] == ["string", "string"]
    settings = Settings(T=4, dt=1, prefilter=False, postfilter=False)
    assert [r.ID for r in FeaturePipeline(settings).run(events, read_population(spark, str(tmp_path / "mixed.csv"))).population.orderBy("id_idx").collect()] == ["1", "A3"]
    import pandas as pd

    pd.DataFrame({"ID": [1, 1], "t": [0.5, None], "variable_name": ["HR", "SEX"], "variable_value": [7, "M"]}).to_pickle(tmp_path / "data.p")
    assert sorted(r.val for r in read_events(spark, str(tmp_path / "data.p")).collect()) == ["7", "M"]
    with pytest.raises(ValueError, match="cannot read"):
        read_events(spark, "data.xlsx")
    with pytest.raises(ValueError, match="cannot read"):
        read_population(spark, "pop.xlsx")


def test_filled_properties(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 8), "v", str(rng.randint(0, 9))) for i in range(20) for _ in range(rng.randint(0, 9))]
    people = spark.range(25).withColumnRenamed("id", "ID")
    settings = Settings(T=8, dt=1, stats=("min", "count", "median"))
    results = []
    for parts in (1, 7):
        table = temporal.filled(temporal.binned(events_of(spark, rows).repartition(parts), people, settings), people, lookup(people.limit(1).selectExpr("'v' as var")), settings)
        results.append(sorted(map(tuple, table.collect()), key=str))
    assert results[0] == results[1] and len(results[0]) == 25 * 8
    by_id = {}
    for ID, k, _, mask, delta, value, low, n, _ in sorted(results[0], key=lambda r: (r[0], r[1])):
        last = k if mask else by_id.get(ID)
        by_id[ID] = last
        assert delta == (0 if last is None else k - last) and (value is None) == (last is None)
        assert mask or low == value and n in (None, 0.0, 1.0)


def test_postfilter(spark):
    n = 40
    rng = random.Random(1)
    a = [rng.randint(0, 1) for _ in range(n)]
    columns = {0: a, 1: [1 - v for v in a], 2: [rng.randint(0, 1) for _ in range(n)], 3: a, 4: [1] * n, 5: [0] * (n - 1) + [1]}
    features = spark.createDataFrame([(k, f"f{k}", 0.0) for k in columns], "feature_id long, name string, default_value double")
    cells = spark.createDataFrame([(r, r, k, float(v)) for k, c in columns.items() for r, v in enumerate(c) if v], "row_id long, ID long, feature_id long, value double")
    rows = spark.range(n).select(F.col("id").alias("row_id"))
    verdict = postfilter.near_constant(features, cells, n, 0.05)
    assert {r.feature_id for r in verdict.where("kept").collect()} == {0, 1, 2, 3}
    kept, own, aliases = postfilter.select(features, cells, verdict, rows, n)
    assert [r.name for r in kept.orderBy("feature_id").collect()] == ["f0", "f2"]
    assert {(r.kept, r.alias) for r in aliases.collect()} == {("f0", "~{f1}"), ("f0", "f3")}
    again, _, none = postfilter.select(kept, own, postfilter.near_constant(kept, own, n, 0.05), rows, n)
    assert again.count() == 2 and none.count() == 0


def test_shifted_default_counts_as_value(spark):
    features = spark.createDataFrame([(0, "x", 1.0)], "feature_id long, name string, default_value double")
    cells = spark.createDataFrame([(0, 0, 0, 3.0)], "row_id long, ID long, feature_id long, value double")
    got = postfilter.near_constant(features, cells, 2, 0.0).head()
    assert math.isclose(got.variance, 1.0)  # of 3 and 1


def test_numbering_and_settings(spark, tmp_path):
    got = numbered(spark.createDataFrame([(9,), (3,), (3,), (None,)], "ID long")).orderBy("ID").collect()
    assert [(r.ID, r.id_idx) for r in got] == [(3, 0), (9, 1)]
    path = tmp_path / "c.yaml"
    path.write_text("discretize: no\nvalue_types:\n  A: Categorical\n")
    s = load_settings(str(path), T=5, dt=2)
    assert s.L == 2 and not s.discretize and s.value_types == {"A": "Categorical"}
    with pytest.raises(ValueError):
        Settings(T=1, dt=0)


def test_profile_ignores_few_numbers(spark):
    cells = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "col string, num double")
    got = {r["col"]: r["edges"] for r in column_profile(cells).collect()}
    assert got["a"] is None and got["b"][0] == 1.0 and got["b"][-1] == 3.0


def test_command_line_and_files(spark, tmp_path):
    from tempofeat import cli

    rows = ["ID,t,variable_name,variable_value"] + [f"{i},{t},HR,{v}" for i, seen in HR.items() for t, v in seen] + ["1,NULL,SEX,M", "2,NULL,SEX,F"]
    (tmp_path / "data.csv").write_text("\n".join(rows))
    (tmp_path / "pop.csv").write_text("ID\n3\n4\n1\n2\n")
    cli.main(["--data_fname", str(tmp_path / "data.csv"), "--population_fname", str(tmp_path / "pop.csv"), "--output_dir", str(tmp_path / "out"), "--T", "4", "--dt", "1"])
    import json

    names = json.loads((tmp_path / "out/S.feature_names.json").read_text())
    assert names == ["SEX_value_F", "SEX_value_M"]
    assert spark.read.parquet(str(tmp_path / "out/pre-filtered.parquet")).count() == 18
    assert "HR_value" in json.loads((tmp_path / "out/X_all.discretization.json").read_text())


def test_stream(spark, small, tmp_path):
    from tempofeat.streaming.latest import latest_on_stream, with_frozen_bins

    events, _ = small
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = latest_on_stream(stream, Settings(T=4, dt=1))
    q = out.writeStream.outputMode("complete").format("memory").queryName("latest_cells").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.table("latest_cells")
    assert got.where("ID = 2 and bin = 0 and var = 'HR'").head().num == 61
    assert with_frozen_bins(got, {"HR_value": [60.0, 70.0, 90.0]}).where("ID = 2 and bin = 0 and var = 'HR'").head().interval == 1


def test_quantiles_by_rank_are_exact(spark):
    rng = random.Random(9)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3001)] + [("b", float(rng.randint(0, 3))) for _ in range(500)] + [("c", float(k)) for k in (1, 2, 3)] + [("d", None)]
    cells = spark.createDataFrame(rows, "col string, num double").repartition(5)
    got = {r["col"]: r for r in column_profile(cells).collect()}
    assert got["d"].edges is None and (got["d"].n_text, got["d"].numbers) == (1, 0)
    for name in "abc":
        own = [x for c, x in rows if c == name]
        want = sorted(set(np.percentile(own, [0, 20, 40, 60, 80, 100])))
        assert len(got[name].edges) == len(want) and np.allclose(got[name].edges, want, atol=1e-12)
        assert (got[name].numbers, got[name].n_num) == (len(set(own)), len(own)) and math.isclose(got[name].mean, np.mean(own), abs_tol=1e-12)


def test_plans_stay_on_the_jvm(spark, small):
    result, _ = run(small)
    for frame in (result.X.cells, result.S.cells, result.X.profile):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_vectors(small):
    from tempofeat.plans.pipeline import vectors

    result, _ = run(small, discretize=False)
    got = {r.row_id: r.features for r in vectors(result.S, result.population.select(F.col("id_idx").alias("row_id"))).collect()}
    assert got[3][0] == 41.0 and got[0][0] == 50.0 and len(got) == 4


def test_time_bins_of_all_values(spark, tmp_path):
    values = [-0.2, -20.0, 0.0, 599.99, 600.0, 1730.0]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {r.event_id: r.bin for r in QUERIES["time_bins"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(SQL["time_bins"]).fetchall()) == {0: 0, 1: -2, 2: 0, 3: 60, 4: 60, 5: 173}


def test_a_stored_population_is_not_broadcast(spark, small):
    """Its file is far below Spark's limit for broadcasts, its rows in memory need not be."""
    people = stored(spark.range(30_000).select(F.col("id").alias("ID")))
    for rows in (prefilter.in_population(small[0], people), temporal.binned(small[0], people, Settings(T=4, dt=1)), invariant.last_values(small[0], people)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_customers_are_not_broadcast(spark):
    """Nations, a row each, are; their product with the regions looks larger to Spark than a file of customers."""
    from tempofeat.plans.views import events

    plan = events(spark, "/root/testdata/sf0.01")._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "c_nationkey" in line and "Join" in line]
    assert joins and all("BroadcastHashJoin" in line and "BuildRight" in line for line in joins)


def test_types_are_matched_without_lower(spark):
    """lower() in the driver, over a small dictionary, loads the title case of all characters."""
    rows = [(1, 0.0, "A", "x", 0), (1, 0.0, "A", "y", 1), (1, 0.0, "B", "x", 2), (1, 0.0, "B", "y", 3), (1, 0.0, "C", None, 4), (1, 0.0, "C", None, 5)]
    types = lookup(spark.createDataFrame([("A", "Categorical"), ("B", "NUMERIC + Categorical"), ("C", "None")], "var string, value_type string"))
    got = value_types.premap_duplicates(spark.createDataFrame(rows, SCHEMA), types)
    assert "lower(" not in got._jdf.queryExecution().logical().toString()
    assert {(r["var"], r.val, r.row_idx) for r in got.collect()} == {("A:x", "1", 0), ("A:y", "1", 1), *((r[2], r[3], r[4]) for r in rows[2:])}


def test_steps_release_what_the_driver_holds(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    for step in (stored, lookup):
        before = whole()
        step(spark.range(3))
        assert whole() > before


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_keys_need_no_broadcast(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ID long, var string")
    names = lookup(spark.createDataFrame([("a",), (None,), ("z",)], "var string"))
    inside, outside = (look_up(rows, names, ["var"], how) for how in ("left_semi", "left_anti"))
    assert inside.columns == ["var", "ID"] and [r.ID for r in inside.collect()] == [1] and sorted(r.ID for r in outside.collect()) == [2, 3]
    assert "Broadcast" not in plan(inside) + plan(outside)
    none = lookup(spark.createDataFrame([], "var string"))
    assert [look_up(rows, none, ["var"], how).count() for how in ("left_semi", "left_anti")] == [0, 3]
    many = lookup(spark.range(1000).select(F.col("id").alias("ID")))
    assert look_up(rows, many, ["ID"], "left_anti").count() == 0 and "Broadcast" in plan(look_up(rows, many, ["ID"], "left_semi"))


def test_forced_and_filled_need_no_broadcast(small):
    events, people = small
    types = lookup(value_types.detect(events, {"ROOM": "Categorical"}))
    forced = value_types.force_categorical(events, {"ROOM": "Categorical"}, types=types)
    assert {r.val for r in forced.where("var = 'ROOM'").collect()} == {"_101", "_102", "_103"} and "Broadcast" not in plan(forced)
    often = lookup(events.where("var = 'HR'").select("var").distinct())
    settings = Settings(T=4, dt=1)
    table = temporal.filled(temporal.binned(events, people, settings), people, often, settings)
    assert table.count() == 16 and "BroadcastNested" not in plan(table) and "BroadcastHash" not in plan(table)


def test_freed_native_memory_is_returned(spark):
    assert "Trim native heap" in trim(spark)


def test_variances_are_computed_once(spark):
    features, cells, _, _ = _kept_s(spark, "/root/testdata/sf0.001")
    assert cells.count() and "Aggregate" not in plan(cells) + plan(features)


def with_sql(spark, name, d):
    """Sorted rows of a query over the tables of a folder, and of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "events", "nation", "orders", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return sorted(map(tuple, QUERIES[name](spark, d).collect()), key=str), sorted(con.execute(SQL[name]).fetchall(), key=str)


@pytest.mark.parametrize("change", ["case when c_custkey < 5 then -0.0D else c_acctbal end as c_acctbal", "nullif(c_nationkey, 3) as c_nationkey", "if(c_custkey < 50, c_nationkey + 25, c_nationkey) as c_nationkey", "-1 - abs(c_acctbal) as c_acctbal", "if(c_custkey % 10 = 9, null, c_custkey) as c_custkey"])
def test_mean_of_odd_customers(spark, tmp_path, change):
    """Balances of -0.0, customers of no known nation, debts alone, and customers without a key."""
    for t in ("customer", "events", "nation", "orders", "region"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        rows = rows.selectExpr(f"* except ({change.split()[-1]})", change) if t == "customer" else rows
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = with_sql(spark, "invariant_impute_mean", str(tmp_path))
    assert got == want and len(got) == 150


def test_numbers_of_odd_events(spark, tmp_path):
    """Ids that are null, or negative, of which some have no text."""
    ids = [None, None, *range(-25, 25), 2**62, -(2**62)]
    for t in ("customer", "nation", "orders", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got, want = with_sql(spark, "numeric_text", str(tmp_path))
    assert got == want and (None, None, None) in got and (-1, None, None) in got
