"""What must not grow with the square of the input, or change with its size: each on small rows."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from conftest import SF
from pyspark.sql import functions as F

from zenithal.functions import manoeuvre
from zenithal.functions import text as T
from zenithal.operators import graph, intervals, joins, metrics, monitoring, retrieval
from zenithal.plans.registry import ORACLES, QUERIES
from zenithal.plans.tables import Tables
from zenithal.queries.t_text import _first
from zenithal.session import by_slices
from zenithal.sources import loaders
from zenithal.streaming import events, leases


def test_bin_links_stand_for_all_pairs(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(rng.uniform((0, 0), (2000, 180), (150, 2)))] + [(900, None, 3.0), (901, 5.0, None)], "id long, p double, q double")
    pairs = {(r.id_a, r.id_b) for r in joins.orbital_bins(df, "id", "p", "q").collect()}
    rows = {r.id: r for r in joins.bin_links(df, "id", "p", "q").collect()}
    near = {i: {int(x) for x in r.near_classes.split(",")} for i, r in rows.items()}
    assert {(a, b) for a in rows for b in rows if a < b and rows[b].class_id in near[a]} == pairs
    assert {i: r.n_links for i, r in rows.items()} == {i: sum(i in p for p in pairs) for i in rows}


def test_d8_gives_every_pair_of_objects_in_neighbouring_bins(spark):
    got = [(r.id_a, r.id_b) for r in QUERIES["d8_orbital_bins"](spark, SF).collect()]
    cells = [(r.norad_id, r.perigee_km // 200, r.inclination_deg // 15) for r in Tables(spark, SF).catalog.collect()]
    assert len(got) == len(set(got)) > 500 and set(got) == {(a, b) for a, h, i in cells for b, k, j in cells if a < b and abs(h - k) <= 1 and abs(i - j) <= 1}


def test_cells_dealt_to_tasks_lose_no_pair_of_a_split_cell(spark):
    df = spark.range(900).selectExpr("id", "id % 3 * 1.0 AS p", "id % 2 * 200.0 AS q")
    got = joins.cell_pairs(df, "id", [F.floor("p"), F.floor("q")], cell_rows=40, columns=["id"], tasks=7).select("a.id", F.col("b.id").alias("o"))
    assert got.count() == got.distinct().count() == sum(abs(a % 3 - b % 3) <= 1 and a % 2 == b % 2 for a in range(900) for b in range(a + 1, 900))
    assert joins.orbital_bins(df, "id", "p", "q").rdd.getNumPartitions() > 1


def test_near_approaches_do_not_write_the_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-8, 8, (120, 3)))]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    eph = spark.createDataFrame([(i, k, *(float(v) for v in np.array(p) + k * rng.integers(-2, 3, 3))) for i, *p in rows for k in range(5) if (i + k) % 7 and i != 3], "id int, k int, x double, y double, z double")
    pairs = joins.near_pairs(df, "id", ("x", "y", "z"), 5.0)
    want = joins.closest_approach(pairs.select("id_a", "id_b"), eph, "id", "k", ("x", "y", "z"))
    got = joins.near_approaches(df, eph, "id", "k", ("x", "y", "z"), 5.0)
    told = lambda d: sorted((r.id_a, r.id_b, r.tca, round(r.distance, 9)) for r in d.collect())
    assert told(got) == told(want) and got.count() > 100


def test_d10_broadcasts_no_exploded_table(spark):
    plan = QUERIES["d10_closest_approach"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and plan.count("map_from_entries") >= 1


def test_d10_distances_of_a_pair_are_compiled(spark):
    plan = QUERIES["d10_closest_approach"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "array_min" in plan


def test_near_approaches_are_the_same_with_columns_and_with_arrays(spark):
    """Ties, epochs that one or both of a pair lack, a pair without a common epoch, coordinates that are null or NaN."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, *map(float, rng.integers(-6, 7, 3))) for i in range(90)], "id int, x double, y double, z double")
    value = lambda i, k: None if (i + 2 * k) % 29 == 0 else float("nan") if (i * k) % 31 == 30 else float(rng.integers(-3, 4))
    rows = [(i, k * 10, value(i, k), value(i, k + 1), float(rng.integers(-3, 4))) for i in range(90) for k in range(6) if i != 3 and k % 2 == i % 2 or i % 5 and (i + k) % 4]
    eph = spark.createDataFrame(rows, "id int, k int, x double, y double, z double")
    told = lambda d: sorted(repr((r.id_a, r.id_b, r.tca, round(r.distance, 9))) for r in d.collect())
    got = {u: told(joins.near_approaches(df, eph, "id", "k", ("x", "y", "z"), 5.0, unrolled=u)) for u in (0, 5, 6, 50)}
    pairs = joins.near_pairs(df, "id", ("x", "y", "z"), 5.0).select("id_a", "id_b")
    whole = eph.where("x is not null and y is not null and z is not null")
    assert got[0] == got[5] == got[6] == got[50] == told(joins.closest_approach(pairs, whole, "id", "k", ("x", "y", "z"))) and len(got[0]) > 100
    assert joins.near_approaches(df, eph.limit(0), "id", "k", ("x", "y", "z"), 5.0).count() == 0


def test_element_sets_are_written_and_dealt_out(spark):
    for name in ("b16_sgp4", "b17_batch_propagation"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "lpad" not in plan  # the expressions that make the lines are not repeated in each check of a line


def test_b36_is_many_tasks_without_interpreted_steps(spark):
    df = QUERIES["b36_two_body_forecast"](spark, SF)
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.rdd.getNumPartitions() > 1


def test_increase_is_a_running_sum(spark):
    rng = np.random.default_rng(5)
    at = [int(x) for x in rng.integers(-40, 40, 300)]
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 50 else None, a) for i, a in enumerate(at)], "i int, k string, h int").selectExpr("i", "k", "timestamp_ntz'1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, h, 0, if(i % 3 = 0, 0.000001, 0)) AS t")
    rows = {r.i: r for r in df.collect()}
    got = monitoring.increase(df, "k", "t", 6)
    hours6 = pd.Timedelta(hours=6)
    assert {r.i: r.increase for r in got.collect()} == {i: sum(o.k == r.k and r.t - hours6 <= o.t <= r.t for o in rows.values()) for i, r in rows.items()}
    assert "_b" in got._jdf.queryExecution().optimizedPlan().toString()  # not one task for each key


def test_either_case_means_the_same_to_both_engines(spark):
    texts = ["éESA x", "x ESAé", "esa", "a ESA", "ESTEC", "EſTEC", "NAſA", "KNASA", "x_NASA", "日NASA", "(nasa)", "Technical\x0bNote", "Technical Note", "user  manual", "tm-5", "éESA"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for fn, rules, other in ((T.agency, T.AGENCIES, "OTHER"), (T.document_kind, T.KINDS, "unknown")):
        got = [r.v for r in df.orderBy("i").select(fn(df.x).alias("v")).collect()]
        con = duckdb.connect()
        want = [con.execute(f"SELECT {_first('x', rules, other)} FROM (SELECT ? AS x)", [x]).fetchall()[0][0] for x in texts]
        assert got == want
    assert "x4_job_leases" in ORACLES


def test_a_run_that_takes_no_time_is_released():
    step = leases.lease(2_700_000, 7_200_000)
    out, _, _ = step([(5, 1, "a", False), (5, 1, "a", True), (5, 2, "b", False), (7_200_000, 3, "c", False), (7_200_500, 3, "c", True)], None, 10**9)
    assert [(o[0], o[2], o[3]) for o in out] == [(1, "run", 5), (1, "released", 5), (2, "done", 5), (3, "run", 7_200_000), (3, "released", 7_200_500)]


def test_streaks_go_over_batches_in_any_order():
    class State:
        exists, get = False, None

        def update(self, value):
            self.get = value

    batches = [pd.DataFrame({"event_id": [5, 2], "value": [5.0, 2.0]}), pd.DataFrame({"event_id": [1, 4, 3], "value": [1.0, 1.5, 3.0]})]
    state = State()
    got = pd.concat(events._streak((7,), iter(batches), state))
    assert list(zip(got.event_id, got.streak, strict=True)) == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 2)] and state.get == (5.0, 2)


def test_exact_quantiles_beyond_the_size_of_sketches(spark):
    rng = np.random.default_rng(6)
    values = [*map(float, rng.normal(50, 20, 3000).round(1)), *[7.0] * 500]
    df = spark.createDataFrame([("ab"[i % 2] if i % 9 else None, i % 5000, v) for i, v in enumerate(values)], "k string, m int, v double").selectExpr("k", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0) AS t", "v")
    qs = {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.key: r for r in metrics.exact_quantiles(df, metrics.hourly(df, "k", "t", "v", 8), "k", "t", "v", qs, "week", 8).collect()}
    assert len(got) == 3
    for key, r in got.items():
        own = sorted(v for i, v in enumerate(values) if ("ab"[i % 2] if i % 9 else None) == key)
        assert [r.n, r.low, r.p50, r.p95, r.top] == [len(own), *[own[max(1, int(np.ceil(q * len(own)))) - 1] for q in qs.values()]]


def test_g7_gives_every_pair_that_shares_a_neighbour(spark):
    larger = SF.replace("0.001", "0.01")  # on the smallest tables no two nodes share one
    got = [(r.id, r.other) for r in QUERIES["g7_shared_neighbour"](spark, larger).collect()]
    edges = [(r.src, r.dst) for r in Tables(spark, larger).edges.where("type = 'HEADQUARTERED_IN'").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, x in edges for b, y in edges if x == y and a != b} != set()


def test_shared_neighbours_of_split_hubs_and_of_several_hubs(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 90, 150), rng.integers(0, 4, 150), strict=True)] + [(1000, 9), (None, 1), (5, None)]
    got = [(r.id, r.other) for r in graph.shared_neighbours(spark.createDataFrame(edges, "src int, dst int"), part_rows=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, x in edges for b, y in edges if x is not None and x == y and None not in (a, b) and a != b}


def test_context_orders_no_texts(spark):
    df = spark.createDataFrame([("q", i, "w " * n if n else None) for i, n in enumerate([0, 3000, 3000, 0, 3000, 9000, 9000, 1])], "q string, i int, x string")
    out = retrieval.context(df, "q", "i", df.i.cast("string"), "x")
    assert [(r.n_sources, r.context.split("\n")[0]) for r in out.collect()] == [(6, "1")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("x#" in line for line in plan.splitlines() if "Window" in line)


def test_merged_intervals_hold_the_same_points_once(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(6)), *(None if rng.random() < 0.1 else int(x) for x in rng.integers(0, 60, 2))) for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, a long, b long")
    got = [(r.k, r.a, r.b) for r in intervals.merged(df, "k", "a", "b").collect()]
    holds = lambda of, k, x: sum(i == k and (a is None or a <= x) and (b is None or x <= b) for i, a, b in of)
    for k in range(6):
        for x in range(-1, 61):
            assert holds(got, k, x) == min(1, holds(rows, k, x))


def test_pages_are_parsed_once_and_in_slices(spark):
    plan = QUERIES["r24_document_ingest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [sections(") == 1 and plan.count("ArrowEvalPython [cut(") == 1
    seen = []
    got = by_slices(lambda own: seen.append(len(own)) or own, pa.string(), pa.array([*"abcdefg", None]), rows=3)
    assert got.to_pylist() == [*"abcdefg", None] and seen == [3, 3, 2] and by_slices(list, pa.string(), pa.array([], pa.string())).to_pylist() == []


def test_documents_as_files_are_neither_listed_nor_opened_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of number {i} that are long enough") for i in range(60)] + [(60, None)], "id long, body string").repartition(3)
    kind = F.when(F.col("id") % 2 == 0, "docx").otherwise("html")
    named = loaders.export(docs, "id", "body", kind, f"file://{tmp_path}/files").toPandas()
    names = spark.createDataFrame(named)
    read = lambda d: {r.path[-36:]: (r.loader, r.content) for r in d.collect()}
    got = loaders.load(loaders.read_files(names, "name", f"file://{tmp_path}/files"))
    assert read(got) == read(loaders.load_folder(spark, f"file://{tmp_path}/files")) and len(read(got)) == 61
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and plan.count("PartitionFilters: [isnotnull(loader") >= 3
    assert "binaryFile" not in QUERIES["a18_documents_as_files"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_b36_covers_all_seven_days(spark):
    steps = QUERIES["b36_two_body_forecast"](spark, SF).groupBy("norad_id").agg(F.count("*").alias("n"), F.min("step").alias("a"), F.max("step").alias("b"), F.count_distinct("step").alias("d"))
    assert {(r.n, r.a, r.b, r.d) for r in steps.collect()} == {(336, 0, 335, 336)}
    assert spark.range(1).select(F.size(manoeuvre.two_body_forecast(F.lit(7000.0), F.lit(0.01), F.lit(51.6), most=None))).first()[0] == 336
