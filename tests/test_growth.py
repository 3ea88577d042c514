"""What must not grow faster than the input."""

import os
import time
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import functions as F

from cargolens.operators import cleaning, explain, forest
from cargolens.plans import derived, jobs, queries, staging, testtables
from cargolens.sources import csv as csv_source
from cargolens.sources import records, sinks
from cargolens.sources.store import BatchStore

ROWS = {
    "customer": ("c_custkey long, c_nationkey long", [(1, 3), (2, 4), (2, 5), (None, 6), (3, None)]),
    "supplier": ("s_suppkey long, s_nationkey long", [(1, 7), (17, 8), (2, None), (None, 1), (1, 9)]),
    "part": ("p_partkey long, p_brand string, p_size int", [(1, "B", 3), (53, None, None), (1, "C", 4), (None, "D", 5)]),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string",
        [(1, 1, None, "F"), (2, 2, None, "O"), (2, 3, None, None), (None, 1, None, "P"), (3, None, None, "F")],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        [(o, p, s, n, 13.0 + n, 2.5, 0.1, 0.0, "A", None, None)
         for o in (1, 2, 3, None) for p in (1, 53, None) for s in (1, 2, 17, None) for n in (1, 7)],
    ),
}


def _tables(spark, path):
    """The tables above, with another order of whole rows."""
    for name, (kind, rows) in ROWS.items():
        more = [(9, 1, datetime(2024, 1, 2), "O")] if name == "orders" else []
        more += [(9, 1, 1, n, 3.0 + n, 50.0 * n, 0.1, 0.02, "A", "O", datetime(2024, 1, 3)) for n in (1, 2, 2)] if name == "lineitem" else []
        spark.createDataFrame(rows + more, kind).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_line_items_do_not_move_for_customers(spark, tmp_path):
    for name, (kind, rows) in ROWS.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    found = testtables.shipments(spark, str(tmp_path))
    sql = testtables.SHIPMENTS_SQL
    for name in testtables.TABLES:
        sql = sql.replace(f"FROM {name}\n", f"FROM {{{name}}}\n").replace(f"JOIN {name} ON", f"JOIN {{{name}}} ON")
    expected = spark.sql(sql, **{t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in testtables.TABLES})
    assert found.schema == expected.schema
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str) != []
    joins = [n for n in _nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    of_customers = [n for n in joins if "c_custkey" in n.condition().toString()]
    assert len(of_customers) == 1 and "l_orderkey" not in of_customers[0].output().mkString(",")


def test_line_items_are_not_sorted_for_joins(spark, tmp_path):
    """Sorts for two joins beside the sort by container made tasks spill; what can be broadcast still is."""
    for name, (kind, rows) in ROWS.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")

    def found(limit):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        df = testtables.shipments(spark, str(tmp_path))
        nodes = df._jdf.queryExecution().sparkPlan().toString()
        return sorted(df.collect(), key=str), {n: nodes.count(n) for n in ("SortMergeJoin [l_", "ShuffledHashJoin [l_", "BroadcastHashJoin [l_")}

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        small, broadcast = found("10MB")
        large, hashed = found("-1")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert small == large != []
    assert broadcast["BroadcastHashJoin [l_"] >= 2 and broadcast["SortMergeJoin [l_"] == 0
    assert hashed["ShuffledHashJoin [l_"] == 2 and hashed["SortMergeJoin [l_"] == 1  # that of the few suppliers


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    """They stayed until the driver's heap was collected, so a query's disk was the sum of all its steps."""
    rows = spark.range(20_000).repartition(4, "id")
    kept = spark.conf.get(staging.FREED)
    before = _shuffle_files(spark)
    rows.write.parquet(f"{tmp_path}/plain")
    assert _shuffle_files(spark) - before
    before = _shuffle_files(spark)
    store = BatchStore(spark, f"{tmp_path}/store")
    with staging.Staging(spark) as own:
        written = [own(rows), staging.stage(rows)]
        store.write_cleaned(rows, "b")
        sinks.write_csv(rows, f"{tmp_path}/csv")
        for _ in range(50):  # files go a moment after the query
            if not _shuffle_files(spark) - before:
                break
            time.sleep(0.1)
        assert not _shuffle_files(spark) - before
        assert [found.count() for found in (*written, store.cleaned("b"))] == [20_000] * 3
    assert spark.conf.get(staging.FREED) == kept


def test_unique_and_cleaned_rows_come_from_one_run_of_the_joins(spark, tmp_path, monkeypatch):
    folder = _tables(spark, tmp_path)
    runs = []
    plain = derived.shipments
    monkeypatch.setattr(derived, "shipments", lambda *where: runs.append(where) or plain(*where))
    derived.forget()
    unique, cleaned = derived.unique(spark, folder), derived.cleaned(spark, folder)
    assert len(runs) == 1
    expected = cleaning.clean(plain(spark, folder), testtables.ORDER)
    assert cleaned.schema == expected.schema and cleaned.count() > 0 and unique.count() > cleaned.count()
    assert cleaned.exceptAll(expected).isEmpty() and expected.exceptAll(cleaned).isEmpty()
    derived.forget()


def test_cleaned_rows_are_written_once(spark, small, monkeypatch):
    written = []
    plain = derived.stage
    monkeypatch.setattr(derived, "_small", lambda df, name="stage": written.append(name) or plain(df, name, codec="zstd"))
    derived.forget()
    rows = derived.cleaned(spark, small)
    assert written == ["unique"] and rows.count() > 0
    derived.forget()


def test_a_task_carries_nothing_of_other_file_splits(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f'{i},"a\nb {i}"\n' for i in range(300)))
    sizes, kind = [], type(spark.range(1))
    plain = kind.mapInArrow

    def noted(df, run, schema, *more, **options):
        sizes.append(len(cloudpickle.dumps(run)))
        return plain(df, run, schema, *more, **options)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    seen, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for cut in ("2000", "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
            sizes.clear()
            lines = spark.read.text(str(tmp_path)).selectExpr("value AS line", "*").select("line", *csv_source._ingest_columns())
            maps = records.split_maps(lines)
            joined, _ = records.join_records(lines, maps)
            assert sorted(r["line"] for r in joined.collect()) == sorted(["x,y", *(f'{i},"a\nb {i}"' for i in range(300))])
            seen.append((len({(m["ingest_file"], m["ingest_block"]) for m in maps}), max(sizes)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[1][0] > 3 * seen[0][0] and seen[1][1] == seen[0][1]


def test_arriving_files_keep_their_size(spark, small, monkeypatch):
    made = []
    plain = queries.stage_path
    monkeypatch.setattr(queries, "stage_path", lambda s, name: made.append(plain(s, name)) or made[-1])
    expected = queries.QUERIES["st1_exactly_once"](spark, small).collect()
    monkeypatch.setattr(queries, "ARRIVAL_ROWS", 50)
    made.clear()
    found = queries.QUERIES["st1_exactly_once"](spark, small).collect()
    assert sorted(found, key=str) == sorted(expected, key=str)
    source = next(p for p in made if "/arrivals-" in p)
    assert sum(f.endswith(".parquet") for f in os.listdir(source)) > 3
    store = next(p for p in made if "/streamed-" in p)
    assert sum(d.startswith("batch_id=") for d in os.listdir(f"{store}/predictions")) == 3


def test_an_ordered_stream_reads_more_files_and_holds_its_state_on_disk(spark, small, monkeypatch):
    """st2_first_in_order: files grow in number, in three micro-batches, and the session's settings come back."""
    made = []
    plain = queries.stage_path
    monkeypatch.setattr(queries, "stage_path", lambda s, name: made.append(plain(s, name)) or made[-1])
    monkeypatch.setattr(queries, "ARRIVAL_ROWS", 200)
    before = dict(spark.conf.getAll)
    found = queries.QUERIES["st2_first_in_order"](spark, small).count()
    assert dict(spark.conf.getAll) == before
    assert found == queries.QUERIES["c3_deduplicate"](spark, small).count()
    source, state = (next(p for p in made if f"/{n}-" in p) for n in ("st2-arrivals", "st2-order"))
    assert sum(f.endswith(".parquet") for f in os.listdir(source)) > 25
    with open(f"{state}/offsets/2") as f:
        assert "RocksDBStateStoreProvider" in f.read()
    with open(f"{state}/offsets/3") as f:  # the fourth one has the row that ends the stream
        assert '"batchWatermarkMs":0' not in f.read()


def _rows_to_tag(spark):
    """Repeated ids, exact copies, ties in the order, nulls in every column and rows of no id."""
    kind = "Container_ID string, Declared_Value double, Declared_Weight double, Measured_Weight double, seq int, place int"
    ids, values = ("a", "b", "b", "c", None, "crowd", "crowd", "crowd"), (1.0, None, 2.0, 0.0, -0.0, float("nan"))
    rows = [(i, v, w, w, q, p) for i in ids for v in values for w in (None, 1.0) for q in (2, 1, None) for p in (None, 1)]
    return spark.createDataFrame(rows + rows[::3] + [("one", 1.0, 1.0, 1.0, 1, 1), ("two", None, 1.0, 1.0, 1, 1)] + rows[::50] * 4, kind)


def test_rows_are_tagged_alike_by_both_ways(spark, monkeypatch):
    """j3_rejects: ids that few rows share are sorted, others are split; one id is on the one way, one on the other."""
    rows = _rows_to_tag(spark).withColumns({"Declared_Value": F.col("Declared_Value") + 0.0})
    for unique in (True, False):
        order = ["seq", "place"]
        seen = []
        for limit in (10**6, 150, 0):
            monkeypatch.setattr(cleaning, "CROWDED", limit)
            seen.append(sorted(cleaning.tag_rows(rows, order, unique_order=unique).collect(), key=str))
        plain = sorted(cleaning._tag_split(rows, order, unique).collect(), key=str)
        assert str(seen[0]) == str(seen[1]) == str(seen[2]) == str(plain) != "[]"
        assert sum(r["copies"] for r in plain) == rows.count()


def test_tagged_rows_move_once(spark):
    """j3_rejects: whole rows moved for their copies, for the first one of an id and for the join with it."""
    rows = _rows_to_tag(spark)
    tagged = cleaning.tag_rows(rows, ["seq"])
    tagged.collect()
    plan = tagged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(Container_ID#") == 1 and "Exchange hashpartitioning(_id#" not in plan
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_explanations_need_no_lambdas(spark, small):
    """s9_report_export, j3_score_batch: lambdas were interpreted row by row, and the findings were made up to three times."""
    plan = derived.predictions(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "explanation_summary" in plan and "lambdafunction" not in plan
    kind = "weight_diff_pct double, value_per_kg double, Dwell_Time_Hours double, flag_high_value_density int, flag_low_value_density int, origin_country_risk int, dest_country_risk int, route_frequency long, flag_excessive_dwell int, flag_minimal_dwell int, is_night int, is_weekend int, HS_Code string, risk_level string, score double"
    none = (0.0, 1.0, 1.0, 0, 0, 0, 0, 9, 0, 0, 0, 0, "10", "Critical", 0.5)
    many = (-30.0, 12345.5, 400.0, 1, 0, 1, 2, 1, 1, 0, 1, 1, "8412", "Critical", 0.9)
    two = (0.0, 1.0, 1.0, 0, 0, 0, 0, 9, 0, 0, 1, 0, "85", "Medium", 0.3)
    rows = [none, many, (*many[:-2], "High", 0.6), (*many[:-2], "Low", 0.1), (*many[:-2], None, 0.1), two, (*two[:-2], "Low", 0.1)]
    found = [r[0] for r in spark.createDataFrame(rows, kind).coalesce(1).select(explain.explanation()).collect()]
    weight = "Measured weight is 30.0% lower than declared."
    value = "Exceptionally high value density ($12,346/kg) - possible luxury or contraband goods."
    night = "Timing flags: submitted during off-hours (may indicate avoidance of oversight)."
    hs = "HS code 85** associated with controlled/restricted commodities."
    assert found == [
        "All parameters within normal ranges. Risk score: 0.50. Standard processing.", f"{weight} {value}", weight,
        f"Minor risk indicators noted: {weight}; {value}.", f"Minor risk indicators noted: {weight}; {value}.", night,
        f"Minor risk indicators noted: {night}; {hs}.",
    ]


def test_a_task_reads_several_small_splits(spark, tmp_path, monkeypatch):
    rows = spark.range(3_000).select(F.concat(F.lit("C"), "id").alias("Container_ID"), F.concat(F.lit('x\n"y",'), "id").alias("HS_Code"))
    rows.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = {}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        for splits in (1_000_000, 1):
            monkeypatch.setattr(csv_source, "SPLITS", splits)
            plain = spark.read.text(f"{tmp_path}/in")
            found[splits] = csv_source.read_uploaded_csv(spark, f"{tmp_path}/in").select("Container_ID", "HS_Code").collect()
            tasks = csv_source._several_splits(plain).rdd.getNumPartitions()
            assert tasks == plain.rdd.getNumPartitions() > 8  # one split a task is as many tasks as before
        monkeypatch.setattr(csv_source, "SPLITS", 3)
        splits = plain.rdd.getNumPartitions()
        assert csv_source._several_splits(plain).rdd.getNumPartitions() == max(3 * spark.sparkContext.defaultParallelism, -(-splits // 3)) < splits
        found[3] = csv_source.read_uploaded_csv(spark, f"{tmp_path}/in").select("Container_ID", "HS_Code").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(found[3]) == sorted(found[1]) == sorted(found[1_000_000]) == sorted(map(tuple, rows.collect()))


def test_trained_queries_share_one_run_of_the_joins(spark, tmp_path, monkeypatch):
    folder = _tables(spark, tmp_path)
    runs = []
    plain = derived.shipments
    monkeypatch.setattr(derived, "shipments", lambda *where: runs.append(where) or plain(*where))
    monkeypatch.setattr(derived, "train_model", lambda df, *_, **__: df.count())
    derived.forget()
    trained, unique = derived.trained(spark, folder), derived.unique(spark, folder)
    assert len(runs) == 1 and trained == derived.declared(spark, folder).count() > unique.count() > 0
    derived.forget()


def test_cleaned_rows_to_score_are_moved_once(spark, tmp_path):
    folder = _tables(spark, tmp_path)
    derived.forget()
    rows = derived.unique(spark, folder)
    staged = []
    scored = jobs.score_rows_of(
        rows, testtables.ORDER, testtables.rule_columns, staging=lambda df, name: staged.append(name) or staging.stage(df, name)
    )
    assert staged == ["cleaned"] and scored.count() == derived.cleaned(spark, folder).count()
    assert "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()
    derived.forget()


def test_draws_of_the_forest_are_compiled(spark):
    rows = spark.range(500).select(F.concat(F.lit("C"), "id").alias("Container_ID"), F.col("id").cast("double").alias("a"))
    drawn = forest.draw_rows(rows, "Container_ID", 5, 10, 42, F.array("a"))
    assert "lambda" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    keep = F.filter(
        F.sequence(F.lit(0), F.lit(4)),
        lambda t: F.pmod(F.xxhash64("Container_ID", t.cast("long"), F.lit(43)), F.lit(500)) < int(10 * forest.OVERDRAW),
    )
    expected = rows.select(F.explode(keep).alias("tree"), "a", "Container_ID")
    expected = expected.select("tree", F.xxhash64("Container_ID", F.col("tree").cast("long"), F.lit(43)), F.array("a"))
    assert sorted(drawn.collect()) == sorted(map(tuple, expected.collect())) != []
