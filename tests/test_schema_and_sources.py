import glob
import io
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cargolens import constants as K
from cargolens.operators.cleaning import clean, reject_reasons, standardize
from cargolens.schema import SchemaError, header_mapping, missing_fields, normalize_columns, require_schema
from cargolens.sources import csv as source
from cargolens.sources import sinks
from cargolens.sources.records import inside_after
from cargolens.sources.store import BatchStore

HEADER = (
    "Container_ID,Declaration_Date (YYYY-MM-DD),Declaration_Time,"
    "Trade_Regime (Import / Export / Transit),Origin_Country,Destination_Port,Destination_Country,"
    "HS_Code,Importer_ID,Exporter_ID,Declared_Value,Declared_Weight,Measured_Weight,Shipping_Line,"
    "Dwell_Time_Hours"
)
ROWS = [
    "97061800,2020-01-01,20:16:40,Import,BE,PORT_30,UG,440890,A1,B1,372254.4,108.0,106.0,LINE_10,37.6, ",
    "",
    "34131149,2020-01-01,03:36:29,Import,NA,PORT_20,LV,071080,A2,B2,6364800.0,240.0,248.8,LINE_10,70.9",
    '11111111,bad,03:36:29,Import,N/A,PORT_20,LV,071080,A3,B3,"1,5",240.0,248.8,"LINE, ""X""",70.9,,',
]


def write(folder, *lines, name="a.csv"):
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(folder)


def test_header_mapping():
    found = header_mapping(["\ufeffcontainer-id", "Declared Value (USD)", "Trade_Regime (Import / Export / Transit)", "x"])
    assert found == {
        "\ufeffcontainer-id": "Container_ID",
        "Declared Value (USD)": "Declared_Value",
        "Trade_Regime (Import / Export / Transit)": "Trade_Regime",
    }


def test_missing_and_colliding_headers(spark):
    assert missing_fields(K.REQUIRED_COLUMNS) == []
    assert missing_fields(K.REQUIRED_COLUMNS[:-1]) == ["Missing required field: Dwell_Time_Hours"]
    with pytest.raises(SchemaError):
        normalize_columns(spark.createDataFrame([(1, 2)], ["HS_Code", "hs code"]))
    with pytest.raises(SchemaError):
        require_schema(spark.createDataFrame([(1,)], ["HS_Code"]))


def test_defensive_reader(spark, tmp_path):
    path = write(tmp_path, "\ufeff" + HEADER + ", ,", *ROWS)
    df = source.read_uploaded_csv(spark, path)
    assert [c for c in df.columns if c not in source.INGEST_COLUMNS] == [
        header_mapping([c]).get(c, c) for c in HEADER.split(",")
    ]
    rows = {r["Container_ID"]: r for r in standardize(df).collect()}
    assert len(rows) == 3
    assert rows["34131149"]["HS_Code"] == "071080"
    assert rows["34131149"]["Origin_Country"] == "NA"
    assert rows["11111111"]["Origin_Country"] is None
    assert rows["11111111"]["Declared_Value"] is None
    assert rows["11111111"]["Declaration_Date"] is None
    assert rows["11111111"]["Shipping_Line"] == 'LINE, "X"'
    assert rows["97061800"]["Dwell_Time_Hours"] == 37.6
    as_int = source.read_uploaded_csv(spark, path, hs_as_int=True)
    assert {r[0] for r in as_int.select("HS_Code").collect()} == {"440890", "71080"}


def test_reader_drops_blank_unnamed_columns(spark, tmp_path):
    df = source.read_uploaded_csv(spark, write(tmp_path, "a,,b,", "1,,2,", "3, ,4,"))
    assert [c for c in df.columns if c not in source.INGEST_COLUMNS] == ["a", "b"]


def test_reader_keeps_file_order_for_first_row(spark, tmp_path):
    write(tmp_path, HEADER, *[r.replace("97061800", "X") for r in ROWS[:1]], name="a.csv")
    write(tmp_path, HEADER, *[r.replace("34131149", "X") for r in ROWS[2:3]], name="b.csv")
    df = source.read_uploaded_csv(spark, str(tmp_path))
    kept = clean(df, source.INGEST_ORDER).collect()
    assert [(r["Container_ID"], r["Origin_Country"]) for r in kept] == [("X", "BE")]
    kept = clean(source.read_csv(spark, str(tmp_path)), source.INGEST_ORDER).collect()
    assert [(r["Container_ID"], r["Origin_Country"]) for r in kept] == [("X", "BE")]


def test_reader_takes_each_file_by_its_own_header(spark, tmp_path):
    write(tmp_path, "Container_ID,Declared_Value,Shipping_Line", "A,10,x", "A2,11,y,EXTRA", name="a.csv")
    write(tmp_path, "  ", "Declared_Value,Container_ID,HS_Code", "20,B,0101", "Declared_Value,Container_ID,HS_Code", name="b.csv")
    rows = {r["Container_ID"]: r for r in source.read_uploaded_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A", "A2", "B", "Container_ID"}
    assert (rows["B"]["Declared_Value"], rows["B"]["HS_Code"], rows["B"]["Shipping_Line"]) == ("20", "0101", None)
    assert (rows["A"]["ingest_surplus"], rows["A2"]["ingest_surplus"]) == (None, "EXTRA")


BROKEN = [
    "id,note,score",
    'a,"one\ntwo, ""three"",\n\n ,four",1',
    "",
    'b,5" pipe,2',
    'c,"x""y",3',
    'd,"\n",4,',
    'e,plain,5',
    'f,"ends, here",6',
    'g,"""\n""\n""",7',
]


def pandas_rows(text):
    lines = [re.sub(r"(,\s*)+$", "", line) for line in text.splitlines()]
    df = pd.read_csv(io.StringIO("\n".join(lines)), index_col=False, dtype=str, keep_default_na=False)
    return sorted(tuple(x or None if isinstance(x, str) else None for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("size", [7, 16, 40, 1 << 20])
def test_quoted_line_breaks_at_any_split_border(spark, tmp_path, size):
    """Every split border falls somewhere in a record; the rows are those of a reader of whole files."""
    text = "\n".join(BROKEN) + "\n"
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text(text.replace("\n", "\r\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = source.read_uploaded_csv(spark, str(tmp_path), null_tokens=[""])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = df.collect()
    found = sorted((r["id"], r["note"], r["score"]) for r in rows)
    assert found == sorted(2 * pandas_rows(text))
    assert all(r["ingest_surplus"] is None for r in rows)
    ids = [r["id"] for r in sorted(rows, key=lambda r: tuple(r[c] for c in source.INGEST_ORDER))]
    assert ids == 2 * list("abcdefg")


def test_line_states_follow_a_reader_of_characters():
    rng = random.Random(7)

    def plain(line, inside):
        state = "quoted" if inside else "begin"
        for c in line:
            if state == "quoted":
                state = "closed" if c == '"' else "quoted"
            elif c == ",":
                state = "begin"
            elif c == '"' and state in ("begin", "closed"):
                state = "quoted"
            else:
                state = "plain"
        return state == "quoted"

    for _ in range(20_000):
        line = "".join(rng.choices('",ab', k=rng.randrange(9)))
        for inside in (False, True):
            assert inside_after(line, inside) == plain(line, inside), (line, inside)
    assert inside_after('a,"' + '""' * 100_000, False)


def test_header_over_two_lines_and_open_quotes(spark, tmp_path):
    write(tmp_path, '\ufeff"Container\n_ID",Declared_Value', 'A,"1\n"', name="a.csv")
    df = source.read_uploaded_csv(spark, str(tmp_path))
    assert [r["Declared_Value"] for r in df.collect()] == ["1\n"]
    write(tmp_path, "Container_ID", 'A,"1', name="b.csv")
    with pytest.raises(SchemaError, match="not closed"):
        source.read_uploaded_csv(spark, str(tmp_path))
    plain = source.read_csv(spark, write(tmp_path, "x,y", '1,"a, \nb"', name="c.csv") + "/c.csv", line_breaks=True)
    assert [(r["x"], r["y"]) for r in plain.collect()] == [("1", "a, \nb")]


def test_many_headers_are_one_scan(spark, tmp_path):
    for i, names in enumerate(["a,b", "b,a,c", "c", "d.e,a"]):
        write(tmp_path, names, ",".join(str(10 * i + k) for k in range(names.count(",") + 1)), name=f"{i}.csv")
    df = source.read_uploaded_csv(spark, str(tmp_path))
    rows = {tuple(r[c] for c in ("a", "b", "c", "d_e")) for r in df.collect()}
    assert rows == {("0", "1", None, None), ("11", "10", "12", None), (None, None, "20", None), ("31", None, None, "30")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the rows, and the first line of each file
    assert plan.count("Relation [") <= 2 and "Union" not in plan


def test_surplus_fields_are_a_reject_reason(spark, tmp_path):
    path = write(tmp_path, HEADER, *ROWS[:2], ROWS[2].rstrip(", ") + ",1,2,3,4,5,6,7,8")
    df = standardize(source.read_uploaded_csv(spark, path))
    reasons = [r["reject_reason"] for r in reject_reasons(df, source.INGEST_ORDER, {}, unique_order=True).collect()]
    assert sorted(map(str, reasons)) == ["None", "surplus_fields"]


def test_row_numbers_follow_the_file(spark, tmp_path):
    write(tmp_path, "id,score", ",1", "", ",2", "X,3", ",4", name="a.csv")
    write(tmp_path, "score", "5", "6", name="b.csv")
    rows = source.read_scored_csv(spark, str(tmp_path)).orderBy("score").collect()
    assert [r["id"] for r in rows] == ["ROW_1", "ROW_2", "X", "ROW_4", "ROW_1", "ROW_2"]


def test_scored_file_aliases(spark, tmp_path):
    path = write(tmp_path, "id,Risk_Score,level,origin,dw,expl", "A,12.5,High,CN,3,", ",x,,,,text")
    rows = source.read_scored_csv(spark, path).orderBy("score").collect()
    assert rows[0]["id"] == "ROW_2" and rows[0]["level"] == "Low" and rows[0]["score"] == 0.0
    assert rows[0]["expl"] == "text" and rows[0]["origin"] == "N/A"
    assert (rows[1]["id"], rows[1]["score"], rows[1]["level"], rows[1]["dw"]) == ("A", 12.5, "High", 3.0)
    assert rows[1]["expl"] == K.TEXT_NO_EXPLANATION and rows[1]["line"] == "N/A"


def test_canonical_rewrite(spark, tmp_path):
    df = spark.createDataFrame([("C1", 'a "b", c', None)], "Container_ID string, Shipping_Line string, is_risky int")
    sinks.write_canonical_csv(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "out" / "*.csv")))
    header, row = text.strip().split("\n")
    assert header == ",".join(K.REQUIRED_COLUMNS + ["is_risky"])
    assert row.startswith("C1,,") and '"a ""b"", c"' in row


def test_batch_store_replaces_one_batch(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    df = spark.createDataFrame([("a", "High"), ("b", "Low")], "container_id string, risk_level string")
    store.write_predictions(df, "one")
    store.write_predictions(df, "two")
    store.write_predictions(df.limit(1), "one")
    assert store.predictions("one").count() == 1
    assert store.predictions("two").count() == 2
    plan = store.by_level("two", "High")
    assert plan.count() == 1 and len(plan.inputFiles()) <= 2
    with pytest.raises(ValueError):
        store.by_level("two", "Odd")


def test_select_ids(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "container_id string")
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "x string")
    assert [r[0] for r in sinks.select_ids(df, ids).collect()] == ["a"]


def test_records(spark):
    df = source.from_records(spark, [{"container_id": "A", "declared_value": 5}, {"container_id": None}])
    assert set(df.columns) == {"Container_ID", "Declared_Value", "ingest_seq"}
    assert df.where(F.col("Container_ID").isNull()).count() == 1
