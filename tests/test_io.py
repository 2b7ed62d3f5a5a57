import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quillon.cli import Shell, render
from quillon.harness import append_json_line, compare_materialisation, markdown, measure, write_csv, write_json
from quillon.session import Engine
from quillon.sources import arrow_to_table, read_arrow, read_csv, spans_lines, table_to_arrow, write_arrow

SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("big", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])
TEXT = 'id,big,x,s\n1, 10 ,1.5,"a ""q"" b"\n2,,2.5,"two\nlines"\nbad,30,3.5,c\n4,40,oops,d\n5,50\n6,60,6.5,f,extra\n ,70,7.5,  trimmed  \n8,80.5,1e3,h\n'


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "t.csv").write_text(TEXT)
    return str(tmp_path / "t.csv")


def test_csv_rows_and_errors(spark, csv):
    got = read_csv(spark, csv, SCHEMA)
    assert sorted(map(tuple, got.rows.collect()), key=lambda r: (r[0], r[1] or 0)) == [
        (0, 30, 3.5, "c"), (0, 70, 7.5, "trimmed"), (1, 10, 1.5, 'a "q" b'), (2, None, 2.5, "two\nlines"), (4, 40, None, "d"), (8, None, 1000.0, "h")]
    errors = [(e["col_name"], e["message"]) for e in got.errors.collect()]
    assert errors.count((None, "wrong number of fields")) == 2 and ("x", "not of type double") in errors and ("big", "not of type bigint") in errors and len(errors) == 6
    assert got.rows.count() == 6 and got.rows.select("s").count() == 6 and got.rows.select("x").agg({"x": "max"}).first()[0] == 1000.0
    assert got.has_errors() and read_csv(spark, csv, SCHEMA, max_errors=2).errors.count() == 2


def test_csv_errors_name_their_place(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    bad = {"a": (3, 700, 1999), "b": (1, 2, 1500)}
    for name, at in bad.items():
        lines = ["id,big,x,s", *(f"{i},{'no' if i in at else i},{i}.5,{'w' * 20}" for i in range(1, 2001))]
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = read_csv(spark, str(folder), SCHEMA)
        assert got.rows.rdd.getNumPartitions() > 4 and got.rows_parsed() == 4000
        errors = [(e["file"][-5], e["row"], e["col"], e["col_name"]) for e in got.errors.collect()]
        assert errors == [(n, i, 1, "big") for n, at in bad.items() for i in at]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert not spans_lines(spark, str(folder))
    (folder / "c.csv").write_text(TEXT)
    assert spans_lines(spark, str(folder)) and read_csv(spark, str(folder / "c.csv"), SCHEMA).errors.first()["row"] == 3


def test_csv_strict(spark, csv, tmp_path):
    with pytest.raises(Exception, match="not of type|wrong number of fields|isn't nullable"):
        read_csv(spark, csv, SCHEMA, strict=True).rows.collect()
    (tmp_path / "ok.csv").write_text("1;2;3.5;x\n")
    assert read_csv(spark, str(tmp_path / "ok.csv"), SCHEMA, delimiter=";", header=False, strict=True).rows.first() == (1, 2, 3.5, "x")


def test_arrow_tables(spark):
    table = pa.table({"lot": pa.array([(i * i) % 31 for i in range(24)], pa.int32()), "weight": pa.array([None, *range(100, 123)], pa.int64()), "ratio": [1 / (i + 1) for i in range(24)], "mark": ["x", None, "Größe"] * 8})
    df = arrow_to_table(spark, table)
    assert df.dtypes == [("lot", "int"), ("weight", "bigint"), ("ratio", "double"), ("mark", "string")]
    assert table_to_arrow(df).equals(table.cast(table_to_arrow(df).schema))
    with pytest.raises(TypeError):
        arrow_to_table(spark, pa.table({"t": pa.array([1], pa.timestamp("us"))}))


def test_arrow_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("cast(id as int) as a", "id * 2 as b", "id / 3 as c", "if(id % 7 = 0, null, cast(id as string)) as d").repartition(3)
    write_arrow(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_arrow(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
    with pa.OSFile(str(tmp_path / "s.arrows"), "wb") as f, pa.ipc.new_stream(f, pa.schema([("x", pa.int64())])) as w:
        for i in range(3):
            w.write_batch(pa.record_batch({"x": [i, i + 10]}))
    assert sorted(r[0] for r in read_arrow(spark, str(tmp_path / "s.arrows")).collect()) == [0, 1, 2, 10, 11, 12]
    with pytest.raises(Exception, match="missing"):
        read_arrow(spark, str(tmp_path / "missing")).count()


def test_arrow_overwrite_and_unfinished_files(spark, tmp_path):
    path = str(tmp_path / "t")
    for mode, want in (("append", 5), ("append", 10), ("overwrite", 5)):
        write_arrow(spark.range(5), path, mode)
        assert read_arrow(spark, path).count() == want
    (tmp_path / "t" / "part-x.arrow.tmp").write_bytes(b"what a lost attempt left")
    assert read_arrow(spark, path).count() == 5


def test_shell(spark, tmp_path):
    said = []
    (tmp_path / "sales.csv").write_text("region,revenue\nN,1.5\nS,2.5\nN,3\n")
    shell = Shell(Engine(spark), said.append)
    for line in (f"LOAD {tmp_path}/sales.csv AS sales", "TABLES", "SELECT region, SUM(revenue) AS r FROM sales GROUP BY region ORDER BY region;", "EXPLAIN SELECT region FROM sales", "DEVICES", "SELECT nope FROM sales", "WHAT", "", "LOAD x"):
        assert shell.run(line)
    text = "\n".join(said)
    assert "3 rows, 2 columns" in text and "sales: 3 rows, columns region, revenue" in text and "N            | 4.500000" in text
    assert "error: no column nope" in text and "unknown command WHAT" in text and "parallelism" in text
    assert not shell.run("exit")
    assert render(spark.range(0).toDF("x")) == "(empty result)" and "... and 5 more rows" in render(spark.range(25).toDF("x"))


def test_materialisation_is_compared(spark):
    df = spark.range(1000).selectExpr("id", "id / 10.0 as x")
    assert [m.name for m in compare_materialisation(df, "id", "x", 90.0, 0, 1)] == ["full", "late"]


def test_reports(tmp_path):
    m = measure(lambda: sum(range(1000)), "q", 1, 10, rows=1000)
    assert m.mean > 0 and m.rows_per_second > 0 and "| q | 10 |" in markdown([m])
    write_csv([m], str(tmp_path / "a.csv"))
    write_json([m], str(tmp_path / "a.json"))
    append_json_line(m, str(tmp_path / "a.jsonl"))
    append_json_line(m, str(tmp_path / "a.jsonl"))
    assert len((tmp_path / "a.jsonl").read_text().splitlines()) == 2 and (tmp_path / "a.csv").read_text().startswith("name,runs")
