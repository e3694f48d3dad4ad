"""Readers and their errors."""

import pytest

from tablewright.sources.records import lines_of, records
from tablewright.sources.reports import write_csv
from tablewright.sources.tables import SourceError, coerce_numeric, read_csv, read_csv_tolerant


def test_missing_file(spark, tmp_path):
    with pytest.raises(SourceError) as e:
        read_csv(spark, str(tmp_path / "nothing.csv"))
    assert e.value.reason == "not_found"


def test_types_come_from_the_head(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name,value\n1,"Doe, J",2.5\n2,x,\n')
    rows = read_csv(spark, str(path))
    assert dict(rows.dtypes) == {"id": "int", "name": "string", "value": "double"}
    assert rows.orderBy("id").first()["name"] == "Doe, J"


def test_tolerant_reader_drops_blank_lines_and_extra_quotes(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('id,name\n1,""a,b""\n   \n2,"""c,d"""\n')
    rows = {r["id"]: r["name"] for r in read_csv_tolerant(spark, str(path)).collect()}
    assert rows == {1: "a,b", 2: "c,d"}


def test_late_values_widen_types(spark, tmp_path):
    """Nothing after the rows that types are guessed from is lost."""
    path = tmp_path / "late.csv"
    body = [f"{i},{i},{i},true" for i in range(1500)] + ["1500,3.75,5000000000,false", "1501,7,8,maybe", "abc,,,"]
    path.write_text("a,b,c,d\n" + "\n".join(body) + "\n")
    rows = read_csv(spark, str(path))
    assert dict(rows.dtypes) == {"a": "string", "b": "double", "c": "bigint", "d": "string"}
    assert rows.count() == 1503 and rows.where("b = 3.75").count() == 1 and rows.where("a = 'abc'").count() == 1
    assert rows.where("d = 'maybe'").count() == 1


def test_line_breaks_survive(spark, tmp_path):
    table = spark.createDataFrame([(1, 'a\nb "c", d'), (2, "\n"), (3, None)], "id int, text string")
    write_csv(table, str(tmp_path / "out"))
    back = {r["id"]: r["text"] for r in read_csv(spark, str(tmp_path / "out")).collect()}
    assert back == {1: 'a\nb "c", d', 2: "\n", 3: None}


def test_tolerant_reader_judges_all_lines(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("id,name\n" + "".join(f"{i},n\n" for i in range(1500)) + 'id,name\n1500,""x,y""\n')
    rows = read_csv_tolerant(spark, str(path))
    found = [tuple(r) for r in rows.where("name <> 'n'").collect()]
    assert sorted(found) == [("1500", "x,y"), ("id", "name")] and rows.count() == 1502


def test_coercion_refuses_lost_values(spark):
    rows = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(ValueError, match="v \\(1 values\\)"):
        coerce_numeric(rows, ["v"])
    with pytest.raises(ValueError, match="missing features"):
        coerce_numeric(rows, ["w"])


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if value is not None else ""


@pytest.mark.parametrize("size", [23, 400])
def test_records_are_cut_at_any_border(spark, tmp_path, size):
    """Values with breaks, quotes and commas, in splits far smaller than a record, against the csv module."""
    import csv
    import random

    rng = random.Random(size)
    for number in range(3):
        rows = [[str(i), "".join(rng.choices('ab,"\n ', k=rng.choice([0, 1, 3, 40]))), rng.choice(["plain", 'in"side', 'x "y" z', "é"])] for i in range(60)]
        body = ["id,text,word", *[",".join([r[0], quoted(r[1]), r[2]]) for r in rows]]
        (tmp_path / f"{number}.csv").write_bytes("\n".join(body).encode() + b"\n" * number)
    want = []
    for number in range(3):
        with open(tmp_path / f"{number}.csv", newline="", encoding="utf-8") as f:
            want += list(csv.reader(f))[1:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        lines = lines_of(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 3
        found = records(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r["value"] for r in found if r["header"]] == ["id,text,word"] * 3
    got = [next(csv.reader([r["value"]], strict=False)) if "\n" not in r["value"] else next(csv.reader(r["value"].splitlines(keepends=True))) for r in found if not r["header"]]
    assert sorted(got) == sorted(r for r in want if r)


def test_broken_lines_are_read_in_as_many_tasks(spark, tmp_path):
    """A value with a line break neither changes the number of tasks nor the rows."""
    body = [(i, f"line {i}\nand more, \"{i}\"", i * 0.5) for i in range(4000)]
    (tmp_path / "t.csv").write_text("id,text,half\n" + "".join(f"{i},{quoted(t)},{h}\n" for i, t, h in body))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = read_csv(spark, str(tmp_path / "t.csv"))
        assert dict(rows.dtypes) == {"id": "int", "text": "string", "half": "double"}
        assert records(lines_of(spark, str(tmp_path / "t.csv"))).rdd.getNumPartitions() > 5
        assert sorted(tuple(r) for r in rows.collect()) == body
        assert sorted(tuple(r) for r in read_csv_tolerant(spark, str(tmp_path / "t.csv")).collect()) == body
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_carriage_returns_and_stray_quotes(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes(b'id,a,b\r\n1,5" pipe,"x\r\ny"\r\n\r\n2,say "hi",z\r\n3,,"q ""r"""\r\n')
    got = {r["id"]: (r["a"], r["b"]) for r in read_csv(spark, str(path)).collect()}
    assert got == {1: ('5" pipe', "x\r\ny"), 2: ('say "hi"', "z"), 3: (None, 'q "r"')}


def test_tolerant_reader_keeps_line_breaks_beside_extra_quotes(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('id,name\n1,"two\nlines"\n\n2,""x,y""\n3,plain\n')
    got = {r["id"]: r["name"] for r in read_csv_tolerant(spark, str(path)).collect()}
    assert got == {1: "two\nlines", 2: "x,y", 3: "plain"}
