"""Contract reader: parallel numbering, rejects with reasons, provenance."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.contract import conform, numbered_lines, read_contract
from millrace.sources.tables import file_digests

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("n", T.IntegerType()), T.StructField("d", T.DateType()), T.StructField("t", T.StringType())])
HEADER = "id,n,d,t\n"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_in_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    want = set()
    for name, blank in (("a.csv", 0.0), ("b.csv", 0.2), ("c.csv", 0.0)):
        number, out = 0, []
        for k in range(700 if name != "c.csv" else 3):
            if rng.random() < blank:
                out.append(rng.choice(["", "  ", "\t"]))
                out[-1] = out[-1].replace("\t", " ")
            else:
                number += 1
                out.append(f"{name} {k} {'x' * rng.randrange(60)}")
                want.add((out[-1], name, number))
        (tmp_path / name).write_text("\n".join(out) + "\n")
    got = numbered_lines(spark, str(tmp_path))
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_bad_rows_are_rejected_with_their_reasons(spark, tmp_path):
    lines = ["1,2,2024-04-01, a ", "x,2,2024-04-01,b", ",3,,c", "4,5.5,2024-13-01,d", '5,6,2024-01-02,"e, f"', "6,7", "7,8,2024-01-02,g,h", '8,9,2024-01-02,"open', "9,99999999999,,", "10,,,"]
    (tmp_path / "t.csv").write_text(HEADER + "\n".join(lines) + "\n")
    digests = file_digests(spark, str(tmp_path), "*.csv").select("name", "sha256")
    reading = read_contract(spark, str(tmp_path / "t.csv"), SCHEMA, "run-1", digests)
    sha = hashlib.sha256((HEADER + "\n".join(lines) + "\n").encode()).hexdigest()
    rows = sorted(reading.rows.collect())
    assert [(r.id, r.n, str(r.d), r.t, r.source_row_number) for r in rows] == [(1, 2, "2024-04-01", "a", 2), (5, 6, "2024-01-02", "e, f", 6), (10, None, "None", None, 11)]
    assert {(r.source_file_name, r.ingestion_run_id, r.source_checksum) for r in rows} == {("t.csv", "run-1", sha)}
    bad = {r.source_row_number: (r.raw_line, r.reasons) for r in reading.rejects.collect()}
    assert {k: v[1] for k, v in bad.items()} == {3: "id:bigint", 4: "id:missing", 5: "n:int;d:date", 7: "width", 8: "width", 9: "open_quote", 10: "n:int"}
    assert all(bad[k][0] == lines[k - 2] for k in bad)


def test_every_file_has_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeff" + HEADER + "1,2,,\r\n")
    (tmp_path / "b.csv").write_text(HEADER)
    assert [(r.id, r.source_row_number) for r in read_contract(spark, str(tmp_path), SCHEMA, "r").rows.collect()] == [(1, 2)]
    (tmp_path / "b.csv").write_text("id,other\n1,2\n")
    with pytest.raises(Exception, match="b.csv"):
        read_contract(spark, str(tmp_path), SCHEMA, "r").rows.collect()


def test_conform_keeps_other_columns(spark):
    got = conform(spark.createDataFrame([("1;2;;z", "k")], "raw string, broken string"), SCHEMA, "raw", ";").first()
    assert got.broken == "k" and got.record.id == 1 and got.record.t == "z" and got.problems == []
