import datetime as dt
import os
import tempfile
import time

import pytest

from conftest import rows
from meterframe.sources import readers as rd
from meterframe.sources import sinks as sk
from meterframe.streaming.uploads import start_upload_ingest

D = dt.date
HEADER = "chargedate,meterid,loc,res,kwh,ghc,paymoney\n"


def _write(path, body, mtime=None):
    with open(path, "w") as f:
        f.write(HEADER + body)
    if mtime:
        os.utime(path, (mtime, mtime))


def test_allowed_file():
    assert rd.allowed_file("a.CSV") and rd.allowed_file("x.b.csv")
    assert not rd.allowed_file("a.txt") and not rd.allowed_file("csv")


def test_upload_ingest_replaces_table(spark):
    d = tempfile.mkdtemp(prefix="mf-upload-")
    _write(os.path.join(d, "u1.csv"), "05-Jan-20,1,A,N-Resid [0],1,2,3\n")
    version = sk.ingest_upload(spark, os.path.join(d, "u1.csv"), "t_up.sales")
    assert rows(spark.table("t_up.sales"), "chargedate", "meterid", "res_mapped") == [(D(2020, 1, 5), 1, "Commercial")]
    assert spark.table("t_up.sales").columns[0] == "chargedate"  # date moved first
    with pytest.raises(ValueError):
        sk.ingest_upload(spark, os.path.join(d, "u1.txt"), "t_up.sales")
    where = spark.sql(f"DESCRIBE TABLE EXTENDED {version}").filter("col_name = 'Location'").first()["data_type"]
    assert spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") in where


def test_replace_keeps_old_table_when_validation_fails(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1)], "chargedate date, meterid bigint")
    sk.replace_table(spark, df, "t_keep.sales")
    bad = spark.createDataFrame([(1,)], "meterid bigint")
    with pytest.raises(ValueError):
        sk.replace_table(spark, bad, "t_keep.sales")
    assert spark.table("t_keep.sales").count() == 1
    with pytest.raises(FileNotFoundError):
        sk.rebuild_from_csv(spark, tempfile.mkdtemp(prefix="mf-empty-"), "t_keep.sales")
    assert spark.table("t_keep.sales").count() == 1
    assert "sales" in rd.list_tables(spark, "t_keep") and rd.table_exists(spark, "t_keep.sales")


def test_quoted_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok', 1)], "loc string, meterid bigint")
    out = str(tmp_path / "export")
    sk.export_csv(df, out, single_file=True, quote_all=True)
    text = open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")][0]).read()
    assert '"say ""hi"", ok"' in text and '"1"' in text
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert rows(back) == [('say "hi", ok', "1")]


def test_load_first_and_parameterized_sql(spark):
    from pyspark.sql import types as T

    empty = T.StructType([T.StructField("x", T.IntegerType())])
    assert rd.load_first(spark, [lambda: spark.table("nope.nope")], empty).count() == 0
    got = rd.run_query(spark, "SELECT ? + 1 AS v, ? AS s", [41, "it's"]).collect()[0]
    assert (got.v, got.s) == (42, "it's")
    many = rd.run_query(spark, "SELECT " + ", ".join(f"? AS c{i}" for i in range(12)) + ", '?' AS q, \"a?\" AS r", range(12)).first()
    assert list(many) == [*range(12), "?", "a?"]
    with pytest.raises(ValueError):
        rd.run_query(spark, "SELECT ?, ?", [1])


def test_streaming_upload_ingest_latest_upload_wins(spark):
    d = tempfile.mkdtemp(prefix="mf-stream-")
    now = time.time()
    _write(os.path.join(d, "a.csv"), "05-Jan-20,1,A,N-Resid [0],1,2,3\n06-Jan-20,2,A,Resid [1],4,5,6\n", now - 20)
    _write(os.path.join(d, "b.csv"), "07-Feb-21,9,B,Resid [1],7,8,x\n", now - 10)
    _write(os.path.join(d, "ignored.txt"), "not,a,csv\n", now - 5)
    q = start_upload_ingest(spark, d, "t_stream.sales")
    q.awaitTermination(120)
    assert q.exception() is None
    got = rows(spark.table("t_stream.sales"), "chargedate", "meterid", "paymoney", "res_mapped")
    assert got == [(D(2021, 2, 7), 9, None, "Residential")]


def test_rebuild_from_csv_parses_dates_only(spark):
    d = tempfile.mkdtemp(prefix="mf-rebuild-")
    _write(os.path.join(d, "a.csv"), "05-Jan-20,1,A,N-Resid [0],1,2,3\n05-Jan-20,1,A,N-Resid [0],1,2,3\n")
    _write(os.path.join(d, "b.CSV"), "bad,2,B,Resid [1],4,,6\n")
    _write(os.path.join(d, "skip.txt"), "x\n")
    sk.rebuild_from_csv(spark, d, "t_rebuild.sales")
    t = spark.table("t_rebuild.sales")
    assert t.columns[0] == "chargedate"
    got = sorted(rows(t, "meterid", "chargedate", "ghc"))
    # no dedupe and no null drop on a rebuild (only the date is normalised)
    assert got == [(1, D(2020, 1, 5), 2.0), (1, D(2020, 1, 5), 2.0), (2, None, None)]


def test_source_csv_layout_round_trip(spark):
    df = spark.createDataFrame([(D(1995, 3, 4), 7, 1.5)], "chargedate date, meterid bigint, kwh double")
    text = sk.to_source_csv_layout(df)
    assert rows(text) == [("04-Mar-95", "7", "1.5")]
    from meterframe.operators.clean import preprocess

    back = preprocess(rd.type_ids(text))
    assert rows(back, "chargedate", "meterid", "kwh") == [(D(1995, 3, 4), 7, 1.5)]


def test_export_filtered(spark, tmp_path):
    from meterframe.operators.filters import FilterParams

    df = spark.createDataFrame([(D(2020, 1, 1), 1, "A"), (D(2020, 2, 1), 2, "B")], "chargedate date, meterid bigint, loc string")
    path = sk.export_filtered(df, FilterParams(selections={"loc": ["B"]}), str(tmp_path))
    assert os.path.basename(path).startswith("meter_export_") and path.endswith("Z.csv")
    back = spark.read.option("header", True).csv(path)
    assert rows(back) == [("2020-02-01", "2", "B")]


def test_refresh_from_uri(spark, tmp_path):
    src = str(tmp_path / "export.parquet")
    spark.createDataFrame(
        [("05-Jan-20", 1, "A", "Resid [1]", "1", "2", "3")],
        "chargedate string, meterid bigint, loc string, res string, kwh string, ghc string, paymoney string",
    ).write.parquet(src)
    assert sk.refresh_from_uri(spark, src, "t_refresh.sales") is True
    assert rows(spark.table("t_refresh.sales"), "chargedate", "res_mapped", "kwh") == [(D(2020, 1, 5), "Residential", 1.0)]
    assert sk.refresh_from_uri(spark, str(tmp_path / "missing.parquet"), "t_refresh.sales") is False
    assert spark.table("t_refresh.sales").count() == 1


def test_streaming_ingest_deletes_processed_uploads(spark):
    d = tempfile.mkdtemp(prefix="mf-clean-")
    now = time.time()
    _write(os.path.join(d, "a.csv"), "05-Jan-20,1,A,N-Resid [0],1,2,3\n", now - 20)
    _write(os.path.join(d, "b.csv"), "06-Jan-20,2,B,Resid [1],4,5,6\n", now - 10)
    q = start_upload_ingest(spark, d, "t_clean.sales", delete_source=True)
    q.awaitTermination(120)
    assert q.exception() is None
    # the earlier upload is gone; the latest one is removed by the next batch
    assert sorted(os.listdir(d)) == ["b.csv"]
    assert rows(spark.table("t_clean.sales"), "meterid") == [(2,)]


def test_partitioned_replace_keeps_its_rows(spark):
    df = spark.createDataFrame([(D(2020 + k % 3, 1, 1), k, 2020 + k % 3) for k in range(30)], "chargedate date, meterid bigint, year int")
    for analyze in (False, True):
        version = sk.replace_table(spark, df, "t_part.sales", partition_by=["year"], analyze=analyze)
        t = spark.table("t_part.sales")
        assert t.columns == df.columns and sorted(rows(t)) == sorted(rows(df))
        assert t.filter("year = 2021").count() == 10
    # Another schema and layout behind the same name; old versions go on request only.
    sk.replace_table(spark, df.drop("year"), "t_part.sales")
    assert spark.table("t_part.sales").columns == ["chargedate", "meterid"]
    assert spark.table(version).count() == 30
    last = sk.replace_table(spark, df, "t_part.sales")
    sk.drop_old_versions(spark, "t_part.sales", last)
    # The list also names the session's temporary views.
    assert sorted(t for t in rd.list_tables(spark, "t_part") if t.startswith("sales")) == sorted(["sales", last.split(".")[1]])
    assert spark.table("t_part.sales").count() == 30


@pytest.mark.parametrize("step", ["point", "analyze_table"])
def test_failed_replace_keeps_the_old_rows(spark, monkeypatch, step):
    df = spark.createDataFrame([(D(2020, 1, 1), 1)], "chargedate date, meterid bigint")
    sk.replace_table(spark, df, "t_fail.sales")
    monkeypatch.setattr(sk, step, lambda *a: (_ for _ in ()).throw(RuntimeError("catalog is down")))
    with pytest.raises(RuntimeError):
        sk.replace_table(spark, df.union(df), "t_fail.sales")
    assert spark.table("t_fail.sales").count() == 1


def test_csv_columns_are_matched_by_header(spark):
    d = tempfile.mkdtemp(prefix="mf headers-")
    for name, text in (("a.csv", "chargedate,meterid\n05-Jan-20,1\n"), ("b.csv", "meterid,chargedate\n2,06-Jan-20\n"), ("c.csv", "loc,meterid\nX,3\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    got = sorted(rows(rd.read_csv(spark, d), "meterid", "chargedate", "loc"))
    assert got == [("1", "05-Jan-20", None), ("2", "06-Jan-20", None), ("3", None, "X")]


def test_header_groups_are_the_same_by_either_way(spark, tmp_path, monkeypatch):
    """Line ends, blank first lines, an empty file and a name with spaces: one read by header, one by lines."""
    for name, text in (
        ("a b.csv", "x,y\r\n1,2\r\n"), ("b.csv", "y,x\n4,3\n"), ("c%1.csv", "\n\nx,y\n5,6\n"), ("d.csv", "z\n7"), ("0.CSV", ""),
    ):
        (tmp_path / name).write_bytes(text.encode())
    want = [("1", "2", None), ("3", "4", None), ("5", "6", None), (None, None, "7")]
    key = lambda r: str(r)
    assert sorted(rows(rd.read_csv(spark, str(tmp_path)), "x", "y", "z"), key=key) == want
    monkeypatch.setattr(rd.headers, "can_open", lambda f: False)
    assert sorted(rows(rd.read_csv(spark, str(tmp_path)), "x", "y", "z"), key=key) == want


def test_header_needs_only_the_start_of_a_file(spark, tmp_path):
    import io

    from meterframe.sources import headers

    long = io.BytesIO(b"\r\n \n" + b"c" * 40_000 + b",d\r\n" + b"1,2\n" * 1_000_000)
    assert headers.first_line(long) == "c" * 40_000 + ",d" and long.tell() <= 4 * headers.CHUNK_BYTES
    assert [headers.first_line(io.BytesIO(b)) for b in (b"", b"\n\n", b"a,b", "ö\r1".encode())] == ["", "", "a,b", "ö"]
    files = []
    for k in range(300):
        (tmp_path / f"{k}.csv").write_text(f"h{k % 3}\n" + "1\n" * 9)
        files.append((tmp_path / f"{k}.csv").as_uri())
    got = headers.header_lines(spark, files)
    assert got.rdd.getNumPartitions() > 1
    assert sorted(r["header"] for r in got.collect()) == sorted(f"h{k % 3}" for k in range(300))
    assert not headers.can_open("wasbs://a@b/c.csv") and headers.can_open("s3a://b/c.csv")


def test_only_missing_sources_are_passed_over(spark, tmp_path):
    from pyspark.sql import types as T

    empty = T.StructType([T.StructField("x", T.IntegerType())])
    assert rd.load_first(spark, [lambda: spark.read.parquet(str(tmp_path / "none"))], empty).count() == 0

    def broken():
        raise ConnectionError("store unreachable")

    with pytest.raises(ConnectionError):
        rd.load_first(spark, [broken, lambda: spark.range(1)], empty)
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet|magic"):
        sk.refresh_from_uri(spark, str(tmp_path / "bad.parquet"), "t_bad.sales")


def test_rewritten_inputs_are_read_again(spark, tmp_path):
    """The billing table and the category codes follow the files, not the path."""
    from meterframe.operators import features as ft
    from meterframe.sources import adapters

    def write(nation):
        for name, df in (
            ("orders", spark.createDataFrame([(1, 1, D(2020, 1, 1)), (2, 2, D(2020, 2, 1))], "o_orderkey long, o_custkey long, o_orderdate date")),
            ("lineitem", spark.createDataFrame([(1, 1.0, 2.0, 0.0)], "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double")),
            ("customer", spark.createDataFrame([(1, 1, "BUILDING"), (2, 2, "MACHINERY")], "c_custkey long, c_nationkey long, c_mktsegment string")),
            ("nation", spark.createDataFrame([(1, nation), (2, "Z")], "n_nationkey long, n_name string")),
        ):
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))

    def codes():
        s = adapters.sales_table(spark, str(tmp_path))
        f = ft.build_features(s, drop_incomplete=False)
        return dict(rows(f, "loc", "loc_enc"))

    write("A")
    assert codes() == {"A": 0, "Z": 1} and codes() == {"A": 0, "Z": 1}
    write("ZZ")
    assert codes() == {"Z": 0, "ZZ": 1}


def test_scratch_folder_must_be_shared_on_a_cluster():
    from meterframe import session

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), {}

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    for master, ok in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False), ("yarn", False)):
        s = Session(master)
        s.conf = Conf()
        if ok:
            assert os.path.isdir(session.scratch_dir(s))
        else:
            with pytest.raises(RuntimeError):
                session.scratch_dir(s)


def _some(spark, n):
    return spark.createDataFrame([(dt.date(2020, 1, 1 + i), i, "a", "b", float(i), 1.0, 2.0) for i in range(n)], "chargedate date, meterid bigint, loc string, res string, kwh double, ghc double, paymoney double")


def test_replace_of_a_real_table_with_retention_and_rollback(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS t_real")
    _some(spark, 1).write.saveAsTable("t_real.sales")
    made = [sk.replace_table(spark, _some(spark, n), "t_real.sales", clean=False, keep=3) for n in (2, 3)]
    assert spark.table("t_real.sales").count() == 3
    known = sk.versions(spark, "t_real.sales")
    assert len(known) == 3 and known[1:] == made and spark.table(known[0]).count() == 1
    assert sk.current_version(spark, "t_real.sales") == made[-1]
    made += [sk.replace_table(spark, _some(spark, n), "t_real.sales", clean=False, keep=3) for n in (4, 5)]
    assert sk.versions(spark, "t_real.sales") == made[1:]
    assert sk.rollback(spark, "t_real.sales") == made[2] and spark.table("t_real.sales").count() == 4
    assert sk.rollback(spark, "t_real.sales", made[1]) == made[1] and spark.table("t_real.sales").count() == 3
    with pytest.raises(ValueError, match="no version before"):
        sk.rollback(spark, "t_real.sales")
    with pytest.raises(ValueError, match="is no version"):
        sk.rollback(spark, "t_real.sales", "t_real.other")
    # A replace after a rollback gets a new number, and the version that is read is never dropped.
    last = sk.replace_table(spark, _some(spark, 6), "t_real.sales", clean=False, keep=1)
    assert sk.versions(spark, "t_real.sales") == [last] and spark.table("t_real.sales").count() == 6


@pytest.mark.parametrize("start", ["table", "view", "nothing"])
def test_failed_switch_leaves_no_orphan(spark, monkeypatch, start):
    name = f"t_orphan.{start}"
    spark.sql("CREATE DATABASE IF NOT EXISTS t_orphan")
    if start == "table":
        _some(spark, 2).write.saveAsTable(name)
    elif start == "view":
        sk.replace_table(spark, _some(spark, 2), name, clean=False)
    before = {t.name for t in spark.catalog.listTables("t_orphan")}

    def broken(*_):
        raise RuntimeError("the catalog went away")

    monkeypatch.setattr(sk, "point", broken)
    with pytest.raises(RuntimeError, match="went away"):
        sk.replace_table(spark, _some(spark, 4), name, clean=False)
    assert {t.name for t in spark.catalog.listTables("t_orphan")} == before
    if start != "nothing":
        assert spark.table(name).count() == 2


def test_a_view_of_someone_else_is_not_replaced(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS t_view")
    spark.sql("CREATE OR REPLACE VIEW t_view.sales AS SELECT 1 AS x")
    with pytest.raises(ValueError, match="not made by"):
        sk.replace_table(spark, _some(spark, 1), "t_view.sales", clean=False)
    assert sk.versions(spark, "t_view.sales") == []
