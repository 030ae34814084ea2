"""Day files into the lake: a status for every job, nothing of a broken day, and scans that prune."""
import gzip
from datetime import date

from pyspark.sql import functions as F

from spreadlens.sources import day_files as D, lake as L

HEAD = "exchange,timestamp,local_timestamp,id,side,price,amount\n"
ROW = "x,{t},{t},{i},BUY,100.5,2\n"
DAY_US = 86_400_000_000
FIRST_US = 1_704_067_200_000_000


def land(root, symbol, day, data, name="a"):
    folder = root / f"symbol={symbol}" / f"day=2024-01-{day:02d}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.csv.gz").write_bytes(data)


def lines(day, n, start=0):
    return HEAD + "".join(ROW.format(t=FIRST_US + (day - 1) * DAY_US + i, i=i) for i in range(start, start + n))


def run(spark, tmp_path, symbols, last):
    jobs = D.job_grid(spark.createDataFrame([(s,) for s in symbols], "symbol string"), "2024-01-01", f"2024-01-{last:02d}")
    got = D.ingest_day_files(spark, str(tmp_path / "raw"), str(tmp_path / "lake"), jobs, D.TRADE_FILE, lambda d: L.canonical_trades(d, "day"))
    return got, {(r["symbol"], r["day"].day): (r["status"], r["rows"]) for r in got.collect()}


def test_every_job_has_a_status(spark, tmp_path):
    raw = tmp_path / "raw"
    whole = gzip.compress(lines(2, 5000).encode())
    land(raw, "A", 1, gzip.compress(lines(1, 3).encode()))
    land(raw, "A", 1, gzip.compress(lines(1, 2, 3).encode()), "b")
    land(raw, "A", 2, whole[: len(whole) // 2])
    land(raw, "A", 3, gzip.compress(HEAD.replace("price,amount", "amount,price").encode() + b"x,1,1,1,BUY,1,1\n"))
    land(raw, "A", 4, gzip.compress(lines(4, 2).replace("100.5", "cheap").encode()))
    land(raw, "A", 5, gzip.compress(HEAD.encode()))
    land(raw, "12", 1, gzip.compress(lines(1, 4).encode()))
    land(raw, "12", 2, gzip.compress(lines(2, 1).encode()))
    land(raw, "12", 2, b"no archive", "b")
    land(raw, "12", 3, gzip.compress((HEAD + "x,,1,1,BUY,1,1\n").encode()))
    got, status = run(spark, tmp_path, ["A", "12"], 6)
    assert status == {("A", 1): ("written", 5), ("A", 2): ("error", None), ("A", 3): ("error", None), ("A", 4): ("error", None), ("A", 5): ("written", 0),
                      ("A", 6): ("missing", None), ("12", 1): ("written", 4), ("12", 2): ("error", None), ("12", 3): ("error", None),
                      ("12", 4): ("missing", None), ("12", 5): ("missing", None), ("12", 6): ("missing", None)}
    assert all((r["message"] is not None) == (r["status"] == "error") for r in got.collect())
    assert D.receipt(got).first().asDict() == {"requested": 12, "skipped_existing": 0, "written": 3, "missing": 4, "errors": 5, "rows_written": 9}
    lake = spark.read.parquet(str(tmp_path / "lake"))
    assert {(str(r["symbol"]), r["day"], r["n"]) for r in lake.groupBy("symbol", "day").agg(F.count("*").alias("n")).collect()} == {("A", date(2024, 1, 1), 5), ("12", date(2024, 1, 1), 4)}

    land(raw, "A", 2, whole)
    _, status = run(spark, tmp_path, ["A", "12"], 6)
    assert status[("A", 1)] == ("skipped", None) and status[("12", 1)] == ("skipped", None) and status[("A", 2)] == ("written", 5000)
    assert spark.read.parquet(str(tmp_path / "lake")).count() == 5009


def test_scans_of_the_lake_read_their_folders_alone(spark, tmp_path):
    for s in "AB":
        for day in range(1, 9):
            land(tmp_path / "raw", s, day, gzip.compress(lines(day, day).encode()))
    run(spark, tmp_path, ["A", "B"], 8)
    for got, files, rows in ((D.lake_day(spark, str(tmp_path / "lake"), "A", "2024-01-03"), 1, 3),
                             (D.lake_range(spark, str(tmp_path / "lake"), "2024-01-02", "2024-01-05", ["B"]), 4, 2 + 3 + 4)):
        plan = got.select("ts", "price")._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
        assert all(f"{c}#" in filters for c in ("symbol", "year", "day")) and "price:double" in plan and "amount:" not in plan
        assert got.count() == rows
        read = {r[0] for r in got.select(F.input_file_name()).distinct().collect()}
        assert len(read) <= files


def test_an_empty_table_of_jobs(spark, tmp_path):
    land(tmp_path / "raw", "A", 1, gzip.compress(lines(1, 3).encode()))
    got, status = run(spark, tmp_path, [], 2)
    assert status == {} and D.receipt(got).first()["requested"] == 0
