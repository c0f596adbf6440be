"""A vendor of daily bars as a source, with a service of the test's own."""

import os
from datetime import date

import pytest

from marketloom.sources import readers, vendor


def service(folder, broken=()):
    class Vendor:
        def bars(self, endpoint, symbol, start, end):
            from datetime import date, timedelta

            seen = len(os.listdir(folder))
            open(f"{folder}/{symbol}.{endpoint}.{start}.{end}.{seen}", "w").close()
            if symbol in broken:
                return [{"日期": start, "开盘": 1.0}]
            days = [date.fromisoformat(start) + timedelta(k) for k in range((date.fromisoformat(end) - date.fromisoformat(start)).days + 1)]
            known = {"a": ("日期", "开盘", "收盘", "最高", "最低", "成交量"), "h": ("date", "open", "close", "high", "low", "volume")}["a" if "zh_a" in endpoint else "h"]
            return [dict(zip(known, (d.isoformat(), 1.5, 2.0, 3.0, 0.5, 100))) for d in days if d.day in (1, 2)]

        def today(self):
            return open(f"{folder}/../today").read()

    return Vendor()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def test_bars_of_two_markets(spark, folder):
    vendor.register(spark, "vendor_a", service(folder))
    read = spark.read.format("vendor_a").option("symbols", "000001, 00175:hk").option("start", "2019-12-31").option("end", "2026-01-15").load()
    typed = readers.typed_quotes(read)
    assert typed.groupBy("symbol").count().count() == 2 and typed.filter("symbol = '00175' and trade_date = date'2026-01-02' and close = 2.0 and amount is null").count() == 1
    assert read.rdd.getNumPartitions() == 4
    read.count()
    assert {n.split(".")[1] for n in os.listdir(folder) if n.startswith("00175")} == {"stock_hk_hist"} and {n.split(".")[1] for n in os.listdir(folder) if n.startswith("000001")} == {"stock_zh_a_hist"}
    assert spark.read.format("vendor_a").option("end", "2026-01-01").load().count() == 0


def test_what_a_vendor_must_deliver(spark, folder):
    vendor.register(spark, "vendor_b", service(folder, broken=("000002",)))
    read = lambda **options: spark.read.format("vendor_b").options(start="2026-01-01", **options).load().collect()
    with pytest.raises(Exception, match="lacks close, high, low, volume"):
        read(symbols="000002", end="2026-01-03")
    with pytest.raises(Exception, match="no vendor for market us"):
        read(symbols="x:us", end="2026-01-03")
    with pytest.raises(Exception, match="needs an end"):
        read(symbols="000001")


def test_a_stream_fetches_the_days_that_are_new(spark, folder, tmp_path):
    vendor.register(spark, "vendor_c", service(folder))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(today):
        (tmp_path / "today").write_text(today)
        query = spark.readStream.format("vendor_c").option("symbols", "000001,00175:hk").option("start", "2026-01-01").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r["symbol"], date.fromisoformat(r["trade_date"]).month, date.fromisoformat(r["trade_date"]).day) for r in spark.read.schema(vendor.BARS).parquet(out).collect())

    both = lambda *days: sorted((s, m, d) for s in ("000001", "00175") for m, d in days)
    assert run("2026-01-01") == both((1, 1))
    assert run("2026-02-01") == both((1, 1), (1, 2), (2, 1)) == run("2026-02-01")
    asked = sorted({tuple(n.split(".")[2:4]) for n in os.listdir(folder)})
    assert asked == [("2026-01-01", "2026-01-01"), ("2026-01-02", "2026-02-01")]
