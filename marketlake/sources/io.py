"""Reading and writing ticks, alerts, calendars, reports and keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.schemas import TICK_FILES
from marketlake.session import use_utc

# ---------------------------------------------------------------- ticks


def conform_ticks(df: DataFrame, symbol: str = "XAUUSD") -> DataFrame:
    """Fill what a feed may leave out: symbol, flags, a last price of 0 (mid), a volume of 0 (ten)."""
    c = set(df.columns)

    def col(name: str, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in c else F.lit(default)

    last = col("last", 0.0)
    volume = col("volume", 0.0)
    ts = F.col("ts") if "ts" in c else F.timestamp_micros(F.col("timestamp_us"))
    return df.select(
        col("symbol", symbol).alias("symbol"), ts.alias("ts"), (F.col("seq") if "seq" in c else F.lit(0)).cast("bigint").alias("seq"),
        "bid", "ask", F.when(last == 0, (F.col("bid") + F.col("ask")) / 2).otherwise(last).alias("last"),
        F.when(volume == 0, 10.0).otherwise(volume.cast("double")).alias("volume"), col("flags", 0).cast("int").alias("flags"))


def read_ticks(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Tick files below ``path``; a partitioned tree is pruned to the months that overlap the range.

    ``end`` is a day and counts whole. Order is left to the windows that need it."""
    use_utc(spark)
    df = spark.read.parquet(path)
    if "year" in df.columns and "month" in df.columns:
        month = F.col("year") * 12 + F.col("month")
        if start:
            s = F.lit(start).cast("date")
            df = df.filter(month >= F.year(s) * 12 + F.month(s))
        if end:
            e = F.lit(end).cast("date")
            df = df.filter(month <= F.year(e) * 12 + F.month(e))
    if "ts" not in df.columns:
        df = df.withColumn("ts", F.timestamp_micros("timestamp_us"))
    if start:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col("ts") < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return df


def write_ticks(ticks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tree symbol/year/month. Rows of a month are spread over tasks by day, so a busy symbol is
    written by many tasks; files are sorted by time for row-group pruning."""
    t = ticks.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    t = t.repartition("symbol", "year", "month", F.day("ts")).sortWithinPartitions("symbol", "year", "month", "ts", "seq")
    t.write.mode(mode).partitionBy("symbol", "year", "month").parquet(path)


def stream_ticks(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Tick files as micro-batches, oldest first; ``max_files`` bounds a batch, else it takes what has arrived."""
    use_utc(spark)
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


# Wire record, little endian: 12-byte symbol, u64 microseconds, three doubles scaled by 1e5, u64 volume, u32 flags.
RECORD = np.dtype([("symbol", "S12"), ("timestamp_us", "<u8"), ("bid", "<f8"), ("ask", "<f8"), ("last", "<f8"), ("volume", "<u8"), ("flags", "<u4")])
PRICE_SCALE = 1e5
DECODED = "source string, symbol string, timestamp_us long, bid double, ask double, last double, volume double, flags int, error string"


def decode_tick_blobs(df: DataFrame, content: str = "content", source: str = "path") -> DataFrame:
    """Binary tick records to rows, one vectorised pass per blob; a short rest becomes an error row."""
    def run(batches):
        for pdf in batches:
            for name, blob in zip(pdf["source"], pdf["content"]):
                n = len(blob) // RECORD.itemsize
                rec = np.frombuffer(blob, RECORD, count=n)
                out = pd.DataFrame({
                    "source": name, "symbol": [s.decode("utf-8", "replace") for s in rec["symbol"]], "timestamp_us": rec["timestamp_us"].astype("int64"),
                    "bid": rec["bid"] / PRICE_SCALE, "ask": rec["ask"] / PRICE_SCALE, "last": rec["last"] / PRICE_SCALE,
                    "volume": rec["volume"].astype("float64"), "flags": rec["flags"].astype("int32"), "error": None})
                if n:
                    yield out
                rest = len(blob) - n * RECORD.itemsize
                if rest:
                    yield pd.DataFrame({"source": [name], "symbol": [None], "timestamp_us": [None], "bid": [None], "ask": [None], "last": [None], "volume": [None], "flags": [None], "error": [f"short record of {rest} bytes"]})

    return df.select(F.col(source).alias("source"), F.col(content).alias("content")).mapInPandas(run, DECODED)


def encode_tick_blobs(ticks: DataFrame) -> DataFrame:
    """Inverse of the decoder: one blob per Arrow batch of ticks."""
    def run(batches):
        for pdf in batches:
            rec = np.zeros(len(pdf), RECORD)
            rec["symbol"] = pdf["symbol"].str.encode("utf-8").to_numpy().astype("S12")
            rec["timestamp_us"] = pdf["timestamp_us"]
            for c in ("bid", "ask", "last"):
                rec[c] = np.round(pdf[c] * PRICE_SCALE)
            rec["volume"], rec["flags"] = pdf["volume"], pdf["flags"]
            yield pd.DataFrame({"path": [f"blob-{pdf['timestamp_us'].iloc[0]}"], "content": [rec.tobytes()]})

    t = ticks.select("symbol", F.unix_micros("ts").alias("timestamp_us"), "bid", "ask", "last", "volume", "flags")
    return t.mapInPandas(run, "path string, content binary")


# ---------------------------------------------------------------- alerts and calendar feeds

ALERT = "symbol string, ticker string, timestamp_us long, action string, strategy string, price double, volume double, qty double, ohlcv struct<close: double, volume: double>, _corrupt string"


def parse_alerts(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON alerts to ticks with the aggressor named by the action; bad JSON stays as an error row."""
    a = df.select(F.col(body), F.from_json(body, ALERT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("a"))
    action = F.lower(F.coalesce("a.action", "a.strategy", F.lit("ohlcv_update")))
    trade = action.isin("buy", "sell")
    price = F.when(trade, F.col("a.price")).when(action == "ohlcv_update", F.col("a.ohlcv.close"))
    volume = F.when(trade, F.coalesce("a.volume", "a.qty")).when(action == "ohlcv_update", F.col("a.ohlcv.volume"))
    return a.select(
        F.coalesce("a.symbol", "a.ticker", F.lit("UNKNOWN")).alias("symbol"), F.col("a.timestamp_us").alias("timestamp_us"), action.alias("action"),
        F.coalesce(price, F.lit(0.0)).alias("last"), F.coalesce(volume, F.lit(0.0)).alias("volume"),
        F.when(action == "buy", "BUY").when(action == "sell", "SELL").otherwise("UNKNOWN").alias("aggressor"), F.col("a._corrupt").alias("error"))


FEED = "channel struct<item: array<struct<title: string, country: string, impact: string, pubDate: string, description: string>>>"
# Currencies looked for in a title, in this order.
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "NZD", "CHF", "XAU")


def extract_number(text: Column) -> Column:
    """First number of a text, thousands separators dropped."""
    return F.regexp_replace(F.regexp_extract(text, r"[-+]?[\d,]+\.?\d*", 0), ",", "").try_cast("double")


def parse_calendar(df: DataFrame, currencies: Sequence[str], min_impact: str = "MEDIUM", body: str = "body") -> DataFrame:
    """Calendar feed to rows: currency from the title, impact, RFC-822 or ISO date, three values."""
    i = df.select(F.explode(F.from_json(body, FEED)["channel"]["item"]).alias("i")).select("i.*")
    title = F.upper("title")
    currency = F.lit("USD")
    for c in reversed(CURRENCIES):
        currency = F.when(title.contains(c), c).otherwise(currency)
    impact = F.when(F.upper("impact").isin("LOW", "MEDIUM", "HIGH"), F.upper("impact")).otherwise("MEDIUM")
    parts = F.split(F.coalesce("description", F.lit("")), "<br>")

    def value(word: str) -> Column:
        return extract_number(F.element_at(F.filter(parts, lambda p: F.upper(p).contains(word)), -1))

    rfc = F.regexp_extract("pubDate", r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    at = F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(F.col("pubDate")))
    c = i.select("title", "country", currency.alias("currency"), impact.alias("impact"), at.alias("scheduled_time"), parts.alias("_p"), "description")
    c = c.filter(F.col("currency").isin(list(currencies)))
    if min_impact != "LOW":
        c = c.filter(F.col("impact") != "LOW")
    key = F.concat(F.col("title"), F.lit(":"), F.date_format("scheduled_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return c.select(F.substring(F.md5(key), 1, 16).alias("event_id"), "title", "country", "currency", "impact", "scheduled_time",
                    value("FORECAST").alias("forecast"), value("PREVIOUS").alias("previous"), value("ACTUAL").alias("actual"))


def infer_columns(df: DataFrame) -> DataFrame:
    """Name the columns of a foreign OHLCV table by their role, whatever their case; others stay as they are."""
    roles = {"timestamp": ("timestamp", "datetime", "date", "time"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "vol", "v")}
    lower = {c.lower(): c for c in df.columns}
    found = {}
    for role, names in roles.items():
        hit = next((lower[n] for n in names if n in lower), None)
        if hit is None:
            raise ValueError(f"no column for {role}")
        found[hit] = role
    rest = [c for c in df.columns if c not in found]
    return df.select(*[F.col(k).alias(v) for k, v in found.items()], *rest)


# ---------------------------------------------------------------- keyed tables

def latest_per_key(df: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Newest row of every key, as an aggregate: rows of a busy key are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Insert or replace: the row of the highest version wins, updates over existing rows."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, F.struct(version, F.col("_new"))).drop("_new")


def set_where_pending(table: DataFrame, updates: DataFrame, key: str, column: str, pending: str = "PENDING") -> DataFrame:
    """Write ``column`` from ``updates`` only where the row is still pending."""
    u = updates.select(key, F.col(column).alias("_u"))
    j = table.join(u, key, "left")
    return j.withColumn(column, F.when(F.col(column) == pending, F.coalesce("_u", F.col(column))).otherwise(F.col(column))).drop("_u")


# Seconds a row stays visible, by namespace.
TTL_SECONDS = {"zone": 86400, "prediction": 120, "macro": 60, "calendar": 21600, "features": 3600, "metrics": 300}


def live_rows(df: DataFrame, namespace: Column, updated: Column, now: Column) -> DataFrame:
    ttl = F.create_map(*[x for k, v in TTL_SECONDS.items() for x in (F.lit(k), F.lit(v))])
    age = F.unix_micros(now) - F.unix_micros(updated)
    return df.filter(age <= ttl[namespace].cast("bigint") * 1_000_000)


def append_archive(df: DataFrame, path: str, at: Column) -> None:
    """Append rows to the archive, a folder for each year and month of ``at``."""
    dated = df.withColumn("archive_year", F.year(at)).withColumn("archive_month", F.month(at))
    dated.repartition("archive_year", "archive_month", F.dayofmonth(at)).write.mode("append").partitionBy("archive_year", "archive_month").parquet(path)


def split_expired(df: DataFrame, done: Column, at: Column, now: Column, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Rows to archive (settled and older than ``days``) and rows to keep."""
    old = done & (at < now - F.make_interval(days=F.lit(days)))
    return df.filter(old), df.filter(~old)


def retain(df: DataFrame, resolved: Column, at: Column, now: Column, keep_days: int, drop_unresolved_days: int) -> DataFrame:
    fresh = at >= now - F.make_interval(days=F.lit(keep_days))
    return df.filter(fresh & (resolved | (at >= now - F.make_interval(days=F.lit(drop_unresolved_days)))))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_report(df: DataFrame, out: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def write_split(df: DataFrame, path: str) -> None:
    """Training set as one table partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
