"""Canonical schemas (session time zone UTC, prices and volumes as double)."""

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


STR, DBL, LNG, INT, TS, BOOL = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.BooleanType(),
)

TICKS = _s(("symbol", STR), ("ts", TS), ("seq", LNG), ("bid", DBL), ("ask", DBL), ("last", DBL),
           ("volume", DBL), ("flags", INT))

# Layout of tick files at rest: microsecond epoch, optional columns last.
TICK_FILES = _s(("timestamp_us", LNG), ("bid", DBL), ("ask", DBL), ("last", DBL), ("volume", DBL),
                ("flags", INT), ("symbol", STR))

BARS = _s(("symbol", STR), ("tf", STR), ("bucket_time", TS), ("bar_no", LNG), ("open", DBL), ("high", DBL),
          ("low", DBL), ("close", DBL), ("volume", DBL), ("tick_count", LNG), ("buy_volume", DBL),
          ("sell_volume", DBL), ("cvd", DBL), ("interpolated", BOOL))

CALENDAR = _s(("event_id", STR), ("title", STR), ("country", STR), ("currency", STR), ("impact", STR),
              ("scheduled_time", TS), ("forecast", DBL), ("previous", DBL), ("actual", DBL), ("scraped_at", TS))

PREDICTIONS = _s(("prediction_id", STR), ("symbol", STR), ("bar_close_time", TS), ("p_bsl", DBL), ("p_ssl", DBL),
                 ("p_lateral", DBL), ("predicted_bsl_level", DBL), ("predicted_ssl_level", DBL),
                 ("session_id", STR), ("macro_regime", STR), ("outcome", STR), ("outcome_time", TS))

ZONES = _s(("zone_id", STR), ("symbol", STR), ("tf", STR), ("zone_type", STR), ("top", DBL), ("bottom", DBL),
           ("p_hold", DBL), ("w_zone", DBL), ("status", STR), ("formed_at", TS), ("updated_at", TS))

# Bar length in seconds, by timeframe (fixed values).
TIMEFRAMES = {"M1": 60, "M5": 300, "M15": 900, "H1": 3600, "H4": 14400, "D1": 86400}
