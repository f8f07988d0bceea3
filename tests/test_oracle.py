"""Registered queries against their SQL twins. MARKETLAKE_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
FEW = """a01_ohlcv a02_timeframe_fanout p03_aggressor w02_atr_wilder w06_running_cvd_daily w16_short_term_swings w19_long_term_swings w22_merged_gaps
j04_next_last_event j05_events_ahead j08_pivot_claim j16_prediction_outcome j24_similar_situations k05_reranked_precedents a12_information_coefficient a16_stability_index
a24_trade_metrics w31_max_drawdown f13_macro_state s08_calendar_feed m01_tick_sequences r01_streaming_bars
a32_zone_history c06_label_outcomes j17_zone_hold j18_hold_label j19_zone_accumulation j19_level_accumulation j20_zones_near_price j21_touch_counting j25_snapshot_lookup u05_zone_registry
s16_ttl_stream r06_staleness_alerts r09_countdown_stream
s06_binary_files m07_isotonic_values m10_skill r02_late_rows r11_archive_ledger c07_replay f09_fib_table_function""".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = list(SQL) if os.environ.get("MARKETLAKE_ALL") else FEW


def test_registry():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, cur.fetchall())
