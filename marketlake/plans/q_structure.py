"""Swings, displacement, gaps, levels and structure events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake.functions.ticks import r
from marketlake.operators import structure as S
from marketlake.plans.registry import query
from marketlake.plans.sqlviews import R, view
from marketlake.sources import views as V

PS = "PARTITION BY symbol, is_high ORDER BY"

view("st_raw", """
SELECT symbol, bar_no, bucket, high, low, lead(high) OVER w AS nh, lead(low) OVER w AS nl,
       last_value(ch IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS rh,
       last_value(cl IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS rl
FROM (SELECT *, CASE WHEN ph <> high THEN ph END AS ch, CASE WHEN pl <> low THEN pl END AS cl FROM day_tr)
WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)""", ("day_tr",))


def _labelled(src: str, term: str) -> str:
    return f"""SELECT *, '{term}' AS term, coalesce(CASE WHEN is_high THEN prev_price <= price ELSE prev_price >= price END, TRUE) AS is_extreme
FROM (SELECT *, row_number() OVER ({PS} bar_no) - 1 AS pivot_no, lag(price) OVER ({PS} bar_no) AS prev_price FROM ({src}))"""


view("piv_st", _labelled("""
SELECT symbol, TRUE AS is_high, bar_no, bar_no + 1 AS confirm_bar_no, bucket, high AS price FROM st_raw WHERE high > rh AND high > nh
UNION ALL SELECT symbol, FALSE, bar_no, bar_no + 1, bucket, low FROM st_raw WHERE low < rl AND low < nl""", "ST"), ("st_raw",))


def _promoted(src: str, term: str, gate: str) -> str:
    return _labelled(f"""
SELECT symbol, is_high, bar_no, conf AS confirm_bar_no, bucket, price FROM (
  SELECT *, last_value(chg IGNORE NULLS) OVER ({PS} pno ROWS UNBOUNDED PRECEDING) AS older FROM (
    SELECT symbol, is_high, bar_no, bucket, price, pivot_no AS pno, lead(price) OVER ({PS} pivot_no) AS newer, lead(confirm_bar_no) OVER ({PS} pivot_no) AS conf,
           CASE WHEN prev_price <> price THEN prev_price END AS chg FROM {src}))
WHERE pno + 2 >= {gate} AND CASE WHEN is_high THEN price > older AND price > newer ELSE price < older AND price < newer END""", term)


view("piv_it", _promoted("piv_st", "IT", "CASE WHEN is_high THEN 4 ELSE 3 END"), ("piv_st",))
view("piv_lt", _promoted("piv_it", "LT", "3"), ("piv_it",))
view("pivots", "SELECT * FROM piv_st UNION ALL BY NAME SELECT * FROM piv_it UNION ALL BY NAME SELECT * FROM piv_lt", ("piv_st", "piv_it", "piv_lt"))

PIV = ["symbol", "is_high", "pivot_no", "bar_no", "confirm_bar_no", "price", "is_extreme"]
PIV_SQL = f"symbol, is_high, pivot_no, bar_no, confirm_bar_no, {R('price', 9)} AS price, is_extreme"


def piv_out(df):
    return df.select(*[r(F.col(c), 9).alias(c) if c == "price" else F.col(c) for c in PIV])


def tiers(spark, sf):
    return S.tiers(V.day_bars(spark, sf))


@query("w16_short_term_swings", f"SELECT {PIV_SQL} FROM piv_st", ("piv_st",))
def w16(spark, sf):
    return piv_out(S.swings(V.day_bars(spark, sf)))


@query("w17_swing_labels", "SELECT symbol, CASE WHEN is_high AND is_extreme THEN 'ST-HH' WHEN is_high THEN 'ST-LH' WHEN is_extreme THEN 'ST-LL' ELSE 'ST-HL' END AS label, count(*) AS n FROM piv_st GROUP BY 1, 2", ("piv_st",))
def w17(spark, sf):
    p = S.swings(V.day_bars(spark, sf))
    return p.groupBy("symbol", S.pivot_label(F.col("term"), F.col("is_high"), F.col("is_extreme")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("w18_intermediate_swings", f"SELECT {PIV_SQL} FROM piv_it", ("piv_it",))
def w18(spark, sf):
    return piv_out(S.promote(S.swings(V.day_bars(spark, sf)), "IT"))


@query("w19_long_term_swings", f"SELECT {PIV_SQL} FROM piv_lt", ("piv_lt",))
def w19(spark, sf):
    return piv_out(S.promote(S.promote(S.swings(V.day_bars(spark, sf)), "IT"), "LT"))


@query("p11_pivot_labels", """
SELECT symbol, bar_no, term || '-' || CASE WHEN is_high AND is_extreme THEN 'HH' WHEN is_high THEN 'LH' WHEN is_extreme THEN 'LL' ELSE 'HL' END AS label FROM pivots""", ("pivots",))
def p11(spark, sf):
    return tiers(spark, sf).select("symbol", "bar_no", S.pivot_label(F.col("term"), F.col("is_high"), F.col("is_extreme")).alias("label"))


K = 10
CW = f"PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {K} PRECEDING AND {K} FOLLOWING"
view("fr_raw", f"""
SELECT symbol, bar_no, high, low, atr, count(*) OVER c = {2 * K + 1} AS whole, max(high) OVER c AS mh, min(low) OVER c AS ml,
       ph, pl, lead(high) OVER o AS nh, lead(low) OVER o AS nl FROM day_atr WINDOW c AS ({CW}), o AS (PARTITION BY symbol ORDER BY bar_no)""", ("day_atr",))
view("fr_piv", """
SELECT symbol, TRUE AS is_high, bar_no, high AS price, atr, high - low AS span FROM fr_raw WHERE whole AND high = mh AND low > pl AND low > nl
UNION ALL SELECT symbol, FALSE, bar_no, low, atr, high - low FROM fr_raw WHERE whole AND low = ml AND high < ph AND high < nh""", ("fr_raw",))


@query("w20_fractal_swings", f"""
SELECT symbol, is_high, arg_max(bar_no, struct_pack(a := span, b := -bar_no)) AS bar_no, count(*) AS merged,
       {R('arg_max(price, struct_pack(a := span, b := -bar_no))', 9)} AS price FROM (
  SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER ({PS} bar_no) AS cluster FROM (
    SELECT *, coalesce(abs(price - lag(price) OVER ({PS} bar_no)) < 0.15 * atr, FALSE) AS near FROM fr_piv))
GROUP BY symbol, is_high, cluster""", ("fr_piv",))
def w20(spark, sf):
    return S.fractal_swings(V.day_bars(spark, sf), K).select("symbol", "is_high", "bar_no", "merged", r(F.col("price"), 9).alias("price"))


BODY = "abs(close - open)"
view("day_lags", f"""
SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(high, 3) OVER w AS h3, lag(low, 3) OVER w AS l3,
       lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2, lag({BODY}) OVER w AS body1,
       stddev_pop({BODY}) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 99 PRECEDING) AS std0,
       stddev_pop({BODY}) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS std1
FROM day_tr WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)""", ("day_tr",))
view("day_disp", """
SELECT *, coalesce(CASE WHEN pc > po THEN h2 < low ELSE l2 > high END, FALSE) AS gap_ok, bar_no >= 2 AS ready FROM day_lags""", ("day_lags",))


@query("w13_displacement", f"""
SELECT symbol, bar_no, coalesce(ready AND gap_ok AND body1 > std0 * 2, FALSE) AS is_displaced, coalesce(pc > po, FALSE) AS is_bullish,
       {R('CASE WHEN ready AND std0 > 0 THEN body1 / (std0 * 2) ELSE 0 END', 5)} AS d_strength, gap_ok AS gap_confirmed FROM day_disp""", ("day_disp",))
def w13(spark, sf):
    d = S.displacement(V.day_bars(spark, sf))
    return d.select("symbol", "bar_no", "is_displaced", F.coalesce("is_bullish", F.lit(False)).alias("is_bullish"), r(F.col("d_strength"), 5).alias("d_strength"), "gap_confirmed")


def _ds(f):
    return f"CASE WHEN ready AND std0 > 0 THEN round((body1 / (std0 * {f}))::double, 5) + 0.0 ELSE 0 END"


@query("w14_displacement_vector", f"SELECT symbol, bar_no, [{_ds(1)}, {_ds(2)}, {_ds(3)}, {_ds(1)}, {_ds(2)}] AS strengths, list_sum([coalesce(ready AND body1 > std0, FALSE)::int, coalesce(ready AND body1 > std0 * 2, FALSE)::int, coalesce(ready AND body1 > std0 * 3, FALSE)::int, coalesce(ready AND gap_ok AND body1 > std0, FALSE)::int, coalesce(ready AND gap_ok AND body1 > std0 * 2, FALSE)::int])::bigint AS hits FROM day_disp", ("day_disp",))
def w14(spark, sf):
    d = S.displacement_vector(V.day_bars(spark, sf))
    tags = list(S.VECTOR_SETTINGS)
    hits = sum((F.col("is_displaced" + t).cast("bigint") for t in tags[1:]), F.col("is_displaced" + tags[0]).cast("bigint"))
    return d.select("symbol", "bar_no", F.array(*[r(F.col("d_strength" + t), 5) for t in tags]).alias("strengths"), hits.alias("hits"))


@query("w15_body_deviation", f"SELECT symbol, bar_no, {R(f'stddev_pop({BODY}) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)', 4)} AS body_std FROM day_bars", ("day_bars",))
def w15(spark, sf):
    return S.body_deviation(V.day_bars(spark, sf)).select("symbol", "bar_no", r(F.col("body_std"), 4).alias("body_std"))


view("day_flags", """
SELECT *, coalesce(low > ph OR high < pl, FALSE) AS gap0, coalesce(pl > h2 OR ph < l2, FALSE) AS gap1,
       coalesce(high < l2 OR low > h2, FALSE) AS fvg0, coalesce(ph < l3 OR pl > h3, FALSE) AS fvg1, coalesce(low > h2, FALSE) AS up,
       greatest(open, close) AS b0h, least(open, close) AS b0l, greatest(po, pc) AS b1h, least(po, pc) AS b1l, greatest(o2, c2) AS b2h, least(o2, c2) AS b2l
FROM day_lags""", ("day_lags",))


def _fvg(merge: bool, extra: str = "TRUE") -> str:
    m = "TRUE" if merge else "FALSE"
    return f"""
SELECT symbol, 'FVG' AS kind, chain - 1 AS imb_no, arg_min(up, bar_no) AS is_bullish, min(bar_no) - 1 AS open_bar_no, max(bar_no) AS close_bar_no,
       arg_max(near, bar_no) AS near, arg_min(far, bar_no) AS far FROM (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bar_no) AS chain FROM (
    SELECT *, {m} AND (b1l > b2h OR b2l > b1h) AND fvg1 AS joins,
      CASE WHEN up THEN CASE WHEN {m} AND b0l > b1h THEN b0l ELSE low END ELSE CASE WHEN {m} AND b0h < b1l THEN b0h ELSE high END END AS near,
      CASE WHEN up THEN CASE WHEN {m} AND b1l > b2h THEN b2h ELSE h2 END ELSE CASE WHEN {m} AND b2l > b1h THEN b2l ELSE l2 END END AS far
    FROM day_flags WHERE fvg0 AND NOT gap0 AND NOT gap1 AND {extra})) WHERE chain > 0 GROUP BY symbol, chain"""


def _edges(src: str) -> str:
    return f"""SELECT *, greatest(near, far) AS top, least(near, far) AS bottom, (near + far) / 2 AS middle,
  coalesce(lag(is_bullish) OVER (PARTITION BY symbol ORDER BY imb_no) <> is_bullish, FALSE) AS invertible FROM ({src})"""


view("fvgs", _edges(_fvg(True)), ("day_flags",))
view("fvgs_plain", _edges(_fvg(False)), ("day_flags",))
view("fvgs_strong", _edges(_fvg(True, "coalesce(body1 > std1 * 1.0, FALSE)")), ("day_flags",))
_NO = "row_number() OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS imb_no"
view("vis", _edges(f"""
SELECT symbol, 'VI' AS kind, {_NO}, b0l > b1h AS is_bullish, bar_no - 1 AS open_bar_no, bar_no AS close_bar_no,
       CASE WHEN b0l > b1h THEN b0l ELSE b0h END AS near, CASE WHEN b0l > b1h THEN b1h ELSE b1l END AS far
FROM day_flags WHERE (b0l > b1h OR b0h < b1l) AND NOT gap0 AND NOT fvg0"""), ("day_flags",))
view("gaps", _edges(f"""
SELECT symbol, 'GAP' AS kind, {_NO}, NOT (high < pl) AS is_bullish, bar_no - 1 AS open_bar_no, bar_no AS close_bar_no,
       CASE WHEN high < pl THEN high ELSE low END AS near, CASE WHEN high < pl THEN pl ELSE ph END AS far FROM day_flags WHERE gap0"""), ("day_flags",))

IMB_SQL = f"symbol, kind, imb_no, is_bullish, open_bar_no, close_bar_no, {R('top', 9)} AS top, {R('bottom', 9)} AS bottom, invertible"


def imb_out(df, *more):
    return df.select("symbol", "kind", "imb_no", "is_bullish", "open_bar_no", "close_bar_no", r(F.col("top"), 9).alias("top"), r(F.col("bottom"), 9).alias("bottom"), "invertible", *more)


@query("w21_fair_value_gaps", f"SELECT {IMB_SQL} FROM fvgs_plain", ("fvgs_plain",))
def w21(spark, sf):
    return imb_out(S.fair_value_gaps(V.day_bars(spark, sf), merge_vi=False))


@query("w21_displaced_gaps", f"SELECT {IMB_SQL} FROM fvgs_strong", ("fvgs_strong",))
def w21d(spark, sf):
    return imb_out(S.fair_value_gaps(V.day_bars(spark, sf), level=1.0))


@query("w22_merged_gaps", f"SELECT {IMB_SQL} FROM fvgs", ("fvgs",))
def w22(spark, sf):
    return imb_out(S.fair_value_gaps(V.day_bars(spark, sf)))


@query("w23_volume_imbalances", f"SELECT {IMB_SQL} FROM vis", ("vis",))
def w23(spark, sf):
    return imb_out(S.volume_imbalances(V.day_bars(spark, sf)))


@query("w24_open_gaps", f"SELECT {IMB_SQL} FROM gaps", ("gaps",))
def w24(spark, sf):
    return imb_out(S.open_gaps(V.day_bars(spark, sf)))


@query("w25_invertible", "SELECT symbol, kind, is_bullish, count(*) AS n, count(*) FILTER (invertible) AS invertible FROM (SELECT * FROM fvgs UNION ALL BY NAME SELECT * FROM gaps) GROUP BY 1, 2, 3", ("fvgs", "gaps"))
def w25(spark, sf):
    b = V.day_bars(spark, sf)
    z = S.fair_value_gaps(b).unionByName(S.open_gaps(b))
    return z.groupBy("symbol", "kind", "is_bullish").agg(F.count(F.lit(1)).alias("n"), F.count_if("invertible").alias("invertible"))


view("claims", """
SELECT p.*, (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = p.symbol AND b.bar_no >= p.confirm_bar_no
             AND CASE WHEN p.is_high THEN b.high > p.price ELSE b.low < p.price END) AS claimed_bar_no FROM pivots p""", ("pivots", "day_bars"))


@query("j08_pivot_claim", "SELECT symbol, term, is_high, bar_no, claimed_bar_no FROM claims", ("claims",))
def j08(spark, sf):
    b = V.day_bars(spark, sf)
    return S.claim(S.tiers(b), b).select("symbol", "term", "is_high", "bar_no", "claimed_bar_no")


def _mit(rule: str) -> str:
    up = "greatest(b.open, b.close)" if rule.startswith("body") else "b.high"
    dn = "least(b.open, b.close)" if rule.startswith("body") else "b.low"
    lvl = {"touched": "near", "half": "middle", "filled": "far"}[rule.split("_")[1]]
    eq = "" if rule == "wick_touched" else "="
    return f"""(SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = z.symbol AND b.bar_no > z.close_bar_no
      AND CASE WHEN z.is_bullish THEN {dn} <{eq} z.{lvl} ELSE {up} >{eq} z.{lvl} END)"""


@query("j09_mitigation", f"SELECT symbol, imb_no, {', '.join(f'{_mit(x)} AS {x}' for x in S.RULES)} FROM fvgs z", ("fvgs", "day_bars"))
def j09(spark, sf):
    b = V.day_bars(spark, sf)
    z = S.fair_value_gaps(b)
    return S.mitigate_all(z, b).select("symbol", "imb_no", *S.RULES)


view("ifvgs", """
SELECT * FROM (SELECT z.*, (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = z.symbol AND b.bar_no > z.close_bar_no
   AND CASE WHEN z.is_bullish THEN b.close < z.far ELSE b.close > z.far END) AS inverted_no FROM fvgs z WHERE invertible) WHERE inverted_no IS NOT NULL""", ("fvgs", "day_bars"))


@query("j10_inverted_gaps", f"SELECT symbol, 'iFVG' AS kind, imb_no, NOT is_bullish AS is_bullish, open_bar_no, inverted_no AS close_bar_no, {R('top', 9)} AS top, {R('bottom', 9)} AS bottom, FALSE AS invertible FROM ifvgs", ("ifvgs",))
def j10(spark, sf):
    b = V.day_bars(spark, sf)
    return imb_out(S.invert(S.fair_value_gaps(b), b))


@query("u02_gaps_with_inversions", f"""
SELECT symbol, kind, is_bullish, count(*) AS n, count({_mit('wick_filled')}) AS filled FROM (
  SELECT symbol, kind, is_bullish, close_bar_no, near, far, middle FROM fvgs
  UNION ALL SELECT symbol, 'iFVG', NOT is_bullish, inverted_no, far, near, middle FROM ifvgs) z GROUP BY 1, 2, 3""", ("fvgs", "ifvgs", "day_bars"))
def u02(spark, sf):
    b = V.day_bars(spark, sf)
    z = S.fair_value_gaps(b)
    m = S.mitigate(z.unionByName(S.invert(z, b)), b)
    return m.groupBy("symbol", "kind", "is_bullish").agg(F.count(F.lit(1)).alias("n"), F.count("mitigated_bar_no").alias("filled"))


view("eq_space", """
SELECT symbol, bar_no, 0.2 * quantile_cont(atr, 0.5) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING) AS spacing FROM day_atr""", ("day_atr",))


@query("w32_level_spacing", f"SELECT symbol, bar_no, {R('spacing', 3)} AS spacing FROM eq_space", ("eq_space",))
def w32(spark, sf):
    return S.eq_spacing(V.day_bars(spark, sf)).select("symbol", "bar_no", r(F.col("spacing"), 3).alias("spacing"))


view("piv_space", "SELECT p.*, s.spacing FROM piv_st p JOIN eq_space s ON s.symbol = p.symbol AND s.bar_no = p.confirm_bar_no", ("piv_st", "eq_space"))
view("piv_reach", """
SELECT p.*, coalesce((SELECT min(d.bar_no) FROM day_bars d WHERE d.symbol = p.symbol AND d.bar_no > p.bar_no AND CASE WHEN p.is_high THEN d.high > p.price ELSE d.low < p.price END), 1000000000) AS nxt,
       coalesce((SELECT max(d.bar_no) FROM day_bars d WHERE d.symbol = p.symbol AND d.bar_no < p.bar_no AND CASE WHEN p.is_high THEN d.high > p.price ELSE d.low < p.price END), -1) AS bck
FROM piv_space p""", ("piv_space", "day_bars"))
view("eq_cand", """
SELECT a.symbol, a.is_high, a.bar_no AS start_no, b.bar_no AS end_no, b.confirm_bar_no AS confirm_no, a.price AS p1, b.price AS p2,
       CASE WHEN a.is_high THEN greatest(a.price, b.price) ELSE least(a.price, b.price) END AS price
FROM piv_reach a JOIN piv_reach b ON a.symbol = b.symbol AND a.is_high = b.is_high AND a.bar_no < b.bar_no AND abs(a.price - b.price) < b.spacing
WHERE CASE WHEN (a.is_high AND a.price >= b.price) OR (NOT a.is_high AND a.price <= b.price) THEN a.nxt >= b.bar_no ELSE b.bck <= a.bar_no END""", ("piv_reach",))
view("eq_free", """
SELECT * FROM eq_cand c WHERE NOT EXISTS (SELECT 1 FROM day_bars d WHERE d.symbol = c.symbol AND d.bar_no > c.start_no AND d.bar_no < c.end_no AND
  CASE WHEN c.is_high THEN d.high > c.p1 + (c.p2 - c.p1) / (c.end_no - c.start_no) * (d.bar_no - c.start_no)
       ELSE d.low < c.p1 + (c.p2 - c.p1) / (c.end_no - c.start_no) * (d.bar_no - c.start_no) END)""", ("eq_cand", "day_bars"))
view("eq_levels", """
SELECT e.*, (SELECT min(d.bar_no) FROM day_bars d WHERE d.symbol = e.symbol AND d.bar_no > e.confirm_no
   AND CASE WHEN e.is_high THEN d.high > e.price ELSE d.low < e.price END) AS claimed_bar_no FROM eq_free e""", ("eq_free", "day_bars"))


@query("j11_equal_levels", f"SELECT symbol, is_high, start_no, end_no, {R('price', 9)} AS price FROM eq_free", ("eq_free",))
def j11(spark, sf):
    b = V.day_bars(spark, sf)
    e = S.line_of_sight(S.equal_pairs(S.swings(b), b), b)
    return e.select("symbol", "is_high", "start_no", "end_no", r(F.col("price"), 9).alias("price"))


@query("j12_line_of_sight", """
SELECT a.symbol, count(*) AS free, count(*) FILTER (a.is_high) AS free_highs FROM eq_free a GROUP BY 1""", ("eq_free",))
def j12(spark, sf):
    b = V.day_bars(spark, sf)
    e = S.line_of_sight(S.equal_pairs(S.swings(b), b), b)
    return e.groupBy("symbol").agg(F.count(F.lit(1)).alias("free"), F.count_if("is_high").alias("free_highs"))


@query("j13_equal_level_claim", f"""
SELECT symbol, is_high, start_no, end_no, {R('price', 9)} AS price, claimed_bar_no FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY claimed_bar_no DESC, end_no DESC, start_no DESC, is_high) AS rk FROM eq_levels WHERE claimed_bar_no IS NOT NULL)
WHERE rk <= 5 UNION ALL SELECT symbol, is_high, start_no, end_no, {R('price', 9)}, claimed_bar_no FROM eq_levels WHERE claimed_bar_no IS NULL""", ("eq_levels",))
def j13(spark, sf):
    """All standing levels and the five claimed last."""
    b = V.day_bars(spark, sf)
    e = S.equal_levels(S.swings(b), b)
    w = Window.partitionBy("symbol", "tf").orderBy(F.col("claimed_bar_no").desc(), F.col("end_no").desc(), F.col("start_no").desc(), "is_high")
    gone = e.filter(F.col("claimed_bar_no").isNotNull()).withColumn("rk", F.row_number().over(w)).filter("rk <= 5").drop("rk")
    return gone.unionByName(e.filter(F.col("claimed_bar_no").isNull())).select("symbol", "is_high", "start_no", "end_no", r(F.col("price"), 9).alias("price"), "claimed_bar_no")


view("now", "SELECT symbol, arg_max(close, bar_no) AS price_now, max(bar_no) AS bar_now, max(bucket) AS bucket_now, arg_max(atr, bar_no) AS atr_now FROM day_atr GROUP BY 1", ("day_atr",))
view("mss_now", """
SELECT p.symbol, p.is_high, term, pivot_no, CASE WHEN p.is_high THEN 'BULLISH_MSS' ELSE 'BEARISH_MSS' END AS event, abs(price - prev_price) / price AS strength
FROM pivots p JOIN now n USING (symbol) WHERE term IN ('ST', 'IT')
 AND CASE WHEN is_high THEN price > prev_price AND price_now > price ELSE price < prev_price AND price_now < price END""", ("pivots", "now"))
view("bos_now", """
SELECT symbol, is_high, CASE WHEN is_high THEN 'BULLISH_BOS' ELSE 'BEARISH_BOS' END AS event, count(*) AS strength, arg_min(price, bar_no) AS oldest_price, min(bar_no) AS oldest_no
FROM pivots JOIN now n USING (symbol) WHERE term IN ('ST', 'IT') AND CASE WHEN is_high THEN price_now > price ELSE price_now < price END
GROUP BY 1, 2 HAVING count(*) >= 2""", ("pivots", "now"))


@query("w26_structure_shift", f"SELECT symbol, term, pivot_no, event, {R('strength')} AS strength FROM mss_now", ("mss_now",))
def w26(spark, sf):
    b = V.day_bars(spark, sf)
    return S.mss(S.tiers(b), b).select("symbol", "term", "pivot_no", "event", r(F.col("strength")).alias("strength"))


view("triggers", """
SELECT * FROM (SELECT p.*, (SELECT min(b.bar_no) FROM day_bars b WHERE b.symbol = p.symbol AND b.bar_no >= p.confirm_bar_no
   AND CASE WHEN p.is_high THEN b.close > p.price ELSE b.close < p.price END) AS trigger_no
FROM piv_st p WHERE CASE WHEN is_high THEN price > prev_price ELSE price < prev_price END) WHERE trigger_no IS NOT NULL""", ("piv_st", "day_bars"))


@query("w26_shift_triggers", "SELECT symbol, is_high, bar_no, trigger_no FROM triggers", ("triggers",))
def w26t(spark, sf):
    b = V.day_bars(spark, sf)
    return S.mss_triggers(S.swings(b), b).select("symbol", "is_high", "bar_no", "trigger_no")


@query("w27_structure_break", f"SELECT symbol, event, strength, {R('oldest_price', 9)} AS oldest_price, oldest_no FROM bos_now", ("bos_now",))
def w27(spark, sf):
    b = V.day_bars(spark, sf)
    return S.bos(S.tiers(b), b).select("symbol", "event", "strength", r(F.col("oldest_price"), 9).alias("oldest_price"), "oldest_no")


BACK = "(PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)"
view("ob_raw", f"""
SELECT *, max(CASE WHEN close < open THEN bar_no END) OVER {BACK} AS red, max(CASE WHEN close > open THEN bar_no END) OVER {BACK} AS green FROM day_atr""", ("day_atr",))
view("order_blocks", """
SELECT t.symbol, t.trigger_no, TRUE AS is_bullish, o.red AS block_no, d.high AS top, d.low AS bottom, (o.high - o.low) / o.atr AS strength
FROM (SELECT DISTINCT symbol, trigger_no FROM triggers) t JOIN ob_raw o ON o.symbol = t.symbol AND o.bar_no = t.trigger_no JOIN day_bars d ON d.symbol = o.symbol AND d.bar_no = o.red
UNION ALL SELECT t.symbol, t.trigger_no, FALSE, o.green, d.high, d.low, (o.high - o.low) / o.atr
FROM (SELECT DISTINCT symbol, trigger_no FROM triggers) t JOIN ob_raw o ON o.symbol = t.symbol AND o.bar_no = t.trigger_no JOIN day_bars d ON d.symbol = o.symbol AND d.bar_no = o.green""", ("triggers", "ob_raw", "day_bars"))


@query("j14_order_blocks", f"SELECT symbol, trigger_no, is_bullish, block_no, {R('top', 9)} AS top, {R('bottom', 9)} AS bottom, {R('strength')} AS strength FROM order_blocks", ("order_blocks",))
def j14(spark, sf):
    b = V.day_bars(spark, sf)
    o = S.order_blocks(S.mss_triggers(S.swings(b), b), b)
    return o.select("symbol", "trigger_no", "is_bullish", "block_no", *[r(F.col(c), 9).alias(c) for c in ("top", "bottom")], r(F.col("strength")).alias("strength"))


view("equil", """
SELECT symbol, max(price) FILTER (is_high) AS major_high, min(price) FILTER (NOT is_high) AS major_low,
       (max(price) FILTER (is_high) + min(price) FILTER (NOT is_high)) / 2 AS eq FROM pivots GROUP BY 1""", ("pivots",))


@query("a08_equilibrium", f"SELECT symbol, {R('major_high', 9)} AS major_high, {R('major_low', 9)} AS major_low, {R('eq', 9)} AS equilibrium FROM equil", ("equil",))
def a08(spark, sf):
    e = S.equilibrium(tiers(spark, sf))
    return e.select("symbol", *[r(F.col(c), 9).alias(c) for c in ("major_high", "major_low", "equilibrium")])


@query("f09_fib_levels", f"""
SELECT symbol, mode, ratio, {R("CASE WHEN mode = 'spec' THEN major_low + ratio * (major_high - major_low) WHEN ratio = 0.5 THEN eq WHEN ratio < 0.5 THEN eq - 0.382 * (major_high - major_low) ELSE eq + ratio * (major_high - major_low) END")} AS price
FROM equil, (SELECT unnest([0.382, 0.5, 0.618, 0.786])::double AS ratio), (SELECT unnest(['spec', 'code']) AS mode)""", ("equil",))
def f09(spark, sf):
    e = S.equilibrium(tiers(spark, sf))
    hi, lo = F.col("major_high"), F.col("major_low")
    modes = F.create_map(F.lit("spec"), S.fib_levels(hi, lo), F.lit("code"), S.fib_levels(hi, lo, "code"))
    m = e.select("symbol", F.explode(modes).alias("mode", "levels"))
    return m.select("symbol", "mode", F.explode("levels").alias("ratio", "price")).withColumn("price", r(F.col("price")))


@query("p08_premium_discount", f"""
SELECT b.symbol, b.bar_no, CASE WHEN close > eq THEN 'premium' WHEN close < eq THEN 'discount' ELSE 'mid' END AS side FROM day_bars b JOIN equil USING (symbol)""", ("day_bars", "equil"))
def p08(spark, sf):
    b = V.day_bars(spark, sf)
    e = S.equilibrium(S.tiers(b)).select("symbol", "tf", "equilibrium")
    return b.join(e, ["symbol", "tf"]).select("symbol", "bar_no", S.price_side(F.col("close"), F.col("equilibrium")).alias("side"))


@query("p09_encroachment", f"SELECT z.symbol, imb_no, {R('CASE WHEN top = bottom THEN 0 ELSE abs(price_now - middle) / abs(top - bottom) * 100 END', 3)} AS ce_pct FROM fvgs z JOIN now USING (symbol)", ("fvgs", "now"))
def p09(spark, sf):
    b = V.day_bars(spark, sf)
    z = S.fair_value_gaps(b).join(S.last_close(b).select("symbol", "tf", "price_now"), ["symbol", "tf"])
    return z.select("symbol", "imb_no", r(S.encroachment_pct(F.col("price_now"), F.col("top"), F.col("bottom")), 3).alias("ce_pct"))


view("nearest", """
SELECT symbol, term, is_high, count(*) AS unclaimed, arg_min(price, struct_pack(a := abs(price - price_now), b := -bar_no)) AS price,
       arg_min(bar_no, struct_pack(a := abs(price - price_now), b := -bar_no)) AS bar_no, any_value(price_now) AS price_now, any_value(atr_now) AS atr_now,
       (any_value(bucket_now) - arg_min(bucket, struct_pack(a := abs(price - price_now), b := -bar_no))) / 60 AS minutes_since
FROM claims JOIN now USING (symbol) WHERE claimed_bar_no IS NULL GROUP BY 1, 2, 3""", ("claims", "now"))


@query("j15_nearest_level", f"""
SELECT symbol, term, is_high, unclaimed, bar_no, {R('price', 9)} AS price, {R('CASE WHEN is_high THEN price - price_now ELSE price_now - price END / atr_now')} AS distance_atr,
       {R('minutes_since')} AS minutes_since FROM nearest""", ("nearest",))
def j15(spark, sf):
    b = V.day_bars(spark, sf)
    n = S.nearest_levels(S.claim(S.tiers(b), b), b)
    return n.select("symbol", "term", "is_high", "unclaimed", "bar_no", r(F.col("price"), 9).alias("price"), *[r(F.col(c)).alias(c) for c in ("distance_atr", "minutes_since")])


@query("a10_claimed_ratio", f"""
SELECT symbol, term, count(*) AS pivots, {R('avg((claimed_bar_no IS NOT NULL)::int)')} AS claimed_ratio,
       {R('avg((claimed_bar_no IS NOT NULL)::int) FILTER (rk <= 50)')} AS claimed_recent FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol, term ORDER BY bar_no DESC, is_high) AS rk FROM claims) GROUP BY 1, 2""", ("claims",))
def a10(spark, sf):
    b = V.day_bars(spark, sf)
    c = S.claimed_ratio(S.claim(S.tiers(b), b))
    return c.select("symbol", "term", "pivots", r(F.col("claimed_ratio")).alias("claimed_ratio"), r(F.col("claimed_recent")).alias("claimed_recent"))


@query("a11_level_density", """
SELECT symbol, count(*) FILTER (is_high AND claimed_bar_no IS NULL AND abs(price - price_now) <= price_now * 0.5) AS bsl_density,
       count(*) FILTER (NOT is_high AND claimed_bar_no IS NULL AND abs(price - price_now) <= price_now * 0.5) AS ssl_density
FROM claims JOIN now USING (symbol) GROUP BY 1""", ("claims", "now"))
def a11(spark, sf):
    """The tape is wild, so the band is half the price rather than one percent."""
    b = V.day_bars(spark, sf)
    return S.level_density(S.claim(S.tiers(b), b), b, 0.5).select("symbol", "bsl_density", "ssl_density")


@query("k04_retained_newest", """
SELECT symbol, kind, count(*) AS kept, min(imb_no) AS oldest FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY imb_no DESC) AS rk FROM (SELECT * FROM fvgs UNION ALL BY NAME SELECT * FROM gaps)) WHERE rk <= 20 GROUP BY 1, 2""", ("fvgs", "gaps"))
def k04(spark, sf):
    b = V.day_bars(spark, sf)
    z = S.fair_value_gaps(b).unionByName(S.open_gaps(b))
    w = Window.partitionBy("symbol", "tf", "kind").orderBy(F.col("imb_no").desc())
    kept = z.withColumn("rk", F.row_number().over(w)).filter("rk <= 20")
    return kept.groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("kept"), F.min("imb_no").alias("oldest"))
