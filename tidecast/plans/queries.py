"""Registered queries over the driver's tables, each with its SQL where one exists.

Series: `orders` per status and day (count of orders), `lineitem` per return flag and day (quantity, mean discount as a
regressor), `events` per type and hour (mean value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.future import future_timestamps, make_future
from ..operators import evaluate, events, history, metrics, search, simulate
from ..operators.fit import fit, regressor_coefficients
from ..operators.predict import predict, prediction_rows, residuals
from ..options import CountryHolidays, Event, ForecastOptions, Regressor, Seasonality
from ..sources.codec import decode_models, encode_models

DAY = X.DAY_MS
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _day_ms(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("long") * DAY


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy("ts_ms")).cast("long") - 1)


def orders_daily(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderstatus", "o_orderdate")
    return _placed(o.groupBy(F.col("o_orderstatus").alias("series_id"), _day_ms(F.col("o_orderdate")).alias("ts_ms")).agg(F.count("*").cast("double").alias("y")))


def lineitem_daily(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_quantity", "l_discount")
    return _placed(x.groupBy(F.col("l_returnflag").alias("series_id"), _day_ms(F.col("l_shipdate")).alias("ts_ms")).agg(F.sum("l_quantity").cast("double").alias("y"), F.avg("l_discount").alias("discount")))


def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "ts", "value")
    at = _day_ms(F.col("ts")) + F.hour("ts").cast("long") * 3_600_000
    return _placed(e.groupBy(F.col("event_type").alias("series_id"), at.alias("ts_ms")).agg(F.avg("value").alias("y")))


ORDERS = """s AS (SELECT o_orderstatus AS series_id, epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS ts_ms, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts_ms) - 1 AS pos FROM s)"""
LINES = """s AS (SELECT l_returnflag AS series_id, epoch_ms(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) AS ts_ms, CAST(sum(l_quantity) AS DOUBLE) AS y, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts_ms) - 1 AS pos FROM s)"""
HOURS = """s AS (SELECT event_type AS series_id, epoch_ms(date_trunc('hour', ts)) AS ts_ms, avg(value) AS y FROM events GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts_ms) - 1 AS pos FROM s)"""


def r(c, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


# --- decoding and resolution -------------------------------------------------------------------------------------------


@register(f"WITH {ORDERS} SELECT series_id, ts_ms, y, pos FROM h")
def decode_observations(spark, d):
    raw = orders_daily(spark, d).drop("pos").withColumn("input_ord", F.col("ts_ms"))
    return history.decode_observations(raw).select("series_id", "ts_ms", "y", "pos")


@register(f"WITH {ORDERS} SELECT series_id, pos, ts_ms FROM h")
def prediction_row_from_observation(spark, d):
    return prediction_rows(orders_daily(spark, d)).select("series_id", "pos", "ts_ms")


_SUMMARY = "g AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY series_id ORDER BY ts_ms) AS gap FROM h), m AS (SELECT series_id, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, max(ts_ms) - min(ts_ms) AS span_ms, min(CASE WHEN gap > 0 THEN gap END) AS min_gap_ms FROM g GROUP BY 1)"


@register(f"WITH {ORDERS}, {_SUMMARY} SELECT * FROM m")
def history_summary(spark, d):
    return history.history_summary(orders_daily(spark, d))


def _resolved(source: str) -> str:
    return f"""WITH {source}, {_SUMMARY} SELECT series_id,
CASE WHEN span_ms < 730*{DAY}::BIGINT THEN 'insufficient-history' ELSE 'automatic-enabled' END AS yearly,
CASE WHEN span_ms < 14*{DAY}::BIGINT THEN 'insufficient-history' WHEN min_gap_ms IS NULL OR min_gap_ms >= 7*{DAY}::BIGINT THEN 'sampling-too-sparse' ELSE 'automatic-enabled' END AS weekly,
CASE WHEN span_ms < 2*{DAY}::BIGINT THEN 'insufficient-history' WHEN min_gap_ms IS NULL OR min_gap_ms >= {DAY} THEN 'sampling-too-sparse' ELSE 'automatic-enabled' END AS daily FROM m"""


@register(_resolved(ORDERS))
def resolve_seasonalities(spark, d):
    return history.resolve_seasonalities(history.history_summary(orders_daily(spark, d)), ForecastOptions())


@register(_resolved(HOURS))
def resolve_seasonalities_hourly(spark, d):
    return history.resolve_seasonalities(history.history_summary(events_hourly(spark, d)), ForecastOptions())


@register(f"""WITH {ORDERS}, n AS (SELECT series_id, count(*) AS n FROM h GROUP BY 1), e AS (SELECT series_id, CAST(floor(n * 0.8) AS BIGINT) AS e FROM n),
c AS (SELECT series_id, e, least(25, e - 1) AS c FROM e WHERE e > 1), o AS (SELECT series_id, e, c, unnest(generate_series(1, c)) AS ord FROM c)
SELECT o.series_id, ord, ts_ms FROM o JOIN h ON h.series_id = o.series_id AND h.pos = CASE WHEN ord = c THEN e - 1 ELSE CAST(round_even(ord * (CAST(e - 1 AS DOUBLE) / c), 0) AS BIGINT) END""")
def resolve_changepoints_auto(spark, d):
    return history.resolve_changepoints(orders_daily(spark, d))


@register(f"WITH {ORDERS}, z AS (SELECT series_id, 0.0::DOUBLE AS y_offset, max(abs(y)) AS q FROM h GROUP BY 1) SELECT series_id, y_offset, CASE WHEN q = 0 THEN 1 ELSE q END AS y_scale FROM z")
def target_scaling_absmax(spark, d):
    return history.resolve_target_scaling(orders_daily(spark, d))


@register(f"WITH {ORDERS}, z AS (SELECT series_id, min(y) AS y_offset, max(y) - min(y) AS q FROM h GROUP BY 1) SELECT series_id, y_offset, CASE WHEN q = 0 THEN 1 ELSE q END AS y_scale FROM z")
def target_scaling_minmax(spark, d):
    return history.resolve_target_scaling(orders_daily(spark, d), "minmax")


@register(f"WITH {ORDERS} SELECT series_id, 0.0::DOUBLE AS y_offset, max(abs(y)) AS y_scale, false AS has_floor FROM h GROUP BY 1")
def logistic_scaling(spark, d):
    return history.resolve_logistic_scaling(orders_daily(spark, d).withColumn("capacity", F.col("y") * 2 + 1))


@register(f"WITH {LINES} SELECT series_id, 'standardized' AS transform, round(avg(discount), 8) AS mean, round(stddev_samp(discount), 8) AS sd FROM h GROUP BY 1")
def regressor_transform(spark, d):
    t = history.resolve_regressor_transform(lineitem_daily(spark, d).select("series_id", F.col("discount").alias("x")))
    return t.select("series_id", "transform", r("mean", 8).alias("mean"), r("sd", 8).alias("sd"))


@register(f"WITH {LINES}, t AS (SELECT series_id, avg(discount) AS m, stddev_samp(discount) AS sd FROM h GROUP BY 1) SELECT h.series_id, pos, round((discount - m) / sd, 5) AS x FROM h JOIN t USING (series_id)")
def standardize_regressor(spark, d):
    rows = lineitem_daily(spark, d)
    t = history.resolve_regressor_transform(rows.select("series_id", F.col("discount").alias("x")))
    return rows.join(t, "series_id").select("series_id", "pos", r((F.col("discount") - F.col("mean")) / F.col("sd"), 5).alias("x"))


# --- features ----------------------------------------------------------------------------------------------------------


@register(f"WITH {ORDERS}, a AS (SELECT series_id, min(ts_ms) AS o, max(ts_ms) - min(ts_ms) AS w, max(abs(y)) AS q FROM h GROUP BY 1) SELECT h.series_id, pos, round((ts_ms - o) / w::DOUBLE, 8) AS tau, round(y / q, 8) AS y_scaled FROM h JOIN a USING (series_id)")
def scaled_time_and_value(spark, d):
    h = orders_daily(spark, d)
    a = h.groupBy("series_id").agg(F.min("ts_ms").alias("o"), (F.max("ts_ms") - F.min("ts_ms")).alias("w"), F.max(F.abs("y")).alias("q"))
    return h.join(a, "series_id").select("series_id", "pos", r(X.scaled_time(F.col("ts_ms"), F.col("o"), F.col("w")), 8).alias("tau"), r(X.scale_value(F.col("y"), F.lit(0.0), F.col("q")), 8).alias("y_scaled"))


@register(f"WITH {ORDERS}, a AS (SELECT series_id, min(ts_ms) AS o, max(ts_ms) - min(ts_ms) AS w FROM h GROUP BY 1), c AS (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS s) SELECT h.series_id, pos, s, round(greatest((ts_ms - o) / w::DOUBLE - s, 0), 8) AS hinge FROM h JOIN a USING (series_id) CROSS JOIN c")
def hinge_features(spark, d):
    h = orders_daily(spark, d)
    a = h.groupBy("series_id").agg(F.min("ts_ms").alias("o"), (F.max("ts_ms") - F.min("ts_ms")).alias("w"))
    tau = X.scaled_time(F.col("ts_ms"), F.col("o"), F.col("w"))
    at = h.join(a, "series_id").select("series_id", "pos", tau.alias("tau"), F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("s"))
    return at.select("series_id", "pos", "s", r(X.hinge(F.col("tau"), F.col("s")), 8).alias("hinge"))


def _fourier(name: str, period: float, order: int, source: str, rows) -> None:
    terms = [f"round({f}(2*pi()*{h}*(ts_ms/86400000.0::DOUBLE)/{period}), 5) + 0.0 AS {f}{h}" for h in range(1, order + 1) for f in ("sin", "cos")]

    def query(spark, d):
        columns = X.fourier(F.col("ts_ms"), period, order)
        return rows(spark, d).select("series_id", "pos", *(r(c, 5).alias(f"{'sin' if i % 2 == 0 else 'cos'}{i // 2 + 1}") for i, c in enumerate(columns)))

    register(f"WITH {source} SELECT series_id, pos, {', '.join(terms)} FROM h", name)(query)


_fourier("fourier_weekly", 7.0, 3, ORDERS, orders_daily)
_fourier("fourier_yearly", 365.25, 10, ORDERS, orders_daily)
_fourier("fourier_daily", 1.0, 4, HOURS, events_hourly)


@register(f"WITH {ORDERS} SELECT series_id, pos, CASE WHEN y > 2 THEN round(sin(2*pi()*(ts_ms/86400000.0::DOUBLE)/7), 5) + 0.0 ELSE 0 END AS sin1 FROM h")
def seasonality_masks(spark, d):
    return orders_daily(spark, d).select("series_id", "pos", X.masked(r(X.fourier(F.col("ts_ms"), 7.0, 1)[0], 5), F.col("y") > 2).alias("sin1"))


@register(f"WITH {ORDERS} SELECT series_id, pos, round(0.5*sin(2*pi()*(ts_ms/86400000.0::DOUBLE)/7) - 0.25*cos(2*pi()*(ts_ms/86400000.0::DOUBLE)/7) + 0.125*sin(4*pi()*(ts_ms/86400000.0::DOUBLE)/7) + 1.5*cos(4*pi()*(ts_ms/86400000.0::DOUBLE)/7), 5) + 0.0 AS weekly FROM h")
def seasonal_components(spark, d):
    s = F.struct(F.lit(7.0).alias("period_days"), F.array(*map(F.lit, (0.5, -0.25, 0.125, 1.5))).alias("coef"))
    return orders_daily(spark, d).select("series_id", "pos", r(X.seasonal_component(F.col("ts_ms"), s), 5).alias("weekly"))


_EVENTS = (Event("sale", "1996-11-29", -1, 2), Event("sale", "1997-11-28", -1, 2), Event("launch", "1995-06-01", 0, 1))
_EVENT_SQL = """ev(name, date, lo, hi) AS (VALUES ('sale', DATE '1996-11-29', -1, 2), ('sale', DATE '1997-11-28', -1, 2), ('launch', DATE '1995-06-01', 0, 1)),
ex AS (SELECT DISTINCT name, name || '_delim_' || CASE WHEN o >= 0 THEN '+' ELSE '-' END || abs(o) AS "column", CAST(date - DATE '1970-01-01' + o AS INTEGER) AS epoch_day, CAST(o AS INTEGER) AS "offset" FROM (SELECT name, date, unnest(generate_series(lo, hi)) AS o FROM ev))"""


@register(f"WITH {_EVENT_SQL} SELECT * FROM ex")
def event_expand(spark, d):
    return events.expand_events(events.event_frame(spark, _EVENTS))


@register(f'WITH {ORDERS}, {_EVENT_SQL} SELECT DISTINCT series_id, pos, "column" FROM h JOIN ex ON ex.epoch_day = CAST(floor(ts_ms / 86400000.0) AS INTEGER)')
def event_features(spark, d):
    return events.event_features(orders_daily(spark, d), events.expand_events(events.event_frame(spark, _EVENTS)))


@register(f"WITH {ORDERS} SELECT DISTINCT CAST(year(make_timestamp(ts_ms * 1000)) AS INTEGER) AS year FROM h")
def country_holiday_years(spark, d):
    return orders_daily(spark, d).select(F.year(F.date_from_unix_date(X.epoch_day(F.col("ts_ms")))).alias("year")).distinct()


_EASTER = """e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
e2 AS (SELECT *, (19*a + b - b//4 - (b - (b + 8)//25 + 1)//3 + 15) % 30 AS d FROM e1), e3 AS (SELECT *, (32 + 2*(b % 4) + 2*(c//4) - d - c % 4) % 7 AS e FROM e2),
e4 AS (SELECT *, d + e - 7*((a + 11*d + 22*e)//451) + 114 AS f FROM e3), easter AS (SELECT y, make_date(y, f//31, f % 31 + 1) AS easter FROM e4)"""


_FRENCH = "(VALUES (1, 1, 'New Year''s Day'), (5, 1, 'Labor Day'), (5, 8, 'Victory Day'), (7, 14, 'National Day'), (8, 15, 'Assumption Day'), (11, 1, 'All Saints'' Day'), (11, 11, 'Armistice Day'), (12, 25, 'Christmas Day')) v(m, dd, name)"


@register(f"""WITH y AS (SELECT unnest([1996, 1997])::BIGINT AS y), {_EASTER}
SELECT 'FR' AS country, CAST(make_date(y, m, dd) - DATE '1970-01-01' AS INTEGER) AS epoch_day, name FROM {_FRENCH}, y
UNION ALL SELECT 'FR', CAST(easter - DATE '1970-01-01' AS INTEGER) + after, name FROM easter, (VALUES (1, 'Easter Monday'), (39, 'Ascension Day'), (50, 'Pentecost Monday')) v(after, name)""")
def country_holiday_occurrences(spark, d):
    return events.inspect_country_holidays(events.calendar_frame(spark, ("FR", "US"), range(1995, 2000)), "FR", [1996, 1997])




@register(f"""WITH {ORDERS}, y AS (SELECT DISTINCT CAST(year(make_timestamp(ts_ms * 1000)) AS BIGINT) AS y FROM h), {_EASTER}
SELECT 'FR' AS country, CAST(make_date(y, m, dd) - DATE '1970-01-01' AS INTEGER) AS epoch_day, name FROM (VALUES (1, 1, 'New Year''s Day'), (5, 1, 'Labor Day'), (5, 8, 'Victory Day'), (7, 14, 'National Day'), (8, 15, 'Assumption Day'), (11, 1, 'All Saints'' Day'), (11, 11, 'Armistice Day'), (12, 25, 'Christmas Day')) v(m, dd, name), y
UNION ALL SELECT 'FR', CAST(easter - DATE '1970-01-01' AS INTEGER) + after, name FROM easter, (VALUES (1, 'Easter Monday'), (39, 'Ascension Day'), (50, 'Pentecost Monday')) v(after, name)""")
def country_holidays_whole(spark, d):
    """All holidays of a country, movable feasts too, in the years of the table."""
    years = [row["year"] for row in country_holiday_years(spark, d).collect()]  # at most the covered years
    return events.inspect_country_holidays(events.calendar_frame(spark), "FR", years)


@register(f"""WITH {ORDERS}, y AS (SELECT DISTINCT year(make_timestamp(ts_ms * 1000)) AS year FROM h), g(country, first_year, last_year, what) AS (VALUES ('GB', 1999, 1999, 'a'), ('GB', 2002, 2002, 'b'), ('DE', 1996, 1997, 'c'))
SELECT country, CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year, what FROM g WHERE EXISTS (SELECT 1 FROM y WHERE year BETWEEN first_year AND last_year)""")
def coverage_issues(spark, d):
    gaps = spark.createDataFrame([("GB", 1999, 1999, "a"), ("GB", 2002, 2002, "b"), ("DE", 1996, 1997, "c")], "country string, first_year int, last_year int, what string")
    return events.coverage_issues(gaps, country_holiday_years(spark, d))


# --- future timestamps -------------------------------------------------------------------------------------------------


def _future(name: str, frequency: str, sql: str) -> None:
    def query(spark, d):
        anchors = orders_daily(spark, d).groupBy("series_id").agg((F.max("ts_ms") + 5_400_000).alias("anchor_ms"))
        return future_timestamps(anchors, 14, frequency)

    base = f"WITH {ORDERS}, a AS (SELECT series_id, max(ts_ms) + 5400000 AS a FROM h GROUP BY 1), b AS (SELECT series_id, a, make_timestamp(a * 1000) AS t, a % 86400000 AS tod, unnest(generate_series(1, 14)) AS p FROM a) SELECT series_id, p - 1 AS pos, {sql} AS ts_ms FROM b"
    register(base, name)(query)


_future("future_ts_hourly", "h", "a + p * 3600000")
_future("future_ts_daily", "D", "a + p * 86400000")
for _i, _w in enumerate(("W-SUN", "W-MON", "W-TUE", "W-WED", "W-THU", "W-FRI", "W-SAT")):
    _future(f"future_ts_weekly_{_w[2:].lower()}", _w, f"a + 86400000 * (CASE WHEN ({_i} - dayofweek(t) + 7) % 7 = 0 THEN 7 ELSE ({_i} - dayofweek(t) + 7) % 7 END + 7 * (p - 1))")
_future("future_ts_month_start", "MS", "epoch_ms(CAST(date_trunc('month', t) AS TIMESTAMP) + to_months(CAST(p AS INTEGER))) + tod")
_future("future_ts_month_end", "ME", "epoch_ms(CAST(last_day(CAST(CAST(date_trunc('month', t) AS TIMESTAMP) + to_months(CAST(CASE WHEN CAST(t AS DATE) < last_day(t) THEN p - 1 ELSE p END AS INTEGER)) AS DATE)) AS TIMESTAMP)) + tod")


@register(f"WITH {ORDERS}, a AS (SELECT series_id, max(ts_ms) AS a FROM h GROUP BY 1), u AS (SELECT DISTINCT series_id, ts_ms FROM h UNION ALL SELECT series_id, a + unnest(generate_series(1, 7)) * 86400000 FROM a) SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts_ms) - 1 AS pos, ts_ms FROM u")
def future_ts_include_history(spark, d):
    return make_future(orders_daily(spark, d), 7, "D", include_history=True)


# --- prediction with given parameters -----------------------------------------------------------------------------------

_AT = "a AS (SELECT series_id, min(ts_ms) AS o, max(ts_ms) - min(ts_ms) AS w FROM h GROUP BY 1), t AS (SELECT h.*, (ts_ms - o) / w::DOUBLE AS tau FROM h JOIN a USING (series_id))"


def _at(h: DataFrame) -> DataFrame:
    a = h.groupBy("series_id").agg(F.min("ts_ms").alias("o"), (F.max("ts_ms") - F.min("ts_ms")).alias("w"))
    return h.join(a, "series_id").withColumn("tau", X.scaled_time(F.col("ts_ms"), F.col("o"), F.col("w")))


def _doubles(*values: float) -> Column:
    return F.array(*map(F.lit, values))


@register(f"WITH {ORDERS}, {_AT} SELECT series_id, pos, round(2.0 + 3.0*tau + 1.5*greatest(tau-0.25,0) - 4.0*greatest(tau-0.6,0), 7) AS trend FROM t")
def trend_linear(spark, d):
    trend = X.linear_trend(F.col("tau"), F.lit(3.0), F.lit(2.0), _doubles(0.25, 0.6), _doubles(1.5, -4.0))
    return _at(orders_daily(spark, d)).select("series_id", "pos", r(trend, 7).alias("trend"))


@register(f"WITH {ORDERS} SELECT series_id, pos, 7.25::DOUBLE AS trend FROM h")
def trend_flat(spark, d):
    h = orders_daily(spark, d)
    return predict(_plain(_fixed_models(h)).withColumn("growth", F.lit("flat")).withColumn("m", F.lit(7.25)), h.drop("y"), components=False).select("series_id", "pos", "trend")


@register(f"""WITH {ORDERS}, {_AT}, p AS (SELECT series_id, pos, tau, CASE WHEN tau >= 0.5 THEN 5.0 - 2.0 ELSE 5.0 END AS q, CASE WHEN tau >= 0.5 THEN 0.3 + (0.5-0.3)*(1-5.0/3.0) ELSE 0.3 END AS m FROM t)
SELECT series_id, pos, round(1 + 9/(1+exp(-(q*(tau-m)))), 7) AS trend FROM p""")
def trend_logistic(spark, d):
    trend = X.logistic_trend(F.col("tau"), F.lit(5.0), F.lit(0.3), _doubles(0.5), _doubles(-2.0), F.lit(10.0), F.lit(1.0))
    return _at(orders_daily(spark, d)).select("series_id", "pos", r(trend, 7).alias("trend"))


@register(f"WITH {ORDERS}, {_AT}, c AS (SELECT series_id, pos, 4+tau AS trend, 0.25*sin(2*pi()*(ts_ms/86400000.0::DOUBLE)/7) AS mult, 0.5*cos(2*pi()*(ts_ms/86400000.0::DOUBLE)/365.25) AS add FROM t) SELECT series_id, pos, round(trend, 5) AS trend, round(add, 5)+0.0 AS additive, round(mult, 5)+0.0 AS multiplicative, round(trend*mult, 5)+0.0 AS contribution, round(trend*(1+mult)+add, 5) AS value FROM c")
def compose_value(spark, d):
    h = orders_daily(spark, d)
    seasons = F.array(_season("weekly", 7.0, "multiplicative", None, 0.25, 0.0), _season("yearly", 365.25, "additive", None, 0.0, 0.5))
    models = _plain(_fixed_models(h)).withColumn("m", F.lit(4.0)).withColumn("k", F.lit(1.0)).withColumn("seasonalities", seasons)
    f = predict(models, h.drop("y")).withColumn("contribution", F.col("seasonalities")[0]["contribution"])
    return f.select("series_id", "pos", *(r(c, 5).alias(c) for c in ("trend", "additive", "multiplicative", "contribution", "value")))


# --- evaluation --------------------------------------------------------------------------------------------------------

_H, _P, _I = 30 * DAY, 60 * DAY, 730 * DAY
_FOLDS = f"""e AS (SELECT series_id, min(ts_ms) AS a, max(ts_ms) AS b FROM h GROUP BY 1), k AS (SELECT series_id, b, CAST(floor((b - {_H} - a - {_I}) / {_P}.0) AS BIGINT) AS steps FROM e),
f AS (SELECT series_id, CAST(j AS INTEGER) AS fold, b - {_H} - (steps - j) * {_P} AS cutoff_ms FROM (SELECT series_id, b, steps, unnest(generate_series(0, steps)) AS j FROM k WHERE steps >= 0))"""


def _folds(h: DataFrame) -> DataFrame:
    return evaluate.generate_cutoffs_regular(h, _H, _P, _I)


@register(f"WITH {ORDERS}, {_FOLDS} SELECT * FROM f")
def generate_cutoffs(spark, d):
    return _folds(orders_daily(spark, d))


@register(f"WITH {ORDERS}, {_FOLDS} SELECT f.series_id, fold, cutoff_ms, CAST(count(*) FILTER (ts_ms <= cutoff_ms) AS BIGINT) AS training_count, CAST(count(*) FILTER (ts_ms > cutoff_ms AND ts_ms <= cutoff_ms + {_H}) AS BIGINT) AS assessment_count FROM f JOIN h USING (series_id) GROUP BY 1, 2, 3")
def fold_counts(spark, d):
    h = orders_daily(spark, d)
    return evaluate.fold_counts(h, _folds(h), _H)


_AHEAD = f"x AS (SELECT f.series_id, fold, cutoff_ms, ts_ms, pos, y FROM f JOIN h USING (series_id) WHERE ts_ms <= cutoff_ms + {_H}), tr AS (SELECT * FROM x WHERE ts_ms <= cutoff_ms), ah AS (SELECT series_id, fold, cutoff_ms, ts_ms, ts_ms - cutoff_ms AS horizon_ms, y AS actual FROM x WHERE ts_ms > cutoff_ms)"
_LAST = "b AS (SELECT series_id, fold, arg_max(y, pos) AS predicted FROM tr GROUP BY 1, 2), cv AS (SELECT ah.*, predicted FROM ah JOIN b USING (series_id, fold))"
_MEAN = "b AS (SELECT series_id, fold, avg(y) AS predicted FROM tr GROUP BY 1, 2), cv AS (SELECT ah.*, predicted FROM ah JOIN b USING (series_id, fold))"


def _cv(spark, d, kind="last") -> DataFrame:
    h = orders_daily(spark, d)
    return evaluate.cross_validate_baseline(h, _folds(h), _H, kind)


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST} SELECT series_id, fold, cutoff_ms, ts_ms, horizon_ms, actual, predicted FROM cv")
def baseline_last(spark, d):
    return _cv(spark, d).drop("lower", "upper")


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_MEAN} SELECT series_id, fold, cutoff_ms, ts_ms, horizon_ms, actual, round(predicted, 8) AS predicted FROM cv")
def baseline_mean(spark, d):
    return _cv(spark, d, "mean").drop("lower", "upper").withColumn("predicted", r("predicted", 8))


_FILLED = f"{ORDERS}, sp AS (SELECT series_id, min(ts_ms) AS a, max(ts_ms) AS b FROM h GROUP BY 1), fl AS (SELECT sp.series_id, d.ts AS ts_ms, coalesce(h.y, 0) AS y FROM (SELECT series_id, unnest(generate_series(a, b, {DAY})) AS ts FROM sp) d JOIN sp ON sp.series_id = d.series_id LEFT JOIN h ON h.series_id = d.series_id AND h.ts_ms = d.ts), hf AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts_ms) - 1 AS pos FROM fl)"


def _filled(spark, d) -> DataFrame:
    """Every day of each series; days without orders count 0."""
    h = orders_daily(spark, d)
    days = h.groupBy("series_id").agg(F.explode(F.sequence(F.min("ts_ms"), F.max("ts_ms"), F.lit(DAY).cast("long"))).alias("ts_ms"))
    return _placed(days.join(h.drop("pos"), ["series_id", "ts_ms"], "left").withColumn("y", F.coalesce("y", F.lit(0.0))))


_FF, _AF = _FOLDS.replace("FROM h ", "FROM hf "), _AHEAD.replace("JOIN h ", "JOIN hf ")


@register(f"WITH {_FILLED}, {_FF}, {_AF} SELECT ah.*, p.y AS predicted FROM ah JOIN hf p ON p.series_id = ah.series_id AND p.ts_ms = ah.ts_ms - 35*{DAY}::BIGINT".replace("hf AS (", "hf AS MATERIALIZED (").replace("f AS (SELECT series_id, CAST(j", "f AS MATERIALIZED (SELECT series_id, CAST(j"))
def baseline_seasonal_naive(spark, d):
    h = _filled(spark, d)
    return evaluate.cross_validate_baseline(h, _folds(h), _H, "seasonal_naive", 35 * DAY).drop("lower", "upper")


_SCORES = "round(avg(abs(actual-predicted)), 6) AS mae, round(avg((actual-predicted)^2), 6) AS mse, round(sqrt(avg((actual-predicted)^2)), 6) AS rmse, round(avg(abs((actual-predicted)/actual)), 6) AS mape, round(quantile_cont(abs((actual-predicted)/actual), 0.5), 6) AS mdape, round(avg(CASE WHEN abs(actual)+abs(predicted) = 0 THEN 0 ELSE abs(actual-predicted)/((abs(actual)+abs(predicted))/2) END), 6) AS smape"
_NAMES = ["mae", "mse", "rmse", "mape", "mdape", "smape"]


def _long(sql: str, keys: str) -> str:
    return f"SELECT {keys}, metric, value, row_count FROM ({sql}) UNPIVOT (value FOR metric IN (mae, mse, rmse, mape, mdape, smape))"


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST} " + _long(f"SELECT series_id, {_SCORES}, count(*) AS row_count FROM cv GROUP BY 1", "series_id"))
def metrics_overall(spark, d):
    return metrics.performance(_cv(spark, d), _NAMES).withColumn("value", r("value"))


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST} " + _long(f"SELECT series_id, horizon_ms AS horizon, {_SCORES}, count(*) AS row_count FROM cv GROUP BY 1, 2", "series_id, horizon"))
def metrics_horizons(spark, d):
    return metrics.performance(_cv(spark, d), _NAMES, "horizons").withColumn("value", r("value"))


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST} " + _long(f"SELECT series_id, CAST((year(make_timestamp(ts_ms*1000))*12+month(make_timestamp(ts_ms*1000))) - (year(make_timestamp(cutoff_ms*1000))*12+month(make_timestamp(cutoff_ms*1000))) AS BIGINT) AS horizon, {_SCORES}, count(*) AS row_count FROM cv GROUP BY 1, 2", "series_id, horizon"))
def metrics_monthly(spark, d):
    return metrics.performance(_cv(spark, d), _NAMES, "horizons", unit="calendar-month").withColumn("value", r("value"))


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST} SELECT series_id, fold, cutoff_ms, ts_ms, horizon_ms AS horizon, 'mae' AS metric, round(abs(actual-predicted), 6) AS value, 1::BIGINT AS row_count FROM cv")
def metrics_rows(spark, d):
    return metrics.performance(_cv(spark, d), ["mae"], "rows").withColumn("value", r("value"))


@register(f"""WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST}, g AS (SELECT series_id, horizon_ms AS horizon, sum(abs(actual-predicted)) AS s, count(*) AS n FROM cv GROUP BY 1, 2),
c AS (SELECT series_id, horizon, s, n, sum(n) OVER (PARTITION BY series_id ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS cc, greatest(1, CAST(floor(sum(n) OVER (PARTITION BY series_id) * 0.1) AS BIGINT)) AS w FROM g),
j AS (SELECT t.series_id, t.horizon, t.w, b.s * greatest(0, least(b.cc, t.cc) - greatest(b.cc - b.n, t.cc - t.w)) / b.n AS part FROM c t JOIN c b ON b.series_id = t.series_id AND b.horizon <= t.horizon WHERE t.cc >= t.w)
SELECT series_id, horizon, 'mae' AS metric, round(sum(part) / w, 6) AS value, CAST(w AS BIGINT) AS row_count FROM j GROUP BY series_id, horizon, w""")
def metrics_rolling(spark, d):
    return metrics.performance(_cv(spark, d), ["mae"], "rolling", window_fraction=0.1).withColumn("value", r("value"))


@register(f"""WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST}, x1 AS (SELECT series_id, horizon_ms AS horizon, abs((actual-predicted)/actual) AS x, row_number() OVER (PARTITION BY series_id ORDER BY horizon_ms, fold, ts_ms) AS p FROM cv),
g AS (SELECT series_id, horizon, min(p) AS a, max(p) AS b FROM x1 GROUP BY 1, 2)
SELECT g.series_id, g.horizon, 'mdape' AS metric, round(quantile_cont(x, 0.5), 6) AS value, count(*) AS row_count FROM g JOIN x1 ON x1.series_id = g.series_id AND x1.p BETWEEN least(a, b - 40 + 1) AND b WHERE b >= 40 GROUP BY 1, 2""")
def metrics_mdape_rolling(spark, d):
    return metrics.performance(_cv(spark, d), ["mdape"], "rolling", window_rows=40).withColumn("value", r("value"))


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST} SELECT series_id, 'wape' AS metric, round(sum(abs(actual-predicted))/sum(abs(actual)), 6) AS value, count(*) AS row_count FROM cv GROUP BY 1")
def metrics_wape(spark, d):
    return metrics.performance(_cv(spark, d), [metrics.WAPE]).withColumn("value", r("value"))


@register(f"""WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST}, gp AS (SELECT series_id, ts_ms, abs(y - lag(y) OVER (PARTITION BY series_id ORDER BY pos)) AS gap FROM h),
sc AS (SELECT f.series_id, fold, avg(gap) AS scale FROM f JOIN gp USING (series_id) WHERE ts_ms <= cutoff_ms AND gap IS NOT NULL GROUP BY 1, 2)
SELECT series_id, round(avg(abs(actual-predicted)/scale), 6) AS value, count(*) AS row_count FROM cv JOIN sc USING (series_id, fold) GROUP BY 1""")
def mase_previous_row(spark, d):
    h = orders_daily(spark, d)
    return metrics.scaled_error(_cv(spark, d), evaluate.fold_scales(h, _folds(h))).withColumn("value", r("value"))


@register(f"""WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST}, gp AS (SELECT h.series_id, h.ts_ms, abs(h.y - p.y) AS gap FROM h JOIN h p ON p.series_id = h.series_id AND p.ts_ms = h.ts_ms - 7*{DAY}::BIGINT),
sc AS (SELECT f.series_id, fold, avg(gap) AS scale FROM f JOIN gp USING (series_id) WHERE ts_ms <= cutoff_ms GROUP BY 1, 2)
SELECT series_id, round(avg(abs(actual-predicted)/scale), 6) AS value, count(*) AS row_count FROM cv JOIN sc USING (series_id, fold) GROUP BY 1""")
def mase_lag_week(spark, d):
    h = orders_daily(spark, d)
    return metrics.scaled_error(_cv(spark, d), evaluate.fold_scales(h, _folds(h), 7 * DAY)).withColumn("value", r("value"))


_RANGE = "tq AS (SELECT series_id, fold, quantile_cont(y, 0.1) AS lower, quantile_cont(y, 0.9) AS upper FROM tr GROUP BY 1, 2), cr AS (SELECT cv.*, lower, upper FROM cv JOIN tq USING (series_id, fold))"


def _ranged(spark, d) -> DataFrame:
    h = orders_daily(spark, d)
    train = evaluate.split_folds(h, _folds(h), _H).filter("not assess")
    q = train.groupBy("series_id", "fold").agg(F.percentile("y", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).select("series_id", "fold", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
    return _cv(spark, d).drop("lower", "upper").join(q, ["series_id", "fold"])


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST}, {_RANGE} SELECT series_id, 'coverage' AS metric, round(avg(CAST(actual BETWEEN lower AND upper AS INTEGER)), 6) AS value, count(*) AS row_count FROM cr GROUP BY 1")
def metric_coverage(spark, d):
    return metrics.performance(_ranged(spark, d), ["coverage"]).withColumn("value", r("value"))


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST}, {_RANGE} SELECT series_id, CASE WHEN actual < lower THEN 'below' WHEN actual > upper THEN 'above' ELSE 'within' END AS position, count(*) AS n FROM cr GROUP BY 1, 2")
def anomaly_position(spark, d):
    at = _ranged(spark, d).withColumn("position", simulate.anomaly_position(F.col("actual"), F.col("lower"), F.col("upper")))
    return at.groupBy("series_id", "position").agg(F.count("*").alias("n"))


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST} SELECT series_id, fold, ts_ms, actual - predicted AS residual FROM cv")
def residuals_baseline(spark, d):
    return _cv(spark, d).select("series_id", "fold", "ts_ms", (F.col("actual") - F.col("predicted")).alias("residual"))


@register("SELECT concat('grid-', g.i, '-', p.i) AS id, g.v AS growth, p.v AS changepoint_prior_scale FROM (VALUES (0, 'linear'), (1, 'flat')) g(i, v), (VALUES (0, '0.01'), (1, '0.05'), (2, '0.5')) p(i, v)")
def parameter_grid(spark, d):
    return search.grid_frame(spark, {"growth": ["linear", "flat"], "changepoint_prior_scale": [0.01, 0.05, 0.5]})


@register(f"""WITH {ORDERS}, {_FOLDS}, {_AHEAD}, bl AS (SELECT series_id, fold, arg_max(y, pos) AS l, avg(y) AS m FROM tr GROUP BY 1, 2),
sc AS (SELECT series_id, avg(abs(actual - l)) AS l, avg(abs(actual - m)) AS m FROM ah JOIN bl USING (series_id, fold) GROUP BY 1)
SELECT series_id, v.candidate, CAST(v.ord AS INTEGER) AS ord, round(v.score, 6) AS score, v.ord = (CASE WHEN l <= m THEN 0 ELSE 1 END) AS best FROM sc, LATERAL (VALUES ('last', 0, l), ('mean', 1, m)) v(candidate, ord, score)""")
def search_select(spark, d):
    scores = None
    for i, kind in enumerate(("last", "mean")):
        own = metrics.performance(_cv(spark, d, kind), ["mae"]).select("series_id", F.lit(kind).alias("candidate"), F.lit(i).alias("ord"), F.col("value").alias("score"))
        scores = own if scores is None else scores.unionByName(own)
    return search.select_best(scores).withColumn("score", r("score"))


@register(f"""WITH {ORDERS}, {_FOLDS}, {_AHEAD}, bl AS (SELECT series_id, fold, arg_max(y, pos) AS l, avg(y) AS m FROM tr GROUP BY 1, 2)
SELECT 'last' AS source, series_id, 'mae' AS metric, round(avg(abs(actual - l)), 6) AS value, count(*) AS row_count FROM ah JOIN bl USING (series_id, fold) GROUP BY 2
UNION ALL SELECT 'mean', series_id, 'mae', round(avg(abs(actual - m)), 6), count(*) FROM ah JOIN bl USING (series_id, fold) GROUP BY 2""")
def compare_performance(spark, d):
    return metrics.compare_performance({k: _cv(spark, d, k) for k in ("last", "mean")}, ["mae"]).withColumn("value", r("value"))


# --- fitted models: iterative, so without SQL ---------------------------------------------------------------------------


def _weekly(h: DataFrame) -> DataFrame:
    at = F.floor(F.col("ts_ms") / (7 * DAY)) * (7 * DAY)
    return _placed(h.groupBy("series_id", at.cast("long").alias("ts_ms")).agg(F.sum("y").alias("y")))


@register()
def forecast_linear(spark, d):
    h = orders_daily(spark, d)
    return predict(fit(h), make_future(h, 28, "D"), components=False)


@register()
def forecast_mixed(spark, d):
    h = lineitem_daily(spark, d).withColumn("regressors", F.create_map(F.lit("discount"), F.col("discount"))).withColumn("conditions", F.create_map(F.lit("summer"), F.month(F.date_from_unix_date(X.epoch_day(F.col("ts_ms")))).between(6, 8)))
    options = ForecastOptions(seasonality_mode="multiplicative", events=_EVENTS, regressors=(Regressor("discount"),), seasonalities=(Seasonality("summer_week", 7.0, 2, condition="summer"),), weekly="off")
    return predict(fit(h, options), h.drop("y"))


@register()
def forecast_flat(spark, d):
    h = events_hourly(spark, d)
    return predict(fit(h, ForecastOptions(growth="flat")), make_future(h, 48, "h"), components=False)


@register()
def forecast_logistic(spark, d):
    h = _weekly(orders_daily(spark, d)).withColumn("capacity", F.max("y").over(Window.partitionBy("series_id")) * 1.5)
    models = fit(h, ForecastOptions(growth="logistic", yearly="off", weekly="off", daily="off", n_changepoints=5))
    return predict(models, h.drop("y"), components=False)


@register()
def fit_models(spark, d):
    return decode_models(encode_models(fit(orders_daily(spark, d)))).select("series_id", "growth", "k", "m", "sigma", "fit_summary")


@register()
def coefficients(spark, d):
    h = lineitem_daily(spark, d).withColumn("regressors", F.create_map(F.lit("discount"), F.col("discount")))
    return regressor_coefficients(fit(h, ForecastOptions(regressors=(Regressor("discount"),), yearly="off")))


@register()
def fitted_residuals(spark, d):
    h = orders_daily(spark, d)
    return residuals(fit(h), h)


@register()
def intervals_linear(spark, d):
    h = orders_daily(spark, d)
    return simulate.predict_uncertainty(fit(h), make_future(h, 28, "D"), seed=7, samples=500)


@register()
def detect_anomalies(spark, d):
    h = events_hourly(spark, d)
    return simulate.detect_anomalies(fit(h), h, seed=11, samples=300)


@register()
def cv_linear(spark, d):
    h = _weekly(orders_daily(spark, d))
    folds = evaluate.generate_cutoffs_regular(h, 8 * 7 * DAY, 16 * 7 * DAY, 40 * 7 * DAY)
    return evaluate.cross_validate(h, ForecastOptions(), folds, 8 * 7 * DAY, intervals={"seed": 3, "samples": 100})


@register()
def search_linear(spark, d):
    h = _weekly(orders_daily(spark, d))
    folds = evaluate.generate_cutoffs_regular(h, 8 * 7 * DAY, 30 * 7 * DAY, 60 * 7 * DAY)
    grid = search.parameter_grid(ForecastOptions(weekly="off"), {"growth": ["linear", "flat"], "changepoint_prior_scale": [0.05, 0.5]})
    return search.search_models(h, grid, folds, 8 * 7 * DAY)


# --- fixed models, alignment, guards and scalar functions ---------------------------------------------------------------


def _season(name: str, period: float, mode: str, condition: str | None, *coef: float) -> Column:
    fields = {"name": F.lit(name), "period_days": F.lit(period), "fourier_order": F.lit(len(coef) // 2), "prior_scale": F.lit(10.0), "mode": F.lit(mode), "condition": F.lit(condition).cast("string"), "coef": _doubles(*coef)}
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _plain(models: DataFrame) -> DataFrame:
    """Models without changepoints, seasonalities, events and regressors."""
    for c in ("changepoints_ms", "deltas", "seasonalities", "events", "regressors"):
        models = models.withColumn(c, F.slice(c, 1, 0))
    return models


def _fixed_models(h: DataFrame) -> DataFrame:
    """A MODEL row for each series with given parameters, so that predict() can be held against SQL."""
    from ..schema import MODEL

    own = h.groupBy("series_id").agg(F.min("ts_ms").alias("time_origin"), (F.max("ts_ms") - F.min("ts_ms")).alias("time_scale"))
    at = (F.col("time_origin") + F.col("time_scale") / 2).cast("long")
    event = lambda day, offset, coef: F.struct(F.lit("sale").alias("name"), F.lit(day).alias("epoch_day"), F.lit(offset).alias("offset"), F.lit("additive").alias("mode"), F.lit(coef).alias("coef"))
    sale = events.parse_date("1996-11-29")
    values = {
        "model_kind": F.lit("map-linear"), "growth": F.lit("linear"), "scaling": F.lit("absmax"), "y_offset": F.lit(0.0), "y_scale": F.lit(1.0), "k": F.lit(3.0), "m": F.lit(2.0), "sigma": F.lit(1.0), "has_floor": F.lit(False),
        "changepoints_ms": F.array(at), "deltas": _doubles(-4.0), "seasonalities": F.array(_season("weekly", 7.0, "multiplicative", None, 0.25, 0.1), _season("odd", 5.0, "additive", "busy", 0.5, 0.0)),
        "events": F.array(event(sale, 0, 2.5), event(sale + 1, 1, 1.5)), "regressors": F.array(F.struct(F.lit("x").alias("name"), F.lit(10.0).alias("prior_scale"), F.lit("additive").alias("mode"), F.lit("standardized").alias("transform"), F.lit(3.0).alias("mean"), F.lit(2.0).alias("sd"), F.lit(0.75).alias("coef"))),
    }
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(MODEL)
    return own.select(*((F.col(f.name) if f.name in own.columns else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in fields))


_FIXED = f"""t AS (SELECT h.*, (ts_ms - o) / w::DOUBLE AS tau, (CAST(o + w / 2.0 AS BIGINT) - o) / w::DOUBLE AS s, ts_ms / 86400000.0::DOUBLE AS dd FROM h JOIN (SELECT series_id, min(ts_ms) AS o, max(ts_ms) - min(ts_ms) AS w FROM h GROUP BY 1) USING (series_id)),
c AS (SELECT series_id, pos, ts_ms, 2 + 3*tau - 4*greatest(tau - s, 0) AS trend, 0.25*sin(2*pi()*dd/7) + 0.1*cos(2*pi()*dd/7) AS mult, CASE WHEN y > 2 THEN 0.5*sin(2*pi()*dd/5) ELSE 0 END AS odd,
CASE WHEN ts_ms = epoch_ms(TIMESTAMP '1996-11-29') THEN 2.5 WHEN ts_ms = epoch_ms(TIMESTAMP '1996-11-30') THEN 1.5 ELSE 0 END AS sale, 0.75*(y - 3)/2 AS x FROM t)"""


def _fixed_forecast(spark, d) -> DataFrame:
    h = orders_daily(spark, d)
    rows = h.withColumn("conditions", F.create_map(F.lit("busy"), F.col("y") > 2)).withColumn("regressors", F.create_map(F.lit("x"), F.col("y"))).drop("y")
    return predict(_fixed_models(h), rows)


@register(f"WITH {ORDERS}, {_FIXED} SELECT series_id, pos, ts_ms, round(trend*(1+mult)+odd+sale+x, 5)+0.0 AS value, round(trend, 5)+0.0 AS trend, round(odd+sale+x, 5)+0.0 AS additive, round(mult, 5)+0.0 AS multiplicative FROM c")
def predict_fixed(spark, d):
    f = _fixed_forecast(spark, d)
    return f.select("series_id", "pos", "ts_ms", *(r(c, 5).alias(c) for c in ("value", "trend", "additive", "multiplicative")))


@register(f"""WITH {ORDERS}, {_FIXED} SELECT series_id, pos, v.name, round(v.value, 5)+0.0 AS value, round(v.contribution, 5)+0.0 AS contribution FROM c,
LATERAL (VALUES ('weekly', NULL::DOUBLE, mult*trend), ('odd', odd::DOUBLE, NULL), ('sale', sale::DOUBLE, NULL), ('x', x, NULL)) v(name, value, contribution)""")
def component_breakdown(spark, d):
    f = _fixed_forecast(spark, d).select("series_id", "pos", F.explode(F.concat("seasonalities", "events", "regressors")).alias("c"))
    return f.select("series_id", "pos", F.col("c.name").alias("name"), r("c.value", 5).alias("value"), r("c.contribution", 5).alias("contribution"))


@register(f"WITH {ORDERS}, {_FIXED} SELECT series_id, pos, h.ts_ms, h.y AS actual, round(h.y - (trend*(1+mult)+odd+sale+x), 5)+0.0 AS residual FROM c JOIN h USING (series_id, pos)")
def residuals_fixed(spark, d):
    h = orders_daily(spark, d).withColumn("conditions", F.create_map(F.lit("busy"), F.col("y") > 2)).withColumn("regressors", F.create_map(F.lit("x"), F.col("y")))
    return residuals(_fixed_models(h), h).select("series_id", "pos", "ts_ms", "actual", r("residual", 5).alias("residual"))


@register(f"WITH {ORDERS} SELECT DISTINCT series_id, 'x' AS name, 'additive' AS mode, 3.0::DOUBLE AS center, 0.375::DOUBLE AS coef FROM h")
def regressor_coefficients_fixed(spark, d):
    return regressor_coefficients(_fixed_models(orders_daily(spark, d))).drop("lower", "upper")


@register("SELECT o_orderstatus AS series_id, 0.0::DOUBLE AS k, 5.0::DOUBLE AS m, 5e-9::DOUBLE AS sigma, 'constant' AS algorithm FROM orders GROUP BY 1")
def constant_shortcut(spark, d):
    h = orders_daily(spark, d).withColumn("y", F.lit(5.0))
    return fit(h).select("series_id", "k", "m", r("sigma", 12).alias("sigma"), F.col("fit_summary.algorithm").alias("algorithm"))


@register(f"WITH {ORDERS}, l AS (SELECT series_id, max(ts_ms) AS b FROM h GROUP BY 1) SELECT series_id, pos, ts_ms, y AS x FROM h UNION ALL SELECT series_id, p, b + (p + 1) * {DAY}::BIGINT, p + 0.5 FROM l, (SELECT unnest(generate_series(0, 4)) AS p)")
def fill_regressor_lookup(spark, d):
    """Every history row is looked up."""
    from ..operators.predict import fill_regressor_values

    h = orders_daily(spark, d).withColumn("regressors", F.create_map(F.lit("x"), F.col("y")))
    ahead = make_future(h, 5, "D")
    made = ahead.select("series_id", "pos", (F.col("pos") + 0.5).cast("double").alias("value"))
    past = h.select("series_id", "pos", "ts_ms")
    out = fill_regressor_values(ahead, h, {"x": made}).unionByName(fill_regressor_values(past, h, {"x": made.limit(0)}))
    return out.select("series_id", "pos", "ts_ms", F.col("regressors")["x"].alias("x"))


@register(f"WITH {ORDERS} SELECT h.series_id, h.pos, ts_ms, y AS actual, y + 1 AS predicted FROM h")
def pair_forecasts(spark, d):
    from ..operators.predict import pair_forecasts as pair

    h = orders_daily(spark, d)
    return pair(h, h.select("series_id", "pos", "ts_ms", (F.col("y") + 1).alias("value")))


@register(f"WITH {ORDERS}, {_FOLDS}, m AS (SELECT f.series_id, fold, max(ts_ms) AS last FROM f JOIN h USING (series_id) WHERE ts_ms <= cutoff_ms GROUP BY 1, 2), c AS (SELECT unnest([epoch_ms(TIMESTAMP '1996-01-01'), epoch_ms(TIMESTAMP '1997-06-01'), epoch_ms(TIMESTAMP '1998-09-01')]) AS p_ms) SELECT series_id, fold, count(p_ms) AS n FROM m LEFT JOIN c ON p_ms < last GROUP BY 1, 2")
def fold_changepoints(spark, d):
    h = orders_daily(spark, d)
    last = evaluate.split_folds(h, _folds(h), _H).filter("not assess").groupBy("series_id", "fold").agg(F.max("ts_ms").alias("last"))
    options = ForecastOptions(changepoints_ms=tuple(events.parse_date(t) * DAY for t in ("1996-01-01", "1997-06-01", "1998-09-01")))

    def run(pdf):
        return pdf.assign(n=[len(evaluate._fold_options(options, t).changepoints_ms) for t in pdf["last"]])[["series_id", "fold", "n"]]

    return last.mapInPandas(lambda parts: map(run, parts), "series_id string, fold int, n long")


@register("SELECT 0::BIGINT AS differences")
def plan_equality(spark, d):
    h = orders_daily(spark, d)
    plan = evaluate.fold_counts(h, _folds(h), _H)
    again = evaluate.fold_counts(h, _folds(h.repartition(3)), _H)
    other = evaluate.fold_counts(h, evaluate.generate_cutoffs_regular(h, _H, 2 * _P, _I), _H)
    return spark.createDataFrame([(int(not evaluate.same_plan(plan, again)) + int(evaluate.same_plan(plan, other)),)], "differences long")


@register(f"WITH {ORDERS} SELECT series_id, round(quantile_cont(y, 0.1), 6) AS lower, round(quantile_cont(y, 0.9), 6) AS upper FROM h GROUP BY 1")
def interval_reduce(spark, d):
    def run(pdf):
        (lower,), (upper,) = simulate.interval_reduce(pdf["y"].to_numpy()[None, :], 0.8)
        return pdf.iloc[:1].assign(lower=lower, upper=upper)[["series_id", "lower", "upper"]]

    q = orders_daily(spark, d).groupBy("series_id").applyInPandas(run, "series_id string, lower double, upper double")
    return q.select("series_id", r("lower").alias("lower"), r("upper").alias("upper"))


@register(f"WITH {ORDERS}, {_FOLDS}, {_AHEAD}, {_LAST} SELECT series_id, 'p90' AS metric, round(quantile_cont(abs(actual-predicted), 0.9), 6) AS value, count(*) AS row_count FROM cv GROUP BY 1")
def metric_quantile(spark, d):
    p90 = metrics.Metric("p90", lambda: F.abs(F.col("actual") - F.col("predicted")), reduce="quantile", p=0.9)
    return metrics.performance(_cv(spark, d), [p90]).withColumn("value", r("value"))


@register(f"WITH {HOURS}, t AS (SELECT DISTINCT ts_ms, make_timestamp(ts_ms * 1000) AS t FROM h) SELECT ts_ms, CAST(year(t)*12+month(t)-1 AS INTEGER) AS utc_month, CAST(day(t) AS INTEGER) AS day_of_month, CAST(day(last_day(t)) AS INTEGER) AS days_in_month, ts_ms % 86400000 AS time_of_day, CAST(ts_ms // 86400000 AS INTEGER) AS epoch_day FROM t")
def utc_calendar(spark, d):
    day = F.date_from_unix_date(X.epoch_day(F.col("ts_ms")))
    t = events_hourly(spark, d).select("ts_ms").distinct()
    return t.select("ts_ms", (F.year(day) * 12 + F.month(day) - 1).alias("utc_month"), F.dayofmonth(day).alias("day_of_month"), F.dayofmonth(F.last_day(day)).alias("days_in_month"), X.time_of_day_ms(F.col("ts_ms")).alias("time_of_day"), X.epoch_day(F.col("ts_ms")).alias("epoch_day"))


@register("SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS text, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS epoch_day FROM orders")
def parse_epoch_day(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("text")).distinct()
    return t.mapInPandas(lambda parts: (p.assign(epoch_day=p["text"].map(events.parse_date)) for p in parts), "text string, epoch_day int")


@register(f"WITH {ORDERS}, {_AT} SELECT series_id, pos, round(1/(1+exp(-(20*tau-10))), 9) AS share, CAST(round_even(y/2, 0) AS DOUBLE) AS half FROM t")
def stable_sigmoid_and_rounding(spark, d):
    return _at(orders_daily(spark, d)).select("series_id", "pos", r(X.stable_sigmoid(20 * F.col("tau") - 10), 9).alias("share"), F.rint(F.col("y") / 2).alias("half"))


@register(f"""WITH {ORDERS}, l AS (SELECT series_id, max(ts_ms) AS b FROM h GROUP BY 1), f AS (SELECT series_id, p, b + (p + 1) * {DAY}::BIGINT AS ts_ms, make_timestamp((b + (p + 1) * {DAY}::BIGINT) * 1000) AS t FROM l, (SELECT unnest(generate_series(0, 799)) AS p))
SELECT series_id, p AS pos, ts_ms, v.name, v.value FROM f, LATERAL (VALUES ('Christmas Day', 2.5::DOUBLE, 12, 25), ('Victory Day', -1.0::DOUBLE, 5, 8)) v(name, value, m, dd) WHERE month(t) = m AND day(t) = dd""")
def predict_country_events(spark, d):
    """Two fitted holidays of a country in 800 days after the history; its other holidays have no coefficient."""
    h = orders_daily(spark, d)
    event = lambda name, day, coef: F.struct(F.lit(name).alias("name"), F.lit(events.parse_date(day)).alias("epoch_day"), F.lit(0).alias("offset"), F.lit("additive").alias("mode"), F.lit(coef).alias("coef"))
    country = F.struct(F.lit("FR").alias("country"), F.lit("reject-known-gaps").alias("coverage"), F.array().cast("array<string>").alias("conflicts"))
    models = _plain(_fixed_models(h)).withColumn("events", F.array(event("Christmas Day", "1996-12-25", 2.5), event("Victory Day", "1996-05-08", -1.0))).withColumn("country", country)
    at = predict(models, make_future(h, 800, "D")).select("series_id", "pos", "ts_ms", F.explode("events").alias("e"))
    return at.filter("e.value != 0").select("series_id", "pos", "ts_ms", F.col("e.name").alias("name"), F.col("e.value").alias("value"))


@register()
def forecast_country_events(spark, d):
    """Holidays of a country in forecasts that reach over the New Year after the history, fitted and predicted."""
    h = orders_daily(spark, d)
    models = fit(h, ForecastOptions(country_holidays=CountryHolidays("US")))
    at = predict(models, make_future(h, 200, "D")).select("series_id", "pos", "ts_ms", F.explode("events").alias("e"))
    return at.filter("e.value != 0").select("series_id", "pos", "ts_ms", F.col("e.name").alias("name"), F.col("e.value").alias("value"))


@register(f"WITH {LINES} SELECT series_id, pos, round(discount, 8) AS first, round(y, 4) AS second FROM h")
def align_regressors(spark, d):
    options = ForecastOptions(regressors=(Regressor("discount"), Regressor("quantity")))
    rows = lineitem_daily(spark, d).withColumn("regressors", F.create_map(F.lit("quantity"), F.col("y"), F.lit("discount"), F.col("discount")))
    first, second = (F.col("regressors")[x.name] for x in options.regressors)
    return history.guard_history(rows, options).filter("y is not null").select("series_id", "pos", r(first, 8).alias("first"), r(second, 4).alias("second"))


@register(f"WITH {ORDERS}, b AS (SELECT series_id, CASE WHEN y > 1 THEN 3 END AS capacity, y AS floor FROM h) SELECT series_id, CASE WHEN capacity IS NULL THEN 'missing-capacity' WHEN capacity <= floor THEN 'capacity-not-above-floor' END AS reason, count(*) AS n FROM b GROUP BY ALL")
def logistic_bounds(spark, d):
    h = orders_daily(spark, d).withColumn("capacity", F.when(F.col("y") > 1, 3.0)).withColumn("floor", F.col("y"))
    return history.row_reasons(h, ForecastOptions(growth="logistic")).groupBy("series_id", "reason").agg(F.count("*").alias("n"))


@register(f"WITH {ORDERS} SELECT series_id, CASE WHEN y > 2 THEN 'bound-on-non-logistic' END AS reason, count(*) AS n FROM h GROUP BY ALL")
def reject_bounds_nonlogistic(spark, d):
    h = orders_daily(spark, d).withColumn("capacity", F.when(F.col("y") > 2, 3.0))
    return history.row_reasons(h, ForecastOptions()).groupBy("series_id", "reason").agg(F.count("*").alias("n"))


@register(f"WITH {ORDERS}, {_FIXED} SELECT series_id, pos, ts_ms, round(trend*(1+mult)+odd+sale+x, 5)+0.0 AS value FROM c")
def model_codec(spark, d):
    """Models written as documents and read again predict the same."""
    h = orders_daily(spark, d)
    rows = h.withColumn("conditions", F.create_map(F.lit("busy"), F.col("y") > 2)).withColumn("regressors", F.create_map(F.lit("x"), F.col("y"))).drop("y")
    f = predict(decode_models(encode_models(_fixed_models(h))), rows, components=False)
    return f.select("series_id", "pos", "ts_ms", r("value", 5).alias("value"))


_WEEKS = f"{ORDERS}, wk AS (SELECT series_id, ts_ms // (7*{DAY}::BIGINT) * (7*{DAY}::BIGINT) AS ts_ms, sum(y) AS y FROM h GROUP BY 1, 2)"


@register(f"""WITH {_WEEKS}, e AS (SELECT series_id, min(ts_ms) AS a, max(ts_ms) AS b FROM wk GROUP BY 1), k AS (SELECT series_id, b, CAST(floor((b - 56*{DAY}::BIGINT - a - 280*{DAY}::BIGINT) / (112.0*{DAY})) AS BIGINT) AS steps FROM e),
f AS (SELECT series_id, CAST(j AS INTEGER) AS fold, b - 56*{DAY}::BIGINT - (steps - j) * 112*{DAY}::BIGINT AS cutoff_ms FROM (SELECT series_id, b, steps, unnest(generate_series(0, steps)) AS j FROM k WHERE steps >= 0))
SELECT f.series_id, fold, cutoff_ms, ts_ms, ts_ms - cutoff_ms AS horizon_ms, y AS actual, true AS ordered FROM f JOIN wk ON wk.series_id = f.series_id AND ts_ms > cutoff_ms AND ts_ms <= cutoff_ms + 56*{DAY}::BIGINT""")
def cv_rows(spark, d):
    """The rows of cv_linear beside what was forecast for them; ordered: a point forecast stands in its range."""
    f = cv_linear(spark, d)
    return f.select("series_id", "fold", "cutoff_ms", "ts_ms", "horizon_ms", "actual", ((F.col("lower") < F.col("upper")) & ~F.isnan("predicted")).alias("ordered"))


@register(f"""WITH {ORDERS}, l AS (SELECT series_id, max(ts_ms) - 60*{DAY}::BIGINT AS c FROM h GROUP BY 1), b AS (SELECT h.series_id, arg_max(y, pos) AS p FROM h JOIN l ON l.series_id = h.series_id AND ts_ms <= c GROUP BY 1)
SELECT h.series_id, 'mae' AS metric, round(avg(abs(y - p)), 6) AS value, count(*) AS row_count, 'last' AS source FROM h JOIN l ON l.series_id = h.series_id AND ts_ms > c JOIN b ON b.series_id = h.series_id GROUP BY 1""")
def holdout_baseline(spark, d):
    h = orders_daily(spark, d)
    ends = h.groupBy("series_id").agg((F.max("ts_ms") - 60 * DAY).alias("c"))
    parts = h.join(ends, "series_id")
    report = search.evaluate_holdout(parts.filter("ts_ms <= c").drop("c"), parts.filter("ts_ms > c").drop("c"), ForecastOptions(), ["mae"], {"last": {"kind": "last"}})
    return report.filter("source = 'last'").withColumn("value", r("value"))


@register()
def posterior_components(spark, d):
    """Component ranges of a sampled model."""
    from ..options import Mcmc

    h = _weekly(orders_daily(spark, d))
    models = fit(h, ForecastOptions(mcmc=Mcmc(40, seed=5, chains=1), n_changepoints=3, weekly="off"))
    return simulate.posterior_component_intervals(models, make_future(h, 8, "W"))


@register()
def regressor_model_intervals(spark, d):
    """Ranges of a model whose regressor is forecast by a model of its own."""
    from ..operators.fit import fit_regressor_models

    own = ForecastOptions(yearly="off", weekly="off", n_changepoints=3)
    options = ForecastOptions(regressors=(Regressor("discount", predictor=own),), yearly="off", n_changepoints=3)
    h = lineitem_daily(spark, d).withColumn("regressors", F.create_map(F.lit("discount"), F.col("discount"))).drop("discount")
    ahead = make_future(h, 28, "D")
    subs = fit_regressor_models(h, options)
    from ..operators.predict import fill_regressor_values

    rows = fill_regressor_values(ahead, h, {k: predict(m, ahead, components=False) for k, m in subs.items()})
    drawn = simulate.regressor_draws(subs, dict.fromkeys(subs, ahead), seed=3, samples=50)
    return simulate.predict_uncertainty(fit(h, options), rows.join(drawn, ["series_id", "pos"], "left"), seed=3, samples=100)