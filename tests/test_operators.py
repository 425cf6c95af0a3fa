import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.errors import CountryHolidayError, EvaluationMetricError, EvaluationReportError, EvaluationSearchError, FutureTimestampsError, ModelSerializationError, ObservationError, SearchOptionsError, UncertaintyOptionsError
from tidecast.functions.future import future_timestamps, make_future
from tidecast.operators import predict as predict_module
from tidecast.operators import evaluate, events, history, metrics, search, simulate
from tidecast.operators.fit import fit, fit_regressor_models, fit_series, regressor_coefficients, warm_start_parameters
from tidecast.operators.predict import fill_regressor_values, pair_forecasts, predict, residuals
from tidecast.options import CountryHolidays, Event, ForecastOptions, Mcmc, Regressor, Seasonality
from tidecast.sources.codec import decode_models, encode_models, read_models, write_models
from tidecast.streaming.scoring import score_batches, windowed_series

DAY = 86_400_000


def ms(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def table(n=120, names=("a", "b"), noise=0.1):
    out = []
    for j, name in enumerate(names):
        rnd = np.random.default_rng(j)
        t = np.arange(n)
        y = 10 + j + 0.05 * t + 2 * np.sin(2 * np.pi * t / 7) + noise * rnd.standard_normal(n)
        out.append(pd.DataFrame({"series_id": name, "pos": t, "ts_ms": t * DAY, "y": y}))
    return pd.concat(out)


@pytest.fixture(scope="module")
def hist(spark):
    return spark.createDataFrame(table()).cache()


@pytest.fixture(scope="module")
def models(hist):
    out = fit(hist).cache()
    out.count()
    return out


def test_one_series_equals_many_and_numpy_equals_columns(spark, hist, models):
    alone = fit(hist.filter("series_id = 'b'")).first()
    among = models.filter("series_id = 'b'").first()
    assert alone["k"] == among["k"] and alone["deltas"] == among["deltas"]
    rows = predict(models, make_future(hist, 10, "D", include_history=True)).toPandas().sort_values(["series_id", "pos"])
    assert np.allclose(rows["value"], rows["trend"] * (1 + rows["multiplicative"]) + rows["additive"])
    own = fit_series(table(names=("a",)), ForecastOptions())
    mine = evaluate.predict_series(own, rows[rows.series_id == "a"][["ts_ms"]])
    assert np.allclose(mine["predicted"], rows[rows.series_id == "a"]["value"])
    assert rows["seasonalities"].iloc[0][0]["name"] == "weekly" and rows["seasonalities"].iloc[0][0]["factor"] is None
    left = residuals(models, hist).toPandas()
    assert abs(left["residual"].mean()) < 0.1 and np.allclose(left["actual"] - left["predicted"], left["residual"])


def test_codec_round_trip(spark, models, tmp_path):
    docs = encode_models(models)
    assert decode_models(docs).orderBy("series_id").collect() == models.orderBy("series_id").collect()
    with pytest.raises(ModelSerializationError):
        decode_models(docs.withColumn("document", F.lit("{}")))
    write_models(models, str(tmp_path / "m"))
    assert read_models(spark, str(tmp_path / "m")).count() == 2


def test_events_regressors_conditions_logistic(spark):
    pdf = table(150, ("a",)).assign(capacity=None)
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal(150)
    pdf["y"] += 4 * x
    pdf.loc[pdf.ts_ms == ms("1970-02-10"), "y"] += 9
    pdf["regressors"] = [{"x": float(v)} for v in x]
    pdf["conditions"] = [{"on": bool(i % 2)} for i in range(150)]
    df = spark.createDataFrame(pdf.drop(columns=["capacity"]), "series_id string, pos long, ts_ms long, y double, regressors map<string,double>, conditions map<string,boolean>")
    options = ForecastOptions(regressors=(Regressor("x"),), events=(Event("e", "1970-02-10", -1, 0),), seasonalities=(Seasonality("s", 5.0, 1, condition="on"),))
    history.check_names(df, options)
    with pytest.raises(ObservationError) as e:
        history.check_names(df, ForecastOptions(regressors=(Regressor("z"),)))
    assert e.value.reason == "missing-regressor"
    with pytest.raises(ObservationError):
        history.check_names(df, ForecastOptions(growth="logistic", regressors=(Regressor("x"),)))
    m = fit(df, options)
    c = regressor_coefficients(m).first()
    assert abs(c["coef"] - 4) < 0.2
    found = predict(m, df.drop("y")).toPandas().sort_values("pos")
    assert np.abs(found["value"].to_numpy() - pdf["y"].to_numpy()).mean() < 0.5
    on = found[found.ts_ms == ms("1970-02-10")].iloc[0]["events"][0]
    assert on["name"] == "e" and on["value"] > 5
    assert {r["name"] for r in found.iloc[0]["regressors"]} == {"x"}
    assert all(r[0]["value"] == 0 for r, i in zip(found["seasonalities"], range(150), strict=True) if r[0]["name"] == "s" and i % 2 == 0)
    grow = spark.createDataFrame(pd.DataFrame({"series_id": "g", "pos": range(60), "ts_ms": np.arange(60) * DAY, "y": 8 / (1 + np.exp(-(np.arange(60) - 30) / 6)), "capacity": 8.0}))
    gm = fit(grow, ForecastOptions(growth="logistic", weekly="off"))
    got = predict(gm, grow.drop("y"), components=False).toPandas().sort_values("pos")
    assert np.abs(got["value"].to_numpy() - 8 / (1 + np.exp(-(np.arange(60) - 30) / 6))).max() < 0.4


def test_future_timestamps(spark):
    def run(anchor, periods, frequency):
        df = spark.createDataFrame([("a", ms(anchor))], "series_id string, anchor_ms long")
        return [dt.datetime.fromtimestamp(r["ts_ms"] / 1000, dt.timezone.utc).strftime("%Y-%m-%dT%H") for r in future_timestamps(df, periods, frequency).orderBy("pos").collect()]

    assert run("2024-01-30T05", 2, "h") == ["2024-01-30T06", "2024-01-30T07"]
    assert run("2024-01-31T05", 3, "ME") == ["2024-02-29T05", "2024-03-31T05", "2024-04-30T05"]
    assert run("2024-01-30T05", 2, "ME") == ["2024-01-31T05", "2024-02-29T05"]
    assert run("2024-01-01T00", 2, "MS") == ["2024-02-01T00", "2024-03-01T00"]
    assert run("2024-01-07T00", 2, "W") == ["2024-01-14T00", "2024-01-21T00"]
    assert run("1969-12-30T23", 2, "W-WED") == ["1969-12-31T23", "1970-01-07T23"]
    assert run("2024-01-01T00", 0, "D") == []
    with pytest.raises(FutureTimestampsError):
        run("2024-01-01T00", 1, "Q")


def test_decode_and_resolution(spark):
    text = spark.createDataFrame([("2024-01-01T00:00:00.000Z",), ("2024-02-30T00:00:00.000Z",), ("2024-1-1",), ("1969-12-31T23:00:00.001Z",), (None,)], "t string")
    assert [r[0] for r in text.select(history.parse_timestamp(F.col("t"))).collect()] == [ms("2024-01-01"), None, None, -3_599_999, None]
    rows = spark.createDataFrame([("a", 5, 1.0, 0), ("a", 3, 2.0, 1), ("a", 3, 9.0, 2)], "series_id string, ts_ms long, y double, input_ord int")
    assert [(r["pos"], r["y"]) for r in history.decode_observations(rows).orderBy("pos").collect()] == [(0, 2.0), (1, 9.0), (2, 1.0)]
    for bad, reason in ((rows.limit(0), "empty"), (rows.withColumn("y", F.lit(float("nan"))), "invalid-shape")):
        with pytest.raises(ObservationError) as e:
            history.decode_observations(bad)
        assert e.value.reason == reason
    x = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", 5.0), ("c", 5.0)], "series_id string, x double")
    got = {r["series_id"]: (r["transform"], r["mean"]) for r in history.resolve_regressor_transform(x).collect()}
    assert got == {"a": ("identity", 0.0), "b": ("standardized", 3.0), "c": ("identity", 0.0)}


def test_uncertainty_anomalies_and_limits(hist, models):
    ahead = make_future(hist, 7, "D")
    a = simulate.predict_uncertainty(models, ahead, seed=5, samples=200).orderBy("series_id", "pos").toPandas()
    b = simulate.predict_uncertainty(models, ahead.repartition(5), seed=5, samples=200).orderBy("series_id", "pos").toPandas()
    assert a.equals(b) and (a["value_lower"] < a["value_upper"]).all()
    assert simulate.predict_uncertainty(models, ahead, 5, 20, output="samples").count() == 2 * 7 * 20
    odd = hist.withColumn("y", F.when((F.col("pos") == 50) & (F.col("series_id") == "a"), F.col("y") + 30).otherwise(F.col("y")))
    found = simulate.detect_anomalies(models, odd, seed=1, samples=200)
    above = {(r["series_id"], r["pos"]) for r in found.filter("position = 'above'").collect()}
    assert ("a", 50) in above and len(above) <= 4
    with pytest.raises(Exception, match="simulation-limit"):
        simulate.predict_uncertainty(models, make_future(hist, 5000, "D"), seed=5, samples=2).count()
    with pytest.raises(UncertaintyOptionsError):
        simulate.predict_uncertainty(models, ahead, 5, 20, output="paths")


def test_cross_validation_equals_fitting_the_prefix(hist):
    folds = evaluate.plan_rolling_origin(hist, 7 * DAY, cutoffs_ms=(80 * DAY, 100 * DAY))
    assert {(r["fold"], r["training_count"], r["assessment_count"]) for r in folds.collect()} == {(0, 81, 7), (1, 101, 7)}
    cv = evaluate.cross_validate(hist, ForecastOptions(), folds, 7 * DAY, intervals={"seed": 1, "samples": 100}).toPandas()
    assert len(cv) == 28 and (cv["lower"] < cv["upper"]).all()
    model = fit_series(table(names=("a",)).query("ts_ms <= @DAY * 80"), ForecastOptions())
    want = evaluate.predict_series(model, pd.DataFrame({"ts_ms": (81 + np.arange(7)) * DAY}))["predicted"]
    assert np.allclose(cv[(cv.series_id == "a") & (cv.fold == 0)].sort_values("ts_ms")["predicted"], want)
    assert evaluate.same_plan(folds, evaluate.plan_rolling_origin(hist, 7 * DAY, cutoffs_ms=(80 * DAY, 100 * DAY)))
    made = evaluate.plan_rolling_origin(hist, 7 * DAY, initial_ms=60 * DAY)
    regular = evaluate.generate_cutoffs_regular(hist, 7 * DAY, initial_ms=60 * DAY)
    assert {(r["series_id"], r["cutoff_ms"]) for r in made.collect()} == {(r["series_id"], r["cutoff_ms"]) for r in regular.collect()}


def test_metric_guards(spark):
    row = ("a", 0, 0, 5, 5, 0.0, 1.0, None, None)
    cv = spark.createDataFrame([row], "series_id string, fold int, cutoff_ms long, ts_ms long, horizon_ms long, actual double, predicted double, lower double, upper double")
    for names, reason in ((["mape"], "zero-actual"), (["coverage"], "unavailable")):
        with pytest.raises(EvaluationMetricError) as e:
            metrics.validate(cv, [metrics.METRICS[n] for n in names])
        assert e.value.reason == reason
    metrics.validate(cv, [metrics.METRICS["mae"]])
    assert metrics.performance(cv, ["smape"]).first()["value"] == 2.0


def test_search_and_holdout(hist):
    folds = evaluate.plan_rolling_origin(hist, 7 * DAY, cutoffs_ms=(80 * DAY, 100 * DAY))
    grid = search.parameter_grid(ForecastOptions(), {"growth": ["flat", "linear"]})
    assert [g for g, _ in grid] == ["grid-0", "grid-1"]
    found = search.search_models(hist, grid, folds, 7 * DAY).filter("best").collect()
    assert {(r["series_id"], r["candidate"]) for r in found} == {("a", "grid-1"), ("b", "grid-1")}
    broken = [("no-capacity", ForecastOptions(growth="logistic")), *grid]
    kept = search.search_models(hist, broken, folds, 7 * DAY, mode="record").collect()
    assert {r["candidate"] for r in kept} == {"grid-0", "grid-1"} and {r["candidate"] for r in kept if r["best"]} == {"grid-1"}
    with pytest.raises(EvaluationSearchError):
        search.search_models(hist, broken[:1], folds, 7 * DAY, mode="record")
    with pytest.raises(SearchOptionsError):
        search.parameter_grid(ForecastOptions(), {"growth": ["flat", "flat"]})
    report = search.evaluate_holdout(hist.filter("pos < 100"), hist.filter("pos >= 100"), ForecastOptions(), ["mae"], {"last": {"kind": "last"}}).toPandas()
    assert report[report.source == "model"]["value"].max() < 0.5 < report[report.source == "last"]["value"].min()
    facts = [{"series_id": "a", "actual": 3.0, "predicted": 2.0}, {"series_id": "a", "actual": 1.0, "predicted": 1.5}]
    score = {"series_id": "a", "metric": "mae", "value": 0.75, "row_count": 2, "source": "model"}
    assert search.decode_report(search.encode_report([score], facts)) == {"version": 1, "metrics": [score], "forecasts": facts}
    for text, reason in ((search.encode_report([{**score, "value": 0.5}], facts), "score-mismatch"), ("{", "decode"), ("{}", "decode")):
        with pytest.raises(EvaluationReportError) as e:
            search.decode_report(text)
        assert e.value.reason == reason


def test_country_calendars(monkeypatch):
    names = {(d, n) for _, _, d, n in events.country_rows("US", [2024])}
    day = lambda t: events.parse_date(t)
    assert {(day("2024-07-04"), "Independence Day"), (day("2024-11-28"), "Thanksgiving Day"), (day("2024-05-27"), "Memorial Day")} <= names
    assert (day("2024-04-01"), "Easter Monday") in {(d, n) for _, _, d, n in events.country_rows("DE", [2024])}
    with pytest.raises(CountryHolidayError):
        events.country_rows("XX", [2024])
    assert any(e.name == "Wedding of William and Catherine" for e in events.merged_events(ForecastOptions(country_holidays=CountryHolidays("GB")), [2011]))
    monkeypatch.setattr(events, "KNOWN_GAPS", [("GB", 2011, 2012, "a day that no rule has")])
    with pytest.raises(CountryHolidayError):
        events.merged_events(ForecastOptions(country_holidays=CountryHolidays("GB")), [2011])
    assert events.column_name("x", -2) == "x_delim_-2" and events.column_name("x", 0) == "x_delim_+0"


def test_regressor_models_warm_start_and_pairs(spark, hist):
    rows = hist.withColumn("regressors", F.create_map(F.lit("x"), F.col("y") * 2))
    options = ForecastOptions(regressors=(Regressor("x", predictor=ForecastOptions()),))
    sub = fit_regressor_models(rows, options)
    ahead = make_future(hist, 5, "D")
    filled = fill_regressor_values(ahead, rows, {"x": predict(sub["x"], ahead, components=False)})
    assert filled.filter("regressors['x'] is null").count() == 0
    m = fit(rows, options)
    assert predict(m, filled).count() == 10
    again = fit(rows, options.with_(warm_start=warm_start_parameters(m)))
    assert all(abs(a["m"] - b["m"]) < 0.5 for a, b in zip(m.orderBy("series_id").collect(), again.orderBy("series_id").collect(), strict=True))
    with pytest.raises(Exception, match="aligned"):
        pair_forecasts(hist, predict(m, filled, components=False))


def test_sampled_models(spark):
    df = spark.createDataFrame(table(40, ("a",)))
    m = fit(df, ForecastOptions(weekly="off", n_changepoints=2, mcmc=Mcmc(40, 3, chains=2))).cache()
    row = m.first()
    assert row["model_kind"] == "mcmc-linear" and len(row["draws"]) == 40 and {d["name"] for d in row["diagnostics"]} == {"k", "m", "sigma"}
    ranges = simulate.predict_uncertainty(m, make_future(df, 3, "D"), seed=1, samples=60).toPandas()
    assert len(ranges) == 3 and (ranges["value_lower"] < ranges["value_upper"]).all()


def test_stream_scoring(spark, models, tmp_path):
    source, seen = str(tmp_path / "in"), []
    make = spark.createDataFrame([("a", 0, 200 * DAY), ("b", 0, 200 * DAY)], "series_id string, pos long, ts_ms long")
    make.write.parquet(source)
    query = score_batches(models, spark.readStream.schema(make.schema).parquet(source), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert {r["series_id"] for r in seen} == {"a", "b"}
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "k", 1.0), (dt.datetime(2024, 1, 1, 7), "k", 2.0)], "ts timestamp, kind string, value double")
    assert windowed_series(ev, "kind").first()["y"] == 3.0


def test_country_holidays_after_the_history(spark):
    day = lambda t: ms(t) // DAY
    t = np.arange(day("2021-01-01"), day("2023-12-31") + 1)
    hit = np.isin(t, [day(f"{y}-{md}") for y in (2021, 2022, 2023) for md in ("07-04", "12-25")])
    pdf = pd.DataFrame({"series_id": "a", "pos": np.arange(len(t)), "ts_ms": t * DAY, "y": 20 + 8.0 * hit + 0.1 * np.random.default_rng(0).standard_normal(len(t))})
    df = spark.createDataFrame(pdf)
    options = ForecastOptions(country_holidays=CountryHolidays("US"), yearly="off", weekly="off")
    m = fit(df, options).cache()
    days = ["2024-07-04", "2024-07-05", "2024-12-25", "2026-12-25"]
    rows = spark.createDataFrame([("a", i, ms(d)) for i, d in enumerate(days)], "series_id string, pos long, ts_ms long")
    got = predict(m, rows).toPandas().sort_values("pos")
    assert np.allclose(got["additive"], [8, 0, 8, 8], atol=0.5)
    assert {e["name"] for e in got["events"].iloc[2] if e["value"]} == {"Christmas Day"}
    again = predict(decode_models(encode_models(m)), rows).toPandas().sort_values("pos")
    assert np.allclose(got["value"], again["value"])
    one = evaluate.predict_series(m.first().asDict(recursive=True), pd.DataFrame({"ts_ms": [ms(d) for d in days]}))
    assert np.allclose(one["predicted"], got["value"])
    folds = spark.createDataFrame([("a", 0, ms("2022-12-20"))], "series_id string, fold int, cutoff_ms long")
    cv = evaluate.cross_validate(df, options, folds, 220 * DAY).toPandas().set_index("ts_ms")
    assert cv.loc[ms("2023-07-04"), "predicted"] - cv.loc[ms("2023-07-05"), "predicted"] > 6
    with pytest.raises(Exception, match="invalid-year"):
        predict(m, spark.createDataFrame([("a", 0, ms("2061-01-01"))], "series_id string, pos long, ts_ms long")).collect()
    assert (events.parse_date("2027-12-31"), "New Year's Day (observed)") in {(d, n) for _, _, d, n in events.country_rows("US", [2027])}


def test_movable_feasts():
    listed = {1995: "04-16", 1996: "04-07", 1997: "03-30", 1998: "04-12", 1999: "04-04", 2000: "04-23", 2001: "04-15", 2008: "03-23", 2011: "04-24", 2019: "04-21", 2024: "03-31", 2038: "04-25"}
    for year, text in listed.items():
        easter = events.parse_date(f"{year}-{text}")
        found = {n: d for _, _, d, n in events.country_rows("FR", [year])}
        assert [found[n] - easter for n in ("Easter Monday", "Ascension Day", "Pentecost Monday")] == [1, 39, 50] and len(found) == 11


def test_gb_and_us_days_as_observed():
    days = lambda c, y: {(n, (dt.date(1970, 1, 1) + dt.timedelta(days=d)).isoformat()) for _, _, d, n in events.country_rows(c, [y])}
    assert {("Christmas Day (observed)", "2021-12-27"), ("Boxing Day (observed)", "2021-12-28")} <= days("GB", 2021)
    assert ("Christmas Day (observed)", "2022-12-27") in days("GB", 2022) and ("New Year's Day (observed)", "2022-01-03") in days("GB", 2022)
    assert ("Boxing Day (observed)", "2020-12-28") in days("GB", 2020) and ("May Day", "2020-05-08") in days("GB", 2020)
    assert {("Spring Bank Holiday", "2022-06-02"), ("State Funeral of Queen Elizabeth II", "2022-09-19")} <= days("GB", 2022)
    assert ("New Year's Day (observed)", "2021-12-31") in days("US", 2021) and not any("New Year" in n and "observed" in n for n, _ in days("US", 2022))
    assert ("Reformation Day", "2017-10-31") in days("DE", 2017) and not any(n == "Reformation Day" for n, _ in days("DE", 2018))


def test_calendar_documents_are_read(spark, tmp_path):
    (tmp_path / "XX.json").write_text(json.dumps({"country": "XX", "firstYear": 2000, "lastYear": 2001, "names": ["A", "B"], "years": [[[10957, 1], [10960, 0]], []], "coverage": {"issues": []}}))
    (tmp_path / "YY.json").write_text(json.dumps({"country": "YY", "firstYear": 2001, "lastYear": 2001, "names": ["C"], "years": [[[11323, 0]]]}))
    got = {tuple(r) for r in events.load_calendar(spark, str(tmp_path)).collect()}
    assert got == {("XX", 2000, 10957, "B"), ("XX", 2000, 10960, "A"), ("YY", 2001, 11323, "C")}
    assert events.inspect_country_holidays(events.load_calendar(spark, str(tmp_path)), "XX", [2000]).count() == 2


def test_rows_that_do_not_fit_raise_their_reason(spark, hist, models):
    with pytest.raises(Exception, match="missing-regressor"):
        fit(hist, ForecastOptions(regressors=(Regressor("z"),))).collect()
    with pytest.raises(Exception, match="bound-on-non-logistic"):
        fit(hist.withColumn("capacity", F.lit(9.0))).collect()
    with pytest.raises(Exception, match="missing-capacity"):
        fit(hist, ForecastOptions(growth="logistic")).collect()
    with pytest.raises(Exception, match="invalid-target"):
        fit(hist.withColumn("y", F.lit(float("nan")))).collect()
    with pytest.raises(Exception, match="changepoint-out-of-range"):
        fit(hist, ForecastOptions(changepoints_ms=(-5 * DAY,))).collect()
    ahead = make_future(hist, 3, "D")
    for column, reason in ((F.create_map(F.lit("z"), F.lit(1.0)), "unexpected-regressor"),):
        with pytest.raises(Exception, match=reason):
            predict(models, ahead.withColumn("regressors", column)).collect()
    with pytest.raises(Exception, match="unexpected-condition"):
        predict(models, ahead.withColumn("conditions", F.create_map(F.lit("z"), F.lit(True)))).collect()
    with pytest.raises(Exception, match="bound-on-non-logistic"):
        predict(models, ahead.withColumn("floor", F.lit(1.0))).collect()
    seasonal = fit(hist.withColumn("conditions", F.create_map(F.lit("c"), F.col("pos") > 50)), ForecastOptions(seasonalities=(Seasonality("s", 7.0, 1, condition="c"),), weekly="off"))
    with pytest.raises(Exception, match="missing-condition"):
        predict(seasonal, ahead).collect()
    with pytest.raises(Exception, match="timestamp-overflow"):
        future_timestamps(spark.createDataFrame([("a", 8_640_000_000_000_000)], "series_id string, anchor_ms long"), 1, "D").collect()
    cv = spark.createDataFrame([("a", 0, 0, 5, 5, 0.0, 1.0, None, None)], "series_id string, fold int, cutoff_ms long, ts_ms long, horizon_ms long, actual double, predicted double, lower double, upper double")
    for names, frame, reason in ((["mape"], cv, "zero-actual"), (["coverage"], cv, "unavailable"), (["mae"], cv.withColumn("horizon_ms", F.lit(4).cast("long")), "misaligned"), (["mae"], cv.withColumn("predicted", F.lit(float("inf"))), "non-finite")):
        with pytest.raises(Exception, match=reason):
            metrics.performance(frame, names).collect()
    extra = ahead.unionByName(ahead.filter("series_id = 'a'").withColumn("series_id", F.lit("none")))
    assert predict_module.unmodelled_rows(models, extra).count() == 3 and predict(models, extra).count() == ahead.count()


def test_posterior_ranges_use_each_draws_coefficients(spark):
    n = 120
    y = 5 + 2 * np.sin(2 * np.pi * np.arange(n) / 7) + np.random.default_rng(2).normal(0, 0.1, n)
    h = spark.createDataFrame(pd.DataFrame({"series_id": "a", "pos": range(n), "ts_ms": np.arange(n) * DAY, "y": y}))
    model = fit(h, ForecastOptions(growth="flat"))
    pair = [(0.0, 0.0), (3.0, 0.0)]  # two draws that differ in the weekly terms only
    size = len(model.first()["seasonalities"][0]["coef"])
    draw = lambda i, a: F.struct(F.lit(0).alias("chain"), F.lit(i).alias("draw"), F.col("k").alias("k"), F.col("m").alias("m"), F.lit(1e-9).alias("sigma"), F.col("deltas").alias("deltas"), F.array(F.lit(a), *[F.lit(0.0)] * (size - 1)).alias("beta"))
    sampled = model.withColumn("draws", F.array(*(draw(i, a) for i, (a, _) in enumerate(pair))))
    ahead = make_future(h, 14, "D")
    got = simulate.predict_uncertainty(sampled, ahead, seed=1, samples=5, output="samples").toPandas()
    assert got["sample"].nunique() == 6  # ceil(5 / 2) for each draw
    sine = np.sin(2 * np.pi * (n + got["pos"].to_numpy()) / 7)
    want = got["trend"].to_numpy() + np.where(got["sample"] < 3, 0.0, 3.0) * sine
    assert np.allclose(got["value"], want, atol=1e-6)
    ranges = simulate.posterior_component_intervals(sampled, ahead, 0.8).toPandas()
    assert {(k, x) for k, x in zip(ranges["kind"], ranges["name"], strict=True)} == {("seasonality", "weekly"), ("total", "additive"), ("total", "multiplicative")}
    weekly = ranges[ranges.name == "weekly"]
    spread = np.abs(3 * np.sin(2 * np.pi * (n + weekly["pos"].to_numpy()) / 7))
    assert np.allclose(weekly["upper"] - weekly["lower"], 0.8 * spread, atol=1e-9)


def test_regressor_models_widen_ranges(spark, hist):
    rows = hist.withColumn("regressors", F.create_map(F.lit("x"), F.col("pos") % 5 + F.rand(3)))
    m = fit(rows, ForecastOptions(regressors=(Regressor("x"),), weekly="off")).withColumn("regressors", F.transform("regressors", lambda r: r.withField("coef", F.lit(4.0)))).withColumn("sigma", F.lit(1e-9))
    ahead = make_future(hist, 4, "D").withColumn("regressors", F.create_map(F.lit("x"), F.lit(2.0)))
    moved = ahead.withColumn("regressor_draws", F.create_map(F.lit("x"), F.struct(F.array(F.lit(1.0), F.lit(3.0)).alias("draws"), F.lit(2.0).alias("point"))))
    plain = simulate.predict_uncertainty(m, ahead, 1, 10, output="samples").toPandas()
    wide = simulate.predict_uncertainty(m, moved, 1, 10, output="samples").toPandas()
    sd = m.select("series_id", F.col("regressors")[0]["sd"].alias("sd")).toPandas().set_index("series_id")["sd"]
    both = plain.merge(wide, on=["series_id", "pos", "sample"])
    step = 4.0 / both["series_id"].map(sd) * np.where(both["sample"] % 2 == 0, -1.0, 1.0)
    assert np.allclose(both["value_y"] - both["value_x"], step, atol=1e-6)


def test_rolling_windows_equal_a_plain_sweep(spark):
    rnd = np.random.default_rng(7)
    rows = [("a", f, 0, int(t), int(t), float(rnd.integers(1, 9)), float(rnd.integers(1, 9)), None, None) for f in range(6) for t in sorted(rnd.choice(np.arange(1, 12), 7, replace=False))]
    cv = spark.createDataFrame(rows, "series_id string, fold int, cutoff_ms long, ts_ms long, horizon_ms long, actual double, predicted double, lower double, upper double")
    order = sorted(rows, key=lambda r: (r[4], r[1], r[3]))
    error = [abs(r[5] - r[6]) for r in order]
    for w in (1, 5, 13, 42):
        means = {r["horizon"]: r["value"] for r in metrics.performance(cv, ["mae"], "rolling", window_rows=w).collect()}
        p50 = metrics.Metric("p50", lambda: F.abs(F.col("actual") - F.col("predicted")), reduce="median")
        medians = {r["horizon"]: (r["value"], r["row_count"]) for r in metrics.performance(cv, [p50], "rolling", window_rows=w).collect()}
        want_mean, want_median = {}, {}
        for h in sorted({r[4] for r in order}):
            start, end = min(i for i, r in enumerate(order) if r[4] == h), max(i for i, r in enumerate(order) if r[4] == h) + 1
            if end >= w:
                part = error[min(start, end - w) : end]
                want_median[h] = (float(np.median(part)), len(part))
                left, total = w, 0.0
                for g in sorted({r[4] for r in order if r[4] <= h}, reverse=True):
                    own = [e for e, r in zip(error, order, strict=True) if r[4] == g]
                    take = min(left, len(own))
                    total += sum(own) * take / len(own)
                    left -= take
                want_mean[h] = total / w
        assert means.keys() == want_mean.keys() and all(abs(means[h] - want_mean[h]) < 1e-9 for h in means)
        assert medians == want_median
