"""Events and country holidays: small calendars expanded by their windows and met with rows by epoch day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CountryHolidayError, OptionsError
from ..options import DELIMITER, CountryHolidays, Event, ForecastOptions

MAX_COLUMNS = 10_000
FIRST_YEAR, LAST_YEAR = 1995, 2060


def parse_date(text: str) -> int:
    """Epoch day of a zero-padded Gregorian date."""
    try:
        day = dt.date.fromisoformat(text)
    except ValueError:
        day = None
    if day is None or day.isoformat() != text:
        raise OptionsError("invalid-value", f"not a date: {text!r}")
    return (day - dt.date(1970, 1, 1)).days


def event_columns(events: list[Event] | tuple[Event, ...]) -> list[tuple[str, int, int]]:
    """(name, epoch day, offset) of each indicator day, without repeats; columns in code-point order of their names."""
    out = sorted({(e.name, parse_date(e.date) + o, o) for e in events for o in range(e.lower_window, e.upper_window + 1)}, key=lambda x: (column_name(x[0], x[2]), x[1]))
    if len({(n, o) for n, _, o in out}) > MAX_COLUMNS:
        raise OptionsError("limit-exceeded", f"more than {MAX_COLUMNS} event columns")
    return out


def column_name(name: str, offset: int) -> str:
    return f"{name}{DELIMITER}{'+' if offset >= 0 else '-'}{abs(offset)}"


def event_frame(spark: SparkSession, events: list[Event] | tuple[Event, ...]) -> DataFrame:
    rows = sorted({(e.name, e.date, parse_date(e.date), e.lower_window, e.upper_window) for e in events})
    return spark.createDataFrame(rows, "name string, date string, epoch_day int, lower_window int, upper_window int").withColumn("date", F.to_date("date"))


def expand_events(events: DataFrame) -> DataFrame:
    """(name, epoch_day, lower_window, upper_window) -> (name, column, epoch_day, offset), one row per indicator day."""
    each = events.select("name", "epoch_day", F.explode(F.sequence("lower_window", "upper_window")).alias("offset"))
    sign = F.when(F.col("offset") >= 0, "+").otherwise("-")
    return each.select("name", F.concat("name", F.lit(DELIMITER), sign, F.abs("offset").cast("string")).alias("column"), (F.col("epoch_day") + F.col("offset")).alias("epoch_day"), "offset").distinct()


def event_features(rows: DataFrame, expanded: DataFrame) -> DataFrame:
    """rows (series_id, pos, ts_ms) -> (series_id, pos, column): the indicators that are 1. Repeats stay binary."""
    day = rows.select("series_id", "pos", F.floor(F.col("ts_ms") / 86_400_000).cast("int").alias("epoch_day"))
    return day.join(expanded.select("epoch_day", "column").distinct(), "epoch_day").select("series_id", "pos", "column")


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday (Monday 0) of a month; the last for n = -1."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7)


def _easter(year: int) -> dt.date:
    a, b, c = year % 19, year // 100, year % 100
    d = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * (c // 4) - d - c % 4) % 7
    f = d + e - 7 * ((a + 11 * d + 22 * e) // 451) + 114
    return dt.date(year, f // 31, f % 31 + 1)


def _rules(country: str, year: int) -> list[tuple[dt.date, str]]:
    easter, day = _easter(year), dt.timedelta(days=1)
    if country == "US":
        fixed = [(dt.date(year, 1, 1), "New Year's Day"), (dt.date(year, 7, 4), "Independence Day"), (dt.date(year, 11, 11), "Veterans Day"), (dt.date(year, 12, 25), "Christmas Day")]
        if year >= 2021:
            fixed.append((dt.date(year, 6, 19), "Juneteenth National Independence Day"))
        floating = [(_nth(year, 1, 0, 3), "Martin Luther King Jr. Day"), (_nth(year, 2, 0, 3), "Washington's Birthday"), (_nth(year, 5, 0, -1), "Memorial Day"), (_nth(year, 9, 0, 1), "Labor Day"), (_nth(year, 10, 0, 2), "Columbus Day"), (_nth(year, 11, 3, 4), "Thanksgiving Day")]
        seen = [(d + day * {5: -1, 6: 1}[d.weekday()], f"{n} (observed)") for d, n in fixed if d.weekday() >= 5]
        return fixed + floating + seen
    if country == "DE":
        fixed = [(dt.date(year, m, d), n) for m, d, n in ((1, 1, "New Year's Day"), (5, 1, "Labor Day"), (10, 3, "German Unity Day"), (12, 25, "Christmas Day"), (12, 26, "Second Day of Christmas"))]
        fixed += [(dt.date(2017, 10, 31), "Reformation Day")] * (year == 2017)
        return fixed + [(easter - 2 * day, "Good Friday"), (easter + day, "Easter Monday"), (easter + 39 * day, "Ascension Day"), (easter + 50 * day, "Pentecost Monday")]
    if country == "FR":
        fixed = [(dt.date(year, m, d), n) for m, d, n in ((1, 1, "New Year's Day"), (5, 1, "Labor Day"), (5, 8, "Victory Day"), (7, 14, "National Day"), (8, 15, "Assumption Day"), (11, 1, "All Saints' Day"), (11, 11, "Armistice Day"), (12, 25, "Christmas Day"))]
        return fixed + [(easter + day, "Easter Monday"), (easter + 39 * day, "Ascension Day"), (easter + 50 * day, "Pentecost Monday")]
    if country == "GB":
        new_year, christmas, boxing = dt.date(year, 1, 1), dt.date(year, 12, 25), dt.date(year, 12, 26)
        moved = {n: dt.date.fromisoformat(d) for d, n in GB_MOVED if d.startswith(str(year))}
        out = [(new_year, "New Year's Day"), (christmas, "Christmas Day"), (boxing, "Boxing Day"), (easter - 2 * day, "Good Friday")]
        out += [(moved.get("May Day", _nth(year, 5, 0, 1)), "May Day"), (moved.get("Spring Bank Holiday", _nth(year, 5, 0, -1)), "Spring Bank Holiday")]
        out += [(dt.date.fromisoformat(d), n) for d, n in GB_ONCE if d.startswith(str(year))]
        if new_year.weekday() >= 5:
            out.append((new_year + day * (7 - new_year.weekday()), "New Year's Day (observed)"))
        if christmas.weekday() >= 5:  # the next day that is no holiday yet
            out.append((dt.date(year, 12, 27), "Christmas Day (observed)"))
        if boxing.weekday() >= 5:
            out.append((dt.date(year, 12, 28), "Boxing Day (observed)"))
        return out
    raise CountryHolidayError("unknown-country", country)


#: Countries with a rule here; other calendars come as a CALENDAR table of the caller's.
COUNTRIES = ("DE", "FR", "GB", "US")
#: Days that took the place of the rule's, and holidays of one year.
GB_MOVED = [("1995-05-08", "May Day"), ("2002-06-04", "Spring Bank Holiday"), ("2012-06-04", "Spring Bank Holiday"), ("2020-05-08", "May Day"), ("2022-06-02", "Spring Bank Holiday")]
GB_ONCE = [
    ("1999-12-31", "Millennium Celebrations"), ("2002-06-03", "Golden Jubilee of Elizabeth II"), ("2011-04-29", "Wedding of William and Catherine"), ("2012-06-05", "Diamond Jubilee of Elizabeth II"),
    ("2022-06-03", "Platinum Jubilee of Elizabeth II"), ("2022-09-19", "State Funeral of Queen Elizabeth II"), ("2023-05-08", "Coronation of Charles III"),
]
#: Spans of years whose national rules had exceptions that no rule here has: (country, first year, last year, what). None now.
KNOWN_GAPS: list[tuple[str, int, int, str]] = []


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    """CALENDAR rows of calendar documents: JSON with country, firstYear, names, and by year a list of [epoch day, name number]."""
    schema = "country string, firstYear int, names array<string>, years array<array<array<int>>>"
    documents = spark.read.schema(schema).option("multiLine", True).json(path)
    years = documents.select("country", "names", "firstYear", F.posexplode("years").alias("i", "days"))
    days = years.select("country", "names", (F.col("firstYear") + F.col("i")).alias("year"), F.explode("days").alias("d"))
    return days.select("country", "year", F.col("d")[0].alias("epoch_day"), F.get("names", F.col("d")[1]).alias("name"))


def country_rows(country: str, years: list[int] | range) -> list[tuple[str, int, int, str]]:
    """(country, year, epoch day, name), days and names without repeats, in order."""
    if country not in COUNTRIES:
        raise CountryHolidayError("unknown-country", country)
    if any(not FIRST_YEAR <= y <= LAST_YEAR for y in years):
        raise CountryHolidayError("invalid-year", f"years {FIRST_YEAR} to {LAST_YEAR} are covered")
    found = {(d, n) for y in {*years, *(y + 1 for y in years)} for d, n in _rules(country, y)}  # New Year's Day may be observed in the old year
    return sorted({(country, d.year, (d - dt.date(1970, 1, 1)).days, n) for d, n in found if d.year in set(years)}, key=lambda r: (r[2], r[3]))


def calendar_frame(spark: SparkSession, countries: tuple[str, ...] = COUNTRIES, years: range = range(FIRST_YEAR, LAST_YEAR + 1)) -> DataFrame:
    return spark.createDataFrame([r for c in countries for r in country_rows(c, years)], "country string, year int, epoch_day int, name string")


def coverage_issues(calendar_gaps: DataFrame, requested: DataFrame) -> DataFrame:
    """Gaps (country, first_year, last_year, what) that hold any requested (year): a range semi-join."""
    return calendar_gaps.join(F.broadcast(requested), F.col("year").between(F.col("first_year"), F.col("last_year")), "left_semi")


def inspect_country_holidays(calendar: DataFrame, country: str, years: list[int]) -> DataFrame:
    """Occurrences of a country in the years, without repeats."""
    return calendar.filter((F.col("country") == country) & F.col("year").isin(years)).select("country", "epoch_day", "name").distinct()


def _reject_gaps(country: str, coverage: str, years: list[int]) -> None:
    if coverage == "reject-known-gaps":
        bad = [g for g in KNOWN_GAPS if g[0] == country and any(g[1] <= y <= g[2] for y in years)]
        if bad:
            raise CountryHolidayError("known-gap", "; ".join(g[3] for g in bad))


def country_state(options: ForecastOptions) -> dict | None:
    """What a model carries of its country: the selection, and custom names whose prior scale a holiday may not share."""
    chosen = options.country_holidays
    if chosen is None:
        return None
    prior = chosen.prior_scale or options.holidays_prior_scale
    conflicts = sorted({e.name for e in options.events if (e.prior_scale or options.holidays_prior_scale) != prior})
    return {"country": chosen.country, "coverage": chosen.coverage, "conflicts": conflicts}


def predicted_holidays(country: dict | None, years: list[int], fitted: set[str]) -> list[tuple[str, int, int]]:
    """(name, epoch day, offset) of a model's holidays in the years of prediction rows; only fitted names."""
    if country is None:
        return []
    _reject_gaps(country["country"], country["coverage"], years)
    made = [(n, d, 0) for _, _, d, n in country_rows(country["country"], years) if n in fitted]
    if any(n in country["conflicts"] for n, _, _ in made):
        raise CountryHolidayError("prior-conflict")
    return made


def holiday_years(spark: SparkSession) -> DataFrame:
    """(country, holiday_year, holidays, gap) of every covered year: at most some 260 rows."""
    rows: dict[tuple[str, int], list[tuple[int, str]]] = {}
    for c in COUNTRIES:
        for _, y, d, n in country_rows(c, range(FIRST_YEAR, LAST_YEAR + 1)):
            rows.setdefault((c, y), []).append((d, n))
    gap = lambda c, y: next((g[3] for g in KNOWN_GAPS if g[0] == c and g[1] <= y <= g[2]), None)
    return spark.createDataFrame([(c, y, days, gap(c, y)) for (c, y), days in rows.items()], "holiday_country string, holiday_year int, holidays array<struct<epoch_day:int,name:string>>, gap string")


def merged_events(options: ForecastOptions, years: list[int]) -> tuple[Event, ...]:
    """Configured events and the generated holidays of the years; one prior scale per name."""
    chosen: CountryHolidays | None = options.country_holidays
    if chosen is None:
        return options.events
    _reject_gaps(chosen.country, chosen.coverage, years)
    prior = chosen.prior_scale or options.holidays_prior_scale
    made = tuple(Event(n, (dt.date(1970, 1, 1) + dt.timedelta(days=d)).isoformat(), prior_scale=prior) for _, _, d, n in country_rows(chosen.country, sorted(years)))
    own = {e.name: e.prior_scale or options.holidays_prior_scale for e in options.events}
    if any(e.name in own and own[e.name] != prior for e in made):
        raise CountryHolidayError("prior-conflict")
    return options.events + made
