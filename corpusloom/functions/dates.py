"""Date and time functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def title_date(name: Column) -> Column:
    """The day in a file's stem, if the first run of digits and separators that looks like one is a real day.

    Eight digits in a row, or four, two and two with the same separator (a hyphen or a point), with no digit next to them.
    """
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]+$", "")
    found = F.regexp_extract(stem, r"(?<!\d)(\d{8}|\d{4}-\d{2}-\d{2}|\d{4}\.\d{2}\.\d{2})(?!\d)", 1)
    return F.when(found != "", F.try_to_date(F.regexp_replace(found, "[-.]", ""), "yyyyMMdd"))


def named_range(name: str, now: Column) -> tuple[Column, Column]:
    """Start and last millisecond of yesterday, or of the last, this or next week, month, quarter or year. Weeks start on Monday."""
    if name == "yesterday":
        start = F.date_trunc("DAY", now) - F.expr("INTERVAL 1 DAY")
        return start, start + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.001 SECOND")
    which, unit = name.split(" ")
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    shift = {"last": -1, "this": 0, "next": 1}[which]
    start = F.date_trunc(unit.upper(), now)
    move = lambda k: (F.make_interval(weeks=F.lit(k)) if months is None else F.make_interval(months=F.lit(k * months)))
    return start + move(shift), start + move(shift + 1) - F.expr("INTERVAL 0.001 SECOND")


def quarter_range(year: Column, quarter: Column) -> tuple[Column, Column]:
    start = F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))
    return start, F.date_add(F.add_months(start, 3), -1)


def recency(day: Column, today: Column) -> Column:
    """1 today, falling to 0.3 within three weeks."""
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), 1 - F.datediff(today, day) / 30))


def daily_notes(start: Column, end: Column, most: int = 365) -> Column:
    """[[YYYY-MM-DD]] of every day, the newest ``most`` of them."""
    first = F.greatest(start, F.date_add(end, -(most - 1)))
    return F.transform(F.sequence(first, end), lambda d: F.concat(F.lit("[["), F.date_format(d, "yyyy-MM-dd"), F.lit("]]")))


def epoch(value: Column) -> Column:
    """Seconds if it has ten digits, else milliseconds."""
    return F.timestamp_millis(F.when(F.length(value.cast("string")) == 10, value * 1000).otherwise(value))


def clock(seconds: Column) -> Column:
    """[HH:]MM:SS"""
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    short = F.concat_ws(":", two((seconds % 3600) / 60), two(seconds % 60))
    return F.when(seconds >= 3600, F.concat_ws(":", two(seconds / 3600), short)).otherwise(short)


def relative_range(count: int, unit: str, now: Column) -> tuple[Column, Column]:
    """The last ``count`` days, weeks, months or years, up to the start of today."""
    end = F.date_trunc("DAY", now)
    return end - F.make_interval(**{unit: F.lit(count)}), end


def utc_offset(text: Column) -> Column:
    """Minutes of +8, UTC+5:30 or GMT-0330; null for other texts and beyond 14 hours."""
    pattern = r"^(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?$"
    clean = F.upper(F.trim(text))
    hours, minutes = F.regexp_extract(clean, pattern, 2).try_cast("int"), F.coalesce(F.regexp_extract(clean, pattern, 3).try_cast("int"), F.lit(0))
    size = hours * 60 + minutes
    return F.when((size <= 14 * 60) & (minutes < 60), F.when(F.regexp_extract(clean, pattern, 1) == "-", -size).otherwise(size))


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO 8601 duration of hours, minutes and seconds (PT1H2M3S); null for other texts."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda g: F.coalesce(F.regexp_extract(text, pattern, g).try_cast("long"), F.lit(0))
    return F.when(text.rlike(pattern) & (text != "PT"), part(1) * 3600 + part(2) * 60 + part(3))


MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = "|".join([*(rf"{m[:3]}(?:{m[3:]})?" for m in MONTHS if len(m) > 3 and m != "september"), "may", "sept?(?:ember)?"])


def _end(start: Column, months: int) -> Column:
    return start + F.make_interval(months=F.lit(months)) - F.expr("INTERVAL 0.001 SECOND")


def _month_number(text: Column) -> Column:
    """1 to 12 of a month's name or its first three letters; null for other texts."""
    return F.nullif(F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.left(text, F.lit(3))), F.lit(0)).cast("int")


#: What may stand before a number of units, and before a year.
_BACKWARDS = ("last", "past", "previous", "prior")
_BEFORE_YEARS = ("", *(" ".join(w for w in (the, year, of) if w) for the in ("", "the") for year in ("year", "yr") for of in ("", "of", "in")))


def time_range(expression: Column, now: Column) -> Column:
    """struct(start, end) of a time expression in English, by the first rule that fits; null where none does.

    Rules, in this order: the last (past, previous, prior) so many days, weeks, months or years; yesterday and the last, this or next week,
    month, quarter or year; "week of" a day; a month; a month and a year; a quarter, with or without a year; a year; a day or two days
    (YYYY-MM-DD, "to" between them). A range that would start in the future is taken a year earlier (not so for this and next ones). A year ends at
    the start of its last day. Case, the mark @vault and space around don't count.
    """
    # The text and its words are bound once: each rule reads them many times.
    bound = lambda value, within: F.get(F.transform(F.array(value), within), F.lit(0))
    text = F.trim(F.replace(F.lower(expression), F.lit("@vault"), F.lit("")))
    return bound(text, lambda t: bound(F.split(t, r"\s+"), lambda words: _by_rules(t, words, now)))


def _by_rules(t: Column, words: Column, now: Column) -> Column:
    part = lambda pattern, g: F.regexp_extract(t, pattern, g)
    span = lambda start, end: F.struct(start.cast("timestamp").alias("start"), end.cast("timestamp").alias("end"))

    def not_future(start: Column, end: Column) -> Column:
        earlier = F.make_interval(years=F.lit(-1))
        return F.when(start > now, span(start + earlier, end + earlier)).otherwise(span(start, end))

    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    rest = lambda w, n: F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0))), " ")  # noqa: E731  what follows the first n words
    rules = []
    count, today = F.when(F.translate(word(1), "0123456789", "") == "", word(1)).try_cast("int"), F.date_trunc("DAY", now)
    for unit in ("day", "week", "month", "year"):
        rules.append(((F.size(words) == 3) & word(0).isin(*_BACKWARDS) & word(2).isin(unit, f"{unit}s") & (count > 0), span(today - F.make_interval(**{f"{unit}s": count}), today)))
    for name in ("yesterday", *(f"{which} {unit}" for unit in ("week", "month", "quarter", "year") for which in ("last", "this", "next"))):
        rules.append((t == name, span(*named_range(name, now))))
    said = F.when(word(0) == "the", rest(words, 1)).otherwise(F.array_join(words, " "))
    of = F.when(F.startswith(said, F.lit("week of ")), F.substr(said, F.lit(9)))
    day = F.coalesce(F.try_to_date(of, "yyyy-MM-dd"), F.try_to_date(F.concat_ws(" ", F.year(now).cast("string"), F.initcap(F.regexp_replace(of, r"(\d)(?:st|nd|rd|th)$", "$1"))), "yyyy MMMM d"))
    monday = F.date_trunc("WEEK", day.cast("timestamp"))
    rules.append((of.isNotNull() & day.isNotNull(), not_future(monday, monday + F.expr("INTERVAL 7 DAYS") - F.expr("INTERVAL 0.001 SECOND"))))
    alone, dated = rf"^({_MONTH})$", rf"^({_MONTH})\s+(\d{{4}})$"
    first = lambda year, month: F.make_date(year, month, F.lit(1)).cast("timestamp")
    month = _month_number(part(alone, 1))
    start = first(F.year(now) - F.when(month > F.month(now), 1).otherwise(0), month)
    rules.append((t.rlike(alone), not_future(start, _end(start, 1))))
    start = first(part(dated, 2).try_cast("int"), _month_number(part(dated, 1)))
    rules.append((t.rlike(dated), not_future(start, _end(start, 1))))
    for pattern, q, y in ((r"^q([1-4])\s+(\d{4})$", 1, 2), (r"^(\d{4})\s+q([1-4])$", 2, 1)):
        start = first(part(pattern, y).try_cast("int"), (part(pattern, q).try_cast("int") - 1) * 3 + 1)
        rules.append((t.rlike(pattern), not_future(start, _end(start, 3))))
    quarter = r"^q([1-4])$"
    start = first(F.year(now), (part(quarter, 1).try_cast("int") - 1) * 3 + 1)
    rules.append((t.rlike(quarter), not_future(start, _end(start, 3))))
    last = F.element_at(words, -1)
    start = first(F.when(last.rlike(r"^\d{4}$"), last).try_cast("int"), F.lit(1))
    before = F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
    rules.append((start.isNotNull() & before.isin(*_BEFORE_YEARS), not_future(start, F.make_date(F.year(start), F.lit(12), F.lit(31)).cast("timestamp"))))
    days = r"^(\d{4}-\d{2}-\d{2})(?:\s+to\s+(\d{4}-\d{2}-\d{2}))?$"
    a = F.try_to_date(part(days, 1), "yyyy-MM-dd")
    z = F.coalesce(F.try_to_date(part(days, 2), "yyyy-MM-dd"), a)
    rules.append((t.rlike(days) & a.isNotNull(), span(a.cast("timestamp"), F.date_add(z, 1).cast("timestamp") - F.expr("INTERVAL 0.001 SECOND"))))
    out = F.lit(None).cast("struct<start:timestamp,end:timestamp>")
    for fits, value in reversed(rules):
        out = F.when(fits, value).otherwise(out)
    return out


def valid_range(start: Column, end: Column) -> Column:
    """struct(start, end) in milliseconds; null for half-open, reversed, zero and negative ranges, which filter nothing."""
    return F.when((start > 0) & (end > 0) & (start <= end), F.struct(start.alias("start"), end.alias("end")))


def matching_time(start: Column, end: Column, *candidates: Column) -> Column:
    """The first of a note's times (changed, in its title, in its frontmatter; milliseconds) that lies within the range, borders included."""
    return F.coalesce(*(F.when(c.between(start, end), c) for c in candidates))


def in_zone(at: Column, source: Column, target: Column) -> Column:
    """A wall-clock time of one offset (+8, UTC+5:30) in another; null for unknown offsets."""
    return at + F.make_dt_interval(mins=utc_offset(target) - utc_offset(source))
