"""Registered queries of the calendar, payroll, time-zone, signal and layout operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import calendar as C
from docloom.functions import layout as L
from docloom.functions import payroll as P
from docloom.functions import signal as S
from docloom.functions import zones as Z
from docloom.functions.text import round_half_up
from docloom.operators.catalogue import query
from docloom.operators.text_queries import table


#: Year, and the days of the Lunar New Year, Buddha's Birthday and Chuseok, for the SQL side.
_LUNAR = """
(1995, '01-31', '05-07', '09-09'), (1996, '02-19', '05-24', '09-27'), (1997, '02-08', '05-14', '09-16'), (1998, '01-28', '05-03', '10-05'),
(1999, '02-16', '05-22', '09-24'), (2000, '02-05', '05-11', '09-12'), (2001, '01-24', '05-01', '10-01'), (2002, '02-12', '05-19', '09-21'),
(2003, '02-01', '05-08', '09-11'), (2004, '01-22', '05-26', '09-28'), (2005, '02-09', '05-15', '09-18'), (2006, '01-29', '05-05', '10-06'),
(2007, '02-18', '05-24', '09-25'), (2008, '02-07', '05-12', '09-14'), (2009, '01-26', '05-02', '10-03'), (2010, '02-14', '05-21', '09-22'),
(2011, '02-03', '05-10', '09-12'), (2012, '01-23', '05-28', '09-30'), (2013, '02-10', '05-17', '09-19'), (2014, '01-31', '05-06', '09-08'),
(2015, '02-19', '05-25', '09-27'), (2016, '02-08', '05-14', '09-15'), (2017, '01-28', '05-03', '10-04'), (2018, '02-16', '05-22', '09-24'),
(2019, '02-05', '05-12', '09-13'), (2020, '01-25', '04-30', '10-01'), (2021, '02-12', '05-19', '09-21'), (2022, '02-01', '05-08', '09-10'),
(2023, '01-22', '05-27', '09-29'), (2024, '02-10', '05-15', '09-17'), (2025, '01-29', '05-05', '10-06'), (2026, '02-17', '05-24', '09-25'),
(2027, '02-07', '05-13', '09-15'), (2028, '01-27', '05-02', '10-03'), (2029, '02-13', '05-20', '09-22'),
(2030, '02-03', '05-09', '09-12')
"""
_holidays_sql = f"""WITH lunar(y, ny, bu, ch) AS (VALUES {_LUNAR}),
own AS (SELECT y, ord, make_date(y, m, d) AS first, 1 AS n, rest, [name] AS names FROM lunar, (VALUES {", ".join(f"({i}, {m}, {d}, {name!r}, {int(eligible)})" if "'" not in name else f"({i}, {m}, {d}, '{name.replace(chr(39), chr(39) * 2)}', {int(eligible)})" for i, (m, d, name, eligible) in enumerate(C.FIXED))}) f(ord, m, d, name, rest)
 UNION ALL SELECT y, 20, CAST(y || '-' || ny AS DATE) - 1, 3, 2, ['Lunar New Year holiday', 'Lunar New Year''s Day', 'Lunar New Year holiday'] FROM lunar
 UNION ALL SELECT y, 21, CAST(y || '-' || bu AS DATE), 1, 1, ['Buddha''s Birthday'] FROM lunar
 UNION ALL SELECT y, 22, CAST(y || '-' || ch AS DATE) - 1, 3, 2, ['Chuseok holiday', 'Chuseok', 'Chuseok holiday'] FROM lunar
 UNION ALL SELECT 2026, 23, DATE '2026-06-03', 1, 0, ['9th nationwide local elections']),
days AS (SELECT y, ord, rest, first + CAST(k AS INT) AS d, names[k + 1] AS name FROM (SELECT *, unnest(range(n)) AS k FROM own)),
lost AS (SELECT y, ord, d FROM (SELECT *, count(*) OVER (PARTITION BY y, d) AS held FROM days) WHERE rest > 0 AND (held > 1 OR isodow(d) = 7 OR rest = 1 AND isodow(d) = 6)),
due AS (SELECT DISTINCT y, ord FROM lost l WHERE NOT EXISTS (SELECT 1 FROM lost e WHERE e.y = l.y AND e.d = l.d AND e.ord < l.ord)),
free AS (SELECT *, row_number() OVER (PARTITION BY y, ord ORDER BY d) AS r FROM (SELECT y, ord, names, first + n + CAST(k AS INT) AS d FROM (SELECT own.*, unnest(range(20)) AS k FROM own JOIN due USING (y, ord))) c WHERE isodow(d) < 6 AND NOT EXISTS (SELECT 1 FROM days WHERE days.y = c.y AND days.d = c.d)),
turn AS (SELECT y, ord, row_number() OVER (PARTITION BY d ORDER BY ord) AS r FROM free WHERE r = 1),
holidays AS (SELECT d AS date, name, false AS substitute FROM days UNION ALL SELECT d, 'Substitute holiday (' || names[1] || ')', true FROM free JOIN turn USING (y, ord, r))"""


@query("holidays_dim", _holidays_sql + " SELECT * FROM holidays")
def holidays_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.holidays(spark, 1995, 2030)


@query("business_days_weekends", """
SELECT o_orderkey, CASE WHEN o_orderdate IS NOT NULL THEN CAST(b + 1 AS BIGINT) END AS total, CASE WHEN o_orderdate IS NOT NULL THEN CAST((SELECT count(*) FROM generate_series(0, 20) g(i) WHERE i <= b AND isodow(CAST(o_orderdate AS DATE) + CAST(i AS INT)) <= 5) AS BIGINT) END AS business
FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 20 AS b FROM orders)""")
def business_days_weekends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays in a range, in closed form: no rows per day."""
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, (F.col("o_orderkey") % 20).cast("int"))
    before = lambda d: F.floor((F.datediff(d, F.lit(date(1970, 1, 5)))) / 7.0) * 5 + F.least(F.lit(5), F.pmod(F.datediff(d, F.lit(date(1970, 1, 5))), F.lit(7)))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.datediff(end, start) + 1).cast("long").alias("total"), (before(F.date_add(end, 1)) - before(start)).cast("long").alias("business"))


@query("business_days", _holidays_sql + """, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderkey % 30 AS INT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN count(d) > 0 THEN CAST(any_value(n) + 1 AS BIGINT) END AS total, CASE WHEN count(d) > 0 THEN CAST(count(*) FILTER (WHERE isodow(d) < 6 AND d NOT IN (SELECT date FROM holidays)) AS BIGINT) END AS business FROM (SELECT o_orderkey, n, a + CAST(unnest(range(n + 1)) AS INT) AS d FROM o) GROUP BY o_orderkey""")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order date to a bounded number of days later, Korean holidays left out, by two joins with the day index.

    The index has the years that the orders have; an order without a date has null counts.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("b"))
    first, last = o.agg(F.year(F.min("a")), F.year(F.max("b"))).first()
    days = C.business_index(spark, first or 2000, last or 2000)
    x = days.select(F.col("day").alias("a"), (F.col("upto") - F.col("works")).alias("from"))
    y = days.select(F.col("day").alias("b"), F.col("upto").alias("to"))
    joined = o.join(F.broadcast(x), "a", "left").join(F.broadcast(y), "b", "left")  # a row for each day of the calendar
    return joined.select("o_orderkey", (F.datediff("b", "a") + 1).cast("long").alias("total"), (F.col("to") - F.col("from")).alias("business"))


@query("excluded_days", _holidays_sql + """, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderkey % 30 AS INT) AS n FROM orders),
named AS (SELECT date, arg_max(name, ord) AS name FROM (SELECT d AS date, name, ord FROM days UNION ALL SELECT date, name, 99 FROM holidays WHERE substitute) GROUP BY date),
x AS (SELECT o_orderkey, a + CAST(unnest(range(n + 1)) AS INT) AS day FROM o)
SELECT o_orderkey, day, coalesce(name, 'Weekend') AS reason FROM x LEFT JOIN named ON date = day WHERE name IS NOT NULL OR isodow(day) > 5""")
def excluded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that are no business days from each order's date to a number of days later, each with its reason."""
    a = F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), a.alias("first"), F.date_add(a, (F.col("o_orderkey") % 30).cast("int")).alias("last"))
    first, last = o.agg(F.year(F.min("first")), F.year(F.max("last"))).first()
    free = C.free_days(spark, first or 2000, last or 2000)
    return C.excluded_days(o, free).withColumnRenamed("id", "o_orderkey")


_AS_OF = date(2026, 3, 15)


def _leave(method: str):
    return lambda spark, sf_dir: (
        table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("h"))
        .select("o_orderkey", C.annual_leave(F.col("h"), F.lit(_AS_OF), method).alias("days"))
    )


_hires = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS h FROM orders)"
query("annual_leave_hire", f"SELECT o_orderkey, CAST(CASE WHEN datesub('year', h, DATE '2026-03-15') < 1 THEN least(11, datesub('month', h, DATE '2026-03-15')) ELSE least(25, 15 + (datesub('year', h, DATE '2026-03-15') - 1) // 2) END AS DOUBLE) AS days FROM {_hires}")(_leave("hire"))
query("annual_leave_fiscal", f"SELECT o_orderkey, CAST(CASE WHEN year(h) = 2026 THEN least(11, datesub('month', h, DATE '2026-03-15')) WHEN year(h) = 2025 THEN floor(150.0::DOUBLE * (DATE '2026-01-01' - h) / 365 + 0.5) / 10 ELSE least(25, 15 + greatest(0, datesub('year', h, DATE '2026-01-01') - 1) // 2) END AS DOUBLE) AS days FROM {_hires}")(_leave("fiscal"))


def _pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") * 1000.0).alias("m"), (F.col("c_custkey") % 4 + 1).alias("dep"), (F.col("c_custkey") % 4).alias("kids"))


_pay_sql = """WITH a AS (SELECT c_custkey, abs(c_acctbal) * 1000::DOUBLE AS m, c_custkey % 4 + 1 AS dep, c_custkey % 4 AS kids FROM customer),
b AS (SELECT *, m * 12 AS g, least(6590000::DOUBLE, greatest(410000::DOUBLE, m)) AS pb FROM a),
c AS (SELECT *, least(20000000::DOUBLE, CASE WHEN g <= 5000000 THEN g * 0.7::DOUBLE WHEN g <= 15000000 THEN 3500000 + (g - 5000000) * 0.4::DOUBLE WHEN g <= 45000000 THEN 7500000 + (g - 15000000) * 0.15::DOUBLE WHEN g <= 100000000 THEN 12000000 + (g - 45000000) * 0.05::DOUBLE ELSE 14750000 + (g - 100000000) * 0.02::DOUBLE END) AS e,
 CASE dep WHEN 1 THEN 3100000 + g * 0.04::DOUBLE WHEN 2 THEN 3600000 + g * 0.04::DOUBLE ELSE 5000000 + g * 0.07::DOUBLE END AS sp FROM b),
d AS (SELECT *, greatest(0::DOUBLE, g - e - dep * 1500000 - pb * 0.0475::DOUBLE * 12 - sp) AS base FROM c),
t AS (SELECT *, 0.06::DOUBLE * least(base, 14e6) + 0.15::DOUBLE * greatest(0, least(base, 50e6) - 14e6) + 0.24::DOUBLE * greatest(0, least(base, 88e6) - 50e6) + 0.35::DOUBLE * greatest(0, least(base, 150e6) - 88e6) + 0.38::DOUBLE * greatest(0, base - 150e6) AS tax FROM d),
x AS (SELECT *, greatest(0::DOUBLE, tax - least(CASE WHEN tax <= 1300000 THEN tax * 0.55::DOUBLE ELSE 715000 + (tax - 1300000) * 0.3::DOUBLE END, CASE WHEN g <= 33000000 THEN 740000::DOUBLE WHEN g <= 70000000 THEN greatest(660000::DOUBLE, 740000 - (g - 33000000) * 0.008::DOUBLE) ELSE greatest(500000::DOUBLE, 660000 - (g - 70000000) * 0.005::DOUBLE) END) - CASE kids WHEN 0 THEN 0::DOUBLE WHEN 1 THEN 250000 WHEN 2 THEN 550000 ELSE 550000 + (kids - 2) * 400000 END) / 12 AS it FROM t)"""


@query("income_tax", _pay_sql + " SELECT c_custkey, round(it, 0) AS tax FROM x")
def income_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pay(spark, sf_dir).select("c_custkey", F.round(P.monthly_income_tax(F.col("m"), F.col("dep"), F.col("kids")), 0).alias("tax"))


@query("net_pay", _pay_sql + """, y AS (SELECT c_custkey, m, floor(pb * 0.0475::DOUBLE / 10) * 10 AS pension, floor(m * 0.03595::DOUBLE / 10) * 10 AS health, floor(m * 0.009::DOUBLE / 10) * 10 AS employment, floor(it / 10) * 10 AS income_tax FROM x),
z AS (SELECT *, floor(health * 0.1314::DOUBLE / 10) * 10 AS long_term_care, floor(income_tax * 0.1::DOUBLE / 10) * 10 AS local_tax FROM y)
SELECT c_custkey, pension, health, long_term_care, employment, income_tax, local_tax, pension + health + long_term_care + employment + income_tax + local_tax AS deductions, round(greatest(0, m - (pension + health + long_term_care + employment + income_tax + local_tax)), 4) AS net FROM z""")
def net_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = P.net_pay(F.col("m"), F.col("dep"), F.col("kids"))
    return _pay(spark, sf_dir).select("c_custkey", *[(F.round(c, 4) if n == "net" else c).alias(n) for n, c in parts.items()])


@query("weekly_allowance", """SELECT c_custkey, h >= 15 AS eligible, CASE WHEN h >= 15 THEN least(h / 40, 1.0::DOUBLE) * 8 ELSE 0 END AS paid_hours, CAST(floor(CASE WHEN h >= 15 THEN least(h / 40, 1.0::DOUBLE) * 8 ELSE 0 END * w + 0.5) AS BIGINT) AS allowance
FROM (SELECT c_custkey, CAST(c_custkey % 53 AS DOUBLE) AS h, 10000::DOUBLE + c_custkey % 7 AS w FROM customer)""")
def weekly_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 53).cast("double").alias("h"), (F.lit(10000.0) + F.col("c_custkey") % 7).alias("w"))
    return d.select("c_custkey", *[c.alias(n) for n, c in P.weekly_allowance(F.col("h"), F.col("w")).items()])


@query("severance", """SELECT o_orderkey, e AS eligible, CAST(n AS BIGINT) AS service_days, round(x, 1) AS extra, round(w, 3) AS daily, round(CASE WHEN e THEN w * 30 * n / 365 ELSE 0 END, 2) AS severance
FROM (SELECT *, n >= 365 AND hours >= 15 AS e, (t * 3 + x) / 92 AS w FROM (SELECT o_orderkey, DATE '2001-12-31' - CAST(o_orderdate AS DATE) + 1 AS n, o_orderkey % 41 AS hours, o_totalprice AS t, o_totalprice * 3 / 12 AS x FROM orders))""")
def severance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_totalprice")
    parts = P.severance(F.col("o_orderdate").cast("date"), F.lit(date(2001, 12, 31)), t * 3, t, F.lit(0.0), F.lit(92), F.col("o_orderkey") % 41)
    digits = {"extra": 1, "daily": 3, "severance": 2}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[(F.round(c, digits[n]) if n in digits else c).alias(n) for n, c in parts.items()])


_zone_list = ", ".join(f"('{i}', '{z}')" for i, z in Z.CITIES)


_zones_sql = f"""SELECT event_id, id, l AS local_time, CAST(l AS DATE) - CAST(ts AS DATE) AS shift, round(datediff('minute', ts, l) / 60.0::DOUBLE, 1) AS offset_hours, hour(l) + minute(l) / 60.0::DOUBLE >= 9 AND hour(l) + minute(l) / 60.0::DOUBLE < 18 AS works
FROM (SELECT event_id, ts, id, (ts AT TIME ZONE 'UTC') AT TIME ZONE zone AS l FROM events, (VALUES {_zone_list}) c(id, zone))"""


@query("zone_convert", _zones_sql)
def zone_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in every city's wall time."""
    return _in_zones(table(spark, sf_dir, "events"))


# the same under the name that it had beside a query on part of the events
query("zone_convert_all", _zones_sql)(zone_convert)


def _in_zones(events: DataFrame) -> DataFrame:
    """The city dimension is a fixed short list. In the events' time a zone changes its offset a few times: an event's offset
    is looked up among these, and all else follows from it by arithmetic."""
    spark = events.sparkSession
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    known = {z: Z.offsets(spark, z, first, last) for z in {z for _, z in Z.CITIES}} if first else {}
    ts = F.col("ts").cast("timestamp_ntz")
    if any(len(k) > Z.FEW_CHANGES for k in known.values()) or not known:
        seconds = lambda z: F.timestamp_diff("SECOND", ts, Z.wall_time(ts, F.lit(z)))
    else:
        seconds = lambda z: Z.offset_seconds(ts, known[z])
    each = F.array(*[F.struct(F.lit(i).alias("id"), seconds(z).cast("int").alias("s")) for i, z in Z.CITIES])
    d = events.select("event_id", ts.alias("ts"), F.explode(each).alias("c")).select("event_id", "ts", "c.id", "c.s")
    local = d.withColumn("l", F.col("ts") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)")))
    return local.select("event_id", "id", F.col("l").alias("local_time"), Z.day_shift(F.col("l"), F.col("ts")).cast("long").alias("shift"), F.round(F.floor(F.col("s") / 60) / 60.0, 1).alias("offset_hours"), Z.works(F.col("l")).alias("works"))


@query("meeting_slots", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events UNION SELECT DATE '2024-03-10' UNION SELECT DATE '2024-11-03'),
s AS (SELECT day, unnest(generate_series((CAST(day AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', (CAST(day + 1 AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS slot FROM d),
z AS (SELECT day, slot, (slot AT TIME ZONE 'UTC') AT TIME ZONE zone AS l FROM s, (VALUES ('America/New_York'), ('Europe/London'), ('Asia/Dubai')) v(zone))
SELECT day, slot FROM z GROUP BY day, slot HAVING bool_and(hour(l) + minute(l) / 60.0 >= 7 AND hour(l) + minute(l) / 60.0 < 22)""")
def meeting_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).union(spark.createDataFrame([(date(2024, 3, 10),), (date(2024, 11, 3),)], "day date")).distinct()
    return Z.meeting_slots(spark, days, ["America/New_York", "Europe/London", "Asia/Dubai"], 7.0, 22.0)


@query("city_search", f"SELECT id, zone FROM (SELECT id, zone, row_number() OVER () AS ord FROM (VALUES {_zone_list}) c(id, zone)) WHERE replace(lower(id || ' ' || zone), '-', ' ') LIKE '%on%' ORDER BY ord LIMIT 8")
def city_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.search(Z.cities(spark), " oN ", ["id", "zone"]).select("id", "zone")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 20).cast("int").alias("s"), (F.col("vec_id") % 20 + 10).cast("int").alias("e"))


def _signal(name: str, f, sql: str):
    """f: the edited array; sql: over v (doubles), s, e (selection) and n (length), x and i (one sample, from zero)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _samples(spark, sf_dir).select("vec_id", f(F.col("v")).alias("v"))
        at = F.transform(F.col("v"), lambda x, i: x * (i + 1))
        return d.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.aggregate(at, F.lit(0.0), lambda a, x: a + x), 5).alias("moment"))

    source = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(vec_id % 20 AS INT) AS s, CAST(vec_id % 20 + 10 AS INT) AS e, len(embedding) AS n FROM embeddings)"
    query(name, f"SELECT vec_id, CAST(len(o) AS BIGINT) AS n, round(list_sum(o), 6) AS total, round(list_sum(list_transform(o, lambda x, i: x * i)), 5) AS moment FROM (SELECT vec_id, {sql} AS o FROM {source})")(run)


_inside = "i - 1 >= s AND i - 1 < e"
_signal("signal_mute", lambda v: S.mute(v, F.col("s"), F.col("e")), f"list_transform(v, lambda x, i: CASE WHEN {_inside} THEN 0.0 ELSE x END)")
_signal("signal_delete", lambda v: S.delete(v, F.col("s"), F.col("e")), "v[:s] || v[e + 1:]")
_signal("signal_copy", lambda v: S.copy(v, F.col("s"), F.col("e")), "v[s + 1:e]")
_signal("signal_paste", lambda v: S.paste(v, F.col("e"), S.copy(v, F.col("s"), F.col("e"))), "v[:e] || v[s + 1:e] || v[e + 1:]")
_signal("signal_fade_in", lambda v: S.fade(v, F.col("s"), F.col("e"), True), f"list_transform(v, lambda x, i: CASE WHEN {_inside} THEN x * ((i - 1 - s) / 9.0::DOUBLE) ELSE x END)")
_signal("signal_fade_out", lambda v: S.fade(v, F.col("s"), F.col("e"), False), f"list_transform(v, lambda x, i: CASE WHEN {_inside} THEN x * (1.0::DOUBLE - (i - 1 - s) / 9.0::DOUBLE) ELSE x END)")
_signal("signal_gain", lambda v: S.gain(v, F.col("s"), F.col("e"), F.lit(3.5)), f"list_transform(v, lambda x, i: CASE WHEN {_inside} THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * 3.5::DOUBLE)) ELSE x END)")
_signal("signal_normalize", lambda v: S.normalize(v, F.col("s"), F.col("e"), S.peak(v, F.col("s"), F.col("e"))), f"list_transform(v, lambda x, i: CASE WHEN {_inside} THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * least(16.0::DOUBLE, 0.98::DOUBLE / list_max(list_transform(v[s + 1:e], lambda y: abs(y)))))) ELSE x END)")
_signal("signal_robot", lambda v: S.robot(v, F.lit(8000)), "list_transform(v, lambda x, i: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * (0.18::DOUBLE + 0.82::DOUBLE * sin(2 * pi() * 55 * (i - 1) / 8000)))))")
_signal("signal_resample", lambda v: S.resample(v, F.lit(101)), "list_transform(range(0, 101), lambda k: v[CAST(floor(k * (n - 1) / 100.0::DOUBLE) AS INT) + 1] + (v[least(CAST(floor(k * (n - 1) / 100.0::DOUBLE) AS INT) + 2, n)] - v[CAST(floor(k * (n - 1) / 100.0::DOUBLE) AS INT) + 1]) * (k * (n - 1) / 100.0::DOUBLE - floor(k * (n - 1) / 100.0::DOUBLE)))")
_signal("signal_crossfade", lambda v: S.crossfade(v, F.col("s"), S.copy(v, F.lit(40), F.lit(50)), F.lit(4)), "list_transform(v, lambda x, i: CASE WHEN i - 1 >= s AND i - 1 < s + 10 THEN x * (1.0::DOUBLE - least(1.0::DOUBLE, (i - 1 - s) / 4.0::DOUBLE, (9 - (i - 1 - s)) / 4.0::DOUBLE)) + v[40 + i - s] * least(1.0::DOUBLE, (i - 1 - s) / 4.0::DOUBLE, (9 - (i - 1 - s)) / 4.0::DOUBLE) ELSE x END)")
_signal("signal_pcm16", lambda v: F.transform(S.pcm16(v), lambda x: x.cast("double")), "list_transform(v, lambda x: CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) * CASE WHEN x < 0 THEN 32768.0::DOUBLE ELSE 32767.0::DOUBLE END) AS DOUBLE))")
_signal("signal_interleave", lambda v: S.interleave(F.array(v, F.reverse(v))), "flatten(list_transform(v, lambda x, i: [x, v[n + 1 - i]]))")


@query("peak_by_label", "SELECT label, round(max(list_max(list_transform(embedding, lambda x: abs(x)))), 6) AS peak FROM embeddings GROUP BY label")
def peak_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.max(S.peak(v, F.lit(0), F.size(v))), 6).alias("peak"))


@query("history_limit", "SELECT p_partkey, CAST(greatest(1, least(12, floor(134217728.0 / (p_partkey * 40000)))) AS BIGINT) AS states FROM part")
def history_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.history_limit(F.col("p_partkey") * 40000).alias("states"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + 7).alias("w"), F.floor(F.col("p_retailprice")).cast("long").alias("h"), F.floor(F.col("p_partkey") / 10).cast("long").alias("g"))


_images_sql = "(SELECT p_partkey, p_size * 40 + 7 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h, p_partkey // 10 AS g FROM part)"


@query("collage_vertical", f"SELECT p_partkey, k AS height, CAST(coalesce(sum(k + 12) OVER (PARTITION BY g ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM (SELECT *, CAST(greatest(1, floor(h * 600::DOUBLE / w + 0.5)) AS BIGINT) AS k FROM {_images_sql})")
def collage_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _images(spark, sf_dir).withColumn("height", F.greatest(F.lit(1), round_half_up(F.col("h") * 600.0 / F.col("w"))))
    before = Window.partitionBy("g").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)
    return d.select("p_partkey", "height", F.coalesce(F.sum(F.col("height") + 12).over(before), F.lit(0)).alias("y"))


@query("collage_grid", f"SELECT p_partkey, CAST(r % 3 * 206 AS BIGINT) AS x, CAST(r // 3 * (144 + 6) AS BIGINT) AS y FROM (SELECT p_partkey, row_number() OVER (PARTITION BY g ORDER BY p_partkey) - 1 AS r FROM {_images_sql})".replace("206", "198").replace("(144 + 6)", "150"))
def collage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of a 588 pixel canvas with gaps of 6."""
    width, gap, columns = 588, 6, 3
    cell = (width - gap * (columns - 1)) // columns
    tall = int(cell * 0.75 + 0.5)
    r = F.row_number().over(Window.partitionBy("g").orderBy("p_partkey")) - 1
    return _images(spark, sf_dir).select("p_partkey", r.alias("r")).select("p_partkey", (F.col("r") % columns * (cell + gap)).cast("long").alias("x"), (F.floor(F.col("r") / columns) * (tall + gap)).alias("y"))


@query("contain_cover", f"""SELECT p_partkey, round((640 - w * k) / 2, 6) AS dest_x, round((360 - h * k) / 2, 6) AS dest_y, round(w * k, 6) AS dest_w, round(h * k, 6) AS dest_h, round((w - cw) / 2, 6) AS source_x, round((h - ch) / 2, 6) AS source_y, round(cw, 6) AS crop_w, round(ch, 6) AS crop_h
FROM (SELECT *, least(640.0::DOUBLE / w, 360.0::DOUBLE / h) AS k, CASE WHEN w::DOUBLE / h > 640.0::DOUBLE / 360 THEN h * (640.0::DOUBLE / 360) ELSE w END AS cw, CASE WHEN w::DOUBLE / h > 640.0::DOUBLE / 360 THEN h ELSE w / (640.0::DOUBLE / 360) END AS ch FROM {_images_sql})""")
def contain_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = L.contain(F.col("w"), F.col("h"), 640, 360) | L.cover(F.col("w"), F.col("h"), 640, 360)
    return _images(spark, sf_dir).select("p_partkey", *[F.round(c, 6).alias(n) for n, c in parts.items()])


_even = lambda x: f"(greatest(2, CAST(floor({x} + 0.5) AS BIGINT)) - greatest(2, CAST(floor({x} + 0.5) AS BIGINT)) % 2)"


@query("output_dims", f"""SELECT p_partkey, s AS vertical_w, {_even('s * 16 / 9.0::DOUBLE')} AS vertical_h, {_even('s * 16 / 9.0::DOUBLE')} AS wide_w, s AS wide_h, CASE WHEN w <= h THEN s ELSE {_even('s * w / h::DOUBLE')} END AS own_w, CASE WHEN w <= h THEN {_even('s * h / w::DOUBLE')} ELSE s END AS own_h
FROM (SELECT *, {_even('least(w, h, 720)')} AS s FROM {_images_sql})""")
def output_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    out = {n: L.output_size(w, h, a, "720") for n, a in (("vertical", "9:16"), ("wide", "16:9"), ("own", "source"))}
    return _images(spark, sf_dir).select("p_partkey", *[x.cast("long").alias(f"{n}_{s}") for n, pair in out.items() for s, x in zip("wh", pair)])


@query("affine_bounds", f"""SELECT p_partkey, round(least(0.8::DOUBLE * w, -0.6::DOUBLE * h, 0.8::DOUBLE * w - 0.6::DOUBLE * h, 0::DOUBLE) + 5 + 0 * (w + h), 6) AS left_, round(least(0::DOUBLE, 0.6::DOUBLE * w + 0.8::DOUBLE * h) + 7 + 0 * (w + h), 6) AS top_, round(greatest(0.8::DOUBLE * w, -0.6::DOUBLE * h, 0.8::DOUBLE * w - 0.6::DOUBLE * h, 0::DOUBLE) + 5 + 0 * (w + h), 6) AS right_, round(0.6::DOUBLE * w + 0.8::DOUBLE * h + 7, 6) AS bottom_ FROM {_images_sql}""")
def affine_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tuple(F.lit(x) for x in (0.8, 0.6, -0.6, 0.8, 5.0, 7.0))
    parts = L.affine_bounds(m, F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"))
    return _images(spark, sf_dir).select("p_partkey", *[F.round(c, 6).alias(f"{n}_") for n, c in parts.items()])


@query("page_fit", f"""SELECT p_partkey, pw AS page_w, ph AS page_h, round((pw - w * 0.75::DOUBLE * k) / 2, 6) AS x, round((ph - h * 0.75::DOUBLE * k) / 2, 6) AS y, round(w * 0.75::DOUBLE * k, 6) AS w, round(h * 0.75::DOUBLE * k, 6) AS h
FROM (SELECT *, least(1.0::DOUBLE, (pw - 56) / (w * 0.75::DOUBLE), (ph - 56) / (h * 0.75::DOUBLE)) AS k FROM (SELECT *, CASE WHEN w > h THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS pw, CASE WHEN w > h THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS ph FROM {_images_sql}))""")
def page_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = L.page_fit(F.col("w"), F.col("h"))
    return _images(spark, sf_dir).select("p_partkey", *[(c if n.startswith("page") else F.round(c, 6)).alias(n) for n, c in parts.items()])


@query("nearest_rate", """SELECT p_partkey, (SELECT arg_min(r, (abs(r - p_size * 1999), i)) FROM (VALUES (0, 8000), (1, 12000), (2, 16000), (3, 24000), (4, 48000)) v(i, r)) AS rate FROM part""")
def nearest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", L.nearest(F.col("p_size") * 1999, [8000, 12000, 16000, 24000, 48000]).alias("rate"))


@query("rotation_normalize", "SELECT l_orderkey, l_linenumber, CAST(((d % 360) + 360) % 360 AS BIGINT) AS rotation FROM (SELECT *, CAST(l_quantity AS BIGINT) * 90 - l_partkey * 270 AS d FROM lineitem)")
def rotation_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.rotation(F.col("l_quantity").cast("long") * 90 - F.col("l_partkey") * 270).alias("rotation"))


@query("line_cells", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_quantity AS w, sum(l_quantity + l_partkey % 40) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS x FROM lineitem),
b AS (SELECT *, x - lag(x + w) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS gap FROM a),
c AS (SELECT *, sum(CASE WHEN gap > greatest(18, 1.8 * 12) THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS cell FROM b)
SELECT l_orderkey, CAST(cell AS BIGINT) AS cell, min(x) AS x, CAST(count(*) AS BIGINT) AS n_words, string_agg(CAST(l_linenumber AS VARCHAR), CASE WHEN FALSE THEN '' ELSE ' ' END ORDER BY l_linenumber) AS text FROM c GROUP BY l_orderkey, cell""")
def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a line (an order's lines, with made-up places) put into cells where the gap is wide."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    line = order.rowsBetween(Window.unboundedPreceding, 0)
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_quantity").alias("w"), F.sum(F.col("l_quantity") + F.col("l_partkey") % 40).over(line).alias("x"))
    b = a.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(order))
    c = b.withColumn("cell", F.sum((F.coalesce(F.col("gap"), F.lit(0.0)) > max(18, 1.8 * 12)).cast("long")).over(line))
    words = F.array_join(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda x: x.cast("string")), " ")
    return c.groupBy("l_orderkey", "cell").agg(F.min("x").alias("x"), F.count("*").alias("n_words"), words.alias("text"))
