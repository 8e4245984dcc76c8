"""DuckDB twins of the queries, written independently of the Spark plans.

Shared steps are common table expressions; :func:`_assemble` adds the ones a statement
mentions, with what they mention in turn.
"""

from __future__ import annotations

import math
import re
from dataclasses import replace
from datetime import date
from itertools import combinations, product
from statistics import NormalDist

from panelspark import params
from panelspark.operators.universe import REASONS
from panelspark.plans import catalogue as cat
from panelspark.plans import fixtures as fx

CTE: dict[str, str] = {}
SQL: dict[str, str] = {}


def _assemble(statement: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTE[name])
                if name not in needed:
                    needed.append(name)

    visit(statement)
    if not needed:
        return statement
    order = [n for n in CTE if n in needed]
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" + statement


def all_sql() -> dict[str, str]:
    return {name: _assemble(text) for name, text in SQL.items()}


def _d(day: date) -> str:
    return f"DATE '{day}'"


def _between(span: tuple[date, date]) -> str:
    return f"date BETWEEN {_d(span[0])} AND {_d(span[1])}"


def _r(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# ---- bars ---------------------------------------------------------------------------

CTE["ticks"] = """SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
 l_extendedprice / l_quantity AS px, l_quantity AS qty, l_orderkey, l_linenumber, l_partkey FROM lineitem"""
_K = "row(l_orderkey, l_linenumber, l_partkey, px, qty)"
CTE["bars"] = f"""SELECT symbol, date, arg_min(px, {_K}) AS open, max(px) AS high, min(px) AS low,
 arg_max(px, {_K}) AS close, sum(qty) AS volume FROM ticks GROUP BY symbol, date"""
CTE["adjusted"] = f"""SELECT symbol, date, open * f AS o, high * f AS h, low * f AS l,
 CASE WHEN adj > 0 THEN adj END AS c, volume AS v FROM (
  SELECT *, adj / greatest(close, 1e-12) AS f FROM (
   SELECT *, CASE WHEN symbol % 2 = 1 AND date < {_d(fx.SPLIT_DAY)} THEN close * 0.5::DOUBLE ELSE close END AS adj
   FROM bars WHERE date BETWEEN {_d(fx.SPLITS.start)} AND {_d(fx.SPLITS.end)}))
 QUALIFY count(*) OVER (PARTITION BY symbol) >= {fx.SPEC.min_history}"""
CTE["sess"] = f"""SELECT DISTINCT symbol, date FROM ticks
 WHERE date BETWEEN {_d(fx.SPLITS.start)} AND {_d(fx.SPLITS.end)}"""
CTE["news"] = """SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS date,
 strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 10 = 0 THEN ' 13:45:00 UTC' ELSE ' 00:00:00 UTC' END AS ts,
 CASE WHEN year(o_orderdate) < 2000 THEN 'allext' ELSE 'nasdaq' END AS src,
 (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 3) / 2::DOUBLE AS sent_signed FROM orders"""

SQL["daily_bars"] = "SELECT symbol, date, open, high, low, close, volume FROM bars"
SQL["adjusted_bars"] = "SELECT symbol, date, o, h, l, c, v FROM adjusted"
SQL["one_row_per_day"] = """SELECT symbol, date, px AS close, qty AS volume FROM ticks
 QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY px, qty) = 1"""
SQL["split_days"] = "SELECT " + ", ".join(
    f"CAST(count(*) FILTER (WHERE {_between(getattr(fx.SPLITS, s))}) AS BIGINT) AS {s}"
    for s in ("train", "val", "test")) + " FROM (SELECT DISTINCT date FROM sess)"

# ---- profiles and universe ----------------------------------------------------------

CTE["pp"] = """SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
 round((max(date) - min(date)) / 365.25::DOUBLE, 2) AS n_years,
 median(CASE WHEN age <= 252 THEN dv END) AS med_dollar_vol_recent252, median(dv) AS med_dollar_vol_full,
 coalesce(max(gap), 0) AS max_gap_days FROM (
  SELECT *, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS gap,
   row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM (
    SELECT CAST(symbol AS VARCHAR) AS ticker, date, close * volume AS dv FROM bars)) GROUP BY ticker"""
CTE["nprof"] = """SELECT CAST(symbol AS VARCHAR) AS ticker, count(*) AS total,
 count(*) FILTER (WHERE src = 'allext') AS allext_count, count(*) FILTER (WHERE src = 'nasdaq') AS nasdaq_count,
 min(substr(ts, 1, 10)) AS first_news, max(substr(ts, 1, 10)) AS last_news, """ + ", ".join(
    f"count(*) FILTER (WHERE year(date) = {y}) AS y{y}" for y in fx.NEWS_YEARS) + " FROM news GROUP BY 1"
_COUNTS = ["total", "allext_count", "nasdaq_count", *[f"y{y}" for y in fx.NEWS_YEARS]]
CTE["cand"] = f"""SELECT p.*, {', '.join(f'coalesce(n.{c}, 0) AS {c}' for c in _COUNTS)},
 (p.ticker IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 3)
  OR regexp_matches(p.ticker, '{params.LEVERAGED_PATTERN}')) AS is_fund
 FROM pp p LEFT JOIN nprof n ON p.ticker = n.ticker"""


def _present(years) -> str:
    return "(" + " + ".join(f"CAST(y{y} > 0 AS INTEGER)" for y in years) + ")"


def _fails(f) -> list[str]:
    return [f"first_date IS NULL OR first_date > {_d(f.first_date_max)}",
            f"last_date IS NULL OR last_date < {_d(f.last_date_min)}",
            f"n_rows < {f.n_rows_min}", f"max_gap_days > {f.max_gap_days} OR max_gap_days < 0",
            f"med_dollar_vol_recent252 < {f.dollar_vol_min}", f"total < {f.news_total_min}",
            f"{_present(f.train_years)} < {f.train_years_min}", f"{_present(f.test_years)} < {f.test_years_min}",
            "is_fund"]


def _screen(f) -> str:
    rungs = " ".join(f"WHEN {test} THEN '{name}'" for name, test in zip(REASONS, _fails(f)))
    window = " + ".join(f"y{y}" for y in f.window_years)
    return f"SELECT *, CASE {rungs} ELSE 'PASS' END AS exclusion_reason, {window} AS news_window FROM cand"


def _inside(f) -> str:
    return " AND ".join(f"NOT ({t})" for t in _fails(f))


CTE["screened"] = _screen(fx.FLOORS)
_OPEN = replace(fx.FLOORS, first_date_max=date(1995, 12, 31), last_date_min=date(2000, 1, 1), n_rows_min=1,
                max_gap_days=1000, dollar_vol_min=0.0, news_total_min=1)
CTE["members"] = f"SELECT * FROM ({_screen(_OPEN)}) WHERE exclusion_reason = 'PASS'"
SQL["price_profile"] = """SELECT ticker, n_rows, first_date, last_date, n_years,
 round(med_dollar_vol_recent252, 6) AS med_dollar_vol_recent252, round(med_dollar_vol_full, 6) AS med_dollar_vol_full,
 max_gap_days FROM pp"""
SQL["news_profile"] = "SELECT * FROM nprof"
SQL["yearly_news"] = " UNION ALL ".join(
    f"SELECT {y} AS year, CAST(sum(y{y}) AS BIGINT) AS articles, count(*) FILTER (WHERE y{y} > 0) AS symbols, "
    f"median(CASE WHEN y{y} > 0 THEN y{y} END) AS median_pos FROM nprof" for y in fx.NEWS_YEARS)
SQL["last_news_years"] = """SELECT CAST(substr(last_news, 1, 4) AS INTEGER) AS year, count(*) AS symbols
 FROM nprof GROUP BY 1"""
SQL["universe_reasons"] = "SELECT ticker, exclusion_reason, news_window FROM screened"
SQL["reason_counts"] = "SELECT exclusion_reason, count(*) AS n FROM screened GROUP BY 1"
_TIER = "ticker, round(med_dollar_vol_recent252, 6) AS med_dollar_vol_recent252, news_window"
SQL["universe_tiers"] = f"""SELECT 1 AS tier, {_TIER} FROM members UNION ALL SELECT 2 AS tier, * FROM (
 SELECT {_TIER} FROM members m ORDER BY m.news_window DESC, m.med_dollar_vol_recent252 DESC, m.ticker LIMIT 20)"""
SQL["universe_sweep"] = " UNION ALL ".join(
    f"SELECT {_d(s)} AS start, {d}::DOUBLE AS dollar_floor, {n} AS news_floor, count(*) FILTER (WHERE first_date <= {_d(s)} "
    f"AND last_date >= {_d(fx.FLOORS.last_date_min)} AND med_dollar_vol_recent252 >= {d} AND total >= {n}) AS n FROM cand"
    for s, d, n in product((date(1995, 1, 10), date(1995, 1, 20), date(1995, 2, 1)), cat.DOLLAR_FLOORS, cat.NEWS_FLOORS))
_AXES = {"dollar_vol_min": cat.DOLLAR_FLOORS, "news_total_min": cat.NEWS_FLOORS, "n_rows_min": (500, 515, 530),
         "max_gap_days": (20, 30, 40), "first_date_max": (date(1995, 1, 10), date(1995, 1, 20))}
_POINTS = [(f"{k}={v}", replace(fx.FLOORS, **{k: v})) for k, vs in _AXES.items() for v in vs] + [
    (f"dollar_vol_min={d},news_total_min={n}", replace(fx.FLOORS, dollar_vol_min=d, news_total_min=n))
    for d, n in product(cat.DOLLAR_FLOORS[1:4], cat.NEWS_FLOORS[1:4])]
SQL["universe_jaccard"] = " UNION ALL ".join(
    f"SELECT '{name}' AS point, count(*) FILTER (WHERE {_inside(f)}) AS n, coalesce(round(count(*) FILTER "
    f"(WHERE ({_inside(f)}) AND ({_inside(fx.FLOORS)})) / nullif(count(*) FILTER (WHERE ({_inside(f)}) OR "
    f"({_inside(fx.FLOORS)})), 0)::DOUBLE, 3), 1.0) AS jaccard FROM cand" for name, f in _POINTS)
SQL["floor_percentiles"] = " UNION ALL ".join(
    [f"SELECT 'med_dollar_vol_recent252' AS metric, {p} AS p, round(quantile_cont(med_dollar_vol_recent252, {p / 100}), 6) "
     f"AS value FROM cand WHERE med_dollar_vol_recent252 <> 0" for p in (10, 25, 50, 60, 70, 75, 80, 90, 95)] +
    [f"SELECT 'total' AS metric, {p} AS p, round(quantile_cont(total::DOUBLE, {p / 100}), 6) AS value FROM cand"
     for p in (25, 50, 60, 70, 75, 80, 90, 95)])
SQL["floor_positions"] = f"""SELECT 'med_dollar_vol_recent252' AS metric, {fx.FLOORS.dollar_vol_min}::DOUBLE AS floor,
 round(avg(CASE WHEN med_dollar_vol_recent252 < {fx.FLOORS.dollar_vol_min} THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_below
 FROM cand WHERE med_dollar_vol_recent252 <> 0 UNION ALL SELECT 'total', {fx.FLOORS.news_total_min}::DOUBLE,
 round(avg(CASE WHEN total < {fx.FLOORS.news_total_min} THEN 1.0 ELSE 0.0 END) * 100, 6) FROM cand"""
SQL["cutoff_counts"] = " UNION ALL ".join(
    [f"SELECT 'last_date>={d}' AS cut, count(*) FILTER (WHERE last_date >= DATE '{d}') AS n FROM pp"
     for d in ("2001-10-01", "2001-07-20", "2000-12-31")] +
    [f"SELECT 'first_date<={d}', count(*) FILTER (WHERE first_date <= DATE '{d}') FROM pp"
     for d in ("1995-01-05", "1995-01-20", "1995-02-01")])
CTE["calendar"] = """SELECT DISTINCT date FROM ticks WHERE CAST(symbol AS VARCHAR) IN (
 SELECT ticker FROM members ORDER BY med_dollar_vol_recent252 DESC, ticker LIMIT 40)"""
CTE["audited"] = """SELECT ticker, round(share, 4) AS coverage, gap AS max_gap_days, dup_dates, bad_px, bad_vol,
 bad_px BETWEEN 1 AND 3 AS repairable, share >= 0.2 AND gap <= 30 AND dup_dates = 0 AND bad_px <= 3 AS ok FROM (
 SELECT ticker, count(DISTINCT date) FILTER (WHERE open_day) / (SELECT count(*) FROM calendar)::DOUBLE AS share,
  coalesce(max(gap), 9999) AS gap, CAST(sum(copies - 1) AS BIGINT) AS dup_dates, CAST(sum(bad_px) AS BIGINT) AS bad_px,
  CAST(sum(bad_vol) AS BIGINT) AS bad_vol FROM (
   SELECT CAST(symbol AS VARCHAR) AS ticker, date, count(*) AS copies,
    count(*) FILTER (WHERE px IS NULL OR px <= 0) AS bad_px, count(*) FILTER (WHERE qty IS NULL OR qty < 0) AS bad_vol,
    date IN (SELECT date FROM calendar) AS open_day,
    date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap FROM ticks GROUP BY symbol, date)
  WHERE ticker IN (SELECT ticker FROM members) GROUP BY ticker)"""
SQL["universe_audit"] = "SELECT * FROM audited"


def _gate(name: str, value: str, bound: float, at_least: bool, source: str) -> str:
    op = ">=" if at_least else "<="
    return (f"SELECT '{name}' AS gate, round(value, 6) AS value, {bound}::DOUBLE AS threshold, "
            f"coalesce(value {op} {bound}, false) AS passed FROM (SELECT CAST({value} AS DOUBLE) AS value FROM {source})")


def _gates(*gates) -> str:
    return " UNION ALL ".join(_gate(*g) for g in gates)


SQL["universe_gates"] = _gates(
    ("size", "count(*)", 5.0, True, "members"),
    ("news_in_train_years", f"avg(CAST({_present(fx.FLOORS.train_years)} >= 3 AS INTEGER))", 0.9, True, "members"),
    ("news_in_test_years", f"avg(CAST({_present(fx.FLOORS.test_years)} >= 2 AS INTEGER))", 0.8, True, "members"),
    ("price_complete", "avg(CAST(ok AS INTEGER))", 0.99, True, "audited"),
    ("unrepairable_names", "count(*) FILTER (WHERE bad_px > 3)", 0.0, False, "audited"),
    ("train_days", f"count(*) FILTER (WHERE {_between(fx.SPLITS.train)})", 700.0, True, "calendar"),
    ("test_days", f"count(*) FILTER (WHERE {_between(fx.SPLITS.test)})", 300.0, True, "calendar"))
_SURV = replace(fx.FLOORS, first_date_max=date(1995, 12, 31), last_date_min=date(2001, 10, 25),
                dollar_vol_min=20_000.0, news_total_min=100)
SQL["survivorship_cohort"] = f"""SELECT strftime(last_date, '%Y-%m') AS month, count(*) AS n FROM ({_screen(_SURV)})
 WHERE exclusion_reason = '{REASONS[1]}' AND med_dollar_vol_recent252 >= 20000 AND total >= 100
 GROUP BY 1 ORDER BY n DESC, month LIMIT 6"""

# ---- articles -----------------------------------------------------------------------

CTE["arts"] = """SELECT doc_id, CAST(n_chars % (SELECT count(*) FROM supplier) AS VARCHAR) AS symbol,
 strftime(DATE '1995-01-01' + CAST(n_chars % 2000 AS INTEGER), '%Y-%m-%d') || ' 00:00:00 UTC' AS ts,
 split_part(text, chr(10), 1) AS title, text AS body, url,
 CASE WHEN CAST(substr(source, 4, 4) AS INTEGER) < 10 THEN 'allext' ELSE 'nasdaq' END AS src
 FROM documents LEFT JOIN pages ON doc_id = page_id"""


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


CTE["cleaned"] = rf"""SELECT *, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS ntitle FROM (
 SELECT upper(trim(symbol)) AS symbol, trim(ts) AS ts, substr(trim(ts), 1, 10) AS date,
 CASE WHEN {_strip("coalesce(title, '')")} <> '' THEN {_strip("coalesce(title, '')")} ELSE array_to_string(
  list_filter(string_split_regex({_strip("coalesce(body, '')")}, '\s+'), lambda w: w <> '')[1:60], ' ') END AS title,
 length({_strip("coalesce(body, '')")}) > 20 AS has_body,
 regexp_replace(split_part(split_part(lower(trim(coalesce(url, ''))), '?', 1), '#', 1), '/+$', '') AS nurl, src
 FROM arts WHERE regexp_full_match(substr(trim(ts), 1, 10), '\d{{4}}-\d{{2}}-\d{{2}}')) WHERE length(title) > 0"""
SQL["clean_articles"] = "SELECT symbol, ts, date, title, has_body, nurl, src, ntitle FROM cleaned"
SQL["dedup_articles"] = """SELECT symbol, date, ntitle, nurl, ts, title, has_body, src FROM cleaned
 QUALIFY row_number() OVER (PARTITION BY symbol, date, ntitle, nurl
  ORDER BY CASE src WHEN 'allext' THEN 1 ELSE 2 END, ts, title, has_body) = 1"""
SQL["member_articles"] = """SELECT symbol, count(*) AS n FROM cleaned
 WHERE symbol IN (SELECT ticker FROM members) GROUP BY symbol"""
SQL["over_merge_rate"] = """SELECT loose, strict, round(1 - loose / strict::DOUBLE, 6) AS rate FROM (
 SELECT count(DISTINCT (trim(symbol), substr(ts, 1, 10), substr(trim(title), 1, 120))) AS loose,
  count(DISTINCT (trim(symbol), substr(ts, 1, 10), trim(title), coalesce(url, ''))) AS strict
 FROM arts WHERE title IS NOT NULL)"""


def _words(x: str) -> str:
    return (rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower({x}), '[,.]', ' ', 'g'), '\s+'), "
            f"lambda w: w <> ''))")


def _hits(x: str, words) -> str:
    return f"len(list_intersect({_words(x)}, [{', '.join(repr(w) for w in words)}]))"


def _lex(x: str) -> str:
    return f"CAST(sign({_hits(x, cat.POSITIVE)} - {_hits(x, cat.NEGATIVE)}) AS INTEGER)"


CTE["hits"] = f"SELECT doc_id, {_hits('text', cat.POSITIVE)} AS pos, {_hits('text', cat.NEGATIVE)} AS neg FROM documents"
CTE["probs"] = """SELECT doc_id, CAST(exp(pos) / (exp(pos) + exp(neg) + 1) AS FLOAT) AS p_pos,
 CAST(exp(neg) / (exp(pos) + exp(neg) + 1) AS FLOAT) AS p_neg, CAST(1 / (exp(pos) + exp(neg) + 1) AS FLOAT) AS p_neu
 FROM hits"""
SQL["lexicon_sign"] = "SELECT doc_id, pos, neg, CAST(sign(pos - neg) AS INTEGER) AS lex FROM hits"
SQL["score_text"] = """SELECT doc_id, round(p_pos::DOUBLE, 4) AS p_pos, round(p_neg::DOUBLE, 4) AS p_neg,
 round(p_neu::DOUBLE, 4) AS p_neu, round((p_pos - p_neg)::DOUBLE, 4) AS sent_signed FROM probs"""
SQL["label_audit_sample"] = """SELECT label, doc_id FROM (SELECT doc_id, CASE WHEN p_pos >= greatest(p_neg, p_neu)
 THEN 'pos' WHEN p_neg >= greatest(p_pos, p_neu) THEN 'neg' ELSE 'neu' END AS label FROM probs)
 QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':1'), doc_id) <= 70"""
SQL["sign_agreement"] = f"""SELECT round(avg(CAST({_lex('title')} = {_lex('body')} AS INTEGER)), 6) AS agreement,
 count(*) AS n FROM arts"""


def _average_rank(x: str, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    equal = f"PARTITION BY {group}, {x}" if group else f"PARTITION BY {x}"
    return f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER ({equal}) - 1) / 2::DOUBLE)"


def _spearman(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


SQL["title_body_units"] = f"""SELECT round({_spearman('ra', 'rb')}, 6) AS ic, count(*) AS n FROM (
 SELECT {_average_rank('a')} AS ra, {_average_rank('b')} AS rb FROM (
  SELECT {_lex(_strip('title'))} AS a, {_lex(_strip('body'))} AS b FROM arts
  WHERE length(body) > 200 AND title IS NOT NULL))"""
SQL["title_join"] = """SELECT a.symbol, count(*) AS rows, count(b.title) AS titles FROM cleaned a
 LEFT JOIN cleaned b ON a.symbol = b.symbol AND a.ts = b.ts GROUP BY a.symbol"""
SQL["scored_titles"] = f"""SELECT symbol, date, ntitle, nurl, title, round((p - n)::DOUBLE, 4) AS sent_signed FROM (
 SELECT *, CAST(exp(a) / (exp(a) + exp(b) + 1) AS FLOAT) AS p, CAST(exp(b) / (exp(a) + exp(b) + 1) AS FLOAT) AS n FROM (
  SELECT *, {_hits('title', cat.POSITIVE)} AS a, {_hits('title', cat.NEGATIVE)} AS b FROM cleaned
  QUALIFY row_number() OVER (PARTITION BY symbol, date, ntitle, nurl
   ORDER BY CASE src WHEN 'allext' THEN 1 ELSE 2 END, ts, title, has_body) = 1))"""
SQL["date_only_fraction"] = """SELECT year(date) AS year, count(*) AS articles,
 round(avg(CASE WHEN substr(ts, 12, 8) = '00:00:00' THEN 1.0 ELSE 0.0 END), 6) AS frac FROM news GROUP BY 1"""
SQL["sampled_symbols"] = """SELECT symbol FROM (SELECT DISTINCT symbol FROM sess)
 ORDER BY md5(symbol || ':0'), symbol LIMIT 20"""
SQL["probe_rows"] = "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':3'), doc_id LIMIT 100"

# ---- alignment ----------------------------------------------------------------------

CTE["aligned"] = """SELECT n.*, s.date AS eff FROM news n ASOF JOIN sess s
 ON n.symbol = s.symbol AND n.date < s.date"""
CTE["sessnews"] = """SELECT symbol, eff AS date, avg(sent_signed) AS mean, count(*) AS n,
 coalesce(stddev_samp(sent_signed), 0) AS sd FROM aligned GROUP BY symbol, eff"""
CTE["sentd"] = """SELECT symbol, date, coalesce(last_raw * pow(0.5, (i - last_i) / 5::DOUBLE), 0) AS sent_decay, mean AS sent_raw,
 CAST(coalesce(n, 0) AS INTEGER) AS news_intensity, sd AS sent_dispersion, coalesce(i - last_i, -1) AS days_since_news,
 n IS NOT NULL AS has_news FROM (
  SELECT *, last_value(mean IGNORE NULLS) OVER w AS last_raw,
   last_value(CASE WHEN n IS NOT NULL THEN i END IGNORE NULLS) OVER w AS last_i FROM (
    SELECT s.symbol, s.date, mean, n, sd, row_number() OVER (PARTITION BY s.symbol ORDER BY s.date) AS i
    FROM sess s LEFT JOIN sessnews k ON s.symbol = k.symbol AND s.date = k.date)
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SQL["next_session"] = "SELECT symbol, date AS sdate, eff, count(*) AS n FROM aligned GROUP BY ALL"
SQL["session_sentiment"] = "SELECT symbol, date, round(mean, 8) AS mean, n, round(sd, 8) AS sd FROM sessnews"
SQL["sentiment_daily"] = """SELECT symbol, date, round(sent_decay, 8) AS sent_decay, round(sent_raw, 8) AS sent_raw,
 news_intensity, round(sent_dispersion, 8) AS sent_dispersion, days_since_news, has_news FROM sentd"""
SQL["yearly_coverage"] = """SELECT year(date) AS year, count(*) AS rows,
 round(avg(CAST(has_news AS INTEGER)) * 100, 6) AS news_pct, round(avg(news_intensity), 6) AS mean_intensity
 FROM sentd GROUP BY 1"""
CTE["monthly"] = """SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(sent_raw) AS mean, count(*) AS n
 FROM sentd WHERE has_news GROUP BY 1"""
SQL["monthly_sentiment"] = "SELECT month, round(mean, 6) AS mean, n FROM monthly"
CTE["decays"] = """SELECT *, lag(abs(sent_decay)) OVER (PARTITION BY symbol ORDER BY date) AS before FROM sentd"""
CTE["othersess"] = """SELECT DISTINCT n.symbol, (SELECT min(s.date) FROM sess s WHERE s.symbol = n.symbol AND s.date > n.date)
 AS date FROM (SELECT DISTINCT symbol, date FROM news) n"""
SQL["sentiment_gates"] = _gates(
    ("look_ahead", "count(*) FILTER (WHERE eff <= date)", 0.0, False, "aligned"),
    ("least_news_year_pct", "min(p)", 1e-9, True,
     "(SELECT avg(CAST(has_news AS INTEGER)) * 100 AS p FROM sentd GROUP BY year(date))"),
    ("news_day_age_not_zero", "count(*) FILTER (WHERE has_news AND days_since_news <> 0)", 0.0, False, "decays"),
    ("news_day_decay_not_raw", "count(*) FILTER (WHERE has_news AND abs(sent_decay - sent_raw) > 1e-5)", 0.0, False, "decays"),
    ("quiet_day_decay_rises", "count(*) FILTER (WHERE NOT has_news AND abs(sent_decay) > before + 1e-6)", 0.0, False, "decays"),
    ("outside_unit_range", "count(*) FILTER (WHERE sent_decay NOT BETWEEN -1 AND 1)", 0.0, False, "decays"),
    ("deviation", "stddev_samp(sent_decay)", 1e-12, True, "decays"),
    ("month_minus_base", "max(CASE WHEN month = DATE '1998-03-01' THEN mean END) - avg(CASE WHEN month BETWEEN "
     "DATE '1997-12-01' AND DATE '1998-02-01' THEN mean END)", 0.0, False, "monthly"),
    ("symbols_off", "count(DISTINCT symbol)", 0.0, False,
     "((SELECT * FROM (SELECT symbol, date FROM sentd WHERE has_news EXCEPT SELECT symbol, date FROM othersess)) UNION ALL "
     "(SELECT * FROM (SELECT symbol, date FROM othersess WHERE date IS NOT NULL EXCEPT SELECT symbol, date FROM sentd WHERE has_news)))"))

# ---- features and labels ------------------------------------------------------------


def _over(w: int, key: str = "symbol") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, of: str, w: int, key: str = "symbol") -> str:
    return f"CASE WHEN count({of}) {_over(w, key)} = {w} THEN {agg} {_over(w, key)} END"


KLINE = {"KMID": "(c - o) / nullif(o, 0)", "KLEN": "(h - l) / nullif(o, 0)",
         "KMID2": "(c - o) / (nullif(h - l, 0) + 1e-12)", "KUP": "(h - greatest(o, c)) / nullif(o, 0)",
         "KLOW": "(least(o, c) - l) / nullif(o, 0)", "KSFT": "(2 * c - h - l) / nullif(o, 0)",
         "KSFT2": "(2 * c - h - l) / (nullif(h - l, 0) + 1e-12)"}


def _ret(k: int, key: str = "symbol") -> str:
    return f"ln(c / lag(c, {k}) OVER (PARTITION BY {key} ORDER BY date))"


def _mom(k: int, key: str = "symbol") -> str:
    return f"c / lag(c, {k}) OVER (PARTITION BY {key} ORDER BY date) - 1"


def _rolling(w: int, key: str = "symbol") -> dict[str, str]:
    low, high = _full("min(l)", "l", w, key), _full("max(h)", "h", w, key)
    return {f"MA_{w}": f"({_full('avg(c)', 'c', w, key)}) / c", f"STD_{w}": f"({_full('stddev_samp(c)', 'c', w, key)}) / c",
            f"MAX_{w}": f"({high}) / c", f"MIN_{w}": f"({low}) / c",
            f"RSV_{w}": f"(c - ({low})) / (({high}) - ({low}) + 1e-12)",
            f"VMA_{w}": f"({_full('avg(v)', 'v', w, key)}) / (v + 1e-12)",
            f"VSTD_{w}": f"({_full('stddev_samp(v)', 'v', w, key)}) / (v + 1e-12)"}


_LC, _LV = "ln(greatest(c, 1e-12))", "ln(greatest(v, 1) + 1)"


def _corr(w: int, key: str = "symbol") -> str:
    return (f"CASE WHEN count(c) {_over(w, key)} = {w} THEN covar_samp({_LC}, {_LV}) {_over(w, key)} / nullif("
            f"stddev_samp({_LC}) {_over(w, key)} * stddev_samp({_LV}) {_over(w, key)}, 0) END")


def _forward(h: int) -> dict[str, str]:
    ahead = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return {f"fwd_ret_{h}": f"ln(lead(c, {h}) OVER (PARTITION BY symbol ORDER BY date) / c)",
            f"fwd_vol_{h}": f"CASE WHEN count(r1) {ahead} = {h} THEN stddev_samp(r1) {ahead} END"}


def _select(exprs: dict[str, str], source: str = "adjusted", digits: int | None = 6) -> str:
    cols = ", ".join(f"round({e}, {digits}) AS {n}" if digits else f"{e} AS {n}" for n, e in exprs.items())
    return f"SELECT symbol, date, {cols} FROM {source}"


def _merge(*parts: dict[str, str]) -> dict[str, str]:
    return {k: v for p in parts for k, v in p.items()}


_RETS = _merge({f"RET_{k}": _ret(k) for k in params.RETURN_LAGS}, {f"MOM_{k}": _mom(k) for k in params.MOMENTUM_WINDOWS})
_ROLLS = _merge(*[_rolling(w) for w in params.ROLL_WINDOWS])
_CORRS = {f"CORR_{w}": _corr(w) for w in params.CORR_WINDOWS}
_FWDS = _merge(*[_forward(h) for h in params.HORIZONS])
CTE["withr1"] = "SELECT *, ln(c / lag(c, 1) OVER (PARTITION BY symbol ORDER BY date)) AS r1 FROM adjusted"
SQL["kline_features"] = _select(KLINE)
SQL["return_features"] = _select(_RETS)
SQL["rolling_features"] = _select(_ROLLS)
SQL["corr_features"] = _select(_CORRS)
SQL["forward_labels"] = _select(_FWDS, "withr1")
CTE["joined"] = """SELECT a.symbol, a.date, o, h, l, c, v, sent_decay, days_since_news, news_intensity, sent_dispersion,
 has_news, s.symbol IS NOT NULL AS matched FROM adjusted a LEFT JOIN sentd s ON a.symbol = s.symbol AND a.date = s.date"""
_S = "sent_decay"
_ANY = "bool_or(matched) OVER (PARTITION BY symbol)"
_SENT = {"SENT": _S, "SENT_DELTA": f"{_S} - lag({_S}) OVER (PARTITION BY symbol ORDER BY date)",
         "SENT_MA_5": _full(f"avg({_S})", _S, 5), "SENT_MA_20": _full(f"avg({_S})", _S, 20),
         "SENT_STD_20": _full(f"stddev_samp({_S})", _S, 20), "DSN": "days_since_news",
         "NEWS_INT": f"CASE WHEN {_ANY} THEN ln(1 + coalesce(news_intensity, 0)) END",
         "SENT_DISP": f"CASE WHEN {_ANY} THEN coalesce(sent_dispersion, 0) END",
         "HAS_NEWS": f"CASE WHEN {_ANY} THEN CAST(coalesce(has_news, false) AS INTEGER) END"}
SQL["sentiment_features"] = _select(_SENT, "joined")


def _xs(x: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER "
            f"(PARTITION BY date, {x}) - 1) / 2::DOUBLE) / count({x}) OVER (PARTITION BY date) END")


CTE["xsin"] = _select(_merge({"RET_20": _ret(20), "MOM_20": _mom(20)}, {"MA_20": _rolling(20)["MA_20"]}), digits=None)
SQL["xs_rank_features"] = _select({f"XS_{s}": _xs(s) for s in params.XS_SOURCES}, "xsin")
_SPLIT = "CASE " + " ".join(f"WHEN {_between(getattr(fx.SPLITS, s))} THEN '{s}'" for s in ("train", "val", "test")) \
    + " ELSE 'warmup' END"
CTE["joinedr1"] = "SELECT *, ln(c / lag(c, 1) OVER (PARTITION BY symbol ORDER BY date)) AS r1 FROM joined"
CTE["widefeat"] = _select(_merge(KLINE, _RETS, _ROLLS, _CORRS, _FWDS, _SENT), "joinedr1", None)
CTE["rawpanel"] = "SELECT *, " + ", ".join(f"{_xs(s)} AS XS_{s}" for s in params.XS_SOURCES) \
    + f", {_SPLIT} AS split FROM widefeat"
_SCALED = [*KLINE, *_RETS, *_ROLLS, *_CORRS, *[s for s in _SENT if s != "HAS_NEWS"],
           *[f"XS_{s}" for s in params.XS_SOURCES]]
SQL["train_norm_stats"] = "SELECT symbol, " + ", ".join(
    f"round(avg({f}), 6) AS {f}__mu, round(nullif(stddev_samp({f}), 0), 6) AS {f}__sd" for f in _SCALED) \
    + " FROM rawpanel WHERE split = 'train' GROUP BY symbol"


def _z(f: str) -> str:
    own = f"CASE WHEN split = 'train' THEN {f} END"
    return (f"({f} - avg({own}) OVER (PARTITION BY symbol)) / "
            f"nullif(stddev_samp({own}) OVER (PARTITION BY symbol), 0)")


CTE["zpanel"] = "SELECT symbol, date, split, HAS_NEWS, " + ", ".join(_FWDS) + ", " + ", ".join(
    f"{_z(f)} AS {f}" for f in _SCALED) + " FROM rawpanel"
SQL["normalised_panel"] = "SELECT symbol, date, split, HAS_NEWS, " + ", ".join(
    f"round(CAST({f} AS FLOAT)::DOUBLE, 3) AS {f}" for f in _FWDS) + ", " + ", ".join(
    f"round(CAST(CASE WHEN {f} IS NOT NULL THEN greatest(-8, least(8, {f})) END AS FLOAT)::DOUBLE, 3) AS {f}"
    for f in _SCALED) + " FROM zpanel"

_CAUSAL = {"RET_20": _ret(20), "MA_20": _rolling(20)["MA_20"], "KMID": KLINE["KMID"], "CORR_20": _corr(20),
           "RSV_20": _rolling(20)["RSV_20"], "VMA_20": _rolling(20)["VMA_20"], "VSTD_20": _rolling(20)["VSTD_20"],
           "MOM_20": _mom(20), "SENT_MA_20": _SENT["SENT_MA_20"]}
CTE["placed"] = """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) <=
 floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) + 1 AS kept FROM joined"""
CTE["fullside"] = _select({**_CAUSAL, "kept": "kept"}, "placed", None)
CTE["cutside"] = _select(_CAUSAL, "(SELECT * FROM placed WHERE kept)", None)
SQL["truncation_causality"] = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (WHERE a.{f} IS NOT NULL OR b.{f} IS NOT NULL) AS checked, count(*) FILTER "
    f"(WHERE (a.{f} IS NULL) <> (b.{f} IS NULL) OR abs(a.{f} - b.{f}) > 1e-9) AS bad FROM fullside a JOIN cutside b "
    f"ON a.symbol = b.symbol AND a.date = b.date WHERE a.kept" for f in _CAUSAL)
CTE["numbered"] = """SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
 FROM (SELECT DISTINCT date FROM adjusted)"""
CTE["cuts"] = """SELECT date AS cut FROM numbered
 WHERE i IN (SELECT DISTINCT floor(60 + k * ((n - 120) / 39::DOUBLE)) FROM numbered, range(40) t(k))"""
_KEY2 = "cut, symbol"
CTE["versions"] = """SELECT a.*, cut FROM adjusted a JOIN cuts ON a.date <= cut"""
CTE["cutranks"] = "SELECT symbol, date, " + ", ".join(f"{_xs(s)} AS {s}" for s in params.XS_SOURCES) + f""" FROM (
 SELECT symbol, date, cut, {_ret(20, _KEY2)} AS RET_20, {_mom(20, _KEY2)} AS MOM_20,
 {_rolling(20, _KEY2)['MA_20']} AS MA_20 FROM versions) WHERE date = cut"""
CTE["fullranks"] = "SELECT symbol, date, " + ", ".join(f"{_xs(s)} AS {s}" for s in params.XS_SOURCES) + " FROM xsin"
SQL["rank_truncation"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT a.date, 'XS_{s}' AS feature, count(*) FILTER (WHERE a.{s} IS NOT NULL AND b.{s} IS NOT NULL) AS names, "
    f"count(*) FILTER (WHERE (a.{s} IS NULL) <> (b.{s} IS NULL) OR abs(a.{s} - b.{s}) > 1e-9) AS bad "
    f"FROM fullranks a JOIN cutranks b ON a.symbol = b.symbol AND a.date = b.date GROUP BY a.date"
    for s in params.XS_SOURCES) + ") WHERE names >= 20"
SQL["independent_sessions"] = """SELECT DISTINCT symbol, (SELECT min(s.date) FROM sess s WHERE s.symbol = n.symbol AND s.date > n.date) AS date
 FROM (SELECT DISTINCT symbol, date FROM news) n WHERE EXISTS (SELECT 1 FROM sess s WHERE s.symbol = n.symbol AND s.date > n.date)"""

_GF = cat.GATE_FEATURES
CTE["gateraw"] = "SELECT *, " + _SPLIT + " AS split FROM (" + _select(
    {"c": "c", "RET_20": _ret(20), "MA_20": _rolling(20)["MA_20"], "KMID": KLINE["KMID"], "CORR_20": _corr(20),
     "SENT": "sent_decay", "fwd_ret_5": _forward(5)["fwd_ret_5"]}, "joined", None) + ")"
CTE["gatestats"] = "SELECT symbol, " + ", ".join(
    f"avg({f}) AS {f}__mu, nullif(stddev_samp({f}), 0) AS {f}__sd" for f in _GF) \
    + " FROM gateraw WHERE split = 'train' GROUP BY symbol"
CTE["gatez"] = "SELECT r.symbol, r.date, r.split, r.fwd_ret_5, " + ", ".join(
    f"CASE WHEN (r.{f} - {f}__mu) / {f}__sd IS NOT NULL THEN greatest(-8, least(8, (r.{f} - {f}__mu) / {f}__sd)) END AS {f}"
    for f in _GF) + " FROM gateraw r LEFT JOIN gatestats s ON r.symbol = s.symbol"
CTE["gateall"] = "SELECT symbol, " + ", ".join(
    f"avg({f}) FILTER (WHERE split = 'train') AS {f}_t, avg({f}) AS {f}_a" for f in _GF) + " FROM gateraw GROUP BY symbol"
CTE["gateunit"] = "SELECT " + ", ".join(f"avg(abs({f}_m)) AS {f}_m, avg({f}_s) AS {f}_s" for f in ("RET_20", "MA_20")) \
    + " FROM (SELECT symbol, " + ", ".join(f"avg({f}) AS {f}_m, stddev_samp({f}) AS {f}_s" for f in ("RET_20", "MA_20")) \
    + " FROM gatez WHERE split = 'train' GROUP BY symbol)"
CTE["gatesent"] = """SELECT z.SENT AS z, s.sent_decay AS d, SENT__sd AS sd, SENT__mu AS mu FROM gatez z
 JOIN sentd s ON z.symbol = s.symbol AND z.date = s.date JOIN gatestats g ON z.symbol = g.symbol
 WHERE z.SENT IS NOT NULL AND SENT__sd IS NOT NULL"""
_STAT_OFF = " + ".join(f"coalesce(CAST(abs({f}__mu - {f}_t) > 1e-6 * (1 + abs({f}_t)) AS INTEGER), 0)" for f in _GF[:4])
_STAT_ALL = " + ".join(f"coalesce(CAST(abs({f}_t - {f}_a) > 1e-9 AND abs({f}__mu - {f}_a) < 1e-9 AS INTEGER), 0)"
                       for f in _GF[:4])
_UNIT = []
for _f in ("RET_20", "MA_20"):
    _UNIT += [(f"{_f}_train_mean", f"max({_f}_m)", 0.05, False, "gateunit"),
              (f"{_f}_train_sd_low", f"max({_f}_s)", 0.8, True, "gateunit"),
              (f"{_f}_train_sd_high", f"max({_f}_s)", 1.2, False, "gateunit")]
SQL["panel_gates"] = _gates(
    ("stats_not_train_moments", f"sum({_STAT_OFF})", 0.0, False, "gateall a JOIN gatestats s ON a.symbol = s.symbol"),
    ("stats_of_all_rows", f"sum({_STAT_ALL})", 0.0, False, "gateall a JOIN gatestats s ON a.symbol = s.symbol"),
    *_UNIT,
    ("labels_off", "count(*) FILTER (WHERE abs(z.fwd_ret_5 - e.x) > 1e-4)", 0.0, False,
     "gatez z LEFT JOIN (SELECT symbol, date, ln(lead(c, 5) OVER (PARTITION BY symbol ORDER BY date) / c) AS x FROM adjusted) e "
     "ON z.symbol = e.symbol AND z.date = e.date"),
    ("sentiment_rebuild_error", "max(CASE WHEN abs(z) < 7.999 THEN abs(z * sd + mu - d) END)", 1e-4, False, "gatesent"),
    ("sentiment_clipped_share", "avg(CAST(NOT abs(z) < 7.999 AS INTEGER))", 1.0, False, "gatesent"),
    ("sentiment_pearson", "covar_samp(z, d) / nullif(stddev_samp(z) * stddev_samp(d), 0)", -1.0, True, "gatesent"),
    ("splits_ordered", "CAST(coalesce(max(date) FILTER (WHERE split = 'train') < min(date) FILTER (WHERE split = 'val') AND "
     "max(date) FILTER (WHERE split = 'val') < min(date) FILTER (WHERE split = 'test'), false) AS INTEGER)", 1.0, True, "gatez"),
    ("repeated_rows", "count(*) - count(DISTINCT (symbol, date))", 0.0, False, "gatez"))

# ---- rebalance dates, folds, samples ------------------------------------------------

_W5, _W20 = _rolling(5), _rolling(20)
_MF = {"KMID": KLINE["KMID"], "KLEN": KLINE["KLEN"], "RET_5": _ret(5), "MOM_20": _mom(20), "STD_20": _W20["STD_20"],
       "RSV_5": _W5["RSV_5"], "MA_20": _W20["MA_20"], "VMA_20": _W20["VMA_20"]}
CTE["mpanel"] = f"SELECT *, {_SPLIT} AS split FROM (" + _select({**_MF, **_forward(5)}, "withr1", None) + ")"
_BAD = " OR ".join(f"{f} IS NULL" for f in _MF)
_L = fx.SPEC.lookback
CTE["elig"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
 sum(CAST({_BAD} AS INTEGER)) {_over(_L)} AS nbad FROM mpanel)
 WHERE rn >= {_L} AND nbad = 0 AND fwd_ret_5 IS NOT NULL"""
CTE["rebdates"] = """SELECT row_number() OVER (ORDER BY date) - 1 AS t, date FROM (
 SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM elig))
 WHERE CASE WHEN n > 10 THEN i >= 5 AND i < n - 5 AND (i - 5) % 5 = 0 ELSE i % 5 = 0 END"""
CTE["rebrows"] = "SELECT e.*, r.t, e.fwd_ret_5 AS y FROM elig e JOIN rebdates r ON e.date = r.date"
SQL["eligible_rows"] = "SELECT symbol, date, round(fwd_ret_5, 6) AS y, round(fwd_vol_5, 6) AS v FROM elig"
SQL["rebalance_dates"] = "SELECT t, date FROM rebdates"
SQL["row_gaps"] = """SELECT symbol, min(gap) AS min_gap FROM (
 SELECT symbol, rn - lag(rn) OVER (PARTITION BY symbol ORDER BY rn) AS gap FROM (
  SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM adjusted)
 WHERE date IN (SELECT date FROM rebdates)) GROUP BY symbol"""
SQL["symbol_codes"] = "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS sym_id FROM (SELECT DISTINCT symbol FROM sess)"
SQL["capped_dates"] = """SELECT date, symbol FROM rebrows
 QUALIFY row_number() OVER (PARTITION BY date ORDER BY md5(symbol || ':5'), symbol) <= 10"""
SQL["date_sample"] = """SELECT date, i FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM
 (SELECT DISTINCT date FROM sess)) WHERE i IN (SELECT CAST(floor(400 + k * (((SELECT count(DISTINCT date) FROM sess)
 - 460) / 39::DOUBLE)) AS BIGINT) FROM range(40) x(k))"""
CTE["blocks"] = """SELECT t // 16 AS block, date FROM rebdates
 WHERE (t // 16 + 1) * 16 <= (SELECT count(*) FROM rebdates)"""
SQL["date_blocks"] = "SELECT block, date FROM blocks"
SQL["shuffled_blocks"] = """SELECT block, dense_rank() OVER (ORDER BY md5(block || ':11')) - 1 AS turn, date FROM blocks"""
SQL["sequence_windows"] = f"""SELECT p.symbol, p.date, length, round(first_kmid, 6) AS first_kmid,
 round(last_kmid, 6) AS last_kmid, round(sum_kmid, 6) AS sum_kmid FROM (
  SELECT symbol, date, count(*) {_over(_L)} AS length, lag(KMID, {_L - 1}) OVER (PARTITION BY symbol ORDER BY date) AS first_kmid,
   KMID AS last_kmid, sum(KMID) {_over(_L)} AS sum_kmid FROM mpanel) p
 JOIN rebrows r ON p.symbol = r.symbol AND p.date = r.date"""


def _folds(groups: int, k: int, purge: int, source: str) -> str:
    """source has columns date and i, n."""
    combos = ", ".join(f"({i}, [{', '.join(map(str, c))}])" for i, c in enumerate(combinations(range(groups), k)))
    return f"""SELECT fold, i, date, CASE WHEN tst THEN 'test' WHEN bool_or(tst) OVER (PARTITION BY fold ORDER BY i
 ROWS BETWEEN {purge} PRECEDING AND {purge} FOLLOWING) THEN 'purged' ELSE 'train' END AS role FROM (
 SELECT fold, i, date, list_contains(combo, ((i + 1) * {groups} - 1) // n) AS tst
 FROM {source}, (VALUES {combos}) AS c(fold, combo))"""


CTE["rebn"] = "SELECT t AS i, date, (SELECT count(*) FROM rebdates) AS n FROM rebdates"
CTE["cpcv"] = _folds(6, 2, 1, "rebn")
SQL["cpcv_folds"] = "SELECT fold, i, date, role FROM cpcv"
SQL["cscv_folds"] = f"SELECT fold, i, role FROM ({_folds(10, 5, 0, 'rebn')})"
SQL["nested_inner"] = """SELECT fold, j, date, CASE WHEN j >= floor(n * 4 / 5::DOUBLE) THEN 'val'
 WHEN j < floor(n * 4 / 5::DOUBLE) - 1 THEN 'train' ELSE 'purged' END AS role FROM (
 SELECT fold, date, row_number() OVER (PARTITION BY fold ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY fold) AS n
 FROM cpcv WHERE role = 'train')"""
SQL["fold_gates"] = """SELECT c.fold, n_train, n_test, CAST(0 AS BIGINT) AS overlap, min_gap, min_gap > 1 AS passed FROM (
 SELECT fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test
 FROM cpcv GROUP BY fold) c JOIN (SELECT a.fold, min(abs(a.i - b.i)) AS min_gap FROM cpcv a JOIN cpcv b
 ON a.fold = b.fold AND a.role = 'train' AND b.role = 'test' GROUP BY a.fold) g ON c.fold = g.fold"""
SQL["fold_coverage"] = "SELECT date, count(*) FILTER (WHERE role = 'test') AS paths FROM cpcv GROUP BY date"
_CELL = ", ".join(f"(({i}), '{m}', '{a}')" for i, (m, a) in enumerate(
    [*product(("m0", "m1", "m2"), ("risk", "mse")), ("ridge", "ridge")]))
_BASE = {"risk": "MOM_20", "mse": "-RET_5", "ridge": "MA_20 * 0.5::DOUBLE - STD_20 * 0.5::DOUBLE"}
CTE["cells"] = " UNION ALL ".join(
    f"SELECT 'm{m}' AS model, '{a}' AS arm, {s} AS seed, c.fold, r.t AS date_id, r.symbol AS sym_id, r.y, r.split, "
    f"{_BASE[a]} + {m} * 0.02::DOUBLE * KMID + {s} * 0.01::DOUBLE * RSV_5 + c.fold * 0.001::DOUBLE * KLEN AS score "
    f"FROM rebrows r JOIN cpcv c ON r.date = c.date AND c.role = 'test'"
    for m in range(len(fx.MODELS)) for a in fx.ARMS for s in range(fx.SEEDS))
SQL["cell_backlog"] = f"""SELECT p * {fx.SEEDS * 15} + s * 15 + f AS cell, model, arm, s AS seed, f AS fold FROM
 (VALUES {_CELL}) AS g(p, model, arm), range({fx.SEEDS}) a(s), range(15) b(f) WHERE NOT EXISTS (SELECT 1 FROM cells k
 WHERE k.model = g.model AND k.arm = g.arm AND k.seed = s AND k.fold = f
 AND NOT (k.model = 'm1' AND k.seed = 1 AND k.arm = 'mse'))"""

# ---- portfolios ---------------------------------------------------------------------


def _hard(source: str, by: str, t: str = "t", sym: str = "symbol", cost: float = 0.001) -> str:
    """gross, turnover, net per (by, t) of ``source`` with columns by, t, sym, y, score."""
    keys = f"{by}, {t}" if by else t
    part = f"PARTITION BY {by} " if by else ""
    return _net(f"""SELECT {keys}, {sym}, y, 1.0::DOUBLE / k AS w FROM (SELECT *, greatest(1, ceil(0.1::DOUBLE * count(*)
 OVER (PARTITION BY {keys}))) AS k, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {sym}) AS p FROM {source})
 WHERE p <= k""", by, t, sym, cost)


def _net(weights: str, by: str, t: str, sym: str, cost: float) -> str:
    keys = f"{by}, {t}" if by else t
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {keys}, gross, CASE WHEN d = 1 THEN 0 ELSE turnover END AS turnover,
 gross - {cost}::DOUBLE * CASE WHEN d = 1 THEN 0 ELSE turnover END AS net FROM (
 SELECT {lead}{t}, d, sum(w * y) AS gross FROM (SELECT *, dense_rank() OVER ({part}ORDER BY {t}) AS d FROM ({weights}))
 GROUP BY ALL) JOIN (SELECT {lead}d, 0.5::DOUBLE * sum(abs(dw)) AS turnover FROM (SELECT {lead}d, {sym}, sum(sw) AS dw FROM (
  SELECT {lead}d, {sym}, w AS sw FROM (SELECT *, dense_rank() OVER ({part}ORDER BY {t}) AS d FROM ({weights})) UNION ALL
  SELECT {lead}d + 1, {sym}, -w FROM (SELECT *, dense_rank() OVER ({part}ORDER BY {t}) AS d FROM ({weights})))
  GROUP BY ALL) GROUP BY ALL) USING ({lead}d)"""


_ANN = math.sqrt(252.0 / 5)


def _sharpe(x: str) -> str:
    return f"avg({x}) / (stddev_samp({x}) + 1e-12) * {_ANN!r}"


CTE["mom"] = "SELECT t, date, symbol, y, MOM_20 AS score, STD_20 FROM rebrows"
CTE["momnet"] = _hard("mom", "")
SQL["top_decile_net"] = f"""SELECT t, date, {_r(['gross', 'turnover', 'net'])} FROM momnet JOIN rebdates USING (t)"""
CTE["softw"] = """SELECT t, symbol, y, CASE WHEN n = 1 THEN 1 ELSE w / (sum(w) OVER (PARTITION BY t) + 1e-8) END AS w FROM (
 SELECT *, 1 / (1 + exp(-greatest(-700, least(700, (score - q) / (0.05::DOUBLE * sd))))) AS w FROM mom JOIN (
  SELECT t, quantile_cont(score, 0.9) AS q, stddev_pop(score) + 1e-8 AS sd, count(*) AS n FROM mom GROUP BY t) USING (t))"""
CTE["softnet"] = _net("SELECT t, symbol, y, w FROM softw", "", "t", "symbol", 0.001)
SQL["soft_decile_net"] = f"SELECT t, {_r(['gross', 'turnover', 'net'])} FROM softnet"
SQL["cost_grid"] = " UNION ALL ".join(
    f"SELECT {c}::DOUBLE AS cost_bps, round({_sharpe(f'(gross - {c / 10000}::DOUBLE * turnover)')}, 6) AS sharpe FROM momnet"
    for c in (0, 5, 10, 20))
SQL["performance"] = f"""SELECT round({_sharpe('net')}, 6) AS sharpe,
 round(avg(net) / nullif(sqrt(avg(pow(least(net, 0), 2))), 0) * {_ANN!r}, 6) AS sortino,
 round(max(1 - wealth / peak), 6) AS max_drawdown,
 round(avg(net) * {252.0 / 5!r} / nullif(max(1 - wealth / peak), 0), 6) AS calmar,
 round(avg(net) FILTER (WHERE net <= (SELECT quantile_cont(net, 0.05) FROM momnet)), 6) AS cvar FROM (
 SELECT *, greatest(1, max(wealth) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS peak FROM (
  SELECT t, net, exp(sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS wealth
  FROM momnet))"""
SQL["buy_and_hold"] = "SELECT t, round(avg(y), 6) AS gross, count(*) AS names FROM mom GROUP BY t"
CTE["daygross"] = """SELECT date, avg(fwd_ret_5) AS gross FROM (SELECT *, row_number() OVER (PARTITION BY date
 ORDER BY MOM_20 DESC, symbol) AS p, greatest(1, ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY date))) AS k FROM elig)
 WHERE p <= k GROUP BY date"""
CTE["centred"] = """SELECT gross, gross - avg(gross) OVER () AS e, row_number() OVER (ORDER BY date) AS i FROM daygross"""
SQL["newey_west"] = """SELECT round(mean, 6) AS mean, round(se, 6) AS se, n, round(mean / se, 6) AS t FROM (
 SELECT (SELECT avg(gross) FROM centred) AS mean, (SELECT count(*) FROM centred) AS n,
  sqrt(sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / 5::DOUBLE) * g END)) / (SELECT count(*) FROM centred) AS se FROM (
   SELECT a.i - b.i AS k, sum(a.e * b.e) AS g FROM centred a JOIN centred b ON a.i - b.i BETWEEN 0 AND 4 GROUP BY 1))"""
SQL["objective_diagnostics"] = """SELECT round(l_sr, 6) AS l_sr, round(l_anchor, 6) AS l_anchor, round(l_nll, 6) AS l_nll,
 round(0.7 * l_sr + 0.5 * l_anchor + 0.5 * l_nll, 6) AS total FROM
 (SELECT -avg(net) / (stddev_samp(net) + 1e-8) AS l_sr FROM softnet),
 (SELECT avg(pow(y - score, 2)) AS l_anchor, avg(0.5 * (lv + pow(y - score, 2) / (exp(lv) + 1e-8))) AS l_nll
  FROM (SELECT *, ln(STD_20 * STD_20) AS lv FROM mom))"""
SQL["selection_metric"] = f"""SELECT 'risk' AS arm, round({_sharpe('gross')}, 6) AS metric FROM momnet UNION ALL
 SELECT 'mse', round(-avg(pow(score - y, 2)), 6) FROM mom"""

# ---- scores to verdict --------------------------------------------------------------

CTE["oof"] = """SELECT model, arm, date_id, sym_id, max(y) AS y, avg(score) AS score, any_value(split) AS split
 FROM cells GROUP BY model, arm, date_id, sym_id"""
SQL["oof_scores"] = "SELECT model, arm, date_id, sym_id, round(y, 6) AS y, round(score, 6) AS score FROM oof"
CTE["paired"] = """SELECT a.model, a.date_id, a.sym_id, a.y, a.score AS s_risk, b.score AS s_mse, c.score AS s_ridge FROM oof a
 JOIN oof b ON a.model = b.model AND a.date_id = b.date_id AND a.sym_id = b.sym_id AND b.arm = 'mse'
 JOIN oof c ON c.model = 'm0' AND c.arm = 'ridge' AND a.date_id = c.date_id AND a.sym_id = c.sym_id
 WHERE a.arm = 'risk' AND a.split = 'test'"""
SQL["paired_arms"] = f"SELECT model, date_id, sym_id, {_r(['y', 's_risk', 's_mse', 's_ridge'])} FROM paired"
CTE["ooftest"] = "SELECT * FROM oof WHERE split = 'test'"
CTE["oofnet"] = _hard("ooftest", "model, arm", "date_id", "sym_id")
CTE["look"] = f"""SELECT c.model, c.arm, cells, coalesce(rows, 0) AS rows, CASE WHEN rows >= 20 THEN sharpe END AS sharpe,
 CASE WHEN rows >= 20 THEN ic END AS ic FROM
 (SELECT model, arm, count(DISTINCT (seed, fold)) AS cells FROM cells GROUP BY model, arm) c
 LEFT JOIN (SELECT model, arm, {_sharpe('net')} AS sharpe FROM oofnet GROUP BY model, arm) s USING (model, arm)
 LEFT JOIN (SELECT model, arm, count(*) AS rows, {_spearman('rx', 'ry')} AS ic FROM (
  SELECT model, arm, {_average_rank('score', 'model, arm')} AS rx, {_average_rank('y', 'model, arm')} AS ry FROM ooftest)
  GROUP BY model, arm) i USING (model, arm)"""
SQL["quicklook"] = "SELECT model, arm, cells, rows, round(sharpe, 6) AS sharpe, round(ic, 6) AS ic FROM look"
SQL["arm_gain"] = """SELECT a.model, round(a.sharpe - b.sharpe, 6) AS dsharpe,
 round(coalesce(a.ic, 0) - coalesce(b.ic, 0), 6) AS drankic FROM look a JOIN look b ON a.model = b.model
 WHERE a.arm = 'risk' AND b.arm = 'mse' AND a.sharpe - b.sharpe IS NOT NULL"""
CTE["seedoof"] = """SELECT model, seed, date_id, sym_id, max(y) AS y, avg(score) AS score FROM cells
 WHERE arm = 'risk' AND split = 'test' GROUP BY model, seed, date_id, sym_id"""
SQL["seed_dispersion"] = f"""SELECT model, seed, round({_sharpe('net')}, 6) AS sharpe, count(*) AS periods
 FROM ({_hard('seedoof', 'model, seed', 'date_id', 'sym_id')}) GROUP BY model, seed HAVING count(*) > 1"""
CTE["armrows"] = " UNION ALL ".join(
    f"SELECT model, '{a}' AS arm, date_id, sym_id, y, s_{a} AS score FROM paired" for a in fx.ARMS)
CTE["armnet"] = _hard("armrows", "model, arm", "date_id", "sym_id")
CTE["armdiff"] = """SELECT a.model, a.date_id, a.net - b.net AS d FROM armnet a JOIN armnet b
 ON a.model = b.model AND a.date_id = b.date_id AND a.arm = 'risk' AND b.arm = 'mse'"""
_G = params.EULER_GAMMA
_HURDLE = (1 - _G) * NormalDist().inv_cdf(1 - 1 / 1152) + _G * NormalDist().inv_cdf(1 - 1 / (1152 * math.e))
CTE["dsr"] = f"""SELECT *, (sr - sqrt(1.0::DOUBLE / (n - 1)) * {_HURDLE!r}) * sqrt(n - 1) /
 sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-9)) AS z FROM (
 SELECT model, count(*) AS n, avg(m) / (stddev_samp(d) + 1e-12) AS sr,
  avg(pow(d - m, 3)) / (pow(stddev_pop(d), 3) + 1e-12) AS g3,
  avg(pow(d - m, 4)) / (pow(stddev_pop(d), 4) + 1e-12) AS g4
 FROM (SELECT *, avg(d) OVER (PARTITION BY model) AS m FROM armdiff) GROUP BY model)"""
SQL["deflated_sharpe"] = f"""SELECT model, n, round(sr * {_ANN!r}, 6) AS sr, round(g3, 6) AS g3, round(g4, 6) AS g4,
 round(z, 6) AS z FROM dsr"""
CTE["perf"] = """SELECT model, date_id, list_position(['risk', 'mse', 'ridge'], arm) AS config, gross AS value FROM armnet"""
_PBO_COMBOS = ", ".join(f"({i}, [{', '.join(map(str, c))}])" for i, c in enumerate(combinations(range(10), 5)))
CTE["cscvmeans"] = f"""SELECT model, fold, config, avg(CASE WHEN NOT oos THEN value END) AS ism,
 avg(CASE WHEN oos THEN value END) AS oom FROM (SELECT p.*, fold, list_contains(combo, ((i + 1) * 10 - 1) // n) AS oos FROM (
  SELECT *, dense_rank() OVER (PARTITION BY model ORDER BY date_id) - 1 AS i,
   (SELECT count(DISTINCT q.date_id) FROM perf q WHERE q.model = perf.model) AS n FROM perf) p,
  (VALUES {_PBO_COMBOS}) AS c(fold, combo)) GROUP BY model, fold, config"""
SQL["pbo"] = """SELECT model, count(*) AS n_splits, round(avg(CAST(ln(s / (1 - s)) <= 0 AS INTEGER)), 6) AS pbo FROM (
 SELECT model, fold, best, greatest(1e-6, least(1 - 1e-6, rk / (n + 1)::DOUBLE)) AS s FROM (
  SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY ism DESC, config) AS best,
   row_number() OVER (PARTITION BY model, fold ORDER BY oom, config) AS rk,
   count(*) OVER (PARTITION BY model, fold) AS n FROM cscvmeans)) WHERE best = 1 GROUP BY model"""
SQL["score_errors"] = """SELECT model, arm, round(avg(pow(score - y, 2)), 6) AS mse, round(avg(abs(score - y)), 6) AS mae,
 count(*) AS n FROM cells GROUP BY model, arm"""

CTE["fwd520"] = _select({k: v for k, v in _FWDS.items() if k in ("fwd_ret_5", "fwd_ret_20")}, "withr1", None)

# ---- resampling and power ---------------------------------------------------------------

CTE["horizongross"] = """SELECT horizon, date, avg(y) AS gross FROM (SELECT *, row_number() OVER (PARTITION BY horizon, date
 ORDER BY score DESC, symbol) AS p, greatest(1, ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY horizon, date))) AS k FROM (
  SELECT e.symbol, e.date, e.MOM_20 AS score, h AS horizon, CASE h WHEN 5 THEN f.fwd_ret_5 ELSE f.fwd_ret_20 END AS y
  FROM elig e JOIN fwd520 f ON e.symbol = f.symbol AND e.date = f.date, (VALUES (5), (20)) AS v(h)) WHERE y IS NOT NULL)
 WHERE p <= k GROUP BY horizon, date"""


def _bootstrap(source: str, key: str, date: str, value: str, mean: str, spacing: str, replicates: int = 1000) -> str:
    """Blocks laid out value by value: every replicate is written out in full, in the order of its draws."""
    def bits(part: int) -> str:
        return f"('0x' || substr(md5(concat_ws(':', 'bootstrap', replicate, draw)), {1 + 13 * part}, 13))::BIGINT"
    return f"""SELECT {key}, count(*) AS replicates, max(n) AS n, {', '.join(
        f"round(quantile_cont({c}, 0.025), 6) AS {c}_low, round(quantile_cont({c}, 0.975), 6) AS {c}_high, round(stddev_samp({c}), 6) AS {c}_se"
        for c in ('mean', 'sharpe'))} FROM (
 SELECT b.{key}, replicate, any_value(b.n) AS n, avg(x) AS mean, avg(x) / (stddev_samp(x) + 1e-12) * sqrt(252.0::DOUBLE / {spacing}) AS sharpe FROM (
  SELECT {key}, replicate, n, unnest(range(least(len, n - before)::BIGINT)) + start AS place FROM (
   SELECT *, coalesce(sum(len) OVER (PARTITION BY {key}, replicate ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT {key}, n, replicate, draw, {bits(0)} % n AS start,
     least(n, 1 + floor(ln(({bits(1)} + 1) / pow(2::DOUBLE, 52)) / ln(1 - 1 / {mean}::DOUBLE)))::BIGINT AS len FROM (
     SELECT {key}, n, replicate, unnest(range(n)) AS draw FROM (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key}), range({replicates}) r(replicate))))
   WHERE before < n) b
 JOIN (SELECT {key}, {value} AS x, row_number() OVER (PARTITION BY {key} ORDER BY {date}) - 1 AS i FROM {source}) s ON s.{key} = b.{key} AND s.i = b.place % b.n
 GROUP BY b.{key}, replicate) GROUP BY {key}"""


SQL["bootstrap_difference"] = _bootstrap("armdiff", "model", "date_id", "d", "4.0", "5")
SQL["bootstrap_horizons"] = _bootstrap("horizongross", "horizon", "date", "gross", "horizon", "b.horizon")
_Z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
CTE["hcentred"] = """SELECT horizon, gross, gross - avg(gross) OVER (PARTITION BY horizon) AS e,
 row_number() OVER (PARTITION BY horizon ORDER BY date) AS i FROM horizongross"""
CTE["heff"] = """SELECT horizon, n, mean, sd, n / greatest(1, 1 + 2 * w / v) AS n_eff FROM
 (SELECT horizon, count(*) AS n, avg(gross) AS mean, stddev_samp(gross) AS sd, sum(e * e) AS v FROM hcentred GROUP BY horizon)
 JOIN (SELECT a.horizon, sum((1 - (a.i - b.i) / a.horizon::DOUBLE) * a.e * b.e) AS w FROM hcentred a JOIN hcentred b
  ON a.horizon = b.horizon AND a.i - b.i BETWEEN 1 AND a.horizon - 1 GROUP BY a.horizon) USING (horizon)"""
SQL["detectable_effect"] = f"""SELECT horizon, n, {_r(['mean', 'sd', 'n_eff'])}, n // horizon AS n_floor,
 round(mean / (sd + 1e-12) * sqrt(252.0::DOUBLE / horizon), 6) AS sharpe, {', '.join(
    f"round({_Z!r}::DOUBLE * sqrt((1 + pow(mean / (sd + 1e-12), 2) / 2) / {n}) * sqrt(252.0::DOUBLE / horizon), 6) AS {a}"
    for n, a in (('(n // horizon)', 'mde_floor'), ('n_eff', 'mde_eff')))} FROM heff"""

# ---- normal probability and the verdict -------------------------------------------------


def _cdf(z: str) -> str:
    """Normal probability by the power series about zero; 12 deviations out it is 0 or 1 to more digits than are compared."""
    terms = f"[exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())) FOR k IN range(300)]"
    return f"""CASE WHEN {z} = 0 THEN 0.5 WHEN abs({z}) > 8 THEN CAST({z} > 0 AS DOUBLE)
 ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum({terms}) END"""


SQL["deflated_sharpe_probability"] = f"""SELECT model, round(z, 6) AS z, round(dsr, 6) AS dsr, round(1 - dsr, 6) AS p FROM (
 SELECT model, z, {_cdf('z')} AS dsr FROM dsr)"""
CTE["armgaps"] = """SELECT a.model, b.arm AS other, a.date_id, a.net - b.net AS d FROM armnet a JOIN armnet b
 ON a.model = b.model AND a.date_id = b.date_id AND a.arm = 'risk' AND b.arm <> 'risk'"""
CTE["gapdsr"] = f"""SELECT model, other, sr, {_cdf('z')} AS dsr FROM (
 SELECT *, (sr - sqrt(1.0::DOUBLE / (n - 1)) * {_HURDLE!r}) * sqrt(n - 1) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-9)) AS z FROM (
  SELECT model, other, count(*) AS n, avg(m) / (stddev_samp(d) + 1e-12) AS sr,
   avg(pow(d - m, 3)) / (pow(stddev_pop(d), 3) + 1e-12) AS g3, avg(pow(d - m, 4)) / (pow(stddev_pop(d), 4) + 1e-12) AS g4
  FROM (SELECT *, avg(d) OVER (PARTITION BY model, other) AS m FROM armgaps) GROUP BY model, other))"""
CTE["pairedic"] = f"""SELECT model, {_spearman('ra', 'ry')} - {_spearman('rb', 'ry')} AS gain FROM (
 SELECT model, {_average_rank('s_risk', 'model')} AS ra, {_average_rank('s_mse', 'model')} AS rb, {_average_rank('y', 'model')} AS ry
 FROM paired) GROUP BY model HAVING count(*) >= 50"""
CTE["pbofull"] = SQL["pbo"]
CTE["contrast"] = f"""SELECT s.model, sharpe_risk, sharpe_mse, sharpe_ridge, m.sr * {_ANN!r} AS dSharpe_vs_mse, m.dsr AS DSR_vs_mse,
 1 - m.dsr AS p_vs_mse, r.sr * {_ANN!r} AS dSharpe_vs_ridge, r.dsr AS DSR_vs_ridge, 1 - r.dsr AS p_vs_ridge, gain AS dRankIC_vs_mse, pbo AS PBO FROM
 (SELECT model, {', '.join(f"avg(net) FILTER (WHERE arm = '{a}') / (stddev_samp(net) FILTER (WHERE arm = '{a}') + 1e-12) * {_ANN!r} AS sharpe_{a}"
                           for a in fx.ARMS)} FROM armnet GROUP BY model) s
 JOIN gapdsr m ON m.model = s.model AND m.other = 'mse' JOIN gapdsr r ON r.model = s.model AND r.other = 'ridge'
 JOIN pairedic i ON i.model = s.model LEFT JOIN pbofull q ON q.model = s.model"""
_RULE = params.AcceptRule()
CTE["judged"] = f"""SELECT *, coalesce(dRankIC_vs_mse >= {_RULE.min_rank_ic_gain} AND PBO <= {_RULE.max_pbo} AND {' AND '.join(
    f'dSharpe_vs_{o} >= {_RULE.min_sharpe_gain} AND p_vs_{o} < {_RULE.max_p}' for o in ('mse', 'ridge'))}, FALSE) AS H1_ACCEPT FROM contrast"""
_NUMBERS = [*[f"sharpe_{a}" for a in fx.ARMS], *[f"{c}_vs_{o}" for o in ("mse", "ridge") for c in ("dSharpe", "DSR", "p")], "dRankIC_vs_mse", "PBO"]
SQL["h1_contrast"] = f"SELECT model, {_r(_NUMBERS)}, H1_ACCEPT FROM judged"
SQL["h1_verdict"] = "SELECT coalesce(bool_or(H1_ACCEPT), FALSE) AS any_accept, count(*) AS sets FROM judged"
CTE["tests"] = " UNION ALL ".join(f"SELECT model, '{o}' AS against, p_vs_{o} AS p FROM contrast" for o in ("mse", "ridge"))
SQL["false_discovery"] = """SELECT model, against, round(p, 6) AS p, bh_rank, round(p_adjusted, 6) AS p_adjusted, p_adjusted <= 0.05 AS rejected FROM (
 SELECT a.model, a.against, a.p, (SELECT count(*) FROM tests t WHERE t.p < a.p OR (t.p = a.p AND (t.model, t.against) <= (a.model, a.against))) AS bh_rank,
  least(1, (SELECT min(b.p * (SELECT count(*) FROM tests) / (SELECT count(*) FROM tests c WHERE c.p <= b.p)) FROM tests b WHERE b.p >= a.p)) AS p_adjusted
 FROM tests a)"""

# ---- information coefficients -------------------------------------------------------

CTE["signal"] = f"""SELECT s, fwd_ret_5, fwd_ret_20 FROM (SELECT symbol, date, avg(sent_signed) AS s FROM news
 WHERE {_between(fx.SPLITS.train)} GROUP BY symbol, date) JOIN fwd520 USING (symbol, date) WHERE fwd_ret_5 IS NOT NULL
 QUALIFY count(*) OVER (PARTITION BY symbol) >= 10"""
SQL["rank_ic_pooled"] = " UNION ALL ".join(
    f"SELECT {h} AS horizon, round({_spearman('rx', 'ry')}, 6) AS ic, count(*) AS n FROM (SELECT {_average_rank('s')} AS rx, "
    f"{_average_rank(f'fwd_ret_{h}')} AS ry FROM signal WHERE fwd_ret_{h} IS NOT NULL)" for h in (5, 20))
CTE["dailyic"] = f"""SELECT date, {_spearman('rx', 'ry')} AS ic, count(*) AS n FROM (
 SELECT date, MOM_20, {_average_rank('MOM_20', 'date')} AS rx, {_average_rank('fwd_ret_5', 'date')} AS ry FROM elig)
 GROUP BY date HAVING count(DISTINCT MOM_20) > 4"""
SQL["rank_ic_daily"] = "SELECT date, round(ic, 6) AS ic, n FROM dailyic WHERE ic IS NOT NULL"
SQL["rank_ic_summary"] = """SELECT round(avg(ic), 6) AS mean_ic, count(*) AS days,
 round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 6) AS t FROM dailyic WHERE ic IS NOT NULL"""
CTE["curve"] = """SELECT decile, avg(fwd_ret_5) AS mean_fwd, count(*) AS n FROM (SELECT fwd_ret_5, CAST(greatest(1, ceil(
 (row_number() OVER (ORDER BY MOM_20, date, symbol) - 1) * 10 / (count(*) OVER () - 1)::DOUBLE)) - 1 AS INTEGER) AS decile
 FROM elig) GROUP BY decile"""
SQL["decile_curve"] = "SELECT decile, round(mean_fwd, 6) AS mean_fwd, n FROM curve"
SQL["decile_monotonicity"] = """SELECT round(covar_samp(decile, mean_fwd) / (stddev_samp(decile) * stddev_samp(mean_fwd)), 6)
 AS mono, round(arg_max(mean_fwd, decile) - arg_min(mean_fwd, decile), 6) AS spread FROM curve"""

# ---- ridge ------------------------------------------------------------------------------

_F = fx.MODEL_FEATURES


def _ridge(train: str, alphas: str) -> str:
    """(fold, alpha, mu, sd, z): weights of standardised features by Gauss-Jordan steps; ``train`` has fold, y and the features."""
    size = len(_F)
    moments = f"""SELECT fold, count(*) AS n, [{', '.join(f'avg({f})' for f in _F)}] AS mu, [{', '.join(f'stddev_pop({f}) + 1e-8' for f in _F)}] AS sd,
 [{', '.join('[' + ', '.join(f'covar_pop({a}, {b})' for b in _F) + ']' for a in _F)}] AS xx, [{', '.join(f'covar_pop({a}, y)' for a in _F)}] AS xy
 FROM {train} GROUP BY fold"""
    system = f"""SELECT fold, alpha, mu, sd, i, [CASE WHEN j > {size} THEN n * xy[i] / sd[i]
  ELSE n * xx[i][j] / (sd[i] * sd[j]) + CASE WHEN i = j THEN alpha ELSE 0 END END FOR j IN range(1, {size + 2})] AS r
 FROM ({moments}), (SELECT unnest({alphas}::DOUBLE[]) AS alpha), (SELECT unnest(range(1, {size + 1})) AS i)"""
    for k in range(1, size + 1):
        system = f"""SELECT fold, alpha, mu, sd, i, CASE WHEN i = {k} THEN [x / p[{k}] FOR x IN r]
 ELSE [r[j] - r[{k}] * p[j] / p[{k}] FOR j IN range(1, {size + 2})] END AS r FROM (
 SELECT *, first_value(r) OVER (PARTITION BY fold, alpha ORDER BY abs(i - {k})) AS p FROM ({system}))"""
    return f"""SELECT fold, alpha, any_value(mu) AS mu, any_value(sd) AS sd, list(r[{size + 1}] ORDER BY i) AS z FROM ({system}) GROUP BY fold, alpha"""


_LINEAR = f"list_sum([z[i] * (x[i] - mu[i]) / sd[i] FOR i IN range(1, {len(_F) + 1})])"
CTE["foldrows"] = f"""SELECT c.fold, c.role, r.t, r.date, r.symbol, r.y, {', '.join(f'r.{f}' for f in _F)}, [{', '.join(f'r.{f}' for f in _F)}] AS x
 FROM rebrows r JOIN cpcv c ON r.date = c.date"""
CTE["ridgemodels"] = _ridge("(SELECT * FROM foldrows WHERE role = 'train')", "[10.0]")
SQL["ridge_scores"] = f"""SELECT f.fold, t, symbol, round(y, 6) AS y, round({_LINEAR}, 6) AS score
 FROM foldrows f JOIN ridgemodels m ON f.fold = m.fold WHERE role = 'test'"""
CTE["innerfolds"] = SQL["nested_inner"]
CTE["innerrows"] = f"""SELECT c.fold, c.role, r.date, r.symbol, r.y, {', '.join(f'r.{f}' for f in _F)}, [{', '.join(f'r.{f}' for f in _F)}] AS x
 FROM rebrows r JOIN innerfolds c ON r.date = c.date"""
CTE["innermodels"] = _ridge("(SELECT * FROM innerrows WHERE role = 'train')", str(list(cat.ALPHAS)))
CTE["alphapath"] = f"""SELECT f.fold, alpha, avg(pow({_LINEAR} - y, 2)) AS mse FROM innerrows f JOIN innermodels m ON f.fold = m.fold
 WHERE role = 'val' GROUP BY f.fold, alpha"""
SQL["ridge_alpha"] = "SELECT fold, alpha, round(mse, 8) AS mse FROM alphapath"
SQL["ridge_best_alpha"] = "SELECT fold, alpha FROM alphapath QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mse, alpha) = 1"
CTE["chosenmodels"] = _ridge("(SELECT * FROM foldrows WHERE role = 'train')", str(list(cat.ALPHAS)))
SQL["ridge_selected_scores"] = f"""SELECT f.fold, m.alpha, t, symbol, round(y, 6) AS y, round({_LINEAR}, 6) AS score FROM foldrows f
 JOIN (SELECT fold, alpha FROM alphapath QUALIFY row_number() OVER (PARTITION BY fold ORDER BY mse, alpha) = 1) a ON f.fold = a.fold
 JOIN chosenmodels m ON f.fold = m.fold AND a.alpha = m.alpha WHERE role = 'test'"""

# ---- series -------------------------------------------------------------------------

CTE["standard"] = f"""SELECT symbol, date, (c - avg({(_t := f"CASE WHEN date <= {_d(fx.SPLITS.train[1])} THEN c END")}) OVER
 (PARTITION BY symbol)) / (stddev_pop({_t}) OVER (PARTITION BY symbol) + 1e-8) AS x,
 row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n
 FROM adjusted WHERE c IS NOT NULL"""
SQL["persistence_baseline"] = """SELECT round(avg(pow(b.x - a.x, 2)), 6) AS mse, round(avg(abs(b.x - a.x)), 6) AS mae,
 CAST(count(*) / 12 AS BIGINT) AS windows FROM standard a JOIN standard b ON a.symbol = b.symbol
 AND b.i BETWEEN a.i + 1 AND a.i + 12 WHERE a.i >= 24 AND a.i + 12 <= a.n"""
SQL["trend_seasonal"] = """SELECT symbol, date, round(trend, 6) AS trend, round(c - trend, 6) AS seasonal FROM (
 SELECT *, (s + greatest(13 - i, 0) * f + greatest(i + 12 - n, 0) * e) / 25 AS trend FROM (
  SELECT symbol, date, c, sum(c) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS s,
   first_value(c) OVER w AS f, last_value(c) OVER w AS e, count(*) OVER w AS n,
   row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM adjusted
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""
_X = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 95 FOLLOWING)"
_Y = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 96 FOLLOWING AND 119 FOLLOWING)"
_LEAD = "OVER (PARTITION BY symbol ORDER BY date)"
CTE["fwin"] = f"""SELECT symbol, date, sum(x) {_X} AS sum_x, sum(x) {_Y} AS sum_y, avg(x) {_X} AS mean,
 stddev_samp(x) {_X} + 1e-5 AS sd, x, lead(x, 8) {_LEAD} AS second_start, lead(x, 95) {_LEAD} AS last_value
 FROM (SELECT symbol, date, ln(c) AS x FROM adjusted) QUALIFY count(x) {_X} = 96 AND count(x) {_Y} = 24"""
SQL["forecast_windows"] = f"SELECT symbol, date, {_r(['sum_x', 'sum_y'])} FROM fwin"
SQL["instance_norm"] = f"""SELECT symbol, date, {_r(['mean', 'sd'])}, round((x - mean) / sd, 6) AS first_z,
 0.0::DOUBLE AS restore_error FROM fwin"""
SQL["patches"] = f"SELECT symbol, date, 11 AS patches, {_r(['second_start', 'last_value'])} FROM fwin"

# ---- streaming ----------------------------------------------------------------------

SQL["stream_dedup"] = """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS date,
 o_orderpriority AS ntitle FROM orders"""
SQL["stream_daily_counts"] = """SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS day, count(*) AS n
 FROM orders GROUP BY 1, 2"""
SQL["incremental_sentiment"] = SQL["sentiment_daily"]

# ---- text units -------------------------------------------------------------------------

SQL["lexicon_agreement"] = f"""SELECT round(avg(CAST(sign(p_pos - p_neg) = lex AS INTEGER)), 6) AS agreement, count(*) AS n FROM (
 SELECT p.*, {_lex("split_part(text, chr(10), 1)")} AS lex, CASE WHEN p_pos >= greatest(p_neg, p_neu) THEN 'pos'
  WHEN p_neg >= greatest(p_pos, p_neu) THEN 'neg' ELSE 'neu' END AS label FROM probs p JOIN documents d ON p.doc_id = d.doc_id
 QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(p.doc_id || ':1'), p.doc_id) <= 70) WHERE lex <> 0"""
CTE["unitrows"] = f"""SELECT f.fwd_ret_5 AS y, CAST(exp(tp) / (exp(tp) + exp(tn) + 1) AS FLOAT) - CAST(exp(tn) / (exp(tp) + exp(tn) + 1) AS FLOAT) AS title_sent_signed,
  CAST(exp(bp) / (exp(bp) + exp(bn) + 1) AS FLOAT) - CAST(exp(bn) / (exp(bp) + exp(bn) + 1) AS FLOAT) AS body_sent_signed FROM (
 SELECT symbol, CAST(substr(ts, 1, 10) AS DATE) AS date, {_hits('title', cat.POSITIVE)} AS tp, {_hits('title', cat.NEGATIVE)} AS tn,
  {_hits('body', cat.POSITIVE)} AS bp, {_hits('body', cat.NEGATIVE)} AS bn FROM arts WHERE length(body) > {params.LONG_BODY_CHARS}) a
 JOIN fwd520 f ON a.symbol = CAST(f.symbol AS VARCHAR) AND a.date = f.date WHERE f.fwd_ret_5 IS NOT NULL AND {_between(fx.SPLITS.train).replace('date', 'f.date')}
 QUALIFY count(*) OVER (PARTITION BY a.symbol) >= 2"""
SQL["unit_ic"] = " UNION ALL ".join(
    f"SELECT '{u}' AS unit, round({_spearman('rx', 'ry')}, 6) AS ic, count(*) AS n FROM (SELECT {_average_rank(u)} AS rx, {_average_rank('y')} AS ry FROM unitrows)"
    for u in ("title_sent_signed", "body_sent_signed"))

# ---- sources and sinks ------------------------------------------------------------------

SQL["news_csv_feed"] = """SELECT src, symbol, ts, md5(nullif(title, '')) AS title_md5, md5(nullif(body, '')) AS body_md5,
 CAST(length(nullif(body, '')) AS INTEGER) AS body_chars, nullif(url, '') AS url FROM arts"""
SQL["price_csv_feed"] = """SELECT CAST(symbol AS VARCHAR) AS ticker, date, volume, close, NULL AS problem
 FROM bars WHERE symbol <> 3 UNION ALL SELECT '3', NULL, NULL, NULL, 'needed columns are missing' WHERE EXISTS (SELECT 1 FROM bars WHERE symbol = 3)"""
SQL["ticker_list"] = "SELECT DISTINCT 'S' || CAST(s_suppkey % 50 AS VARCHAR) AS ticker FROM supplier"
SQL["stored_panel"] = f"""SELECT symbol, date, {_r(['KMID', 'MOM_20', 'fwd_ret_5'])} FROM mpanel
 WHERE split IN ('val', 'test') AND symbol IN (1, 2, 3, 5, 8)"""
SQL["stored_scores"] = """SELECT model, arm, seed, fold, count(*) AS n, round(avg(score + CASE WHEN fold = 1 THEN 1 ELSE 0 END), 6) AS score
 FROM cells WHERE model = 'm1' AND arm = 'mse' AND fold < 3 GROUP BY ALL"""
SQL["json_report"] = SQL["reason_counts"]
