"""The registered queries as plain SQL over the same tables, for result comparison.

Written for clarity, not for scale: distinct counts and ordered lists instead of the
library's pre-aggregated plans, so that an error in either shows up as a difference.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Fixed values, said again here on purpose: nothing is taken from the code under test.
METRICS = ("revenue", "num_customers", "first_time_customers", "num_purchases", "tracks_sold")
CORE_KPIS = {
    "purchases_num": "number", "cust_num": "number", "cust_num_new": "number", "cust_per_new": "percent",
    "tracks_sold_num": "number", "tracks_per_purchase": "float", "revenue_total": "dollar",
    "revenue_per_month": "dollar", "revenue_per_cust": "dollar", "revenue_per_purchase": "dollar",
    "genre_num": "number", "artist_num": "number", "country_num": "number",
}
RETENTION_KPIS = {
    "num_cust": "number", "num_new": "number", "pct_new": "percent", "ret_n_any": "number",
    "ret_rate_any": "percent", "ret_n_return": "number", "ret_rate_return": "percent",
    "ret_n_conv": "number", "ret_rate_conv": "percent", "ret_n_window": "number",
    "ret_rate_window": "percent", "avg_life_mo_tot": "float", "avg_life_mo_win": "float",
    "med_gap_life": "float", "med_gap_window": "float", "med_gap_winback": "float",
    "med_gap_ret": "float", "avg_gap_life": "float", "avg_gap_window": "float", "avg_gap_bound": "float",
}
RETENTION_LINES = {
    "cust_line": ("num_cust", "pct_new"), "ret_any_line": ("ret_n_any", "ret_rate_any"),
    "ret_return_line": ("ret_n_return", "ret_rate_return"), "ret_conv_line": ("ret_n_conv", "ret_rate_conv"),
    "ret_window_line": ("ret_n_window", "ret_rate_window"),
}
TOP_N_DISPLAY = {
    "num_customers": "number", "num_purchases": "number", "tracks_sold": "number", "revenue": "dollar",
    "first_time_customers": "number", "avg_revenue_per_cust": "dollar", "avg_revenue_per_purchase": "dollar",
    "avg_tracks_per_purchase": "float", "revenue_share": "percent", "unique_tracks_sold": "number",
    "catalog_size": "number", "pct_catalog_sold": "percent",
}
CARDS = {
    "revenue": {"revenue_total": "Total Revenue"},
    "purchases": {
        "purchases_num": "Total Orders", "revenue_per_purchase": "Avg Revenue per Order",
        "tracks_sold_num": "Total Tracks Sold", "tracks_per_purchase": "Avg Tracks per Order",
    },
    "customers": {
        "cust_num": "Total Customers", "cust_per_new": "% New Customers",
        "revenue_per_cust": "Avg Revenue per Customer", "top_cohort_line_3": "Top 3-Month Retention",
        "top_cohort_line_6": "Top 6-Month Retention",
    },
}
RANKED = {"topn_country": ("Top Markets", 3), "topn_genre": ("Top Genre", 1), "topn_artist": ("Top Artist", 1)}
SCOPES = ("All Data", "Filtered View")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
INDICATORS = "".join(chr(0x1F1E6 + k) for k in range(26))
MEANS = ("avg_gap_life", "avg_gap_window", "avg_gap_bound")
DIGITS = 6


@dataclass(frozen=True)
class Span:
    """SQL dates that bound a range, and how they widen to whole months."""

    start: str
    end: str

    def month_aligned(self) -> Span:
        return Span(f"date_trunc('month', {self.start})::DATE", f"last_day({self.end})")

    @property
    def months(self) -> str:
        return f"(datediff('month', {self.start}, {self.end}) + 1)"


@dataclass(frozen=True)
class Choice:
    genres: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    artists: tuple[str, ...] = ()


@dataclass(frozen=True)
class Variant:
    suffix: str
    filter: Choice
    rng: Span


def _days(first: date, last: date) -> Span:
    return Span(f"DATE '{first}'", f"DATE '{last}'")


EVERY_DAY = Span("(SELECT min(dt) FROM inv)", "(SELECT max(dt) FROM inv)")
PLAIN = Variant("", Choice(), EVERY_DAY)
WINDOWED = Variant("_window", Choice(), _days(date(1997, 3, 10), date(1998, 11, 20)))
FILTERED = Variant("_filtered", Choice(("ECONOMY",), ("NATION_2", "NATION_3")), _days(date(1997, 1, 1), date(1998, 12, 31)))
EMPTY = Variant("_empty", Choice(("NO SUCH GENRE",)), EVERY_DAY)

# Results by the variants they have: plain and filtered, or a window too.
TWO = (
    "filtered_invoices", "group_kpis_artist", "topn_genre", "topn_artist", "topn_country", "catalog_sales_genre",
    "catalog_sales_artist", "geo_yearly", "geo_aggregate", "geo_metric_bounds", "group_yearly_genre",
    "top_groups_yearly", "top_groups_yearly_genre", "top_groups_yearly_customers", "cohort_grid", "cohort_matrix",
    "cohort_fingerprint", "retention_decay_percent", "filter_fingerprint", "bundle_fingerprint",
)
THREE = (
    "invoice_details", "core_kpis", "group_kpis_genre", "group_kpis_country", "monthly_summary", "geo_frames",
    "group_yearly_artist", "cohort_retention", "retention_decay", "top_cohorts", "customer_bounds",
    "customer_metrics", "retention_kpis", "retention_kpis_strict", "kpi_bundle_long",
)

# The canonical views.
MODEL = """
inv AS (
  SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, o_orderdate AS invoice_date,
         CAST(o_orderdate AS DATE) AS dt, n_name AS country,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
              LEFT JOIN nation ON n_nationkey = c_nationkey),
ln AS (
  SELECT l_orderkey AS invoice_id, l_partkey AS track_id, l_quantity AS quantity,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount
  FROM lineitem),
it AS (SELECT p_partkey AS track_id, p_type AS genre, p_brand AS artist FROM part)"""


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})" if values else "TRUE"


def _between(rng: Span, column: str = "dt") -> str:
    return f"{column} BETWEEN {rng.start} AND {rng.end}"


def staged(flt: Choice, p: str = "") -> str:
    """``{p}st``: staged invoices; ``{p}sl``: their lines."""
    return f"""
{p}st AS (
  SELECT inv.* FROM inv WHERE {_in('country', flt.countries)} AND invoice_id IN (
    SELECT ln.invoice_id FROM ln, it WHERE ln.track_id = it.track_id
    AND genre IS NOT NULL AND artist IS NOT NULL
    AND {_in('genre', flt.genres)} AND {_in('artist', flt.artists)})),
{p}sl AS (
  SELECT invoice_id, customer_id, dt, country, track_id, quantity, amount, genre, artist
  FROM {p}st JOIN ln USING (invoice_id) LEFT JOIN it USING (track_id))"""


def core(rng: Span, p: str = "") -> str:
    a = rng.month_aligned()
    return f"""
{p}core0 AS (
  SELECT count(DISTINCT invoice_id) AS purchases_num, count(DISTINCT customer_id) AS cust_num,
         count(DISTINCT customer_id) FILTER (customer_id IN (
           SELECT customer_id FROM inv GROUP BY 1 HAVING {_between(a, 'min(dt)')})) AS cust_num_new,
         CAST(sum(quantity) AS DOUBLE) AS tracks_sold_num,
         CAST(round(sum(amount), 2) AS DOUBLE) AS revenue_total,
         count(DISTINCT genre) AS genre_num, count(DISTINCT artist) AS artist_num,
         count(DISTINCT country) AS country_num
  FROM {p}sl WHERE {_between(a)}),
{p}core AS (
  SELECT *, CAST(cust_num_new AS DOUBLE) / cust_num AS cust_per_new,
         CAST(tracks_sold_num AS DOUBLE) / purchases_num AS tracks_per_purchase,
         revenue_total / {a.months} AS revenue_per_month, revenue_total / cust_num AS revenue_per_cust,
         revenue_total / purchases_num AS revenue_per_purchase
  FROM {p}core0 WHERE purchases_num > 0)"""


def group_base(rng: Span, by: str, p: str = "") -> str:
    """``{p}g_<by>``: KPIs per group; ``{p}cs_<by>``: catalog coverage."""
    a = rng.month_aligned()
    rows = f"SELECT *, {by} AS group_val FROM {p}sl WHERE {_between(a)}"
    if by != "country":
        rows += f" AND {by} IS NOT NULL"
    text = f"""
{p}g_{by} AS (
  SELECT group_val, count(DISTINCT customer_id) AS num_customers,
         count(DISTINCT invoice_id) AS num_purchases, CAST(sum(quantity) AS DOUBLE) AS tracks_sold,
         CAST(sum(amount) AS DOUBLE) AS revenue,
         count(DISTINCT customer_id) FILTER (dt = day_one) AS first_time_customers
  FROM (SELECT *, min(dt) OVER (PARTITION BY customer_id) AS day_one FROM ({rows}))
  GROUP BY group_val)"""
    if by != "country":
        text += f""",
{p}cs_{by} AS (
  SELECT group_val, unique_tracks_sold, catalog_size,
         CAST(unique_tracks_sold AS DOUBLE) / nullif(catalog_size, 0) AS pct_catalog_sold
  FROM (SELECT group_val, count(DISTINCT track_id) AS unique_tracks_sold FROM ({rows}) GROUP BY 1)
  LEFT JOIN (SELECT {by} AS group_val, count(DISTINCT track_id) AS catalog_size FROM it GROUP BY 1)
    USING (group_val))"""
    return text


def top(by: str, n: int, p: str = "") -> str:
    """``{p}t_<by>``: ranked rows of all metrics with derived columns."""
    ranked = " UNION ALL ".join(
        f"(SELECT '{m}' AS metric, row_number() OVER (ORDER BY {m} DESC, group_val) AS rank, * "
        f"FROM {p}g_{by} ORDER BY rank LIMIT {n})"
        for m in METRICS
    )
    coverage = "" if by == "country" else f"LEFT JOIN {p}cs_{by} USING (group_val)"
    return f"""
{p}t_{by} AS (
  SELECT *, revenue / num_customers AS avg_revenue_per_cust,
         revenue / num_purchases AS avg_revenue_per_purchase,
         CAST(tracks_sold AS DOUBLE) / num_purchases AS avg_tracks_per_purchase,
         revenue / (SELECT revenue_total FROM {p}core) AS revenue_share
  FROM (SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({ranked})) {coverage})"""


def monthly(rng: Span) -> str:
    return f"""
SELECT strftime(dt, '%Y-%m') AS month, count(DISTINCT invoice_id) AS num_purchases,
       count(DISTINCT customer_id) AS num_customers, CAST(sum(quantity) AS DOUBLE) AS tracks_sold,
       CAST(sum(amount) AS DOUBLE) AS revenue,
       count(DISTINCT customer_id) FILTER (date_trunc('month', dt) = date_trunc('month', day_one))
         AS first_time_customers,
       CAST(sum(amount) AS DOUBLE) / count(DISTINCT customer_id) AS rev_per_cust
FROM sl JOIN (SELECT customer_id, min(dt) AS day_one FROM st GROUP BY 1) USING (customer_id)
WHERE {_between(rng)} GROUP BY 1"""


def geo(rng: Span) -> str:
    """``geo_y``, ``geo_a`` and their union ``geo_f``."""
    s, e = rng.start, rng.end
    figures = """count(DISTINCT customer_id) AS num_customers, count(DISTINCT invoice_id) AS num_purchases,
         CAST(sum(quantity) AS DOUBLE) AS tracks_sold, CAST(sum(amount) AS DOUBLE) AS revenue,
         count(DISTINCT customer_id) FILTER (dt = day_one) AS first_time_customers"""
    return f"""
gb AS (SELECT *, min(dt) OVER (PARTITION BY customer_id) AS day_one FROM sl WHERE {_between(rng)}),
geo_y AS (
  SELECT strftime(dt, '%Y') AS year,
         CAST(datediff('month', greatest({s}, min(date_trunc('year', dt))),
           least({e}, min(date_trunc('year', dt)) + INTERVAL 11 MONTH)) + 1 AS INTEGER) AS num_months,
         country, {figures}
  FROM gb GROUP BY strftime(dt, '%Y'), country),
geo_a AS (
  SELECT 'All' AS year, CAST(datesub('month', {s}, {e}) + 1 AS INTEGER) AS num_months,
         country, {figures}
  FROM gb GROUP BY country),
geo_f AS (FROM geo_y UNION ALL FROM geo_a)"""


def yearly(rng: Span, by: str) -> str:
    return f"""
yb AS (SELECT *, strftime(dt, '%Y') AS year, {by} AS g,
              min(year(dt)) OVER (PARTITION BY customer_id) AS cy, min(year(dt)) OVER (PARTITION BY track_id) AS ty
       FROM sl WHERE {_between(rng)} AND {by} IS NOT NULL),
yr AS (
  SELECT year, g AS {by}, count(DISTINCT customer_id) AS num_customers,
         count(DISTINCT invoice_id) AS num_purchases, count(DISTINCT country) AS num_countries,
         CAST(sum(quantity) AS DOUBLE) AS tracks_sold, CAST(sum(amount) AS DOUBLE) AS revenue,
         count(DISTINCT customer_id) FILTER (year(dt) = cy) AS first_time_customers,
         count(DISTINCT track_id) AS unique_tracks_sold,
         count(DISTINCT track_id) FILTER (year(dt) = ty) AS first_tracks_sold,
         (SELECT count(DISTINCT track_id) FROM it WHERE it.{by} = yb.g) AS catalog_size
  FROM yb GROUP BY year, g)"""


def cohort(rng: Span, p: str = "", reach: str | None = None) -> str:
    """``{p}act``: staged activity with offsets; ``{p}co``: cohort retention."""
    limit = reach or f"(SELECT datediff('month', min(dt), max(dt)) FROM {p}st)"
    return f"""
{p}born AS (SELECT customer_id, CAST(date_trunc('month', min(dt)) AS DATE) AS cohort_month FROM inv GROUP BY 1),
{p}act AS (
  SELECT customer_id, cohort_month, CAST(datediff('month', cohort_month, dt) AS INTEGER) AS month_offset
  FROM {p}st JOIN {p}born USING (customer_id)
  WHERE {_between(rng)} AND datediff('month', cohort_month, dt) BETWEEN 0 AND {limit}),
{p}co AS (
  SELECT cohort_month, month_offset, count(DISTINCT customer_id) AS num_active_customers, cohort_size,
         round(CAST(count(DISTINCT customer_id) AS DOUBLE) / cohort_size, 4) AS retention_pct
  FROM {p}act JOIN (SELECT cohort_month, count(*) AS cohort_size FROM {p}born GROUP BY 1) USING (cohort_month)
  WHERE month_offset > 0 GROUP BY cohort_month, month_offset, cohort_size)"""


def decay(scale: int = 1) -> str:
    return f"""
SELECT month_offset, count(DISTINCT customer_id) AS num_retained,
       (SELECT count(DISTINCT customer_id) FROM act) AS num_customers,
       CAST(count(DISTINCT customer_id) AS DOUBLE) / (SELECT count(DISTINCT customer_id) FROM act) * {scale}
         AS retention_rate
FROM act WHERE month_offset > 0 GROUP BY month_offset"""


def best_cohorts(p: str = "") -> str:
    return f"""
{p}best AS (
  SELECT o AS month_offset, pick.cohort_month, pick.retention_pct
  FROM (SELECT CAST(unnest([3, 6, 9]) AS INTEGER) AS o) LEFT JOIN (
    SELECT month_offset, first(struct_pack(cohort_month := cohort_month, retention_pct := retention_pct)
             ORDER BY retention_pct DESC, cohort_month) AS pick
    FROM {p}co GROUP BY 1) ON o = month_offset)"""


def grid() -> str:
    return """
grid AS (
  SELECT m.cohort_month, o.month_offset, strftime(m.cohort_month, '%b %Y') AS cohort_label,
         num_active_customers, cohort_size, retention_pct * 100 AS retention_pct
  FROM (SELECT CAST(unnest(generate_series((SELECT min(cohort_month) FROM co),
          (SELECT max(cohort_month) FROM co), INTERVAL 1 MONTH)) AS DATE) AS cohort_month) m
  JOIN (SELECT CAST(unnest(generate_series((SELECT min(month_offset) FROM co),
          (SELECT max(month_offset) FROM co))) AS INTEGER) AS month_offset) o ON TRUE
  LEFT JOIN co ON co.cohort_month = m.cohort_month AND co.month_offset = o.month_offset)"""


def bounds(rng: Span, p: str = "", strict: bool = False) -> str:
    """``{p}bd``: boundaries from ordered lists; ``{p}cm``: metrics per customer."""
    inside, later = _between(rng), "IS NOT NULL" if strict else "IS NULL"
    s, e = rng.start, rng.end
    months = lambda a, b: f"CAST(datediff('month', {a}, {b}) AS INTEGER)"
    days = lambda a, b: f"CAST({b} - {a} AS INTEGER)"
    per = lambda a, b, n: f"CAST({b} - {a} AS DOUBLE) / nullif({n}, 0)"
    return f"""
{p}bd AS (
  SELECT customer_id, d[1] AS first_date, d[2] AS second_date, d[-1] AS last_date,
         len(d) AS total_purchases, last_before_window, first_after_window,
         len(w) AS num_in_window, w[1] AS first_in_window, w[2] AS second_in_window, w[-1] AS last_in_window
  FROM (SELECT customer_id, list(dt ORDER BY dt, invoice_id) AS d,
               list(dt ORDER BY dt, invoice_id) FILTER ({inside}) AS w,
               max(dt) FILTER (dt < {s}) AS last_before_window, min(dt) FILTER (dt > {e}) AS first_after_window
        FROM {p}st GROUP BY customer_id)
  WHERE len(w) > 0),
{p}cm AS (
  SELECT *, last_before_window IS NULL AS cust_new, total_purchases > 1 AS repeat_any,
         last_before_window IS NOT NULL AS repeat_ret,
         last_before_window IS NULL AND (num_in_window > 1 OR first_after_window {later}) AS repeat_conv,
         num_in_window > 1 AS repeat_window,
         CASE WHEN total_purchases > 1 THEN {months('first_date', 'last_date')} END AS lifespan_mo_total,
         CASE WHEN last_before_window IS NULL AND first_after_window IS NULL AND num_in_window = 1 THEN NULL
              ELSE {months(f'CASE WHEN last_before_window IS NULL THEN first_in_window ELSE {s} END',
                           f'CASE WHEN first_after_window IS NULL THEN last_in_window ELSE {e} END')}
         END AS lifespan_mo_window,
         {days('first_date', 'second_date')} AS gap_life,
         {days('first_in_window', 'second_in_window')} AS gap_window,
         {days('last_before_window', 'first_in_window')} AS gap_winback,
         {days('last_in_window', 'first_after_window')} AS gap_retention,
         {per('first_date', 'last_date', 'total_purchases - 1')} AS avg_gap_life,
         {per('first_in_window', 'last_in_window', 'num_in_window - 1')} AS avg_gap_window,
         {per('coalesce(last_before_window, first_in_window)', 'coalesce(first_after_window, last_in_window)',
              'num_in_window - 1 + CAST(last_before_window IS NOT NULL AS INTEGER)'
              ' + CAST(first_after_window IS NOT NULL AS INTEGER)')} AS avg_gap_bound
  FROM {p}bd)"""


def retention(p: str = "") -> str:
    return f"""
{p}rt AS (
  SELECT *, CAST(num_new AS DOUBLE) / num_cust AS pct_new, CAST(ret_n_any AS DOUBLE) / num_cust AS ret_rate_any,
         CAST(ret_n_return AS DOUBLE) / nullif(num_cust - num_new, 0) AS ret_rate_return,
         CAST(ret_n_conv AS DOUBLE) / nullif(num_new, 0) AS ret_rate_conv,
         CAST(ret_n_window AS DOUBLE) / num_cust AS ret_rate_window
  FROM (SELECT count(*) AS num_cust, count(*) FILTER (cust_new) AS num_new,
               count(*) FILTER (repeat_any) AS ret_n_any, count(*) FILTER (repeat_ret) AS ret_n_return,
               count(*) FILTER (repeat_conv) AS ret_n_conv, count(*) FILTER (repeat_window) AS ret_n_window,
               avg(lifespan_mo_total) AS avg_life_mo_tot, avg(lifespan_mo_window) AS avg_life_mo_win,
               CAST(median(gap_life) AS DOUBLE) AS med_gap_life,
               CAST(median(gap_window) AS DOUBLE) AS med_gap_window,
               CAST(median(gap_winback) AS DOUBLE) AS med_gap_winback,
               CAST(median(gap_retention) AS DOUBLE) AS med_gap_ret,
               avg(avg_gap_life) AS avg_gap_life, avg(avg_gap_window) AS avg_gap_window,
               avg(avg_gap_bound) AS avg_gap_bound
        FROM {p}cm)
  WHERE num_cust > 0)"""


def text(column: str, kind: str) -> str:
    """Display text of a figure."""
    value = f"CAST({column} AS DOUBLE)"
    shown = {
        "dollar": f"'$' || format('{{:,.2f}}', {value})",
        "percent": f"format('{{:.2f}}', {value} * 100) || '%'",
        "float": f"format('{{:,.2f}}', {value})",
        "number": f"CASE WHEN {value} = floor({value}) THEN format('{{:,}}', CAST({value} AS BIGINT)) "
        f"ELSE format('{{:,.2f}}', {value}) END",
    }[kind]
    return f"CASE WHEN {column} IS NULL THEN 'NA' ELSE {shown} END"


def bundle_rows(p: str = "") -> str:
    """``{p}bu``: all scalar KPIs in long form."""

    def row(section: str, kpi: str, value: str, fmt: str, source: str) -> str:
        return (
            f"SELECT '{section}' AS section, '{kpi}' AS kpi, CAST({value} AS DOUBLE) AS value, "
            f"{fmt} AS value_fmt FROM {source}"
        )

    kept = f"(SELECT * FROM {p}rt WHERE EXISTS (FROM {p}core))"
    rows = [row("metadata_kpis", k, k, text(k, kind), f"{p}core") for k, kind in CORE_KPIS.items()]
    rows += [
        row(f"topn_{by}", "num_vals", f"{by}_num", text(f"{by}_num", "number"), f"{p}core")
        for by in ("genre", "artist", "country")
    ]
    rows += [row("retention_kpis", k, k, text(k, kind), kept) for k, kind in RETENTION_KPIS.items()]
    rows += [
        row(
            "retention_kpis",
            name,
            "NULL",
            f"{text(n, RETENTION_KPIS[n])} || ' (' || {text(r, RETENTION_KPIS[r])} || ')'",
            kept,
        )
        for name, (n, r) in RETENTION_LINES.items()
    ]
    month = "coalesce(strftime(cohort_month, '%b %Y'), 'NA')"
    rate = text("retention_pct", "percent")
    for o in (3, 6, 9):
        source = f"{p}best WHERE month_offset = {o} AND EXISTS (FROM {kept})"
        rows.append(row("retention_kpis", f"top_cohort_month_{o}", "NULL", month, source))
        rows.append(row("retention_kpis", f"top_cohort_retention_{o}", "retention_pct", rate, source))
        rows.append(
            row("retention_kpis", f"top_cohort_line_{o}", "NULL", f"{month} || ' (' || {rate} || ')'", source)
        )
    return f"\n{p}bu AS ({' UNION ALL '.join(rows)})"


CODES = """
codes AS (
  SELECT n_name AS country, chr(65 + n_regionkey) || chr(65 + n_nationkey) AS iso2,
         'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso_alpha
  FROM nation)"""


def ranking_rows(p: str = "") -> str:
    """``{p}ta``: all rankings with display columns."""
    parts = []
    for by in ("genre", "artist", "country"):
        shown = [
            f"{text(c, kind)} AS {c}_fmt"
            for c, kind in TOP_N_DISPLAY.items()
            if by != "country" or c not in ("unique_tracks_sold", "catalog_size", "pct_catalog_sold")
        ]
        name = (
            f"(SELECT translate(iso2, '{LETTERS}', '{INDICATORS}') || ' ' || country FROM codes "
            "WHERE country = group_val)"
            if by == "country"
            else "group_val"
        )
        parts.append(
            f"SELECT 'topn_{by}' AS section, *, {', '.join(shown)}, {name} AS group_val_fmt FROM {p}t_{by}"
        )
    return f"\n{p}ta AS ({' UNION ALL BY NAME '.join(parts)})"


def _with(*parts: str) -> str:
    return "WITH " + ",".join([MODEL, *parts])


def _replace(table: str, swaps: dict[str, str]) -> str:
    swaps = ", ".join(f"{text.replace('{}', c)} AS {c}" for c, text in swaps.items())
    return f" SELECT * REPLACE ({swaps}) FROM {table}"


def _fingerprint(texts: str) -> str:
    part = lambda start: (
        f"CAST(coalesce(sum(CAST(CAST('0x' || substr(md5(t), {start}, 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR)"
    )
    return (
        f" SELECT count(*) AS num_keys, md5(CAST(count(*) AS VARCHAR) || '-' || {part(1)} || '-' || {part(16)})"
        f" AS fingerprint FROM ({texts})"
    )


def _everything(v: Variant, p: str = "", n: int = 5) -> list[str]:
    parts = [staged(v.filter, p), core(v.rng, p), cohort(v.rng, p), best_cohorts(p), bounds(v.rng, p)]
    parts += [retention(p), bundle_rows(p)]
    for by in ("genre", "artist", "country"):
        parts += [group_base(v.rng, by, p), top(by, n, p)]
    return parts


def _scoped(name: str, v: Variant) -> str:
    st, rng = staged(v.filter), v.rng
    co = cohort(rng)
    if name == "filtered_invoices":
        return _with(st) + " SELECT customer_id, dt, invoice_id FROM st"
    if name == "invoice_details":
        return _with(st) + (
            " SELECT invoice_id, customer_id, invoice_date, country, CAST(total AS DOUBLE) AS total "
            f"FROM st WHERE {_between(rng.month_aligned())}"
        )
    if name == "core_kpis":
        return _with(st, core(rng)) + " FROM core"
    if name.startswith("group_kpis_"):
        by = name.rsplit("_", 1)[1]
        return _with(st, group_base(rng, by)) + f" FROM g_{by}"
    if name.startswith("catalog_sales_"):
        by = name.rsplit("_", 1)[1]
        return _with(st, group_base(rng, by)) + f" FROM cs_{by}"
    if name.startswith("topn_"):
        by = name.rsplit("_", 1)[1]
        return _with(st, core(rng), group_base(rng, by), top(by, 5)) + f" FROM t_{by}"
    if name == "monthly_summary":
        return _with(st) + monthly(rng)
    if name == "geo_aggregate":
        return _with(st, geo(rng)) + (
            " SELECT *, revenue / num_customers AS rev_per_cust FROM geo_a"
        )
    if name == "geo_metric_bounds":
        rows = [
            f"SELECT '{m}' AS metric, CAST(min({m}) AS DOUBLE) AS min_value, "
            f"CAST(max({m}) AS DOUBLE) AS max_value FROM geo_f"
            for m in METRICS
        ]
        return _with(st, geo(rng)) + " " + " UNION ALL ".join(rows)
    if name in ("geo_yearly", "geo_frames"):
        return _with(st, geo(rng)) + (" FROM geo_y" if name == "geo_yearly" else " FROM geo_f")
    if name.startswith("group_yearly_"):
        by = name.rsplit("_", 1)[1]
        return _with(st, yearly(rng, by)) + (
            " SELECT *, revenue / catalog_size AS revenue_per_track, "
            "CAST(unique_tracks_sold AS DOUBLE) / catalog_size AS pct_catalog_sold FROM yr"
        )
    if name.startswith("top_groups_yearly"):
        by = "genre" if name.endswith("_genre") else "artist"
        metric, n = ("num_customers", 7) if name.endswith("_customers") else ("revenue", 20)
        return _with(st, yearly(rng, by)) + (
            f" FROM yr WHERE {by} IN (SELECT {by} FROM yr GROUP BY 1 ORDER BY sum({metric}) DESC, {by} LIMIT {n})"
        )
    if name == "cohort_retention":
        return _with(st, co) + " FROM co"
    if name == "cohort_grid":
        return _with(st, co, grid()) + " FROM grid"
    if name == "cohort_matrix":
        shown = "coalesce(format('{:,.2f}', retention_pct), '-')"
        return _with(st, co, grid()) + (
            " SELECT cohort_month, cohort_label, string_agg(CAST(month_offset AS VARCHAR), ' ' ORDER BY month_offset)"
            f" AS offsets, string_agg({shown}, ' ' ORDER BY month_offset) AS retention_pct FROM grid GROUP BY 1, 2"
        )
    if name == "cohort_fingerprint":
        return _with(st, co) + _fingerprint(
            "SELECT concat_ws('|', CAST(cohort_month AS VARCHAR), CAST(cohort_size AS VARCHAR), "
            "CAST(month_offset AS VARCHAR), CAST(num_active_customers AS VARCHAR), "
            "CAST(CAST(retention_pct AS DECIMAL(38,6)) AS VARCHAR)) AS t FROM co"
        )
    if name == "top_cohorts":
        return _with(st, co, best_cohorts()) + " FROM best"
    if name == "retention_decay":
        return _with(st, co) + decay()
    if name == "retention_decay_percent":
        return _with(st, co) + decay(100)
    if name == "customer_bounds":
        return _with(st, bounds(rng)) + " FROM bd"
    if name == "customer_metrics":
        return _with(st, bounds(rng)) + " FROM cm"
    if name in ("retention_kpis", "retention_kpis_strict"):
        return _with(st, bounds(rng, strict=name.endswith("_strict")), retention()) + _replace("rt", dict.fromkeys(MEANS, f"round({{}}, {DIGITS})"))
    if name == "filter_fingerprint":
        return _with(st) + _fingerprint("SELECT CAST(invoice_id AS VARCHAR) AS t FROM st")
    if name in ("kpi_bundle_long", "bundle_fingerprint"):
        parts = [st, core(rng), co, best_cohorts(), bounds(rng), retention(), bundle_rows()]
    if name == "bundle_fingerprint":
        return _with(*parts) + _fingerprint(
            "SELECT concat_ws('|', coalesce(kpi, '~'), coalesce(section, '~'), coalesce(value_fmt, '~')) AS t FROM bu"
        )
    if name == "kpi_bundle_long":
        return _with(*parts) + _replace(
            "bu", {"value": f"CASE WHEN {_in('kpi', MEANS)} THEN round({{}}, {DIGITS}) ELSE {{}} END"}
        )
    raise KeyError(name)


def _unscoped() -> dict[str, str]:
    summary = {
        "Date Range": "strftime(min(dt), '%b %Y') || ' – ' || strftime(max(dt), '%b %Y') FROM inv",
        "Number of Purchases": "format('{:,}', count(DISTINCT invoice_id)) FROM inv",
        "Number of Customers": "format('{:,}', count(DISTINCT customer_id)) FROM inv",
        "Tracks Sold": "format('{:,}', count(*)) FROM ln",
        "Total Revenue (USD$)": "'$' || format('{:,.2f}', CAST(sum(total) AS DOUBLE)) FROM inv",
        "Number of Genres": "format('{:,}', count(DISTINCT genre)) FROM it",
        "Number of Artists": "format('{:,}', count(DISTINCT artist)) FROM it",
        "Number of Countries": "format('{:,}', count(DISTINCT country)) FROM inv",
    }
    labelled = " UNION ALL ".join(f"SELECT '{k}' AS \"Metric\", {q}" for k, q in summary.items())
    labelled = labelled.replace(" FROM inv", ' AS "Value" FROM inv', 1)
    return {
        "genre_catalog": _with() + " SELECT genre, count(DISTINCT track_id) AS num_tracks FROM it GROUP BY 1",
        "artist_catalog": _with() + " SELECT artist, count(DISTINCT track_id) AS num_tracks FROM it GROUP BY 1",
        "static_summary": _with() + " " + labelled,
        "filter_values": _with()
        + " SELECT DISTINCT 'country' AS kind, country AS value FROM inv UNION ALL "
        "SELECT DISTINCT 'genre', genre FROM it UNION ALL SELECT DISTINCT 'artist', artist FROM it",
        "date_bounds": _with() + " SELECT min(dt) AS min_date, max(dt) AS max_date FROM inv",
    }


def _insights() -> str:
    parts, rows = [CODES], []
    for v, scope, p in ((PLAIN, SCOPES[0], "a_"), (FILTERED, SCOPES[1], "f_")):
        parts += [*_everything(v, p, 3), ranking_rows(p)]
        for card, kpis in CARDS.items():
            rows += [
                f"SELECT '{scope}' AS scope, '{card}' AS card, '{label}' AS label, 1 AS rank, "
                f"CAST(NULL AS VARCHAR) AS name, value_fmt FROM {p}bu WHERE kpi = '{kpi}'"
                for kpi, label in kpis.items()
            ]
        rows += [
            f"SELECT '{scope}', 'revenue', '{label}', rank, group_val_fmt, revenue_fmt FROM {p}ta "
            f"WHERE section = '{section}' AND metric = 'revenue' AND rank <= {places}"
            for section, (label, places) in RANKED.items()
        ]
    return _with(*parts) + " " + " UNION ALL ".join(rows)


def _code_labels() -> str:
    name = f"(SELECT translate(iso2, '{LETTERS}', '{INDICATORS}') || ' ' || iso_alpha FROM codes WHERE country = group_val)"
    parts = [CODES, staged(PLAIN.filter), core(PLAIN.rng), group_base(PLAIN.rng, "country"), top("country", 5)]
    return _with(*parts) + f" SELECT metric, rank, group_val, {name} AS group_val_fmt FROM t_country"


def _tree_digest(v: Variant) -> str:
    levels = "t0 AS (SELECT invoice_id >> 12 AS place, sha256(string_agg(CAST(invoice_id AS VARCHAR), ',' ORDER BY invoice_id)) AS digest, count(*) AS n FROM (SELECT DISTINCT invoice_id FROM st) GROUP BY 1)"
    for k in range(7):
        levels += f", t{k + 1} AS (SELECT place >> 8 AS place, sha256(string_agg(place || ':' || digest, ',' ORDER BY t{k}.place)) AS digest, sum(n) AS n FROM t{k} GROUP BY place >> 8)"
    top = "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS num_ids, sha256(coalesce(string_agg(place || ':' || digest, ',' ORDER BY place), '')) AS digest FROM t7"
    return _with(staged(v.filter), levels) + " " + top


def build_oracle() -> dict[str, str]:
    found = {name + v.suffix: _scoped(name, v) for name in TWO + THREE for v in (PLAIN, FILTERED)}
    found |= {name + WINDOWED.suffix: _scoped(name, WINDOWED) for name in THREE}
    empty = ("core_kpis", "group_kpis_genre", "monthly_summary", "geo_frames", "retention_kpis")
    found |= {name + EMPTY.suffix: _scoped(name, EMPTY) for name in empty}
    found.update(_unscoped())
    for v in (PLAIN, FILTERED):
        found["topn_all" + v.suffix] = _with(CODES, *_everything(v), ranking_rows()) + " FROM ta"
        found["geo_iso" + v.suffix] = (
            _with(CODES, staged(v.filter), geo(v.rng))
            + " SELECT geo_f.*, iso_alpha FROM geo_f JOIN codes USING (country)"
        )
    found["insights_compare"] = _insights()
    found["country_codes_topn"] = _code_labels()
    # How tables lie and whether a set was staged before changes no result.
    for name in ("core_kpis", "group_kpis_genre", "group_yearly_artist", "monthly_summary", "catalog_sales_artist", "customer_bounds"):
        for v in (PLAIN, FILTERED):
            found |= {f"{name}{v.suffix}_{how}": found[name + v.suffix] for how in ("colocated", "found_again")}
    for v in (PLAIN, WINDOWED, FILTERED):
        for by in ("genre", "artist", "country"):
            tracks = "" if by == "country" else ", count(DISTINCT track_id) AS unique_tracks_sold"
            named = "TRUE" if by == "country" else f"{by} IS NOT NULL"
            found[f"distinct_counts_{by}{v.suffix}_kept"] = (
                _with(staged(v.filter))
                + f" SELECT {by} AS group_val, count(DISTINCT customer_id) AS num_customers{tracks} FROM sl WHERE {_between(v.rng)} AND {named} GROUP BY 1"
            )
        found[f"customer_bounds{v.suffix}_in_batches"] = found["customer_bounds" + v.suffix]
        found[f"filter_digest{v.suffix}"] = _tree_digest(v)
    found["static_summary_colocated"] = found["static_summary"]
    return found
