"""The same queries as plain SQL over the supplied tables."""

from __future__ import annotations

from statistics import NormalDist

from shopcast import fixed
from shopcast.operators.features import column_name
from shopcast.plans import retail

F0, F1 = retail.FEATURE_PERIOD
O0, O1 = retail.OUTCOME_PERIOD
SHARES = retail.SHARES
CHUNK = retail.SETTINGS.chunk_size

PARTS: dict[str, str] = {}


def _text(value: str) -> str:
    """A SQL string literal; line breaks as chr(10)."""
    pieces = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + " || chr(10) || ".join(pieces) + ")"


def _with(*names: str, body: str) -> str:
    """The named parts, with what they need first, in front of the body."""
    order: list[str] = []

    def add(name: str) -> None:
        needs, _ = PARTS[name]
        for need in needs:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + body


def part(name: str, needs: list[str], sql: str) -> None:
    PARTS[name] = (needs, sql)


def plain(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', CAST({x} AS DOUBLE))"


def value(x: str, kind: str) -> str:
    """Typed rendering."""
    shown = {
        "percent": f"{plain(f'({x}) * 100', 1)} || '%'",
        "integer": f"format('{{:,}}', CAST(trunc({x}) AS BIGINT))",
        "float": plain(x, 2),
        "string": f"CAST({x} AS VARCHAR)",
    }[kind]
    return f"coalesce({shown}, 'N/A')"


def pct(x: str) -> str:
    return f"{plain(f'({x}) * 100', 2)} || '%'"


# Transactions and customers ------------------------------------------------

part("raw", [], """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS invoice_no,
       l_linenumber AS line_no, o_orderdate AS invoice_date,
       CAST(l_partkey AS VARCHAR) AS stock_code, coalesce(p_name, 'UNKNOWN') AS description,
       p_type AS category, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       (l_extendedprice / l_quantity) * l_quantity AS sales,
       strftime(o_orderdate, '%Y-%m') AS yearmon
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE o_custkey IS NOT NULL AND l_extendedprice / l_quantity > 0 AND l_quantity > 0
  AND CAST(l_partkey AS VARCHAR) NOT IN ('BANK CHARGES', 'C2', 'DOT', 'M', 'PADS', 'POST')""")
part("tx", ["raw"], f"SELECT * FROM raw WHERE yearmon >= '{F0}'")
part("ftx", ["tx"], f"SELECT * FROM tx WHERE yearmon BETWEEN '{F0}' AND '{F1}'")
part("otx", ["tx"], f"SELECT * FROM tx WHERE yearmon BETWEEN '{O0}' AND '{O1}'")
part("last", ["ftx"], "SELECT max(invoice_date) AS d FROM ftx")
part("rfm", ["ftx", "last"], """
SELECT customer_id,
       CAST(floor(epoch(any_value(last.d) - max(invoice_date)) / 86400) AS BIGINT) AS recency,
       min(invoice_date) AS first_purchase_date,
       count(DISTINCT invoice_date) AS purchase_day, count(DISTINCT invoice_no) AS nb_invoice,
       round(sum(sales), 2) AS total_sales, count(DISTINCT stock_code) AS nb_product,
       count(DISTINCT category) AS nb_category,
       CAST(floor(epoch(any_value(last.d) - min(invoice_date)) / 86400) AS BIGINT) AS customer_lifetime
FROM ftx, last GROUP BY customer_id""")
part("rates", ["rfm"], """
SELECT *, customer_lifetime / CAST(purchase_day AS DOUBLE) AS avg_purchase_frequency,
       total_sales / purchase_day AS avg_purchase_value FROM rfm""")
_sums = ", ".join(
    f"round(sum(CASE WHEN category = '{c}' THEN sales ELSE 0 END), 2) AS {column_name(c)}"
    for c in retail.CATEGORIES
)
_names = [column_name(c) for c in retail.CATEGORIES]
part("cat_pivot", ["ftx"], f"""
SELECT customer_id, {', '.join(_names)},
       {', '.join(f'{n} / total AS per_{n}' for n in _names)}
FROM (SELECT customer_id, round(sum(sales), 2) AS total, {_sums} FROM ftx GROUP BY customer_id)""")


def _firsts(source: str, column: str, out: str) -> str:
    return f"""
SELECT customer_id, string_agg(v, '|' ORDER BY a, b, c, v) AS {out} FROM (
  SELECT customer_id, {column} AS v, min(ROW(invoice_date, invoice_no, line_no)) AS m,
         m[1] AS a, m[2] AS b, m[3] AS c
  FROM {source} GROUP BY customer_id, {column}) GROUP BY customer_id"""


for _src, _col, _out in (
    ("ftx", "description", "bought_descriptions"),
    ("ftx", "category", "bought_categories"),
    ("otx", "description", "target_descriptions"),
    ("otx", "category", "target_categories"),
):
    part(_out, [_src], _firsts(_src, _col, _out))
part("osales", ["otx"], "SELECT customer_id, sum(sales) AS s FROM otx GROUP BY customer_id")
part(
    "outcome",
    ["ftx", "osales", "target_descriptions", "target_categories", "bought_descriptions", "bought_categories"],
    """
SELECT customer_id, round(coalesce(s, 0.0), 2) AS target_sales,
       coalesce(target_descriptions, '') AS target_descriptions,
       coalesce(target_categories, '') AS target_categories,
       coalesce(bought_descriptions, '') AS bought_descriptions,
       coalesce(bought_categories, '') AS bought_categories
FROM (SELECT DISTINCT customer_id FROM ftx) LEFT JOIN osales USING (customer_id)
LEFT JOIN target_descriptions USING (customer_id) LEFT JOIN target_categories USING (customer_id)
LEFT JOIN bought_descriptions USING (customer_id) LEFT JOIN bought_categories USING (customer_id)""",
)
part("dataset", ["outcome", "rates", "cat_pivot"], f"""
SELECT o.*, recency, purchase_day, total_sales, nb_product, nb_category, customer_lifetime,
       avg_purchase_frequency, avg_purchase_value, {', '.join(SHARES)}
FROM outcome o JOIN rates USING (customer_id) JOIN cat_pivot USING (customer_id)""")
part("cust", ["dataset"], f"""
SELECT dataset.*, c_mktsegment AS segment, CAST(target_sales > 0 AS INTEGER) AS label,
       {_text(retail.TREATMENTS[0])} AS promotion
FROM dataset JOIN customer ON CAST(c_custkey AS VARCHAR) = customer_id""")
_rounded = ("avg_purchase_frequency", "avg_purchase_value", *SHARES)
part("rcust", ["cust"], f"""
SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _rounded)}) FROM cust""")
part("people", [], "SELECT *, CAST(c_custkey AS VARCHAR) AS customer_id FROM customer")

SQL: dict[str, str] = {}
SQL["clean_transactions"] = _with("raw", body="""
SELECT customer_id, invoice_no, line_no, stock_code, description, quantity, round(sales, 2) AS sales FROM raw""")
SQL["yearmon_sales"] = """
SELECT strftime(o_orderdate, '%Y-%m') AS yearmon, count(*) AS orders, round(sum(o_totalprice), 2) AS sales
FROM orders GROUP BY 1"""
SQL["period_split"] = _with("ftx", "otx", body="""
SELECT 'feature' AS period, yearmon, count(*) AS lines, round(sum(sales), 2) AS sales FROM ftx GROUP BY yearmon
UNION ALL SELECT 'outcome', yearmon, count(*), round(sum(sales), 2) FROM otx GROUP BY yearmon""")
SQL["category_join"] = _with("raw", body="""
SELECT invoice_no, line_no, stock_code, p_type AS category, round(sales, 2) AS sales
FROM raw LEFT JOIN part ON stock_code = CAST(p_partkey AS VARCHAR)""")
SQL["period_sales"] = _with("ftx", "otx", body="""
SELECT customer_id, round(f, 2) AS feature_sales, round(o, 2) AS outcome_sales
FROM (SELECT customer_id, sum(sales) AS f FROM ftx GROUP BY 1)
FULL JOIN (SELECT customer_id, sum(sales) AS o FROM otx GROUP BY 1) USING (customer_id)""")
SQL["rfm_features"] = _with("rfm", body="""
SELECT * REPLACE (strftime(first_purchase_date, '%Y-%m-%d') AS first_purchase_date) FROM rfm""")
SQL["rfm_derived"] = _with("rates", body="""
SELECT customer_id, customer_lifetime, round(avg_purchase_frequency, 6) AS avg_purchase_frequency,
       round(avg_purchase_value, 6) AS avg_purchase_value FROM rates""")
SQL["category_pivot"] = _with("cat_pivot", body=f"""
SELECT * REPLACE ({', '.join(f'round({s}, 6) AS {s}' for s in SHARES)}) FROM cat_pivot""")
SQL["bought_lists"] = _with("bought_descriptions", "bought_categories", body="""
SELECT * FROM bought_descriptions JOIN bought_categories USING (customer_id)""")
SQL["outcome_table"] = _with("outcome", body="SELECT * FROM outcome")
SQL["customer_dataset"] = _with("dataset", body=f"""
SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _rounded)}) FROM dataset""")

# Cleaning ------------------------------------------------------------------

SQL["convert_to_float"] = _with("people", body="""
SELECT customer_id, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal,
       TRY_CAST(' ' || c_acctbal AS DOUBLE) AS balance_text,
       CASE WHEN c_nationkey < 22 THEN CAST(c_nationkey AS DOUBLE) END AS mostly_number,
       CASE WHEN c_nationkey < 8 THEN CAST(c_nationkey AS VARCHAR) ELSE 'none' END AS mostly_text,
       c_mktsegment FROM people""")
SQL["impute_cols"] = _with("people", body="""
SELECT customer_id,
       CASE WHEN days IS NULL OR days > 360 THEN 360.0e0 ELSE days END AS days_since_last_order,
       coalesce(round(f_sales, 2), 0.0e0) AS f_sales, coalesce(p_priority, '') AS p_priority
FROM people LEFT JOIN (
  SELECT o_custkey AS c_custkey,
         CAST(date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS DOUBLE) AS days,
         sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f_sales,
         max(o_orderpriority) FILTER (o_orderstatus = 'P') AS p_priority
  FROM orders GROUP BY 1) USING (c_custkey)""")


def nearest_rank(column: str, prob: float, source: str) -> str:
    return (
        f"(SELECT list({column} ORDER BY {column})"
        f"[CAST(floor((count({column}) - 1) * {prob!r}::DOUBLE + 0.5::DOUBLE) AS BIGINT) + 1] FROM {source})"
    )


SQL["winsorize_upper"] = f"""
WITH pos AS (SELECT o_totalprice FROM orders WHERE o_totalprice > 0)
SELECT o_orderkey, least(o_totalprice, {nearest_rank('o_totalprice', 0.95, 'pos')}) AS o_totalprice FROM orders"""
_tail = (1 - 0.9) / 2
SQL["winsorize_both"] = _with("people", body=f"""
SELECT customer_id, greatest(least(c_acctbal, {nearest_rank('c_acctbal', 1 - _tail, 'customer')}),
       {nearest_rank('c_acctbal', _tail, 'customer')}) AS c_acctbal FROM people""")
SQL["counterfactual_grid"] = _with("people", body=f"""
SELECT customer_id, c_mktsegment, promotion FROM people
CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in retail.TREATMENTS)}) t(promotion)""")


# Sampling ------------------------------------------------------------------


def hashed(key: str, seed: int | str) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


part("split", ["people"], f"""
SELECT *, CASE WHEN r <= t THEN 'train' WHEN r <= t + round_even((n - t) * 0.5::DOUBLE, 0) THEN 'valid'
               ELSE 'test' END AS split
FROM (SELECT *, round_even(n * 0.6::DOUBLE, 0) AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hashed('c_custkey', 112)}) AS r,
         count(*) OVER (PARTITION BY c_mktsegment) AS n FROM people))""")
SQL["train_valid_test"] = _with("split", body="SELECT customer_id, c_mktsegment, split FROM split")
_scaled = {c: f"(SELECT {{0}}(CAST({c} AS DOUBLE)) FROM split WHERE split = 'train')" for c in ("c_acctbal", "c_nationkey")}
SQL["minmax_scale"] = _with("split", body="SELECT customer_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - {q.format('min')}) / ({q.format('max')} - {q.format('min')}), 8) AS {c}"
    for c, q in _scaled.items()) + " FROM split")
SQL["zscore_features"] = _with("split", body="SELECT customer_id, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - {q.format('avg')}) / {q.format('stddev_pop')}, 8) AS {c}"
    for c, q in _scaled.items()) + " FROM split")
SQL["split_check"] = _with("split", body="""
SELECT s.split, w.c_mktsegment, round(w.share, 8) AS original_share,
       round(coalesce(p.share, 0), 8) AS split_share, abs(w.share - coalesce(p.share, 0)) > 0.0015::DOUBLE AS deviates
FROM (SELECT c_mktsegment, count(*) / CAST((SELECT count(*) FROM split) AS DOUBLE) AS share FROM split GROUP BY 1) w
CROSS JOIN (SELECT DISTINCT split FROM split) s
LEFT JOIN (SELECT split, c_mktsegment, count(*) / CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE) AS share
           FROM split GROUP BY 1, 2) p ON p.split = s.split AND p.c_mktsegment = w.c_mktsegment""")
part("ord", [], """
SELECT o_orderkey, o_orderpriority, CAST(o_orderstatus = 'F' AS INTEGER) AS outcome FROM orders""")
SQL["resample_outcome"] = _with("ord", body=f"""
SELECT o_orderkey, o_orderpriority, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY outcome, o_orderpriority ORDER BY {hashed('o_orderkey', 112)}) AS r,
         count(*) OVER (PARTITION BY outcome, o_orderpriority) AS n, count(*) OVER (PARTITION BY outcome) AS neg,
         floor(0.5::DOUBLE * (SELECT sum(outcome) FROM ord)) AS wanted FROM ord)
WHERE outcome = 1 OR wanted > neg OR r <= round_even(n / CAST(neg AS DOUBLE) * wanted, 0)""")
SQL["stratified_sample"] = _with("ord", body=f"""
SELECT o_orderkey, o_orderpriority, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hashed('o_orderkey', 112)}) AS r,
         count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS total FROM ord)
WHERE r <= round_even(n / CAST(total AS DOUBLE) * 500, 0)""")
SQL["stratified_split"] = _with("ord", body=f"""
SELECT o_orderkey, o_orderpriority, outcome,
       CASE WHEN r <= round_even(n * 0.3::DOUBLE, 0) THEN 'first' ELSE 'second' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hashed('o_orderkey', 112)}) AS r,
         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM ord)""")
SQL["row_limit_sample"] = _with("ord", body=f"""
SELECT * FROM ord ORDER BY {hashed('o_orderkey', 42)} LIMIT 100""")
SQL["fraction_sample"] = _with("ord", body=f"""
SELECT * FROM ord WHERE substr({hashed('o_orderkey', 42)}, 1, 8) < '{int(0.1 * 16**8):08x}'""")
SQL["holdout"] = _with("people", body=f"""
SELECT customer_id, c_mktsegment,
       CASE WHEN row_number() OVER (ORDER BY {hashed('customer_id', 42)}) <= 1000 THEN 'infer' ELSE 'reference' END AS role
FROM people""")

# Summaries -----------------------------------------------------------------


def decile_rows(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, prob, CAST(vs[CAST(floor((len(vs) - 1) * prob + 0.5::DOUBLE) AS BIGINT) + 1] AS DOUBLE) AS value
FROM (SELECT list({c} ORDER BY {c}) FILTER ({c} IS NOT NULL) AS vs FROM {source}),
     (SELECT unnest([{', '.join(f'{p!r}::DOUBLE' for p in fixed.DECILES)}]) AS prob)"""
        for c in columns
    )


def stat_rows(specs, source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{s.name}' AS feature, count({s.name}) AS n, CAST(min({s.name}) AS DOUBLE) AS min,
CAST(max({s.name}) AS DOUBLE) AS max, avg(CAST({s.name} AS DOUBLE)) AS mean,
avg(CAST({s.name} {'< 360' if 'days_since_' in s.name else '> 0'} AS DOUBLE)) AS share FROM {source}"""
        for s in specs
    )


_numeric = [s for s in retail.PROFILE_SPECS if s.data_type != "string"]
SQL["nearest_deciles"] = decile_rows(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem")
SQL["feature_stats"] = _with("cust", body=f"""
SELECT feature, n, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(share, 8) AS share
FROM ({stat_rows(_numeric, 'cust')})""")
SQL["value_shares"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {c} AS value, count(*) AS cnt,
round(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 8) AS share FROM orders GROUP BY {c}"""
    for c in ("o_orderstatus", "o_orderpriority")
)


def numeric_bodies(specs, source: str) -> str:
    """Text of every numeric column, with its place."""
    out = []
    for i, s in enumerate(specs):
        kind = s.data_type

        def v(x: str) -> str:
            return value(x, kind)

        lines = " || ".join(
            f"chr(10) || '  {round(p * 100)}th: ' || {v(nearest_rank(s.name, p, source))}" for p in fixed.DECILES
        )
        out.append(f"""SELECT '{s.name}' AS feature, {_text(f'Distribution of {s.description}:')} || chr(10) ||
'- Range: ' || {v(f'min({s.name})')} || ' to ' || {v(f'max({s.name})')} || chr(10) ||
'- Percent of non-zero values: ' || {pct(f'avg(CAST({s.name} > 0 AS DOUBLE))')} || chr(10) ||
'- Mean: ' || {v(f'avg({s.name})')} || chr(10) || '- Percentiles:' || {lines} AS body FROM {source}""")
    return " UNION ALL ".join(out)


def string_body(s, source: str) -> str:
    return f"""SELECT '{s.name}' AS feature, {_text(f'Distribution of {s.description}:')} || chr(10) || '- Value counts:' ||
chr(10) || string_agg('  ' || coalesce(v, 'None') || ': ' || {pct('c / CAST(t AS DOUBLE)')}, chr(10) ORDER BY c DESC, v NULLS LAST) AS body
FROM (SELECT {s.name} AS v, count(*) AS c, sum(count(*)) OVER () AS t FROM {source} GROUP BY 1)"""


def _feature_text(specs, source: str) -> str:
    seen: list[str] = []
    cases = []
    for i, s in enumerate(specs):
        head = "" if s.domain in seen else f"[{s.domain} Domain]\n"
        seen.append(s.domain)
        cases.append((s.name, i, head))
    place = " ".join(f"WHEN '{n}' THEN {i}" for n, i, _ in cases)
    prefix = " ".join(f"WHEN '{n}' THEN {_text(h)}" for n, _, h in cases)
    return f"""SELECT string_agg(CASE feature {prefix} END || body, chr(10) ORDER BY CASE feature {place} END) AS distribution
FROM ({numeric_bodies(specs, source)})"""


SQL["feature_distribution_text"] = _with("cust", body=_feature_text(_numeric, "cust"))
part("odist", ["cust"], f"""
SELECT {_text(retail.OUTCOME_CONTEXT)} || chr(10) || chr(10) || body AS distribution
FROM ({numeric_bodies([retail.OUTCOME_SPECS[0]], 'cust')})""")
SQL["outcome_distribution_text"] = _with("odist", body=f"""
SELECT distribution || chr(10) || chr(10) || body AS distribution
FROM odist, ({string_body(retail.OUTCOME_SPECS[1], 'cust')})""")


def _quartiles(column: str, label: str, source: str) -> str:
    q = f"quantile_cont({column}, {{}}) "
    return f"""'''{label}'' has a mean value of ' || {plain(f'avg({column})', 1)} || ' with a standard deviation of ' || {plain(f'stddev_samp({column})', 1)} ||
'. The minimum observed value is ' || {plain(f'min({column})', 1)} || ', while the maximum is ' || {plain(f'max({column})', 1)} ||
'. Approximately 25% of the values are below ' || {plain(q.format('0.25'), 1)} || ', the median (50th percentile) is ' || {plain(q.format('0.5'), 1)} ||
', and 75% of the values fall below ' || {plain(q.format('0.75'), 1)} || '. '"""


SQL["quartile_text"] = "SELECT " + " || ".join(
    _quartiles(c, n, "lineitem")
    for c, n in (("l_quantity", "Quantity"), ("l_extendedprice", "Price"), ("l_discount", "Discount"))
) + " AS distribution FROM lineitem"

# Similarity ----------------------------------------------------------------

_SIM = retail.SIMILARITY_FEATURES
part("zvec", ["rcust"], "SELECT customer_id AS id, [" + ", ".join(
    f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) OVER () = 0 THEN 1 ELSE stddev_pop(CAST({c} AS DOUBLE)) OVER () END"
    for c in _SIM) + "] AS v FROM rcust")


def _sum_of(expr: str, n: int) -> str:
    return " + ".join(expr.format(i=i + 1) for i in range(n))


def _norm(v: str, n: int) -> str:
    terms = _sum_of(v + "[{i}] * " + v + "[{i}]", n)
    return f"greatest(sqrt({terms}), 1e-10)"


def _pairs(name: str, needs: list[str], source: str, value_sql: str, k: int, where: str = "true",
           refs: str | None = None) -> None:
    part(name, needs, f"""
SELECT query_id, ref_id, CAST(rank AS INTEGER) AS rank, val FROM (
  SELECT query_id, ref_id, val, row_number() OVER (PARTITION BY query_id ORDER BY round(val, 9), ref_id) AS rank
  FROM (SELECT a.id AS query_id, b.id AS ref_id, {value_sql} AS val FROM {source} a, {refs or source} b WHERE {where}))
WHERE rank <= {k}""")


_n = len(_SIM)
_euclid = "sqrt(" + _sum_of("(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])", _n) + ")"
_pairs("near_euclid", ["zvec"], "zvec", _euclid, 5)
_pairs("near_other", ["zvec"], "zvec", _euclid, 3, "a.id <> b.id")
_pairs("near_l1", ["zvec"], "zvec", _sum_of("abs(a.v[{i}] - b.v[{i}])", _n), 5)
_pairs("near_hamming", ["zvec"], "zvec",
       _sum_of("CAST((a.v[{i}] > 0.5) <> (b.v[{i}] > 0.5) AS DOUBLE)", _n), 5)
_pairs("near_dot", ["zvec"], "zvec", "-(" + _sum_of("a.v[{i}] * b.v[{i}]", _n) + ")", 5)
part("unit", ["zvec"], f"SELECT id, list_transform(v, lambda x: x / n) AS v FROM (SELECT id, v, {_norm('v', _n)} AS n FROM zvec)")
_pairs("near_angle", ["unit"], "unit", "-(" + _sum_of("a.v[{i}] * b.v[{i}]", _n) + ")", 5)


def _distance(name: str, expr: str = "val", score: str = "exp(-val)") -> str:
    return _with(name, body=f"""
SELECT query_id, ref_id, rank, round({expr}, 6) AS distance, round({score}, 6) AS score FROM {name}""")


SQL["knn_euclidean"] = _distance("near_euclid")
SQL["knn_probed_all"] = SQL["knn_euclidean"]
SQL["knn_probed_rows"] = _with("near_euclid", body="""
SELECT query_id, count(*) AS neighbours FROM near_euclid GROUP BY query_id""")
SQL["knn_recall"] = "SELECT true AS enough"
SQL["knn_forest_recall"] = "SELECT true AS enough, true AS within"
SQL["knn_manhattan"] = _distance("near_l1")
SQL["knn_hamming"] = _distance("near_hamming")
SQL["knn_angular"] = _distance(
    "near_angle", "sqrt(greatest(2 + 2 * val, 0))", "exp(-sqrt(greatest(2 + 2 * val, 0)))")
SQL["knn_dot"] = _with("near_dot", body="SELECT query_id, ref_id, rank, round(-val, 6) AS distance FROM near_dot")

_RANK = retail.RANKING_FEATURES
_m = len(_RANK)
part("scaled", ["rcust"], "SELECT customer_id AS id, label, " + ", ".join(
    f"coalesce((CAST({c} AS DOUBLE) - min(CAST({c} AS DOUBLE)) OVER ()) / nullif(max(CAST({c} AS DOUBLE)) OVER () - min(CAST({c} AS DOUBLE)) OVER (), 0), 0) AS {c}"
    for c in _RANK) + " FROM rcust")
part("sunit", ["scaled"], f"""
SELECT id, list_transform(v, lambda x: x / n) AS v FROM (
  SELECT id, v, {_norm('v', _m)} AS n FROM (SELECT id, [{', '.join(_RANK)}] AS v FROM scaled))""")
_cosine = "-(" + _sum_of("a.v[{i}] * b.v[{i}]", _m) + ")"
_pairs("near_cos10", ["sunit"], "sunit", _cosine, 10)
SQL["knn_cosine"] = _with("near_cos10", body="""
SELECT query_id, ref_id, rank, round(-val, 6) AS score FROM near_cos10""")

part("emb", [], """
SELECT id, list(z ORDER BY i) AS v FROM (
  SELECT id, i, (x - avg(x) OVER (PARTITION BY i)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY i) = 0 THEN 1 ELSE stddev_pop(x) OVER (PARTITION BY i) END AS z
  FROM (SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
GROUP BY id""")
_pairs("near_emb", ["emb"], "emb", "list_distance(a.v, b.v)", 5, "a.id <> b.id")
SQL["embedding_topk"] = _with("near_emb", body="""
SELECT query_id, ref_id, rank, round(val, 5) AS distance, round(exp(-val), 6) AS score FROM near_emb""")
part("evec", [], "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings")
part("eclick", ["evec"], "SELECT evec.* FROM evec JOIN labels ON doc_id = id WHERE quality = 1")
_pairs("near_text", ["evec", "eclick"], "evec", "-list_cosine_similarity(a.v, b.v)", 5, refs="eclick")
SQL["similar_text_answers"] = _with("near_text", body="""
SELECT query_id, string_agg(text || '. Answer: ' || CASE toxic WHEN 1 THEN 'accept' ELSE 'refuse' END || '. Confidence: ' ||
                            CAST(90 - 5 * rank AS VARCHAR) || '.', chr(10) ORDER BY rank) AS similar_text
FROM near_text JOIN documents d ON d.doc_id = ref_id JOIN labels l ON l.doc_id = ref_id GROUP BY query_id""")
SQL["similar_text_cosine"] = _with("near_text", body="""
SELECT query_id, string_agg(text || '. Preferred categories: ' || label || '.', chr(10) ORDER BY rank) AS similar_text
FROM near_text JOIN embeddings ON vec_id = ref_id JOIN documents ON doc_id = ref_id GROUP BY query_id""")

# Local ranking -------------------------------------------------------------



def _in_train(function: str, c: str) -> str:
    return f"{function}(CAST({c} AS DOUBLE)) FILTER (split = 'train') OVER ()"


part("tscaled", ["rcust", "split"], "SELECT customer_id AS id, label, split, " + ", ".join(
    f"coalesce((CAST({c} AS DOUBLE) - {_in_train('min', c)}) / nullif({_in_train('max', c)} - {_in_train('min', c)}, 0), 0) AS {c}"
    for c in _RANK) + " FROM rcust JOIN (SELECT customer_id, split FROM split) USING (customer_id)")
part("tunit", ["tscaled"], f"""
SELECT id, split, list_transform(v, lambda x: x / n) AS v FROM (
  SELECT id, split, v, {_norm('v', _m)} AS n FROM (SELECT id, split, [{', '.join(_RANK)}] AS v FROM tscaled))""")
_pairs("near_cos", ["tunit"], "(SELECT * FROM tunit WHERE split = 'test')", _cosine,
       retail.RANKING_NEIGHBOURS, refs="(SELECT * FROM tunit WHERE split = 'train')")
part("sref", ["tscaled"], "SELECT id AS ref_id, label, " + ", ".join(f"round({c}, 9) AS {c}" for c in _RANK)
     + " FROM tscaled WHERE split = 'train'")
part("local", ["near_cos", "sref"], "SELECT * FROM near_cos JOIN sref USING (ref_id)")
part("near1000", ["local"], f"SELECT * FROM local WHERE rank <= {retail.SCREEN_NEIGHBOURS}")


def _r(x: str, y: str) -> str:
    n = "count(*)"
    vx = f"({n} * sum({x} * {x}) - sum({x}) * sum({x}))"
    vy = f"({n} * sum({y} * {y}) - sum({y}) * sum({y}))"
    return (
        f"CASE WHEN {vx} > 1e-10 * {n} * {n} AND {vy} > 1e-10 * {n} * {n} THEN "
        f"({n} * sum({x} * {y}) - sum({x}) * sum({y})) / sqrt({vx} * {vy}) END"
    )


SQL["corr_ranking"] = _with("local", body=f"""
SELECT query_id, feature, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query_id, feature, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, feature DESC) AS rank FROM (
    SELECT query_id, unnest([{', '.join(f"'{c}'" for c in _RANK)}]) AS feature, unnest(rs) AS score FROM (
      SELECT query_id, [{', '.join(f"round(abs(coalesce({_r(c, 'label')}, 0)), 9)" for c in _RANK)}] AS rs
      FROM local GROUP BY query_id)))
WHERE rank <= 30""")
part("mi", ["local"], f"""
SELECT query_id, feature, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, feature DESC) AS rank FROM (
  SELECT query_id, feature, round(abs(sum(c / n * ln(c * n / (cb * cy)))), 9) AS score FROM (
    SELECT *, sum(c) OVER (PARTITION BY query_id, feature) AS n, sum(c) OVER (PARTITION BY query_id, feature, bin) AS cb,
           sum(c) OVER (PARTITION BY query_id, feature, y) AS cy FROM (
      SELECT query_id, feature, bin, label AS y, CAST(count(*) AS DOUBLE) AS c FROM (
        SELECT query_id, label, unnest([{', '.join(f"'{c}'" for c in _RANK)}]) AS feature,
               unnest([{', '.join(f'CAST(least(floor({c} * 10), 9) AS INTEGER)' for c in _RANK)}]) AS bin FROM local)
      GROUP BY ALL))
  GROUP BY query_id, feature)""")
SQL["mi_ranking"] = _with("mi", body="""
SELECT query_id, feature, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM mi WHERE rank <= 30""")

part("moments", ["near1000"], "SELECT query_id, count(*) AS n, " + ", ".join(
    [f"{_r(c, 'label')} AS t_{i}" for i, c in enumerate(_RANK)]
    + [f"coalesce({_r(_RANK[i], _RANK[j])}, 0) AS f_{i}_{j}" for i in range(_m) for j in range(i + 1, _m)]
) + " FROM near1000 GROUP BY query_id")


def _z(r: str, given: int) -> str:
    size = f"least(abs(coalesce({r}, 0)), 0.999999999)"
    return f"sqrt(CAST(greatest(n - {given} - 3, 0) AS DOUBLE)) * 0.5 * ln((1 + {size}) / (1 - {size}))"


def _weakest(i: int) -> str:
    tests = [_z(f"t_{i}", 0)]
    for j in range(_m):
        if j == i:
            continue
        f = f"f_{min(i, j)}_{max(i, j)}"
        t = f"coalesce(t_{j}, 0)"
        spread = f"((1 - {f} * {f}) * (1 - {t} * {t}))"
        tests.append(_z(f"(CASE WHEN {spread} > 1e-10 THEN (coalesce(t_{i}, 0) - {f} * {t}) / sqrt({spread}) END)", 1))
    return f"least({', '.join(tests)})"


part("screen", ["moments"], f"""
SELECT query_id, feature, correlation, weakest_z, weakest_z > {NormalDist().inv_cdf(0.95)!r}::DOUBLE AS passed FROM (
  SELECT query_id, unnest([{', '.join(f"'{c}'" for c in _RANK)}]) AS feature,
         unnest([{', '.join(f'coalesce(t_{i}, 0)' for i in range(_m))}]) AS correlation,
         unnest([{', '.join(_weakest(i) for i in range(_m))}]) AS weakest_z FROM moments)""")
SQL["fisher_z_screen"] = _with("screen", body="""
SELECT query_id, feature, round(correlation, 6) AS correlation, round(weakest_z, 5) AS weakest_z, passed FROM screen""")
_SK = [*retail.SIMILARITY_FEATURES, "label"]
_sk_pairs = [(i, j) for i in range(len(_SK)) for j in range(i + 1, len(_SK))]
part("skr", ["near1000"], f"""
SELECT query_id, n, unnest([{', '.join(str(i) for i, _ in _sk_pairs)}]) AS i, unnest([{', '.join(str(j) for _, j in _sk_pairs)}]) AS j,
       unnest(rs) AS r FROM (
  SELECT query_id, count(*) AS n, [{', '.join(f"coalesce({_r(_SK[i], _SK[j])}, 0)" for i, j in _sk_pairs)}] AS rs
  FROM near1000 GROUP BY query_id)""")
part("skboth", ["skr"], "SELECT * FROM skr UNION ALL SELECT query_id, n, j, i, r FROM skr")


def _given(own: str, left: str, right: str) -> str:
    spread = f"((1 - {left} * {left}) * (1 - {right} * {right}))"
    return f"CASE WHEN {spread} > 1e-10 THEN ({own} - {left} * {right}) / sqrt({spread}) ELSE 0 END"


_sk_critical = f"{NormalDist().inv_cdf(0.95)!r}::DOUBLE"
part("skone", ["skboth"], f"""
SELECT a.query_id, a.n, a.i, a.j, b.j AS k, {_given('a.r', 'b.r', 'c.r')} AS r
FROM skboth a JOIN skboth b ON b.query_id = a.query_id AND b.i = a.i AND b.j <> a.j
JOIN skboth c ON c.query_id = a.query_id AND c.i = a.j AND c.j = b.j""")
part("skadj0", ["skboth"], f"SELECT query_id, i, j FROM skboth WHERE {_z('r', 0)} > {_sk_critical}")
part("sksep1", ["skone", "skadj0"], f"""
SELECT query_id, i, j, min(k) AS k FROM skone JOIN skadj0 USING (query_id, i, j)
WHERE i < j AND ((query_id, i, k) IN (SELECT (query_id, i, j) FROM skadj0) OR (query_id, j, k) IN (SELECT (query_id, i, j) FROM skadj0))
  AND NOT ({_z('r', 1)} > {_sk_critical}) GROUP BY ALL""")
part("skadj1", ["skadj0", "sksep1"], """
SELECT * FROM skadj0 WHERE (query_id, least(i, j), greatest(i, j)) NOT IN (SELECT (query_id, i, j) FROM sksep1)""")
part("sksep2", ["skone", "skadj1"], f"""
SELECT query_id, i, j, min([k, l]) AS kl FROM (
  SELECT a.query_id, a.n, a.i, a.j, a.k, b.j AS l, {_given('a.r', 'b.r', 'c.r')} AS r
  FROM skone a JOIN skadj1 e ON e.query_id = a.query_id AND e.i = a.i AND e.j = a.j AND a.i < a.j
  JOIN skone b ON b.query_id = a.query_id AND b.i = a.i AND b.k = a.k AND b.j > a.k AND b.j <> a.j
  JOIN skone c ON c.query_id = a.query_id AND c.i = a.j AND c.k = a.k AND c.j = b.j)
WHERE (((query_id, i, k) IN (SELECT (query_id, i, j) FROM skadj1) AND (query_id, i, l) IN (SELECT (query_id, i, j) FROM skadj1))
    OR ((query_id, j, k) IN (SELECT (query_id, i, j) FROM skadj1) AND (query_id, j, l) IN (SELECT (query_id, i, j) FROM skadj1)))
  AND NOT ({_z('r', 2)} > {_sk_critical}) GROUP BY ALL""")
_sk_names = "[" + ", ".join(f"'{c}'" for c in _SK) + "]"
SQL["dependence_skeleton"] = _with("skr", "skadj0", "sksep1", "sksep2", body=f"""
SELECT query_id, {_sk_names}[i + 1] AS first, {_sk_names}[j + 1] AS second, round(r, 6) AS correlation,
       (query_id, i, j) IN (SELECT (query_id, i, j) FROM skadj0) AND k IS NULL AND kl IS NULL AS joined,
       CASE WHEN (query_id, i, j) NOT IN (SELECT (query_id, i, j) FROM skadj0) THEN ''
            WHEN k IS NOT NULL THEN {_sk_names}[k + 1]
            WHEN kl IS NOT NULL THEN {_sk_names}[kl[1] + 1] || '+' || {_sk_names}[kl[2] + 1] END AS separated_by
FROM skr LEFT JOIN sksep1 USING (query_id, i, j) LEFT JOIN sksep2 USING (query_id, i, j)""")
part("forder", ["mi", "screen"], """
SELECT query_id, feature, place FROM (
  SELECT query_id, feature, row_number() OVER (PARTITION BY query_id ORDER BY CAST(passed AS INTEGER) DESC, rank) AS place
  FROM (SELECT * FROM mi WHERE rank <= 30) JOIN screen USING (query_id, feature)) WHERE place <= 15""")


def _label_case(names: dict[str, str], column: str = "feature") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


FULL_NAMES = {
    "recency": "Recency", "purchase_day": "Days", "total_sales": "Total",
    "nb_product": "Products", "nb_category": "Categories", "customer_lifetime": "Lifetime",
    "avg_purchase_frequency": "Frequency", "avg_purchase_value": "Basket",
}
part("ftext", ["forder"], f"""
SELECT query_id, string_agg({_label_case(FULL_NAMES)}, ' > ' ORDER BY place) || '.' AS factor_text FROM forder GROUP BY query_id""")
SQL["factor_text"] = _with("ftext", body="SELECT * FROM ftext")
_value_case = "CASE feature " + " ".join(f"WHEN '{c}' THEN CAST({c} AS VARCHAR)" for c in _RANK) + " END"
part("cases", ["forder", "near_cos", "rcust"], f"""
SELECT query_id, string_agg('Customer Profile: ' || body || '.Answer: ' || CASE label WHEN 1 THEN 'accept' ELSE 'refuse' END || '.', chr(10) ORDER BY rank) AS case_text
FROM (SELECT query_id, rank, any_value(label) AS label, string_agg(feature || ' is ' || {_value_case}, ', ' ORDER BY place) AS body
      FROM near_cos JOIN rcust ON customer_id = ref_id JOIN forder USING (query_id) WHERE rank <= 5 GROUP BY query_id, rank)
GROUP BY query_id""")
SQL["case_text"] = _with("cases", body="SELECT * FROM cases")
_items = " || ".join(
    f"CASE WHEN CAST(trunc({c}) AS BIGINT) <> 0 THEN ', {c} is ' || CAST({c} AS VARCHAR) ELSE '' END" for c in retail.SHARES)
SQL["case_text_rec"] = _with("forder", "near_cos", "rcust", body=f"""
SELECT query_id, string_agg('Customer Profile: ' || body || items || '.Preferred Categories: group ' || CAST(nb_category AS VARCHAR) || '.',
                            chr(10) ORDER BY rank) AS case_text
FROM (SELECT query_id, rank, any_value(nb_category) AS nb_category, any_value({_items}) AS items,
             string_agg(feature || ' is ' || {_value_case}, ', ' ORDER BY place) AS body
      FROM near_cos JOIN rcust ON customer_id = ref_id JOIN forder USING (query_id) WHERE rank <= 5 GROUP BY query_id, rank)
GROUP BY query_id""")


def bare(x: str, kind: str = "number") -> str:
    if kind == "string":
        return x
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE {plain(x, 2)} END)"


def numeric_text(names: dict[str, str], skip: tuple[str, ...] = ()) -> str:
    return " || ".join(
        f"{_text(label.replace('.', '') + ' is ')} || {bare(c, 'string' if c == 'segment' else 'number')} || '. '"
        for c, label in names.items() if c not in skip
    )


SQL["factor_prompt"] = _with("ftext", "cases", body=f"""
SELECT query_id, 'Start.' || chr(10) || 'Factors:' || chr(10) || replace(factor_text, ',', chr(10)) || chr(10) ||
       'Cases:' || chr(10) || case_text || chr(10) || 'End.' || chr(10) || {numeric_text({c: FULL_NAMES[c] for c in _SIM})} AS prompt
FROM ftext JOIN cases USING (query_id) JOIN rcust ON customer_id = query_id""")

SQL["factor_prompt_layouts"] = _with("ftext", "cases", body="""
SELECT query_id, unnest(['factors', 'cases', 'text']) AS layout,
       'Start.' || chr(10) || unnest(['Factors:' || chr(10) || replace(factor_text, ',', chr(10)) || chr(10),
                                      'Cases:' || chr(10) || case_text || chr(10), '']) ||
       'End.' || chr(10) || 'Customer ' || query_id AS prompt
FROM ftext JOIN cases USING (query_id)""")

# Text ----------------------------------------------------------------------

SQL["format_values"] = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN 'Yes' ELSE 'No' END AS as_binary,
       {value('o_totalprice / 500000.0::DOUBLE', 'percent')} AS as_percent, {value('o_totalprice', 'integer')} AS as_integer,
       {value('o_totalprice', 'float')} AS as_float, CAST(o_totalprice AS VARCHAR) AS as_string,
       CASE WHEN o_orderstatus = 'O' THEN {value('o_totalprice', 'float')} ELSE 'N/A' END AS with_nulls
FROM orders"""


def _domains(specs) -> dict[str, list]:
    out: dict[str, list] = {}
    for s in specs:
        out.setdefault(s.domain, []).append(s)
    return out


def _sentence(s) -> str:
    return f"{_text(s.description + ': ')} || {value(s.name, s.data_type)}"


def profile_sql(specs) -> str:
    lines = [
        f"{_text(f'[{d} Domain] ')} || " + " || '. ' || ".join(_sentence(s) for s in members) + " || '.'"
        for d, members in _domains(specs).items()
    ]
    return " || chr(10) || ".join(lines)


def shuffled_profile_sql(specs) -> str:
    def order(name: str) -> str:
        return f"md5(customer_id || ':112:' || '{name}')"

    lines = []
    for d, members in _domains(specs).items():
        pairs = ", ".join(f"{{'o': {order(s.name)}, 't': {_sentence(s)}}}" for s in members)
        body = f"array_to_string(list_transform(list_sort([{pairs}]), lambda p: p.t), '. ')"
        lines.append(f"{{'o': {order(d)}, 't': {_text(f'[{d} Domain] ')} || {body} || '.'}}")
    return f"array_to_string(list_transform(list_sort([{', '.join(lines)}]), lambda p: p.t), chr(10))"


SQL["template_profile"] = _with("cust", body=f"""
SELECT customer_id, {profile_sql(retail.PROFILE_SPECS)} AS template_profile FROM cust""")
SQL["template_profile_shuffled"] = _with("cust", body=f"""
SELECT customer_id, {shuffled_profile_sql(retail.PROFILE_SPECS)} AS template_profile FROM cust""")
SQL["template_treatment"] = _with("people", body=f"""
SELECT customer_id, treatment, 'Promotion offered: ' || treatment || '.' AS template_treatment FROM people
CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in retail.TREATMENTS)}) t(treatment)""")
_out_text = " || ' ' || ".join(f"{_sentence(s)} || '.'" for s in retail.OUTCOME_SPECS)
_out_raw = " || '~' || ".join(f"coalesce(CAST({s.name} AS VARCHAR), 'None')" for s in retail.OUTCOME_SPECS)
SQL["template_outcome"] = _with("outcome", body=f"""
SELECT customer_id, {_out_raw} AS outcome, {_out_text} AS template_outcome FROM outcome""")
part("profiles", ["cust"], f"""
SELECT customer_id, {profile_sql(retail.PROFILE_SPECS)} AS template_profile, promotion AS treatment,
       'Promotion offered: ' || promotion || '.' AS template_treatment,
       {_out_raw} AS outcome, {_out_text} AS template_outcome FROM cust""")
SQL["profile_dataset"] = _with("profiles", body="SELECT * FROM profiles")


def whole(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def _sentence_sql() -> str:
    pieces = [_text(retail.SENTENCES.prefix)]
    for g in retail.SENTENCES.groups:
        inner = []
        for c, (some, none) in g.sentences.items():
            if c == "segment":
                shown = _label_case(retail.SEGMENT_NAMES, "segment")
                inner.append(f"replace({_text(some)}, '[VALUE]', {shown})")
            else:
                inner.append(
                    f"CASE WHEN {c} = 0 THEN replace({_text(none)}, '[VALUE]', {whole(c)}) "
                    f"ELSE replace({_text(some)}, '[VALUE]', {whole(c)}) END"
                )
        body = " || ".join(inner)
        if g.guard:
            body = f"CASE WHEN {g.guard} = 0 THEN {_text(g.empty_text)} ELSE {body} END"
        pieces.append(f"({body})")
    return " || ".join(pieces)


SQL["sentence_template"] = _with("people", "rfm", "cat_pivot", body=f"""
SELECT customer_id, {_sentence_sql()} AS human_template FROM (
  SELECT p.customer_id, c_mktsegment AS segment, coalesce(recency, 0) AS recency, coalesce(purchase_day, 0) AS purchase_day,
         coalesce(total_sales, 0.0::DOUBLE) AS total_sales, coalesce(customer_lifetime, 0) AS customer_lifetime,
         coalesce(promo, 0.0::DOUBLE) AS promo
  FROM people p LEFT JOIN rfm USING (customer_id) LEFT JOIN cat_pivot USING (customer_id))""")
SQL["numeric_template"] = _with("rcust", body=f"""
SELECT customer_id, {numeric_text(retail.NUMERIC_NAMES, ('label',))} AS numerical_template FROM rcust""")
SQL["strip_labels"] = _with("rcust", body=f"""
SELECT customer_id, {numeric_text(retail.NUMERIC_NAMES, ('label',))} || ' ' AS text FROM rcust""")
SQL["clean_reply"] = """
SELECT doc_id, CASE WHEN strpos(lower(r), 'profile:') > 0 THEN substr(r, strpos(lower(r), 'profile:') + 8) ELSE r END AS reply
FROM (SELECT doc_id, replace(CASE WHEN doc_id % 3 = 0 THEN 'Here is the Profile:' || chr(10) ELSE 'Note: ' END || text, chr(10), '') AS r
      FROM documents)"""
SQL["label_codecs"] = """
SELECT doc_id, CASE quality WHEN 1 THEN 'accept' ELSE 'refuse' END AS class_text, quality AS class_number,
       CASE quality WHEN 1 THEN 'accept.' ELSE 'refuse.' END AS label_text, toxic = 1 AS click FROM labels"""
part("brands", [], """
SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
SQL["map_labels"] = _with("brands", body="""
SELECT l_orderkey, array_to_string(list_transform(b, lambda x: 'Category ' || CAST(CAST(replace(x, 'Brand#', '') AS INTEGER) % 5 + 1 AS VARCHAR)), ', ') AS categories
FROM brands""")
SQL["brand_lists"] = _with("brands", body="""
SELECT l_orderkey, array_to_string(list_transform(b, lambda x: replace(x, 'Brand#', '')), ', ') || '.' AS cleaned,
       array_to_string(list_transform(b, lambda x: replace(x, 'Brand#', '')), '|') AS items FROM brands""")
part("loose", [], """
SELECT doc_id, CASE
  WHEN doc_id % 5 = 0 THEN 'response follows, answer: ' || a || '; confidence: ' || s || '% of 200; reason: case ' || doc_id
  WHEN doc_id % 5 = 1 THEN 'Sure: {"answer": "' || a || '", "confidence": "' || s || '", "reason": "case ' || doc_id || '"}'
  WHEN doc_id % 5 = 2 THEN 'I ' || a || ' this'
  ELSE 'The answer is ' || a || ' with confidence ' || s || ' for the reason ' || doc_id || '<|eot_id|>' END AS reply
FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'accept' ELSE 'refuse' END AS a, CAST(doc_id % 130 AS VARCHAR) AS s FROM labels)""")


def confidence(x: str) -> str:
    return (
        f"CAST(coalesce(list_max(list_filter(list_transform(regexp_extract_all({x}, '[0-9]+'), "
        f"lambda d: TRY_CAST(d AS INTEGER)), lambda n: n <= 100)), 0) AS INTEGER)"
    )


SQL["parse_confidence"] = f"SELECT doc_id, {confidence('text')} AS confidence FROM documents"


_class = "CASE WHEN contains(a, 'accept') THEN '1' WHEN contains(a, 'refuse') THEN '0' ELSE '' END"


def _brands(x: str) -> str:
    return f"""array_to_string(string_split(translate(replace({x}, 'brand', ''), chr(39) || ':"{{}}. ', ''), ','), ', ') || '.'"""


def _loose(source: str, key: str = "doc_id", answer: str = _class) -> str:
    """Cut positions; an absent word is position -1 and counts from the end."""
    return f"""
SELECT {key}, {answer} AS answer,
       {confidence('c')} AS confidence, replace(r, '<|eot_id|>', '') AS reason FROM (
  SELECT {key}, substr(reply, s + 1, greatest(ce - s, 0)) AS a,
         substr(reply, ce + 1, greatest(re - ce, 0)) AS c, substr(reply, re + 1) AS r FROM (
    SELECT *, CASE WHEN a0 > 0 AND p0 >= 0 THEN p0 ELSE greatest(a0, 0) END AS s,
           CASE WHEN c0 < 0 THEN length(reply) - 1 ELSE c0 END AS ce,
           CASE WHEN r0 < 0 THEN length(reply) - 1 ELSE r0 END AS re FROM (
      SELECT *, strpos(reply, 'answer') - 1 AS a0, strpos(reply, 'response') - 1 AS p0,
             strpos(reply, 'confidence') - 1 AS c0, strpos(reply, 'reason') - 1 AS r0 FROM {source})))"""


SQL["parse_loose_reply"] = _with("loose", body=_loose("loose"))
part("braced", ["loose"], """
SELECT doc_id, CASE WHEN strpos(reply, '{') > 0 THEN substr(reply, strpos(reply, '{')) ELSE reply END AS reply FROM loose""")
part("loosely", ["braced"], _loose("braced"))
SQL["parse_reply"] = _with("loosely", body=f"""
SELECT doc_id,
       CASE WHEN ok THEN CASE WHEN contains(j->>'answer', 'accept') THEN '1' ELSE '0' END ELSE l.answer END AS answer,
       round(CASE WHEN ok THEN {confidence("(j->>'confidence')")} ELSE l.confidence END * 0.01::DOUBLE, 4) AS confidence,
       CASE WHEN ok THEN j->>'reason' ELSE l.reason END AS reason
FROM (SELECT doc_id, json_valid(reply) AS ok, TRY_CAST(CASE WHEN json_valid(reply) THEN reply END AS JSON) AS j FROM braced)
JOIN loosely l USING (doc_id)""")

part("brand_replies", ["brands"], """
SELECT l_orderkey, CASE
  WHEN l_orderkey % 3 = 0 THEN 'Sure: {"brand": "' || n || '", "confidence": "' || s || '", "reason": "order ' || l_orderkey || '"}'
  WHEN l_orderkey % 3 = 1 THEN 'I like ' || n
  ELSE 'The answer is ' || n || ' with confidence ' || s || ' for the reason ' || l_orderkey || '<|eot_id|>' END AS reply
FROM (SELECT l_orderkey, replace(array_to_string(b, ', '), 'Brand#', 'brand') AS n, CAST(l_orderkey % 130 AS VARCHAR) AS s FROM brands)""")
SQL["parse_loose_brands"] = _with("brand_replies", body=_loose("brand_replies", "l_orderkey", _brands("a")))
part("brand_braced", ["brand_replies"], """
SELECT l_orderkey, CASE WHEN strpos(reply, '{') > 0 THEN substr(reply, strpos(reply, '{')) ELSE reply END AS reply FROM brand_replies""")
part("brand_loosely", ["brand_braced"], _loose("brand_braced", "l_orderkey", _brands("a")))
SQL["parse_brands"] = _with("brand_loosely", body=f"""
SELECT l_orderkey,
       CASE WHEN ok THEN {_brands("(j->>'brand')")} ELSE l.answer END AS answer,
       round(CASE WHEN ok THEN {confidence("(j->>'confidence')")} ELSE l.confidence END * 0.01::DOUBLE, 4) AS confidence,
       CASE WHEN ok THEN j->>'reason' ELSE l.reason END AS reason
FROM (SELECT l_orderkey, json_valid(reply) AS ok, TRY_CAST(CASE WHEN json_valid(reply) THEN reply END AS JSON) AS j FROM brand_braced)
JOIN brand_loosely l USING (l_orderkey)""")

# Prompts and replies -------------------------------------------------------


def _chunks(source: str, key: str = "customer_id") -> str:
    size, chunk = retail.SETTINGS.batch_size, CHUNK
    per = -(-size // chunk)
    return f"""
SELECT * EXCLUDE (z), CAST(z // {size} AS BIGINT) AS window_no,
       CAST((z // {size}) * {per} + (z % {size}) // {chunk} AS BIGINT) AS chunk_no,
       CAST((z % {size}) % {chunk} + 1 AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (ORDER BY {hashed(key, 112)}) - 1 AS z FROM {source})"""


part("chunks", ["people"], _chunks("(SELECT customer_id, c_acctbal, c_mktsegment FROM people)"))
part("pchunks", ["profiles"], _chunks("profiles"))
SQL["chunk_assign"] = _with("chunks", body="SELECT customer_id, window_no, chunk_no, position FROM chunks")


def _gather(text: str, source: str, out: str = "prompt") -> str:
    return f"""SELECT chunk_no, string_agg({text}, chr(10) || chr(10) ORDER BY position) AS {out}, CAST(count(*) AS INTEGER) AS rows
FROM {source} GROUP BY chunk_no"""


_profile_line = "'Customer ' || customer_id || ': ' || template_profile"
_prediction_line = (
    "'Customer ' || customer_id || ':' || chr(10) || 'Profile: ' || template_profile || chr(10) || "
    "'Treatment: ' || template_treatment"
)
SQL["profile_prompt"] = _with("pchunks", body=_gather(_profile_line, "pchunks"))
part("pprompts", ["pchunks"], _gather(_prediction_line, "pchunks"))
SQL["prediction_prompt"] = _with("pprompts", body="SELECT * FROM pprompts")
SQL["prompt_size"] = _with("pchunks", body=f"""
SELECT chunk_no, chars, chars // 4 AS tokens FROM (
  SELECT chunk_no, CAST(length(prompt) + {len(retail.SYSTEM_TEXT)} AS BIGINT) AS chars FROM ({_gather(_profile_line, 'pchunks')}))""")
part("rprofiles", ["rcust"], f"""
SELECT customer_id, {profile_sql(retail.PROFILE_SPECS)} AS profile,
       'Promotion offered: ' || promotion || '.' AS treatment, {_out_text} AS outcome FROM rcust""")
part("examples", ["near_other", "rprofiles"], """
SELECT query_id, ref_id, rank, exp(-val) AS score, profile, treatment, outcome
FROM near_other JOIN rprofiles ON customer_id = ref_id""")
SQL["fewshot_examples"] = _with("examples", body="SELECT * REPLACE (round(score, 6) AS score) FROM examples")
part("sections", ["examples"], f"""
SELECT query_id, 'Similar Examples for Customer ' || query_id || ':' || chr(10) || string_agg(
  chr(10) || 'Example ' || rank || ' (similarity: ' || {plain('score', 3)} || '):' || chr(10) || 'Profile: ' || profile || chr(10) ||
  'Treatment: ' || treatment || chr(10) || 'Actual Outcomes: ' || outcome, chr(10) ORDER BY rank) AS examples
FROM examples GROUP BY query_id""")
part("rchunks", ["rprofiles"], _chunks("(SELECT customer_id, profile AS template_profile, treatment AS template_treatment FROM rprofiles)"))
part("blocks", ["sections", "rchunks"], _gather("examples", "(SELECT * FROM rchunks JOIN sections ON query_id = customer_id)", "examples"))
SQL["fewshot_block"] = _with("blocks", body="SELECT * FROM blocks")


def _reply_format() -> str:
    from shopcast.operators.prompts import reply_format

    return reply_format(retail.OUTCOME_SPECS)


part("rprompts", ["rchunks"], _gather(_prediction_line, "rchunks"))
part("rodist", ["rcust"], f"""
SELECT {_text(retail.OUTCOME_CONTEXT)} || chr(10) || chr(10) || body AS distribution
FROM ({numeric_bodies([retail.OUTCOME_SPECS[0]], 'rcust')})""")
_asked = f"""'Customer profiles:' || chr(10) || prompt || chr(10) || chr(10) ||
       {_text('Reply with a JSON array, one object per customer with customer_id. ' + _reply_format())} AS prompt, p.rows"""
_system = f"{_text(retail.SYSTEM_TEXT)} || chr(10) || chr(10)"
SQL["prompt_layouts"] = _with("rprompts", "blocks", "rodist", body=f"""
SELECT p.chunk_no, 'distribution' AS layout,
       {_system} || 'Outcome distribution:' || chr(10) || distribution || chr(10) || chr(10) || {_asked} FROM rprompts p, rodist
UNION ALL SELECT p.chunk_no, 'examples',
       {_system} || 'Similar examples:' || chr(10) || examples || chr(10) || chr(10) || {_asked} FROM rprompts p JOIN blocks USING (chunk_no)
UNION ALL SELECT p.chunk_no, 'profiles', {_system} || {_asked} FROM rprompts p""")
SQL["prompt_context"] = _with("rprompts", "blocks", "rodist", body=f"""
SELECT p.chunk_no, {_text(retail.SYSTEM_TEXT)} || chr(10) || chr(10) || 'Outcome distribution:' || chr(10) || distribution ||
       chr(10) || chr(10) || 'Similar examples:' || chr(10) || examples || chr(10) || chr(10) ||
       'Customer profiles:' || chr(10) || prompt || chr(10) || chr(10) ||
       {_text('Reply with a JSON array, one object per customer with customer_id. ' + _reply_format())} AS prompt, p.rows
FROM rprompts p JOIN blocks USING (chunk_no), rodist""")

_num = "CAST(customer_id AS BIGINT)"


def _one(ident: str, body: str) -> str:
    return f"'{{\"customer_id\": \"' || {ident} || '\", \"narrative_profile\": \"' || {body} || '\"}}'"


_body = "'Spends on ' || c_mktsegment"
_entry = f"""CASE WHEN {_num} % 11 = 0 THEN NULL WHEN {_num} % 11 = 1 THEN {_one('customer_id', "''")}
WHEN {_num} % 11 = 2 THEN {_one('customer_id', _body)} || ', ' || {_one('customer_id', "'second entry'")}
WHEN {_num} % 11 = 3 THEN {_one("'x' || customer_id", _body)} ELSE {_one('customer_id', _body)} END"""


def _reply_text(entry: str) -> str:
    return f"""
SELECT chunk_no, CASE chunk_no % 7 WHEN 0 THEN '[' || left(body, length(body) - 4)
  WHEN 1 THEN 'Here is the list:' || chr(10) || '[' || body || ']' || chr(10) || 'That is all.' ELSE '[' || body || ']' END AS reply
FROM (SELECT chunk_no, coalesce(string_agg(e, ', ' ORDER BY position), '') AS body FROM (SELECT *, {entry} AS e FROM chunks) GROUP BY chunk_no)"""


def _parsed(source: str, fields: list[str]) -> str:
    picked = ", ".join(f"item->>'{f}' AS {f}" for f in fields)
    return f"""
SELECT chunk_no, CAST(entry AS INTEGER) AS entry, {picked} FROM (
  SELECT chunk_no, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS entry FROM (
    SELECT chunk_no, CASE WHEN json_valid(body) THEN CAST(CAST(body AS JSON) AS JSON[])
                          WHEN json_valid(fixed) THEN CAST(CAST(fixed AS JSON) AS JSON[]) END AS items FROM (
      SELECT chunk_no, body, regexp_replace(body, '([0-9]),([0-9][0-9][0-9])', '\\1\\2', 'g') AS fixed FROM (
        SELECT chunk_no, CASE WHEN regexp_matches(reply, '\\[.*\\]', 's') THEN regexp_extract(reply, '\\[.*\\]', 0, 's') ELSE trim(reply) END AS body
        FROM {source}))))"""


part("nreplies", ["chunks"], _reply_text(_entry))
part("nparsed", ["nreplies"], _parsed("nreplies", ["customer_id", "narrative_profile"]))
SQL["extract_json_array"] = _with("nparsed", body="SELECT * FROM nparsed")
SQL["reconcile_replies"] = _with("nparsed", body="""
SELECT c.chunk_no, c.customer_id, p.narrative_profile, p.customer_id IS NOT NULL AS matched
FROM chunks c LEFT JOIN nparsed p ON p.chunk_no = c.chunk_no AND p.customer_id = c.customer_id""")
part("nfirst", ["nparsed"], """
SELECT chunk_no, customer_id, arg_min(narrative_profile, entry) AS narrative_profile
FROM nparsed WHERE narrative_profile <> '' GROUP BY 1, 2""")
_template = "'[Segment Domain] Segment: ' || c_mktsegment || '.'"
SQL["narrative_profiles"] = _with("nfirst", body=f"""
SELECT c.customer_id, coalesce(p.narrative_profile, {_template}) || chr(10) || {_template} AS narrative_profile,
       p.customer_id IS NULL AS is_fallback
FROM chunks c LEFT JOIN nfirst p ON p.chunk_no = c.chunk_no AND p.customer_id = c.customer_id""")
SQL["fallback_report"] = _with("nparsed", body="""
SELECT c.chunk_no, count(*) AS expected, coalesce(any_value(r.received), 0) AS received,
       count(*) FILTER (p.customer_id IS NULL) AS fallbacks
FROM chunks c LEFT JOIN (SELECT DISTINCT chunk_no, customer_id FROM nparsed) p ON p.chunk_no = c.chunk_no AND p.customer_id = c.customer_id
LEFT JOIN (SELECT chunk_no, count(*) AS received FROM nparsed GROUP BY 1) r ON r.chunk_no = c.chunk_no GROUP BY c.chunk_no""")
_amount = f"""CASE {_num} % 7 WHEN 0 THEN '"unknown"' WHEN 1 THEN 'null' WHEN 2 THEN format('{{:,}}', CAST(round_even(c_acctbal, 0) AS BIGINT))
ELSE '"' || c_acctbal || '"' END"""
_conf = f"""CASE {_num} % 6 WHEN 0 THEN '1.7' WHEN 1 THEN '-1' WHEN 2 THEN '"high"' WHEN 3 THEN 'null' ELSE '0.25' END"""
_pentry = f"""CASE WHEN {_num} % 11 <> 0 THEN '{{"customer_id": "' || customer_id || '", "pred_target_sales": ' || {_amount} ||
', "pred_target_categories": "' || c_mktsegment || '", "pred_confidence": ' || {_conf} || ', "pred_reasoning": "row ' || customer_id || '"}}' END"""
_pfields = ["pred_target_sales", "pred_target_categories", "pred_confidence", "pred_reasoning"]
part("preplies", ["chunks"], _reply_text(_pentry))
part("pparsed", ["preplies"], _parsed("preplies", ["customer_id", *_pfields]))
part("pvalid", ["pparsed"], """
SELECT chunk_no, entry, customer_id, coalesce(TRY_CAST(pred_target_sales AS DOUBLE), 0.0::DOUBLE) AS pred_target_sales,
       coalesce(pred_target_categories, '') AS pred_target_categories,
       CASE WHEN TRY_CAST(pred_confidence AS DOUBLE) IS NULL THEN 0.5::DOUBLE
            ELSE least(greatest(TRY_CAST(pred_confidence AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) END AS pred_confidence,
       coalesce(pred_reasoning, 'No reasoning provided') AS pred_reasoning FROM pparsed""")
SQL["validate_predictions"] = _with("pvalid", body=f"SELECT customer_id, {', '.join(_pfields)} FROM pvalid")
SQL["predictions"] = _with("pvalid", body="""
SELECT c.customer_id, c.chunk_no, coalesce(pred_target_sales, 0.0::DOUBLE) AS pred_target_sales,
       coalesce(pred_target_categories, '') AS pred_target_categories, coalesce(pred_confidence, 0.0::DOUBLE) AS pred_confidence,
       coalesce(pred_reasoning, 'Fallback prediction due to processing error') AS pred_reasoning, p.customer_id IS NULL AS is_fallback
FROM chunks c LEFT JOIN (SELECT * FROM pvalid QUALIFY row_number() OVER (PARTITION BY chunk_no, customer_id ORDER BY entry) = 1) p
ON p.chunk_no = c.chunk_no AND p.customer_id = c.customer_id""")
SQL["category_lines"] = """
SELECT CAST(p_partkey AS VARCHAR) AS stock_code, p_name || ' ' || p_partkey AS description,
       CASE WHEN p_partkey % 9 <> 0 THEN p_type ELSE 'Others' END AS category FROM part"""
SQL["resume_pending"] = """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
SQL["ft_export_cls"] = _with("rcust", body=f"""
SELECT {_text(retail.SYSTEM_TEXT)} AS instruction, {numeric_text(retail.NUMERIC_NAMES, ('label',))} AS input,
       CASE label WHEN 1 THEN 'accept.' ELSE 'refuse.' END AS output FROM rcust""")
SQL["ft_export_rec"] = _with("rcust", body=f"""
SELECT {_text(retail.SYSTEM_TEXT)} AS system, {numeric_text(retail.NUMERIC_NAMES, ('label',))} AS query,
       replace(target_categories, '|', ', ') || '.' AS response, label = 1 AS label FROM rcust""")

# Evaluation ----------------------------------------------------------------

part("scored", [], "SELECT doc_id, quality, toxic, (doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM labels")
SQL["binary_metrics"] = _with("scored", body="""
SELECT round((tp + tn) / n, 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1_score,
       round(brier, 8) AS brier_score_loss, 0.5::DOUBLE AS threshold
FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (quality = 1 AND score >= 0.5) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (quality = 0 AND score >= 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (quality = 1 AND score < 0.5) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (quality = 0 AND score < 0.5) AS DOUBLE) AS tn, avg((score - quality) * (score - quality)) AS brier FROM scored)""")
part("by_score", ["scored"], """
SELECT score, CAST(sum(quality) AS DOUBLE) AS p, CAST(sum(1 - quality) AS DOUBLE) AS n FROM scored GROUP BY 1""")
part("curve", ["by_score"], """
SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pt, sum(n) OVER () AS nt
FROM by_score WINDOW w AS (ORDER BY score DESC)""")
part("points", ["curve"], """
SELECT *, tp / (tp + fp) AS prec, coalesce(lag(tp / (tp + fp)) OVER (ORDER BY score DESC), 1.0) AS prev FROM curve""")
SQL["roc_pr_auc"] = _with("points", body="""
SELECT round(sum(n * (tp - p + p / 2)) / (any_value(pt) * any_value(nt)), 8) AS roc_auc,
       round(sum(p * (prec + prev) / 2) / any_value(pt), 8) AS pr_auc FROM points""")
SQL["classification_report"] = """
WITH r AS (SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'F' WHEN o_orderkey % 7 = 1 THEN 'P' ELSE o_orderstatus END AS p FROM orders),
k AS (SELECT y AS class FROM r UNION SELECT p FROM r),
c AS (SELECT class, count(*) FILTER (y = class AND p = class) AS tp, count(*) FILTER (p = class) AS chosen,
             count(*) FILTER (y = class) AS support FROM k, r GROUP BY class),
m AS (SELECT class, tp, support, coalesce(tp / nullif(CAST(chosen AS DOUBLE), 0), 0) AS precision,
             coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0) AS recall,
             coalesce(2 * tp / nullif(CAST(chosen + support AS DOUBLE), 0), 0) AS f1 FROM c)
SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1_score, support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / CAST(sum(support) AS DOUBLE), 8), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 8), round(avg(recall), 8), round(avg(f1), 8), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8), round(sum(recall * support) / sum(support), 8),
                 round(sum(f1 * support) / sum(support), 8), CAST(sum(support) AS BIGINT) FROM m"""
part("predicted", ["ftx", "osales", "rates"], """
SELECT customer_id, round(coalesce(s, 0.0), 2) AS actual, round(f, 2) / 3 AS predicted, avg_purchase_value AS baseline
FROM (SELECT customer_id, sum(sales) AS f FROM ftx GROUP BY 1) LEFT JOIN osales USING (customer_id) JOIN rates USING (customer_id)""")
SQL["regression_errors"] = _with("predicted", body=" UNION ALL ".join(
    f"""SELECT '{m}' AS model, round(avg((actual - {m}) * (actual - {m})), 2) AS mse, round(avg(abs(actual - {m})), 4) AS mae FROM predicted"""
    for m in ("predicted", "baseline")))
SQL["baseline_errors"] = _with("rcust", "split", body="""
SELECT split, count(*) AS scored, true AS helps FROM rcust JOIN split USING (customer_id)
WHERE split <> 'test' GROUP BY split""")
SQL["confusion_matrix"] = _with("scored", body="""
SELECT toxic AS actual, CAST(score >= 0.3 AS INTEGER) AS predicted, count(*) AS cnt,
       round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY toxic) AS DOUBLE), 8) AS share FROM scored GROUP BY 1, 2""")


def _calibration(edges: str) -> str:
    return f"""
SELECT CAST(len(list_filter(({edges}), lambda e: e < score)) AS INTEGER) AS bin, round(avg(score), 8) AS mean_predicted,
       round(avg(quality), 8) AS share_positive, count(*) AS cnt FROM scored GROUP BY 1"""


SQL["calibration_uniform"] = _with("scored", body=_calibration(
    "[" + ", ".join(f"{i * (1.0 / 20)!r}::DOUBLE" for i in range(1, 20)) + "]"))
SQL["calibration_quantile"] = _with("scored", body=_calibration(
    "SELECT quantile_cont(score, [" + ", ".join(f"{i / 10!r}" for i in range(1, 10)) + "]) FROM scored"))
SQL["sales_histogram"] = _with("predicted", body=" UNION ALL ".join(
    f"""SELECT '{c}' AS series, CAST(least(floor(({c} - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin, count(*) AS cnt
FROM predicted, (SELECT min({c}) AS lo, max({c}) AS hi FROM predicted) GROUP BY 2"""
    for c in ("actual", "predicted", "baseline")))
SQL["rec_report"] = """
SELECT round(avg(CAST(list_sort(a) = list_sort(p) AS DOUBLE)), 8) AS exact_match,
       round(avg(len(list_intersect(a, p)) / CAST(len(a) AS DOUBLE) * click), 8) AS expected_ctr, round(avg(click), 8) AS true_ctr
FROM (SELECT list(DISTINCT p_brand) AS a, 
             list(DISTINCT CASE WHEN (l_orderkey + l_partkey) % 5 = 0 THEN 'Brand#11' ELSE p_brand END) AS p,
             max(CAST(l_returnflag = 'R' AS INTEGER)) AS click
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""

# Model calls with the made model functions ---------------------------------

part("pplain", ["pchunks"], _gather(_profile_line, "pchunks"))
SQL["narrative_stub"] = _with("pplain", body=f"""
SELECT customer_id, CASE WHEN lost THEN template_profile ELSE 'Customer ' || customer_id || ' in words.' END AS narrative_profile,
       lost AS is_fallback
FROM (SELECT customer_id, template_profile,
             length(prompt) % 13 = 0 OR (length(prompt) % 5 = 0 AND position = rows) AS lost
      FROM pchunks JOIN pplain USING (chunk_no))""")
SQL["prediction_stub"] = _with("profiles", body="""
SELECT customer_id, CAST(length(customer_id) AS DOUBLE) AS pred_target_sales, 'SMALL' AS pred_target_categories,
       0.6::DOUBLE AS pred_confidence, 'same for all' AS pred_reasoning, false AS is_fallback FROM profiles""")
SQL["narratives"] = _with("rprofiles", body="""
SELECT customer_id, CASE WHEN lost THEN template_profile ELSE 'Customer ' || customer_id || ' in words.' END AS narrative_profile,
       lost AS is_fallback
FROM (SELECT customer_id, profile AS template_profile, CAST(customer_id AS BIGINT) % 11 = 0 AS lost FROM rprofiles)""")


def _by_train(c: str) -> str:
    v = f"coalesce(CAST({c} AS DOUBLE), 0)"
    mean, std = (f"{f}({v}) FILTER (split = 'train') OVER ()" for f in ("avg", "stddev_pop"))
    return f"({v} - {mean}) / CASE WHEN {std} = 0 THEN 1 ELSE {std} END"


part("ztrain", ["rcust", "split"], f"""
SELECT customer_id AS id, split, [{', '.join(_by_train(c) for c in _SIM)}] AS v
FROM rcust JOIN (SELECT customer_id, split FROM split) USING (customer_id)""")
_pairs("near_train", ["ztrain"], "(SELECT * FROM ztrain WHERE split = 'test')", _euclid, 3,
       refs="(SELECT * FROM ztrain WHERE split = 'train')")
SQL["fewshot_predictions"] = _with("near_train", "rprofiles", body="""
SELECT query_id AS customer_id, CAST(count(*) AS DOUBLE) AS pred_target_sales,
       max(outcome) FILTER (rank = 1) AS pred_target_categories, false AS is_fallback
FROM near_train JOIN rprofiles ON customer_id = ref_id GROUP BY query_id""")
SQL["adaptive_resumed"] = _with("rcust", body=f"""
SELECT customer_id, CASE WHEN CAST(customer_id AS BIGINT) % 3 > 0 THEN 'first ' ELSE 'second ' END ||
       lower({numeric_text(retail.NUMERIC_NAMES, ('label',))} || ' ') AS adaptive_template FROM rcust""")
SQL["adaptive_stub"] = _with("rcust", body=f"""
SELECT customer_id, lower({numeric_text(retail.NUMERIC_NAMES, ('label',))} || ' ') AS adaptive_template FROM rcust""")
_percent = "CASE promotion " + " ".join(
    f"WHEN '{t}' THEN {t.rsplit(' ', 1)[1].rstrip('%') if t.endswith('%') else 0}" for t in retail.TREATMENTS) + " END"
SQL["counterfactual_predictions"] = _with("people", body=f"""
SELECT customer_id, promotion, CASE WHEN lost THEN 0.0::DOUBLE ELSE CAST(c_custkey % 100 + {_percent} AS DOUBLE) END AS pred_target_sales,
       CASE WHEN NOT lost THEN CAST({_percent} AS DOUBLE) END AS effect_target_sales, lost AS is_fallback
FROM (SELECT customer_id, c_custkey, c_custkey % 11 = 0 AS lost FROM people)
CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in retail.TREATMENTS)}) t(promotion)""")
SQL["resume_prompts"] = _with("people", body="""
SELECT c_custkey, CASE WHEN c_nationkey < 20 AND c_custkey % 7 <> 0 THEN 'first: ' ELSE 'second: ' END ||
       customer_id || ' ' || c_mktsegment AS reply FROM people""")

# Sinks ---------------------------------------------------------------------

SQL["parquet_sink"] = "SELECT * EXCLUDE (o_orderdate) FROM orders"
SQL["csv_sink"] = """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_acctbal, '["' || c_mktsegment || '","a \\"quoted\\", one"]' AS listed FROM customer"""
SQL["json_sink"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS open_price FROM orders"
