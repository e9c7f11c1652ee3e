"""Queries: profiles, contracts, drift, splits, merging, freshness."""

from pyspark.sql import functions as F

from ..operators import drift, quality, splits
from ..sources.tables import read_contract
from .bindings import table
from .registry import query

BORDER = "1998-01-01"
LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate"]


def _profile_sql(relation, numbers, others):
    parts = [f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count({c}) AS n,
      round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, min({c}::DOUBLE) AS low,
      round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
      round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c}::DOUBLE) AS high FROM {relation}""" for c in numbers]
    parts += [f"""SELECT '{c}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM {relation}""" for c in others]
    return " UNION ALL ".join(parts)


def _profiled(df):
    rounded = [F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")]
    return quality.profile(df).select("column", "rows", "nulls", F.col("count").alias("n"), F.round("mean", 6).alias("mean"),
                                      F.round("std", 6).alias("std"), F.col("min").alias("low"), *rounded, F.col("max").alias("high"))


@query(_profile_sql("lineitem", LINEITEM_NUMBERS, LINEITEM_TEXTS))
def profile(spark, d):
    return _profiled(table(spark, d, "lineitem"))


@query(_profile_sql("events", ["event_id", "user_id", "value"], ["ts", "event_type", "props"]))
def profile_events(spark, d):
    return _profiled(table(spark, d, "events"))


def _document_stats():
    widths = {"doc_id": "8", "n_chars": "8"}
    parts = []
    for i, (c, kind) in enumerate([("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]):
        size = f"count({c}) * {widths[c]}" if c in widths else f"sum(strlen({c}))"
        parts.append(f"""SELECT '{c}' AS "column", {i} AS position, '{kind}' AS dtype, count(*) AS rows,
          count(*) - count({c}) AS nulls, CAST({size} AS BIGINT) AS bytes FROM documents""")
    return " UNION ALL ".join(parts)


@query(_document_stats())
def dataset_stats(spark, d):
    return quality.dataset_stats(table(spark, d, "documents"))


CONTRACT = """
columns:
  l_orderkey: int64
  l_quantity: float64
  l_returnflag: object
  l_linestatus: string
  l_shipdate: datetime64[ns]
  l_linenumber: int64
  l_tax: object
  l_comment: str
"""


@query("""
WITH contract(name, expected, fits) AS (VALUES
  ('l_orderkey', 'int64', ['BIGINT']), ('l_quantity', 'float64', ['DOUBLE']), ('l_returnflag', 'object', ['VARCHAR']),
  ('l_linestatus', 'string', ['VARCHAR']), ('l_shipdate', 'datetime64[ns]', ['TIMESTAMP', 'TIMESTAMP_NS']),
  ('l_linenumber', 'int64', ['BIGINT']), ('l_tax', 'object', ['VARCHAR']), ('l_comment', 'str', ['VARCHAR'])),
spelled(kind, spark) AS (VALUES ('BIGINT', 'bigint'), ('INTEGER', 'int'), ('DOUBLE', 'double'), ('VARCHAR', 'string'),
  ('TIMESTAMP', 'timestamp_ntz'), ('TIMESTAMP_NS', 'timestamp_ntz'))
SELECT c.name AS "column", CASE WHEN t.column_name IS NULL THEN 'missing' ELSE 'dtype_mismatch' END AS error,
       CASE WHEN t.column_name IS NOT NULL THEN c.expected END AS expected, s.spark AS actual
FROM contract c LEFT JOIN (SELECT column_name, column_type FROM (DESCRIBE lineitem)) t ON t.column_name = c.name
LEFT JOIN spelled s ON s.kind = t.column_type
WHERE t.column_name IS NULL OR NOT list_contains(c.fits, t.column_type)""")
def validate_schema(spark, d):
    return quality.validate_schema(table(spark, d, "lineitem"), read_contract(spark, CONTRACT))


# --- drift

_P = """CASE WHEN lam < 0.2::DOUBLE THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * lam * lam))))) END"""


def _ks_sql(source, columns):
    """``source`` selects the columns and ``side`` (0 reference, 1 candidate)."""
    values = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::DOUBLE AS v, side FROM s WHERE {c} IS NOT NULL" for c in columns)
    return f"""s AS ({source}), long AS ({values}),
counted AS (SELECT col, v, sum(1 - side) AS r, sum(side) AS c FROM long GROUP BY col, v),
running AS (SELECT col, sum(r) OVER w AS cr, sum(c) OVER w AS cc FROM counted
            WINDOW w AS (PARTITION BY col ORDER BY v ROWS UNBOUNDED PRECEDING)),
sizes AS (SELECT col, CAST(sum(r) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS m FROM counted GROUP BY col),
ks AS (SELECT z.col, n, m, max(abs(cr::DOUBLE / n - cc::DOUBLE / m)) AS stat FROM sizes z JOIN running USING (col) GROUP BY z.col, n, m),
tested AS (SELECT *, {_P} AS p FROM (SELECT *, stat * sqrt(n::DOUBLE * m / (n::DOUBLE + m)) AS lam FROM ks))"""


def _l1_sql(source, columns):
    values = " UNION ALL ".join(f"SELECT '{c}' AS col, coalesce(CAST({c} AS VARCHAR), '<null>') AS v, side FROM t" for c in columns)
    return f"""t AS ({source}), cats AS ({values}),
freq AS (SELECT col, v, CAST(sum(1 - side) AS DOUBLE) / (SELECT count(*) FROM t WHERE side = 0) AS a,
                CAST(sum(side) AS DOUBLE) / (SELECT count(*) FROM t WHERE side = 1) AS b FROM cats GROUP BY col, v),
dist AS (SELECT col, sum(abs(a - b)) AS d FROM freq GROUP BY col)"""


LINEITEM_SIDES = f"SELECT *, CASE WHEN l_shipdate < TIMESTAMP '{BORDER}' THEN 0 ELSE 1 END AS side FROM lineitem"
PRICE_SIDES = "SELECT *, CASE WHEN l_quantity < 25 THEN 0 ELSE 1 END AS side FROM lineitem"


def _sides(spark, d):
    rows = table(spark, d, "lineitem")
    border = F.lit(BORDER).cast("timestamp_ntz")
    return rows.filter(F.col("l_shipdate") < border), rows.filter(F.col("l_shipdate") >= border)


_KS_OUT = 'SELECT col AS "column", n, m, round(stat, 12) AS ks_statistic, round(p, 9) AS p_value FROM tested'


def _ks(report):
    return report.select("column", "n", "m", F.round("ks_statistic", 12).alias("ks_statistic"), F.round("p_value", 9).alias("p_value"))


@query(f"WITH {_ks_sql(LINEITEM_SIDES, LINEITEM_NUMBERS)} {_KS_OUT}")
def drift_numeric(spark, d):
    return _ks(drift.drift_numeric(*_sides(spark, d), LINEITEM_NUMBERS))


@query(f"WITH {_ks_sql(PRICE_SIDES, ['l_extendedprice', 'l_tax'])} {_KS_OUT}")
def drift_numeric_shifted(spark, d):
    rows = table(spark, d, "lineitem")
    return _ks(drift.drift_numeric(rows.filter("l_quantity < 25"), rows.filter("l_quantity >= 25"), ["l_extendedprice", "l_tax"]))


@query(f"""WITH {_l1_sql(LINEITEM_SIDES, ['l_returnflag', 'l_linestatus'])}
SELECT col AS "column", round(d, 12) AS frequency_distance FROM dist""")
def drift_categorical(spark, d):
    return drift.drift_categorical(*_sides(spark, d), ["l_returnflag", "l_linestatus"]).select(
        "column", F.round("frequency_distance", 12).alias("frequency_distance"))


@query(f"""WITH {_l1_sql("SELECT event_type, 0 AS side FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_type, 1 FROM events", ['event_type'])}
SELECT col AS "column", round(d, 12) AS frequency_distance, d > 0.2 AS drift_detected FROM dist""")
def drift_categorical_shifted(spark, d):
    events = table(spark, d, "events").select("event_type")
    report = drift.drift_report(events.filter(F.col("event_type").isin("click", "view")), events)
    return report.select("column", F.round("frequency_distance", 12).alias("frequency_distance"), "drift_detected")


@query(f"""WITH {_ks_sql(LINEITEM_SIDES, LINEITEM_NUMBERS)}, {_l1_sql(LINEITEM_SIDES, ['l_returnflag', 'l_linestatus'])}
SELECT col AS "column", 'numeric' AS type, round(stat, 12) AS ks_statistic, round(p, 9) AS p_value,
       CAST(NULL AS DOUBLE) AS frequency_distance, p < 0.05 AS drift_detected, CAST(NULL AS VARCHAR) AS reason FROM tested
UNION ALL SELECT col, 'categorical', NULL, NULL, round(d, 12), d > 0.2, NULL FROM dist""")
def drift_report(spark, d):
    reference, candidate = (side.drop("l_shipdate") for side in _sides(spark, d))
    return drift.drift_report(reference, candidate).select(
        "column", "type", F.round("ks_statistic", 12).alias("ks_statistic"), F.round("p_value", 9).alias("p_value"),
        F.round("frequency_distance", 12).alias("frequency_distance"), "drift_detected", "reason")


# --- splits

@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42')) AS rank, count(*) OVER () AS n FROM documents),
s AS (SELECT *, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS n_train FROM r),
u AS (SELECT *, CAST(ceil((n - n_train) * (0.15::DOUBLE / (0.15::DOUBLE + 0.15::DOUBLE))) AS BIGINT) AS n_test FROM s)
SELECT doc_id, CASE WHEN rank <= n_train THEN 'train' WHEN rank <= n - n_test THEN 'val' ELSE 'test' END AS split FROM u""")
def split(spark, d):
    return splits.split(table(spark, d, "documents").select("doc_id"), ["doc_id"])


def _quota_sql(name, source, count, target):
    return f"""{name} AS (SELECT q.*, base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, st) <= target - sum(base) OVER () THEN 1 ELSE 0 END AS {name}_n
  FROM (SELECT *, {target} AS target, ({target}) * {count} // nullif(sum({count}) OVER (), 0) AS base,
               ({target}) * {count} % nullif(sum({count}) OVER (), 0) AS remainder FROM {source}) q)"""


@query(f"""
WITH strata AS (SELECT '=' || lang AS st, CAST(count(*) AS HUGEINT) AS c FROM documents GROUP BY lang),
{_quota_sql('tr', 'strata', 'c', "CAST(floor(sum(c) OVER () * 0.7::DOUBLE) AS HUGEINT)")},
rest AS (SELECT st, c, tr_n, c - tr_n AS r FROM tr),
{_quota_sql('te', 'rest', 'r', "CAST(ceil(CAST(sum(r) OVER () AS DOUBLE) * (0.15::DOUBLE / (0.15::DOUBLE + 0.15::DOUBLE))) AS HUGEINT)")},
ranked AS (SELECT doc_id, lang, '=' || lang AS st, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42')) AS rank FROM documents)
SELECT doc_id, lang, CASE WHEN rank <= tr_n THEN 'train' WHEN rank <= c - te_n THEN 'val' ELSE 'test' END AS split
FROM ranked JOIN te USING (st)""")
def split_stratified(spark, d):
    return splits.split_stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", key=["doc_id"])


@query("""
SELECT split, count(*) AS rows FROM (
  SELECT CASE WHEN rank <= floor(n * 0.8::DOUBLE) THEN 'train'
              WHEN rank <= n - ceil((n - floor(n * 0.8::DOUBLE)) * (0.1::DOUBLE / (0.1::DOUBLE + 0.1::DOUBLE))) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS rank, count(*) OVER () AS n FROM lineitem)) GROUP BY split""")
def split_sizes(spark, d):
    """Sizes when the key repeats: lines of one order share a digest, borders cut through them."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return splits.split_counts(splits.split(rows, ["l_orderkey"], 0.8, 0.1, 0.1))


# --- merge, dedup, sample, freshness

def _parties(spark, d):
    customers = table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = table(spark, d, "supplier").selectExpr(
        "CAST(s_suppkey AS INT) AS id", "s_name AS name", "concat('n', s_nationkey) AS nation", "CAST(s_acctbal AS FLOAT) AS balance")
    return customers, suppliers


@query("""
SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, round(c_acctbal, 2) AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, 'n' || s_nationkey, round(CAST(CAST(s_acctbal AS FLOAT) AS DOUBLE), 2), NULL FROM supplier""")
def merge(spark, d):
    return quality.merge(list(_parties(spark, d))).withColumn("balance", F.round("balance", 2))


@query("""
SELECT o_orderpriority AS label, o_orderstatus AS state FROM orders UNION
SELECT event_type, NULL FROM events""")
def merge_dedup(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderpriority AS label", "o_orderstatus AS state")
    return quality.merge([orders, table(spark, d, "events").selectExpr("event_type AS label")], deduplicate=True)


@query("SELECT DISTINCT text, lang FROM documents")
def dedup(spark, d):
    return quality.dedup(table(spark, d, "documents").select("text", "lang"))


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", name="sample_rows")
def sample(spark, d):
    orders = table(spark, d, "orders").withColumn("_order", -F.col("o_totalprice"))
    return quality.sample_rows(orders, ["_order", "o_orderkey"], 5).drop("_order")


@query("""
SELECT event_type, last_modified, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_modified))::DOUBLE / 1e6::DOUBLE) AS age_seconds,
       (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_modified))::DOUBLE / 1e6::DOUBLE > 24 * 3600 AS is_stale
FROM (SELECT event_type, max(ts) AS last_modified FROM events GROUP BY event_type)""")
def freshness(spark, d):
    return quality.freshness(table(spark, d, "events"), ["event_type"], "ts", "2024-01-31 00:00:00")
