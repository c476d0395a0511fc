"""Queries that bind the operators to the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import dedup, evaluate, families, features, joins, models, order, profile, ranks, rules, search, serve, sparse, split
from ..operators.components import written
from ..sources import files, markup
from . import vehicles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rules and the funnel: orders with their customers.

ORDER_STAGES = ["status", "priority", "price", "balance", "segment"]
ORDER_STAGE_TABLE = [("prefix", "status_", "status"), ("contains", "priority", "priority"), ("prefix", "price_", "price"), ("suffix", "_balance", "balance")]
_REASONS = """r AS (SELECT o_orderkey,
  o_orderstatus = 'P' AS a, o_orderpriority = '5-LOW' AS b, o_totalprice < 20000 AS c, o_totalprice > 450000 AS d,
  c_acctbal < 0 AS e, c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AS f
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def order_reasons(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return rules.with_reasons(o.join(c, o.o_custkey == c.c_custkey, "left"), [
        ("status_partial", F.col("o_orderstatus") == "P"), ("low_priority", F.col("o_orderpriority") == "5-LOW"),
        ("price_too_low", F.col("o_totalprice") < 20000), ("price_too_high", F.col("o_totalprice") > 450000),
        ("negative_balance", F.col("c_acctbal") < 0), ("segment_out_of_scope", F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD"))])


@query(f"""WITH {_REASONS}, x AS (SELECT CASE WHEN a THEN 0 WHEN b THEN 1 WHEN c OR d THEN 2 WHEN e THEN 3 WHEN f THEN 4 ELSE 5 END AS s FROM r),
st(s, stage) AS (VALUES (0, 'status'), (1, 'priority'), (2, 'price'), (3, 'balance'), (4, 'segment')),
n AS (SELECT st.s, stage, count(x.s) AS removed FROM st LEFT JOIN x ON x.s = st.s GROUP BY st.s, stage),
t AS (SELECT count(*) AS total FROM x)
SELECT stage, CAST(total - coalesce(sum(removed) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, removed,
  CAST(total - sum(removed) OVER (ORDER BY s) AS BIGINT) AS after FROM n, t""")
def sequential_funnel(spark, sf_dir):
    return rules.funnel(order_reasons(spark, sf_dir), ORDER_STAGES, lambda r: rules.prefix_stage(r, ORDER_STAGE_TABLE, "segment"))


@query(f"""WITH {_REASONS} SELECT reason, count(*) AS n FROM (
  SELECT unnest([CASE WHEN a THEN 'status_partial' END, CASE WHEN b THEN 'low_priority' END, CASE WHEN c THEN 'price_too_low' END,
    CASE WHEN d THEN 'price_too_high' END, CASE WHEN e THEN 'negative_balance' END, CASE WHEN f THEN 'segment_out_of_scope' END]) AS reason FROM r)
WHERE reason IS NOT NULL GROUP BY reason""")
def rule_reason_counts(spark, sf_dir):
    return rules.reason_counts(order_reasons(spark, sf_dir))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'reviewed_powertrain' WHEN 1 THEN 'raw_integrity' WHEN 2 THEN 'model_year'
  WHEN 3 THEN 'powertrain_metadata' WHEN 4 THEN 'target' WHEN 5 THEN 'phev' ELSE 'engine_specs' END AS stage FROM events""")
def reason_stage(spark, sf_dir):
    names = ["reviewed_powertrain_hybrid:x", "raw_request_not_validated", "model_year_out_of_scope", "invalid_type:trany", "invalid_numeric:comb08", "unknown_phev_boolean", "invalid_numeric:comb08U"]
    e = table(spark, sf_dir, "events").select("event_id")
    reason = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", vehicles.stage_of(reason).alias("stage"))


PART_RULES = "(VALUES ('r1', 'Brand#1', 0, 25, 'bolt', 900.5, NULL), ('r2', 'Brand#1', 20, 50, 'ring|gear', NULL, 4.0), ('r3', 'brand#17', 1, 50, 'widget', 901.1, 12.0), ('r4', 'Brand#4', 5, 9, '', NULL, NULL), ('r5', 'Brand#9', 0, 50, '^red', NULL, 7.0))"
_PARTS = "p AS (SELECT p_partkey, p_brand, p_name, p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size % 13 AS DOUBLE) END AS grade FROM part)"
_RULES = f"ru(rule_id, make, lo, hi, pattern, price_is, grade_is) AS {PART_RULES}"


def _part_rules(spark):
    rows = [("r1", "Brand#1", 0, 25, "bolt", 900.5, None), ("r2", "Brand#1", 20, 50, "ring|gear", None, 4.0), ("r3", "brand#17", 1, 50, "widget", 901.1, 12.0), ("r4", "Brand#4", 5, 9, "", None, None), ("r5", "Brand#9", 0, 50, "^red", None, 7.0)]
    return spark.createDataFrame(rows, "rule_id string, make string, year_min int, year_max int, pattern string, price_is double, grade_is double")


def _rule_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"),
                                               F.when(F.col("p_partkey") % 3 != 0, (F.col("p_size") % 13).cast("double")).alias("grade"))


def _matched(spark, sf_dir, mode):
    out = rules.match_rules(_rule_parts(spark, sf_dir), _part_rules(spark), make="p_brand", name="p_name", year="p_size", engine=[("price", "price_is"), ("grade", "grade_is")], mode=mode)
    return out.select("p_partkey", F.array_join("rule_ids", "|").alias("rule_ids"))


def _match_sql(extra):
    return f"""WITH {_PARTS}, {_RULES}, h AS (SELECT p_partkey, rule_id FROM p JOIN ru ON lower(p_brand) = lower(make) AND p_size BETWEEN lo AND hi AND regexp_matches(p_name, pattern) AND {extra})
SELECT p.p_partkey, coalesce(string_agg(rule_id, '|' ORDER BY rule_id), '') AS rule_ids FROM p LEFT JOIN h ON h.p_partkey = p.p_partkey GROUP BY p.p_partkey"""


@query(_match_sql("(price_is IS NULL OR abs(price - price_is) < 1e-6) AND (grade_is IS NULL OR abs(grade - grade_is) < 1e-6)"))
def rule_table_theta_join(spark, sf_dir):
    return _matched(spark, sf_dir, "full")


@query(_match_sql("((price_is IS NOT NULL AND price IS NULL) OR (grade_is IS NOT NULL AND grade IS NULL)) AND (price_is IS NULL OR price IS NULL OR abs(price - price_is) < 1e-6) AND (grade_is IS NULL OR grade IS NULL OR abs(grade - grade_is) < 1e-6)"))
def rule_missing_engine(spark, sf_dir):
    return _matched(spark, sf_dir, "missing")


@query(f"WITH {_RULES} SELECT p_partkey, EXISTS (SELECT 1 FROM ru WHERE lower(p_brand) = lower(make) AND p_size BETWEEN lo AND hi) AS in_range FROM part")
def rule_range_probe(spark, sf_dir):
    return rules.in_rule_range(table(spark, sf_dir, "part"), _part_rules(spark), make="p_brand", year="p_size").select("p_partkey", "in_range")


# Checked parsing over JSON rebuilt from the events.

_TEXT = """CASE event_id % 12 WHEN 0 THEN ' ' || value || ' ' WHEN 1 THEN '' WHEN 2 THEN '1d' WHEN 3 THEN 'NaN' WHEN 4 THEN 'inf' WHEN 5 THEN '1_0'
  WHEN 6 THEN '12' WHEN 7 THEN '3.5' WHEN 8 THEN '-1e3' WHEN 9 THEN 'oops' WHEN 10 THEN NULL ELSE '+7.' END"""


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'pad' WHEN 1 THEN '' WHEN 2 THEN '1d' WHEN 3 THEN 'NaN' WHEN 4 THEN 'inf' WHEN 5 THEN '1_0'
  WHEN 6 THEN '12' WHEN 7 THEN '3.5' WHEN 8 THEN '-1e3' WHEN 9 THEN 'oops' WHEN 10 THEN NULL ELSE '+7.' END AS s, CAST(user_id AS DOUBLE) AS u FROM events)
SELECT event_id, CASE WHEN s = 'pad' THEN u WHEN s = '1_0' THEN 10.0 WHEN s = '+7.' THEN 7.0 WHEN s IN ('12', '3.5', '-1e3') THEN CAST(s AS DOUBLE) END AS number,
  CASE WHEN s = 'pad' THEN u WHEN s = '1_0' THEN 10.0 WHEN s = '+7.' THEN 7.0 WHEN s IN ('12', '-1e3') THEN CAST(s AS DOUBLE) END AS whole,
  CASE WHEN s IN ('1d', 'NaN', 'inf', 'oops') THEN 'invalid_numeric:x' END AS reason FROM t""")
def checked_number_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    texts = ["", "1d", "NaN", "inf", "1_0", "12", "3.5", "-1e3", "oops", None, "+7."]
    k = (F.col("event_id") % 12).cast("int")
    s = F.when(k == 0, F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit("\t"))).otherwise(F.get(F.array(*map(F.lit, texts)), k - 1))
    v = F.element_at(V.json_map(F.to_json(F.struct(s.alias("x")), {"ignoreNullFields": "false"})), F.lit("x"))
    e = e.withColumn("v", v)
    number, reason = V.checked_number(F.col("v"), "x")
    return e.select("event_id", number.alias("number"), V.checked_number(F.col("v"), "x", True)[0].alias("whole"), reason.alias("reason"))


_FOUR = "CASE event_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN '{\"k\": null}' WHEN 2 THEN '{\"k\": \"  \"}' WHEN 3 THEN '{\"k\": \"v\"}' ELSE props END"


def _four(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_FOUR).alias("j"))


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT json_exists(j, '$.k') THEN '<KEY_ABSENT>' WHEN json_type(j, '$.k') = 'NULL' THEN '<NULL>'
  WHEN json_type(j, '$.k') = 'VARCHAR' AND trim(json_extract_string(j, '$.k')) = '' THEN '<EMPTY>' ELSE '<VALUE>' END AS status FROM (SELECT {_FOUR} AS j FROM events)) GROUP BY status""")
def four_way_missing(spark, sf_dir):
    return _four(spark, sf_dir).select(V.missingness(V.json_map(F.col("j")), "k").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT 'k' AS key, CASE json_type(j, '$.k') WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS type, count(*) AS n
FROM (SELECT {_FOUR} AS j FROM events) WHERE json_exists(j, '$.k') GROUP BY 2""")
def type_histogram(spark, sf_dir):
    return profile.key_types(_four(spark, sf_dir), "j")


@query(f"""WITH s AS (SELECT CASE WHEN NOT json_exists(j, '$.k') THEN '<KEY_ABSENT>' WHEN json_type(j, '$.k') = 'NULL' THEN '<NULL>'
  WHEN json_type(j, '$.k') = 'VARCHAR' AND trim(json_extract_string(j, '$.k')) = '' THEN '<EMPTY>' ELSE '<VALUE>' END AS status FROM (SELECT {_FOUR} AS j FROM events))
SELECT 'k' AS key, status, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'other', '<KEY_ABSENT>', count(*) FROM s""")
def key_presence_matrix(spark, sf_dir):
    return profile.key_presence(_four(spark, sf_dir), "j", ["k", "other"])


@query("""WITH t AS (SELECT event_id, event_id % 9 AS k FROM events)
SELECT event_id, CASE WHEN k IN (0, 3, 6) THEN true WHEN k IN (1, 4, 5) THEN false END AS value, k NOT IN (2, 7) AS known FROM t""")
def bool_parse(spark, sf_dir):
    vals = ['{"b": true}', '{"b": "No"}', '{"b": "maybe"}', '{"b": " YES "}', '{"b": "  "}', '{"b": "0"}', '{"b": "1"}', '{"b": 1}', '{"b": null}']
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(V.json_map(F.get(F.array(*map(F.lit, vals)), (F.col("event_id") % 9).cast("int"))), F.lit("b")).alias("v"))
    value, known = V.parse_boolean(F.col("v"))
    return e.select("event_id", value.alias("value"), known.alias("known"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'b' WHEN 3 THEN NULL ELSE 'a' END AS value,
  CASE WHEN event_id % 4 = 2 THEN 'conflicting_alias:main' END AS reason, CASE WHEN event_id % 4 = 1 THEN 'compatibility_alias:old->main' END AS flag FROM events""")
def alias_conflict_flags(spark, sf_dir):
    vals = ['{"main": "a", "old": "a"}', '{"old": "b"}', '{"main": "a", "old": "b"}', "{}"]
    e = table(spark, sf_dir, "events").select("event_id", V.json_map(F.get(F.array(*map(F.lit, vals)), (F.col("event_id") % 4).cast("int"))).alias("m"))
    value, reason, flag = V.alias_value(F.col("m"), "main", "old")
    return e.select("event_id", F.try_variant_get(value, "$", "string").alias("value"), reason.alias("reason"), flag.alias("flag"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS n_items,
  CASE event_id % 8 WHEN 2 THEN 'A' WHEN 3 THEN 'x,7' WHEN 0 THEN '' WHEN 1 THEN '' END AS texts,
  CASE event_id % 8 WHEN 4 THEN 'no_menu_object' WHEN 5 THEN 'bad_menu_type' WHEN 6 THEN 'bad_item' WHEN 7 THEN 'invalid_json' END AS menu_error FROM events""")
def menu_normalise(spark, sf_dir):
    vals = ["null", '{"menuItem": null}', '{"menuItem": {"text": " A ", "value": "1"}}', '{"menuItem": [{"text": "x", "value": 1}, {"text": 7, "value": "y"}]}', "{}", '{"menuItem": "bad"}', '{"menuItem": [{"text": true, "value": "1"}]}', "{"]
    e = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, vals)), (F.col("event_id") % 8).cast("int")).alias("raw"))
    out = files.menu_items(e, "raw")
    return out.select("event_id", F.when(F.col("items").isNotNull(), F.size("items")).cast("int").alias("n_items"), F.array_join(F.transform("items", lambda i: i["text"]), ",").alias("texts"), "menu_error")


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'key_absent' WHEN 1 THEN 'null' WHEN 2 THEN 'empty' WHEN 3 THEN 'invalid_type' WHEN 4 THEN 'non_numeric'
  WHEN 5 THEN 'nonfinite' WHEN 6 THEN 'nonpositive' WHEN 7 THEN 'valid' ELSE 'valid' END AS status FROM events""")
def target_status(spark, sf_dir):
    vals = ["{}", '{"comb08": null}', '{"comb08": " "}', '{"comb08": {}}', '{"comb08": "oops"}', '{"comb08": "inf"}', '{"comb08": "-1"}', '{"comb08": "30"}', '{"comb08": 28.5}']
    e = table(spark, sf_dir, "events").select("event_id", V.json_map(F.get(F.array(*map(F.lit, vals)), (F.col("event_id") % 9).cast("int"))).alias("m"))
    return e.select("event_id", vehicles.target_status(F.col("m")).alias("status"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'structured_predictor' WHEN 1 THEN 'preserve_original_text_for_final_sanitization' WHEN 2 THEN 'target_or_target_audit_only'
  WHEN 3 THEN 'excluded_from_predictors_leakage_or_output' ELSE 'source_audit_only_excluded_from_predictors' END AS role FROM events""")
def key_disposition(spark, sf_dir):
    names = F.array(*map(F.lit, ["displ", "eng_dscr", "comb08", "UHighwayA", "startStop"]))
    return table(spark, sf_dir, "events").select("event_id", vehicles.key_disposition(F.get(names, (F.col("event_id") % 5).cast("int"))).alias("role"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 235.2145833333333 / (p_size % 10) END AS target FROM part""")
def derived_target(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.positive_ratio(vehicles.LITRES_PER_100KM, (F.col("p_size") % 10).cast("double")).alias("target"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_brand || '  ' || p_name, '\\s+', ' ', 'g'))) AS k, length(lower(p_brand)) || ':' || lower(p_brand) || '|' || lower(p_name) AS model_group FROM part""")
def group_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", V.group_text(F.concat(F.lit(" "), "p_brand", F.lit(" \t"), "p_name", F.lit("\n"))).alias("k"), V.group_key(V.group_text(F.col("p_brand")), V.group_text(F.col("p_name"))).alias("model_group"))


# Profiles.

@query("""SELECT 'c_mktsegment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'region', coalesce(CASE WHEN c_nationkey % 7 <> 0 THEN CAST(c_nationkey AS VARCHAR) END, '<MISSING>'), count(*) FROM customer GROUP BY 2""")
def category_inventory(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_nationkey") % 7 != 0, F.col("c_nationkey")).alias("region"))
    return profile.category_inventory(c, ["c_mktsegment", "region"])


@query("""WITH t AS (SELECT nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_nationkey = 3 THEN '' ELSE c_name END AS name FROM customer)
SELECT 'seg' AS field, count(*) FILTER (WHERE seg IS NULL) AS null_n, count(*) FILTER (WHERE seg = '') AS empty_n, count(*) FILTER (WHERE seg IS NULL OR seg = '') AS missing_n, count(*) FILTER (WHERE seg IS NULL OR seg = '') / count(*) AS fraction FROM t
UNION ALL SELECT 'name', count(*) FILTER (WHERE name IS NULL), count(*) FILTER (WHERE name = ''), count(*) FILTER (WHERE name IS NULL OR name = ''), count(*) FILTER (WHERE name IS NULL OR name = '') / count(*) FROM t""")
def column_missingness(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.when(F.col("c_nationkey") == 3, "").otherwise(F.col("c_name")).alias("name"))
    return profile.column_missingness(c, ["seg", "name"])


@query("""SELECT CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1, 3
UNION ALL SELECT CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END, 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 1, 3""")
def coverage_grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.when(F.col("o_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return profile.coverage(o, "split", ["o_orderstatus", "o_orderpriority"])


@query("SELECT 'o_custkey' AS field, count(DISTINCT o_custkey) AS n_distinct FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders")
def distinct_profile(spark, sf_dir):
    return profile.distinct_profile(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN x IS NULL THEN 'Missing' WHEN x <= 0 THEN 'Invalid' WHEN x <= 2 THEN '(0,2]' WHEN x <= 3 THEN '(2,3]' WHEN x <= 4 THEN '(3,4]' ELSE '(4,+inf)' END AS label
FROM (SELECT CASE WHEN l_linenumber <> 2 THEN l_quantity / 10 - 0.5 END AS x FROM lineitem)) GROUP BY label""")
def right_closed_bins(spark, sf_dir):
    x = F.when(F.col("l_linenumber") != 2, F.col("l_quantity") / 10 - 0.5)
    return table(spark, sf_dir, "lineitem").select(V.right_closed_bins(x, [0, 2, 3, 4]).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def equal_width_hist(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)


@query("SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q, round(unnest(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95])), 6) AS value FROM lineitem")
def quantiles(spark, sf_dir):
    return profile.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("q", F.round("value", 6).alias("value"))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(spark, sf_dir):
    return profile.correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select("n", F.round("r", 6).alias("r"))


@query("SELECT p_type, count(p_retailprice) AS n, round(median(p_retailprice), 6) AS median, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std FROM part GROUP BY p_type")
def group_describe(spark, sf_dir):
    out = profile.describe_groups(table(spark, sf_dir, "part"), "p_type", "p_retailprice")
    return out.select("p_type", "n", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std")])


@query("SELECT year(o_orderdate)::INTEGER AS order_year, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def year_make_coverage(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("order_year"), "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, p_name, count(DISTINCT b) AS n_bases, coalesce(string_agg(DISTINCT b, ' | ' ORDER BY b), '') AS bases, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS years,
  count(*) FILTER (WHERE b IS NULL) AS missing_base FROM (SELECT *, nullif(p_type, 'SMALL') AS b FROM part) GROUP BY p_brand, p_name""")
def family_consistency(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", F.nullif("p_type", F.lit("SMALL")).alias("b"), F.col("p_size").cast("string").alias("y"))
    return profile.group_consistency(p, ["p_brand", "p_name"], "b", "y")


# Logs.

@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_log_entry(spark, sf_dir):
    return order.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY 1)
SELECT b.user_id, coalesce(a.e, b.e) AS e FROM b LEFT JOIN a USING (user_id)""")
def log_fallback_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return joins.overlay(e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("e")), e.groupBy("user_id").agg(F.min("event_id").alias("e")), "user_id")


@query("""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'missing_right' WHEN event_id % 50 = 1 THEN 'differs:event_type' WHEN event_id % 50 = 2 THEN 'differs:value' ELSE 'differs:event_type|differs:value' END AS reasons
FROM events WHERE event_id % 50 IN (0, 1, 2, 3)""")
def log_reconcile(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    k = F.col("event_id") % 50
    b = a.where(k != 0).select("event_id", F.when(k.isin(1, 3), "changed").otherwise(F.col("event_type")).alias("event_type"), F.when(k == 2, None).when(k == 3, F.col("value") + 1).otherwise(F.col("value") + 1e-13).alias("value"))
    return joins.reconcile(a, b, "event_id", ["event_type", "value"], 1e-9)


# Duplicates.

_NORM = "lower(regexp_replace(text, '\\s+', ' ', 'g'))"


def _copies(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2(F.lower(F.regexp_replace("text", r"\s+", " ")).cast("binary"), 256).alias("h"))
    return d


_DUPS = f"""d AS (SELECT doc_id, lang, source, n_chars, sha256({_NORM}) AS h FROM documents),
g AS (SELECT lang, h, count(*) AS size, count(DISTINCT source) AS contents, count(DISTINCT n_chars) > 1 AS conflict FROM d GROUP BY lang, h HAVING count(*) > 1)"""


@query(f"""WITH {_DUPS} SELECT doc_id, size AS candidate_size, conflict AS target_conflict, CASE WHEN contents > 1 THEN 'retained_differences_unresolved' ELSE 'confirmed_complete_equivalence' END AS status
FROM d JOIN g ON d.lang = g.lang AND d.h = g.h""")
def dup_candidates(spark, sf_dir):
    return dedup.candidates(_copies(spark, sf_dir), "doc_id", ["lang", "h"], ["lang", "h", "source"], "n_chars").drop("candidate_group")


@query(f"""WITH {_DUPS}, e AS (SELECT lang, h, source, min(doc_id) AS rep, count(*) AS same FROM d GROUP BY lang, h, source)
SELECT doc_id, rep AS representative_id, doc_id <> rep AS removed, CASE WHEN same > 1 THEN 'complete_equivalence' ELSE 'retain_differences' END AS decision, conflict AS target_conflict
FROM d JOIN g ON d.lang = g.lang AND d.h = g.h JOIN e ON d.lang = e.lang AND d.h = e.h AND d.source = e.source""")
def dup_resolution(spark, sf_dir):
    return dedup.resolution(_copies(spark, sf_dir), "doc_id", ["lang", "h"], ["lang", "h", "source"], "n_chars").drop("candidate_group")


@query("""WITH r AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s, arg_min(o_orderpriority, o_orderkey) AS p, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)
SELECT o.o_custkey AS "group", o_orderkey AS id, k AS reference_id, 'o_orderstatus' AS field, s AS reference_value, o_orderstatus AS member_value FROM orders o JOIN r ON o.o_custkey = r.o_custkey WHERE o_orderkey <> k AND o_orderstatus <> s
UNION ALL SELECT o.o_custkey, o_orderkey, k, 'o_orderpriority', p, o_orderpriority FROM orders o JOIN r ON o.o_custkey = r.o_custkey WHERE o_orderkey <> k AND o_orderpriority <> p""")
def dup_field_diff(spark, sf_dir):
    return dedup.field_diff(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_guard(spark, sf_dir):
    return dedup.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, sha256(coalesce(length(n) || ':' || n, '∅') || '|' || length(c_mktsegment) || ':' || c_mktsegment) AS h FROM (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS n FROM customer)")
def canonical_fingerprint(spark, sf_dir):
    n = F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.fingerprint(n, F.col("c_mktsegment")).alias("h"))


# Joins.

@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN 'missing_right' WHEN o_orderkey % 40 = 1 THEN 'differs:o_totalprice' ELSE 'differs:o_orderstatus' END AS reasons
FROM orders WHERE o_orderkey % 40 IN (0, 1) OR (o_orderkey % 40 = 2 AND o_orderstatus <> 'F')""")
def dataset_reconcile(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey") % 40
    b = a.where(k != 0).select("o_orderkey", F.when(k == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(k == 2, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return joins.reconcile(a, b, "o_orderkey", ["o_totalprice", "o_orderstatus"], 1e-12)


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def cardinality_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    out = joins.one_to_one(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), c, ["n_nationkey"], "left")
    return out.select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def indicator_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return joins.many_to_one(o, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'left' AS side, k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'right', k FROM b WHERE k NOT IN (SELECT k FROM a)""")
def anti_overlap(spark, sf_dir):
    """Customers of other segments without an urgent order, and urgent buyers of that segment."""
    customers = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return joins.set_difference(customers, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k")


# Families.

def _named(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 6 == 0, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(F.col("p_name")).alias("name"),
                                               F.when(F.col("p_partkey") % 6 > 1, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("base"))


_NAMED = "nm AS (SELECT p_partkey, lower(p_brand) AS make, CASE WHEN p_partkey % 6 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name, CASE WHEN p_partkey % 6 > 1 THEN split_part(p_name, ' ', 1) END AS base FROM part)"


@query(f"""WITH {_NAMED}, a AS (SELECT DISTINCT make, name FROM nm WHERE base IS NULL), b AS (SELECT DISTINCT make, base FROM nm WHERE base IS NOT NULL)
SELECT a.make, name, string_agg(base, ' | ' ORDER BY base) AS possible_bases FROM a JOIN b ON a.make = b.make AND (starts_with(name, base || ' ') OR starts_with(base, name || ' ')) GROUP BY a.make, name""")
def prefix_alias_candidates(spark, sf_dir):
    return families.prefix_candidates(_named(spark, sf_dir), "p_brand", "name", "base")


@query(f"""WITH {_NAMED}, k AS (SELECT DISTINCT make, base AS name FROM nm WHERE base IS NOT NULL),
f AS (SELECT p_partkey, nm.make, CASE WHEN nm.make = 'brand#1' AND nm.name = 'red widget' THEN 'widgets' END AS alias, base, nm.name, k.name IS NOT NULL AS exact FROM nm LEFT JOIN k ON nm.make = k.make AND nm.name = k.name)
SELECT p_partkey, make, coalesce(alias, base, name) AS family, length(make) || ':' || make || '|' || coalesce(alias, base, name) AS model_group,
  CASE WHEN alias IS NOT NULL THEN 'explicit_alias' WHEN base IS NOT NULL THEN 'base_model' WHEN exact THEN 'audited_alias' ELSE 'fallback_name' END AS group_source FROM f""")
def family_assignment(spark, sf_dir):
    aliases = spark.createDataFrame([("Brand#1", "Red  Widget", "Widgets")], "make string, name string, family string")
    return families.assign(_named(spark, sf_dir), "p_partkey", "p_brand", "name", "base", aliases)


_AL = "al AS (SELECT DISTINCT lower(p_brand) AS make, lower(p_name) AS name, lower(p_type) || '-' || (p_size % 9) AS base FROM part)"


@query(f"""WITH RECURSIVE {_AL}, e AS (SELECT DISTINCT a.make, a.base AS x, b.base AS y FROM al a JOIN al b ON a.make = b.make AND a.name = b.name AND a.base <> b.base),
w AS (SELECT make, x AS base, x AS other FROM e UNION SELECT w.make, w.base, e.y FROM w JOIN e ON e.make = w.make AND e.x = w.other)
SELECT make, base, min(other) AS canonical FROM w GROUP BY make, base""")
def alias_components(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", F.concat("p_type", F.lit("-"), (F.col("p_size") % 9).cast("string")).alias("base"))
    return families.alias_components(p, "p_brand", "p_name", "base").select("make", "base", "canonical")


# Orders.

@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS turn FROM orders")
def round_robin_order(spark, sf_dir):
    return order.round_robin(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("""WITH t AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders),
s AS (SELECT *, row_number() OVER (ORDER BY turn, o_custkey) AS seq FROM t) SELECT o_orderkey, seq, CAST(floor((seq - 1) / 4) AS BIGINT) AS batch FROM s""")
def bounded_batches(spark, sf_dir):
    out = order.batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 4)
    return out.select("o_orderkey", F.col("seq").cast("long").alias("seq"), "batch")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def per_group_cap(spark, sf_dir):
    return order.cap(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey")


@query("""WITH t AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders)
SELECT l_orderkey AS o_orderkey, l_linenumber, o_totalprice, rank FROM lineitem JOIN t ON l_orderkey = o_orderkey WHERE rank <= 10""")
def largest_with_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return order.largest(o, "o_orderkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 10, lines)


@query("SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('42:' || p_brand || ':' || p_name), p_name)::INTEGER AS place FROM (SELECT DISTINCT p_brand, p_name FROM part)")
def seeded_order(spark, sf_dir):
    return order.seeded_rank(table(spark, sf_dir, "part"), "p_brand", "p_name", 42)


@query("SELECT event_type, min(event_id) AS first_position FROM events GROUP BY event_type")
def ordered_distinct(spark, sf_dir):
    return order.ordered_distinct(table(spark, sf_dir, "events"), "event_type", "event_id")


# Splits.

@query("SELECT count(*) AS n_groups, CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_test, CAST(0 AS BIGINT) AS groups_in_both FROM (SELECT DISTINCT o_custkey FROM orders)")
def group_shuffle_split(spark, sf_dir):
    s = split.shuffle_split(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey")
    return s.groupBy("o_custkey").agg(F.count_distinct("split").alias("k"), F.max("split").alias("split")).agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(F.col("k") > 1).alias("groups_in_both"))


@query("""WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey DESC) AS i FROM orders GROUP BY o_custkey),
w(i, rows, groups) AS (SELECT CAST(0 AS BIGINT), [0, 0, 0, 0, 0]::BIGINT[], [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT g.i, list_transform(range(1, 6), lambda j: CAST(l.rows[j] + CASE WHEN j = l.least THEN g.n ELSE 0 END AS BIGINT)), list_transform(range(1, 6), lambda j: CAST(l.groups[j] + CASE WHEN j = l.least THEN 1 ELSE 0 END AS BIGINT))
  FROM (SELECT *, list_position(rows, list_min(rows)) AS least FROM w) l JOIN g ON g.i = l.i + 1)
SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS cv_fold, unnest(rows) AS n_rows, unnest(groups) AS n_groups FROM w WHERE i = (SELECT max(i) FROM g)""")
def group_kfold(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    return o.join(split.group_folds(o, "o_custkey"), "o_custkey").groupBy("cv_fold").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups"))


_MANIFEST = f"""o AS (SELECT o_orderkey AS id, o_custkey AS g FROM orders),
m AS (SELECT CASE WHEN id % 11 = 0 THEN -id ELSE id END AS id, g, CASE WHEN g % 5 = 0 OR id % 13 = 0 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN 7 WHEN g % 5 = 0 AND id % 23 <> 0 THEN NULL ELSE g % 4 + id % 29 // 28 END AS f FROM o UNION ALL SELECT id, g, 'train', 1 FROM o WHERE id % 31 = 0)"""


def _broken_manifest(spark, sf_dir):
    """A manifest with every kind of fault, and its frame."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("g"))
    i, g = F.col("id"), F.col("g")
    fold = F.when(i % 17 == 0, None).when(i % 19 == 0, 7).when((g % 5 == 0) & (i % 23 != 0), None).otherwise(g % 4 + F.floor(i % 29 / 28))
    m = o.select(F.when(i % 11 == 0, -i).otherwise(i).alias("id"), "g", F.when((g % 5 == 0) | (i % 13 == 0), "test").otherwise("train").alias("split"), fold.cast("int").alias("cv_fold"))
    return o, m.unionByName(o.where("id % 31 = 0").select("id", "g", F.lit("train").alias("split"), F.lit(1).alias("cv_fold")))


@query(f"""WITH {_MANIFEST} SELECT 'missing_ids' AS "check", count(*) AS n FROM o WHERE id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'unknown_ids', count(*) FROM m WHERE id NOT IN (SELECT id FROM o)
UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'groups_in_both_splits', count(*) FROM (SELECT g FROM m GROUP BY g HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'test_rows_with_fold', count(*) FROM m WHERE split = 'test' AND f IS NOT NULL
UNION ALL SELECT 'train_rows_without_fold', count(*) FROM m WHERE split = 'train' AND (f IS NULL OR f < 0 OR f > 4)
UNION ALL SELECT 'groups_in_several_folds', count(*) FROM (SELECT g FROM m WHERE split = 'train' GROUP BY g HAVING count(DISTINCT f) > 1)""")
def manifest_validation(spark, sf_dir):
    o, m = _broken_manifest(spark, sf_dir)
    return split.check_manifest(o, m, "id", "g")


@query(f"""WITH {_MANIFEST}, p AS (SELECT id, 'a' AS model, CASE WHEN id % 7 = 0 THEN 'train_oof' ELSE CASE split WHEN 'test' THEN 'test' ELSE 'train_oof' END END AS split, CASE WHEN id % 3 = 0 THEN 2 ELSE f END AS fold FROM m WHERE id % 37 <> 0),
d AS (SELECT id, any_value(split) AS s, any_value(f) AS f FROM m GROUP BY id HAVING count(*) = 1),
q AS (SELECT id, CASE split WHEN 'test' THEN 'test' ELSE 'train' END AS s, count(*) AS n, max(fold) AS pf FROM p WHERE id IN (SELECT id FROM d) GROUP BY ALL),
b AS (SELECT coalesce(d.s, q.s) AS s, d.id IS NOT NULL AS known, n, pf, f FROM d FULL JOIN q ON d.id = q.id AND d.s = q.s)
SELECT 'missing' AS "check", CAST(count(*) FILTER (WHERE n IS NULL) AS BIGINT) AS n FROM b UNION ALL SELECT 'unknown', count(*) FILTER (WHERE n > 0 AND NOT known) FROM b UNION ALL SELECT 'repeated', count(*) FILTER (WHERE n > 1) FROM b
UNION ALL SELECT 'test_with_fold', count(*) FILTER (WHERE s = 'test' AND pf IS NOT NULL) FROM b UNION ALL SELECT 'other_fold', count(*) FILTER (WHERE known AND s = 'train' AND n IS NOT NULL AND pf IS DISTINCT FROM f) FROM b""")
def prediction_coverage(spark, sf_dir):
    """Predictions with missing rows, other splits and other folds, against their manifest."""
    m = _broken_manifest(spark, sf_dir)[1]
    single = m.groupBy("id").agg(F.count("*").alias("k"), F.first("split").alias("split"), F.first("cv_fold").alias("cv_fold")).where("k = 1").drop("k")
    p = single.where("id % 37 <> 0").select("id", F.lit("a").alias("model"), F.when((F.col("id") % 7 == 0) | (F.col("split") != "test"), "train_oof").otherwise("test").alias("split"), F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("cv_fold")).alias("fold"))
    return split.check_predictions(p, single, "id")


@query("""SELECT o_orderkey, CASE WHEN CAST('0x' || substr(sha256('42:' || o_custkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders""")
def hash_split(spark, sf_dir):
    return split.hash_split(table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "split")


# Features and text.

@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS size, p_retailprice AS price, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS type, p_partkey % 5 = 0 AS held FROM part),
m AS (SELECT median(size) AS ms, median(price) AS mp FROM t WHERE NOT held), s AS (SELECT avg(coalesce(size, ms)) AS a, stddev_pop(coalesce(size, ms)) AS b, avg(price) AS c, stddev_pop(price) AS d FROM t, m WHERE NOT held)
SELECT p_partkey, round((coalesce(size, ms) - a) / b, 6) AS size, round((price - c) / d, 6) AS price, CASE WHEN size IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS size__missing,
  (coalesce(type, 'Unknown') = 'ECONOMY')::INTEGER::DOUBLE AS "type=ECONOMY", (coalesce(type, 'Unknown') = 'Unknown')::INTEGER::DOUBLE AS "type=Unknown" FROM t, m, s""")
def impute_scale_encode(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("double")).alias("size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("type"))
    p = features.Preprocessor(["size", "price"], ["type"]).fit(t.where("p_partkey % 5 <> 0"))
    return p.transform(t, ["p_partkey"]).select("p_partkey", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"), "size__missing", "`type=ECONOMY`", "`type=Unknown`")


@query("SELECT 8 * count(*) * (2 * 2 + count(DISTINCT p_type) + 1) AS bytes FROM part")
def dense_memory_bound(spark, sf_dir):
    n = features.refuse_dense(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_type"])
    return spark.range(1).select(F.lit(n).cast("long").alias("bytes"))


@query("SELECT p_partkey, p_name || ' ' || p_type || ' V8' AS clean FROM part")
def sanitize_text(spark, sf_dir):
    """One of 20 kinds of leaks, with amounts that vary by row, stands inside each text."""
    n, s = (F.col("p_partkey") * 7 % 2999 + 1).cast("string"), F.col("p_size").cast("string")
    forms = ["fuelCost08 {n}", "co2TailpipeGpm {n}", "barrels08 {s}.5", "youSaveSpend -{n}", "emissions: {n}", "${s},500/year", "{s} MPG", "MPG: {s}", "{s}.2 L/100 km", "L/100km={s}.2",
             "fuel economy: {s} MPG", "EPA combined: {s}", "annual fuel cost: ${s},500.00", "CO2: {n} g/km", "{n} g/mi", "ghgScore={s}", "Gas GUZZLER", "efficiency score: {s}", "fuelCostA2={n} USD", "smartway score {s}"]
    leaks = F.array(*[F.replace(F.replace(F.lit(f), F.lit("{n}"), n), F.lit("{s}"), s) for f in forms])
    text = F.concat_ws("  ", "p_name", F.get(leaks, (F.col("p_partkey") % len(forms)).cast("int")), "p_type", F.lit("V8"))
    return table(spark, sf_dir, "part").select("p_partkey", X.sanitize(text).alias("clean"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(AKIA|ASIA)[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(password|token|secret|api_key) ?= ?\"?[A-Za-z0-9]{8,}')""")
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(X.SECRET)).select("doc_id")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM t),
c AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY term)
SELECT term, tf, df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf FROM c ORDER BY tf DESC, term LIMIT 5000""")
def tfidf_top_terms(spark, sf_dir):
    v = features.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 5000)
    return v.select("term", "tf", "df", F.round("idf", 6).alias("idf"))


@query(r"""WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{L}\p{N}_]{2,}') AS w FROM part),
g AS (SELECT p_partkey, unnest(w) AS term FROM t UNION ALL SELECT p_partkey, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM t),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM part)) / (1 + count(DISTINCT p_partkey))) + 1 AS idf FROM g GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000),
r AS (SELECT p_partkey, term, (1 + ln(count(*))) * any_value(idf) AS x FROM g JOIN v USING (term) GROUP BY p_partkey, term)
SELECT p_partkey, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 6) AS weight FROM r""")
def tfidf_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return features.tfidf(p, "p_partkey", "text", features.vocabulary(p, "text")).withColumn("weight", F.round("weight", 6))


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<li(?:\s[^>]*)?>([^<]*(?:<(?:/?(?:a|b|i|em|strong|span)\b)[^>]*>[^<]*)*)', 1) AS items FROM pages),
i AS (SELECT page_id, CAST(unnest(range(0, len(items))) AS INTEGER) AS position, unnest(items) AS item FROM l),
t AS (SELECT page_id, position, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(item, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS item FROM i)
SELECT page_id, position, nullif(regexp_extract(item, '^([A-Za-z][A-Za-z0-9_]*)\s*-\s*(.+)', 1), '') AS key, item AS meaning FROM t""")
def html_list_items(spark, sf_dir):
    return files.list_items(table(spark, sf_dir, "pages"), "page_id", "html", keyed=False)


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>', 1) AS items FROM pages),
i AS (SELECT page_id, CAST(unnest(range(0, len(items))) AS INTEGER) AS position, unnest(items) AS item FROM l),
t AS (SELECT page_id, position, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(item, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS item FROM i)
SELECT page_id, position, nullif(regexp_extract(item, '^([A-Za-z][A-Za-z0-9_]*)\s*-\s*(.+)', 1), '') AS key, item AS meaning FROM t""")
def html_descriptions(spark, sf_dir):
    return markup.list_descriptions(table(spark, sf_dir, "pages"), "page_id", "html", keyed=False)


# Models.

def _fold(key: str):
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long") % 5).cast("int")


_FOLD = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 6) AS BIGINT) % 5"


def _modelling(spark, sf_dir):
    """id, x, y, cv_fold, grp: lines' quantity and discount against their tax, per part."""
    p = table(spark, sf_dir, "part")
    y = 5 + 0.3 * F.col("p_size") + (F.col("p_retailprice") - 900) * 0.02 + F.when(F.col("p_type") == "ECONOMY", 1.0).otherwise(0.0) + (F.col("p_partkey") % 7) * 0.1
    return p.select("p_partkey", F.array(F.col("p_size") / F.lit(10.0), (F.col("p_retailprice") - 900) / 10, (F.col("p_type") == "ECONOMY").cast("double")).alias("x"), y.alias("y"), _fold("p_brand").alias("cv_fold"), F.col("p_brand").alias("grp"))


_MODEL = f"""t AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS x1, (p_retailprice - 900) / 10 AS x2, CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END::DOUBLE AS x3,
  5 + 0.3::DOUBLE * p_size + (p_retailprice - 900) * 0.02::DOUBLE + CASE WHEN p_type = 'ECONOMY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + (p_partkey % 7) * 0.1::DOUBLE AS y, {_FOLD.format('p_brand')} AS f FROM part)"""


@query(f"""WITH {_MODEL}, m AS (SELECT h.f, median(t.y) AS v FROM (SELECT DISTINCT f FROM t) h JOIN t ON t.f <> h.f GROUP BY h.f)
SELECT CAST(t.f AS INTEGER) AS cv_fold, count(*) AS n, round(avg(abs(v - y)), 6) AS mae FROM t JOIN m ON m.f = t.f GROUP BY t.f""")
def dummy_cv(spark, sf_dir):
    d = _modelling(spark, sf_dir).select("y", "cv_fold")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("cv_fold"))).alias("f")
    middle = ranks.medians(d.select(other, "y"), ["f"], ["y"]).select("f", F.col("y").alias("v"))  # five folds
    return d.join(F.broadcast(middle), F.col("cv_fold") == F.col("f")).groupBy("cv_fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("v") - F.col("y"))), 6).alias("mae"))


@query(f"""WITH {_MODEL}, n AS (SELECT a.p_partkey AS q, b.y, sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) + (a.x3 - b.x3) * (a.x3 - b.x3)) AS d,
  row_number() OVER (PARTITION BY a.p_partkey ORDER BY (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) + (a.x3 - b.x3) * (a.x3 - b.x3), b.p_partkey) AS rn FROM t a JOIN t b ON a.f = 0 AND b.f <> 0)
SELECT q AS p_partkey, round(CASE WHEN min(d) = 0 THEN avg(y) FILTER (WHERE d = 0) ELSE sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)) END, 6) AS y_pred FROM n WHERE rn <= 15 GROUP BY q""")
def knn_predict(spark, sf_dir):
    d = _modelling(spark, sf_dir)
    return models.nearest(d.where("cv_fold <> 0"), d.where("cv_fold = 0"), "p_partkey", "x", "y").select("p_partkey", F.round("y_pred", 6).alias("y_pred"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def ols_fit(spark, sf_dir):
    m = models.Linear().fit(table(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")))
    return spark.createDataFrame([(round(float(m.coef[0]), 4), round(m.intercept, 4))], "slope double, intercept double")


@query("""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx FROM lineitem)
SELECT round(sxy / (sxx + 100), 4) AS slope, round(my - mx * sxy / (sxx + 100), 4) AS intercept FROM s""")
def ridge_fit(spark, sf_dir):
    m = models.Linear(100.0).fit(table(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")))
    return spark.createDataFrame([(round(float(m.coef[0]), 4), round(m.intercept, 4))], "slope double, intercept double")


# Evaluation over predictions derived from the lines: three models of the price.

_PRED = """pr AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS grp, l_quantity, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train_oof' END AS split, CAST(l_orderkey % 5 AS INTEGER) AS fold, l_extendedprice AS y,
  l_quantity * 1000 AS p1, 25000.0::DOUBLE AS p2, l_extendedprice * 0.9::DOUBLE AS p3 FROM lineitem),
lg AS (SELECT id, grp, l_quantity, split, fold, y AS y_true, p AS y_pred, p - y AS residual, abs(p - y) AS abs_error, model FROM (
  SELECT *, p1 AS p, 'by_quantity' AS model FROM pr UNION ALL SELECT *, p2, 'dummy' FROM pr UNION ALL SELECT *, p3, 'shrunk' FROM pr))"""


def _predictions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", "l_quantity", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train_oof").alias("split"),
                                                 (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_extendedprice").alias("y_true"))
    preds = F.array(F.struct(F.lit("by_quantity").alias("model"), (F.col("l_quantity") * 1000).alias("y_pred")), F.struct(F.lit("dummy").alias("model"), F.lit(25000.0).alias("y_pred")), F.struct(F.lit("shrunk").alias("model"), (F.col("y_true") * 0.9).alias("y_pred")))
    long = li.select("*", F.inline(preds))
    return long.withColumn("residual", F.col("y_pred") - F.col("y_true")).withColumn("abs_error", F.abs("residual"))


@query(f"""WITH {_PRED} SELECT model, split, count(*) AS n, round(avg(abs_error), 4) AS mae, round(sqrt(avg(residual * residual)), 4) AS rmse, round(1 - avg(residual * residual) / var_pop(y_true), 6) AS r2 FROM lg GROUP BY model, split""")
def regression_metrics(spark, sf_dir):
    m = evaluate.metrics(_predictions(spark, sf_dir), ["model", "split"])
    return m.select("model", "split", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(f"""WITH {_PRED} SELECT model, split, subgroup, count(*) AS n, round(avg(abs_error), 4) AS mae, round(sqrt(avg(residual * residual)), 4) AS rmse, round(median(abs_error), 4) AS median_absolute_error, round(avg(residual), 4) AS bias, count(*) < 30 AS small_support
FROM (SELECT *, CASE WHEN l_quantity / 10 <= 2 THEN '(0,2]' WHEN l_quantity / 10 <= 3 THEN '(2,3]' WHEN l_quantity / 10 <= 4 THEN '(3,4]' ELSE '(4,+inf)' END AS subgroup FROM lg) GROUP BY model, split, subgroup""")
def subgroup_errors(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("label", V.right_closed_bins(F.col("l_quantity") / 10, [0, 2, 3, 4]))
    out = evaluate.subgroup_errors(p, ["model", "split"], "label")
    return out.select("model", "split", "subgroup", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "median_absolute_error", "bias")], "small_support")


@query(f"""WITH {_PRED} SELECT model, id, round(abs_error, 4) AS abs_error, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs_error DESC, id) AS place FROM lg WHERE split = 'test') WHERE place <= 10""")
def top_errors(spark, sf_dir):
    out = evaluate.top_errors(_predictions(spark, sf_dir).where("split = 'test'"), "id")
    return out.select("model", "id", F.round("abs_error", 4).alias("abs_error"), "place")


_FOLDS = f"{_PRED}, fm AS (SELECT model, fold, avg(abs_error) AS mae FROM lg WHERE split <> 'test' GROUP BY model, fold), fs AS (SELECT model, avg(mae) AS cv_mean, stddev_pop(mae) AS cv_std FROM fm GROUP BY model)"


def _folds(spark, sf_dir):
    return evaluate.fold_summary(evaluate.metrics(_predictions(spark, sf_dir).where("split <> 'test'"), ["model", "fold"]))


@query(f"WITH {_FOLDS} SELECT model, round(cv_mean, 4) AS cv_mean, round(cv_std, 4) AS cv_std FROM fs")
def fold_summary(spark, sf_dir):
    return _folds(spark, sf_dir).select("model", F.round("cv_mean", 4).alias("cv_mean"), F.round("cv_std", 4).alias("cv_std"))


@query(f"WITH {_FOLDS} SELECT model FROM fs ORDER BY cv_mean, cv_std, model LIMIT 1")
def select_winner(spark, sf_dir):
    return evaluate.winner(_folds(spark, sf_dir), ["by_quantity", "dummy", "shrunk"])


@query(f"WITH {_FOLDS} SELECT model, round(100 * (b - cv_mean) / b, 6) AS improvement_pct FROM fs, (SELECT cv_mean AS b FROM fs WHERE model = 'dummy')")
def improvement_pct(spark, sf_dir):
    return evaluate.improvement(_folds(spark, sf_dir), "dummy").select("model", F.round("improvement_pct", 6).alias("improvement_pct"))


_PAIR = f"{_PRED}, u AS (SELECT id, min(fold) FILTER (WHERE true) AS fold, any_value(abs(p1 - y)) AS a, any_value(abs(p2 - y)) AS b, any_value(abs(p3 - y)) AS c, count(*) AS k FROM pr WHERE split = 'test' GROUP BY id HAVING count(*) = 1)"


def _pairs(spark, sf_dir):
    p = _predictions(spark, sf_dir).where("split = 'test'")
    single = p.groupBy("id").agg(F.count("*").alias("k")).where("k = 3").select("id")
    return evaluate.paired(p.join(single, "id"), "id", ["by_quantity", "dummy", "shrunk"])


@query(f"WITH {_PAIR} SELECT id, round(a, 4) AS by_quantity, round(b, 4) AS dummy, round(c, 4) AS shrunk FROM u")
def paired_pivot(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", *[F.round(c, 4).alias(c) for c in ("by_quantity", "dummy", "shrunk")])


@query(f"""WITH {_PAIR} SELECT 'by_quantity' AS model, round(avg(a - b), 4) AS mean_delta, count(*) FILTER (WHERE a < b) AS n_better, count(*) AS n FROM u
UNION ALL SELECT 'shrunk', round(avg(c - b), 4), count(*) FILTER (WHERE c < b), count(*) FROM u""")
def paired_delta(spark, sf_dir):
    return evaluate.paired_delta(_pairs(spark, sf_dir), "dummy", ["by_quantity", "shrunk"]).select("model", F.round("mean_delta", 4).alias("mean_delta"), "n_better", "n")


@query(f"WITH {_PRED}, m AS (SELECT model, split, avg(abs(y_pred - y_true)) AS mae FROM lg GROUP BY model, split) SELECT model, split, round(mae + 0.5, 6) AS reported FROM m WHERE model = 'dummy' OR split = 'test'")
def rederived_metrics(spark, sf_dir):
    """Reported metrics of which the dummy's and the test split's were altered by hand."""
    m = evaluate.metrics(_predictions(spark, sf_dir), ["model", "split"])
    told = m.select("model", "split", F.when((F.col("model") == "dummy") | (F.col("split") == "test"), F.col("mae") + 0.5).otherwise(F.col("mae")).alias("mae"))
    return evaluate.check_reported(told, m, ["model", "split"], ["mae"], 1e-9).select("model", "split", F.round("mae", 6).alias("reported"))


# Segments over the embeddings.

@query()
def pca_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mean, parts = models.pca(e, "x", 0.5)
    return models.project(e, "x", mean, parts).select("vec_id", "scores")


@query()
def kmeans_select(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(models.whole("x"))
    return models.choose_k(written(models.mean_silhouettes(e, "x", models.kmeans_each(e, "x", range(2, 7))), "scores"))


@query("""WITH p AS (SELECT a.vec_id, a.label AS c, b.label AS o, avg(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))))) AS m
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
s AS (SELECT vec_id, c, max(m) FILTER (WHERE c = o) AS own, min(m) FILTER (WHERE c <> o) AS other FROM p GROUP BY vec_id, c)
SELECT vec_id, c AS label, round(CASE WHEN own IS NULL THEN 0.0 ELSE (other - own) / greatest(own, other) END, 6) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    return models.silhouette(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


@query("SELECT label, count(*) AS n, round(avg(embedding[1]), 5) AS first_mean, round(median(embedding[1]::DOUBLE), 5) AS first_median FROM embeddings GROUP BY label")
def cluster_summary(spark, sf_dir):
    out = profile.segment_summary(table(spark, sf_dir, "embeddings"), ["label"], {"first": F.get("embedding", F.lit(0)).cast("double")})
    return out.select("label", "n", F.round("first_mean", 5).alias("first_mean"), F.round("first_median", 5).alias("first_median"))


@query("SELECT p_type AS cluster, p_brand AS class, count(*) AS n, round(avg(p_size), 6) AS size_mean, median(p_size::DOUBLE) AS size_median FROM part GROUP BY ALL")
def cluster_class_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("cluster"), F.col("p_brand").alias("class"), "p_size")
    return profile.segment_summary(p, ["cluster", "class"], {"size": F.col("p_size").cast("double")}).withColumn("size_mean", F.round("size_mean", 6))


def _cv(model, **options):
    def run(spark, sf_dir):
        oof = models.cross_validate(_modelling(spark, sf_dir).select("p_partkey", "x", "y", "cv_fold"), "p_partkey", model, **options)
        return evaluate.metrics(oof, ["model", "fold"])
    return run


for _name, _model, _options in (("tree_cv", "tree", {}), ("forest_cv", "random_forest", {}), ("extra_trees_cv", "extra_trees", {}), ("mlp_cv", "mlp", {})):
    QUERIES[_name] = _cv(_model, **_options)


@query()
def nested_search(spark, sf_dir):
    grid = [("tree", {"depth": 4}), ("tree", {"depth": 8}), ("extra_trees", {"trees": 5, "depth": 6}), ("extra_trees", {"trees": 5, "depth": 10})]
    return search.nested_search(_modelling(spark, sf_dir), grid, "grp")


# Serving.

@query("""WITH t AS (SELECT * FROM part WHERE p_partkey % 5 <> 0) SELECT 'p_type' AS field, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS options, CAST(NULL AS DOUBLE) AS median FROM t
UNION ALL SELECT 'p_brand', string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) FILTER (WHERE p_brand IN ('Brand#1', 'Brand#2')), NULL FROM t UNION ALL SELECT 'p_size', NULL, median(p_size) FROM t
UNION ALL SELECT 'training_rows', sha256('["' || string_agg(p_partkey::VARCHAR, '","' ORDER BY p_partkey::VARCHAR) || '"]'), count(*)::DOUBLE FROM t""")
def interface_schema(spark, sf_dir):
    train = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0")  # the training side of a split
    return serve.interface_schema(train, ["p_type", "p_brand"], ["p_size"], "p_partkey", {"p_brand": ["Brand#1", "Brand#2"]}).withColumn("options", F.array_join("options", "|"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'hybrid_or_unconfirmed' WHEN 1 THEN 'model_year_out_of_scope' WHEN 2 THEN 'no_engine_specs' WHEN 3 THEN 'vehicle_class_out_of_scope' WHEN 4 THEN 'hybrid_text_signal'
  WHEN 5 THEN 'reviewed_powertrain' WHEN 6 THEN 'engine_specs_needed' END AS error FROM part""")
def validate_inputs(spark, sf_dir):
    k = F.col("p_partkey") % 8
    p = table(spark, sf_dir, "part").select(
        "p_partkey", (k != 0).alias("gasoline_nonhybrid"), F.when(k == 1, 2014).when(k.isin(5, 6), 2022).otherwise(2020).alias("model_year"),
        F.when(k != 2, 2.0).alias("displacement_l"), F.when(~k.isin(2, 6), 4).alias("cylinders"), F.when(k.isin(5, 6), "Audi").otherwise(F.col("p_brand")).alias("manufacturer"),
        F.lit("Automatic").alias("transmission"), F.lit("FWD").alias("drivetrain"), F.when(k == 3, "Vans").otherwise("Compact Cars").alias("vehicle_class"),
        F.when(k == 4, "x PHEV").when(k.isin(5, 6), "A4 quattro").otherwise(F.col("p_name")).alias("model_name"), F.lit(None).cast("string").alias("engine_description"))
    return vehicles.validate_inputs(p).select("p_partkey", "error")


@query(f"""WITH {_MODEL}, s AS (SELECT x1 AS x, y, f FROM t), a AS (SELECT k AS alpha, h AS held FROM unnest([0.5, 5.0, 50.0]) u(k), range(0, 5) r(h)),
g AS (SELECT held, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, avg(x2) AS mz, var_pop(x2) * count(*) AS szz, covar_pop(x2, y) * count(*) AS szy FROM (SELECT x1 AS x, x2, y, f FROM t), range(0, 5) r(held) WHERE f <> held GROUP BY held),
e AS (SELECT 'size' AS model, alpha, a.held, avg(abs(my + (t.x1 - mx) * sxy / (sxx + alpha) - y)) AS mae FROM a JOIN g USING (held) JOIN t ON t.f = a.held GROUP BY ALL
  UNION ALL SELECT 'price', alpha, a.held, avg(abs(my + (t.x2 - mz) * szy / (szz + alpha) - y)) FROM a JOIN g USING (held) JOIN t ON t.f = a.held GROUP BY ALL),
m AS (SELECT model, alpha, avg(mae) AS mm, stddev_pop(mae) AS ms FROM e GROUP BY model, alpha),
c AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mm, ms, alpha) = 1 AS arm_choice FROM m)
SELECT model, alpha::DOUBLE AS alpha, round(mm, 6) AS mae_mean, round(ms, 6) AS mae_std, arm_choice, arm_choice AND mm = (SELECT min(mm) FROM c) AS selected FROM c""")
def ridge_arm_grid(spark, sf_dir):
    d = _modelling(spark, sf_dir).withColumns({"size": F.slice("x", 1, 1), "price": F.slice("x", 2, 1)})
    return search.ridge_grid(d, {"size": "size", "price": "price"}, [0.5, 5.0, 50.0], "y", "cv_fold").withColumns({c: F.round(c, 6) for c in ("mae_mean", "mae_std")})


@query()
def text_arm_grid(spark, sf_dir):
    """Sparse ridges of the four arms, over the parts' names and types as texts."""
    d = _modelling(spark, sf_dir).select("p_partkey", "y", "cv_fold", F.col("x")[0].alias("size"), F.when(F.col("p_partkey") % 9 != 0, F.col("x")[1]).alias("price"), "grp")
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("__k"), F.col("p_name").alias("model_name"), F.concat_ws(" ", F.lit("V"), (F.col("p_size") % 9 + 10).cast("string"), "p_type").alias("engine_description"))
    design = sparse.Design(["size", "price"], ["grp"], ["model_name", "engine_description"])
    return sparse.text_ridge_grid(d.join(texts, F.col("p_partkey") == F.col("__k")).drop("__k"), design, serve.ARMS, [0.1, 1.0, 10.0], "y").withColumns({c: F.round(c, 6) for c in ("mae_mean", "mae_std")})


@query()
def batch_score(spark, sf_dir):
    d = _modelling(spark, sf_dir)
    m = models.Linear().fit(d.where("cv_fold <> 0"))
    scored = m.predict(d.where("cv_fold = 0"))
    return scored.select("p_partkey", F.when((F.col("y_pred") > 0) & (F.abs("y_pred") < float("inf")), F.col("y_pred")).alias("y_pred"))


# The vehicle binding, over records written from the parts.

def _records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 10
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = {
        "id": text((F.floor(F.col("p_partkey") / 10) * 10 + F.when(k == 9, 8).otherwise(k) + 1).cast("string")), "year": F.when(k == 1, F.lit('"2009"')).otherwise(F.lit('"2019"')), "make": text(F.col("p_brand")),
        "model": text(F.col("p_name")), "baseModel": text(F.split_part("p_name", F.lit(" "), F.lit(1))), "displ": F.when(k == 2, F.lit('"oops"')).otherwise(F.lit('"2.0"')), "cylinders": F.lit('"4"'), "trany": F.lit('"Automatic"'), "drive": F.lit('"FWD"'),
        "VClass": F.when(k == 3, F.lit('"Vans"')).otherwise(F.lit('"Compact Cars"')), "eng_dscr": F.when(k == 4, F.lit('"x hybrid"')).otherwise(F.lit('""')), "engId": text(F.floor(F.col("p_partkey") / 10).cast("string")), "atvType": F.lit('""'),
        "fuelType1": F.when(k == 5, F.lit('"Diesel"')).otherwise(F.lit('"Regular Gasoline"')), "fuelType2": F.lit('""'), "evMotor": F.when(k == 6, F.lit("null")).otherwise(F.lit('""')), "phevBlended": F.lit("false"),
        "comb08": F.when(k == 7, F.lit('"0"')).otherwise(text((F.col("p_size") + 10).cast("string"))), "comb08U": F.lit('"0"')}
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), v) for n, v in pairs.items()])
    return p.select("p_partkey", F.concat(F.lit("{"), body, F.lit("}")).alias("raw"))


@query("""WITH r AS (SELECT CASE p_partkey % 10 WHEN 1 THEN 2 WHEN 6 THEN 3 WHEN 5 THEN 4 WHEN 4 THEN 9 WHEN 3 THEN 11 WHEN 7 THEN 12 WHEN 2 THEN 13 ELSE 99 END AS s FROM part),
st(s, stage) AS (VALUES (0, 'raw_integrity'), (1, 'required_identity'), (2, 'model_year'), (3, 'powertrain_metadata'), (4, 'primary_fuel'), (5, 'secondary_fuel'), (6, 'alternative_technology'), (7, 'electric_motor'), (8, 'phev'), (9, 'hybrid_text'), (10, 'reviewed_powertrain'), (11, 'vehicle_class'), (12, 'target'), (13, 'engine_specs')),
n AS (SELECT st.s, stage, count(r.s) AS removed FROM st LEFT JOIN r ON r.s = st.s GROUP BY st.s, stage), t AS (SELECT count(*) AS total FROM r)
SELECT stage, CAST(total - coalesce(sum(removed) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, removed, CAST(total - sum(removed) OVER (ORDER BY s) AS BIGINT) AS after FROM n, t""")
def vehicle_funnel(spark, sf_dir):
    return rules.funnel(vehicles.normalise(_records(spark, sf_dir)), vehicles.STAGES, vehicles.stage_of)


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 1 THEN 'model_year_out_of_scope' WHEN 2 THEN 'invalid_numeric:displ' WHEN 3 THEN 'vehicle_class_out_of_scope' WHEN 4 THEN 'hybrid_text_signal'
  WHEN 5 THEN 'primary_fuel_out_of_scope' WHEN 6 THEN 'null_powertrain_metadata:evMotor' WHEN 7 THEN 'invalid_target' ELSE '' END AS reasons,
  CASE WHEN p_partkey % 10 = 7 THEN NULL ELSE round(235.2145833333333 / (p_size + 10), 9) END AS target_l100km FROM part""")
def vehicle_clean(spark, sf_dir):
    return vehicles.normalise(_records(spark, sf_dir)).select("p_partkey", F.array_join("reasons", "|").alias("reasons"), F.round("target_l100km", 9).alias("target_l100km"))


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 10 = 3 THEN 'Vans' ELSE 'Compact Cars' END AS v, CASE WHEN p_partkey % 10 = 5 THEN 'Diesel' ELSE 'Regular Gasoline' END AS f, p_partkey % 10 = 6 AS nomotor, p_brand AS b FROM part)
SELECT 'VClass' AS field, v AS value, count(*) AS n FROM t GROUP BY v UNION ALL SELECT 'fuelType1', f, count(*) FROM t GROUP BY f UNION ALL SELECT 'fuelType2', '<EMPTY>', count(*) FROM t UNION ALL SELECT 'atvType', '<EMPTY>', count(*) FROM t
UNION ALL SELECT 'evMotor', CASE WHEN nomotor THEN '<MISSING>' ELSE '<EMPTY>' END, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'make', b, count(*) FROM t GROUP BY b UNION ALL SELECT 'vehicle_class_atv_pair', v || '::<EMPTY>', count(*) FROM t GROUP BY v""")
def raw_categories(spark, sf_dir):
    return vehicles.raw_categories(_records(spark, sf_dir))


@query("""SELECT CASE WHEN p_partkey % 4 = 0 THEN 'SUV' WHEN p_partkey % 4 = 1 THEN 'Station wagons' WHEN p_partkey % 4 = 2 THEN 'Cars' END AS family, count(*) AS n FROM part GROUP BY ALL""")
def class_families(spark, sf_dir):
    names = F.array(F.lit("Small Sport Utility Vehicle 2WD"), F.lit("Midsize Station Wagons"), F.lit("Two Seaters"), F.lit(None))
    return table(spark, sf_dir, "part").groupBy(vehicles.class_family(F.get(names, (F.col("p_partkey") % 4).cast("int"))).alias("family")).agg(F.count("*").alias("n"))


# Coverage and contamination joins of the corpus tables.

@query("SELECT source, count(*) AS n, count(quality) AS labelled, count(*) FILTER (WHERE quality IS NULL) AS unlabelled FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) GROUP BY source")
def label_coverage(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query("SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON sha256(lower(d.text)) = sha256(lower(b.text))")
def benchmark_copies(spark, sf_dir):
    h = F.sha2(F.lower("text").cast("binary"), 256).alias("h")
    return table(spark, sf_dir, "documents").select("doc_id", h).join(table(spark, sf_dir, "benchmark").select(h), "h", "left_semi").select("doc_id")
