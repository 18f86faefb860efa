"""Registered queries and the SQL they are compared with. Doubles are rounded to nine digits on both sides (to four from
1,000 on): short decimals, such as means of prices, are never halfway between two of those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import tails
from tabloom.operators import associate, boost, diagnose, metrics, model, neighbours, pipeline, prepare, smote, split, tracking
from tabloom.streaming.profile import windowed_profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    near = lambda c: F.when(F.abs(f"`{c}`") < 1000, F.round(f"`{c}`", 9)).otherwise(F.round(f"`{c}`", 4)).alias(c)
    return df.select(*(near(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(sql: str | None = None, doubles: str = ""):
    """Registers a query under its function's name; doubles are the columns of sql to be rounded."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))
        if sql:
            replace = ", ".join(f"CASE WHEN abs({c}) < 1000 THEN round({c}, 9) ELSE round({c}, 4) END AS {c}" for c in doubles.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({replace}) FROM ({sql})" if replace else sql
        return f

    return add


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PROFILE = """SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_unique, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
    avg({c})::DOUBLE AS mean, stddev_samp({c})::DOUBLE AS std, skewness({c}) AS skew, kurtosis_pop({c}) AS kurtosis,
    quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.5)::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM lineitem"""


@query(" UNION ALL ".join(PROFILE.format(c=c) for c in NUMBERS), "min max mean std skew kurtosis q1 median q3")
def profile_lineitem(t):
    return diagnose.profile_numeric(t("lineitem"), NUMBERS)


@query("""SELECT "column", value, count, rank FROM (SELECT "column", value, count(*) AS count, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS INTEGER) AS rank
    FROM (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY 1, 2) WHERE rank <= 10""")
def top_values(t):
    return diagnose.top_values(t("orders"), ["o_orderstatus", "o_orderpriority"])


@query("""WITH d AS (SELECT DISTINCT ts FROM events), s AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS x FROM d)
    SELECT min(ts) AS min, max(ts) AS max, (SELECT CASE WHEN count(*) >= 3 AND min(x) = max(x) THEN min(x) / 1e6::DOUBLE END FROM s) AS step_seconds FROM events""", "step_seconds")
def datetime_range(t):
    out = diagnose.datetime_range(t("events"), "ts")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min", "max")})


def _role(table: str, c: str, kind: str) -> str:
    words = [("true", "false"), ("yes", "no"), ("0", "1"), ("1", "2")]
    within = " OR ".join(f"bool_and(lower(CAST({c} AS VARCHAR)) IN {w})" for w in words)
    dated = f"(SELECT coalesce(bool_and(regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}([ T].*)?') AND try_cast(x AS TIMESTAMP) IS NOT NULL), false) FROM (SELECT {c} AS x FROM {table} WHERE {c} IS NOT NULL LIMIT 50))" if kind == "string" else "false"
    length = f"avg(length({c}))" if kind == "string" else "NULL::DOUBLE"
    base = f"count(DISTINCT {c}) AS u, count(*) AS n, count({c}) AS k, coalesce({within}, false) AS b, {length} AS len, {dated} AS dated FROM {table}"
    rules = [
        ("u <= 1", "constant", "high"), (f"'{kind}' = 'time'", "datetime", "high"), ("dated", "datetime", "medium"), ("u = 2 AND b", "boolean", "medium"), ("u / n::DOUBLE > 0.95::DOUBLE", "identifier", "high"),
        (f"'{kind}' = 'number' AND (u > 20 OR u / greatest(k, 1)::DOUBLE > 0.05::DOUBLE)", "numeric_continuous", "high"), (f"'{kind}' = 'number'", "numeric_discrete", "medium"),
        ("u / greatest(k, 1)::DOUBLE > 0.5::DOUBLE AND len > 30", "text_freeform", "medium"), ("u <= 50", "categorical_nominal", "high"), ("true", "categorical_nominal", "medium"),
    ]
    pick = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in rules) + " END"
    return f"SELECT '{c}' AS \"column\", {pick(1)} AS role, {pick(2)} AS confidence, u AS n_unique, n - k AS missing FROM (SELECT {base})"


ROLES = {
    "events": {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "string", "value": "number", "props": "string"},
    "lineitem": {"l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "time"},
    "labels": {"doc_id": "number", "quality": "number", "toxic": "number"},
    "documents": {"doc_id": "number", "text": "string", "lang": "string", "source": "string", "n_chars": "number"},
}


def _roles(table: str) -> str:
    return " UNION ALL ".join(_role(table, c, k) for c, k in ROLES[table].items())


@query(_roles("events"))
def column_roles(t):
    return diagnose.column_roles(t("events"))


@query(_roles("lineitem"))
def column_roles_lineitem(t):
    return diagnose.column_roles(t("lineitem"))


@query(" UNION ALL ".join(f"SELECT '{x}' AS \"table\", * FROM ({_roles(x)})" for x in ("labels", "documents")))
def column_roles_texts(t):
    of = lambda x: diagnose.column_roles(t(x)).select(F.lit(x).alias("table"), "*")
    return of("labels").union(of("documents"))


# The order's date as text, but for what is no date from the 51st row on; the fraction of whole numbers.
MADE = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no' END AS flag, (o_orderkey % 3)::DOUBLE AS third, (o_orderkey % 2)::DOUBLE AS half, 'x' AS same FROM orders"


@query("WITH made AS (" + MADE + ") " + " UNION ALL ".join(_role("made", c, k) for c, k in {"o_orderkey": "number", "day": "string", "flag": "string", "third": "number", "half": "number", "same": "string"}.items()))
def column_roles_made(t):
    return diagnose.column_roles(t("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 != 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') END AS day", "CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no' END AS flag", "CAST(o_orderkey % 3 AS DOUBLE) AS third", "CAST(o_orderkey % 2 AS DOUBLE) AS half", "'x' AS same"))


@query("""SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, 0.0::DOUBLE AS missing_pct, min(o_orderkey)::DOUBLE AS min, max(o_orderkey)::DOUBLE AS max, avg(o_orderkey) AS mean, stddev_samp(o_orderkey) AS std, skewness(o_orderkey) AS skew, NULL::TIMESTAMP AS first, NULL::TIMESTAMP AS last, NULL::BIGINT AS cardinality FROM orders
    UNION ALL SELECT 'price', 'double', 100 * avg((price IS NULL)::INT), min(price), max(price), avg(price), stddev_samp(price), skewness(price), NULL, NULL, NULL FROM (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders)
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', 0.0, NULL, NULL, NULL, NULL, NULL, min(o_orderdate), max(o_orderdate), NULL FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', 0.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT o_orderpriority) FROM orders""", "missing_pct min max mean std skew")
def profile_orders(t):
    rows = t("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 != 0 THEN o_totalprice END AS price", "o_orderdate", "o_orderpriority")
    out = diagnose.profile_dataset(rows, "quick").drop("frequency", "kurtosis", "normality_stat", "normality_p", "is_normal", "top_values")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("SELECT 'quality' AS target, count(DISTINCT quality) AS n_unique, 'classification' AS task, 'high' AS confidence, false AS needs_clarification FROM labels")
def target_task(t):
    return diagnose.infer_task(t("labels"), diagnose.infer_target(t("labels").columns, "predict the quality of a text"))


@query("SELECT o_orderstatus AS value, count(*) AS count, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM orders GROUP BY 1", "share")
def class_balance(t):
    return diagnose.class_balance(t("orders"), "o_orderstatus")


def _taxed(t):
    return t("lineitem").select(*NUMBERS[:3], F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))


@query("""SELECT 'l_tax' AS "column", count(*) - count(x) AS missing, 100.0::DOUBLE * avg((x IS NULL)::INT) AS missing_pct,
    greatest(abs(corr((x IS NULL)::INT::DOUBLE, l_quantity)), abs(corr((x IS NULL)::INT::DOUBLE, l_extendedprice)), abs(corr((x IS NULL)::INT::DOUBLE, l_discount))) AS max_abs_r, max_abs_r >= 0.3 AS likely_mar
    FROM (SELECT *, nullif(l_tax, 0) AS x FROM lineitem)""", "missing_pct max_abs_r")
def missingness(t):
    return diagnose.missingness(_taxed(t))


# The mask follows the flag, which no number tells; as a text, the order's key has a value for every four rows or so.
@query("""WITH x AS (SELECT l_linenumber, l_returnflag, l_linestatus, CAST(l_orderkey AS VARCHAR) AS k, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS tax FROM lineitem),
    c AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) AS a, dense_rank() OVER (ORDER BY l_linestatus) AS b, dense_rank() OVER (ORDER BY k) AS d, (tax IS NULL)::INT::DOUBLE AS m FROM x)
    SELECT 'tax' AS "column", count(*) - count(tax) AS missing, 100.0::DOUBLE * avg(m) AS missing_pct, greatest(abs(corr(m, l_linenumber)), abs(corr(m, a)), abs(corr(m, b)), abs(corr(m, d))) AS max_abs_r, max_abs_r >= 0.3 AS likely_mar FROM c""", "missing_pct max_abs_r")
def missingness_categories(t):
    return diagnose.missingness(t("lineitem").select("l_linenumber", "l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string").alias("k"), F.expr("CASE WHEN l_returnflag <> 'N' THEN l_tax END").alias("tax")))


BOUNDS = """WITH b AS ({b}) SELECT 'value' AS "column", lower, upper, (SELECT count(*) FROM events, b WHERE value < lower OR value > upper) AS n_outliers FROM b"""


@query(BOUNDS.format(b="SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT quantile_cont(value, 0.25)::DOUBLE AS q1, quantile_cont(value, 0.75)::DOUBLE AS q3 FROM events)"), "lower upper")
def outliers_iqr(t):
    return diagnose.outliers(t("events"), ["value"])


@query(BOUNDS.format(b="SELECT avg(value) - 3 * stddev_samp(value) AS lower, avg(value) + 3 * stddev_samp(value) AS upper FROM events"), "lower upper")
def outliers_zscore(t):
    return diagnose.outliers(t("events"), ["value"], "zscore")


@query("""WITH j AS (SELECT l_quantity, l_shipdate, l_extendedprice, l_extendedprice * 1.0::DOUBLE AS copy, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    x AS (SELECT 'l_quantity' AS "column", round(count(DISTINCT l_quantity) / count(*)::DOUBLE, 4) AS unique_ratio, round(abs(corr(l_quantity, l_extendedprice)), 4) AS abs_r, NULL::DOUBLE AS after_outcome FROM j
    UNION ALL SELECT 'copy', round(count(DISTINCT copy) / count(*)::DOUBLE, 4), round(abs(corr(copy, l_extendedprice)), 4), NULL FROM j
    UNION ALL SELECT 'l_shipdate', round(count(DISTINCT l_shipdate) / count(*)::DOUBLE, 4), NULL, round(avg((l_shipdate > o_orderdate)::INT), 4) FROM j)
    SELECT *, concat_ws(',', CASE WHEN unique_ratio > 0.95 THEN 'identifier_like' END, CASE WHEN abs_r >= 0.98 THEN 'high_correlation' END, CASE WHEN after_outcome > 0.5 THEN 'timestamped_after_outcome' END) AS suspects FROM x""", "unique_ratio")
def leakage_audit(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_quantity", "l_shipdate", "l_extendedprice", (F.col("l_extendedprice") * 1.0).alias("copy"), "o_orderdate")
    return diagnose.leakage(j, "l_extendedprice", "o_orderdate")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT count(*) AS n, corr(a, b) AS rho FROM r""", "rho")
def assoc_spearman(t):
    return associate.spearman(t("lineitem"), "l_quantity", "l_extendedprice")


CHI = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2), g AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
    s AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / (sum(n) OVER ())::DOUBLE AS e FROM g),
    z AS (SELECT CAST(sum(n) AS BIGINT) AS n, (SELECT count(DISTINCT a)::INT FROM c) AS r, (SELECT count(DISTINCT b)::INT FROM c) AS k, sum({x}) AS chi2 FROM s) SELECT *, sqrt(chi2 / (n * (least(r, k) - 1))) AS v FROM z"""


@query(CHI.format(a="l_returnflag", b="l_linestatus", t="lineitem", x="(n - e) * (n - e) / e"), "chi2 v")
def assoc_cramers_v(t):
    return associate.cramers_v(t("lineitem"), "l_returnflag", "l_linestatus")


@query(CHI.format(a="quality", b="toxic", t="labels", x="greatest(abs(n - e) - 0.5, 0) * greatest(abs(n - e) - 0.5, 0) / e"), "chi2 v")
def assoc_cramers_v_yates(t):
    return associate.cramers_v(t("labels"), "quality", "toxic")


@query("""WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS t, count(*) AS n FROM orders)
    SELECT count(*) AS k, CAST(sum(g.n) AS BIGINT) AS n, sum(g.n * (g.m - a.m) * (g.m - a.m)) / (count(*) - 1) / (sum(g.n * v) / (sum(g.n) - count(*))) AS f, sum(g.n * (g.m - a.m) * (g.m - a.m)) / max(a.t) AS eta2 FROM g, a""", "f eta2")
def assoc_anova(t):
    return associate.anova(t("orders"), "o_orderpriority", "o_totalprice")


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT n, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb, sum(n) OVER () AS t FROM c)
    SELECT sum(n / t * ln(n * t / (ra * cb))) AS mi FROM s""", "mi")
def assoc_mutual_info(t):
    return associate.mutual_information(t("lineitem"), "l_returnflag", "l_linestatus")


@query("""WITH c AS (SELECT l_quantity AS v, count(*) FILTER (l_linestatus = 'O')::DOUBLE AS a, count(*) FILTER (l_linestatus <> 'O')::DOUBLE AS b FROM lineitem GROUP BY 1),
    s AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))
    SELECT CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2, max(abs(ca / n1 - cb / n2)) AS d FROM s""", "d")
def shift_ks(t):
    return associate.ks_two_samples(t("lineitem").withColumn("first", F.col("l_linestatus") == "O"), "l_quantity", "first")


KS_P = """WITH c AS (SELECT l_extendedprice AS v, count(*) FILTER (l_linenumber < 3)::DOUBLE AS a, count(*) FILTER (NOT l_linenumber < 3)::DOUBLE AS b FROM lineitem GROUP BY 1),
    s AS (SELECT sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c WINDOW o AS (ORDER BY v)),
    d AS (SELECT max(n1) AS n1, max(n2) AS n2, max(abs(ca / n1 - cb / n2)) AS d FROM s), x AS (SELECT *, d * d * n1 * n2 / (n1 + n2) AS x2 FROM d),
    p AS (SELECT n1, n2, d, CASE WHEN x2 < 0.04 THEN 1.0::DOUBLE ELSE greatest(0, least(1, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2 END * exp(-2.0::DOUBLE * k * k * x2)) FROM range(1, 101) r(k)))) END AS p_value FROM x)
    SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, d, p_value, p_value < 0.05 AS shifted FROM p"""


@query(KS_P, "d p_value")
def shift_test(t):
    return associate.shift(t("lineitem").withColumn("first", F.col("l_linenumber") < 3), "l_extendedprice", "first", exact=False)


K2 = """WITH a AS (SELECT count(o_totalprice)::DOUBLE AS n, avg(o_totalprice) AS mu, var_pop(o_totalprice) AS v FROM orders),
    g AS (SELECT any_value(n) AS n, avg(power((o_totalprice - mu) / sqrt(v), 3)) AS s, kurtosis_pop(o_totalprice) AS k FROM orders, a),
    h AS (SELECT *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w,
                 (k + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
                 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM g),
    i AS (SELECT *, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS a FROM h), j AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS b FROM i),
    z AS (SELECT n, asinh(y / sqrt(2 / (w - 1))) / sqrt(ln(w) / 2) AS z1, (1 - 2 / (9 * a) - sign(b) * cbrt((1 - 2 / a) / abs(b))) / sqrt(2 / (9 * a)) AS z2 FROM j)
    SELECT 'o_totalprice' AS "column", CAST(n AS BIGINT) AS n, z1 * z1 + z2 * z2 AS k2, exp(-(z1 * z1 + z2 * z2) / 2) AS p_value, exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal FROM z"""


@query(K2, "k2 p_value")
def normality(t):
    return associate.normality(t("orders"), ["o_totalprice"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", r * r * (n - 2) / (1 - r * r) AS f FROM (SELECT corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem)" for c in ("l_quantity", "l_discount", "l_tax")), "f")
def select_filter(t):
    return associate.f_scores(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


ORDERED = "row_number() OVER ({by} ORDER BY md5(concat(CAST({key} AS VARCHAR), '|42')), {key})"


@query(f"SELECT o_orderkey, CASE WHEN {ORDERED.format(by='', key='o_orderkey')} <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM orders")
def split_random(t):
    return split.random_split(t("orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT o_orderkey, o_orderstatus, CASE WHEN {ORDERED.format(by='PARTITION BY o_orderstatus', key='o_orderkey')} <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM orders")
def split_stratified(t):
    return split.stratified_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query(f"WITH g AS (SELECT DISTINCT o_custkey FROM orders), p AS (SELECT o_custkey, CASE WHEN {ORDERED.format(by='', key='o_custkey')} <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM g) SELECT o_orderkey, o_custkey, part FROM orders JOIN p USING (o_custkey)")
def split_group(t):
    return split.group_split(t("orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= greatest(1, least(round_even(count(*) OVER () * 0.8::DOUBLE, 0), count(*) OVER () - 1)) THEN 'train' ELSE 'test' END AS part FROM orders")
def split_time(t):
    return split.time_split(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(f"""WITH p AS (SELECT o_orderkey, {ORDERED.format(by='', key='o_orderkey')} - 1 AS pos, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM p""")
def folds_random(t):
    return split.random_folds(t("orders").select("o_orderkey"), "o_orderkey", 5)


@query(f"SELECT o_orderkey, CAST(({ORDERED.format(by='PARTITION BY o_orderstatus', key='o_orderkey')} - 1) % 5 AS INTEGER) AS fold FROM orders")
def folds_stratified(t):
    return split.stratified_folds(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5).drop("o_orderstatus")


# One customer after the other, largest first, to the fold with the fewest rows: so many customers of a size for each fold, in shuffled order.
GREEDY = """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY n DESC) AS i, n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)),
    g AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS rows, [0, 0, 0, 0, 0]::BIGINT[] AS groups UNION ALL
        SELECT s.i, list_transform(rows, lambda x, k: x + CASE WHEN k = list_position(rows, list_min(rows)) THEN s.n ELSE 0 END), list_transform(groups, lambda x, k: x + CASE WHEN k = list_position(rows, list_min(rows)) THEN 1 ELSE 0 END) FROM g JOIN s ON s.i = g.i + 1),
    e AS (SELECT n, groups FROM g JOIN s USING (i) QUALIFY i = max(i) OVER (PARTITION BY n)),
    u AS (SELECT n, list_transform(groups, lambda x, k: x - coalesce(before[k], 0)) AS taken FROM (SELECT n, groups, lag(groups) OVER (ORDER BY n DESC) AS before FROM e)),
    p AS (SELECT o_custkey, n, {order} AS pos FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)),
    f AS (SELECT o_custkey, CAST(len(list_filter([1, 2, 3, 4], lambda k: pos > list_sum(taken[:k]))) AS INTEGER) AS fold FROM p JOIN u USING (n))
    SELECT o_orderkey, fold FROM orders JOIN f ON orders.o_custkey IS NOT DISTINCT FROM f.o_custkey"""


@query(GREEDY.format(order=ORDERED.format(by="PARTITION BY n", key="o_custkey")))
def folds_group(t):
    return split.group_folds(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 5).drop("o_custkey")


@query("""WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events)
    SELECT event_id, CAST(CASE WHEN pos <= n - 5 * (n // 6) THEN 0 ELSE 1 + (pos - (n - 5 * (n // 6)) - 1) // (n // 6) END AS INTEGER) AS block FROM p""")
def folds_time(t):
    return split.time_folds(t("events").select("event_id", "ts"), "ts", "event_id", 5).drop("ts")


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS w, CAST(quarter(o_orderdate) AS INTEGER) AS q,
    last_day(o_orderdate) = o_orderdate::DATE AS e FROM orders""")
def derive_datetime_parts(t):
    parts = [("y", "year"), ("m", "month"), ("w", "weekday"), ("q", "quarter"), ("e", "is_month_end")]
    defs = [{"name": n, "expression_type": "row_wise", "definition": {"kind": "datetime_part", "column": "o_orderdate", "part": p}} for n, p in parts]
    return prepare.derive(t("orders").select("o_orderkey", "o_orderdate"), defs).drop("o_orderdate")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS ratio, l_extendedprice * (1 - l_discount) + pow(l_tax, 2) AS net, l_quantity > 25 AND l_tax <= 0.04 AS big FROM lineitem""", "ratio net")
def derive_arithmetic(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    defs = [("ratio", {"kind": "ratio", "numerator": "l_extendedprice", "denominator": "l_discount"}), ("net", {"kind": "arithmetic", "expression": "l_extendedprice * (1 - l_discount) + l_tax ** 2"}), ("big", {"kind": "arithmetic", "expression": "(l_quantity > 25) & (l_tax <= 0.04)"})]
    return prepare.derive(rows, [{"name": n, "expression_type": "row_wise", "definition": d} for n, d in defs]).select("l_orderkey", "l_linenumber", "ratio", "net", "big")


@query("""WITH tr AS (SELECT * FROM lineitem WHERE l_linenumber <= 3), g AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS v FROM tr GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, coalesce(v, (SELECT avg(l_quantity) FROM tr)) AS enc FROM lineitem LEFT JOIN g USING (l_suppkey, l_returnflag)""", "enc")
def derive_group_aggregate(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    return prepare.group_feature(rows.where("l_linenumber <= 3"), rows, "enc", ["l_suppkey", "l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "enc")


IMPUTED = {"a": "mean", "b": "median", "c": "most_frequent", "d": "constant"}


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS a, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size::DOUBLE END AS b, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS c, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_type END AS d FROM part)
    SELECT p_partkey, coalesce(a, (SELECT avg(a) FROM x)) AS a, coalesce(b, (SELECT median(b) FROM x)) AS b, coalesce(c, (SELECT c FROM x WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)) AS c, coalesce(d, '__missing__') AS d FROM x""", "a b")
def impute(t):
    hole = lambda c, k: F.when(F.col("p_size") % k != 0, F.col(c))
    x = t("part").select("p_partkey", hole("p_retailprice", 3).alias("a"), hole("p_size", 4).cast("double").alias("b"), hole("p_brand", 5).alias("c"), hole("p_type", 2).alias("d"))
    return prepare.impute(x, x, IMPUTED)


@query("""WITH tr AS (SELECT * FROM orders WHERE o_custkey % 2 = 0), f AS (SELECT o_orderpriority, count(*) / sum(count(*)) OVER ()::DOUBLE AS v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS c FROM tr GROUP BY 1)
    SELECT o_orderkey, coalesce(v, 0.0::DOUBLE) AS freq, CAST(coalesce(c, -1) AS INTEGER) AS code FROM orders LEFT JOIN f USING (o_orderpriority)""", "freq")
def encode_frequency_label(t):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    train = rows.where("o_custkey % 2 = 0")
    return prepare.encode_label(train, prepare.encode_frequency(train, rows, "o_orderpriority", "freq"), "o_orderpriority", "code").select("o_orderkey", "freq", "code")


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
def encode_one_hot(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    return prepare.encode_one_hot(rows, rows, "o_orderstatus").drop("o_orderstatus")


@query("""WITH g AS (SELECT c_nationkey, sum(c_acctbal) AS s, count(c_acctbal) AS m FROM customer GROUP BY 1), a AS (SELECT avg(c_acctbal) AS v FROM customer)
    SELECT c_custkey, (s + 10 * v) / (m + 10) AS enc FROM customer JOIN g USING (c_nationkey), a""", "enc")
def encode_target(t):
    rows = t("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return prepare.encode_target(rows, rows, "c_nationkey", "c_acctbal", "enc").select("c_custkey", "enc")


@query("""WITH r AS (SELECT *, c_custkey % 5 AS fold FROM customer), a AS (SELECT avg(c_acctbal) AS v FROM customer)
    SELECT x.c_custkey, (coalesce(sum(y.c_acctbal), 0) + 10 * max(a.v)) / (count(y.c_acctbal) + 10) AS enc FROM r x LEFT JOIN r y ON x.c_nationkey = y.c_nationkey AND x.fold <> y.fold CROSS JOIN a GROUP BY 1""", "enc")
def encode_target_oof(t):
    rows = t("customer").select("c_custkey", "c_nationkey", "c_acctbal", (F.col("c_custkey") % 5).alias("fold"))
    return prepare.encode_target_out_of_fold(rows, "c_nationkey", "c_acctbal", "enc").select("c_custkey", "enc")


def _scaled(t, method):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return prepare.scale(rows, rows, ["l_extendedprice", "l_quantity"], method)


SCALED = "WITH f AS (SELECT {a} FROM lineitem) SELECT l_orderkey, l_linenumber, (l_extendedprice - c1) / w1 AS l_extendedprice, (l_quantity - c2) / w2 AS l_quantity FROM lineitem, f"


@query(SCALED.format(a="avg(l_extendedprice) AS c1, stddev_pop(l_extendedprice) AS w1, avg(l_quantity) AS c2, stddev_pop(l_quantity) AS w2"), "l_extendedprice l_quantity")
def scale_standard(t):
    return _scaled(t, "standard")


@query(SCALED.format(a="min(l_extendedprice) AS c1, max(l_extendedprice) - min(l_extendedprice) AS w1, min(l_quantity) AS c2, max(l_quantity) - min(l_quantity) AS w2"), "l_extendedprice l_quantity")
def scale_minmax(t):
    return _scaled(t, "minmax")


@query(SCALED.format(a=", ".join(f"quantile_cont({c}, 0.5)::DOUBLE AS c{i}, quantile_cont({c}, 0.75)::DOUBLE - quantile_cont({c}, 0.25) AS w{i}" for i, c in ((1, "l_extendedprice"), (2, "l_quantity")))), "l_extendedprice l_quantity")
def scale_robust(t):
    return _scaled(t, "robust")


FENCE = "WITH q AS (SELECT quantile_cont(value, 0.25)::DOUBLE AS a, quantile_cont(value, 0.75)::DOUBLE AS b FROM events), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) "


@query(FENCE + "SELECT event_id, least(greatest(value, lo), hi) AS value FROM events, f", "value")
def outlier_cap(t):
    rows = t("events").select("event_id", "value")
    return prepare.handle_outliers(rows, rows, ["value"])


@query(FENCE + "SELECT event_id, value FROM events, f WHERE value IS NULL OR value BETWEEN lo AND hi", "value")
def outlier_remove(t):
    rows = t("events").select("event_id", "value")
    return prepare.handle_outliers(rows, rows, ["value"], "remove")


@query("SELECT event_id, sign(value) * ln(1 + abs(value)) AS value FROM events", "value")
def outlier_transform(t):
    rows = t("events").select("event_id", "value")
    return prepare.handle_outliers(rows, rows, ["value"], "transform")


def _called(t):
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("quality", (F.col("n_chars") > 1000).cast("int").alias("p"), (F.least(F.col("n_chars"), F.lit(5000)) / 5000).alias("s"))


CALLED = "WITH x AS (SELECT quality AS y, (n_chars > 1000)::INT AS p, least(n_chars, 5000) / 5000.0::DOUBLE AS s FROM labels JOIN documents USING (doc_id)) "


@query(CALLED + "SELECT avg((y = p)::INT) AS accuracy, (SELECT avg(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + w, 0), 0)) FROM (SELECT l, count(*) FILTER (y = l AND p = l) AS tp, count(*) FILTER ((y = l) <> (p = l)) AS w FROM x, (SELECT DISTINCT y AS l FROM x UNION SELECT DISTINCT p FROM x) GROUP BY l)) AS f1_macro FROM x", "accuracy f1_macro")
def metrics_classification(t):
    return metrics.classification(_called(t), "quality", "p")


@query("SELECT sqrt(avg((l_extendedprice - p) * (l_extendedprice - p))) AS rmse, avg(abs(l_extendedprice - p)) AS mae, 1 - sum((l_extendedprice - p) * (l_extendedprice - p)) / (count(*) * var_pop(l_extendedprice)) AS r2 FROM (SELECT *, l_quantity * 1500.0::DOUBLE AS p FROM lineitem)", "rmse mae r2")
def metrics_regression(t):
    return metrics.regression(t("lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p")


@query(CALLED + ", r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS k FROM x) SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, (sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc FROM r", "auc")
def metrics_auc(t):
    return metrics.roc_auc(_called(t), "quality", "s")


@query(CALLED + """SELECT k / 100.0::DOUBLE AS threshold, coalesce(count(*) FILTER (s >= k / 100.0::DOUBLE AND y = 1) / nullif(count(*) FILTER (s >= k / 100.0::DOUBLE), 0)::DOUBLE, 0) AS precision,
    count(*) FILTER (s >= k / 100.0::DOUBLE AND y = 1) / sum(y)::DOUBLE AS recall, 2 * count(*) FILTER (s >= k / 100.0::DOUBLE AND y = 1) / (count(*) FILTER (s >= k / 100.0::DOUBLE) + sum(y))::DOUBLE AS f1 FROM x, range(1, 100) t(k) GROUP BY k""", "threshold precision recall f1")
def threshold_sweep(t):
    return metrics.thresholds(_called(t), "quality", "s")


@query("WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT max(n) / sum(n)::DOUBLE AS accuracy, 2 * max(n) / (sum(n) + max(n))::DOUBLE / count(*) AS f1_macro FROM c", "accuracy f1_macro")
def baseline_classification(t):
    return metrics.baseline_classification(t("orders"), "o_orderstatus")


@query("SELECT stddev_pop(o_totalprice) AS rmse, avg(abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders))) AS mae, 0.0::DOUBLE AS r2 FROM orders", "rmse mae r2")
def baseline_regression(t):
    out = metrics.baseline_regression(t("orders"), "o_totalprice")
    return out.withColumn("r2", F.abs(F.round("r2", 6)))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25)::DOUBLE AS a, quantile_cont(o_totalprice, 0.5)::DOUBLE AS b, quantile_cont(o_totalprice, 0.75)::DOUBLE AS c FROM orders)
    SELECT CAST(CASE WHEN o_totalprice <= a THEN 1 WHEN o_totalprice <= b THEN 2 WHEN o_totalprice <= c THEN 3 ELSE 4 END AS VARCHAR) AS segment, count(*) AS n, avg((o_orderstatus <> 'F')::INT) AS error_rate FROM orders, q GROUP BY 1""", "error_rate")
def segment_errors(t):
    return metrics.segment_errors(metrics.quartile(t("orders").withColumn("p", F.lit("F")), "o_totalprice"), "quartile", "o_orderstatus", "p")


@query("""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, min(n) / max(n)::DOUBLE AS ratio, CASE WHEN min(n) / max(n)::DOUBLE >= 0.3 THEN 'none' WHEN sum(n) >= 200 AND min(n) / max(n)::DOUBLE * sum(n) >= 6 THEN 'oversample_smote' ELSE 'class_weight' END AS strategy FROM c""", "ratio")
def imbalance(t):
    return metrics.imbalance(t("labels"), "toxic")


@query("SELECT toxic AS class, (SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * count(*))::DOUBLE AS weight FROM labels GROUP BY 1", "weight")
def class_weights(t):
    return metrics.class_weights(t("labels"), "toxic")


@query("WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, (SELECT max(n) FROM c) AS n FROM c")
def resample_over(t):
    return model.resample(t("labels"), "toxic", "doc_id", "over").groupBy("toxic").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, (SELECT min(n) FROM c) AS n FROM c")
def resample_under(t):
    return model.resample(t("labels"), "toxic", "doc_id", "under").groupBy("toxic").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1", "mean std min max")
def windowed_events(t):
    return windowed_profile(t("events"), "ts", "value").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT CAST(user_id AS VARCHAR) AS run, arg_max_null(value, event_id) AS number FROM events WHERE event_type = 'click' GROUP BY 1", "number")
def runs_compared_events(t):
    rows = t("events").select(F.col("event_type").alias("experiment"), F.col("user_id").cast("string").alias("run"), F.lit("metric").alias("kind"), F.lit("value").alias("key"), F.lit(None).cast("string").alias("value"), F.col("value").alias("number"), F.col("event_id").cast("double").alias("at"))
    return tracking.compare_runs(rows, "click", "value")


@query("""WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 4 AS bucket, o_custkey % 10 + 1 AS n, (o_orderkey % 3)::DOUBLE AS a, (o_custkey % 4)::DOUBLE AS b FROM orders WHERE o_orderstatus = 'F')
    SELECT id, round(0.3::DOUBLE * abs(bucket - 1) + 0.2::DOUBLE * abs(n - 4) / greatest(n, 4) + 0.5::DOUBLE * (abs(0.5::DOUBLE - a / greatest(a + b, 1)) + abs(0.5::DOUBLE - b / greatest(a + b, 1))) / 2, 4) AS distance FROM c ORDER BY 2, 1 LIMIT 5""", "distance")
def cases_similar_orders(t):
    mix = F.create_map(F.lit("boolean"), (F.col("o_orderkey") % 3).cast("int"), F.lit("identifier"), (F.col("o_custkey") % 4).cast("int"))
    bucket = F.element_at(F.array(*map(F.lit, tracking.BUCKETS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    task = F.when(F.col("o_orderstatus") == "F", "classification").otherwise("regression")
    cases = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), bucket.alias("row_bucket"), (F.col("o_custkey") % 10 + 1).cast("int").alias("n_columns"), mix.alias("role_mix"), task.alias("task"), F.lit("private").alias("scope"))
    return tracking.similar_cases(cases, {"row_bucket": "small", "n_columns": 4, "role_mix": {"boolean": 2, "identifier": 2}}, "classification").select("id", "distance")


# Ridge on one column that is imputed by its mean and scaled, both fitted on the fold's training rows, in closed form.
CV = """WITH d AS (SELECT o_totalprice AS y, CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 97)::DOUBLE END AS x, {fold} AS fold FROM orders), k AS (SELECT * FROM range({first}, {last}) r(fold)),
    m AS (SELECT k.fold, avg(x) AS mx, avg(y) AS my, count(*)::DOUBLE AS n FROM k JOIN d ON {train} GROUP BY 1),
    s AS (SELECT m.fold, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, stddev_pop(coalesce(x, mx)) AS sx FROM m JOIN d ON {train2} GROUP BY 1),
    w AS (SELECT s.fold, any_value(mx) AS mx, any_value(my) AS my, any_value(sx) AS sx, sum((coalesce(x, mx) - mx) / sx * (y - my)) / (any_value(n) + 1) AS w FROM s JOIN d ON {train3} GROUP BY 1),
    e AS (SELECT w.fold, y, my + w * (coalesce(x, mx) - mx) / sx AS p FROM w JOIN d USING (fold)),
    r AS (SELECT fold, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2 FROM e GROUP BY 1)
    SELECT CAST(fold AS INTEGER) AS fold, 'validation' AS part, metric, value FROM r UNPIVOT (value FOR metric IN (rmse, mae, r2))"""


def _cv_rows(t, fold):
    return t("orders").select(F.col("o_totalprice").alias("y"), F.expr("CASE WHEN o_custkey % 5 != 0 THEN CAST(o_custkey % 97 AS DOUBLE) END").alias("x"), fold.cast("int").alias("fold"))


RIDGE = pipeline.Spec(imputers={"x": "mean"}, scaler="standard")


@query(CV.format(fold="o_orderkey % 3", first=0, last=3, train="d.fold <> k.fold", train2="d.fold <> m.fold", train3="d.fold <> s.fold"), "value")
def cv_linear(t):
    return model.cross_validate(_cv_rows(t, F.col("o_orderkey") % 3), RIDGE, "y", "linear", "regression")


@query(CV.format(fold="year(o_orderdate) % 4", first=1, last=4, train="d.fold < k.fold", train2="d.fold < m.fold", train3="d.fold < s.fold"), "value")
def cv_linear_time(t):
    return model.cross_validate(_cv_rows(t, F.year("o_orderdate") % 4), RIDGE, "y", "linear", "regression", ordered=True)


PREPARED = """WITH tr AS (SELECT * FROM orders WHERE o_custkey % 3 <> 0), q AS (SELECT quantile_cont(o_totalprice, 0.25)::DOUBLE AS a, quantile_cont(o_totalprice, 0.75)::DOUBLE AS b FROM tr),
    c AS (SELECT *, least(greatest(o_totalprice, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS x FROM orders, q), f AS (SELECT median(x) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w FROM c WHERE o_custkey % 3 <> 0),
    n AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS v FROM tr GROUP BY 1), g AS (SELECT o_clerk, sum(y) AS s, count(*) AS m FROM (SELECT o_custkey % 11 AS o_clerk, o_orderkey % 10 AS y FROM tr) GROUP BY 1)
    SELECT o_orderkey, (x - m) / w AS price, v AS priority, (s + 10 * (SELECT avg(o_orderkey % 10) FROM tr)) / (g.m + 10) AS clerk, (o_orderstatus = 'F')::INT::DOUBLE AS f, (o_orderstatus = 'O')::INT::DOUBLE AS o, (o_orderstatus = 'P')::INT::DOUBLE AS p
    FROM c CROSS JOIN f JOIN n USING (o_orderpriority) JOIN g ON g.o_clerk = o_custkey % 11"""


@query(PREPARED.replace("SELECT o_orderkey, (x - m) / w", "SELECT o_orderkey, (x - f.m) / w"), "price priority clerk f o p")
def prepared(t):
    rows = t("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 11).cast("string").alias("clerk"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 10).cast("double").alias("y"))
    spec = pipeline.Spec(imputers={"price": "median"}, scaler="robust", outliers=("cap", ["price"]), encoders={"priority": "frequency", "clerk": "target_encoding", "status": "one_hot"})
    out = pipeline.fit_spec(spec, rows.where("o_custkey % 3 != 0"), "y").transform(rows)
    v = vector_to_array(pipeline.FEATURES)
    return out.select("o_orderkey", *(v[i].alias(c) for i, c in enumerate(["price", "priority", "clerk", "f", "o", "p"])))


CLASSES = """WITH x AS (SELECT o_orderkey % 3 AS y, unnest([0, 1, 2]) AS c, (o_custkey % 101) / 100.0::DOUBLE AS s FROM orders), r AS (SELECT c, (y = c)::INT AS hit, s2, rank() OVER (PARTITION BY c ORDER BY s2) + (count(*) OVER (PARTITION BY c, s2) - 1) / 2.0::DOUBLE AS k
        FROM (SELECT *, CASE c WHEN 0 THEN s WHEN 1 THEN s * s WHEN 2 THEN 1 - s END AS s2 FROM x))
    SELECT c AS class, count(*) AS n, CAST(sum(hit) AS BIGINT) AS n_positive, ((sum(k) FILTER (hit = 1)) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit)))::DOUBLE AS auc FROM r GROUP BY 1"""


@query(CLASSES, "auc")
def metrics_auc_classes(t):
    s = (F.col("o_custkey") % 101) / 100.0
    rows = t("orders").select((F.col("o_orderkey") % 3).alias("y"), F.array(s, s * s, 1 - s).alias("scores"))
    return metrics.roc_auc_classes(rows, "y", "scores")


CATEGORY_SHIFT = """WITH c AS (SELECT o_orderpriority AS v, count(*) FILTER (o_custkey % 4 = 0) AS a, count(*) FILTER (o_custkey % 4 <> 0) AS b FROM orders GROUP BY 1),
    s AS (SELECT *, (a + b) * sum(a) OVER () / (sum(a + b) OVER ())::DOUBLE AS ea, (a + b) * sum(b) OVER () / (sum(a + b) OVER ())::DOUBLE AS eb FROM c)
    SELECT CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, CAST(count(*) AS INTEGER) AS k, sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb) AS chi2 FROM s"""


@query(CATEGORY_SHIFT, "chi2")
def shift_categories(t):
    return associate.shift_categories(t("orders").withColumn("first", F.col("o_custkey") % 4 == 0), "o_orderpriority", "first")


@query("""WITH x AS (SELECT *, (o_orderstatus <> 'F')::INT::DOUBLE AS e FROM orders), d AS (SELECT o_orderpriority AS v, abs(corr(h, e)) AS r FROM (SELECT y.o_orderpriority, (x.o_orderpriority = y.o_orderpriority)::INT::DOUBLE AS h, e FROM x, (SELECT DISTINCT o_orderpriority FROM orders) y WHERE y.o_orderpriority > (SELECT min(o_orderpriority) FROM orders)) GROUP BY 1)
    SELECT 'o_totalprice' AS "column", abs(corr(o_totalprice, e)) AS strength FROM x UNION ALL SELECT 'o_custkey', abs(corr(o_custkey, e)) FROM x UNION ALL SELECT 'o_orderpriority', max(r) FROM d""", "strength")
def segment_columns(t):
    return model.segment_columns(t("orders").withColumn("e", (F.col("o_orderstatus") != "F").cast("int")), "e", ["o_totalprice", "o_custkey", "o_orderpriority"])


@query("""WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|42')), doc_id) AS k, count(*) OVER (PARTITION BY toxic) AS n FROM labels), m AS (SELECT max(n) AS most FROM r)
    SELECT doc_id, toxic, most // n + (k <= most % n)::INT AS copies FROM r, m""")
def resample_rows(t):
    return model.resample(t("labels").select("doc_id", "toxic"), "toxic", "doc_id", "over").groupBy("doc_id", "toxic").agg(F.count("*").alias("copies"))


@query("""WITH c AS (SELECT o_orderstatus AS status, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_custkey) AS first, max(o_custkey) AS last FROM orders GROUP BY 1)
    SELECT status, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS n_made, low, high, first, last FROM c""", "low high")
def resample_smote(t):
    """Sizes and ranges: rows between two others never widen a class's range."""
    out = smote.smote(t("orders"), "o_orderstatus", "o_orderkey", ["o_totalprice", "o_custkey"]).groupBy(F.col("o_orderstatus").alias("status"))
    price, customer = F.col("o_totalprice"), F.col("o_custkey")
    return out.agg(F.count("*").alias("n"), F.count_if("_made").alias("n_made"), F.min(price).alias("low"), F.max(price).alias("high"), F.min(customer).alias("first"), F.max(customer).alias("last"))


@query("SELECT arg_max(CAST(user_id AS VARCHAR), (value, -user_id)) AS run, max(value) AS number FROM (SELECT user_id, arg_max_null(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1)", "number")
def run_best(t):
    rows = t("events").select(F.col("event_type").alias("experiment"), F.col("user_id").cast("string").alias("run"), F.lit("metric").alias("kind"), F.lit("value").alias("key"), F.lit(None).cast("string").alias("value"), F.col("value").alias("number"), F.col("event_id").cast("double").alias("at"))
    best = tracking.best_run(rows, "click", "value")
    return t("region").sparkSession.createDataFrame([(best["run"], best["metrics"]["value"])], "run string, number double")


@query()
def cv_trees(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_orderkey") % 3).cast("int").alias("fold"))
    return model.cross_validate(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "tree_ensemble", "regression")


@query()
def boost_classes(t):
    """Predicted status and its probability of every order, of trees boosted on them."""
    rows = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("day"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"))
    rows = VectorAssembler(inputCols=["price", "day"], outputCol="features").transform(rows)
    out = boost.SoftmaxBoost(labelCol="y", rounds=3, depth=3).fit(rows).transform(rows)
    return out.select("o_orderkey", "y", F.col("prediction").cast("int").alias("predicted"), F.round(F.array_max(vector_to_array("probability")), 9).alias("p"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity / (l_linenumber - 3)::DOUBLE END AS d,
    CASE WHEN l_linenumber <> 3 THEN -7 - (l_linenumber - 3) * floor(-7 / (l_linenumber - 3)::DOUBLE) END AS m, -pow(2.0, pow(l_linenumber % 3, 2)) + 1 AS p, l_tax >= 0.02 AND l_tax < l_discount OR l_quantity = 1 AS c FROM lineitem""", "d m p")
def derive_expressions(t):
    defs = {"d": "l_quantity / (l_linenumber - 3)", "m": "-7 % (l_linenumber - 3)", "p": "-2 ** (l_linenumber % 3) ** 2 + 1", "c": "0.02 <= l_tax < l_discount | l_quantity == 1"}
    rows = prepare.derive(t("lineitem"), [{"name": k, "expression_type": "row_wise", "definition": {"kind": "arithmetic", "expression": v}} for k, v in defs.items()])
    return rows.select("l_orderkey", "l_linenumber", "d", F.col("m").cast("double"), "p", "c")


def _poly(x, coefficients):
    return " + ".join(f"{c!r}::DOUBLE * pow({x}, {k})" for k, c in enumerate(coefficients))


def _ratio(x, pair):
    return f"(({_poly(x, pair[0])}) / ({_poly(x, pair[1])}))"


SHAPIRO = f"""WITH r AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) AS i, count(*) OVER () AS n FROM customer WHERE c_acctbal IS NOT NULL), p AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM r),
    q AS (SELECT *, p - 0.5 AS q, sqrt(-ln(least(p, 1 - p))) AS t FROM p), z AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio("(0.180625 - q * q)", tails.QUANTILE_MIDDLE)} WHEN t <= 5 THEN sign(q) * {_ratio("(t - 1.6)", tails.QUANTILE_NEAR)} ELSE sign(q) * {_ratio("(t - 5)", tails.QUANTILE_FAR)} END AS z FROM q),
    s AS (SELECT n, sum(z * z) AS zz, sum(z * x) FILTER (i BETWEEN 3 AND n - 2) AS zx, var_pop(x) AS v, max(x) FILTER (i = n) - max(x) FILTER (i = 1) AS d1, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS d2, max(z) FILTER (i = n) AS z1, max(z) FILTER (i = n - 1) AS z2 FROM z GROUP BY n),
    a AS (SELECT *, z1 / sqrt(zz) + {_poly("(1 / sqrt(n))", tails.WEIGHT_OUTER)} AS a1, z2 / sqrt(zz) + {_poly("(1 / sqrt(n))", tails.WEIGHT_NEXT)} AS a2 FROM s)
    SELECT 'c_acctbal' AS "column", n, pow(a1 * d1 + a2 * d2 + zx / sqrt((zz - 2 * z1 * z1 - 2 * z2 * z2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / (n * v) AS w FROM a WHERE n < 5000"""


@query(SHAPIRO, "w")
def normality_few(t):
    return associate.shapiro_wilk(t("customer"), ["c_acctbal"]).select("column", "n", "w")


# Lattice paths from (0, 0) to (n1, n2), a diagonal at a time, that stay closer than d.
EXACT_KS = """WITH RECURSIVE c AS (SELECT s_acctbal AS v, count(*) FILTER (s_nationkey < 12)::DOUBLE AS a, count(*) FILTER (s_nationkey >= 12)::DOUBLE AS b FROM supplier GROUP BY 1),
    s AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)), x AS (SELECT max(n1) AS n1, max(n2) AS n2, max(abs(ca / n1 - cb / n2)) AS d FROM s),
    p AS (SELECT 0 AS i, 0 AS j, 1.0::DOUBLE AS paths UNION ALL
        SELECT i, j, sum(paths) AS paths FROM (SELECT i + 1 AS i, j, paths FROM p UNION ALL SELECT i, j + 1, paths FROM p), x WHERE i <= n1 AND j <= n2 AND abs(i * n2 - j * n1) < round(d * n1 * n2) GROUP BY i, j)
    SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, d, 1 - coalesce((SELECT max(paths) FROM p, x WHERE i = n1 AND j = n2), 0) * exp(lgamma(n1 + 1) + lgamma(n2 + 1) - lgamma(n1 + n2 + 1)) AS p_value FROM x"""


@query(EXACT_KS, "d p_value")
def shift_exact(t):
    return associate.shift(t("supplier").withColumn("first", F.col("s_nationkey") < 12), "s_acctbal", "first").drop("shifted")


@query("SELECT metric, avg(value) AS mean, stddev_pop(value) AS std FROM (" + CV.format(fold="o_orderkey % 3", first=0, last=3, train="d.fold <> k.fold", train2="d.fold <> m.fold", train3="d.fold <> s.fold") + ") GROUP BY 1", "mean std")
def cv_summary(t):
    return metrics.fold_summary(model.cross_validate(_cv_rows(t, F.col("o_orderkey") % 3), RIDGE, "y", "linear", "regression"))


@query("""WITH s AS (SELECT (o_custkey % 101) / 100.0::DOUBLE AS s, (o_orderkey % 3 = 0)::INT AS y FROM orders), h AS (SELECT k, k / 100.0::DOUBLE AS t, sum(y) FILTER (s >= k / 100.0::DOUBLE - 1e-12) AS tp, count(*) FILTER (s >= k / 100.0::DOUBLE - 1e-12) AS called, sum(y) AS all_ FROM s, range(1, 100) r(k) GROUP BY k)
    SELECT arg_max(t, (2.0::DOUBLE * tp / (called + all_), -k)) AS threshold FROM h""", "threshold")
def best_threshold_orders(t):
    rows = t("orders").select(((F.col("o_custkey") % 101) / 100.0).alias("s"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("y"))
    return metrics.thresholds(rows, "y", "s").agg(F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"))


@query("SELECT o_orderstatus AS class, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE AS weight FROM orders GROUP BY 1", "weight")
def class_weights_orders(t):
    counts = t("orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("n"))
    return counts.join(metrics.class_weights(t("orders"), "o_orderstatus"), "class")


# Pool of adjacent violators as the slope of the greatest convex minorant: the largest mean up to here of the least means from here on.
ISOTONIC = """WITH c AS (SELECT (o_custkey % 37)::DOUBLE AS score, sum((o_orderstatus = 'F')::INT)::DOUBLE AS y, count(*)::DOUBLE AS w FROM orders GROUP BY 1),
    b AS (SELECT *, sum(y) OVER (ORDER BY score) AS sy, sum(w) OVER (ORDER BY score) AS sw FROM c),
    m AS (SELECT a.score AS low, z.score AS high, (z.sy - a.sy + a.y) / (z.sw - a.sw + a.w) AS mean FROM b a JOIN b z ON a.score <= z.score),
    k AS (SELECT c.score, m.low, min(m.mean) AS least FROM c JOIN m ON m.low <= c.score AND m.high >= c.score GROUP BY 1, 2)
    SELECT score, max(least) AS calibrated FROM k GROUP BY 1"""


@query(ISOTONIC, "calibrated")
def calibrated_isotonic(t):
    rows = t("orders").select((F.col("o_custkey") % 37).cast("double").alias("score"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return model.calibrate(rows, "y", "isotonic").transform(rows.select("score").distinct())


@query()
def mutual_info_neighbours(t):
    return neighbours.of_category(t("orders"), "o_totalprice", "o_orderpriority").select("n", F.round("mi", 9).alias("mi"))


@query()
def mutual_info_numbers(t):
    return neighbours.of_numbers(t("part"), "p_retailprice", "p_size").select("n", F.round("mi", 9).alias("mi"))
