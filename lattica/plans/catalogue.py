"""The catalogue: one query per operator over the test tables, and the SQL that gives the same rows.

The tables stand in for materials data: rows of lineitem and orders are samples with numeric features,
parts get formulas by their key, events and customers have groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import formula as fm
from lattica.functions import metrics as mt
from lattica.functions import oxidation
from lattica.functions.order import hash_number
from lattica.operators import analysis, baselines, cleaning, clustering, domain, features, kernels, learning, models, neighbours, scaling, search, selection, splits, trees, uncertainty
from lattica.plans import applicability, dataset, evaluate, experiment, linear_sql, predict, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---------------------------------------------------------------- common inputs
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    out = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 5).alias("split"), F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") / 1000).alias("y_true"), ((F.col("o_totalprice") + (c % 97 - 48) * 100) / 1000).alias("y_pred"), (0.5 + (c % 13) * 0.3).alias("y_err"))
    return out.withColumn("residual", F.col("y_pred") - F.col("y_true"))


P = "p AS (SELECT *, y_pred - y_true AS residual FROM (SELECT o_orderkey AS row_id, o_orderkey % 5 AS split, o_orderpriority AS grp, o_totalprice / 1000 AS y_true, (o_totalprice + (o_custkey % 97 - 48) * 100) / 1000 AS y_pred, 0.5::DOUBLE + (o_custkey % 13) * 0.3::DOUBLE AS y_err FROM orders))"

FORMULAS = ("NaCl", "Al2O3", "SrTiO3", "La0.75Sr0.25MnO3", "Fe2O3", "Al3Cu7", "Al0.5Cu0.5", "MgO", "Si", "TiO2", "GaAs", "CuZn")
FORMULA_SQL = f"f AS (SELECT p_partkey, ({list(FORMULAS)})[p_partkey % {len(FORMULAS)} + 1] AS formula FROM part)"
PARTS_SQL = FORMULA_SQL + """, raw AS (SELECT formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 1)) AS element, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 2)) AS a FROM (SELECT DISTINCT formula FROM f)),
 e AS (SELECT formula, element, sum(CASE WHEN a = '' THEN 1.0::DOUBLE ELSE a::DOUBLE END) AS amount FROM raw GROUP BY ALL), fr AS (SELECT *, amount / sum(amount) OVER (PARTITION BY formula) AS fraction FROM e)"""


def with_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    return part.withColumn("formula", F.element_at(F.array(*[F.lit(x) for x in FORMULAS]), (F.col("p_partkey") % len(FORMULAS) + 1).cast("int")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.elements(with_formula(spark, sf_dir), "formula")


PROPERTIES = tuple(sorted({p for _, _, p, _ in fm.element_rows()}))


def properties(spark: SparkSession) -> DataFrame:
    return fm.element_table(spark).where(F.col("property").isin(*PROPERTIES))


PROPERTY_SQL = "t(element, property, value) AS (VALUES " + ", ".join(f"('{e}', '{p}', {v}::DOUBLE)" for e, _, p, v in fm.element_rows() if p in PROPERTIES) + ")"


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("value")).alias("value"), (F.col("user_id") % 7).cast("double").alias("score"), F.when(F.col("event_id") % 7 == 0, None).otherwise((F.col("user_id") % 5).cast("double")).alias("level"))


H = "h AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value, (user_id % 7)::DOUBLE AS score, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (user_id % 5)::DOUBLE END AS level FROM events)"


def h32(cols: str, seed: str = "0") -> str:
    joined = " || '|' || ".join(c.strip() for c in cols.split(","))
    return f"(('0x' || substr(md5('{seed}|' || {joined}), 1, 8))::BIGINT)"


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LINE_KEY = ", ".join(LINE)


# ---------------------------------------------------------------- flagship: cross-validated linear model
def _cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_extendedprice")
    df = li.withColumn("fold", (hash_number(*LINE) % 5).cast("int"))
    fitted = models.linear_cv(df, ["l_quantity"], "l_extendedprice", "fold")
    return models.predict_linear(df, fitted, ["l_quantity"], "fold").withColumn("y_true", F.col("l_extendedprice"))


CV = f"""d AS (SELECT l_quantity AS x, l_extendedprice AS y, {h32(LINE_KEY)} % 5 AS fold FROM lineitem),
m AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d, (SELECT DISTINCT fold FROM d) k WHERE d.fold <> k.fold GROUP BY k.fold),
s AS (SELECT d.fold, d.y AS t, a + b * x AS p FROM d JOIN m ON d.fold = m.fold)"""


@query(f"WITH {CV} SELECT fold::INT AS fold, round(avg(abs(t - p)), 4) AS mean_absolute_error, round(sqrt(avg((t - p) * (t - p))), 4) AS root_mean_squared_error, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS r2_score FROM s GROUP BY fold")
def cv_linear_metrics(spark, sf_dir):
    out = mt.evaluate(_cv(spark, sf_dir), ["mean_absolute_error", "root_mean_squared_error", "r2_score"], ["fold"])
    return out.select("fold", F.round("mean_absolute_error", 4).alias("mean_absolute_error"), F.round("root_mean_squared_error", 4).alias("root_mean_squared_error"), F.round("r2_score", 6).alias("r2_score"))


@query(f"WITH {CV}, q AS (SELECT fold, avg(abs(t - p)) AS v FROM s GROUP BY fold) SELECT 'mean_absolute_error' AS metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS stdev FROM q")
def cv_linear_overall(spark, sf_dir):
    per = mt.evaluate(_cv(spark, sf_dir), ["mean_absolute_error"], ["fold"])
    return rounded(mt.over_splits(per, ["mean_absolute_error"]), 4)


# ---------------------------------------------------------------- A: sources and roles
@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def load_roles(spark, sf_dir):
    return dataset.load(table(spark, sf_dir, "part"), "p_partkey", features=["p_size"], target="p_retailprice").projected()


@query("SELECT o_custkey, round(avg(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY o_custkey")
def average_duplicates(spark, sf_dir):
    return rounded(dataset.average_duplicates(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderstatus"), "o_custkey"), 4)


@query("SELECT c_custkey, 'out_a' AS leave_out_set FROM customer WHERE c_nationkey % 5 = 0 UNION ALL SELECT c_custkey, 'out_b' FROM customer WHERE c_acctbal < 0")
def left_out_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") % 5 == 0).cast("int").alias("out_a"), (F.col("c_acctbal") < 0).cast("int").alias("out_b"))
    return dataset.load(c, "c_custkey", features=[], target="c_acctbal", leave_out=["out_a", "out_b"]).left_out()


@query(f"WITH {P} SELECT round(stddev_pop(y_true), 6) AS dataset_stdev FROM (SELECT DISTINCT y_true FROM p)")
def distinct_stdev(spark, sf_dir):
    return rounded(uncertainty.distinct_stdev(predictions(spark, sf_dir), "y_true"))


# ---------------------------------------------------------------- B: cleaning
@query(f"WITH {H} SELECT * FROM h WHERE value IS NOT NULL AND level IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    return cleaning.drop_rows_with_null(holes(spark, sf_dir))


@query(f"WITH {H} SELECT event_id, score FROM h")
def drop_null_columns(spark, sf_dir):
    return cleaning.drop_columns_with_null(holes(spark, sf_dir))


@query(f"WITH {H} SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value, score, round(coalesce(level, avg(level) OVER ()), 6) AS level FROM h")
def impute_mean(spark, sf_dir):
    return cleaning.impute(holes(spark, sf_dir), ["value", "level"], "mean").select("event_id", F.round("value", 6).alias("value"), "score", F.round("level", 6).alias("level"))


@query(f"WITH {H}, s AS (SELECT median(value) AS mv, median(level) AS ml FROM h) SELECT event_id, round(coalesce(value, mv), 6) AS value, score, coalesce(level, ml) AS level FROM h, s")
def impute_median(spark, sf_dir):
    return cleaning.median_fill(holes(spark, sf_dir), ["value", "level"]).withColumn("value", F.round("value", 6))


@query(f"WITH {H}, s AS (SELECT level AS m FROM h WHERE level IS NOT NULL GROUP BY level ORDER BY count(*) DESC, level LIMIT 1) SELECT event_id, value, score, coalesce(level, m) AS level FROM h, s")
def impute_most_frequent(spark, sf_dir):
    return cleaning.impute(holes(spark, sf_dir), ["level"], "most_frequent")


@query(f"WITH {H} SELECT event_id, coalesce(value, -1.0::DOUBLE) AS value, score, level FROM h")
def impute_constant(spark, sf_dir):
    return cleaning.impute(holes(spark, sf_dir), ["value"], "constant", -1.0)


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) SELECT event_id, 'value' AS \"column\", value FROM events, s WHERE abs(value - m) > 3 * d")
def flag_outliers(spark, sf_dir):
    return cleaning.outliers(table(spark, sf_dir, "events"), "event_id", ["value"])


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d, avg(o_custkey) AS n, stddev_pop(o_custkey) AS f FROM orders) SELECT o_orderkey, ((abs(o_totalprice - m) > 1.5 * d)::INT + (abs(o_custkey - n) > 1.5 * f)::INT)::BIGINT AS n_outliers FROM orders, s WHERE abs(o_totalprice - m) > 1.5 * d OR abs(o_custkey - n) > 1.5 * f")
def outlier_counts(spark, sf_dir):
    found = cleaning.outliers(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice", "o_custkey"], 1.5)
    return cleaning.outlier_counts(found, "o_orderkey")


@query("SELECT unnest(['c_name', 'c_mktsegment']) AS \"column\"")
def flag_string_columns(spark, sf_dir):
    found = cleaning.columns_with_strings(table(spark, sf_dir, "customer"))
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part")
def coerce_numeric(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"), "p_retailprice", "p_name")
    return cleaning.to_numeric(part, keep=["p_partkey"])


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def drop_constant(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.lit(1).alias("one"))
    return cleaning.drop_constant_columns(s, ["s_acctbal", "one"])


@query("SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k, c_nationkey AS y FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k")
def merge_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return cleaning.merge_columns(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x")), c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("y")), "k")


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.c_nationkey, b.c_nationkey) AS c_nationkey, c_acctbal, c_mktsegment FROM (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0) b ON a.c_custkey = b.c_custkey AND a.c_nationkey = b.c_nationkey")
def merge_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return cleaning.merge_rows(c.where("c_custkey % 2 = 0").select("c_custkey", "c_nationkey", "c_acctbal"), c.where("c_custkey % 3 = 0").select("c_custkey", "c_nationkey", "c_mktsegment"))


def _describe_sql(c: str, t: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stdev, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, max({c})::DOUBLE AS max FROM {t}"


@query(_describe_sql("p_size", "part") + " UNION ALL " + _describe_sql("p_retailprice", "part"))
def describe_numbers(spark, sf_dir):
    return rounded(cleaning.describe(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


@query("WITH g AS (SELECT c_mktsegment AS v, count(*) AS freq FROM customer GROUP BY 1) SELECT 'c_mktsegment' AS \"column\", sum(freq)::BIGINT AS n, count(*) AS n_distinct, (SELECT v FROM g ORDER BY freq DESC, v LIMIT 1) AS top, max(freq) AS freq FROM g")
def describe_text(spark, sf_dir):
    return cleaning.describe_text(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_of_duplicates(spark, sf_dir):
    return cleaning.first_of_duplicates(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query(f"WITH {H} SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value, score, round(coalesce(level, avg(level) OVER ()), 6) AS level FROM h")
def clean_by_mean(spark, sf_dir):
    return rounded(cleaning.clean(holes(spark, sf_dir), "event_id", "impute", ["value", "level"]).data)


@query()
def ppca_impute(spark, sf_dir):
    return rounded(cleaning.ppca(holes(spark, sf_dir), "event_id", ["value", "score", "level"], 2, rounds=8), 4)


# ---------------------------------------------------------------- C: scalers
def _scaled(name: str, expression: str, **options):
    def run(spark, sf_dir):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
        return rounded(scaling.Scaler(name, **options).fit_transform(part, ["p_retailprice"]))

    run.__name__ = "scale_" + name.lower()
    query(f"WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sp, stddev_samp(p_retailprice) AS ss, min(p_retailprice) AS lo, max(p_retailprice) AS hi, max(abs(p_retailprice)) AS ma, median(p_retailprice) AS md, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.75) AS q3 FROM part) SELECT p_partkey, round({expression}, 6) AS p_retailprice FROM part, s")(run)


_scaled("StandardScaler", "(p_retailprice - m) / sp")
_scaled("MinMaxScaler", "(p_retailprice - lo) / (hi - lo)")
_scaled("MaxAbsScaler", "p_retailprice / ma")
_scaled("RobustScaler", "(p_retailprice - md) / (q3 - q1)")
_scaled("MeanStdevScaler", "(p_retailprice - m) / ss * 2 + 1", mean=1.0, stdev=2.0)
_scaled("NoPreprocessor", "p_retailprice")


@query("SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part")
def scale_inverse(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    scaler = scaling.Scaler("StandardScaler").fit(part, ["p_retailprice"])
    return rounded(scaler.inverse(scaler.transform(part)))


@query("SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_retailprice FROM part")
def normalize_rows(spark, sf_dir):
    return rounded(scaling.normalize(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"]))


@query("SELECT p_partkey, round((pow(p_size + 1, 0.5::DOUBLE) - 1) / 0.5::DOUBLE, 6) AS p_size FROM part")
def power_transform(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", scaling.yeo_johnson(F.col("p_size").cast("double"), 0.5).alias("p_size")))


@query("WITH s AS (SELECT quantile_cont(p_retailprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM part), q AS (SELECT p_partkey, p_retailprice AS x, e, len([v FOR v IN e IF v <= p_retailprice]) - 1 AS k FROM part, s) SELECT p_partkey, round(CASE WHEN k >= 4 THEN 1.0 ELSE (k + (x - e[k + 1]) / (e[k + 2] - e[k + 1])) / 4 END::DOUBLE, 6) AS p_retailprice FROM q")
def quantile_scale(spark, sf_dir):
    return rounded(scaling.quantile_transform(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 4))


@query("SELECT p_partkey, (p_size > 25)::INT::DOUBLE AS p_size FROM part")
def binarize(spark, sf_dir):
    return scaling.binarize(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_size"], 25)


@query("WITH s AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part) SELECT p_partkey, p_size, least(floor((p_size - lo) / (hi - lo) * 7), 6)::INT AS bin FROM part, s")
def bins_uniform(spark, sf_dir):
    return scaling.bins(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 7)


@query("WITH s AS (SELECT quantile_cont(p_size, [0.25, 0.5, 0.75]) AS e FROM part) SELECT p_partkey, p_size, len(list_filter(e, lambda x: x <= p_size))::INT AS bin FROM part, s")
def bins_quantile(spark, sf_dir):
    return scaling.bins(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 4, "quantile")


# ---------------------------------------------------------------- D: compositions and features
@query(f"WITH {PARTS_SQL} SELECT formula, element, round(amount, 6) AS amount, round(fraction, 6) AS fraction FROM fr")
def composition_fractions(spark, sf_dir):
    return rounded(fm.fractions(parts(spark, sf_dir), "formula"))


@query(f"""WITH {PARTS_SQL}, {PROPERTY_SQL}, j AS (SELECT formula, property, sum(value * amount) / sum(amount) AS a, avg(value) AS b, max(value) AS c, min(value) AS d, max(value) - min(value) AS r FROM fr JOIN t USING (element) GROUP BY ALL)
SELECT formula, property || '_composition_average' AS feature, round(a, 6) AS value FROM j UNION ALL SELECT formula, property || '_arithmetic_average', round(b, 6) FROM j UNION ALL SELECT formula, property || '_max_value', c FROM j UNION ALL SELECT formula, property || '_min_value', d FROM j UNION ALL SELECT formula, property || '_difference', r FROM j""")
def element_features(spark, sf_dir):
    return rounded(features.element_features(parts(spark, sf_dir), properties(spark), "formula"))


@query(f"WITH {PARTS_SQL}, g AS (SELECT formula, max(CASE WHEN element = 'O' THEN fraction END) AS o, max(CASE WHEN element = 'Al' THEN fraction END) AS al FROM fr GROUP BY formula) SELECT p_partkey, formula, round(coalesce(o, 0), 6) AS \"O\", round(coalesce(al, 0), 6) AS \"Al\" FROM f JOIN g USING (formula)")
def element_fraction_vector(spark, sf_dir):
    wide = features.element_fractions(parts(spark, sf_dir), "formula").select("formula", "O", "Al")
    return rounded(with_formula(spark, sf_dir).join(wide, "formula").select("p_partkey", "formula", "O", "Al"))


@query(f"""WITH {PARTS_SQL}, {PROPERTY_SQL}, j AS (SELECT formula, property, fraction, value, sum(fraction * value) OVER w AS m, max(fraction) OVER w AS top FROM fr JOIN t USING (element) WINDOW w AS (PARTITION BY formula, property)),
q AS (SELECT formula, property, max(m) AS avg, sum(fraction * abs(value - m)) AS dev, max(value) - min(value) AS range, max(value) AS max, min(value) AS min, min(CASE WHEN fraction = top THEN value END) AS mode FROM j GROUP BY ALL)
SELECT formula, k || '_' || property AS feature, round(v, 6) AS value FROM (UNPIVOT q ON avg, dev, range, max, min, mode INTO NAME k VALUE v)""")
def composition_statistics(spark, sf_dir):
    return rounded(features.composition_statistics(parts(spark, sf_dir), properties(spark), "formula"))


@query(f"WITH {PARTS_SQL} SELECT element, round(sum(amount), 6) AS amount, count(*) AS formulas FROM e GROUP BY element")
def element_prevalence(spark, sf_dir):
    return rounded(features.element_prevalence(parts(spark, sf_dir)))


@query(f"WITH {PARTS_SQL} SELECT formula, max((element = 'O')::INT)::DOUBLE AS \"has_O\", max((element = 'Cu')::INT)::DOUBLE AS \"has_Cu\" FROM e GROUP BY formula")
def one_hot_elements(spark, sf_dir):
    return features.one_hot_elements(parts(spark, sf_dir), "formula").select("formula", "has_O", "has_Cu")


@query(f"WITH {PARTS_SQL} SELECT formula, element, round(amount, 6) AS amount FROM e WHERE formula IN (SELECT formula FROM e GROUP BY formula HAVING count(*) > 1)")
def drop_pure_elements(spark, sf_dir):
    return rounded(features.drop_pure_elements(parts(spark, sf_dir), "formula"))


@query(f"WITH {FORMULA_SQL} SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(formula, '[^a-zA-Z]+', '', 'g'), '([A-Z][a-z]?)', 1))), '-') AS system FROM f")
def chemical_system(spark, sf_dir):
    return with_formula(spark, sf_dir).select("p_partkey", fm.chemical_system(F.col("formula")).alias("system"))


Z_SQL = f"z AS (SELECT unnest({list(fm.SYMBOLS)}) AS element, unnest(range(1, {len(fm.SYMBOLS) + 1}))::INT AS z)"


@query(f"WITH {PARTS_SQL}, {Z_SQL} SELECT formula, (row_number() OVER (PARTITION BY formula ORDER BY amount DESC, element) - 1)::INT AS place, z, round(fraction, 6) AS fraction FROM fr JOIN z USING (element)")
def element_matrix(spark, sf_dir):
    m = features.element_matrix(parts(spark, sf_dir), "formula")
    return rounded(m.select("formula", F.posexplode(F.arrays_zip("z", "fraction")).alias("place", "e")).select("formula", "place", "e.z", "e.fraction"))


@query(f"""WITH {PARTS_SQL}, {PROPERTY_SQL}, j AS (SELECT formula, property, fraction, value, sum(fraction * value) OVER w AS m, max(fraction) OVER w AS top FROM fr JOIN t USING (element) WINDOW w AS (PARTITION BY formula, property)),
q AS (SELECT formula, property, max(m) AS avg, sum(fraction * abs(value - m)) AS dev, max(value) - min(value) AS range, max(value) AS max, min(value) AS min, min(CASE WHEN fraction = top THEN value END) AS mode, max(m) AS sum FROM j GROUP BY ALL)
SELECT formula, k || '_' || property AS feature, round(v, 6) AS value FROM (UNPIVOT q ON avg, dev, range, max, min, mode, sum INTO NAME k VALUE v)""")
def collapsed_matrix(spark, sf_dir):
    return rounded(features.collapsed(features.element_matrix(parts(spark, sf_dir), "formula"), fm.element_table(spark).where(F.col("property").isin(*PROPERTIES)), "formula"))


@query(f"WITH {PARTS_SQL}, {PROPERTY_SQL}, o AS (SELECT formula, element, row_number() OVER (PARTITION BY formula ORDER BY element) AS i FROM e) SELECT formula, 'Element' || i || '_' || property AS feature, value FROM o JOIN t USING (element)")
def element_positions(spark, sf_dir):
    return features.positional_features(parts(spark, sf_dir), properties(spark), "formula")


@query("SELECT p_brand, p_retailprice, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1")
def most_stable_entry(spark, sf_dir):
    return features.most_stable(table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_partkey", "p_size"), "p_brand", "p_retailprice")


#: Covalent radius in angstrom (Cordero 2008) and electronegativity (Pauling).
ALLOY = {
    "O": (0.66, 3.44), "Na": (1.66, 0.93), "Mg": (1.41, 1.31), "Al": (1.21, 1.61), "Si": (1.11, 1.90), "Cl": (1.02, 3.16), "Ti": (1.60, 1.54), "Mn": (1.39, 1.55),
    "Fe": (1.32, 1.83), "Cu": (1.32, 1.90), "Zn": (1.22, 1.65), "Ga": (1.22, 1.81), "As": (1.19, 2.18), "Sr": (1.95, 0.95), "La": (2.07, 1.10),
}
ALLOY_SQL = "v(element, r, e) AS (VALUES " + ", ".join(f"('{k}', {r}::DOUBLE, {e}::DOUBLE)" for k, (r, e) in ALLOY.items()) + ")"


@query(f"""WITH {PARTS_SQL}, {ALLOY_SQL}, q AS (SELECT formula, sum(fraction * r) AS m, sum(fraction * v.e) AS e_mean, -8.314462618::DOUBLE * sum(fraction * ln(fraction)) AS s_mix, sum(fraction * r * r) AS rr, min(r) AS lo, max(r) AS hi FROM fr JOIN v USING (element) GROUP BY formula)
SELECT formula, round(m, 6) AS r_mean, round(e_mean, 6) AS e_mean, round(s_mix, 6) + 0.0::DOUBLE AS s_mix, round(sqrt(greatest(rr / (m * m) - 1, 0)), 4) AS delta, round((1 - sqrt((pow(lo + m, 2) - m * m) / pow(lo + m, 2))) / (1 - sqrt((pow(hi + m, 2) - m * m) / pow(hi + m, 2))), 6) AS gamma FROM q""")
def alloy_descriptors(spark, sf_dir):
    radius = spark.createDataFrame([(k, r) for k, (r, _) in ALLOY.items()], "element string, value double")
    negative = spark.createDataFrame([(k, e) for k, (_, e) in ALLOY.items()], "element string, value double")
    out = features.alloy_descriptors(parts(spark, sf_dir), radius, negative, "formula")
    # the mismatch of pure elements is the root of a rounding error
    return rounded(out.withColumn("delta", F.round("delta", 4)).withColumn("s_mix", F.round("s_mix", 6) + 0.0))


#: Formulas with brackets, a cage and an unreadable one, with what they hold.
DEEP = {
    "Li3Fe2(PO4)3": {"Li": 3, "Fe": 2, "P": 3, "O": 12}, "Y3N@C80": {"Y": 3, "N": 1, "C": 80}, "[La0.75Sr0.25][Mn][O3]": {"La": 0.75, "Sr": 0.25, "Mn": 1, "O": 3}, "NaCl)": {},
    "Ca5(PO4)3(OH)": {"Ca": 5, "P": 3, "O": 13, "H": 1}, "K4[Fe(CN)6]": {"K": 4, "Fe": 1, "C": 6, "N": 6},
}


@query(f"WITH f AS (SELECT DISTINCT ({list(DEEP)})[p_partkey % {len(DEEP)} + 1] AS formula FROM part), v(formula, element, amount) AS (VALUES " + ", ".join(f"('{f}', '{e}', {a}::DOUBLE)" for f, each in DEEP.items() for e, a in each.items()) + ") SELECT formula, element, amount FROM f JOIN v USING (formula)")
def nested_formulas(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.element_at(F.array(*[F.lit(x) for x in DEEP]), (F.col("p_partkey") % len(DEEP) + 1).cast("int")).alias("formula"))
    return rounded(fm.elements(part, "formula"))


@query("SELECT p_partkey, a, b, 1.0::DOUBLE AS \"1\", a AS \"a^1\", b AS \"b^1\", round(a * a, 6) AS \"a^2\", round(a * b, 6) AS \"a b\", round(b * b, 6) AS \"b^2\" FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)")
def polynomial_features(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return rounded(features.polynomial(part, ["a", "b"]))


@query("WITH g AS (SELECT DISTINCT o_orderstatus AS v FROM orders), n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM g) SELECT o_orderkey, o_orderstatus, (i = 0)::INT::DOUBLE AS o_orderstatus_0, (i = 1)::INT::DOUBLE AS o_orderstatus_1, (i = 2)::INT::DOUBLE AS o_orderstatus_2 FROM orders JOIN n ON v = o_orderstatus")
def one_hot_group(spark, sf_dir):
    return features.one_hot_group(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


# ---------------------------------------------------------------- E: selection
NUMBERS = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")


XS = list(NUMBERS[:3])
#: d: rows with their fold; t: the training rows of each fold's model.
FOLDS = f"""d AS (SELECT {", ".join(XS)}, l_extendedprice AS y, {h32(LINE_KEY)} % 5 AS fold FROM lineitem), t AS (SELECT k.fold, d.* EXCLUDE (fold) FROM d JOIN (SELECT DISTINCT fold FROM d) k ON d.fold <> k.fold)"""


def _subset(names: list[str]) -> str:
    """RMSE by fold of the fits with these features."""
    return f"SELECT d.fold, sqrt(avg(pow(y - {linear_sql.predicted(names)}, 2))) AS r FROM d JOIN ({linear_sql.fit('t', 'fold', names, 'y')}) USING (fold) GROUP BY d.fold"


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance FROM lineitem" for c in NUMBERS[:3]))
def feature_variance(spark, sf_dir):
    return rounded(selection.variances(table(spark, sf_dir, "lineitem"), list(NUMBERS[:3])))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def correlation_matrix(spark, sf_dir):
    return rounded(selection.correlations(table(spark, sf_dir, "lineitem"), list(NUMBERS)))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 2) AS f FROM lineitem" for c in NUMBERS[:3]))
def f_scores(spark, sf_dir):
    return rounded(selection.f_scores(table(spark, sf_dir, "lineitem"), list(NUMBERS[:3]), "l_extendedprice"), 2)


@query("SELECT * FROM (SELECT 'l_quantity' AS left_feature, 'l_extendedprice' AS right_feature, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem) WHERE abs(r) > 0.1 UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0")
def correlated_selections(spark, sf_dir):
    return rounded(selection.between_sets(table(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_extendedprice", "l_quantity"], 0.1))


@query("WITH s AS (SELECT avg(l_quantity) AS m FROM lineitem) SELECT 'l_quantity' AS feature, round(sum(abs(3 * (l_quantity - m))), 2) AS total FROM lineitem, s")
def linear_shapley(spark, sf_dir):
    return rounded(selection.linear_shap(table(spark, sf_dir, "lineitem"), {"l_quantity": 3.0}, ["l_quantity"]), 2)


SUBSETS = [[c for i, c in enumerate(XS) if mask >> i & 1] for mask in range(1, 2 ** len(XS))]


@query(f"WITH {FOLDS}, s AS (" + " UNION ALL ".join(f"SELECT {n} AS names, avg(r) AS r FROM ({_subset(n)})" for n in SUBSETS) + """),
a AS (SELECT names[1] AS f, r FROM s WHERE len(names) = 1 ORDER BY r, f LIMIT 1),
b AS (SELECT [x FOR x IN names IF x <> a.f][1] AS f, s.r FROM s, a WHERE len(names) = 2 AND list_contains(names, a.f) ORDER BY s.r, 1 LIMIT 1),
c AS (SELECT [x FOR x IN names IF x <> a.f AND x <> b.f][1] AS f, s.r FROM s, a, b WHERE len(names) = 3)
SELECT 0 AS place, f AS feature, round(r, 4) AS rmse FROM a UNION ALL SELECT 1, f, round(r, 4) FROM b UNION ALL SELECT 2, f, round(r, 4) FROM c""")
def forward_selection(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("fold", (hash_number(*LINE) % 5).cast("int"))
    got = selection.forward(df, list(NUMBERS[:3]), "l_extendedprice", "fold", 3)
    return spark.createDataFrame([(i, c, round(s, 4)) for i, (c, s) in enumerate(got)], "place int, feature string, rmse double")


_TWICE = "q AS (SELECT l_quantity, 2 * l_quantity + l_tax AS twice, l_discount, l_tax, l_extendedprice FROM lineitem)"


SALTS = ("NaCl", "Al2O3", "SrTiO3", "Fe3O4", "Fe2O3", "FeO", "La2CuO4", "MnO2", "KMnO4", "SO3", "H2SO4", "NH4Cl", "Cu", "XeF6", "V2O5", "CaCO3", "Mn2O7", "CuZn", "PbO2", "La0.5Sr0.5MnO3")


@query(f"""WITH RECURSIVE s(element, q) AS (VALUES {", ".join(f"('{e}', {q})" for e, qs in oxidation.STATES.items() for q in qs)}), f AS (SELECT p_partkey, ({list(SALTS)})[p_partkey % {len(SALTS)} + 1] AS formula FROM part),
raw AS (SELECT formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 1)) AS element, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*[.]?[0-9]*)', 2)) AS a FROM (SELECT DISTINCT formula FROM f)),
e AS (SELECT formula, element, sum(CASE WHEN a = '' THEN 1.0::DOUBLE ELSE a::DOUBLE END) AS amount, row_number() OVER (PARTITION BY formula ORDER BY element) AS k, count(*) OVER (PARTITION BY formula) AS n FROM raw GROUP BY formula, element),
w AS (SELECT formula, 0::BIGINT AS k, 0.0::DOUBLE AS total, []::INT[] AS qs FROM (SELECT DISTINCT formula FROM e) UNION ALL SELECT w.formula, e.k, w.total + e.amount * s.q, list_append(w.qs, s.q) FROM w JOIN e ON e.formula = w.formula AND e.k = w.k + 1 JOIN s USING (element)),
g AS (SELECT w.formula, arg_min(qs, (list_max(qs) - list_min(qs), qs)) AS qs FROM w JOIN (SELECT DISTINCT formula, n FROM e) USING (formula) WHERE w.k = n AND abs(total) <= 1e-6 GROUP BY w.formula)
SELECT p_partkey, f.formula, CASE WHEN n = 1 THEN element || ':0' ELSE (SELECT string_agg(element || ':' || g.qs[k], ',' ORDER BY k) FROM e WHERE e.formula = f.formula AND g.qs IS NOT NULL) END AS charges FROM f JOIN (SELECT formula, any_value(n) AS n, any_value(element) AS element FROM e GROUP BY formula) USING (formula) LEFT JOIN g ON g.formula = f.formula""")
def oxidation_states(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in SALTS]), (F.col("p_partkey") % len(SALTS) + 1).cast("int")).alias("formula"))
    found = oxidation.guess(fm.elements(part, "formula"), "formula")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("charges")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return part.join(found.select("formula", text.alias("charges")), "formula").select("p_partkey", "formula", "charges")


@query(f"WITH {_TWICE}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS r FROM q" for c in ("l_quantity", "twice", "l_discount", "l_tax")) + ") SELECT (row_number() OVER (ORDER BY r DESC, feature) - 1)::INT AS place, feature FROM r WHERE feature <> 'twice' OR (SELECT abs(corr(l_quantity, twice)) FROM q) < 0.9")
def pearson_selection(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("twice", 2 * F.col("l_quantity") + F.col("l_tax"))
    got = selection.pearson(li, ["l_quantity", "twice", "l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame(list(enumerate(got)), "place int, feature string")


# ---------------------------------------------------------------- F: splits
@query(f"SELECT o_orderkey, ({h32('o_orderkey')} % 5)::INT AS fold FROM orders")
def folds_by_hash(spark, sf_dir):
    return splits.hash_folds(table(spark, sf_dir, "orders"), "o_orderkey", 5)


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('0|' || o_orderkey)) - 1) % 5)::INT AS fold FROM orders")
def folds_exact(spark, sf_dir):
    return splits.exact_folds(table(spark, sf_dir, "orders"), "o_orderkey", 5)


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0|' || o_orderkey)) - 1) % 5)::INT AS fold FROM orders")
def folds_stratified(spark, sf_dir):
    return splits.exact_folds(table(spark, sf_dir, "orders"), "o_orderkey", 5, stratum="o_orderstatus")


@query(" UNION ALL ".join(f"SELECT {r} AS repeat, o_orderkey, ({h32('o_orderkey', str(r))} % 3)::INT AS fold FROM orders" for r in range(2)))
def folds_repeated(spark, sf_dir):
    return splits.repeated_folds(table(spark, sf_dir, "orders"), "o_orderkey", 3, 2)


def _grouped(spark, sf_dir):
    """Events of which some have no type, and others no user."""
    e, hole = table(spark, sf_dir, "events"), lambda c, k: F.when(F.col("event_id") % k != 0, F.col(c)).alias(c)
    return e.select("event_id", hole("event_type", 10), hole("user_id", 11))


GROUPED = "e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id FROM events)"


@query(f"WITH {GROUPED} SELECT event_id, (dense_rank() OVER (ORDER BY event_type NULLS FIRST) - 1)::INT AS fold FROM e")
def folds_leave_one_group(spark, sf_dir):
    return splits.leave_one_group_out(_grouped(spark, sf_dir), "event_id", "event_type")


@query(f"WITH {GROUPED}, g AS (SELECT user_id AS u, (row_number() OVER (ORDER BY count(*) DESC, user_id NULLS FIRST) - 1) % 4 AS fold FROM e GROUP BY user_id) SELECT event_id, fold::INT AS fold FROM e JOIN g ON user_id IS NOT DISTINCT FROM u")
def folds_of_groups(spark, sf_dir):
    return splits.group_folds(_grouped(spark, sf_dir), "event_id", "user_id", 4)


@query(f"WITH {GROUPED}, g AS (SELECT event_type AS g, (row_number() OVER (ORDER BY event_type NULLS FIRST) - 1)::INT AS split FROM (SELECT DISTINCT event_type FROM e)) SELECT split, event_id, CASE WHEN event_type IS NOT DISTINCT FROM g THEN 'train' ELSE 'test' END AS role, 1 AS weight FROM e, g")
def split_each_group(spark, sf_dir):
    return splits.just_each_group(_grouped(spark, sf_dir), "event_id", "event_type")


@query("SELECT 0 AS split, s_suppkey, unnest(['train', 'test']) AS role, 1 AS weight FROM supplier")
def split_none(spark, sf_dir):
    return splits.no_split(table(spark, sf_dir, "supplier"), "s_suppkey")


@query("WITH r AS (SELECT split, o_orderkey, row_number() OVER (PARTITION BY split ORDER BY md5('0|' || split || '|' || o_orderkey)) AS k FROM orders, (SELECT unnest(range(0, 3)) AS split)), n AS (SELECT ceil(count(*) * 0.2::DOUBLE) AS most FROM orders) SELECT split::INT AS split, o_orderkey, CASE WHEN k <= most THEN 'test' ELSE 'train' END AS role, 1 AS weight FROM r, n")
def split_leave_out_percent(spark, sf_dir):
    return splits.leave_out_percent(table(spark, sf_dir, "orders"), "o_orderkey", 0.2, 3)


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders), q AS (SELECT *, floor(n / 5) AS test FROM r) SELECT o_orderkey, CASE WHEN k <= n - test * 4 THEN 0 ELSE ceil((k - (n - test * 4)) / test) END::INT AS block FROM q")
def folds_in_time(spark, sf_dir):
    return splits.time_series_folds(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderdate"), 4)


@query("WITH g AS (SELECT DISTINCT event_type AS g FROM events), c AS (SELECT (row_number() OVER (ORDER BY a.g, b.g) - 1)::INT AS split, a.g AS a, b.g AS b FROM g a, g b WHERE a.g < b.g) SELECT split, event_id, CASE WHEN event_type IN (a, b) THEN 'test' ELSE 'train' END AS role, 1 AS weight FROM events, c")
def split_leave_groups_out(spark, sf_dir):
    return splits.leave_multi_groups_out(table(spark, sf_dir, "events"), "event_id", "event_type", 2)


@query(f"""WITH r AS (SELECT split, s_suppkey, row_number() OVER (PARTITION BY split ORDER BY md5('0|' || split || '|' || s_suppkey)) AS k, ceil((SELECT count(*) FROM supplier) * 0.5::DOUBLE)::BIGINT AS cut, (SELECT count(*) FROM supplier) AS n FROM supplier, (SELECT unnest(range(0, 3)) AS split)),
q AS (SELECT split, s_suppkey, CASE WHEN k <= cut THEN 'train' ELSE 'test' END AS role, CASE WHEN k <= cut THEN k - 1 ELSE k - 1 - cut END AS place, CASE WHEN k <= cut THEN cut ELSE n - cut END AS size FROM r),
d AS (SELECT split, role, {h32('split, role, place', 'draw0')} % size AS place, count(*)::INT AS weight FROM q GROUP BY 1, 2, 3) SELECT q.split::INT AS split, s_suppkey, q.role, weight FROM q JOIN d USING (split, role, place)""")
def split_bootstrap(spark, sf_dir):
    return splits.bootstrap(table(spark, sf_dir, "supplier"), "s_suppkey", 3)


@query("WITH t AS (SELECT p_partkey, count(*) OVER (PARTITION BY p_size, p_brand) > 1 AS twin FROM part) SELECT split, p_partkey, CASE WHEN twin = (split = 0) THEN 'test' ELSE 'train' END AS role, 1 AS weight FROM t, (SELECT unnest([0, 1]) AS split)")
def split_twins(spark, sf_dir):
    return splits.leave_out_twins(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_brand"])


@query("SELECT s_suppkey FROM supplier a WHERE EXISTS (SELECT 1 FROM supplier b WHERE a.s_suppkey <> b.s_suppkey AND sqrt(pow(a.s_acctbal - b.s_acctbal, 2) + pow(a.s_nationkey - b.s_nationkey, 2)) <= 20)")
def twins_within(spark, sf_dir):
    return splits.twins(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"], 20.0)


_STEPS = [0.0]
while _STEPS[-1] < 20_000:
    _STEPS.append((_STEPS[-1] or 0.1) * 1.1)


@query(f"WITH d AS (SELECT a.s_suppkey, min(round(sqrt(pow(a.s_acctbal - b.s_acctbal, 2) + pow(a.s_nationkey - b.s_nationkey, 2)), 12)) AS d FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey), t AS (SELECT unnest({_STEPS})::DOUBLE AS t), c AS (SELECT t, count(*) AS n FROM t JOIN d ON d <= t GROUP BY t), b AS (SELECT min(t) AS t FROM c WHERE n >= greatest(floor(0.3 * (SELECT count(*) FROM supplier)), 2)) SELECT s_suppkey, round(t, 6) AS threshold FROM d, b WHERE d <= t")
def twins_automatic(spark, sf_dir):
    threshold, found, _ = splits.auto_twins(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"], ceiling=0.3)
    return found.select("s_suppkey", F.lit(round(threshold, 6)).alias("threshold"))


_PAIRS = "x AS (SELECT s_suppkey AS id, s_acctbal / 100 AS a, s_nationkey::DOUBLE AS b FROM supplier), d AS (SELECT p.id AS u, q.id AS v, round(sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2)), 12) AS d FROM x p, x q)"


@query(f"WITH RECURSIVE {_PAIRS}, n AS (SELECT u, v, d FROM d WHERE d <= 5), core AS (SELECT u FROM n GROUP BY u HAVING count(*) >= 3), r AS (SELECT u AS a, u AS b FROM core UNION SELECT r.a, n.v FROM r JOIN n ON n.u = r.b WHERE n.v IN (SELECT u FROM core)), c AS (SELECT a AS u, min(b) AS cluster FROM r GROUP BY a), e AS (SELECT n.u, arg_min(c.cluster, (n.d, n.v)) AS cluster FROM n JOIN c ON c.u = n.v WHERE n.u NOT IN (SELECT u FROM core) GROUP BY n.u) SELECT id AS s_suppkey, coalesce(c.cluster, e.cluster) AS cluster, c.u IS NOT NULL AS core FROM x LEFT JOIN c ON c.u = id LEFT JOIN e ON e.u = id")
def clusters_by_density(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("a"), "s_nationkey")
    return clustering.dbscan(s, "s_suppkey", ["a", "s_nationkey"], 5.0, 3)


@query(f"WITH RECURSIVE {_PAIRS}, n AS (SELECT u, v FROM d WHERE d <= 4), r AS (SELECT id AS a, id AS b FROM x UNION SELECT r.a, n.v FROM r JOIN n ON n.u = r.b) SELECT a AS s_suppkey, min(b) AS cluster FROM r GROUP BY a")
def clusters_by_links(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("a"), "s_nationkey")
    return clustering.single_link(s, "s_suppkey", ["a", "s_nationkey"], distance=4.0)


@query(f"WITH o AS (SELECT unnest(range(0, 3)) AS outer_) SELECT outer_::INT AS \"outer\", s_suppkey, CASE WHEN {h32('s_suppkey', 'outer')} % 3 <> outer_ THEN {h32('outer_, s_suppkey', 'inner')} % 2 END::INT AS \"inner\" FROM supplier, o")
def split_nested(spark, sf_dir):
    return splits.nested(table(spark, sf_dir, "supplier"), "s_suppkey", 3, 2)


@query(f"WITH {PARTS_SQL}, n AS (SELECT formula, sum(fraction * fraction) AS q FROM fr GROUP BY formula), d AS (SELECT a.formula AS split, b.formula AS member, a.q + b.q - 2 * coalesce((SELECT sum(x.fraction * y.fraction) FROM fr x JOIN fr y USING (element) WHERE x.formula = a.formula AND y.formula = b.formula), 0) AS d2 FROM n a, n b) SELECT split, member FROM d WHERE d2 <= 0.09 + 1e-12")
def close_compositions(spark, sf_dir):
    return splits.close_compositions(fm.fractions(parts(spark, sf_dir), "formula"), "formula", 0.3)


#: The ladder Al(i)Cu(10 - i), with two formulas of ten elements that have none in common.
LADDER = tuple(f"Al{i}Cu{10 - i}" if 0 < i < 10 else ("Cu" if i == 0 else "Al") for i in range(11)) + ("HLiBeBCNOFNaMg", "SiPSClKCaScTiVCr", "AlSiPS", "AlSiP")
LADDER_SQL = (
    f"raw AS (SELECT formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS element, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 2)) AS a FROM (SELECT DISTINCT ({list(LADDER)})[p_partkey % {len(LADDER)} + 1] AS formula FROM part)), "
    "e AS (SELECT formula, element, sum(CASE WHEN a = '' THEN 1.0::DOUBLE ELSE a::DOUBLE END) AS amount FROM raw GROUP BY ALL), fr AS (SELECT *, amount / sum(amount) OVER (PARTITION BY formula) AS fraction FROM e)"
)


@query(f"WITH {LADDER_SQL}, n AS (SELECT formula, sum(fraction * fraction) AS q FROM fr GROUP BY formula), d AS (SELECT a.formula AS split, b.formula AS member, a.q + b.q - 2 * coalesce((SELECT sum(x.fraction * y.fraction) FROM fr x JOIN fr y USING (element) WHERE x.formula = a.formula AND y.formula = b.formula), 0) AS d2 FROM n a, n b) SELECT split, member FROM d WHERE d2 <= 0.25 + 1e-12")
def close_compositions_half(spark, sf_dir):
    ladder = F.element_at(F.array(*[F.lit(x) for x in LADDER]), (F.col("p_partkey") % len(LADDER) + 1).cast("int"))
    elements = fm.elements(table(spark, sf_dir, "part").select("p_partkey", ladder.alias("formula")), "formula")
    return splits.close_compositions(fm.fractions(elements, "formula"), "formula", 0.5)


@query()
def folds_by_cluster(spark, sf_dir):
    return splits.cluster_folds(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"], 3)


# ---------------------------------------------------------------- G, H: models and search


ALL_64 = tuple(f"x{i}" for i in range(64))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(ALL_64)], F.col("label").cast("double").alias("label"))


V = "v AS (SELECT vec_id, label::DOUBLE AS label, embedding::DOUBLE[64] AS x FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS n, b.label AS y, round(array_distance(a.x, b.x), 12) AS dist FROM v a, v b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, n) AS k FROM d)"


@query(f"WITH {V} SELECT vec_id, round(avg(y), 6) AS y_pred FROM r WHERE k <= 5 GROUP BY vec_id")
def knn_regression(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = neighbours.nearest(v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0"), "vec_id", ALL_64, "label", 5)
    return rounded(models.knn_regress(near, "vec_id"))


@query(f"WITH {V} SELECT vec_id, y AS y_fake FROM r WHERE k = 1")
def baseline_nearest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return baselines.nearest(v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0"), "vec_id", ALL_64, "label")


@query(f"""WITH {FOLDS}, a AS (SELECT unnest({[10.0**k for k in range(-2, 5)]})::DOUBLE AS alpha), m AS (SELECT fold, {linear_sql.moments(XS, "y")} FROM t GROUP BY fold), f AS (SELECT fold, alpha, {linear_sql.coefficients(XS, "y", "alpha")} FROM m, a),
s AS (SELECT alpha, f.fold, avg(pow(y - {linear_sql.predicted(XS)}, 2)) AS mse FROM d JOIN f USING (fold) GROUP BY ALL) SELECT alpha, round(avg(mse), 2) AS mean_score, round(stddev_pop(mse), 2) AS std_score, row_number() OVER (ORDER BY avg(mse), alpha)::INT AS rank FROM s GROUP BY alpha""")
def ridge_grid(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("fold", (hash_number(*LINE) % 5).cast("int"))
    scores = search.ridge_scores(df, list(NUMBERS[:3]), "l_extendedprice", "fold", search.parse_space("alpha", "-2 4 7 log float")["alpha"])
    return rounded(search.summarize(scores, "alpha", "mse"), 2)


def _elastic(alpha: float, ratio: float) -> str:
    """A fold's fit of one feature with both penalties, in closed form."""
    slope = f"sign(c) * greatest(abs(c) - {alpha * ratio}, 0) / (v + {alpha * (1 - ratio)})"
    return f"m AS (SELECT fold, covar_pop(l_quantity, y) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS x, avg(y) AS z FROM t GROUP BY fold) SELECT fold::INT AS fold, round({slope}, 6) AS \"b_l_quantity\", round(z - x * {slope}, 6) AS b0 FROM m"


@query(f"WITH {FOLDS}, " + _elastic(1000.0, 1.0))
def lasso_folds(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("fold", (hash_number(*LINE) % 5).cast("int"))
    return rounded(models.linear_cv(df, ["l_quantity"], "l_extendedprice", "fold", 1000.0, 1.0))


@query(f"WITH {FOLDS}, " + _elastic(500.0, 0.5))
def elastic_net_folds(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("fold", (hash_number(*LINE) % 5).cast("int"))
    return rounded(models.linear_cv(df, ["l_quantity"], "l_extendedprice", "fold", 500.0, 0.5))


def _priced(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.md5(F.concat_ws("|", *LINE)).alias("row_id"), (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 20).alias("b"), (F.col("l_extendedprice") / 10000).alias("y"), (hash_number(*LINE) % 3).cast("int").alias("fold"))


@query()
def kernel_ridge_folds(spark, sf_dir):
    return rounded(kernels.kernel_ridge(_priced(spark, sf_dir), "row_id", ["a", "b"], "y", "fold", 0.5, 1.0, 100), 6)


@query()
def gaussian_process_folds(spark, sf_dir):
    return rounded(kernels.cross_validated(_priced(spark, sf_dir), "row_id", ["a", "b"], "y", "fold", "ConstantKernel*RBF+WhiteKernel", most=100), 6)


@query()
def gaussian_process_domain(spark, sf_dir):
    """Rows with a large discount, by the greatest deviation of cross-validated rows without one."""
    df = _priced(spark, sf_dir)
    train, test = df.where("b < 1.5"), df.where("b >= 1.5")
    errors = kernels.cross_validated(train, "row_id", ["a", "b"], "y", "fold", "RBF+WhiteKernel", most=100)
    model = kernels.fit(train, ["a", "b"], "y", "RBF+WhiteKernel", most=100, lengths=(0.5, 1.0, 2.0))
    return domain.by_error(kernels.predict(test, model, "row_id", ["a", "b"]), errors).select("row_id", "domain", F.round("y_err", 6).alias("y_err"))


def _sized(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 10).cast("int").alias("digit"), F.round(F.col("p_retailprice") * 100).alias("cents"))


def _draws_sql() -> str:
    """The Poisson(1) number at a share u of the distribution."""
    cumulative, term, steps = 0.0, 0.36787944117144233, []
    for k in range(1, 9):
        cumulative += term
        steps.append(f"(u >= {cumulative!r}::DOUBLE)::INT")
        term /= k
    return "(" + " + ".join(steps) + ")::DOUBLE"


def _forest_sql(n_trees: int, depth: int) -> str:
    """Trees over bags, a level after the other: sums by value, running sums, the best cut of each node."""
    out = f"""r0 AS MATERIALIZED (SELECT p_partkey, tree, 0 AS node, p_size::DOUBLE AS x0, (p_partkey % 10)::DOUBLE AS x1, round(p_retailprice * 100)::DOUBLE AS y, {_draws_sql()} AS w
 FROM (SELECT *, {h32("p_partkey, tree", "bag")} / 4294967296.0::DOUBLE AS u FROM part, (SELECT unnest(range({n_trees})) AS tree)))"""
    for k in range(depth):
        out += f""", h{k} AS (SELECT tree, node, f, x, sum(w) AS w, sum(w * y) AS s FROM (SELECT tree, node, 0 AS f, x0 AS x, w, y FROM r{k} UNION ALL SELECT tree, node, 1, x1, w, y FROM r{k}) WHERE w > 0 GROUP BY ALL),
 u{k} AS (SELECT tree, node, f, x, sum(w) OVER c AS wl, sum(s) OVER c AS sl, sum(w) OVER a AS wt, sum(s) OVER a AS st FROM h{k} WINDOW c AS (PARTITION BY tree, node, f ORDER BY x), a AS (PARTITION BY tree, node, f)),
 g{k} AS (SELECT *, sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) - st * st / wt AS gain FROM u{k} WHERE wl >= 1 AND wt - wl >= 1),
 b{k} AS MATERIALIZED (SELECT tree, node, f, x AS cut, gain FROM g{k} WHERE gain > 1e-9 * abs(st * st / wt) + 1e-12 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, x) = 1),
 r{k + 1} AS MATERIALIZED (SELECT p_partkey, tree, CASE WHEN f IS NULL THEN node ELSE 2 * node + 1 + ((CASE f WHEN 0 THEN x0 ELSE x1 END) > cut)::INT END AS node, x0, x1, y, w FROM r{k} LEFT JOIN b{k} USING (tree, node))"""
    return out


_BAG_X = ("l_quantity", "l_discount")
_BAG_SUMS = ", ".join(["sum(w) AS n", *[f"sum(w * {c}) / sum(w) AS m_{c}" for c in (*_BAG_X, "y")], *[f"sum(w * {a} * {b}) - sum(w * {a}) * sum(w * {b}) / sum(w) AS c_{a}_{b}" for i, a in enumerate((*_BAG_X, "y")) for b in (*_BAG_X, "y")[i:]]])


@query(f"WITH d AS (SELECT md5(concat_ws('|', {LINE_KEY}, l_quantity, l_extendedprice)) AS row_id, l_quantity, l_discount, l_extendedprice AS y FROM lineitem), e AS (SELECT *, {h32('row_id, bag', 'bag')} / 4294967296.0::DOUBLE AS u FROM d, (SELECT unnest(range(8)) AS bag)), f AS (SELECT bag, {linear_sql.coefficients(list(_BAG_X), 'y')} FROM (SELECT bag, {_BAG_SUMS} FROM (SELECT *, {_draws_sql()} AS w FROM e) GROUP BY bag)) SELECT row_id, round(avg({linear_sql.predicted(list(_BAG_X))}), 3) AS y_pred, round(stddev_pop({linear_sql.predicted(list(_BAG_X))}), 3) AS y_err FROM d, f GROUP BY row_id")
def bagged_linear(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.md5(F.concat_ws("|", *LINE, "l_quantity", "l_extendedprice")).alias("row_id"), "l_quantity", "l_discount", "l_extendedprice")
    fitted = models.bagged_linear(df, "row_id", ["l_quantity", "l_discount"], "l_extendedprice", 8)
    return rounded(models.predict_bags(df, fitted, ["l_quantity", "l_discount"]).select("row_id", "y_pred", "y_err"), 3)


@query(f"WITH {_forest_sql(4, 2)}, v AS (SELECT tree, node, sum(w * y) / sum(w) AS value FROM r2 GROUP BY ALL) SELECT p_partkey, round(avg(value), 4) AS y_pred, round(stddev_pop(value), 4) AS y_err FROM r2 JOIN v USING (tree, node) GROUP BY p_partkey")
def forest_regression(spark, sf_dir):
    df = _sized(spark, sf_dir)
    forest = trees.random_forest(df, "p_partkey", ["p_size", "digit"], "cents", 4, 2)
    return rounded(trees.predict(df, forest).select("p_partkey", "y_pred", "y_err"), 4)


@query(f"WITH {_forest_sql(4, 2)}, g AS (SELECT tree, f, gain FROM b0 UNION ALL SELECT tree, f, gain FROM b1), t AS (SELECT tree, f, sum(gain) / sum(sum(gain)) OVER (PARTITION BY tree) AS share FROM g GROUP BY tree, f), a AS (SELECT unnest(range(4)) AS tree), n AS (SELECT unnest([0, 1]) AS f) SELECT CASE f WHEN 0 THEN 'p_size' ELSE 'digit' END AS feature, round(avg(coalesce(share, 0)), 6) AS importance FROM a CROSS JOIN n LEFT JOIN t USING (tree, f) GROUP BY f")
def forest_importance(spark, sf_dir):
    forest = trees.random_forest(_sized(spark, sf_dir), "p_partkey", ["p_size", "digit"], "cents", 4, 2)
    return rounded(spark.createDataFrame(list(forest.importance().items()), "feature string, importance double"))


@query()
def extra_trees_regression(spark, sf_dir):
    df = _sized(spark, sf_dir)
    forest = trees.extra_trees(df, "p_partkey", ["p_size", "digit"], "cents", 5, 3)
    return rounded(trees.predict(df, forest).select("p_partkey", "y_pred", "y_err"), 4)


@query()
def ada_boost_regression(spark, sf_dir):
    df = _sized(spark, sf_dir)
    forest = trees.ada_boost(df, "p_partkey", ["p_size", "digit"], "cents", 4, 3)
    return rounded(trees.predict(df, forest).select("p_partkey", "y_pred", "y_err"), 4)


@query()
def forest_jackknife(spark, sf_dir):
    df = _sized(spark, sf_dir)
    forest = trees.random_forest(df, "p_partkey", ["p_size", "digit"], "cents", 10, 3)
    products, n = trees.bag_products(df, "p_partkey", 10)
    return rounded(trees.jackknife(trees.predict(df, forest), products, n).select("p_partkey", "y_pred", "variance"), 4)


@query()
def forest_shapley(spark, sf_dir):
    df = _sized(spark, sf_dir)
    forest = trees.random_forest(df, "p_partkey", ["p_size", "digit"], "cents", 4, 3)
    return rounded(trees.shapley_importance(df, forest, "p_partkey"), 2)


_BASE = f"{FOLDS}, m AS (SELECT fold, {linear_sql.moments(XS, 'y')} FROM t GROUP BY fold)"
_SCORED = "sqrt(avg(pow(y - p, 2))) AS root_mean_squared_error, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2_score, avg(abs(y - p)) AS mean_absolute_error"


def _member(name: str, selector: str, alpha: float) -> str:
    if selector == "all":
        return f"SELECT '{name}' AS model, 'all' AS selector, d.fold AS split, {_SCORED} FROM (SELECT d.fold, d.y, {linear_sql.predicted(XS)} AS p FROM d JOIN (SELECT fold, {linear_sql.coefficients(XS, 'y', str(alpha))} FROM m) USING (fold)) d GROUP BY d.fold"
    best = "CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END"
    corr = ", ".join(f"abs(c_{x}_y) / sqrt(c_{x}_{x} * c_y_y) AS r{i}" for i, x in enumerate(XS))
    slope = "CASE b " + " ".join(f"WHEN {i} THEN c_{x}_y / (c_{x}_{x} + {alpha})" for i, x in enumerate(XS)) + " END"
    mean = "CASE b " + " ".join(f"WHEN {i} THEN m_{x}" for i, x in enumerate(XS)) + " END"
    value = "CASE b " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(XS)) + " END"
    return f"SELECT '{name}' AS model, 'best' AS selector, fold AS split, {_SCORED} FROM (SELECT d.fold, y, m_y + {slope} * ({value} - {mean}) AS p FROM d JOIN (SELECT *, {best} AS b FROM (SELECT *, {corr} FROM m)) USING (fold)) GROUP BY fold"


@query(f"WITH {_BASE}, s AS (" + " UNION ALL ".join(_member(n, s, a) for n, a in (("plain", 0.0), ("ridge", 5000.0)) for s in ("all", "best")) + ") SELECT model, selector, split::INT AS split, metric, round(value, 4) AS value FROM (UNPIVOT s ON root_mean_squared_error, r2_score, mean_absolute_error INTO NAME metric VALUE value)")
def experiment_linear(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("|", *LINE).alias("row_id"), *NUMBERS)
    data = dataset.load(li, "row_id", features=XS, target="l_extendedprice")
    members = {"plain": experiment.Linear(), "ridge": experiment.Linear(5000.0)}
    return rounded(experiment.Experiment(data, members, {"all": experiment.all_features, "best": experiment.best_correlated(1)}, ("root_mean_squared_error", "r2_score", "mean_absolute_error")).run(), 4)


@query()
def experiment_kinds(spark, sf_dir):
    """A linear model, a forest, extra trees, a Gaussian process and neighbours on the same folds."""
    data = dataset.load(_sized(spark, sf_dir), "p_partkey", features=["p_size", "digit"], target="cents")
    members = {"linear": experiment.Linear(), "forest": experiment.forest(trees=4, depth=3), "gaussian": experiment.gaussian_process(kernel="RBF+WhiteKernel", most=60), "nearest": experiment.nearest(3)}
    return rounded(experiment.Experiment(data, members, k=2).run(), 4)


# ---------------------------------------------------------------- I: metrics
ALL = [m for m in mt.REGRESSION if m != "mean_squared_log_error"]
_MSE = "avg(pow(y_true - y_pred, 2))"
METRIC_SQL = f"""round(1 - var_pop(y_true - y_pred) / var_pop(y_true), 6) AS explained_variance, round(avg(abs(y_true - y_pred)), 6) AS mean_absolute_error, round({_MSE}, 6) AS mean_squared_error, round(median(abs(y_true - y_pred)), 6) AS median_absolute_error,
 round(1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)), 6) AS r2_score, round(1 - (sum(y_pred * y_pred) - sum(y_true * y_pred) * sum(y_true * y_pred) / sum(y_true * y_true)) / (var_pop(y_pred) * count(*)), 6) AS r2_score_noint,
 round(regr_r2(y_pred, y_true), 6) AS r2_score_fitted, round(sqrt({_MSE}), 6) AS root_mean_squared_error, round(sqrt({_MSE}) / stddev_pop(y_true), 6) AS rmse_over_stdev"""


def _incomplete(spark, sf_dir):
    """Predictions of which some are missing, and others have no true value or no error bar."""
    hole = lambda c, k: F.when(F.col("row_id") % k != 0, F.col(c)).alias(c)
    return predictions(spark, sf_dir).select("row_id", "split", hole("y_true", 9), hole("y_pred", 7), hole("y_err", 11), "residual")


INCOMPLETE = f"{P}, i AS (SELECT row_id, split, CASE WHEN row_id % 9 <> 0 THEN y_true END AS y_true, CASE WHEN row_id % 7 <> 0 THEN y_pred END AS y_pred, CASE WHEN row_id % 11 <> 0 THEN y_err END AS y_err, residual FROM p), c AS (SELECT * FROM i WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"


@query(f"WITH {INCOMPLETE} SELECT split, {METRIC_SQL} FROM c GROUP BY split")
def metrics_by_split(spark, sf_dir):
    return rounded(mt.evaluate(_incomplete(spark, sf_dir), ALL, ["split"]))


@query(f"WITH {P} SELECT grp, {METRIC_SQL} FROM p GROUP BY grp")
def metrics_by_group(spark, sf_dir):
    return rounded(mt.evaluate(predictions(spark, sf_dir), ALL, ["grp"]))


@query(f"WITH {INCOMPLETE} SELECT split, round(1 - (sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*))) * (count(*) - 1) / (count(*) - 4), 6) AS r2_score_adjusted FROM c GROUP BY split")
def metric_adjusted_r2(spark, sf_dir):
    return rounded(mt.evaluate(_incomplete(spark, sf_dir), ["r2_score_adjusted"], ["split"], n_features=3))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))


L = "l AS (SELECT quality AS t, 1 - toxic AS p FROM labels)"


@query(f"WITH {L} SELECT t AS label, p AS predicted, count(*) AS n FROM l GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return mt.confusion(_labels(spark, sf_dir))


@query(f"WITH {L}, g AS (SELECT c AS label, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t = c) AS n, count(*) FILTER (p = c) AS q FROM l, (SELECT DISTINCT t AS c FROM l UNION SELECT DISTINCT p FROM l) GROUP BY c) SELECT label, round(tp / q, 6) AS precision, round(tp / n, 6) AS recall, round(2 * tp / (n + q), 6) AS f1, n AS support FROM g")
def classification_report(spark, sf_dir):
    return rounded(mt.report(_labels(spark, sf_dir)))


@query(f"WITH {L} SELECT round(avg((t = p)::INT), 6) AS accuracy FROM l")
def accuracy(spark, sf_dir):
    return rounded(mt.accuracy(_labels(spark, sf_dir)))


@query("WITH s AS (SELECT (o_orderstatus = 'F')::INT AS l, o_custkey % 50 AS s FROM orders), r AS (SELECT l, (rank() OVER (ORDER BY s)) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM s) SELECT round((sum(CASE WHEN l = 1 THEN k END) - sum(l) * (sum(l) + 1) / 2) / (sum(l) * sum(1 - l)), 6) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("l"), (F.col("o_custkey") % 50).alias("s"))
    return rounded(mt.roc_auc(o, "l", "s"))


@query(f"WITH {L}, g AS (SELECT c AS label, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t = c) AS n, count(*) FILTER (p = c) AS q FROM l, (SELECT DISTINCT t AS c FROM l UNION SELECT DISTINCT p FROM l) GROUP BY c), h AS (SELECT tp / q AS a, tp / n AS b, 2 * tp / (n + q) AS f, n FROM g) SELECT 'macro' AS average, round(avg(a), 6) AS precision, round(avg(b), 6) AS recall, round(avg(f), 6) AS f1 FROM h UNION ALL SELECT 'weighted', round(sum(a * n) / sum(n), 6), round(sum(b * n) / sum(n), 6), round(sum(f * n) / sum(n), 6) FROM h")
def classification_averages(spark, sf_dir):
    return rounded(mt.averages(mt.report(_labels(spark, sf_dir))))


@query("WITH s AS (SELECT (o_orderstatus = 'F')::INT AS l, 0.05::DOUBLE + (o_custkey % 10) * 0.1::DOUBLE AS p FROM orders) SELECT round(avg(-CASE WHEN l = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM s")
def log_loss(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("l"), (0.05 + (F.col("o_custkey") % 10) * 0.1).alias("p"))
    return rounded(mt.log_loss(o, "l", "p"))


@query(f"WITH {P} SELECT round(avg(sqrt(2::DOUBLE) * abs(y_true - y_pred) * exp(-ln(y_err)) + ln(y_err)), 6) AS l1, round(avg(0.5::DOUBLE * pow(y_true - y_pred, 2) * exp(-2 * ln(y_err)) + ln(y_err)), 6) AS l2 FROM p")
def robust_losses(spark, sf_dir):
    t, p, s = F.col("y_true"), F.col("y_pred"), F.ln("y_err")
    return rounded(predictions(spark, sf_dir).agg(mt.robust_l1(t, p, s).alias("l1"), mt.robust_l2(t, p, s).alias("l2")))


# ---------------------------------------------------------------- J: baselines
@query(f"WITH {P} SELECT 'mean_absolute_error' AS metric, round(avg(abs(y_true - y_pred)), 6) AS real, round(avg(abs(y_true - m)), 6) AS naive FROM p, (SELECT avg(y_true) AS m FROM p)")
def baseline_mean(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(baselines.compare(p, baselines.mean_of(p, "row_id", "y_true"), "row_id", ["mean_absolute_error"]))


@query("WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5('own0|' || s_suppkey)) AS k FROM supplier), b AS (SELECT s_acctbal AS y_fake, row_number() OVER (ORDER BY md5('other0|' || s_suppkey)) AS k FROM supplier) SELECT s_suppkey, y_fake FROM a JOIN b USING (k)")
def baseline_permuted(spark, sf_dir):
    return baselines.permuted(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal")


@query("SELECT event_id, (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS y_fake FROM events")
def baseline_dominant_class(spark, sf_dir):
    return baselines.dominant_class(table(spark, sf_dir, "events"), "event_id", "event_type")


# ---------------------------------------------------------------- K: uncertainty
BIN_SQL = f"{P}, g AS (SELECT min(y_err) AS lo, (max(y_err) - min(y_err)) / 6 AS w FROM p), b AS (SELECT p.*, least(floor((y_err - lo) / w) + 1, 6)::INT AS bin FROM p, g)"


@query(f"WITH {INCOMPLETE}, g AS (SELECT min(y_err) AS lo, (max(y_err) - min(y_err)) / 6 AS w FROM i), b AS (SELECT i.*, CASE WHEN y_err IS NOT NULL THEN least(floor((y_err - lo) / w) + 1, 6) END::INT AS bin FROM i, g) SELECT bin, count(*) AS n, round(sqrt(avg(residual * residual)), 6) AS rms, round(avg(residual * residual), 6) AS ms, round(var_pop(residual * residual), 4) AS var_sq, round(avg(y_err), 6) AS sigma_mean FROM b GROUP BY bin")
def error_bin_statistics(spark, sf_dir):
    out = uncertainty.bin_statistics(uncertainty.error_bins(_incomplete(spark, sf_dir), 6))
    return rounded(out.withColumn("var_sq", F.round("var_sq", 4)))


@query(f"WITH {BIN_SQL}, s AS (SELECT count(*)::DOUBLE AS n, sqrt(avg(residual * residual)) AS y, avg(y_err) AS x FROM b GROUP BY bin), q AS (SELECT sum(n) AS w, sum(n * x) AS x, sum(n * y) AS y, sum(n * x * x) AS xx, sum(n * x * y) AS xy, sum(n * y * y) AS yy, count(*) FILTER (n > 30) AS well_sampled FROM s), z AS (SELECT *, xx - x * x / w AS sxx, xy - x * y / w AS sxy, yy - y * y / w AS syy FROM q) SELECT round(sxy / sxx, 5) AS slope, round((y - sxy / sxx * x) / w, 5) AS intercept, round(sxy * sxy / (sxx * syy), 5) AS r2, well_sampled FROM z")
def residual_against_error(spark, sf_dir):
    return rounded(uncertainty.residual_against_error(uncertainty.bin_statistics(uncertainty.error_bins(predictions(spark, sf_dir), 6))), 5)


@query(f"WITH {P} SELECT round(avg((1.8378770664093453 + 2 * ln(1.5 * y_err + 0.25) + pow(residual / (1.5 * y_err + 0.25), 2)) / 2), 6) AS nll FROM p")
def likelihood(spark, sf_dir):
    return predictions(spark, sf_dir).agg(F.round(uncertainty.nll(F.col("residual"), uncertainty.recalibrated(F.col("y_err"), [F.lit(1.5), F.lit(0.25)])), 6).alias("nll"))


@query()
def recalibration(spark, sf_dir):
    a, b = uncertainty.calibrate(predictions(spark, sf_dir).persist())
    return spark.createDataFrame([(round(a, 3), round(b, 3))], "a double, b double")


@query(f"WITH {BIN_SQL}, c(bin, a, b) AS (VALUES (1, 1.1, 0.1), (2, 1.2, 0.2), (3, 1.3, 0.3)) SELECT row_id, round(coalesce(c.a, 1.3)::DOUBLE * y_err + coalesce(c.b, 0.3)::DOUBLE, 6) AS y_err_cal FROM b LEFT JOIN c USING (bin)")
def apply_calibration(spark, sf_dir):
    c = spark.createDataFrame([(1, 1.1, 0.1), (2, 1.2, 0.2), (3, 1.3, 0.3)], "bin int, a double, b double")
    return rounded(uncertainty.apply_calibration(uncertainty.error_bins(predictions(spark, sf_dir), 6), c).select("row_id", "y_err_cal"))


LEARNERS = "w AS (SELECT row_id, [y_true + i * (row_id % 3) + CASE WHEN i = 11 THEN 500 ELSE 0 END FOR i IN range(0, 12)] AS a FROM p)"


def _learners(spark, sf_dir):
    value = lambda i: F.col("y_true") + i * (F.col("row_id") % 3) + F.when(i == 11, 500).otherwise(0)
    return predictions(spark, sf_dir).select("row_id", F.transform(F.sequence(F.lit(0), F.lit(11)), value).alias("learners"))


@query(f"WITH {P}, {LEARNERS}, k AS (SELECT row_id, a, list_avg(a) AS m, list_stddev_pop(a) AS s FROM w), z AS (SELECT row_id, [x FOR x IN a IF abs(x - m) <= 3 * s] AS b FROM k) SELECT row_id, round(list_avg(b), 5) AS y_pred, round(list_stddev_pop(b), 5) AS y_err, (12 - len(b))::INT AS n_dropped FROM z")
def learners_spread(spark, sf_dir):
    return rounded(models.with_deviation(uncertainty.drop_outlier_learners(_learners(spark, sf_dir))).select("row_id", "y_pred", "y_err", "n_dropped"), 5)


@query(f"WITH {P} SELECT split, round(avg(residual / y_err), 6) AS r_mean, round(stddev_pop(residual / y_err), 6) AS r_stdev FROM p WHERE y_err <> 0 GROUP BY split")
def r_statistics(spark, sf_dir):
    r = uncertainty.r_statistic(predictions(spark, sf_dir))
    return rounded(r.groupBy("split").agg(F.avg("r").alias("r_mean"), F.stddev_pop("r").alias("r_stdev")))


_T = "(1 / (1 + 0.2316419::DOUBLE * abs(level)))"
_PHI = f"(exp(-level * level / 2) / sqrt(2 * 3.141592653589793::DOUBLE) * (((((1.330274429::DOUBLE * {_T} - 1.821255978::DOUBLE) * {_T} + 1.781477937::DOUBLE) * {_T} - 0.356563782::DOUBLE) * {_T} + 0.319381530::DOUBLE) * {_T}))"


def _curve(source: str, by: str = "") -> str:
    """CTEs up to v(by, level, expected, observed): calibration curves from a table with residual and y_err."""
    key = f"{by}, " if by else ""
    return f"""r AS (SELECT {key}ceil((residual / y_err + 4) / 0.08::DOUBLE) AS k FROM {source}), c AS (SELECT {key}i, count(*) FILTER (k <= i) / count(*) AS observed FROM r, (SELECT unnest(range(0, 101)) AS i) GROUP BY ALL),
j AS (SELECT {key}i * 0.08::DOUBLE - 4 AS level, observed FROM c), v AS (SELECT {key}level, CASE WHEN level >= 0 THEN 1 - {_PHI} ELSE {_PHI} END AS expected, observed FROM j)"""


@query(f"WITH {P}, {_curve('p')} SELECT round(level, 6) AS level, round(expected, 6) AS expected, round(observed, 6) AS observed FROM v")
def calibration_curve(spark, sf_dir):
    return rounded(uncertainty.calibration_curve(uncertainty.r_statistic(predictions(spark, sf_dir))))


def _area(by: str = "") -> str:
    """CTE area(by, piece): the trapezoids between the curves of v."""
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"area AS (SELECT {key}(abs(observed - expected) + lag(abs(observed - expected)) OVER w) / 2 * (expected - lag(expected) OVER w) AS piece FROM v WINDOW w AS ({part}ORDER BY level))"


@query(f"WITH {P}, {_curve('p')}, {_area()} SELECT round(sum(piece), 6) AS area FROM area")
def miscalibration_area(spark, sf_dir):
    return rounded(uncertainty.miscalibration_area(uncertainty.calibration_curve(uncertainty.r_statistic(predictions(spark, sf_dir)))))


@query(f"WITH {BIN_SQL}, {_curve('b', 'bin')}, {_area('bin')} SELECT bin, round(sum(piece), 6) AS area FROM area GROUP BY bin")
def miscalibration_by_bin(spark, sf_dir):
    r = uncertainty.r_statistic(uncertainty.error_bins(predictions(spark, sf_dir), 6))
    return rounded(uncertainty.miscalibration_area(uncertainty.calibration_curve(r, by=["bin"]), by=["bin"]))


@query(f"WITH {BIN_SQL} SELECT bin, count(*) AS n, round(avg(residual / y_err), 6) AS r_mean, round(stddev_pop(residual / y_err), 6) AS r_stdev FROM b WHERE y_err <> 0 GROUP BY bin")
def r_statistics_by_bin(spark, sf_dir):
    return rounded(uncertainty.r_summary(uncertainty.r_statistic(uncertainty.error_bins(predictions(spark, sf_dir), 6)), ["bin"]))


@query()
def recalibration_by_bin(spark, sf_dir):
    return rounded(uncertainty.calibrate_bins(uncertainty.error_bins(predictions(spark, sf_dir), 6).persist()), 2)


@query(f"WITH {P} SELECT row_id, y_err, residual, round((SELECT stddev_pop(y_true) FROM (SELECT DISTINCT y_true FROM p WHERE split <> 0)), 6) AS dataset_stdev FROM p WHERE split <> 0")
def error_data(spark, sf_dir):
    part = F.when(F.col("split") == 0, "validation").otherwise("test")
    out = runs.error_data(predictions(spark, sf_dir).withColumn("part", part), "test")
    return out.withColumn("dataset_stdev", F.round("dataset_stdev", 6))


@query(f"WITH {P}, m AS (SELECT split, avg(abs(y_true - y_pred)) AS mean_absolute_error, sqrt(avg(pow(y_true - y_pred, 2))) AS root_mean_squared_error FROM p GROUP BY split) SELECT metric, (row_number() OVER (PARTITION BY metric ORDER BY split) - 1)::INT AS place, round(value, 6) AS value FROM (UNPIVOT m ON mean_absolute_error, root_mean_squared_error INTO NAME metric VALUE value)")
def split_summaries(spark, sf_dir):
    names = ["mean_absolute_error", "root_mean_squared_error"]
    flat = runs.flatten_splits(mt.evaluate(predictions(spark, sf_dir), names, ["split"]), names)
    return rounded(flat.select("metric", F.posexplode("values").alias("place", "value")))


@query(f"WITH {P} SELECT split, round(avg(pow(ln(1 + y_true) - ln(1 + abs(y_pred)), 2)), 6) AS mean_squared_log_error FROM p GROUP BY split")
def metric_log_error(spark, sf_dir):
    return rounded(mt.evaluate(predictions(spark, sf_dir).withColumn("y_pred", F.abs("y_pred")), ["mean_squared_log_error"], ["split"]))


@query()
def evaluate_with_uncertainty(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(evaluate.with_uncertainty(dataset.load(p, "p_partkey", features=["p_size"], target="p_retailprice"), bags=10).predictions, 3)


# ---------------------------------------------------------------- L: domains
@query(f"WITH {PARTS_SQL}, s AS (SELECT DISTINCT element FROM e WHERE formula IN ('Al2O3', 'Fe2O3', 'Si')), j AS (SELECT formula, min((s.element IS NOT NULL)::INT) AS lo, max((s.element IS NOT NULL)::INT) AS hi FROM e LEFT JOIN s USING (element) GROUP BY formula) SELECT formula, CASE WHEN lo = 1 THEN 1 WHEN hi = 1 THEN 0 ELSE -1 END AS domain FROM j")
def domain_elements(spark, sf_dir):
    p = parts(spark, sf_dir)
    return domain.elemental(p, p.where(F.col("formula").isin("Al2O3", "Fe2O3", "Si")), "formula")


@query("WITH s AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part WHERE p_partkey % 3 = 0 AND p_size < 40) SELECT p_partkey, ((p_size BETWEEN a AND b)::INT + (p_retailprice BETWEEN c AND d)::INT)::INT AS n_inside, concat_ws(', ', CASE WHEN p_size NOT BETWEEN a AND b THEN 'p_size' END, CASE WHEN p_retailprice NOT BETWEEN c AND d THEN 'p_retailprice' END) AS outside FROM part, s")
def domain_feature_range(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return domain.feature_range(part, part.where("p_partkey % 3 = 0 and p_size < 40"), "p_partkey", ["p_size", "p_retailprice"])


@query(f"WITH {V}, k AS (SELECT a.vec_id, avg(exp(-pow(array_distance(a.x, b.x), 2) / 2)) AS q FROM v a, v b WHERE b.vec_id % 5 <> 0 GROUP BY a.vec_id) SELECT vec_id, round(q, 9) AS density, round(1 - q / (SELECT max(q) FROM k WHERE vec_id % 5 <> 0), 9) AS dissimilarity FROM k WHERE vec_id % 5 = 0")
def domain_density(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(domain.dissimilarity(v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0"), "vec_id", ALL_64), 9)


_FAR = "q AS (SELECT *, (row_id % 97) / 97::DOUBLE AS dissimilarity, residual * (1 + (row_id % 97)) AS r2 FROM p), b AS (SELECT row_id, y_true, y_err, dissimilarity, r2 AS residual, 1 + len(list_filter(e, lambda x: x <= dissimilarity)) AS bin FROM q, (SELECT quantile_cont(dissimilarity, [0.2, 0.4, 0.6, 0.8]) AS e FROM q))"


@query(f"WITH {P}, {_FAR}, {_curve('b', 'bin')}, {_area('bin')}, a AS (SELECT bin, sum(piece) AS area FROM area GROUP BY bin), m AS (SELECT bin, count(*) AS n, min(dissimilarity) AS least, max(dissimilarity) AS most, sqrt(avg(residual * residual)) / (SELECT stddev_pop(y_true) FROM p) AS rmse FROM b GROUP BY bin) SELECT bin::INT AS bin, n, round(least, 6) AS least, round(most, 6) AS most, round(rmse, 6) AS rmse, round(area, 6) AS area, (rmse <= 1)::INT AS inside_error, (area <= 0.4)::INT AS inside_area FROM m JOIN a USING (bin)")
def domain_bins(spark, sf_dir):
    far = predictions(spark, sf_dir).select("row_id", "y_true", "y_err", ((F.col("row_id") % 97) / 97).alias("dissimilarity"), (F.col("residual") * (1 + F.col("row_id") % 97)).alias("residual"))
    return rounded(applicability.by_bins(far, 5, 1.0, 0.4))


@query()
def domain_applicability(spark, sf_dir):
    """Parts of even keys, by a model and a domain that are fitted to the others."""
    df = _sized(spark, sf_dir)
    data = dataset.load(df.where("p_partkey % 2 = 1"), "p_partkey", features=["p_size", "digit"], target="cents")
    fitted = applicability.fit(data, k=2, n_clusters=(2,), bandwidth=0.5, n_trees=4, depth=3, bins=5, most_area=0.3)
    return rounded(fitted.predict(df.where("p_partkey % 2 = 0")), 4)


# ---------------------------------------------------------------- M: learning curves
_ERR = f"abs(y - {linear_sql.predicted(XS)})"
DATA_CURVE = f"""d AS (SELECT {", ".join(XS)}, l_extendedprice AS y, {h32(LINE_KEY, "fold")} % 5 AS fold, {h32(LINE_KEY, "size")} / 4294967296.0::DOUBLE AS u FROM lineitem), g AS (SELECT size, model FROM (SELECT unnest({list(learning.SIZES)})::DOUBLE AS size), (SELECT unnest(range(0, 5)) AS model)),
t AS (SELECT size, model, d.* FROM d JOIN g ON d.fold <> model AND u < size), f AS ({linear_sql.fit("t", "size, model", XS, "y")}),
s AS (SELECT size, model, 'test' AS part, avg({_ERR}) AS s FROM d JOIN f ON d.fold = model GROUP BY ALL UNION ALL SELECT size, model, 'train', avg({_ERR}) FROM t JOIN f USING (size, model) GROUP BY ALL)"""
_SQ = lambda n: f"sqrt(avg(pow(y - {linear_sql.predicted(XS[:n])}, 2)))"
FEATURE_CURVE = f"{FOLDS}, s AS (" + " UNION ALL ".join(f"SELECT {n} AS n_features, '{part}' AS part, x.fold, {_SQ(n)} AS s FROM {rows} x JOIN ({linear_sql.fit('t', 'fold', XS[:n], 'y')}) USING (fold) GROUP BY ALL" for n in (1, 2, 3) for part, rows in (("test", "d"), ("train", "t"))) + ")"


def _data_curve(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("|", *LINE).alias("row_id"), *NUMBERS)
    return learning.data_curve(li, "row_id", XS, "l_extendedprice")


def _feature_curve(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("fold", (hash_number(*LINE) % 5).cast("int"))
    return learning.feature_curve(df, XS, "l_extendedprice", "fold")


@query(f"WITH {DATA_CURVE} SELECT size, part, round(avg(s), 3) AS mean, round(stddev_pop(s), 3) AS stdev FROM s GROUP BY ALL")
def data_learning_curve(spark, sf_dir):
    return rounded(_data_curve(spark, sf_dir), 3)


@query(f"WITH {FEATURE_CURVE} SELECT n_features, part, round(avg(s), 3) AS mean, round(stddev_pop(s), 3) AS stdev FROM s GROUP BY ALL")
def feature_learning_curve(spark, sf_dir):
    return rounded(_feature_curve(spark, sf_dir), 3)


@query(f"SELECT 'data' AS curve, * FROM (WITH {DATA_CURVE} SELECT size AS x, part, round(avg(s), 3) AS mean, round(stddev_pop(s), 3) AS stdev FROM s GROUP BY ALL) UNION ALL SELECT 'features', * FROM (WITH {FEATURE_CURVE} SELECT n_features::DOUBLE AS x, part, round(avg(s), 3) AS mean, round(stddev_pop(s), 3) AS stdev FROM s GROUP BY ALL)")
def both_learning_curves(spark, sf_dir):
    return rounded(learning.both(_data_curve(spark, sf_dir), _feature_curve(spark, sf_dir)), 3)


# ---------------------------------------------------------------- N: analysis tables
@query(f"WITH {P}, q AS (SELECT split, sqrt(avg(residual * residual)) AS v FROM p GROUP BY split) (SELECT 'best' AS which, split, round(v, 6) AS value FROM q ORDER BY v, split LIMIT 1) UNION ALL (SELECT 'worst', split, round(v, 6) FROM q ORDER BY v DESC, split LIMIT 1)")
def best_and_worst_split(spark, sf_dir):
    return rounded(analysis.best_and_worst_split(predictions(spark, sf_dir)))


MANY = "m AS (SELECT row_id % 500 AS id, split, 1.0::DOUBLE * (row_id % 500) AS y_true, (row_id % 500) + ((row_id * 7) % 23) - 11.0::DOUBLE AS y_pred FROM p)"


def _many(spark, sf_dir):
    r = F.col("row_id")
    return predictions(spark, sf_dir).select((r % 500).alias("id"), "split", (r % 500).cast("double").alias("y_true"), (r % 500 + (r * 7) % 23 - 11.0).cast("double").alias("y_pred"))


@query(f"WITH {P}, {MANY} SELECT id, y_true, round(avg(y_pred), 6) AS mean, round(stddev_samp(y_pred), 6) AS stdev, count(*) AS n FROM m GROUP BY id, y_true")
def mean_prediction(spark, sf_dir):
    return rounded(analysis.mean_prediction(_many(spark, sf_dir), "id"))


@query(f"WITH {P}, {MANY} SELECT id, y_true, min(abs(y_pred - y_true)) AS best_gap, max(abs(y_pred - y_true)) AS worst_gap FROM m GROUP BY id, y_true")
def best_and_worst_prediction(spark, sf_dir):
    out = analysis.best_and_worst_prediction(_many(spark, sf_dir), "id")
    return out.select("id", "y_true", F.abs(F.col("best") - F.col("y_true")).alias("best_gap"), F.abs(F.col("worst") - F.col("y_true")).alias("worst_gap"))


@query(f"WITH {P}, g AS (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 20 AS w FROM p) SELECT least(floor((residual - lo) / w), 19)::INT AS bin, count(*) AS n FROM p, g GROUP BY 1")
def residual_histogram(spark, sf_dir):
    return analysis.histogram(predictions(spark, sf_dir), "residual", 20).select("bin", "n")


@query("SELECT o_orderpriority AS feature, count(*) AS occurrences, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS stdev FROM orders GROUP BY 1")
def feature_occurrence(spark, sf_dir):
    return rounded(analysis.feature_occurrence(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("feature"), F.col("o_totalprice").alias("score"))), 4)


@query("SELECT p_size, round(sum(count(*)) OVER (ORDER BY p_size) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_size")
def running_share(spark, sf_dir):
    return rounded(analysis.running_share(table(spark, sf_dir, "part"), "p_size"))


@query(f"WITH {P} " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS level, round(quantile_cont(residual, {q}), 6) AS sample FROM p" for q in (0.2, 0.4, 0.6, 0.8)))
def residual_quantiles(spark, sf_dir):
    return rounded(analysis.quantile_pairs(predictions(spark, sf_dir), "residual", 4))


# ---------------------------------------------------------------- O: prediction
@query("SELECT l_orderkey, l_linenumber, round(100 + 700 * l_quantity - 50 * l_discount, 6) AS y_pred, round(1.2::DOUBLE * l_tax + 0.1::DOUBLE, 6) AS y_err, (l_quantity BETWEEN 5 AND 40)::INT AS n_inside FROM lineitem")
def predict_rows(spark, sf_dir):
    out = predict.predict(table(spark, sf_dir, "lineitem"), {"b0": 100.0, "l_quantity": 700.0, "l_discount": -50.0}, (1.2, 0.1), None, "l_tax", {"l_quantity": (5.0, 40.0)}, ["l_orderkey", "l_linenumber"])
    return rounded(out)


@query("WITH k AS (SELECT round(p_retailprice, 1) AS r, arg_min(p_size, p_partkey)::DOUBLE AS y FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, round(p_retailprice, 1) AS price, coalesce(y, -1.0) AS y_pred FROM part LEFT JOIN k ON round(p_retailprice, 1) = r")
def predict_known_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.round("p_retailprice", 1).alias("price"), F.col("p_size").cast("double").alias("p_size"))
    return predict.known_first(part.drop("p_size").withColumn("y_pred", F.lit(-1.0)), part.where("p_partkey % 2 = 0"), "p_partkey", ["price"], "p_size")


_ORDER = ("x1", "x2", "x3")
_RMSE = f"sqrt(avg(pow(y - {linear_sql.predicted(list(_ORDER))}, 2)))"


@query(f"""WITH d AS (SELECT o_orderkey AS id, (o_custkey % 7)::DOUBLE AS x1, (o_custkey % 11)::DOUBLE AS x2, month(o_orderdate)::DOUBLE AS x3, o_totalprice AS y FROM orders), o AS (SELECT unnest(range(0, 3)) AS o),
e AS (SELECT d.*, o, CASE WHEN {h32("id", "outer")} % 3 <> o THEN {h32("o, id", "inner")} % 3 END AS i FROM d, o), t AS (SELECT e.*, k.m FROM e JOIN (SELECT unnest(range(0, 3)) AS m) k ON e.i <> k.m), f AS ({linear_sql.fit("t", "o, m", list(_ORDER), "y")}),
s AS (SELECT e.o, e.i, {_RMSE} AS r FROM e JOIN f ON e.o = f.o AND e.i = f.m GROUP BY ALL), b AS (SELECT o, arg_min(i, r) AS m FROM s GROUP BY o)
SELECT e.o::INT AS "outer", 'inner' AS part, round({_RMSE}, 3) AS root_mean_squared_error FROM e JOIN f ON e.o = f.o AND e.i = f.m GROUP BY e.o UNION ALL SELECT e.o::INT, 'outer', round({_RMSE}, 3) FROM e JOIN b ON e.o = b.o AND e.i IS NULL JOIN f ON f.o = b.o AND f.m = b.m GROUP BY e.o""")
def nested_evaluation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).cast("double").alias("x1"), (F.col("o_custkey") % 11).cast("double").alias("x2"), F.month("o_orderdate").cast("double").alias("x3"), "o_totalprice")
    return rounded(evaluate.nested(dataset.load(o, "o_orderkey", features=list(_ORDER), target="o_totalprice")), 3)
