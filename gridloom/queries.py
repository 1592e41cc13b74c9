"""Registered queries: every operator on the test tables, and its SQL counterpart.

Vectors of ``embeddings`` serve twice: as they are (representations, split by ``vec_id % 5``) and
laid out as 16 x 16 patches on a whole-number lattice (see ``sources.patches``). Results are keyed
rows rounded to six places, so that both engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles as O
from .functions import draws as R
from .operators import alignment as A
from .operators import decoding as L
from .operators import families as M
from .operators import gram as G
from .operators import heads as H
from .operators import pixels as P
from .operators import probes as Q
from .operators import reports as V
from .operators.extract import extract, feature_schema
from .plans.features import FeaturePlan
from .plans.presets import RGB_BANDS, preset
from .plans.study import expected_jobs
from .sources import patches as S
from .sources import splits as T
from .sources.tables import table, union_rows

BANDS_6 = ("B02", "B03", "B04", "B08", "B11", "B12")
SIDE = S.SIDE
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (and no negative zero); keys stay."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def patches(spark: SparkSession, sf_dir: str, n_bands: int) -> DataFrame:
    return S.lattice_patches(table(spark, sf_dir, "embeddings"), n_bands)


PLAN_6 = FeaturePlan(BANDS_6)
PLAN_RGB = FeaturePlan(RGB_BANDS)

# --- channels -----------------------------------------------------------------------------------


def _map(name: str, plan: FeaturePlan, channels: list[str], scale: int = 0, zero: tuple[str, ...] = ()) -> None:
    @query(name, O.map_query(plan, channels, scale, zero))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = P.pixels(patches(spark, sf_dir, len(plan.bands)), plan.bands)
        px = P.pooled(P.zero_bands(px, zero), plan.bands, SIDE, SIDE, scale)
        return rounded(px.select("patch_id", F.col("pos").cast("int").alias("pos"), *[P.channel(plan, c).alias(c) for c in channels]))


for _name, _channels in {
    "pan_map": ["pan"], "ndvi_map": ["ndvi"], "ndwi_map": ["ndwi"], "ndbi_map": ["ndbi"], "ndmi_map": ["ndmi"], "nbr_map": ["nbr"], "bsi_map": ["bsi"], "exg_map": ["exg"],
}.items():
    _map(_name, PLAN_6, _channels)
_map("rgb_normdiff_map", PLAN_RGB, ["ngrdi", "ngbdi", "nrbdi"])
_map("saturation_map", PLAN_RGB, ["saturation"])
_map("lightness_map", PLAN_RGB, ["lightness"])
_map("pool_s1", PLAN_6, [*BANDS_6, "ndvi"], 1)
_map("pool_s2", PLAN_6, [*BANDS_6, "ndvi"], 2)
_map("band_zeroed_pan", PLAN_6, ["pan"], zero=("B12",))


@query("pan_total", O.statement(O.pixels(BANDS_6), f"SELECT CAST(patch_id AS BIGINT) AS patch_id, {O.rounded({'pan_total': f'sum({O.channel(PLAN_6, "pan")})'})} FROM p0 GROUP BY patch_id"))
def pan_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.pixels(patches(spark, sf_dir, 6), BANDS_6)
    return rounded(px.groupBy("patch_id").agg(F.sum(P.channel(PLAN_6, "pan")).alias("pan_total")))


# --- families -----------------------------------------------------------------------------------


def _family(name: str, family: str, channels: list[str], scale: int = 0) -> None:
    @query(name, O.family_query(PLAN_6, family, channels, scale))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(M.family(patches(spark, sf_dir, 6), PLAN_6, family, channels, SIDE, SIDE, scale))


_ALL_6 = [*BANDS_6, "pan", "ndvi"]
# means of pan are multiples of 1/1536, whose sixth place can be a tie, so pan_total stands for them
_family("f_moments", "moments", [*BANDS_6, "ndvi"])
_family("f_percentiles", "percentiles", _ALL_6)
_family("f_gradient", "gradient", _ALL_6)
_family("f_gradient_s1", "gradient", _ALL_6, 1)
_family("f_gradient_s2", "gradient", _ALL_6, 2)
_family("f_coherence", "coherence", _ALL_6)
_family("f_orient_entropy", "entropy", list(BANDS_6))
_family("f_orient_hist", "histogram", list(BANDS_6))
_family("f_hough", "hough", ["B02", "B04", "B08", "pan"])
_family("f_harris", "harris", ["B02", "B04", "pan", "ndvi"])
_family("f_lbp", "lbp", ["B02", "B04", "pan", "ndvi"])
_family("f_blobs", "blobs", ["B02", "pan"])
_family("f_fft_peak", "fft_peak", ["B02", "B04", "pan"])
_family("f_fft_slope", "fft_slope", ["B02", "B04", "pan"])
_family("f_tail", "tail", ["B02", "B04", "pan", "ndvi"])

_PAIRS_6 = [("B04", "B08"), ("B03", "B08"), ("B12", "B08"), ("B03", "B04")]


@query(
    "f_correlation",
    O.statement(O.pixels(BANDS_6), f"SELECT CAST(patch_id AS BIGINT) AS patch_id, {O.rounded({f'corr_{a}_{b}': O.correlation_expr(a, b) for a, b in _PAIRS_6})} FROM p0 GROUP BY patch_id"),
)
def f_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.correlations(P.pixels(patches(spark, sf_dir, 6), BANDS_6), PLAN_6, _PAIRS_6))


# --- assembly -----------------------------------------------------------------------------------


def _vector(name: str, plan: FeaturePlan, engine: str = "arrow", sql: bool = True) -> None:
    @query(name, O.vector_query(plan) if sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = patches(spark, sf_dir, len(plan.bands))
        if engine == "relational":
            return rounded(M.features_long(rows, plan, SIDE, SIDE))
        return rounded(extract(rows, plan).select("patch_id", F.posexplode("features").alias("pos", "value")))


PLAN_RGB_SMALL = FeaturePlan(RGB_BANDS, [n for n in PLAN_RGB.names if n.startswith(("mean", "std", "p50", "spread", "coherence", "corr", "grad_mean_s1", "tail", "lbp"))])
_vector("feature_vector_33_long", preset("33"))
_vector("feature_vector_33_relational", preset("33"), "relational")
_vector("feature_vector_52_long", preset("52"))
_vector("feature_vector_rgb_long", PLAN_RGB_SMALL)
_vector("feature_vector_377_long", preset("377"))


@query("feature_vector_389_zeroed_long", O.vector_query(preset("389"), zero=("B10",)))
def zeroed_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(patches(spark, sf_dir, 13), preset("389"), zero_bands=("B10",))
    return rounded(rows.select("patch_id", F.posexplode("features").alias("pos", "value")))


@query("feature_vector_377")
def feature_vector_377(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(patches(spark, sf_dir, 13), preset("377"))


@query("feature_vector_389_two_variants")
def two_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plans = patches(spark, sf_dir, 13), {"frontier33": preset("33"), "pool389": preset("389")}
    original = extract(rows, plans).withColumn("variant", F.lit("original"))
    return union_rows([original, extract(rows, plans, zero_bands=("B10",)).withColumn("variant", F.lit("b10_zeroed"))])


@query("feature_schema_33", "SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS INT), '{n}', '{f}')" for k, n, f in preset("33").schema_rows()) + ") t(pos, name, family)")
def schema_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_schema(spark, preset("33"))


# --- splits and alignment -------------------------------------------------------------------------

Z = "z AS (SELECT vec_id, embedding, label, CASE vec_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM embeddings)"
ZE = f"{Z}, ze AS (SELECT vec_id, label, split, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(64)) AS INT) AS pos FROM z)"


def z_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return T.split_by_number(rows, "vec_id")


def part(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


@query("split_assign", f"WITH {Z} SELECT vec_id, label, split FROM z")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return z_split(spark, sf_dir).select("vec_id", "label", "split")


def _two_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings, and the labels of documents as vectors: two tables whose keys overlap in part."""
    left = z_split(spark, sf_dir).select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("features"))
    marks = F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    return left, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"), marks.alias("features"))


@query("align_inner", "SELECT e.vec_id AS key, e.label, l.quality, l.toxic FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id")
def align_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two_tables(spark, sf_dir)
    right = right.select("key", F.col("features")[0].cast("int").alias("quality"), F.col("features")[1].cast("int").alias("toxic"))
    return A.inner(left.select("key", "label"), right, "key")


@query("align_anti", "SELECT vec_id AS key, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def align_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two_tables(spark, sf_dir)
    return A.missing(left.select("key", "label"), right, "key")


@query(
    "align_report",
    "SELECT CAST(0 AS BIGINT) AS duplicate_left, CAST(0 AS BIGINT) AS duplicate_right, count(*) FILTER (WHERE l.doc_id IS NULL) AS only_left, "
    "count(*) FILTER (WHERE e.vec_id IS NULL) AS only_right, count(*) FILTER (WHERE e.label <> l.quality) AS label_mismatch, CAST(0 AS BIGINT) AS not_finite "
    "FROM embeddings e FULL JOIN labels l ON e.vec_id = l.doc_id",
)
def align_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alignment_report(*_two_tables(spark, sf_dir))


@query("align_checked", "SELECT vec_id AS key, label, CAST(64 AS INT) AS nx, CAST(64 AS INT) AS ny FROM embeddings")
def align_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = z_split(spark, sf_dir).select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("features"))
    return A.align(z, z).select("key", "label", F.size("x").alias("nx"), F.size("y").alias("ny"))


def _md5(*parts: str) -> str:
    text = " || '-' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


@query("nested_fraction", f"SELECT vec_id, label FROM (SELECT *, row_number() OVER (ORDER BY {_md5('7', 'vec_id')}, vec_id) AS r, count(*) OVER () AS n FROM embeddings) WHERE r <= floor(n * CAST(0.2 AS DOUBLE) + 0.5)")
def nested_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nested_subset(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 0.2, 7)


@query(
    "stratified_quota",
    f"SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_md5('3', 'vec_id')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) "
    "WHERE r <= greatest(1, floor(n * CAST(0.1 AS DOUBLE) + CAST(0.5 AS DOUBLE)))",
)
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stratified_subset(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.1, 3)


def _shuffle_sql(within: str) -> str:
    over = f"PARTITION BY {within} " if within else ""
    match = "a.r = b.r" + (f" AND a.{within} = b.{within}" if within else "")
    return (
        f"WITH a AS (SELECT vec_id, label, row_number() OVER ({over}ORDER BY vec_id) AS r FROM embeddings), b AS (SELECT vec_id, label, row_number() OVER ({over}ORDER BY {_md5('1', 'vec_id')}, vec_id) AS r FROM embeddings) "
        f"SELECT a.vec_id, b.vec_id AS partner FROM a JOIN b ON {match}"
    )


@query("row_shuffle", _shuffle_sql(""))
def row_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shuffled_partner(table(spark, sf_dir, "embeddings"), "vec_id", 1)


@query("row_shuffle_within_label", _shuffle_sql("label"))
def row_shuffle_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shuffled_partner(table(spark, sf_dir, "embeddings"), "vec_id", 1, ["label"])


@query(
    "class_center",
    f"WITH {ZE}, c AS (SELECT label, pos, avg(v) AS m FROM ze WHERE split = 'train' GROUP BY label, pos) SELECT vec_id, pos, {O.rounded({'value': 'v - m'})} FROM ze JOIN c USING (label, pos) WHERE split = 'test'",
)
def class_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = z_split(spark, sf_dir)
    out = A.class_centered(part(z, "test"), A.class_means(part(z, "train"), "embedding"), "embedding")
    return rounded(out.select("vec_id", F.posexplode("embedding").alias("pos", "value")))


@query("concat_scaled", f"WITH {ZE} SELECT vec_id, CAST(pos AS INT) AS pos, {O.rounded({'value': 'CASE WHEN pos < 32 THEN v ELSE CAST(0.25 AS DOUBLE) * v END'})} FROM ze")
def concat_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return rounded(z_split(spark, sf_dir).select("vec_id", F.posexplode(A.concat_scaled(F.slice(v, 1, 32), F.slice(v, 33, 32), 0.25)).alias("pos", "value")))


# --- scoring ------------------------------------------------------------------------------------


def literal_head() -> H.Head:
    """A fixed head of ten classes, the same in both engines."""
    return H.Head(np.sin(np.arange(10)[:, None] * 64 + np.arange(64)[None, :]), np.zeros(10))


LOGITS = f"{ZE}, lg AS (SELECT vec_id, label, split, k.k AS class, sum(v * sin(k.k * 64 + pos)) AS logit FROM ze, (SELECT CAST(unnest(range(10)) AS INT) AS k) k GROUP BY vec_id, label, split, k.k)"
PROBS = f"{LOGITS}, pr AS (SELECT vec_id, label, split, class, exp(logit - max(logit) OVER w) / sum(exp(logit - m)) OVER w AS p, logit FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS m FROM lg) WINDOW w AS (PARTITION BY vec_id))"
BEST = f"{LOGITS}, bp AS (SELECT vec_id, label, split, class AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class) AS r FROM lg) WHERE r = 1)"


@query(
    "standardize",
    f"WITH {ZE}, s AS (SELECT pos, avg(v) AS m, CASE WHEN min(v) = max(v) THEN 1 ELSE stddev_pop(v) END AS d FROM ze WHERE split = 'train' GROUP BY pos) SELECT vec_id, pos, {O.rounded({'value': '(v - m) / d'})} FROM ze JOIN s USING (pos) WHERE split = 'val'",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = z_split(spark, sf_dir)
    out = H.standardized(part(z, "val"), *H.scaler(part(z, "train"), "embedding"), "embedding")
    return rounded(out.select("vec_id", F.posexplode("embedding").alias("pos", "value")))


@query("predict_argmax", f"WITH {BEST} SELECT vec_id, label, prediction FROM bp")
def predict_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.predict(z_split(spark, sf_dir).select("vec_id", "label", "embedding"), literal_head(), "embedding").drop("embedding")


@query("predict_argmax_columns", f"WITH {BEST} SELECT vec_id, label, prediction FROM bp")
def predict_argmax_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = z_split(spark, sf_dir).withColumn("z", H.scores(F.col("embedding"), literal_head()))
    return z.select("vec_id", "label", H.argmax(F.col("z")).alias("prediction"))


@query("softmax", f"WITH {PROBS} SELECT vec_id, CAST(class AS INT) AS class, {O.rounded({'p': 'p'})} FROM pr WHERE split = 'val'")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = part(z_split(spark, sf_dir), "val").withColumn("z", H.scores(F.col("embedding"), literal_head()))
    return rounded(z.select("vec_id", F.posexplode(H.softmax_column(F.col("z"))).alias("class", "p")))


@query("accuracy", f"WITH {BEST} SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS correct, {O.rounded({'accuracy': 'avg(CAST(CAST(label = prediction AS INT) AS DOUBLE))'})} FROM bp WHERE split = 'test'")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.accuracy(H.predict(part(z_split(spark, sf_dir), "test"), literal_head(), "embedding")))


@query(
    "accuracy_by_class",
    f"WITH {BEST} SELECT label, count(*) AS n, count(*) FILTER (WHERE label = prediction) AS correct, {O.rounded({'accuracy': 'avg(CAST(CAST(label = prediction AS INT) AS DOUBLE))'})} FROM bp GROUP BY label",
)
def accuracy_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.accuracy_by_class(H.predict(z_split(spark, sf_dir), literal_head(), "embedding")))


@query(
    "logloss",
    f"WITH {PROBS}, rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS r FROM pr WHERE split = 'test') SELECT {O.rounded({'accuracy': 'avg(CAST(CAST(class = label AS INT) AS DOUBLE)) FILTER (WHERE r = 1)'})}, "
    f"count(*) FILTER (WHERE r = 1 AND class = label) AS correct, count(*) FILTER (WHERE r = 1 AND class <> label) AS errors, {O.rounded({'log_loss': 'avg(-ln(greatest(p, 2.220446049250313e-16))) FILTER (WHERE class = label)'})} FROM rk",
)
def logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = H.predict(part(z_split(spark, sf_dir), "test"), literal_head(), "embedding", probabilities="probabilities")
    return rounded(H.classification_metrics(z))


def _head_table(spark: SparkSession) -> DataFrame:
    return spark.range(640).select(F.floor(F.col("id") / 64).cast("int").alias("class"), (F.col("id") % 64).cast("int").alias("pos"), F.sin(F.col("id").cast("double")).alias("w"))


HEAD_SQL = "h AS (SELECT CAST(i // 64 AS INT) AS class, CAST(i % 64 AS INT) AS pos, sin(CAST(i AS DOUBLE)) AS w FROM range(640) t(i))"


@query(
    "importance_rank",
    f"WITH {HEAD_SQL}, g AS (SELECT pos, sqrt(sum(w * w)) AS l2, avg(abs(w)) AS mean_abs, max(abs(w)) AS max_abs FROM h GROUP BY pos) SELECT pos, {O.rounded({c: c for c in ('l2', 'mean_abs', 'max_abs')})}, CAST(row_number() OVER (ORDER BY l2 DESC, pos) AS INT) AS rank FROM g",
)
def importance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.importance_rank(_head_table(spark)))


@query("stored_parameters", f"WITH {HEAD_SQL} SELECT CAST(65 * count(DISTINCT class) AS BIGINT) AS parameters FROM h WHERE w <> 0 AND class <> 2")
def stored_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = literal_head()
    head.weights[2] = 0
    return spark.createDataFrame([(head.stored_parameters(),)], "parameters long")


@query("c_pick", "SELECT CAST(c AS DOUBLE) AS c, CAST(accuracy AS DOUBLE) AS accuracy, row_number() OVER (ORDER BY accuracy DESC, c) = 1 AS selected FROM (VALUES (0.1, 0.5), (1.0, 0.75), (10.0, 0.75), (100.0, 0.25)) t(c, accuracy)")
def c_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pick_c(spark.createDataFrame([(0.1, 0.5), (1.0, 0.75), (10.0, 0.75), (100.0, 0.25)], "c double, accuracy double"))


@query("top_importances", f"WITH {HEAD_SQL}, g AS (SELECT pos, sqrt(sum(w * w)) AS l2 FROM h GROUP BY pos), s AS ({ORACLE_SQL['feature_schema_33']}), r AS (SELECT *, CAST(row_number() OVER (ORDER BY l2 DESC, pos) AS INT) AS rank FROM g) SELECT rank, pos, name, family, {O.rounded({'l2': 'l2'})} FROM (SELECT * FROM r WHERE rank <= 30) JOIN s USING (pos)")
def top_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.top_importances(H.importance_rank(_head_table(spark)), feature_schema(spark, preset("33")), 30))


# --- statistics ---------------------------------------------------------------------------------
# The target is the second half of a vector, its "prediction" the first half, the baseline half of that.

XY = f"{ZE}, xy AS (SELECT a.vec_id, a.label, a.split, CAST(a.pos AS INT) AS pos, a.v AS p, b.v AS y FROM ze a JOIN ze b ON a.vec_id = b.vec_id AND b.pos = a.pos + 32 WHERE a.pos < 32)"
BY_POS = "bp AS (SELECT pos, sum((y - p) * (y - p)) AS sse, CASE WHEN min(y) = max(y) THEN 0 ELSE var_pop(y) * count(*) END AS sst FROM xy WHERE split = 'test' GROUP BY pos), r2 AS (SELECT *, CASE WHEN sst > 0 THEN 1 - sse / sst END AS r2 FROM bp)"


def xy(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    z = z_split(spark, sf_dir)
    z = part(z, split) if split else z
    return z.select("vec_id", "label", "split", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"), F.slice("embedding", 1, 32).alias("predicted"), F.transform(F.slice("embedding", 1, 32), lambda v: v / 2).alias("baseline"))


@query("r2_by_position", f"WITH {XY}, {BY_POS} SELECT pos, {O.rounded({c: c for c in ('sse', 'sst', 'r2')})} FROM r2")
def r2_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.r2_by_position(xy(spark, sf_dir, "test")))


@query(
    "r2_summary",
    f"WITH {XY}, {BY_POS} SELECT {O.rounded({'native_r2': '1 - sum(sse) / sum(sst)', 'macro_r2': 'avg(r2)', 'median_r2': 'quantile_cont(r2, 0.5)', 'q25_r2': 'quantile_cont(r2, 0.25)', 'q75_r2': 'quantile_cont(r2, 0.75)'})}, count(r2) AS defined_features, "
    f"count(*) - count(r2) AS undefined_features, {O.rounded({f'fraction_r2_gt_0{k}': f'avg(CAST(CAST(r2 > {k / 10} AS INT) AS DOUBLE))' for k in (5, 8, 9)})} FROM r2",
)
def r2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.r2_summary(L.r2_by_position(xy(spark, sf_dir, "test"))))


@query(
    "train_mean_baseline",
    f"WITH {XY}, t AS (SELECT pos, avg(y) AS p FROM xy WHERE split = 'train' GROUP BY pos), bp AS (SELECT xy.pos, sum((y - t.p) * (y - t.p)) AS sse, var_pop(y) * count(*) AS sst FROM xy JOIN t ON xy.pos = t.pos WHERE split = 'test' GROUP BY xy.pos) SELECT {O.rounded({'native_r2': '1 - sum(sse) / sum(sst)'})} FROM bp",
)
def train_mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = xy(spark, sf_dir)
    return rounded(L.r2_summary(L.r2_by_position(L.mean_baseline(part(z, "test"), part(z, "train")))).select("native_r2"))


N_DRAWS = 200


def _draws_sql(n: str) -> str:
    return f"mult AS (SELECT d AS draw, {_md5('d', 's')} % n.n AS row, count(*) AS k FROM (SELECT unnest(range({N_DRAWS})) AS d) d, {n} n, LATERAL (SELECT unnest(range(n.n)) AS s) s GROUP BY 1, 2)"


@query(
    "bootstrap_multiplicity",
    f"WITH n AS (SELECT count(*) AS n FROM embeddings), {_draws_sql('n')} SELECT CAST(draw AS BIGINT) AS draw, CAST(row AS BIGINT) AS row, k AS n FROM mult",
)
def bootstrap_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return R.multiplicities(rows, "row", rows.count(), N_DRAWS)


def _boot_sql(value: str, score: str, name: str, extra: str = "") -> str:
    return (
        f"WITH {XY}, tx AS (SELECT * FROM xy WHERE split = 'test'), n AS (SELECT count(DISTINCT vec_id) AS n FROM tx), {_draws_sql('n')}, "
        f"rk AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM (SELECT DISTINCT vec_id FROM tx)), "
        f"lo AS (SELECT vec_id, sum({value}) AS value FROM tx GROUP BY vec_id), "
        "s AS (SELECT draw, pos, sum(k * y) AS s, sum(k * y * y) AS q FROM mult JOIN rk USING (row) JOIN tx USING (vec_id) GROUP BY draw, pos), "
        "den AS (SELECT draw, sum(q) - sum(s * s) / max(n.n) AS den FROM s, n GROUP BY draw), "
        "num AS (SELECT draw, sum(k * value) AS num FROM mult JOIN rk USING (row) JOIN lo USING (vec_id) GROUP BY draw), "
        f"b AS (SELECT {score} AS b FROM num JOIN den USING (draw)) "
        f"SELECT {extra}{O.rounded({f'{name}_ci_low': 'quantile_cont(b, 0.025)', f'{name}_ci_high': 'quantile_cont(b, 0.975)'})}, count(b) AS bootstrap_defined, count(*) - count(b) AS bootstrap_undefined FROM b"
    )


@query("bootstrap_r2", _boot_sql("(y - p) * (y - p)", "1 - num / den", "native"))
def bootstrap_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.bootstrap_r2(xy(spark, sf_dir, "test"), "vec_id", draws=N_DRAWS))


_GAIN = "(y - p / 2) * (y - p / 2) - (y - p) * (y - p)"
_DELTA = f"round((SELECT sum({_GAIN}) FROM tx) / (SELECT sum(t) FROM (SELECT var_pop(y) * count(*) AS t FROM tx GROUP BY pos)), 6) + 0.0 AS delta_r2, "


@query("paired_r2", _boot_sql(_GAIN, "num / den", "delta", _DELTA))
def paired_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.paired_r2(xy(spark, sf_dir, "test"), "vec_id", "y", "baseline", "predicted", N_DRAWS))


# two heads on the same rows: the literal head, and the same with its classes turned by one
PAIRED = (
    f"{PROBS}, two AS (SELECT a.vec_id, a.label, a.p AS pb, b.p AS pc, a.ra = 1 AS rb, b.rc = 1 AS rc FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS ra FROM pr) a "
    "JOIN (SELECT *, (class + 1) % 10 AS turned, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, (class + 1) % 10) AS rc FROM pr) b ON a.vec_id = b.vec_id AND a.class = a.label AND b.turned = a.label WHERE a.split = 'test')"
)


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = literal_head()
    turned = H.Head(np.roll(head.weights, 1, axis=0), np.roll(head.bias, 1))
    rows = part(z_split(spark, sf_dir), "test").select("vec_id", "label", "embedding")
    rows = H.predict(H.predict(rows, head, "embedding", "b", "pb").drop("b"), turned, "embedding", "c", "pc").drop("c", "embedding")
    return Q.outcomes(Q.outcomes(rows, "label", "pb", "b"), "label", "pc", "c")


_COUNTS = "count(*) AS n, count(*) FILTER (WHERE NOT rb AND rc) AS gained_correct, count(*) FILTER (WHERE rb AND NOT rc) AS lost_correct, count(*) FILTER (WHERE rb AND rc) AS both_correct, count(*) FILTER (WHERE NOT rb AND NOT rc) AS both_wrong"


@query(
    "mcnemar",
    f"WITH {PAIRED}, c AS (SELECT {_COUNTS} FROM two), lf AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS f UNION ALL SELECT i, sum(ln(i)) OVER (ORDER BY i) AS f FROM (SELECT unnest(range(1, 5000)) AS i)), "
    "t AS (SELECT least(1, 2 * sum(exp(a.f - b.f - d.f - (gained_correct + lost_correct) * ln(2)))) AS p FROM c JOIN lf a ON a.i = gained_correct + lost_correct JOIN lf b ON b.i <= least(gained_correct, lost_correct) JOIN lf d ON d.i = gained_correct + lost_correct - b.i) "
    f"SELECT c.*, {O.rounded({'accuracy_delta': 'CAST(gained_correct - lost_correct AS DOUBLE) / n', 'relative_error_reduction': 'CAST(gained_correct - lost_correct AS DOUBLE) / (gained_correct + both_wrong)', 'mcnemar_pvalue': 'CASE WHEN gained_correct + lost_correct = 0 THEN 1 ELSE p END'})} FROM c, t",
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.paired_tests(Q.paired_counts(paired(spark, sf_dir), F.col("b_right"), F.col("c_right"))))


@query("paired_by_class", f"WITH {PAIRED} SELECT label, {_COUNTS} FROM two GROUP BY label")
def paired_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.paired_counts(paired(spark, sf_dir), F.col("b_right"), F.col("c_right"), ["label"])


@query(
    "paired_bootstrap",
    f"WITH {PAIRED}, n AS (SELECT count(*) AS n FROM two), {_draws_sql('n')}, rk AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS row, CAST(CAST(rc AS INT) - CAST(rb AS INT) AS DOUBLE) AS a, "
    "-ln(greatest(pb, 2.220446049250313e-16)) + ln(greatest(pc, 2.220446049250313e-16)) AS l FROM two), m AS (SELECT draw, sum(k * a) / max(n.n) AS a, sum(k * l) / max(n.n) AS l FROM mult JOIN rk USING (row), n GROUP BY draw) "
    f"SELECT {O.rounded({'accuracy_ci_low': 'quantile_cont(a, 0.025)', 'accuracy_ci_high': 'quantile_cont(a, 0.975)', 'log_loss_ci_low': 'quantile_cont(l, 0.025)', 'log_loss_ci_high': 'quantile_cont(l, 0.975)'})} FROM m",
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paired(spark, sf_dir).select("vec_id", (F.col("c_right").cast("double") - F.col("b_right").cast("double")).alias("accuracy"), (F.col("b_loss") - F.col("c_loss")).alias("log_loss"))
    return rounded(Q.paired_bootstrap(rows, "vec_id", ["accuracy", "log_loss"], N_DRAWS))


@query(
    "accuracy_interval",
    f"WITH {BEST}, tx AS (SELECT vec_id, CAST(CAST(label = prediction AS INT) AS DOUBLE) AS a FROM bp WHERE split = 'test'), n AS (SELECT count(*) AS n FROM tx), {_draws_sql('n')}, rk AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM tx), "
    f"m AS (SELECT draw, sum(k * a) / max(n.n) AS a FROM mult JOIN rk USING (row), n GROUP BY draw) SELECT round((SELECT avg(a) FROM tx), 6) + 0.0 AS accuracy, {O.rounded({'accuracy_ci_low': 'quantile_cont(a, 0.025)', 'accuracy_ci_high': 'quantile_cont(a, 0.975)'})} FROM m",
)
def accuracy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.predict(part(z_split(spark, sf_dir), "test"), literal_head(), "embedding")
    return rounded(Q.accuracy_interval(rows, "vec_id", draws=N_DRAWS))


P_VALUES = [0.01, 0.04, 0.03, 0.005, 0.2, 0.04]


@query(
    "holm",
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({p} AS DOUBLE))" for k, p in enumerate(P_VALUES)) + ") t(id, p)), s AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) AS s FROM p) "
    f"SELECT CAST(id AS INT) AS id, {O.rounded({'p': 'p', 'p_holm': 'least(1, max(s) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING))'})} FROM s",
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.holm(spark.createDataFrame(list(enumerate(P_VALUES)), "id int, p double")))


@query(
    "family_summary",
    f"WITH {XY}, {BY_POS}, f AS (SELECT 'test' AS model, CASE WHEN pos < 16 THEN 'low' ELSE 'high' END AS family, r2 FROM r2) SELECT model, family, count(*) AS features, count(r2) AS defined, {O.rounded({'mean': 'avg(r2)', 'median': 'quantile_cont(r2, 0.5)', 'q25': 'quantile_cont(r2, 0.25)', 'q75': 'quantile_cont(r2, 0.75)'})} FROM f GROUP BY model, family",
)
def family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r2 = L.r2_by_position(xy(spark, sf_dir, "test")).select(F.lit("test").alias("model"), F.when(F.col("pos") < 16, "low").otherwise("high").alias("family"), "r2")
    return rounded(Q.family_summary(r2, ["model", "family"]))


GRAM_SQL = f"WITH {XY} SELECT CAST(a.pos AS INT) AS i, CAST(b.pos AS INT) AS j, {O.rounded({'v': 'sum(a.p * b.y)'})} FROM xy a JOIN xy b ON a.vec_id = b.vec_id WHERE a.split = 'train' GROUP BY a.pos, b.pos"


@query("gram_matrix", GRAM_SQL)
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.gram_rows(xy(spark, sf_dir, "train"), "x", "y").select("i", F.posexplode("v").alias("j", "v")))


@query("gram_matrix_relational", GRAM_SQL)
def gram_matrix_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.gram_sql(xy(spark, sf_dir, "train"), "vec_id", "x", "y"))


@query(
    "linear_cka",
    f"WITH {XY}, c AS (SELECT vec_id, pos, p - avg(p) OVER (PARTITION BY pos) AS p, y - avg(y) OVER (PARTITION BY pos) AS y FROM xy WHERE split = 'test'), "
    "g AS (SELECT sum(a.p * b.p) AS xx, sum(a.p * b.y) AS xy, sum(a.y * b.y) AS yy FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos) "
    f"SELECT {O.rounded({'cka': 'sum(xy * xy) / (sqrt(sum(xx * xx)) * sqrt(sum(yy * yy)))'})} FROM g",
)
def linear_cka(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.createDataFrame([(L.linear_cka(xy(spark, sf_dir, "test")),)], "cka double"))


@query(
    "pca_energy_cumsum",
    f"WITH {XY}, e AS (SELECT pos, sum(y * y) AS e FROM xy WHERE split = 'test' GROUP BY pos) SELECT CAST(pos + 1 AS INT) AS rank, {O.rounded({'energy': 'sum(e) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)'})} FROM e",
)
def pca_energy_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies along the coordinate axes, summed in order (the components of an identity basis)."""
    e = xy(spark, sf_dir, "test").select(F.posexplode("y").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    return rounded(e.select((F.col("pos") + 1).alias("rank"), F.sum("e").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("energy")))


@query(
    "expected_jobs",
    "WITH m(model) AS (VALUES ('resnet50'), ('convnext_tiny'), ('dofa_large'), ('olmoearth_nano'), ('olmoearth_base')), v(variant, representation) AS (VALUES ('original', 'frontier33'), ('original', 'pool377'), ('original', 'imagestats52'), "
    "('b10_zeroed', 'frontier33'), ('b10_zeroed', 'pool377')), p AS (SELECT * FROM m, v WHERE variant = 'original' OR starts_with(model, 'olmoearth')), "
    "j AS (SELECT 'ridge' AS kind, model, variant, representation, c.c AS context, d.d AS direction FROM p, (VALUES ('ordinary'), ('within_class'), ('shuffle0'), ('shuffle1'), ('shuffle2')) c(c), (VALUES ('h_to_z'), ('z_to_h')) d(d) "
    "UNION ALL SELECT 'probe', model, variant, representation, c.c, '' FROM p, (VALUES ('combined'), ('shuffled'), ('projection')) c(c) WHERE variant = 'original' OR c.c = 'combined' "
    "UNION ALL SELECT 'probe', model, '', '', 'standalone', '' FROM m UNION ALL SELECT 'probe', 'handcrafted', variant, representation, '', '' FROM v) "
    "SELECT array_to_string(list_filter([kind, model, variant, representation, context, direction], lambda x: x <> ''), '-') AS id, * FROM j",
)
def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expected_jobs(spark)


_NAMES_389 = ", ".join(f"('{n}')" for n in preset("389").names)
_INDEX_SQL = " ".join(f"WHEN contains(name, '{index}') THEN '{text}'" for index, text in V.INDEX_TEXT.items())


@query(
    "definition_text",
    f"SELECT name, CASE {_INDEX_SQL} WHEN name LIKE 'corr\\_%' ESCAPE '\\' THEN replace(name[6:], '_', ';') WHEN contains(name, 'pan') "
    f"THEN '{V.PAN_TEXT}' ELSE string_split(name, '_')[-1] END AS definition FROM (VALUES {_NAMES_389}) t(name)",
)
def definition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in preset("389").names], "name string")
    return names.select("name", V.physical_definition(F.col("name")).alias("definition"))


# --- learned: no SQL, held by tests ---------------------------------------------------------------


def _records(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def _vectors(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    z = z_split(spark, sf_dir).select("vec_id", "label", "split", F.col("embedding").alias("features"))
    return {s: part(z, s) for s in ("train", "val", "test")}


@query("logreg_fit")
def logreg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _vectors(spark, sf_dir)
    return H.accuracy(H.predict(z["test"], H.fit(z["train"], H.HEAD_C).shifted(0)))


@query("c_sweep")
def c_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _vectors(spark, sf_dir)
    return _records(spark, H.sweep(z["train"], z["val"], (0.1, 1.0, 10.0))[1], "c double, accuracy double, correct long, n long, iterations int, selected boolean")


@query("rfe_trace")
def rfe_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _vectors(spark, sf_dir)
    rounds, _ = H.eliminate(z["train"], z["val"], z["test"], step=20, minimum=4, grid=(1.0, 10.0))
    return _records(spark, rounds, "features int, parameters int, c double, val_accuracy double, train_accuracy double, test_accuracy double, positions array<int>")


@query("learning_curve")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _vectors(spark, sf_dir)
    return _records(spark, H.learning_curve(z["train"], z["test"], H.HEAD_C, "vec_id", (20, 100), (0, 1)), "percent int, runs int, mean double, std double")


@query("probe_select")
def probe_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = xy(spark, sf_dir)
    _, rows = Q.select_probe(part(z, "train"), part(z, "val"), "x", "y", cs=(1.0, 100.0), betas=(0.0, 1.0))
    return _records(spark, rows, "c double, beta double, val_accuracy double, val_log_loss double, iterations int, baseline boolean, selected boolean")


@query("ridge_select")
def ridge_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = xy(spark, sf_dir)
    _, rows = L.select_ridge(part(z, "train"), part(z, "val"))
    return _records(spark, rows, "alpha double, validation_score double, scoring string, boundary string, selected boolean, selected_on_boundary boolean")


@query("ridge_decode")
def ridge_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = xy(spark, sf_dir).drop("predicted")
    ridge, _ = L.select_ridge(part(z, "train"), part(z, "val"), scoring="macro")
    return L.r2_summary(L.r2_by_position(L.apply_map(part(z, "test"), ridge)))


@query("pca_fit")
def pca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = xy(spark, sf_dir)
    return L.pca_diagnostics(L.fit_pca(part(z, "train")), part(z, "test"), ranks=[r for r in L.RANKS if r <= 32])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 33-feature vectors of 13-band patches, with their names."""
    rows = extract(patches(spark, sf_dir, 13), preset("33")).select("patch_id", F.posexplode("features").alias("pos", "value"))
    return rows.join(F.broadcast(feature_schema(spark, preset("33"))), "pos").select("patch_id", "pos", "name", "family", "value")
