"""Queries of per-pixel algebra, predicates and masks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions import algebra as A
from skyloom.plans.catalog import load, query
from skyloom.plans.standins import OBS, PIX, R6, SER, obs, pix, r6, ser

FOUR = ["blue", "red", "nir", "swir"]
TREES = [
    {"split_feature": 0, "decision_type": "<=", "threshold": 0.4, "left_child": {"leaf_value": -0.7}, "right_child": {"split_feature": 1, "decision_type": "<=", "threshold": 0.03, "left_child": {"leaf_value": 0.2}, "right_child": {"leaf_value": 0.9}}},
    {"split_feature": 1, "decision_type": ">", "threshold": 0.05, "left_child": {"leaf_value": 0.4}, "right_child": {"leaf_value": -0.3}},
]
_TREE_SQL = "(CASE WHEN nir <= 0.4::DOUBLE THEN -0.7 ELSE CASE WHEN red <= 0.03::DOUBLE THEN 0.2 ELSE 0.9 END END::DOUBLE + CASE WHEN red > 0.05::DOUBLE THEN 0.4 ELSE -0.3 END::DOUBLE)"


def _simple(name: str, column, sql: str, out: str = "out"):
    """A query of one computed column for each observation."""

    @query(name, f"{OBS} SELECT oid, {sql} AS {out} FROM obs")
    def run(spark, sf_dir):
        return obs(spark, sf_dir).select("oid", column().alias(out))


def _div(a, b):
    return f"(({a}) / nullif(({b}), 0))"


NDVI, NDWI = _div("nir - red", "nir + red"), _div("blue - nir", "blue + nir")
_simple("p01_normalised_difference", lambda: r6(A.ndi("nir", "red")), R6(NDVI))
_simple("p02_bare_soil", lambda: r6(A.bare_soil_index(*FOUR)), R6(_div("(swir + red) - (nir + blue)", "(swir + red) + (nir + blue)")))
_simple("p02_red_edge_ratio", lambda: r6(A.red_edge_ratio("nir", "red")), R6(_div("nir", "red") + " - 1"))
_simple("p03_euclidean_norm", lambda: r6(A.euclidean_norm(["blue", "nir", "swir"])), R6("sqrt(blue * blue + nir * nir + swir * swir)"))
_simple("p04_linear", lambda: r6(A.linear("nir", 2.0, -5.0)), R6("nir * 2.0::DOUBLE - 5.0::DOUBLE"))
_simple("p04_linear_dtype", lambda: A.linear(F.col("scl"), 100, -300, "tinyint").cast("int"), "CASE WHEN scl * 100 - 300 BETWEEN -128 AND 127 THEN (scl * 100 - 300)::INT END")
_simple("p05_map_and_zip", lambda: r6(A.zip_with(lambda a, b: F.greatest(a, b) / 12 - 11, "red", "nir")), R6("greatest(red, nir) / 12 - 11"))
_simple("p09_valid_data_and_clear", lambda: A.all_masks("is_data", ~(F.col("clp") > 0.4)), "is_data AND NOT (clp > 0.4::DOUBLE)")
_simple("p10_valid_by_scene_class", lambda: F.col("scl").isin(2, 4, 5, 6, 7, 11) & F.col("is_data"), "scl IN (2, 4, 5, 6, 7, 11) AND is_data")
_simple("p11_valid_by_cloud_probability", lambda: F.col("is_data") & F.col("valid") & (F.col("clp") < 0.5), "is_data AND valid AND clp < 0.5::DOUBLE")
_simple("p12_join_masks", lambda: A.all_masks("is_data", "valid", F.col("scl") != 3), "is_data AND valid AND scl <> 3")
_simple("p13_invert_mask", lambda: A.invert(F.col("valid").cast("int")).cast("int"), "CASE WHEN valid THEN 0 ELSE 1 END::INT")
_simple("p14_mask_values", lambda: r6(A.mask_values("nir", "scl", [3, 7])), f"CASE WHEN scl NOT IN (3, 7) THEN {R6('nir')} END")
_simple("p15_map_labels", lambda: A.map_labels(F.col("scl"), {1: 10, 4: 40}).cast("int"), "(CASE scl WHEN 1 THEN 10 WHEN 4 THEN 40 ELSE scl END)::INT")
_simple("p16_override_label", lambda: A.override(F.col("scl"), F.col("valid"), True, 99).cast("int"), "(CASE WHEN valid THEN 99 ELSE scl END)::INT")
_simple("p17_without_class", lambda: A.without_class(F.col("scl"), 5).cast("int"), "(CASE WHEN scl = 5 THEN 0 ELSE 1 END)::INT")
_simple("p21_clip_and_colour", lambda: F.round(A.to_colour(A.clip(F.col("nir") - F.col("swir"), -0.5, 0.5)), 8), "round((least(greatest(nir - swir, -0.5::DOUBLE), 0.5::DOUBLE) + 1) * 127.5::DOUBLE, 8)")
_CLASSES = [(1.0, [40, 30, 20]), (2.0, [150, 30, 60]), (3.0, [120, 60, 60])]
_far = lambda c: "(abs(blue * 2000 - {}) + abs(nir * 200 - {}) + abs(swir * 200 - {})) / 3".format(*c)
_simple("p22_classes_by_colour", lambda: A.nearest_colours([F.col("blue") * 2000, F.col("nir") * 200, F.col("swir") * 200], _CLASSES, 40.0, 0.0), f"CASE WHEN {_far(_CLASSES[2][1])} < 40 THEN 3.0 WHEN {_far(_CLASSES[1][1])} < 40 THEN 2.0 WHEN {_far(_CLASSES[0][1])} < 40 THEN 1.0 ELSE 0.0 END::DOUBLE")
_simple("p23_class_by_alpha", lambda: A.opaque(F.col("red"), 7).cast("int"), "(CASE WHEN red > 0 THEN 7 ELSE 0 END)::INT")
_simple("p25_surface_temperature", lambda: r6((A.brightness_temperature(F.col("nir") * 10000, 3.342e-4, 0.1, 774.89, 1321.08) + A.brightness_temperature(F.col("swir") * 10000, 3.342e-4, 0.1, 480.89, 1201.14)) / 2), R6("(1321.08::DOUBLE / ln(774.89::DOUBLE / (0.0003342::DOUBLE * (nir * 10000) + 0.1::DOUBLE) + 1) + 1201.14::DOUBLE / ln(480.89::DOUBLE / (0.0003342::DOUBLE * (swir * 10000) + 0.1::DOUBLE) + 1)) / 2"))
_TEN = ["blue", "blue", "red", "red", "nir", "nir", "nir", "nir", "swir", "swir"]
_cap = lambda n: R6(" + ".join(f"{b} * {w!r}::DOUBLE" for b, w in zip(_TEN, A.TASSELLED_CAP[n])))


@query("p27_tasselled_cap", f"{OBS} SELECT oid, {_cap('brightness')} AS brightness, {_cap('greenness')} AS greenness, {_cap('wetness')} AS wetness FROM obs")
def _(spark, sf_dir):
    return obs(spark, sf_dir).select("oid", *[r6(c).alias(n) for n, c in A.tasselled_cap(_TEN).items()])


_simple("p30_tree_ensemble", lambda: r6(A.tree_ensemble(TREES, ["nir", "red"])), R6(f"1 / (1 + exp(-{_TREE_SQL}))"))
_simple("p31_tree_with_guard", lambda: F.when(A.ndi("nir", "red") <= 0.2, False).otherwise(A.tree(TREES[0], ["nir", "red"]) > 0.5), f"CASE WHEN {NDVI} <= 0.2::DOUBLE THEN false ELSE CASE WHEN nir <= 0.4::DOUBLE THEN -0.7 ELSE CASE WHEN red <= 0.03::DOUBLE THEN 0.2 ELSE 0.9 END END > 0.5 END")
#: Vegetation, water, moisture and burn indices of the four bands.
_INDICES = [("nir", "red"), ("blue", "nir"), ("nir", "swir"), ("swir", "red")]
_leaf = lambda v: {"leaf_value": v}
_split = lambda i, at, left, right: {"split_feature": i, "decision_type": "<=", "threshold": at, "left_child": left, "right_child": right}
_ON_INDICES = _split(0, 0.75, _split(2, 0.1, _leaf(0.9), _split(3, 0.6, _leaf(0.2), _leaf(0.7))), _split(1, -0.9, _split(2, -0.05, _leaf(0.8), _leaf(0.1)), _leaf(0.6)))
_I = [f"(({a} - {b}) / nullif({a} + {b}, 0))" for a, b in _INDICES]
_simple(
    "p31_tree_on_four_indices",
    lambda: F.when(A.ndi("nir", "red") <= 0.2, False).otherwise(A.tree(_ON_INDICES, [A.ndi(a, b) for a, b in _INDICES]) > 0.5),
    f"CASE WHEN {_I[0]} <= 0.2::DOUBLE THEN false ELSE CASE WHEN {_I[0]} <= 0.75::DOUBLE THEN CASE WHEN {_I[2]} <= 0.1::DOUBLE THEN 0.9 ELSE CASE WHEN {_I[3]} <= 0.6::DOUBLE THEN 0.2 ELSE 0.7 END END ELSE CASE WHEN {_I[1]} <= -0.9::DOUBLE THEN CASE WHEN {_I[2]} <= -0.05::DOUBLE THEN 0.8 ELSE 0.1 END ELSE 0.6 END END > 0.5 END",
)
_simple("p32_packed_index", lambda: A.packed_index(F.round(A.ndi("nir", "red"), 3)), f"trunc(round({NDVI}, 3) * 10000 + 10000)::INT")
_simple("p33_rms_luminance", lambda: r6(A.rms(FOUR)), R6("sqrt((blue * blue + red * red + nir * nir + swir * swir) / 4)"))
_simple("p34_water_reference", lambda: A.water("blue", "nir").cast("int"), f"(CASE WHEN {NDWI} > 0.1::DOUBLE THEN 1 ELSE 0 END)::INT")
_simple("p38_anomaly_score", lambda: r6(A.anomaly_score(F.when(F.col("valid"), F.col("nir") * 6 - 3))), f"CASE WHEN NOT valid THEN -9.0 WHEN abs(nir * 6 - 3) <= 1 THEN 0.0 ELSE {R6('nir * 6 - 3')} END::DOUBLE")
_simple("p39_value_for_missing", lambda: r6(A.value_for_missing(F.when(F.col("valid"), F.col("nir")).otherwise(F.lit(float("nan"))), 0)), f"CASE WHEN valid THEN {R6('nir')} ELSE 0.0 END::DOUBLE")
_simple("p41_wealth_bins", lambda: A.label_bins("nir", [0.2, 0.4, 0.6, 0.8]).cast("int"), "((nir > 0.2::DOUBLE)::INT + (nir > 0.4::DOUBLE)::INT + (nir > 0.6::DOUBLE)::INT + (nir > 0.8::DOUBLE)::INT)::INT")


@query("p06_one_column_per_band", f"SELECT vec_id, {R6('embedding[1]')} AS b01, {R6('embedding[5]')} AS b05, {R6('embedding[64]')} AS b64 FROM embeddings")
def _(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", *[r6(F.element_at("embedding", i).cast("double")).alias(f"b{i:02}") for i in (1, 5, 64)])


@query("p07_concatenate_features", "SELECT vec_id, len(embedding) + 2 AS n, round(list_sum(embedding::DOUBLE[]) + label + 1.0::DOUBLE, 4) + 0.0::DOUBLE AS total FROM embeddings")
def _(spark, sf_dir):
    both = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.col("label").cast("double"), F.lit(1.0)))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", both.alias("b"))
    return rows.select("vec_id", F.size("b").cast("long").alias("n"), (F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)).alias("total"))


@query("p08_drop_and_rename", "SELECT o_orderkey AS parcel_id, o_orderstatus AS status FROM orders")
def _(spark, sf_dir):
    return load(spark, sf_dir, "orders").drop("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority").withColumnRenamed("o_orderkey", "parcel_id").withColumnRenamed("o_orderstatus", "status")


@query("p18_quality_filter", f"{OBS} SELECT oid, {R6('nir')} AS nir FROM obs WHERE valid AND clp < 0.3::DOUBLE AND {NDVI} > 0.5::DOUBLE")
def _(spark, sf_dir):
    return obs(spark, sf_dir).withColumn("ndvi", A.ndi("nir", "red")).where("valid AND clp < 0.3D AND ndvi > 0.5D").select("oid", r6("nir").alias("nir"))


@query("p19_relabel_before_frame", f"{OBS} SELECT oid, CASE WHEN valid AND ts = min(ts) OVER (PARTITION BY tile_id) THEN 0 ELSE valid::INT END::INT AS burn FROM obs")
def _(spark, sf_dir):
    first = F.min("ts").over(Window.partitionBy("tile_id"))
    return obs(spark, sf_dir).select("oid", F.when(F.col("valid") & (F.col("ts") == first), 0).otherwise(F.col("valid").cast("int")).alias("burn"))


@query("p20_change_map", f"{OBS}, c AS (SELECT tile_id, y, x, year(ts) AS yr, max(scl) AS cls FROM obs GROUP BY ALL) SELECT a.tile_id, a.y, a.x, (CASE WHEN a.cls <> b.cls THEN b.cls ELSE 0 END)::INT AS change FROM c a JOIN c b USING (tile_id, y, x) WHERE a.yr = 1996 AND b.yr = 1997")
def _(spark, sf_dir):
    by_year = obs(spark, sf_dir).where(F.year("ts").isin(1996, 1997)).groupBy("tile_id", "y", "x").agg(*[F.max(F.when(F.year("ts") == yr, F.col("scl"))).alias(f"c{yr}") for yr in (1996, 1997)])
    return by_year.where("c1996 IS NOT NULL AND c1997 IS NOT NULL").select("tile_id", "y", "x", A.change("c1996", "c1997").cast("int").alias("change"))


@query("p24_code_to_label", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Other' END AS label, CASE o_orderstatus WHEN 'F' THEN '#00ff00' WHEN 'O' THEN '#0000ff' ELSE '#ffffff' END AS colour FROM orders")
def _(spark, sf_dir):
    codes = spark.createDataFrame([("F", "Finished", "#00ff00"), ("O", "Open", "#0000ff")], "code string, label string, colour string")
    joined = load(spark, sf_dir, "orders").join(F.broadcast(codes), F.col("o_orderstatus") == F.col("code"), "left")
    return joined.select("o_orderkey", F.coalesce("label", F.lit("Other")).alias("label"), F.coalesce("colour", F.lit("#ffffff")).alias("colour"))


_n = lambda b: f"(({b} - min({b}) OVER ()) / (max({b}) OVER () - min({b}) OVER ()))"


@query("p26_albedo", f"{OBS} SELECT oid, {R6(' + '.join(f'{w}::DOUBLE * {_n(b)}' for b, w in zip(['blue', 'red', 'nir', 'swir', 'swir'], A.ALBEDO)) + ' - 0.0018::DOUBLE')} AS albedo FROM obs")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    limits = rows.agg(*[f(b).alias(f"{n}_{b}") for b in FOUR for n, f in (("lo", F.min), ("hi", F.max))])
    joined = rows.join(F.broadcast(limits), F.lit(True))  # one row of limits
    scaled = [A.scale_to(F.col(b), F.col(f"lo_{b}"), F.col(f"hi_{b}")) for b in ("blue", "red", "nir", "swir", "swir")]
    return joined.select("oid", r6(A.weighted(scaled, A.ALBEDO) + A.ALBEDO_OFFSET).alias("albedo"))


@query("p28_quantile_scaling", f"{OBS}, q AS (SELECT quantile_cont(nir, 0.05) AS lo, quantile_cont(nir, 0.95) AS hi FROM obs) SELECT oid, coalesce({R6('(nir - lo) / nullif(hi - lo, 0)')}, 0.0::DOUBLE) AS scaled FROM obs, q")
def _(spark, sf_dir):
    from skyloom.operators.sampling import exact_quantiles

    rows = obs(spark, sf_dir)
    limits = exact_quantiles(rows, "nir", [0.05, 0.95]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return rows.join(F.broadcast(limits), F.lit(True)).select("oid", r6(A.scale_to("nir", "lo", "hi", missing=0)).alias("scaled"))


@query("p29_standardise", f"{PIX}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM pix) SELECT tile_id, y, x, round((v - m) / sd, 4) + 0.0::DOUBLE AS z FROM pix, s")
def _(spark, sf_dir):
    rows = pix(spark, sf_dir)
    stats = rows.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return rows.join(F.broadcast(stats), F.lit(True)).select("tile_id", "y", "x", (F.round(F.try_divide(F.col("v") - F.col("m"), F.col("sd")), 4) + F.lit(0.0)).alias("z"))


@query("p35_most_recent_frame", f"{OBS} SELECT tile_id, y, x, oid, {R6('nir')} AS nir FROM obs QUALIFY row_number() OVER (PARTITION BY tile_id, y, x ORDER BY ts DESC, oid DESC) = 1")
def _(spark, sf_dir):
    last = obs(spark, sf_dir).groupBy("tile_id", "y", "x").agg(F.max(F.struct("ts", "oid", "nir")).alias("s"))
    return last.select("tile_id", "y", "x", "s.oid", r6(F.col("s.nir")).alias("nir"))


@query("p36_split_reference", f"{OBS} SELECT oid, CASE WHEN dense_rank() OVER (PARTITION BY tile_id ORDER BY ts DESC) <= 3 THEN 'reference' ELSE 'input' END AS part FROM obs")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    frames = rows.select("tile_id", "ts").distinct().withColumn("back", F.row_number().over(Window.partitionBy("tile_id").orderBy(F.desc("ts")))).where("back <= 3").select("tile_id", "ts", F.lit("reference").alias("part"))
    return rows.join(frames, ["tile_id", "ts"], "left").select("oid", F.coalesce("part", F.lit("input")).alias("part"))


@query("p37_conditional_step", f"{OBS}, t AS (SELECT tile_id, avg(nir) AS m FROM obs GROUP BY tile_id) SELECT oid, CASE WHEN m > 0.51::DOUBLE THEN {R6('nir * 2')} ELSE {R6('nir')} END AS nir, CASE WHEN m > 0.51::DOUBLE THEN {R6('nir - red')} END AS extra FROM obs JOIN t USING (tile_id)")
def _(spark, sf_dir):
    from skyloom.operators.flow import conditionally

    rows = obs(spark, sf_dir).select("oid", "tile_id", "nir", "red")
    out = conditionally(rows, "tile_id", F.avg("nir") > 0.51, lambda d: d.withColumn("extra", r6(F.col("nir") - F.col("red"))).withColumn("nir", F.col("nir") * 2))
    return out.select("oid", r6("nir").alias("nir"), "extra")


@query("p37_conditional_chain", f"{OBS}, t AS (SELECT tile_id, avg(nir) AS m FROM obs GROUP BY tile_id) SELECT oid, CASE WHEN m > 0.51::DOUBLE THEN {R6('nir / 4 - red')} ELSE {R6('nir')} END AS nir, CASE WHEN m > 0.51::DOUBLE THEN {R6('nir / 4')} END AS before FROM obs JOIN t USING (tile_id)")
def _(spark, sf_dir):
    """The first step takes its tiles below the limit, but the first verdict holds for the whole chain."""
    from skyloom.operators.flow import conditional_chain

    rows = obs(spark, sf_dir).select("oid", "tile_id", "nir", "red")
    steps = [lambda d: d.withColumn("nir", F.col("nir") / 4), lambda d: d.withColumn("before", F.col("nir")), lambda d: d.withColumn("nir", F.col("nir") - F.col("red"))]
    return conditional_chain(rows, "tile_id", F.avg("nir") > 0.51, *steps).select("oid", r6("nir").alias("nir"), r6("before").alias("before"))


@query("m06_argmax_class", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS cls FROM embeddings")
def _(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", A.argmax_class("embedding").alias("cls"))


@query("u02_map_each_feature", f"{SER} SELECT oid, {R6('v * 0.5::DOUBLE')} AS half, {R6('ln(v + 1)')} AS log1 FROM ser")
def _(spark, sf_dir):
    methods = {"half": lambda c: c * 0.5, "log1": lambda c: F.ln(c + 1)}
    return ser(spark, sf_dir).select("oid", *[r6(f(F.col("v"))).alias(n) for n, f in methods.items()])
