"""Removal of near-constant and of perfectly correlated features.

Everything is computed from sparse cells and the features' defaults. Values are
shifted by the default, so that absent cells are zeros; neither variance nor
correlation minds. Perfectly correlated features are found without comparing all
pairs: standardised columns that (nearly) equal or oppose each other have
(nearly) equal or opposite projections on any random sign vector. All SIGNS
projections together, rounded on TABLES differently shifted grids, are the
buckets of a feature; a bucket's first feature stands for it, and exact sums over
common rows decide. Only features that their bucket's first one turns out not
to match go on to its second, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.operators.lookup import Lookup, look_up, lookup, numbered_lookup

#: A correlation counts as perfect if it is this close to 1 or -1.
CLOSE = 1e-8 + 1e-5
#: A grid's cells are GRID wide: some fifty times what near-perfect columns differ by. Of those, one grid parts a tenth, all six a millionth.
SIGNS, TABLES, GRID = 8, 6, 0.2


def _as_lookup(features: Lookup | DataFrame) -> Lookup:
    return features if isinstance(features, Lookup) else lookup(features)


def _with_default(features: Lookup | DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with the default of their feature."""
    features = _as_lookup(features)
    defaults = {d for (d,) in features.frame.select("default_value").collect()} if features.small else ()
    if len(defaults) == 1:  # as of all features of intervals and texts
        default = F.lit(defaults.pop()).cast("double").alias("default_value")
        known = look_up(cells, Lookup(features.frame.select("feature_id"), True), ["feature_id"], "left_semi")
        return known.select("*", default)
    return look_up(cells, Lookup(features.frame.select("feature_id", "default_value"), features.small), ["feature_id"])


def near_constant(features: Lookup | DataFrame, cells: DataFrame, rows: int, theta_2: float) -> DataFrame:
    """feature_id, variance and kept: population variance over theta_2 * (1 - theta_2)."""
    x = F.col("value") - F.col("default_value")
    features = _as_lookup(features)
    sums = _with_default(features, cells).groupBy("feature_id").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    out = features.frame.select("feature_id").join(sums, "feature_id", "left")
    s, ss = F.coalesce("s", F.lit(0.0)) / rows, F.coalesce("ss", F.lit(0.0)) / rows
    return out.select("feature_id", (ss - s * s).alias("variance")).withColumn("kept", F.col("variance") > F.lit(theta_2 * (1 - theta_2)))


def rarely_changing(features: Lookup | DataFrame, cells: DataFrame, entities: int, bins: int, theta_2: float) -> DataFrame:
    """feature_id, ever (share of entities where it is ever not 0), ever_not_one and kept:
    both shares over theta_2."""
    per_id = cells.groupBy("feature_id", "ID").agg(F.count("*").alias("n"), F.count_if(F.col("value") == 1).alias("ones"), F.count_if(F.col("value") != 0).alias("some"))
    d = F.coalesce("default_value", F.lit(0.0))
    features = _as_lookup(features)
    per_id = _with_default(features, per_id)
    full = F.col("n") >= bins
    not_zero = (F.col("some") > 0) | (~full & (d != 0))
    not_one = (F.col("ones") < F.col("n")) | (~full & (d != 1))
    counted = per_id.groupBy("feature_id").agg(F.count("*").alias("ids"), F.count_if(not_zero).alias("nz"), F.count_if(not_one).alias("no"))
    out = features.frame.select("feature_id", "default_value").join(counted, "feature_id", "left").fillna(0, ["ids", "nz", "no"])
    rest = F.lit(entities) - F.col("ids")  # entities with no cell have the default throughout
    ever = (F.col("nz") + F.when(d != 0, rest).otherwise(0)) / entities
    ever_not_one = (F.col("no") + F.when(d != 1, rest).otherwise(0)) / entities
    return out.select("feature_id", ever.alias("ever"), ever_not_one.alias("ever_not_one")).withColumn("kept", (F.col("ever") > theta_2) & (F.col("ever_not_one") > theta_2))


def _signs(row) -> list:
    h = F.xxhash64(row)
    return [F.when(F.shiftright(h, 8 * k).bitwiseAND(1) == 1, 1.0).otherwise(-1.0) for k in range(SIGNS)]


def _shifted(features: Lookup | DataFrame, cells: DataFrame) -> DataFrame:
    """row_id, feature_id and x, the value beyond the feature's default."""
    return _with_default(features, cells).select("row_id", "feature_id", (F.col("value") - F.coalesce("default_value", F.lit(0.0))).alias("x"))


def _sums(shifted: DataFrame, rows: int, *more) -> DataFrame:
    """feature_id, s (sum of x) and dev (sum of squared deviations) of features that vary."""
    sums = shifted.groupBy("feature_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), *more)
    return sums.withColumn("dev", F.col("ss") - F.col("s") * F.col("s") / rows).where(F.col("dev") > 1e-12 * F.col("ss")).drop("ss")


def _correlation(product, rows: int):
    """r of two features, by the sum of products over common rows."""
    return (product - F.col("si") * F.col("sj") / rows) / F.sqrt(F.col("di") * F.col("dj"))


def _projected(shifted: DataFrame, row_ids: DataFrame, rows: int) -> Lookup:
    """feature_id, s, dev and u, the projections of the standardised columns."""
    sign = _signs(F.col("row_id"))
    sums = _sums(shifted, rows, *(F.sum(F.col("x") * sign[k]).alias(f"p{k}") for k in range(SIGNS)))
    totals = row_ids.agg(*(F.sum(sign[k]) for k in range(SIGNS))).head()
    u = F.array(*((F.col(f"p{k}") - F.col("s") / rows * (totals[k] or 0.0)) / F.sqrt("dev") for k in range(SIGNS)))
    return lookup(sums.select("feature_id", "s", "dev", u.alias("u")))


def _buckets(projected: DataFrame) -> DataFrame:
    """bucket, feature_id, s, dev and opposite: each feature and its opposite in one cell of each grid."""
    both = projected.withColumn("opposite", F.explode(F.lit([False, True])))
    both = both.withColumn("u", F.when(F.col("opposite"), F.transform("u", lambda x: -x)).otherwise(F.col("u")))
    cell = lambda t: F.xxhash64(F.lit(t), F.transform("u", lambda x, k: F.floor(x / GRID + (t + 0.5) / TABLES + k / 7.0)))
    return both.select("feature_id", "s", "dev", "opposite", F.explode(F.array(*(cell(t) for t in range(TABLES)))).alias("bucket"))


def _verified(pairs: DataFrame, shifted: DataFrame, rows: int) -> DataFrame:
    """i, j, r of the pairs (i, j, si, sj, di, dj)."""
    pairs = lookup(pairs)
    x = look_up(shifted.withColumnRenamed("feature_id", "i"), pairs, ["i"])
    y = shifted.select("row_id", F.col("feature_id").alias("j"), F.col("x").alias("y"))
    y = look_up(y, Lookup(pairs.frame.select("j").distinct(), pairs.small), ["j"], "left_semi")
    product = x.join(y, ["j", "row_id"], "left").groupBy("i", "j", "si", "sj", "di", "dj").agg(F.sum(F.coalesce(F.col("x") * F.col("y"), F.lit(0.0))).alias("xy"))
    return product.select("i", "j", _correlation(F.col("xy"), rows).alias("r"))


def _ends(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of the features in two frames that share a bucket, the later one as i."""
    i = a.where("not opposite").select("bucket", F.col("feature_id").alias("i"), F.col("s").alias("si"), F.col("dev").alias("di"))
    j = b.select("bucket", F.col("feature_id").alias("j"), F.col("s").alias("sj"), F.col("dev").alias("dj"))
    return i.join(j, "bucket").where("i > j").drop("bucket").distinct()


def perfect_pairs(features: Lookup | DataFrame, cells: DataFrame, row_ids: DataFrame, rows: int) -> DataFrame:
    """i, j, r for all features i > j with a correlation of about 1 or -1 over all rows.

    cells: row_id, feature_id, value; row_ids: all rows. Constant features are in
    no pair. All pairs are the result: `correlated` names a feature's first alone."""
    shifted = _shifted(features, cells)
    buckets = _buckets(_projected(shifted, row_ids, rows).frame)
    return _verified(_ends(buckets, buckets), shifted, rows).where(F.abs(F.abs(F.col("r")) - 1) <= CLOSE)


def correlations(features: Lookup | DataFrame, cells: DataFrame, rows: int) -> DataFrame:
    """i, j and r for all pairs i > j of features that vary, of whatever correlation.

    Only pairs with common rows are multiplied; the result has every pair, so
    this is for few features."""
    shifted = _shifted(features, cells)
    sums = lookup(_sums(shifted, rows))
    order = numbered_lookup(sums, [F.col("feature_id")], "at").frame
    i = order.select(F.col("feature_id").alias("i"), F.col("s").alias("si"), F.col("dev").alias("di"), F.explode(F.sequence(F.lit(0), F.col("at") - 1)).alias("at")).where("at >= 0 and i is not null")
    pairs = i.join(order.select("at", F.col("feature_id").alias("j"), F.col("s").alias("sj"), F.col("dev").alias("dj")), "at").where("i > j").drop("at")
    return _verified(pairs, shifted, rows)


def correlated(features: Lookup | DataFrame, cells: DataFrame, row_ids: DataFrame, rows: int) -> DataFrame:
    """For each feature to drop its first perfectly correlated predecessor:
    dropped_id, kept_id, kept (name) and alias (name, as ~{name} if opposite)."""
    features = _as_lookup(features)
    shifted = _shifted(features, cells)
    projected = _projected(shifted, row_ids, rows)
    buckets = _buckets(projected.frame)
    shared = buckets.groupBy("bucket").agg(F.count_distinct("feature_id").alias("n")).where("n > 1")
    buckets = lookup(buckets.join(shared.select("bucket"), "bucket")).frame
    open_, found, past = buckets, None, None
    while True:
        # each bucket's next feature, and those after it that match nothing yet
        later = buckets.join(past, "bucket").where("feature_id > past") if past is not None else buckets
        firsts = later.groupBy("bucket").agg(F.min("feature_id").alias("first"))
        least = later.join(firsts, "bucket").where("feature_id = first").drop("first")
        pairs = lookup(_ends(open_, least))
        if pairs.frame.isEmpty():
            break
        close = lookup(_verified(pairs.frame, shifted, rows).where(F.abs(F.abs(F.col("r")) - 1) <= CLOSE).groupBy("i").agg(F.min(F.struct("j", "r")).alias("f")))
        found = close.frame if found is None else found.unionByName(close.frame)
        open_ = open_.join(close.frame.select(F.col("i").alias("feature_id")), "feature_id", "left_anti")
        past = lookup(firsts.withColumnRenamed("first", "past")).frame
        open_ = lookup(open_.join(past, "bucket").where("feature_id > past").select(*buckets.columns)).frame
        if open_.isEmpty():
            break
    if found is None:
        found = features.frame.sparkSession.createDataFrame([], "i long, f struct<j: long, r: double>")
    names = Lookup(features.frame.select("feature_id", "name"), features.small)
    out = look_up(found.select(F.col("i").alias("feature_id"), F.col("f.j").alias("kept_id"), F.col("f.r").alias("r")), names, ["feature_id"])
    alias = F.when(F.col("r") < 0, F.concat(F.lit("~{"), "name", F.lit("}"))).otherwise(F.col("name"))
    out = out.select(F.col("feature_id").alias("dropped_id"), F.col("kept_id"), alias.alias("alias"))
    kept = Lookup(names.frame.select(F.col("feature_id").alias("kept_id"), F.col("name").alias("kept")), names.small)
    return look_up(out, kept, ["kept_id"]).select("dropped_id", "kept_id", "kept", "alias")


def select(features: Lookup | DataFrame, cells: DataFrame, verdict: DataFrame, row_ids: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features and cells that stay, with new ids in the old order, and the aliases."""
    features = _as_lookup(features)
    varied = lookup(features.frame.join(verdict.where("kept").select("feature_id"), "feature_id", "left_semi"))
    own = look_up(cells, Lookup(varied.frame.select("feature_id"), varied.small), ["feature_id"], "left_semi")
    aliases = lookup(correlated(varied, own, row_ids, rows))
    dropped = Lookup(aliases.frame.select(F.col("dropped_id").alias("feature_id")), aliases.small)
    kept = numbered_lookup(Lookup(look_up(varied.frame, dropped, ["feature_id"], "left_anti"), varied.small), [F.col("feature_id")], "new_id")
    out = look_up(own, Lookup(kept.frame.select("feature_id", "new_id"), kept.small), ["feature_id"]).drop("feature_id").withColumnRenamed("new_id", "feature_id")
    kept = kept.frame.drop("feature_id").withColumnRenamed("new_id", "feature_id")
    return kept.select(*features.frame.columns), out.select(*cells.columns), aliases.frame
