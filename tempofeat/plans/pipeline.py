"""The whole pipeline: prefilter, types, invariant and time-series features, postfilter."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempofeat.config import Settings
from tempofeat.functions.values import time_label
from tempofeat.operators import encode, hierarchy, invariant, postfilter, prefilter, temporal, value_types
from tempofeat.operators.discretize import edges_by_column
from tempofeat.operators.lookup import Lookup, look_up, lookup, with_ids
from tempofeat.operators.numbering import numbered
from tempofeat.sources.readers import with_common_ids
from tempofeat.sources.writers import write_csv, write_features
from tempofeat.storage import stored

log = logging.getLogger(__name__)


@dataclass
class Matrix:
    """Sparse features: cells (row_id, ID, [bin,] feature_id, value) and their dictionary,
    before and after the postfilter."""

    all_features: DataFrame
    all_cells: DataFrame
    profile: DataFrame
    features: DataFrame
    cells: DataFrame
    aliases: DataFrame | None
    rows: int


@dataclass
class Result:
    population: DataFrame
    prefiltered: DataFrame
    events: DataFrame
    types: DataFrame
    S: Matrix | None
    X: Matrix | None
    filled: DataFrame | None


class FeaturePipeline:
    def __init__(self, settings: Settings, lookups: dict | None = None):
        self.settings, self.lookups = settings, lookups

    def prepare(self, events: DataFrame, population: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """Typed events, types, the numbered population and its size.

        A given N truncates the population for everything."""
        _, events, types, people, n = self._prepare(events, population)
        return events, types.frame.select("var", "value_type"), people, n

    def _prepare(self, events: DataFrame, population: DataFrame) -> tuple[DataFrame, DataFrame, Lookup, DataFrame, int]:
        s = self.settings
        events, population = with_common_ids(events, population)
        people = stored(numbered(population, s.N))
        n = people.count()
        if not n:
            raise ValueError("the population is empty")
        # both are read several times from here on: each is written once
        kept = stored(prefilter.in_time(prefilter.in_population(events, people), s.until) if s.prefilter else events)
        if s.prefilter:
            kept = look_up(kept, prefilter.checked(kept, n, s), ["var"], "left_semi")
        events = hierarchy.expand(kept, s.value_types, s.hierarchical_sep, s.hierarchical_levels, self.lookups)
        types = lookup(value_types.detect(events, s.value_types))
        events = value_types.force_categorical(events, s.value_types, s.strict_compat, types)
        return kept, stored(value_types.premap_duplicates(events, types)), types, people, n

    def run(self, events: DataFrame, population: DataFrame) -> Result:
        prefiltered, events, types, people, n = self._prepare(events, population)
        still, series = value_types.split(events)
        filled = None
        S = self._invariant(still, people, n) if not still.isEmpty() else None
        X = None
        if not series.isEmpty():
            X, filled = self._series(series, types, people, n)
        return Result(people, prefiltered, events, types.frame.select("var", "value_type"), S, X, filled)

    def _invariant(self, events: DataFrame, people: DataFrame, n: int) -> Matrix:
        s = self.settings
        cells = invariant.last_values(events, people)
        features, coded, profile = encode.to_features(stored(cells), ["ID"], None, s, s.S_bins)
        coded = with_ids(coded, people, "inner").select(F.col("id_idx").alias("row_id"), "ID", "feature_id", "value")
        verdict = lambda features, cells: postfilter.near_constant(features, cells, n, s.theta_2)
        return self._matrix(features, coded, profile, verdict, people.select(F.col("id_idx").alias("row_id")), n)

    def _series(self, events: DataFrame, types: Lookup | DataFrame, people: DataFrame, n: int) -> tuple[Matrix, DataFrame | None]:
        s = self.settings
        cells, filled = temporal.series(events, types, people, n, s)
        cells = stored(cells)
        masks = cells.where(F.col("grp") == temporal.MASK)
        others = cells.where(F.col("grp") != temporal.MASK)
        features, coded, profile = encode.to_features(others, ["ID", "bin"], masks, s, s.X_bins)
        coded = with_ids(coded, people, "inner").select((F.col("id_idx") * s.L + F.col("bin")).alias("row_id"), "ID", "bin", "feature_id", "value")
        verdict = lambda features, cells: postfilter.rarely_changing(features, cells, n, s.L, s.theta_2)
        rows = people.select(F.explode(F.sequence(F.col("id_idx") * s.L, F.col("id_idx") * s.L + s.L - 1)).alias("row_id"))
        return self._matrix(features, coded, profile, verdict, rows, n * s.L), filled

    def _matrix(self, features: Lookup, cells, profile, verdict, row_ids, rows: int) -> Matrix:
        if not self.settings.postfilter:
            return Matrix(features.frame, cells, profile, features.frame, cells, None, rows)
        kept, own, aliases = postfilter.select(features, cells, verdict(features, cells), row_ids, rows)
        return Matrix(features.frame, cells, profile, kept, own, aliases, rows)

    def frozen(self, result: Result) -> FeaturePipeline:
        """The pipeline with this result's edges, for other data."""
        bins = lambda m: edges_by_column(m.profile) if m is not None else None
        return FeaturePipeline(replace(self.settings, S_bins=bins(result.S), X_bins=bins(result.X)), self.lookups)


def row_labels(people: DataFrame, settings: Settings) -> DataFrame:
    """row_id, ID, bin and t_range of the rows of the time series."""
    labels = F.lit([time_label(k, settings.dt) for k in range(settings.L)])
    rows = people.select("ID", "id_idx", F.explode(F.sequence(F.lit(0), F.lit(settings.L - 1))).alias("bin"))
    return rows.select((F.col("id_idx") * settings.L + F.col("bin")).alias("row_id"), "ID", "bin", F.element_at(labels, F.col("bin") + 1).alias("t_range"))


def dense(matrix: Matrix, rows: DataFrame, final: bool = True) -> DataFrame:
    """Rows with one column per feature, defaults filled in: for export of small results."""
    features, cells = (matrix.features, matrix.cells) if final else (matrix.all_features, matrix.all_cells)
    listed = features.orderBy("feature_id").collect()
    table = cells.groupBy("row_id").pivot("feature_id", [r.feature_id for r in listed]).agg(F.first("value"))
    table = rows.join(table, "row_id", "left")
    return table.select(*rows.columns, *(F.coalesce(F.col(f"`{r.feature_id}`"), F.lit(r.default_value)).alias(r.name) for r in listed))


def vectors(matrix: Matrix, rows: DataFrame) -> DataFrame:
    """row_id and an ml vector of all features, defaults filled in: for small dictionaries."""
    from pyspark.ml.functions import array_to_vector

    defaults = [r.default_value for r in matrix.features.orderBy("feature_id").collect()]
    stored = matrix.cells.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("m"))
    full = F.transform(F.lit(defaults), lambda d, i: F.coalesce(F.try_element_at("m", i.cast("long")), d))
    return rows.select("row_id").join(stored, "row_id", "left").select("row_id", array_to_vector(full).alias("features"))


def density(matrix: Matrix) -> float:
    """Share of cells of the matrix that are stored and not zero."""
    d = matrix.features.count()
    return matrix.cells.where("value <> 0").count() / (matrix.rows * d) if d else 0.0


def write(result: Result, settings: Settings, out: str) -> None:
    """All artifacts of a run into a folder, which is created."""
    write_csv(result.population.select("ID").orderBy("ID"), f"{out}/IDs.csv")
    result.prefiltered.drop("row_idx").write.mode("overwrite").parquet(f"{out}/pre-filtered.parquet")
    write_csv(result.types.select(F.col("var").alias("variable_name"), "value_type").orderBy("variable_name"), f"{out}/value_types.csv", quote_all=True)
    for name, m in (("S", result.S), ("X", result.X)):
        if m is None:
            continue
        write_features(f"{name}_all", m.all_features, m.all_cells, out, bins=edges_by_column(m.profile) if settings.discretize else None)
        if m.aliases is not None:
            write_features(name, m.features, m.cells, out, aliases=m.aliases)
        log.info("%s: %d rows, density %.4g", name, m.rows, density(m))
    if result.S is not None:
        write_csv(result.population.select("id_idx", "ID"), f"{out}/S.ID.csv")
    if result.X is not None:
        write_csv(row_labels(result.population, settings), f"{out}/X.ID,t_range.csv")
    if result.filled is not None:
        counts = temporal.imputation_counts(result.filled)
        write_csv(counts.select("var", "imputed"), f"{out}/freq_imputed.csv")
        write_csv(counts.select("var", "not_imputed"), f"{out}/freq_not_imputed.csv")
        # the time series before encoding, each frequent variable and bin
        result.filled.write.mode("overwrite").parquet(f"{out}/time_series.parquet")
