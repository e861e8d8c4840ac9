"""Hierarchical values: a path from the root to a leaf, of which some levels are encoded."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_of_text(value: Column, sep: str) -> Column:
    return F.split(value, re.escape(sep))


def level(path: Column, k: int) -> Column:
    """The value at level k from 0, or the deepest there is."""
    return F.try_element_at(path, F.least(F.lit(k + 1), F.size(path)))


def at_levels(events: DataFrame, path: Column, levels: tuple[int, ...]) -> DataFrame:
    """One row for each distinct value of the path at the levels; equal rows once."""
    if not levels:
        warnings.warn("no hierarchical levels are given: hierarchical variables are dropped", stacklevel=2)
        return events.limit(0).select("ID", "t", "var", "val", "row_idx")
    values = F.array_distinct(F.filter(F.array(*(level(path, k) for k in levels)), lambda v: v.isNotNull()))
    rows = events.withColumn("val", F.explode_outer(values))
    return rows.groupBy("ID", "t", "var", "val").agg(F.min("row_idx").alias("row_idx")).select("ID", "t", "var", "val", "row_idx")


def convert_codes(codes: DataFrame, code_map: DataFrame, paths9: DataFrame) -> DataFrame:
    """code and converted: by the code itself, else its parent, else its grandparent.

    code_map: code9, code10. paths9: code, path from the root to the code."""
    own = F.element_at("path", -1)
    up = codes.join(paths9, "code", "left").select("code", F.coalesce(own, "code").alias("c0"), F.try_element_at("path", F.lit(-2)).alias("c1"), F.try_element_at("path", F.lit(-3)).alias("c2"))
    for k in range(3):
        m = code_map.groupBy(F.col("code9").alias(f"c{k}")).agg(F.min("code10").alias(f"m{k}"))
        up = up.join(m, f"c{k}", "left")
    return up.select("code", F.coalesce("m0", "m1", "m2").alias("converted"))


def code_paths(codes: DataFrame, version: int, paths9: DataFrame | None = None, paths10: DataFrame | None = None, code_map: DataFrame | None = None) -> DataFrame:
    """code and path of each code, by lookup tables (code, path) of the two versions.

    Version 9 needs a path there. Version 10 takes its own, else that of the
    converted code, else the path of version 9. The path is null for codes that
    are nowhere."""
    nine = paths9.select("code", F.col("path").alias("path9")) if paths9 is not None else None
    if version == 9:
        return codes.join(nine, "code", "left").select("code", F.col("path9").alias("path"))
    if version != 10:
        raise ValueError(f"no such version of codes: {version}")
    out = codes.join(paths10.select("code", F.col("path").alias("path10")), "code", "left")
    if nine is None:
        return out.select("code", F.col("path10").alias("path"))
    out = out.join(nine, "code", "left")
    if code_map is not None:
        moved = convert_codes(codes, code_map, paths9).join(paths10.select(F.col("code").alias("converted"), F.col("path").alias("moved")), "converted", "left")
        out = out.join(moved.select("code", "moved"), "code", "left")
    else:
        out = out.withColumn("moved", F.lit(None).cast("array<string>"))
    return out.select("code", F.coalesce("path10", "moved", "path9").alias("path"))


def expand(events: DataFrame, value_types: dict[str, str], sep: str, levels: tuple[int, ...], lookups: dict | None = None) -> DataFrame:
    """Hierarchical variables at their levels; all other rows as they are.

    lookups: paths9, paths10 and code_map for coded variables."""
    kinds = {v: k.lower() for v, k in value_types.items() if "hierarchical" in k.lower()}
    if not kinds:
        return events
    if "hierarchical_icd" in kinds.values():
        raise NotImplementedError("the version of the codes must be given: hierarchical_ICD9 or hierarchical_ICD10")
    parts = [events.where(~F.col("var").isin(list(kinds)) | F.col("var").isNull())]
    for kind in sorted(set(kinds.values())):
        own = events.where(F.col("var").isin([v for v, k in kinds.items() if k == kind]))
        if kind in ("hierarchical_icd9", "hierarchical_icd10"):
            if not lookups:
                raise ValueError(f"{kind} needs lookup tables of codes")
            codes = own.select(F.col("val").alias("code")).where("code is not null").distinct()
            paths = code_paths(codes, int(kind.removeprefix("hierarchical_icd")), **lookups)
            bad = paths.where("path is null").limit(5).collect()
            if bad:
                raise ValueError(f"unknown codes for {kind}: {', '.join(r.code for r in bad)}")
            own = own.join(paths.withColumnRenamed("code", "val"), "val", "left")
            parts.append(at_levels(own, F.col("path"), levels))
        else:
            parts.append(at_levels(own, path_of_text(F.col("val"), sep), levels))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
