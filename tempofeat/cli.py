"""python -m tempofeat.cli: events and a population in, sparse features out."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from tempofeat.config import Settings, load_settings
from tempofeat.plans.pipeline import FeaturePipeline, write
from tempofeat.sources.readers import read_events, read_lookups, read_population
from tempofeat.storage import read_text


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data_fname", required=True)
    p.add_argument("--population_fname", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--config_fname")
    p.add_argument("--T", type=float, required=True)
    p.add_argument("--dt", type=float, required=True)
    p.add_argument("--theta_1", type=float, default=0.001)
    p.add_argument("--theta_2", type=float, default=0.001)
    p.add_argument("--theta_freq", type=float, default=1.0)
    p.add_argument("--stats_functions", nargs="+", default=["min", "max", "mean"])
    p.add_argument("--N", type=int)
    p.add_argument("--no_prefilter", action="store_true")
    p.add_argument("--no_postfilter", action="store_true")
    p.add_argument("--lookups", nargs="+", default=[], metavar="NAME=FILE", help="tables of coded hierarchies: paths9, paths10, code_map")
    return p.parse_args(argv)


def settings_of(a: argparse.Namespace, spark: SparkSession) -> Settings:
    return load_settings(
        a.config_fname,
        read_file=lambda path: read_text(spark, path),
        T=a.T,
        dt=a.dt,
        theta_1=a.theta_1,
        theta_2=a.theta_2,
        theta_freq=a.theta_freq,
        stats=tuple(a.stats_functions),
        N=a.N,
        prefilter=not a.no_prefilter,
        postfilter=not a.no_postfilter,
        lookups=dict(x.split("=", 1) for x in a.lookups) or None,
    )


def main(argv: list[str] | None = None) -> None:
    a = parse(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("tempofeat").getOrCreate()
    settings = settings_of(a, spark)
    events = read_events(spark, a.data_fname, settings.column_names)
    population = read_population(spark, a.population_fname, settings.column_names)
    write(FeaturePipeline(settings, read_lookups(spark, settings.lookups)).run(events, population), settings, a.output_dir)


if __name__ == "__main__":
    main()
