"""python -m peltrane --experiment DIR: selects features and builds the dataset, as the environment says."""

import argparse

from pyspark.sql import SparkSession

from .plans.config import Config
from .plans.pipeline import Pipeline


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--experiment", required=True)
    known, _ = parser.parse_known_args(args)
    spark = SparkSession.builder.appName("peltrane").getOrCreate()
    Pipeline(spark, Config.from_env(), known.experiment).run()


if __name__ == "__main__":
    main()
