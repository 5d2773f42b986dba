"""Command line: ``python -m pyrocline.cli -f detections.csv -o folder``."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pyrocline.config import Settings
from pyrocline.operators import scoring
from pyrocline.plans.engine import Run
from pyrocline.sources import detections
from pyrocline.sources.outline import read_outline


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    """Parsed arguments; output is verbose unless ``-v`` is given."""
    parser = argparse.ArgumentParser(description="Cluster and classify thermal detections.")
    parser.add_argument("-f", "--file", required=True, help="CSV of detections")
    parser.add_argument("-b", "--bounds", help="GeoJSON outline")
    parser.add_argument("-o", "--output", required=True, help="folder of the results")
    parser.add_argument("-m", "--model", help="JSON with the classifier's weights and intercept")
    parser.add_argument("-p", "--perc-valid", type=float, default=0.0025, help="share of collects for the validity threshold")
    parser.add_argument("-v", "--verbose", action="store_false", help="say less")
    parser.add_argument("-l", "--log", action="store_true", help="log to debug.log in the folder, too")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> dict[str, str]:
    """Run the density engine on a CSV; returns the paths written."""
    given, began = arguments(args), time.time()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if given.log:
        handlers.append(logging.FileHandler(f"{given.output.rstrip('/')}/debug.log"))
    logging.basicConfig(level=logging.INFO if given.verbose else logging.WARNING, handlers=handlers, format="%(message)s")
    spark = SparkSession.builder.appName("pyrocline").getOrCreate()
    rows = detections.detections(given.file, spark).withColumn("fid", F.col("FID"))
    model = scoring.load(spark, given.model) if given.model else None
    run = Run(rows, read_outline(spark, given.bounds), Settings(valid_share=given.perc_valid))
    paths = run.write(given.output, given.file, model)
    logging.getLogger("pyrocline").info("total seconds: %.1f", time.time() - began)
    return paths


if __name__ == "__main__":
    main()
