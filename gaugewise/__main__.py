"""``python -m gaugewise run --config run.toml``: 0 if there is a station and every one completed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gaugewise.plans.runner import Settings, run


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gaugewise")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("run").add_argument("--config", required=True)
    args = parser.parse_args(argv)
    try:
        settings = Settings.load(args.config)
    except (OSError, ValueError, TypeError) as e:
        print(f"bad settings: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("gaugewise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    done = {r[0]: r[1] for r in run(spark, settings)["manifest"].groupBy("status").count().collect()}
    print(", ".join(f"{k}: {n}" for k, n in sorted(done.items())) or "no stations")
    return 0 if set(done) == {"completed"} else 1


if __name__ == "__main__":
    sys.exit(main())
