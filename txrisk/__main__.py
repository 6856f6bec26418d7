"""Command line: the three entry points of the original, as Spark jobs.

    python -m txrisk profile  --source data.csv
    python -m txrisk pipeline --source data.csv --out DIR [--salt S] [--fit-scope all|train]
    python -m txrisk train    --split DIR/split --out DIR [--model xgboost|random_forest]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="txrisk")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("profile")
    p.add_argument("--source", required=True)
    p = sub.add_parser("pipeline")
    p.add_argument("--source", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--salt", default="")
    p.add_argument("--fit-scope", default="all", choices=("all", "train"))
    p = sub.add_parser("train")
    p.add_argument("--split", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--model", default="xgboost")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"txrisk-{args.cmd}").getOrCreate()
    from .plans import jobs

    if args.cmd == "profile":
        res = jobs.profile(spark, args.source)
        res["rows_and_nulls"].show(truncate=False)
        res["preview"].show(truncate=False)
    elif args.cmd == "pipeline":
        res = jobs.run_data_pipeline(spark, args.source, args.out, salt=args.salt, fit_scope=args.fit_scope)
        print(json.dumps({k: v for k, v in res.items() if isinstance(v, (str, dict))}, default=str))
    else:
        rep = jobs.run_training(spark, args.split, args.out, model_type=args.model)
        print(json.dumps({"metrics": {k: v for k, v in rep["metrics"].items() if k != "classification_report"},
                          "confusion_matrix": rep["confusion_matrix"],
                          "training_time": rep["training_time"]}, default=str))


if __name__ == "__main__":
    main()
