"""Command line: ``python -m ledgerlens train|predict|augment-cities|compose|summarise ...``."""

from __future__ import annotations

import argparse
import datetime as dt


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="ledgerlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train", help="fit both heads on labelled ledger CSVs")
    t.add_argument("--model-dir", required=True)
    t.add_argument("--augment", action="store_true", help="add word-shuffled training rows")
    t.add_argument("ledgers", nargs="+")
    ac = sub.add_parser("augment-cities", help="merchants x cities to a ledger CSV")
    ac.add_argument("--cities", required=True)
    ac.add_argument("--out", required=True)
    ac.add_argument("--cap", type=int, default=None)
    ac.add_argument("ledger")
    co = sub.add_parser("compose", help="restaurant CSV to a ledger CSV")
    co.add_argument("--out", required=True)
    co.add_argument("ledger")
    pr = sub.add_parser("predict", help="label a ledger with saved models")
    pr.add_argument("--model-dir", required=True)
    pr.add_argument("--out", required=True)
    pr.add_argument("ledgers", nargs="+")
    s = sub.add_parser("summarise", help="MTD/YTD totals and trees of a dated ledger")
    s.add_argument("--as-of", default=dt.date.today().isoformat())
    s.add_argument("ledger")
    p.add_argument("--master", default=None)
    args = p.parse_args(argv)

    from .plans import jobs
    from .session import get_spark
    spark = get_spark(args.master)
    if args.cmd == "train":
        src = args.ledgers[0] if len(args.ledgers) == 1 else args.ledgers
        out = jobs.train_models(spark, src, args.model_dir, augment=args.augment)
        out["metrics"].show(truncate=False)
        print(f"rejected rows (labels outside the taxonomy): {out['rejects'].count()}")
    elif args.cmd == "predict":
        src = args.ledgers[0] if len(args.ledgers) == 1 else args.ledgers
        res = jobs.predict_ledger(spark, src, args.model_dir, args.out)
        print(f"wrote {res.count()} rows to {args.out}")
    elif args.cmd == "augment-cities":
        res = jobs.augment_cities(spark, args.ledger, args.cities, args.out, cap=args.cap)
        print(f"wrote {res.count()} rows to {args.out}")
    elif args.cmd == "compose":
        res = jobs.compose_restaurants(spark, args.ledger, args.out)
        print(f"wrote {res.count()} rows to {args.out}")
    else:
        for name, df in jobs.summarise(spark, args.ledger, dt.date.fromisoformat(args.as_of)).items():
            print(name)
            df.show(100, truncate=False)


if __name__ == "__main__":
    main()
