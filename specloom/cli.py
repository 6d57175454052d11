"""specloom build LOG -o SPEC | diff OLD_LOG NEW_LOG | score CLEAN NOISY | noise LOG -o OUT | watch DIR -o SPEC"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    from .operators import noise, quality
    from .plans import render
    from .plans.build import build
    from .ship import ship
    from .sources.logs import accepted, read_har, read_logs, skip_tally

    top = argparse.ArgumentParser("specloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("build")
    one.add_argument("log")
    one.add_argument("-o", "--output", default="openapi.json")
    one.add_argument("--infer-errors", action="store_true")
    two = sub.add_parser("diff")
    two.add_argument("old")
    two.add_argument("new")
    three = sub.add_parser("score")
    three.add_argument("clean")
    three.add_argument("noisy")
    three.add_argument("--holdout", help="a log whose statuses are the truth")
    three.add_argument("--json", action="store_true", help="one JSON object instead of a table")
    three.add_argument("-v", "--verbose", action="store_true", help="also tell how many lines were skipped, and why")
    four = sub.add_parser("noise")
    four.add_argument("log")
    four.add_argument("-o", "--output", required=True)
    four.add_argument("--seed", type=int, default=0)
    four.add_argument("--rate", type=float, default=noise.RATE)
    for kind in noise.KINDS:
        four.add_argument(f"--{kind.replace('_', '-')}-rate", type=float, help=f"of {kind}; --rate if not given")
    five = sub.add_parser("watch")
    five.add_argument("folder")
    five.add_argument("-o", "--output", default="openapi.json")
    five.add_argument("--once", action="store_true")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("specloom").getOrCreate()
    ship(spark)
    read = lambda p: read_har(spark, p) if p.endswith(".har") else read_logs(spark, p)
    if args.command == "build":
        entries = read(args.log).cache()
        contract = build(accepted(entries), args.infer_errors)
        spec = contract.spec()
        render.write_spec(spec, args.output)
        report = {"summary": quality.parse_rate(entries).first().asDict(), "skipped": {r["skip_reason"]: r["count"] for r in skip_tally(entries).collect()}, "endpoints": [r.asDict() for r in contract.quality().orderBy("template", "method").collect()]}
        render.write_text(args.output.rsplit(".", 1)[0] + ".quality.json", json.dumps(report, indent=2))
        wrong = render.validate_spec(spec)
        print("\n".join(wrong) or f"{len(report['endpoints'])} endpoints", file=sys.stderr if wrong else sys.stdout)
        return int(bool(wrong))
    if args.command == "diff":
        old, new = (build(accepted(read(p))) for p in (args.old, args.new))
        from .plans.compare import diff_contracts

        for row in diff_contracts(old, new).orderBy("template", "method", "location", "kind").collect():
            print(json.dumps(row.asDict()))
        return 0
    if args.command == "score":
        from .plans import score

        logs = {name: read(path) for name, path in (("clean", args.clean), ("noisy", args.noisy), ("holdout", args.holdout)) if path}
        found = score.run(*(accepted(log) for log in logs.values()))
        if args.verbose:
            found["skipped"] = {name: {r["skip_reason"]: r["count"] for r in skip_tally(log).collect()} for name, log in logs.items()}
        if args.json:
            print(json.dumps(found))
        else:
            for name, value in found.items():
                for label, one in value.items() if isinstance(value, dict) else [("", value)]:
                    print(f"{name + (f'.{label}' if label else ''):40} {one}")
        return found["crash_count"]
    if args.command == "noise":
        from pyspark.sql import functions as F

        lines = spark.read.text(args.log).select(F.monotonically_increasing_id().alias("entry_seq"), "value")
        noise.mutate_lines(lines, args.seed, {k: args.rate if (own := getattr(args, f"{k}_rate")) is None else own for k in noise.KINDS}).orderBy("entry_seq").select("value").write.mode("overwrite").text(args.output)
        return 0
    from .streaming.watch import watch

    query = watch(spark, args.folder, args.output, once=args.once)
    query.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
