"""Command line: capture events, look at a ledger, ask for facts, run a registered query."""

from __future__ import annotations

import argparse
import json
import sys


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("memspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def capture(args) -> int:
    """Events from a JSON file to both projections, written to --out or counted."""
    from pyspark.sql import functions as F

    from .operators import transcript
    from .sources import files

    spark = _spark()
    def field(name: str):
        as_text = F.try_variant_get("v", f"$.{name}", "string")
        return F.coalesce(as_text, F.to_json(F.try_variant_get("v", f"$.{name}", "variant"))).alias(name)

    events = files.read_events(spark, args.events).select(
        F.coalesce(F.try_variant_get("v", "$.session_id", "string"), F.lit("")).alias("session_id"), "seq", *[field(c) for c in ("type", "text", *transcript.FIELDS)])
    projected = transcript.project(transcript.events_of(events), args.user, args.assistant)
    if args.out:
        files.write_capture(projected, args.out)
    counts = {r["projection"]: r["count"] for r in projected.groupBy("projection").count().collect()}
    print(json.dumps({n: counts.get(n, 0) for n in ("flight_recorder", "memory_grade")}))
    return 0


def status(args) -> int:
    """Queued, running and done entries of a ledger folder."""
    from .operators import ledger

    print(json.dumps(ledger.queue_status(_spark().read.parquet(args.ledger)).first().asDict()))
    return 0


def recall(args) -> int:
    """The text that a question brings up from a folder of edges."""
    from .operators import recall as ops
    from .plans import memory

    spark = _spark()
    edges = spark.read.parquet(args.edges)
    hits, answers = memory.search(spark.createDataFrame([(1, args.text)], "query_id int, text string"), edges, args.n)
    print(ops.injection(hits, answers, edges).first().message)
    return 0


def query(args) -> int:
    """A registered query over a folder of tables."""
    from .plans.catalog import QUERIES

    if args.name not in QUERIES:
        print(f"unknown query; there are: {', '.join(sorted(QUERIES))}", file=sys.stderr)
        return 2
    QUERIES[args.name](_spark(), args.folder).show(args.n, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="memspark", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(f, **kinds):
        sub = commands.add_parser(f.__name__, help=f.__doc__)
        sub.set_defaults(run=f)
        for name, options in kinds.items():
            sub.add_argument(name.replace("__", "--"), **options)

    command(capture, events={}, __out={"default": None}, __user={"default": "user"}, __assistant={"default": "assistant"})
    command(status, ledger={})
    command(recall, edges={}, text={}, __n={"type": int, "default": 5})
    command(query, name={}, folder={}, __n={"type": int, "default": 20})
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
