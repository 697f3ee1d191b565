"""python -m factgrid.plans.cli --code FILE... : facts, a response, verdicts, metrics and a report of each program."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from factgrid.plans.analysis import analyse
from factgrid.sinks import report
from factgrid.sources import providers
from factgrid.sources.files import read_sources
from factgrid.storage import cut

DEMO = '''
LIMIT = 3


def load(path):
    rows = read(path)
    return clean(rows)


def read(path):
    return [path] * LIMIT


def clean(rows):
    return [r.strip() for r in rows]


def main():
    print(load("data"))


main()
'''


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--demo", action="store_true", help="a small program of its own, with the mock provider")
    p.add_argument("--code", "-c", nargs="*", default=[], help="paths or patterns of programs")
    p.add_argument("--output", "-o", default="report.html")
    p.add_argument("--no-llm", action="store_true", help="the mock provider")
    p.add_argument("--api-key")
    p.add_argument("--provider", default="auto", choices=["groq", "gemini", "openai", "mock", "auto"])
    p.add_argument("--quiet", "-q", action="store_true")
    a = p.parse_args(argv)
    if not a.demo and not a.code:
        p.error("--code or --demo")
    spark = SparkSession.builder.getOrCreate()
    sources = spark.createDataFrame([("demo.py", DEMO)], "file_id string, code string") if a.demo else read_sources(spark, *a.code)
    chosen = "mock" if a.demo or a.no_llm else providers.choose(a.provider, a.api_key)
    make = (lambda name, key=a.api_key: providers.Live(name, key)) if chosen != "mock" else None
    responses = cut(providers.generate(sources, chosen, make=make), "responses")
    done = analyse(sources, responses)
    for k, row in enumerate(responses.select("file_id", "run_id").orderBy("file_id").toLocalIterator()):
        page = report.generate(done.verdicts, done.summary, done.metrics, done.recommendations, row["file_id"], row["run_id"])
        path = report.save(page, a.output if not k else a.output.replace(".html", f"-{k}.html"))
        if not a.quiet:
            print(path)
    if not a.quiet:
        print(report.console(done.verdicts))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
