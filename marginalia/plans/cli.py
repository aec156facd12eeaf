"""python -m marginalia.plans.cli [--file F | --paste] [--agents N] [--model M] [--top-k K] [--no-cost-estimate] [--backend stub|openai]"""

from __future__ import annotations

import re
import sys
from argparse import ArgumentParser

from pyspark.errors import PythonException
from pyspark.sql import SparkSession

from marginalia.functions.tokens import CharacterCounter, TiktokenCounter
from marginalia.operators.cost import format_cost
from marginalia.plans import fixed_values as V
from marginalia.plans.review import Reviewer
from marginalia.sources.backends import OpenAIBackend, StubBackend
from marginalia.sources.papers import paper_from_text, resolve


def parser() -> ArgumentParser:
    p = ArgumentParser(description="Review a paper.")
    p.add_argument("--file", "-f", help="text file of the paper")
    p.add_argument("--paste", action="store_true", help="read the paper from the terminal")
    p.add_argument("--no-cost-estimate", action="store_true")
    p.add_argument("--agents", type=int, default=V.DEFAULT_AGENTS, help="a multiple of 8")
    p.add_argument("--model", default=V.GENERATION_MODEL, choices=list(V.PRICES))
    p.add_argument("--top-k", type=int, default=V.DEFAULT_TOP_K)
    p.add_argument("--backend", default="stub", choices=["stub", "openai"], help="openai sends the paper to a third party")
    return p


def value_fault(trace: str) -> str | None:
    """The last fault that a worker's traceback tells, if it is one of a value, as a malformed reply's is."""
    told = re.findall(r"^(?:[\w.]+\.)?(\w+(?:Error|Exception)): ?(.*)$", trace, re.MULTILINE)
    kinds = ("ValueError", "JSONDecodeError", "UnicodeDecodeError")
    return next((text for kind, text in reversed(told) if kind in kinds), None)


def main(argv: list[str] | None = None, stdin=None) -> int:
    """0: done; 1: blank paper or a fault in values; 2: wrong arguments."""
    p = parser()
    args = p.parse_args(argv)
    if args.file and args.paste:
        p.error("--paste cannot be used together with --file")
    text = resolve(args.file, stdin)
    if not text.strip():
        print(V.NO_TEXT, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("marginalia").getOrCreate()
    try:
        backend, counter = (OpenAIBackend(), TiktokenCounter()) if args.backend == "openai" else (StubBackend(), CharacterCounter())
        done = Reviewer(spark, backend, counter).review(paper_from_text(spark, text), args.agents, args.model, args.top_k)
        report = done.meta_review.first()["meta_review"]
    except ValueError as e:
        print(V.CONFIGURATION_ERROR.format(fault=e), file=sys.stderr)
        return 1
    except PythonException as e:
        if not (fault := value_fault(str(e))):
            raise
        print(V.CONFIGURATION_ERROR.format(fault=fault), file=sys.stderr)
        return 1
    print(report)
    if not args.no_cost_estimate:
        print(V.COST_HEADING)
        print(format_cost(done.stage_costs).first()["report"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
