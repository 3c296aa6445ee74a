"""Command line: build vocabularies and graphs, ask questions.  ``python -m skillweave.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from skillweave.operators import evaluation, queries
from skillweave.plans import pipelines
from skillweave.sources import readers, sinks


def _graph(spark: SparkSession, args) -> tuple[DataFrame, DataFrame]:
    return readers.read_nodes(spark, args.nodes), readers.read_edges(spark, args.edges)


def _show(df: DataFrame, output: str | None) -> None:
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    text = json.dumps(rows, ensure_ascii=False, indent=2, default=str)
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skillweave")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, graph: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for o in (("nodes", "edges") if graph else ()) + options:
            p.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"))
        p.add_argument("--output")
        return p

    add("build-gazetteer", "esco?", "onet?")
    add("weak-label", "postings", "gazetteer")
    add("sample-gold", "examples", "size?")
    add("build-full-input", "postings", "gazetteer", "max-sentences?")
    add("build-graph", "examples", "gazetteer", "min-score?")
    add("prepare-re-dataset", "examples")
    add("postings-to-answers", "postings", "gazetteer", "skills", "top-k?", "max-sentences?", "min-score?")
    for name, options in (
        ("summary", ()), ("subgraph", ("limit?",)), ("profile", ("occupation",)), ("recommend", ("skills", "top-k?")), ("recommend-ranked", ("skills", "top-k?")),
        ("skill-gap", ("occupation", "skills")), ("growth-path", ("source", "target")), ("evaluate-graph", ()), ("evaluate-recommendations", ("k?", "holdout?")),
    ):
        add(name, *options, graph=True)
    return top


def run(spark: SparkSession, args) -> None:
    c = args.command
    if c == "build-gazetteer":
        sinks.write_jsonl(pipelines.build_gazetteer(spark, args.esco, args.onet), args.output)
    elif c == "weak-label":
        labelled = pipelines.weak_label(readers.read_postings(spark, args.postings), readers.read_gazetteer(spark, args.gazetteer))
        sinks.write_jsonl(labelled.select("id", "lang", "text", "tokens", "labels"), args.output)
    elif c == "sample-gold":
        sinks.write_jsonl(pipelines.sample_gold(readers.read_examples(spark, args.examples), int(args.size or 200)), args.output)
    elif c == "build-full-input":
        examples, _ = pipelines.full_input(readers.read_postings(spark, args.postings), readers.read_gazetteer(spark, args.gazetteer), int(args.max_sentences or 6))
        sinks.write_jsonl(examples, args.output)
    elif c == "build-graph":
        built = pipelines.build_graph(readers.read_examples(spark, args.examples), readers.read_gazetteer(spark, args.gazetteer), float(args.min_score or 85))
        pipelines.write_graph_outputs(built, args.output)
        sinks.write_report(built["report"], f"{args.output}/report.json")
    elif c == "postings-to-answers":
        base = readers.read_gazetteer(spark, args.gazetteer)
        built = pipelines.postings_to_graph(spark, readers.read_postings(spark, args.postings), base, args.output, int(args.max_sentences or 6), float(args.min_score or 85))
        sinks.write_report(built["report"], f"{args.output}/report.json")
        nodes, edges = readers.read_nodes(spark, f"{args.output}/nodes"), readers.read_edges(spark, f"{args.output}/edges")
        _show(queries.recommend_ranked(nodes, edges, [s.strip() for s in args.skills.split(",") if s.strip()], int(args.top_k or 5)), None)
    elif c == "prepare-re-dataset":
        sinks.write_jsonl(pipelines.relation_dataset(readers.read_examples(spark, args.examples)), args.output)
    else:
        nodes, edges = _graph(spark, args)
        skills = [s.strip() for s in (getattr(args, "skills", None) or "").split(",") if s.strip()]
        answers = {
            "summary": lambda: queries.summary(nodes, edges),
            "subgraph": lambda: queries.subgraph(nodes, edges, int(args.limit or 1200))[1],
            "profile": lambda: queries.occupation_profile(nodes, edges, args.occupation),
            "recommend": lambda: queries.recommend(nodes, edges, skills, int(args.top_k or 5)),
            "recommend-ranked": lambda: queries.recommend_ranked(nodes, edges, skills, int(args.top_k or 5)),
            "skill-gap": lambda: queries.skill_gap(nodes, edges, args.occupation, skills, loose=False),
            "growth-path": lambda: queries.growth_path(nodes, edges, args.source, args.target),
            "evaluate-graph": lambda: evaluation.evaluate_graph(nodes, edges),
            "evaluate-recommendations": lambda: evaluation.evaluate_recommendations(edges, int(args.k or 5), int(args.holdout or 1)),
        }
        _show(answers[c](), args.output)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("skillweave").getOrCreate(), args)


if __name__ == "__main__":
    main()
