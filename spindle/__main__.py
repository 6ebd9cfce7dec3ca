"""Commands: python -m spindle prepare|audit|analyze|sample|evaluate|compare|seeds|promote ... A failed check ends with exit code 2 and writes nothing."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import config, evaluation, reports, workflow
from .sources import tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindle", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    prepare = sub.add_parser("prepare", help="write prepared splits of a task")
    prepare.add_argument("--task", type=Path, required=True)
    prepare.add_argument("--output", required=True)
    prepare.add_argument("--local-jsonl")
    prepare.add_argument("--heldout-fraction", type=float)
    prepare.add_argument("--seed", type=int, default=42)
    prepare.add_argument("--fail-on-overlap", action="store_true")
    prepare.add_argument("--deduplicate-cross-split", action="store_true")
    audit = sub.add_parser("audit", help="check prepared data against their manifest and policy")
    audit.add_argument("--data", required=True)
    for flag in ("overlap", "near-duplicate", "pii"):
        audit.add_argument(f"--fail-on-{flag}", action="store_true")
    audit.add_argument("--output", type=Path)
    analyze = sub.add_parser("analyze", help="report lengths, limits, mentions and categories of marked texts")
    analyze.add_argument("sets", nargs="+", metavar="name=path", help="JSON lines with a column text")
    analyze.add_argument("--output", type=Path, help="without its ending: a .json and a .md file")
    compare = sub.add_parser("compare", help="compare two evaluations")
    compare.add_argument("first", type=Path)
    compare.add_argument("second", type=Path)
    compare.add_argument("--first-base", type=Path, help="the starting model's evaluation, if it does not stand beside the first")
    compare.add_argument("--second-base", type=Path)
    compare.add_argument("--output", type=Path)
    sample = sub.add_parser("sample", help="write the encoded rows that a training run reads")
    sample.add_argument("--task", type=Path, required=True)
    sample.add_argument("--data", required=True)
    sample.add_argument("--output", required=True)
    for flag in ("train", "validation", "save-steps"):
        sample.add_argument(f"--{flag}", type=int)
    sample.add_argument("--max-steps", type=int, default=-1)
    sample.add_argument("--seed", type=int, default=42)
    sample.add_argument("--balanced", action="store_true")
    sample.add_argument("--allow-overlap", action="store_true")
    evaluate = sub.add_parser("evaluate", help="evaluate a run from given outputs")
    evaluate.add_argument("--run", required=True)
    evaluate.add_argument("--data", required=True)
    evaluate.add_argument("--outputs", required=True, help="JSON lines of prompt, output, loss and tokens")
    evaluate.add_argument("--split", choices=("validation", "test"), default="test")
    for flag in ("per-label", "rows", "generated", "max-new-tokens"):
        evaluate.add_argument(f"--{flag}", type=int)
    evaluate.add_argument("--seed", type=int, default=42)
    evaluate.add_argument("--base", action="store_true", help="the outputs are the starting model's")
    evaluate.add_argument("--output")
    seeds = sub.add_parser("seeds", help="sum up evaluations of runs that differ in their seed")
    seeds.add_argument("evaluations", nargs="+")
    seeds.add_argument("--output", type=Path)
    promote = sub.add_parser("promote", help="decide on a run by the policy of its own task")
    promote.add_argument("--run", required=True)
    promote.add_argument("--evaluation", type=Path)
    promote.add_argument("--base-evaluation", type=Path)
    promote.add_argument("--registry", required=True)
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    load = lambda p: json.loads(Path(p).read_text(encoding="utf-8"))
    if args.command == "prepare":
        m = workflow.prepare(spark, config.load_task(args.task), args.output, local_jsonl=args.local_jsonl, heldout_fraction=args.heldout_fraction, seed=args.seed, strict_overlap=args.fail_on_overlap, deduplicate=args.deduplicate_cross_split)
        print(json.dumps(m["counts"]))
    elif args.command == "audit":
        report = workflow.audit(spark, args.data, strict_overlap=args.fail_on_overlap, near_duplicates=args.fail_on_near_duplicate, pii=args.fail_on_pii)
        print(json.dumps(report, indent=2))
        if args.output:
            tables.report(args.output, report)
    elif args.command == "analyze":
        sets = {name: tables.jsonl(spark, path) for name, path in tables.inference_inputs(args.sets).items()}
        found = reports.analysis_report(sets)
        print(reports.analysis_markdown(found), end="")
        if args.output:
            tables.report(args.output.with_suffix(".json"), found)
            args.output.with_suffix(".md").write_text(reports.analysis_markdown(found), encoding="utf-8")
    elif args.command == "sample":
        sample = evaluation.training_sample(spark, config.load_task(args.task), args.data, train=args.train, validation=args.validation, save_steps=args.save_steps, max_steps=args.max_steps, balanced=args.balanced, seed=args.seed, allow_overlap=args.allow_overlap)
        report = {k: v for k, v in sample.items() if k not in ("train", "validation")}

        def fill(staging: str) -> None:
            for split in ("train", "validation"):
                sample[split].write.parquet(f"{staging}/{split}")
            tables.write_text(spark, f"{staging}/sample.json", json.dumps(report, indent=2))

        tables.atomically(spark, args.output, fill, "sample.json")
        print(json.dumps(report["examples"]))
    elif args.command == "evaluate":
        result = evaluation.evaluate(spark, args.run, args.data, evaluation.given_outputs(tables.jsonl(spark, args.outputs)), split=args.split, per_label=args.per_label, rows=args.rows, generated=args.generated, max_new_tokens=args.max_new_tokens, seed=args.seed, base=args.base, output=args.output)
        print(json.dumps(result["generation_metric"]))
    elif args.command == "compare":
        paths, bases = (args.first, args.second), [args.first_base, args.second_base]
        for i, path in enumerate(paths):
            beside = workflow.base_name(path.name)
            if bases[i] is None and beside and path.with_name(beside).exists():
                bases[i] = path.with_name(beside)
        one = lambda path: None if path is None else tables.evaluation(spark, str(path))
        text = workflow.compare_report(spark, *map(one, paths), *map(one, bases))
        print(text, end="")
        if args.output:
            args.output.parent.mkdir(parents=True, exist_ok=True)
            args.output.write_text(text, encoding="utf-8")
    elif args.command == "seeds":
        if len(args.evaluations) < 2:
            raise ValueError("a report on seeds needs two evaluations at least")
        results = [load(p) for p in args.evaluations]
        report = workflow.seeds_report(spark, results, [load(Path(r["run_dir"]) / "run_summary.json") for r in results], args.evaluations)
        print(json.dumps(report, indent=2))
        if args.output:
            tables.report(args.output, report)
    else:
        paths = [args.evaluation or Path(args.run) / "test_evaluation.json", args.base_evaluation or Path(args.run) / "base_test_evaluation.json"]
        decision = workflow.promote(spark, args.run, *paths, args.registry)
        if decision["status"] != "promoted":
            raise ValueError(f"rejected: {'; '.join(decision['failures'])}")
        print("promoted")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return run(spark or SparkSession.builder.appName("spindle").getOrCreate(), args)
    except KeyError as e:
        print(f"a file lacks {e}", file=sys.stderr)
        return 2
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
