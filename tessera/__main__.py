"""python -m tessera COMMAND ...: train, predict, all, score, errors, recall, blocking, caps, owners, holdout, validate, query."""

from __future__ import annotations

import argparse
import json
from dataclasses import fields

from tessera.config import Config
from tessera.session import session


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, settings: bool = False, **options: dict) -> None:
        p = commands.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        for k, v in options.items():
            p.add_argument(f"--{k.replace('_', '-')}", **v)
        if settings:
            for f in fields(Config):
                p.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default) if not isinstance(f.default, tuple) else str, nargs="*" if isinstance(f.default, tuple) else None, default=f.default)

    command("train", "data", "models", settings=True, run={"default": None, "help": "a name; a run of it that was stopped goes on"})
    command("predict", "data", "models", "out", settings=True)
    command("all", "data", "models", "out", settings=True)
    command("score", "truth", "predicted", source={"default": None})
    command("blocking", "truth", "candidates", n_index={"type": int, "default": 1})
    command("caps", "truth", "predicted")
    command("owners", "truth")
    command("holdout", "truth", share={"type": float, "default": 0.1})
    command("errors", "truth", "predicted", "candidates", source={"default": None}, examples={"default": None})
    command("recall", "truth", "candidates", source={"default": None})
    command("validate", "lists", "header", source={"default": None}, index={"nargs": "*", "default": []}, candidates={"default": None})
    command("query", "name", "tables")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from tessera import catalogue
    from tessera.plans import diagnose, linkage
    from tessera.sources import lists

    args, spark = parsed(argv), session()
    config = Config(**{f.name: tuple(v) if isinstance(v := getattr(args, f.name), list) else v for f in fields(Config)}) if hasattr(args, "k_key") else None
    show = lambda df: df.show(1000, truncate=False)
    if args.command in ("train", "all"):
        print(json.dumps(linkage.train(spark, args.data, args.models, config, run=getattr(args, "run", None)), sort_keys=True))
    if args.command in ("predict", "all"):
        checks = linkage.predict(spark, args.data, args.models, args.out, config)
        show(checks)
        return int(checks.where("n > 0").count() > 0)
    if args.command == "score":
        show(diagnose.score(spark, args.truth, args.predicted, args.source))
    elif args.command == "blocking":
        show(diagnose.blocking(spark, args.truth, args.candidates, args.n_index))
    elif args.command == "caps":
        show(diagnose.caps(spark, args.truth, args.predicted))
    elif args.command == "owners":
        show(diagnose.owners(spark, args.truth))
    elif args.command == "holdout":
        show(diagnose.holdout(spark, args.truth, args.share))
    elif args.command == "validate":
        faults = lists.file_faults(spark, args.lists, args.header)
        print("\n".join(faults) or "no fault")
        checks = diagnose.checked(spark, args.lists, args.header, args.source, args.index, args.candidates) if args.source and args.index else None
        if checks is not None:
            show(checks)
        return int(bool(faults) or (checks is not None and checks.where("n > 0 and check <> 'not_candidate'").count() > 0))
    elif args.command == "errors":
        show(diagnose.errors(spark, args.truth, args.predicted, args.candidates, args.source, args.examples))
    elif args.command == "recall":
        show(diagnose.blocking_by_source(spark, args.truth, args.candidates, args.source))
    elif args.command == "query":
        show(catalogue.QUERIES[args.name](spark, args.tables))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
