"""Command line: scan a folder, or score models on a suite."""

from __future__ import annotations

import argparse
import os

from . import config as settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="find near-duplicate components below a folder")
    scan.add_argument("root")
    bench = sub.add_parser("benchmark", help="score embedding models on a labelled suite")
    bench.add_argument("suite")
    bench.add_argument("--root", default=".")
    bench.add_argument("--models", nargs="*", default=["mock"], help="none for all that are known")
    for q in (scan, bench):
        for name in ("include", "exclude", "compare", "ignore-names", "ignore-usages", "disabled-labels", "style-extensions"):
            q.add_argument(f"--{name}", nargs="*")
        for name in ("threshold", "high-threshold", "max-threshold"):
            q.add_argument(f"--{name}", type=float)
        q.add_argument("--limit", type=int)
        q.add_argument("--min-path-distance", type=int)
        for name in ("model", "model-path", "language", "out", "cache"):
            q.add_argument(f"--{name}")
        q.add_argument("--api-url", help="address of a remote backend")
        q.add_argument("--api-key")
        q.add_argument("--api-model")
        q.add_argument("--api-timeout", type=float, help="seconds")
        q.add_argument("--model-repo", help="where a local model comes from; fetching needs a hook, see operators.embed.fetch")
        q.add_argument("--auto-download-model", action="store_true", default=None)
        q.add_argument("--no-progress", dest="progress", action="store_false", default=None)
        q.add_argument("--no-ignores", dest="allow_ignores", action="store_false", default=None)
        q.add_argument("--relative-paths", action="store_true", default=None)
        q.add_argument("--config")
        q.add_argument("--save-config", action="store_true")
    return p


def config_of(args: argparse.Namespace) -> settings.Config:
    own = {k: v for k, v in vars(args).items() if v is not None and k in settings.Config.__dataclass_fields__ and k != "root"}
    remote = {k: getattr(args, f"api_{k}") for k in ("url", "key", "model", "timeout") if getattr(args, f"api_{k}") is not None}
    own |= {"remote": remote} if remote else {}
    found = settings.load(os.path.abspath(args.root), own, args.config)
    if args.save_config:
        settings.save(found, args.config or os.path.join(args.root, settings.FILE))
    return found


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = config_of(args)
    from pyspark.sql import SparkSession

    from . import report
    from .plans import benchmark, scan
    from .sources import files

    shown = "true" if config.progress else "false"
    spark = SparkSession.builder.appName("kinfold").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", shown).getOrCreate()
    root = config.root if config.relative_paths else ""
    if args.command == "scan":
        found = scan.scan(spark, config)
        if config.out.endswith("/"):
            report.emit_tables(found, config.out)
            return 0
        made = report.emit(found, config.out, root, config.limit) if config.out else report.as_dict(found, root)
        print(report.as_text(made, config.limit))
        return 0
    groups, hard = files.load_suite(spark, args.suite)
    models = {benchmark.resolve_model(m)[1]: benchmark.model_config(config, m) for m in args.models or benchmark.DEFAULT_MODELS}
    rows = benchmark.compare_models(spark, models, lambda c: scan.scan(spark, c).components, groups, hard).collect()
    print(report.grid([r.asDict() for r in rows], ["model", "score", "best_f1", "average_precision", "mrr", "recall_at_1", "recall_at_3", "threshold", "gap", "hard_fp"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
