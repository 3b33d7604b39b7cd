"""python -m tarnsieve analyse|summary|report|baseline|list-rules|init|dashboard [options] [paths]"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tarnsieve import config as cfg
from tarnsieve import serve
from tarnsieve.plans.engine import Engine
from tarnsieve.rules.base import PILLARS
from tarnsieve.sinks import report as sinks


def _words(x: str) -> list[str]:
    return [w.strip() for w in x.split(",") if w.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnsieve")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyse", "summary", "report", "baseline", "list-rules", "init", "dashboard"):
        s = sub.add_parser(name)
        s.add_argument("--config")
        s.add_argument("--no-config", action="store_true")
        s.add_argument("--root", default=".")
        if name == "init":
            s.add_argument("--force", action="store_true")
            continue
        if name == "list-rules":
            s.add_argument("--format", default="text", choices=["text", "json"])
            continue
        if name == "dashboard":
            s.add_argument("paths", nargs="*")
            s.add_argument("--host", default=serve.HOST)
            s.add_argument("--port", type=int, default=serve.PORT)
            s.add_argument("--scan-timeout", type=float, default=serve.TIMEOUT)
            s.add_argument("--baseline", default="")
            s.add_argument("--fail-on", default="", choices=["", "advisory", "warning", "error", "none"])
            s.add_argument("--editor", default="none", choices=[*sinks.EDITORS])
            for x in ("no-baseline", "include-ignored", "diff", "interactive", "allow-public"):
                s.add_argument(f"--{x}", action="store_true")
            continue
        s.add_argument("--format", default={"report": "html"}.get(name, "text"))
        s.add_argument("paths", nargs="*")
        s.add_argument("--include-ignored", action="store_true")
        if name != "baseline":
            s.add_argument("--baseline")
            s.add_argument("--diff")
            s.add_argument("--fail-on", choices=["advisory", "warning", "error", "none"])
            for x in ("rules", "pillars", "without-rules", "without-pillars"):
                s.add_argument(f"--{x}", type=_words, default=[])
        if name in ("analyse", "report"):
            s.add_argument("--interactive", action="store_true", help="HTML with a filter of findings")
            s.add_argument("--editor", default="none", choices=[*sinks.EDITORS], help="HTML with links that open files there")
        if name == "analyse":
            s.add_argument("--generate-baseline", metavar="FILE", help="write the findings as reviewed")
        if name == "summary":
            s.add_argument("--top", type=int, default=10)
        if name in ("report", "baseline"):
            s.add_argument("--out")
    return p


def guard_baseline(a: argparse.Namespace) -> None:
    """A baseline holds all findings there are, so nothing may have narrowed them."""
    for given, what in ((a.baseline, "--baseline"), (a.diff, "--diff"), (a.rules or a.pillars or a.without_rules or a.without_pillars, "display filters")):
        if given:
            raise ValueError(f"--generate-baseline can't go with {what}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if the gate fired, or 2 for diagnostics and wrong use."""
    a = parser().parse_args(argv)
    try:
        config = cfg.load_auto(a.root, a.config, a.no_config)
        if a.command == "init":
            path = os.path.join(a.root, cfg.FILE)
            if os.path.exists(path) and not a.force:
                raise ValueError(f"{path} is there; --force merges it")
            with open(path, "w", encoding="utf-8") as f:
                f.write(cfg.render(config))
            return 0
        spark = spark or SparkSession.builder.appName("tarnsieve").getOrCreate()
        if a.command == "dashboard":
            d = serve.Defaults(a.root, a.paths, a.config or "", a.no_config, a.baseline, a.no_baseline, a.include_ignored, a.diff, a.fail_on, a.interactive, a.editor, a.scan_timeout)
            return serve.serve(spark, d, a.host, a.port, a.allow_public)
        engine = Engine(spark, a.root, config)
        if a.command == "list-rules":
            rules = engine.rules().orderBy("id").collect()
            if a.format == "json":
                print(sinks.as_rules_json(rules))
            else:
                for r in rules:
                    print(r.id, r.pillar, r.severity, r.confidence, r.capability, r.title, sep="\t")
            return 0
        if a.command == "baseline":
            print(engine.write_baseline(a.out or "tarnsieve-baseline.json", a.paths or None))
            return 0
        if getattr(a, "generate_baseline", None):
            guard_baseline(a)
            print(engine.write_baseline(a.generate_baseline, a.paths or None))
            return 0
        for p in (*a.pillars, *a.without_pillars):
            if p not in PILLARS:
                raise ValueError(f"no such pillar: {p}")
        display = {"rules": a.rules, "pillars": a.pillars, "without_rules": a.without_rules, "without_pillars": a.without_pillars}
        r = engine.analyse(a.paths or None, baseline=a.baseline, diff=a.diff, fail_on=a.fail_on, command=a.command, include_ignored=a.include_ignored, display=display)
        out = (sinks.as_summary_json(r) if a.format == "json" else sinks.as_summary(r, a.top, a.paths)) if a.command == "summary" else sinks.render(r, a.format, getattr(a, "interactive", False), getattr(a, "editor", "none"), os.path.abspath(a.root))
    except (ValueError, OSError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 2
    if getattr(a, "out", None):
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        sys.stdout.write(out)
    return r.exit_code


if __name__ == "__main__":
    sys.exit(main())
