"""Reports of a run as JSON and text. A report is for people: what reaches the driver is what it lists."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .config import write_text
from .functions.text import snippet
from .plans.scan import Report
from .sources.files import relative


def as_dict(report: Report, root: str = "", limit: int | None = None) -> dict:
    path = (lambda p: relative(p, root)) if root else (lambda p: p)
    rows = report.components.select("id", "name", "path", "has_styles", F.size("hooks").alias("hooks"), "loc", snippet(F.col("source")).alias("snippet")).orderBy("ord").collect()
    pairs = report.pairs if limit is None else report.pairs.limit(limit)
    return {
        "components": [r.asDict(True) | {"path": path(r["path"])} for r in rows],
        "pairs": [{"a": p["id_a"], "b": p["id_b"], "similarity": p["similarity"], "category": p["category"], "labels": p["labels"], "hints": p["hints"]} for p in pairs.collect()],
        "stats": report.scorecard.first().asDict() | {"reasons": {r["reason"]: r["n"] for r in report.reasons.collect()}} | ({"cache": report.cache} if report.cache else {}),
    }


def as_text(found: dict, total: int | None = None) -> str:
    out = []
    for p in found["pairs"][:total]:
        marks = " ".join(f"#{x}" for x in p["labels"])
        out += [f"{p['similarity']:.4f} | {marks}", f"  {p['a']}", f"  {p['b']}", *(f"  - {h}" for h in p["hints"])]
    stats = found["stats"]
    out.append(f"{stats['evaluated']} pairs compared, {stats['suppressed']} suppressed, {stats['covered']} components covered")
    for reason, n in sorted(stats["reasons"].items(), key=lambda x: (-x[1], x[0]))[:3]:
        out.append(f"  {reason}: {n}")
    for what, n in stats.get("cache", {}).items():
        out.append(f"{what}: {n['hits']} cached, {n['misses']} new, {n['cleaned']} removed")
    return "\n".join(out)


def grid(rows: list[dict], columns: list[str]) -> str:
    cells = [columns] + [[f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def emit(report: Report, out: str, root: str = "", total: int | None = None) -> dict:
    """Writes <out>.json and <out>.txt, and returns what they hold."""
    found = as_dict(report, root)
    write_text(f"{out}.json", json.dumps(found, indent=1, default=str))
    write_text(f"{out}.txt", as_text(found, total))
    return found


def emit_tables(report: Report, out: str) -> None:
    """Writes components, pairs, reasons and the scorecard as JSON lines below the folder out, from where they are: nothing passes through
    the driver."""
    shown = report.components.select("ord", "id", "name", "path", "has_styles", F.size("hooks").alias("hooks"), "loc", snippet(F.col("source")).alias("snippet"))
    for name, rows in (("components", shown), ("pairs", report.pairs), ("reasons", report.reasons), ("scorecard", report.scorecard)):
        rows.write.mode("overwrite").json(f"{out.rstrip('/')}/{name}")
