"""A report to be kept or passed on: versioned, with its settings and a digest of each input, without the inputs."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.config import DiffOptions
from driftlens.operators.lineage import durable
from driftlens.plans.diff import Diff
from driftlens.plans.report import document

FORMAT, VERSIONS = "driftlens-report", (1, 2, 3)
#: Lines of a range, and ranges whose digests are merged at once.
RANGE, FAN = 1 << 16, 1 << 12


def digest(lines: DataFrame, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """(run_idx, lines, sha256) of each run.

    Ranges of lines are digested side by side; a digest of digests in their order merges
    ``fan`` of them, until one is left.  So it says what the lines are and in which order,
    and no task gets more than a range.
    """
    n = lines.groupBy("run_idx").agg(F.count("*").alias("lines"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), "\n", "")
    at = F.struct(F.col("line_no").alias("k"), F.concat(F.lit("|"), F.coalesce("raw", F.lit(""))).alias("text"))  # the bar tells no line from an empty one
    level = lines.groupBy("run_idx", F.floor((F.col("line_no") - 1) / size).alias("k")).agg(F.sha2(joined(at), 256).alias("text"))
    while True:
        level = durable(level)
        if not level.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]:
            break
        level = level.groupBy("run_idx", F.floor(F.col("k") / fan).alias("k")).agg(F.sha2(joined(F.struct("k", "text")), 256).alias("text"))
    return n.join(level.select("run_idx", F.col("text").alias("sha256")), "run_idx")


def version_of(options: DiffOptions) -> int:
    """The least version that knows what the options ask for."""
    return 3 if options.watch_rate_change is not None else 2 if options.watch_by else 1


def export(d: Diff, lines: DataFrame, names: list[str], options: DiffOptions = DiffOptions(), at: datetime | None = None) -> str:
    """The report of a comparison of ``lines`` (run_idx, line_no, raw), whose runs are named, the target last."""
    made = {r["run_idx"]: r for r in digest(lines).collect()}  # a row a run
    sources = [{"name": n, "lines": made[k]["lines"] if k in made else 0, "sha256": made[k]["sha256"] if k in made else None} for k, n in enumerate(names)]
    return json.dumps({
        "format": FORMAT, "schema_version": version_of(options), "completed_at": (at or datetime.now(timezone.utc)).isoformat(),
        "settings": {
            "threshold": options.threshold, "significance": options.significance, "group": options.group, "context": options.context, "masks": [[m.pattern, m.placeholder] for m in options.masks],
            "watch_fields": list(options.watch_fields), **({"watch_by": list(options.watch_by)} if options.watch_by else {}), **({} if options.watch_rate_change is None else {"watch_rate_change": options.watch_rate_change}),
        },
        "sources": {"baselines": sources[:-1], "target": sources[-1]}, "result": document(d),
    }, ensure_ascii=False, indent=2)


def load(text: str) -> dict:
    """A report that ``export`` has written; one of another format or of a version that isn't known is refused."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise ValueError(f"not a report: {e}") from None
    if not isinstance(doc, dict) or doc.get("format") != FORMAT:
        raise ValueError("not a report of this kind")
    if doc.get("schema_version") not in VERSIONS or isinstance(doc["schema_version"], bool):
        raise ValueError(f"a report of version {doc.get('schema_version')!r}; known are {', '.join(map(str, VERSIONS))}")
    missing = [k for k in ("completed_at", "settings", "sources", "result") if k not in doc]
    if missing:
        raise ValueError(f"the report lacks {', '.join(missing)}")
    return doc
