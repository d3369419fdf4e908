"""Reports of a comparison.  What they show is a row a finding, block or value; lines stay in Spark."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.text import strip_escapes
from driftlens.operators.fields import PROBLEMS
from driftlens.plans.diff import Diff

# Lines of a block that are shown, characters of a line, and what marks a line as the cause.
BLOCK_LINES, CLIP = 12, 400
DIAGNOSTIC = re.compile(
    r"^\s*(?:(?:[A-Za-z]:[/\\])?[^\s:]+\.(?:go|rs|py|[cm]?[jt]sx?|[ch](?:pp|xx)?|java|rb):[0-9]+(?::[0-9]+)?:(?:\s|$)|E\s{3,}\S|(?:panic|fatal|caused by|assertion failed):"
    r"|thread .+ panicked at\b|(?:[A-Za-z0-9_$.]+\.)?[A-Za-z0-9_$]*(?:Error|Exception):|error(?:\[E[0-9]+\])?:)",
    re.I,
)
SEVERITY = re.compile(r"(?:^|[\s\[\"=:])(?:error|fatal|panic)(?:[\s\]\"=:]|$)", re.I)


def printable(text: str) -> str:
    """Without escapes and control characters; tabs as spaces."""
    return re.sub(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "", strip_escapes(text).replace("\t", "    "))


def clip(text: str, n: int = CLIP) -> str:
    return text if len(text) <= n else text[: n - 1] + "…"


def truncate_location(path: str, rest: str, limit: int) -> str:
    """``path`` and ``rest`` in ``limit`` characters: a long path loses its begin, as its end and the line tell most."""
    room = limit - len(rest)
    if len(path) <= room:
        return path + rest
    return "…" + path[len(path) - max(0, room - 1) :] + rest


def thousands(n: int) -> str:
    return f"{n:,}"


def excerpt(lines: list[str], limit: int = BLOCK_LINES) -> list[int]:
    """Which lines of a block to show: first and last, likely causes (the later first), then from both ends."""
    n = len(lines)
    if not limit or n <= limit:
        return list(range(n))
    tail = limit // 3
    head = limit - tail
    rank = [2 if DIAGNOSTIC.search(printable(x)) else 1 if SEVERITY.search(printable(x)) else 0 for x in lines]
    marked = [i for i in range(n) if rank[i]]
    chosen: list[int] = []
    if marked:
        chosen += [0] if limit >= 2 else []
        if limit >= 3:
            chosen += [n - 1, *(i for i in marked if i < head or i >= n - tail)]
        chosen = list(dict.fromkeys(chosen))
        chosen += [i for i in sorted(marked, key=lambda i: (-rank[i], -i)) if i not in chosen][: max(0, limit - len(chosen))]
    for i in [*range(head), *range(n - 1, n - tail - 1, -1)]:
        if len(chosen) < limit and i not in chosen:
            chosen.append(i)
    return sorted(chosen)


def _rows(df: DataFrame, *order) -> list[dict]:
    return [json.loads(r["j"]) for r in df.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("j")).collect()]


def document(d: Diff) -> dict:
    """The whole comparison as plain values; context, where asked for, is with its finding or value."""
    watches = [
        {
            "pointer": w.pointer, "group_by": list(w.group_by), "complete": w.is_complete(), "coverage": _rows(w.coverage, "run_idx"), "values": _rows(w.values, "group_json", "value_json"),
            **({} if w.rate_groups is None else {"rate_groups": _rows(w.rate_groups, "group_json"), "rate_changes": _rows(w.rate_changes, "group_json", "value_json")}),
        }
        for w in d.watches
    ]
    return {
        "baseline_totals": d.baseline_totals, "target_total": d.target_total, "total_templates": d.total_templates,
        "findings": _rows(d.findings.drop("last_base", "cid", "pos", "value"), "index"), "blocks": _rows(d.blocks, "block"),
        "value_findings": _rows(d.value_findings, F.desc("established"), "template", "position"), "watched_fields": watches,
    }


def to_json(d: Diff) -> str:
    return json.dumps(document(d), indent=2, ensure_ascii=False)


def _items(doc: dict, kind: str) -> list[dict]:
    """Blocks and findings outside of blocks, the greater score first, blocks first of equals."""
    blocks = [{**b, "is_block": True} for b in doc["blocks"] if b["kind"] == kind]
    single = [{**f, "is_block": False} for f in doc["findings"] if f["kind"] == kind and "block" not in f]
    return sorted(blocks + single, key=lambda x: -x["score"])


def _context_lines(context: dict | None, number: int | None, raw: str | None) -> list[tuple[int, str, bool]]:
    """(number, line, whether it is the finding's own) of a window in order."""
    if not context or number is None:
        return []
    around = [(x["line_no"], x.get("raw", ""), False) for x in [*(context.get("before") or []), *(context.get("after") or [])]]
    return sorted([*around, (number, raw or "", True)])


def _seen(x: dict, target: str, baseline: str) -> tuple[str, int | None, str | None]:
    """(file, line number, line) that a finding is shown by."""
    side = "first_baseline" if x["kind"] == "gone" else "first_target"
    return baseline if x["kind"] == "gone" else target, x.get(f"{side}_line_no"), x.get(f"{side}_raw")


def _block(x: dict, doc: dict, limit: int) -> tuple[list[dict], list[tuple[int | None, str, int]]]:
    """(members, (line number, line, times) of those shown; None and a count where some are left out)."""
    members = [doc["findings"][i] for i in x["findings"]]
    line = "first_target_line_no" if x["kind"] == "new" else "first_baseline_line_no"
    raws = [m[line.replace("_line_no", "_raw")] for m in members]
    out, last = [], -1
    for i in [*excerpt(raws, limit), len(raws)]:
        if i > last + 1:
            out.append((None, "", i - last - 1))
        if i < len(raws):
            out.append((members[i][line], raws[i], members[i]["target_count"] if x["kind"] == "new" else members[i]["baseline_counts"][0]))
        last = i
    return members, out


def to_text(d: Diff, baselines: list[str], target: str, block_lines: int = BLOCK_LINES, width: int = 100) -> str:
    """The report for a terminal."""
    doc, total = document(d), d.report_count()
    shown = lambda s: clip(printable(s))
    place = lambda path, rest: " " * 11 + truncate_location(path, f":{rest}", width - 11)
    lines = " + ".join(thousands(n) for n in d.baseline_totals)
    before = f" ({d.finding_count()} before grouping)" if doc["blocks"] else ""
    out = [f"{', '.join(baselines)} → {target}", f"{lines} → {thousands(d.target_total)} lines · {thousands(d.total_templates)} templates · {total} finding{'' if total == 1 else 's'}{before}", ""]

    def own(x, path, number, raw):
        window = _context_lines(x.get("context"), number, raw)
        if window:
            out.extend(f"           {'>' if mine else ' '} {k:>6} | {shown(text)}" for k, text, mine in window)
        elif raw is not None:
            out.append(f"           {shown(raw)}")

    for kind in ("new", "changed", "gone"):
        for x in _items(doc, kind):
            path, number, raw = _seen(x, target, baselines[0] if baselines else "")
            if x["is_block"]:
                members, rows = _block(x, doc, block_lines)
                more = f" · {x['lines_elsewhere']} elsewhere" if x["lines_elsewhere"] else ""
                out += [f"{kind.upper():<10} {len(members)} templates · {x['line_count']} lines{more}  score={x['score']:.1f}", place(path, f"{x['first_line_no']}-{x['last_line_no']}")]
                out += [f"           … {n} more" if at is None else f"           {at:>6} | {shown(text)}" + (f"  ×{n}" if n > 1 else "") for at, text, n in rows]
            else:
                counts = ",".join(map(str, x["baseline_counts"]))
                out.append(f"{kind.upper():<10} baseline={counts} target={x['target_count']}  score={x['score']:.1f}  {shown(x['template'])}")
                if raw is not None:
                    out.append(place(path, number))
                    own(x, path, number, raw)
            out.append("")
    for v in doc["value_findings"]:
        if "block" in v:
            continue
        out += [f"NEW VALUE  {shown(with_value(v['template'], v['position'], v['new_value']))}  (baseline: {', '.join(v['baseline_values'])})", place(target, v["first_target_line_no"])]
        own(v, target, v["first_target_line_no"], v["first_target_raw"])
        out.append("")
    for w in doc["watched_fields"]:
        out.append(f"FIELD      {w['pointer']}" + (f" by {', '.join(w['group_by'])}" if w["group_by"] else "") + f"  ({'complete' if w['complete'] else 'incomplete'})")
        for c in w["coverage"]:
            if c.get("first_problem"):
                path = target if c["run_idx"] == len(baselines) else baselines[c["run_idx"]]
                out += [place(path, f"{c['first_problem']['line_no']}  first problem"), f"           {shown(c['first_problem'].get('raw', ''))}"]
        for v in w["values"]:
            mark = "NEW " if v.get("is_new") else ""
            out.append(f"           {mark}{' '.join(v.get('group_json', []))} {shown(v['value_json'])}  {','.join(map(str, v['baseline_counts']))} → {v['target_count']}")
            if v.get("first_target") and (v.get("is_new") or v.get("context")):
                out.append(place(target, v["first_target"]["line_no"]))
                own(v, target, v["first_target"]["line_no"], v["first_target"].get("raw", ""))
        for c in w.get("rate_changes", []):
            rates = ", ".join("-" if r is None else f"{100 * r:.4f}%" for r in c["baseline_rates"])
            out.append(f"           RATE {' '.join(c['group_json'])} {shown(c['value_json'])}  {rates} → {100 * c['target_rate']:.4f}%  ({c['range_distance_pp']:+.4f} pp, score={c['score']:.1f})")
        out.append("")
    return ("\n".join(out)).rstrip() + "\n"


def _table(heads: list[str], rows: list[list[str]]) -> list[str]:
    """A Markdown table; a head that begins with ``#`` stands over numbers."""
    marks = ["---:" if h.startswith("#") else "---" for h in heads]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line([h.removeprefix("#") for h in heads]), line(marks), *map(line, rows), ""]


def to_markdown(d: Diff, baselines: list[str], target: str, block_lines: int = BLOCK_LINES) -> str:
    """The report as Markdown: blocks as fenced excerpts, everything else in tables."""
    doc, total = document(d), d.report_count()
    lines = " + ".join(thousands(n) for n in d.baseline_totals)
    out = [
        f"{', '.join(map(code, baselines))} ({lines} lines) → {code(target)} ({thousands(d.target_total)} lines), {thousands(d.total_templates)} templates, {total} finding{'' if total == 1 else 's'}"
        + (f" ({d.finding_count()} before grouping)" if doc["blocks"] else ""), "",
    ]
    if not d.complete():
        out += ["**A watched field is incomplete, so that this report can't show that nothing has changed.**", ""]
    contexts: list[tuple[str, list]] = []

    def where(x, path, number, raw):
        if raw is None:
            return "—"
        if window := _context_lines(x.get("context"), number, raw):
            contexts.append((f"{path}:{number}", window))
        return f"{code(f'{path}:{number}', True)} {code(raw, True)}"

    for kind, title in (("new", "New"), ("changed", "Changed"), ("gone", "Gone")):
        items, rows = _items(doc, kind), []
        if items:
            out += [f"### {title}", ""]
        for x in items:
            path, number, raw = _seen(x, target, baselines[0] if baselines else "")
            if x["is_block"]:
                members, shown = _block(x, doc, block_lines)
                more = f", {x['lines_elsewhere']} elsewhere" if x["lines_elsewhere"] else ""
                excerpted = [f"… {n} more" if at is None else f"{at:>6} | {clip(printable(text))}" + (f"  ×{n}" if n > 1 else "") for at, text, n in shown]
                fence = "`" * (max([2, *(len(m) for text in excerpted for m in re.findall("`+", text))]) + 1)
                out += [f"{len(members)} templates, {x['line_count']} lines{more}, score {x['score']:.1f}, {code(f'{path}:{x['first_line_no']}-{x['last_line_no']}')}", "", fence, *excerpted, fence, ""]
            else:
                rows.append([f"{x['score']:.1f}", "/".join(map(str, x["baseline_counts"])), str(x["target_count"]), code(x["template"], True), where(x, path, number, raw)])
        if rows:
            out += _table(["#Score", "#Baseline", "#Target", "Template", "Last seen" if kind == "gone" else "First seen"], rows)
    values = [v for v in doc["value_findings"] if "block" not in v]
    if values:
        rows = [[code(v["template"], True), code(v["new_value"], True), code(", ".join(v["baseline_values"]), True), where(v, target, v["first_target_line_no"], v["first_target_raw"])] for v in values]
        out += ["### New values", "", *_table(["Template", "New value", "Baselines' values", "First seen"], rows)]
    for w in doc["watched_fields"]:
        by = f" by {', '.join(map(code, w['group_by']))}" if w["group_by"] else ""
        out += [f"### {code(w['pointer'])}{by}, {'complete' if w['complete'] else 'incomplete'}", ""]
        problems = [c for c in w["coverage"] if c.get("first_problem")]
        rows = [[code(target if c["run_idx"] == len(baselines) else baselines[c["run_idx"]], True), *(str(c[k]) for k in ("lines", "matched", "missing", "non_json")), str(sum(c[k] for k in PROBLEMS))] for c in w["coverage"]]
        out += _table(["Run", "#Lines", "#Matched", "#Missing", "#Not JSON", "#Problems"], rows)
        if problems:
            rows = [[code(target if c["run_idx"] == len(baselines) else baselines[c["run_idx"]], True), str(c["first_problem"]["line_no"]), code(c["first_problem"].get("raw", ""), True)] for c in problems]
            out += _table(["Run", "#First problem", "Line"], rows)
        group = lambda v: [code(" ".join(v.get("group_json", [])), True)] if w["group_by"] else []  # noqa: B023, E731
        rows = []
        for v in w["values"]:
            at = v.get("first_target") or {}
            rows.append([*group(v), code(v["value_json"], True), "/".join(map(str, v["baseline_counts"])), str(v["target_count"]), {True: "new", False: "", None: "unknown"}[v.get("is_new")], where(v, target, at.get("line_no"), at.get("raw", "") if at else None)])
        if rows:
            out += _table([*(["Group"] if w["group_by"] else []), "Value", "#Baseline", "#Target", "", "First seen"], rows)
        rows = []
        for c in w.get("rate_changes", []):
            rates = "/".join("-" if r is None else f"{100 * r:.4f}%" for r in c["baseline_rates"])
            rows.append([*group(c), code(c["value_json"], True), rates, f"{100 * c['target_rate']:.4f}%", f"{c['range_distance_pp']:+.4f}", f"{c['score']:.1f}"])
        if rows:
            out += _table([*(["Group"] if w["group_by"] else []), "Value", "#Baseline rate", "#Target rate", "#Points outside", "#Score"], rows)
    for place, window in contexts:
        shown = [f"{'>' if mine else ' '} {k:>6} | {clip(printable(text))}" for k, text, mine in window]
        fence = "`" * (max([2, *(len(m) for text in shown for m in re.findall("`+", text))]) + 1)
        out += [code(place), "", fence, *shown, fence, ""]
    if not total and d.complete():
        out.append("Nothing has changed significantly.")
    return ("\n".join(out)).rstrip() + "\n"


def with_value(template: str, position: int, value: str) -> str:
    words = template.split(" ")
    words[position] = value
    return " ".join(words)


def code(text: str, in_table: bool = False) -> str:
    """A Markdown code span, fenced by more backticks than it holds in a row; in a table, bars are escaped."""
    text = clip(printable(text))
    if not text:
        return "<code></code>"
    longest = max((len(m) for m in re.findall("`+", text)), default=0)
    spaced = text[0] == text[-1] == " " and text.strip(" ")
    pad = " " if text.startswith("`") or text.endswith("`") or spaced else ""
    return "`" * (longest + 1) + pad + (text.replace("|", "\\|") if in_table else text) + pad + "`" * (longest + 1)


def templates_text(df: DataFrame, total: int) -> str:
    """The table of the most frequent templates."""
    rows = df.collect()
    return "\n".join(f"{thousands(r['count']):>10}  {100 * r['count'] / max(total, 1):5.1f}%  {clip(printable(r['template']))}" for r in rows) + "\n"
