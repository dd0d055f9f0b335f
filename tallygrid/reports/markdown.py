"""Pages in Markdown, written on the driver from collected rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from .figures import percent


def table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in rows)])


def shown(value: object) -> str:
    """A cell of a table: shares as percentages, nothing for null."""
    return "" if value is None else percent(value, 2) if isinstance(value, float) else str(value)


def interval(lo: float, hi: float) -> str:
    return f"{lo * 100:.1f}–{hi * 100:.1f} %"


def run_page(run: Mapping, cells: Sequence[Mapping], marginals: Sequence[Mapping], rates: Sequence[Mapping], figures: Sequence[Path] = ()) -> str:
    """One run: settings, recall and alarm rate at each budget, cells and marginals."""
    budgets = sorted({c["budget"] for c in cells}, key=lambda b: (b is None, b))
    parts = [f"# {run['title']}", "", table(("setting", "value"), [(k, str(v)) for k, v in run.items() if k != "title" and v is not None])]
    for b in budgets:
        mine = [c for c in cells if c["budget"] == b]
        hits, n = sum(c["hits"] for c in mine), sum(c["n"] for c in mine)
        least = sorted(mine, key=lambda c: (c["recall"], c["family"], c["action"]))
        parts += ["", f"## At {'its own point' if b is None else percent(b, 3) + ' false positives'}", "", f"Recall {percent(hits / n if n else 0.0)} of {n}; worst cells: " + ", ".join(f"{c['family']}/{c['action']} {percent(c['recall'])}" for c in least[: max(1, len(least) // 10)])]
        parts += ["", table(("carrier", "false positives", "95 %"), [(str(r["host_type"]), percent(r["fpr"], 3), interval(r["lo"], r["hi"])) for r in rates if r["budget"] == b])]
        parts += ["", table(("axis", "key", "recall", "n", "95 %"), [(m["axis"], m["key"], percent(m["recall"]), str(m["n"]), interval(m["lo"], m["hi"])) for m in marginals if m["budget"] == b])]
    parts += ["", *(f"![]({p.name})" for p in figures)]
    return "\n".join(parts) + "\n"


def comparison(rows: Sequence[Mapping], budgets: Sequence[float]) -> str:
    """Detectors weakest first; verdicts, marked †, after them and only where they fit a budget."""
    def cell(r: Mapping, b: float) -> str:
        if r["verdict"]:
            return percent(r["recall"].get(None)) + "†" if (r["fpr"].get(None) or 0.0) <= b * 1.25 else "·"
        return percent(r["recall"].get(b))

    key = lambda r: (r["verdict"], r["recall"].get(None if r["verdict"] else budgets[0]) or 0.0, r["title"])
    body = [(r["title"], r["aperture"], *(cell(r, b) for b in budgets)) for r in sorted(rows, key=key)]
    head = ("detector", "reads", *(f"recall at {percent(b, 2)}" for b in budgets))
    return "\n".join(["# Comparison", "", table(head, body), "", "† a verdict at its own point: it cannot be moved to a budget."]) + "\n"


def index(pages: Mapping[str, str]) -> str:
    return "\n".join(["# Reports", "", *(f"- [{title}]({path})" for title, path in sorted(pages.items()))]) + "\n"


def write(text: str, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path
