"""Figures as SVG text, drawn on the driver from a few collected rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Fixed values of the diverging ramp: its middle, its depth and its steps.
HINGE, DEPTH, STEPS = 0.5, 0.5, 21
_LOW, _MID, _HIGH = (0.55, 0.12, 0.06), (0.97, 0.0, 0.0), (0.55, -0.06, -0.11)


def _oklab_to_rgb(lab: tuple[float, float, float]) -> tuple[float, float, float]:
    """Linear sRGB of an OKLab colour (matrices as published for OKLab)."""
    lum, a, b = lab
    x, y, z = ((lum + p * a + q * b) ** 3 for p, q in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480)))
    return (
        4.0767416621 * x - 3.3077115913 * y + 0.2309699292 * z,
        -1.2684380046 * x + 2.6097574011 * y - 0.3413193965 * z,
        -0.0041960863 * x - 0.7034186147 * y + 1.7076147010 * z,
    )


def _hex(rgb: Sequence[float]) -> str:
    def channel(c: float) -> int:
        c = min(1.0, max(0.0, c))
        return round(255 * (12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055))

    return "#" + "".join(f"{channel(c):02x}" for c in rgb)


def heat_colour(value: float) -> str:
    """From the low colour (0) over near white (the hinge) to the high colour (1), in steps."""
    step = round(min(1.0, max(0.0, value)) * (STEPS - 1)) / (STEPS - 1)
    end, share = (_HIGH, (step - HINGE) / (1 - HINGE)) if step >= HINGE else (_LOW, (HINGE - step) / HINGE)
    share *= DEPTH * 2 if DEPTH < 0.5 else 1
    return _hex(_oklab_to_rgb(tuple(m + (e - m) * share for m, e in zip(_MID, end, strict=True))))


def luminance(colour: str) -> float:
    parts = [int(colour[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    r, g, b = (c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in parts)
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: str, b: str) -> float:
    hi, lo = sorted((luminance(a), luminance(b)), reverse=True)
    return (hi + 0.05) / (lo + 0.05)


def ink(ground: str) -> str:
    """Black or white, whichever reads better."""
    return max(("#000000", "#ffffff"), key=lambda c: contrast(c, ground))


def _t(x: float, y: float, text: str, **kw: str) -> str:
    attrs = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in kw.items())
    return f'<text x="{x:.1f}" y="{y:.1f}"{attrs}>{escape(text)}</text>'


def _r(x: float, y: float, w: float, h: float, fill: str, **kw: str) -> str:
    attrs = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in kw.items())
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{fill}"{attrs}/>'


def _svg(w: float, h: float, parts: list[str], title: str) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w:.0f} {h:.0f}" font-family="sans-serif" font-size="12" fill="#222"><title>{escape(title)}</title>'
    return head + "".join(parts) + "</svg>"


def cut(label: str, n: int) -> str:
    return label if len(label) <= n else label[: n - 1] + "…"


def percent(x: float | None, digits: int = 1) -> str:
    return "—" if x is None else f"{x * 100:.{digits}f}%"


def bars(rows: Sequence[tuple[str, float, float, float]], title: str) -> str | None:
    """(label, value, lo, hi), each a bar with its interval."""
    if not rows:
        return None
    parts, left, wide = [], 150, 360
    for i, (label, v, lo, hi) in enumerate(rows):
        y = 30 + 24 * i
        parts += [_t(0, y + 12, cut(label, 22)), _r(left, y, wide * v, 16, heat_colour(v))]
        parts.append(f'<path d="M{left + wide * lo:.1f} {y + 8}H{left + wide * hi:.1f}" stroke="#444"/>')
        parts.append(_t(left + wide + 8, y + 12, percent(v)))
    return _svg(600, 40 + 24 * len(rows), [_t(0, 16, title, font_weight="bold"), *parts], title)


def bars_grouped(groups: Mapping[str, Mapping[str, float]], title: str) -> str | None:
    """One group of bars for each key, one bar for each series."""
    if not groups:
        return None
    parts, y = [_t(0, 16, title, font_weight="bold")], 30.0
    series = sorted({s for g in groups.values() for s in g})
    for key, g in groups.items():
        parts.append(_t(0, y + 12, cut(key, 22)))
        for s in series:
            if s in g:
                parts += [_r(150, y, 300 * g[s], 10, heat_colour(g[s])), _t(456, y + 9, f"{cut(s, 14)} {percent(g[s])}", font_size="10")]
            y += 13
        y += 8
    return _svg(620, y + 8, parts, title)


def _frame(rows: Sequence[str], cols: Sequence[str], draw: Callable[[str, str, float, float], list[str]], title: str) -> str | None:
    if not rows or not cols:
        return None
    w, h = 78.0, 28.0
    parts = [_t(0, 16, title, font_weight="bold")]
    parts += [_t(130 + w * j + w / 2, 40, cut(c, 11), text_anchor="middle") for j, c in enumerate(cols)]
    for i, r in enumerate(rows):
        parts.append(_t(0, 66 + h * i, cut(r, 18)))
        for j, c in enumerate(cols):
            parts += draw(r, c, 130 + w * j, 48 + h * i)
    return _svg(140 + w * len(cols), 60 + h * len(rows), parts, title)


def heat(cells: Mapping[tuple[str, str], tuple[int, int]], rows: Sequence[str], cols: Sequence[str], title: str) -> str | None:
    """Recall of each (row, column) from (hits, n), with pooled margins; a dot where there is no cell."""
    def pooled(keep: Callable[[str, str], bool]) -> tuple[int, int]:
        got = [v for (r, c), v in cells.items() if keep(r, c)]
        return sum(v[0] for v in got), sum(v[1] for v in got)

    every = "all"

    def draw(r: str, c: str, x: float, y: float) -> list[str]:
        v = cells.get((r, c)) if every not in (r, c) else pooled(lambda a, b: r in (a, every) and c in (b, every))
        if not v or not v[1]:
            return [_t(x + 37, y + 18, "·", text_anchor="middle")]
        ground = heat_colour(v[0] / v[1])
        return [_r(x + 1, y + 1, 74, 25, ground, rx="3"), _t(x + 37, y + 18, percent(v[0] / v[1], 0), text_anchor="middle", fill=ink(ground))]

    return _frame([*rows, every] if rows else [], [*cols, every] if cols else [], draw, title)


def heat_diff(diff: Mapping[tuple[str, str], float], rows: Sequence[str], cols: Sequence[str], title: str) -> str | None:
    def draw(r: str, c: str, x: float, y: float) -> list[str]:
        if (r, c) not in diff:
            return [_t(x + 37, y + 18, "·", text_anchor="middle")]
        ground = heat_colour(0.5 + diff[r, c] / 2)
        return [_r(x + 1, y + 1, 74, 25, ground, rx="3"), _t(x + 37, y + 18, f"{diff[r, c] * 100:+.0f}", text_anchor="middle", fill=ink(ground))]

    return _frame(rows, cols, draw, title)


def heat_winner(won: Mapping[tuple[str, str], tuple[str, bool]], colours: Mapping[str, str], rows: Sequence[str], cols: Sequence[str], title: str) -> str | None:
    """The winner of each cell; pale where its lead is not clear."""
    def draw(r: str, c: str, x: float, y: float) -> list[str]:
        if (r, c) not in won:
            return [_t(x + 37, y + 18, "·", text_anchor="middle")]
        name, clear = won[r, c]
        return [_r(x + 1, y + 1, 74, 25, colours.get(name, "#cccccc"), rx="3", opacity="0.75" if clear else "0.25"), _t(x + 37, y + 18, cut(name, 10), text_anchor="middle")]

    return _frame(rows, cols, draw, title)


def hist(bins: Sequence[int], title: str) -> str | None:
    if not any(bins):
        return None
    top, w = max(bins), 560 / len(bins)
    parts = [_r(20 + w * i, 180 - 140 * n / top, w - 1, 140 * n / top, heat_colour((i + 0.5) / len(bins))) for i, n in enumerate(bins)]
    return _svg(600, 200, [_t(0, 16, title, font_weight="bold"), *parts, _t(20, 195, "0%"), _t(560, 195, "100%")], title)


def profiles(lines: Mapping[str, Sequence[float]], title: str) -> str | None:
    """Recalls of each series from best to worst."""
    lines = {k: v for k, v in lines.items() if v}
    if not lines:
        return None
    parts = []
    for i, (name, v) in enumerate(sorted(lines.items())):
        colour = heat_colour(i / max(1, len(lines) - 1))
        pts = " ".join(f"{40 + 480 * k / max(1, len(v) - 1):.1f},{200 - 160 * x:.1f}" for k, x in enumerate(v))
        parts += [f'<polyline points="{pts}" fill="none" stroke="{colour}" stroke-width="2"/>', _t(526, 40 + 14 * i, cut(name, 12), font_size="10")]
    return _svg(620, 220, [_t(0, 16, title, font_weight="bold"), *parts], title)


def curve(lines: Mapping[str, Sequence[tuple[float, float]]], title: str, n_clean: int | None = None, least: float = 1e-4) -> str | None:
    """Recall over the false-positive rate on a log axis; shaded where the clean pool cannot resolve the rate."""
    lines = {k: [p for p in sorted(v) if p[0] >= least] for k, v in lines.items()}
    lines = {k: v for k, v in lines.items() if v}
    if not lines:
        return None
    hi = max(p[0] for v in lines.values() for p in v)
    span = math.log10(hi) - math.log10(least) or 1.0
    at = lambda f: 40 + 480 * (math.log10(f) - math.log10(least)) / span
    parts = [_t(0, 16, title, font_weight="bold")]
    if n_clean and 5 / n_clean > least:
        parts.append(_r(40, 40, max(0.0, at(min(hi, 5 / n_clean)) - 40), 160, "#eeeeee"))
    for i, (name, v) in enumerate(sorted(lines.items())):
        colour = heat_colour(i / max(1, len(lines) - 1))
        pts = " ".join(f"{at(f):.1f},{200 - 160 * r:.1f}" for f, r in v)
        parts += [f'<polyline points="{pts}" fill="none" stroke="{colour}" stroke-width="2"/>', _t(526, 40 + 14 * i, cut(name, 12), font_size="10")]
    return _svg(620, 230, [*parts, _t(40, 218, percent(least, 2)), _t(500, 218, percent(hi, 2))], title)


def check(svg: str) -> None:
    ElementTree.fromstring(svg)


def save(svg: str | None, path: str | Path) -> Path | None:
    """Write a figure; nothing for an empty one."""
    if svg is None:
        return None
    check(svg)
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(svg, encoding="utf-8")
    return path
