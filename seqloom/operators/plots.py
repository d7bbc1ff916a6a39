"""Plots as SVG text, of results that are aggregates or stated points; a table of any size goes in by its bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.aggregate import covariances

_W, _H = 480, 320


def _svg(marks: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{_W}" height="{_H}">' + "".join(marks) + "</svg>"


def scatter(df: DataFrame, x: str, y: str, cells: int = 64) -> str:
    """A mark for each cell of a grid that holds rows, the darker the more; at most cells * cells come to the driver."""
    r = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if r[0] is None or r[2] is None:
        return _svg([])
    at = lambda c, low, high: F.least(F.lit(cells - 1), F.floor((F.col(c) - float(low)) * cells / max(float(high) - float(low), 1e-300))).cast("int")
    found = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(at(x, r[0], r[1]).alias("i"), at(y, r[2], r[3]).alias("j")).count().collect()
    most = max(n for *_, n in found)
    w, h = _W / cells, _H / cells
    return _svg([f'<rect x="{i * w:.1f}" y="{_H - (j + 1) * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill-opacity="{0.2 + 0.8 * n / most:.2f}"/>' for i, j, n in sorted(found)])


def bars(rows: list[tuple[str, float]]) -> str:
    """Labelled bars of aggregates."""
    top = max((abs(v) for _, v in rows), default=0) or 1.0
    w = _W / max(1, len(rows))
    return _svg([f'<rect x="{i * w:.1f}" y="{_H - 20 - abs(v) / top * (_H - 20):.1f}" width="{w * 0.8:.1f}" height="{abs(v) / top * (_H - 20):.1f}"/><text x="{i * w:.1f}" y="{_H - 5}">{k}</text>' for i, (k, v) in enumerate(rows)])


def correlations(df: DataFrame, columns: list[str]) -> str:
    """A square for each pair of columns, as dark as their correlation is strong."""
    cov = {(r[0], r[1]): r[2] for r in covariances(df, columns, 12).collect()}
    value = lambda a, b: cov.get((a, b), cov.get((b, a), 0.0))
    w, marks = min(_W, _H) / max(1, len(columns)), []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            scale = (value(a, a) * value(b, b)) ** 0.5
            marks.append(f'<rect x="{i * w:.1f}" y="{j * w:.1f}" width="{w:.1f}" height="{w:.1f}" fill-opacity="{abs(value(a, b)) / scale if scale else 0:.2f}"/>')
    return _svg(marks)
