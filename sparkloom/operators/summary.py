"""Text tables for model summaries."""

from __future__ import annotations

from collections.abc import Sequence


def number(x: float | int | None) -> str:
    """Thousands apart; exponents outside 0.001 to 1000."""
    if x is None:
        return ""
    if isinstance(x, int):
        return f"{x:,}"
    if x != x or x in (float("inf"), float("-inf")):
        return str(x)
    return f"{x:.4f}" if x == 0 or 0.001 <= abs(x) < 1000 else f"{x:.4e}"


class SummaryTable:
    """A title, pairs in two columns, a table of coefficients, and warnings below."""

    def __init__(self, title: str):
        self.title = title
        self.pairs: list[tuple[str, str]] = []
        self.groups: list[tuple[str, list[str], list[list[str]]]] = []
        self.warnings: list[str] = []

    def add(self, label: str, value: float | int | str | None) -> SummaryTable:
        self.pairs.append((label, value if isinstance(value, str) else number(value)))
        return self

    def group(self, name: str, header: Sequence[str], rows: Sequence[Sequence[float | int | str]]) -> SummaryTable:
        self.groups.append((name, list(header), [[c if isinstance(c, str) else number(c) for c in r] for r in rows]))
        return self

    def warn(self, text: str) -> SummaryTable:
        self.warnings.append(text)
        return self

    def __str__(self) -> str:
        blocks = []
        half = -(-len(self.pairs) // 2)
        cells = [f"{a}: {b}" for a, b in self.pairs]
        wide = max(map(len, cells[:half]), default=0)
        blocks.append("\n".join(f"{cells[i]:<{wide}}    {cells[half + i] if half + i < len(cells) else ''}".rstrip() for i in range(half)))
        for name, header, rows in self.groups:
            widths = [max(len(str(r[i])) for r in [header, *rows]) for i in range(len(header))]
            line = lambda r, w=widths: "  ".join(f"{c:<{n}}" if i == 0 else f"{c:>{n}}" for i, (c, n) in enumerate(zip(r, w, strict=True)))
            blocks.append("\n".join([*([name] if name else []), line(header), "-" * len(line(header)), *map(line, rows)]))
        width = max((len(x) for b in [self.title, *blocks] for x in b.split("\n")), default=0)
        rule = "=" * width
        return "\n".join([rule, self.title.center(width).rstrip(), rule, *(f"{b}\n{rule}" for b in blocks if b), *(f"Warning: {w}" for w in self.warnings)])
