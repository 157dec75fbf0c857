"""Text and LaTeX of short result tables (driver-side, after aggregation)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame


def half_up(x: float | None, places: int) -> str:
    return "--" if x is None else str(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def stars(p: float | None) -> str:
    return "" if p is None else "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.10 else ""


def escape(text: str) -> str:
    return "".join({"_": r"\_", "&": r"\&", "%": r"\%", "#": r"\#"}.get(c, c) for c in text)


def latex(df: DataFrame, columns: dict[str, int | None], caption: str = "", most: int = 1000) -> str:
    """A tabular in the order of df; columns maps a name to its decimal places (None: as it is). A table of more than
    `most` rows is an error, not cut."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: aggregate first, or raise `most`")
    body = [" & ".join(escape(str(v)) if d is None else half_up(v, d) for v, d in zip(r, columns.values(), strict=True)) + r" \\" for r in rows]
    head = " & ".join(map(escape, columns)) + r" \\"
    lines = [r"\begin{table}", r"\centering"] + [rf"\caption{{{escape(caption)}}}"] * bool(caption) + [rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"]
    return "\n".join(lines)


def panels(df: DataFrame, columns: dict[str, int | None], parts: dict[str, DataFrame | Column], caption: str = "", most: int = 1000) -> str:
    """One table of several panels, each a heading and its rows: `parts` maps a panel's title to its rows (a table, or a
    condition on df)."""
    width, lines = len(columns), []
    for letter, (title, part) in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", parts.items(), strict=False):
        rows = latex(df.filter(part) if isinstance(part, Column) else part, columns, "", most).split("\n")
        start = [k for k, line in enumerate(rows) if line == r"\hline"]
        lines += [rf"\multicolumn{{{width}}}{{l}}{{Panel {letter}: {escape(title)}}} \\", *rows[start[1] + 1 : start[2]], r"\hline"]
    head = " & ".join(map(escape, columns)) + r" \\"
    top = [r"\begin{table}", r"\centering"] + [rf"\caption{{{escape(caption)}}}"] * bool(caption)
    return "\n".join([*top, rf"\begin{{tabular}}{{{'l' * width}}}", r"\hline", head, r"\hline", *lines, r"\end{tabular}", r"\end{table}"])


def to_dict(df: DataFrame, keys: tuple[str, ...] = ("model", "asset"), most: int = 100_000) -> dict:
    """A short table as {key: {column: value}}, keys as tuples where there are several; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    name = lambda r: r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)
    return {name(r): {c: v for c, v in r.asDict(recursive=True).items() if c not in keys} for r in rows}


def summary(row) -> str:
    """One audited pair in words."""
    return (
        f"{row.model} on {row.asset}: {row.regime} (ratio {row.ratio:.3f}); violations {row.pi_raw:.4f} -> {row.pi_corr:.4f} over {row.n_test} days; "
        f"Kupiec p {row.kupiec_p_raw:.4f} -> {row.kupiec_p_corr:.4f}; zone {row.zone_raw} -> {row.zone_corr}; score {row.qs_raw:.6f} -> {row.qs_corr:.6f}"
    )


def comparison(master: DataFrame) -> str:
    """Models by replacement ratio, signal-preserving ones first."""
    return latex(master.orderBy("ratio", "model", "asset"), {"model": None, "asset": None, "ratio": 3, "pi_corr": 4, "kupiec_p_corr": 4, "zone_corr": None}, "Audited forecasts")
