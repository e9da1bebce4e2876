"""Reports that a person reads, made on the driver from tables of counts and bounded lists of findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _title(text: str) -> list[str]:
    return [text, "-" * len(text)]


def _counts(df: DataFrame) -> list[str]:
    """A line a row of a small table, the last column as the number."""
    rows = [tuple(r) for r in df.collect()]
    width = max((len(" / ".join(map(str, r[:-1]))) for r in rows), default=0)
    return [f"  {' / '.join(map(str, r[:-1])):<{width}}  {r[-1]}" for r in rows] or ["  none"]


def listed(df: DataFrame, column: str, most: int, order: Iterable[str] = ()) -> list[str]:
    """The first `most` values of a column and how many more there are; no more than `most` rows come to the driver."""
    n = df.count()
    shown = [f"  * {r[0]}" for r in df.orderBy(*order or [column]).select(column).limit(most).collect()]
    return [*shown, f"  and {n - most} more"] if n > most else shown or ["  none"]


def split_audit_report(checks: DataFrame) -> str:
    """checks (check, n) of a split audit; the verdict is clean if all are 0."""
    rows = checks.collect()
    return "\n".join([*_title("Split audit"), *_counts(checks), "", "clean" if not any(r.n for r in rows) else "problems found"]) + "\n"


def staged_source_report(name: str, counts: DataFrame, blocking: DataFrame, notes: DataFrame, most: int = 60) -> str:
    """A staged source: what it holds, what blocks it and what is worth knowing; blocking and notes have `finding`."""
    blocked = blocking.count()
    return "\n".join([*_title(f"Staged source {name}"), *_counts(counts), "", f"Blocking: {blocked}", *listed(blocking, "finding", most), "", "Notes", *listed(notes, "finding", most), "", "blocked" if blocked else "consistent; the decision is a person's"]) + "\n"


def manifest_report(path: str, groups: dict[str, DataFrame], blocking: DataFrame, most: int = 60) -> str:
    """A candidate manifest: counts by each of `groups` and the first blocking findings."""
    lines = _title(f"Candidate manifest {path}")
    for name, counts in groups.items():
        lines += [name, *_counts(counts)]
    n = blocking.count()
    return "\n".join([*lines, "", f"Blocking: {n}", *listed(blocking, "finding", most), "", "blocked" if n else "consistent"]) + "\n"


def leakage_report(counts: DataFrame, spans: dict[str, DataFrame]) -> str:
    """Leaks between splits: counts by split, and how many keys of each kind span splits."""
    found = {name: df.count() for name, df in spans.items()}
    return "\n".join([*_title("Leakage"), *_counts(counts), *(f"  {name}: {n}" for name, n in found.items()), "", "leaking" if any(found.values()) else "clean"]) + "\n"


def evaluation_report(name: str, metrics: DataFrame) -> str:
    """metrics (population, metric, value, low, high, total): values with their 95 % interval where there is one; populations are never merged."""
    lines, last = _title(f"Evaluation {name}"), None
    for r in metrics.orderBy("population", "metric").collect():
        if r.population != last:
            lines += ["", str(r.population)]
            last = r.population
        shown = "n/a" if r.value is None else f"{r.value:.4f}"
        lines.append(f"  {r.metric:<28} {shown}" + (f"  ({r.low:.3f} to {r.high:.3f}, n = {r.total})" if r.low is not None else ""))
    return "\n".join(lines) + "\n"


def external_audit_report(root: str, counts: DataFrame, problems: dict[str, DataFrame], most: int = 25) -> str:
    """A directory audit: counts, and of each kind of problem (`finding`) the first."""
    lines = [*_title(f"Audit of {root}"), *_counts(counts)]
    for name, df in problems.items():
        lines += ["", name, *listed(df, "finding", most)]
    return "\n".join(lines) + "\n"


def shape_statistics_report(items: DataFrame) -> str:
    """Review items: how many have each flag, and the upper median of their aspects."""
    from ..operators.aggregates import upper_median
    from ..operators.review import flag_counts

    aspects = items.filter("aspect is not null").withColumn("k", F.lit(1))
    middle = upper_median(aspects, "aspect", ["k"]).collect()
    return "\n".join([*_title("Shape statistics"), f"  images: {items.count()}", *_counts(flag_counts(items).orderBy(F.col("n").desc(), "flag")), f"  median aspect: {middle[0].value:.2f}" if middle else "  median aspect: none"]) + "\n"
