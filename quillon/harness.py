"""Timing: warm-up runs, measured runs, and reports of them."""

from __future__ import annotations

import csv
import json
import statistics
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass


@dataclass
class Measure:
    """Seconds. p95 is the largest of ten runs, as rank int(0.95 n) from 0."""

    name: str
    runs: int
    mean: float
    median: float
    p95: float
    rows: int | None = None
    timestamp: float = 0.0

    @property
    def rows_per_second(self) -> float | None:
        return self.rows / self.median if self.rows and self.median else None


def measure(run: Callable[[], object], name: str, warm_up: int = 5, runs: int = 10, rows: int | None = None) -> Measure:
    for _ in range(warm_up):
        run()
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    times.sort()
    return Measure(name, runs, statistics.fmean(times), statistics.median(times), times[min(len(times) - 1, int(len(times) * 0.95))], rows, time.time())


def compare_materialisation(df, id_col: str, column: str, threshold: float, warm_up: int = 1, runs: int = 3) -> list[Measure]:
    """Two plans for the rows whose column is above threshold: all columns are read and then filtered, or the ids are
    chosen from two columns and the rows fetched by them."""
    from .operators import LazyFilter, materialize

    def run(plan):
        return lambda: plan.write.format("noop").mode("overwrite").save()

    chosen = LazyFilter(df, df[column] > threshold).selection(id_col)
    return [measure(run(plan), name, warm_up, runs) for name, plan in (("full", df.filter(df[column] > threshold)), ("late", materialize(df, id_col, chosen, id_col)))]


def write_csv(results: list[Measure], path: str) -> None:
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, list(asdict(results[0])) if results else ["name"])
        w.writeheader()
        w.writerows(asdict(r) for r in results)


def write_json(results: list[Measure], path: str) -> None:
    with open(path, "w") as f:
        json.dump([asdict(r) for r in results], f, indent=1)


def append_json_line(result: Measure, path: str) -> None:
    """One line for each result as it comes."""
    with open(path, "a") as f:
        f.write(json.dumps(asdict(result)) + "\n")


def markdown(results: list[Measure]) -> str:
    lines = ["| query | runs | mean ms | median ms | p95 ms | rows/s |", "|-|-|-|-|-|-|"]
    for r in results:
        speed = f"{r.rows_per_second:,.0f}" if r.rows_per_second else "-"
        lines.append(f"| {r.name} | {r.runs} | {1e3 * r.mean:.1f} | {1e3 * r.median:.1f} | {1e3 * r.p95:.1f} | {speed} |")
    return "\n".join(lines)
