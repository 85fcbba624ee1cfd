"""Small trace tables with known answers, written as headerless gzip CSV."""

from __future__ import annotations

import gzip
from pathlib import Path

ADD, REMOVE, UPDATE = 0, 1, 2


def micros(s: float) -> int:
    return round(s * 1_000_000)


def write_part(folder: Path, rows: list[list], part: int = 0) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"part-{part:05d}-of-00001.csv.gz"
    with gzip.open(path, "wt") as out:
        for row in rows:
            out.write(",".join("" if v is None else str(v) for v in row) + "\n")
    return str(folder)


def machine_rows() -> list[list]:
    events = [
        (0, 1, ADD, 0.5), (3600, 1, REMOVE, 0.5), (7200, 1, ADD, 0.5),
        (0, 2, ADD, 1), (3600, 2, REMOVE, None), (7200, 2, ADD, 1),
        (0, 3, ADD, 0.25), (3600, 3, REMOVE, 0.25), (5400, 3, UPDATE, 0.25), (7200, 3, ADD, 0.25),
        (0, 4, ADD, 0.5), (14400, 4, REMOVE, 0.5),
    ]
    return [[micros(t), m, e, "p", c, 0.5] for t, m, e, c in events]


def job_rows() -> list[list]:
    events = [
        (10, 1, 0), (11.8, 1, 1), (112, 1, 4),
        (11, 2, 0), (12.5, 2, 1), (20, 2, 2), (21, 2, 0), (25, 2, 1), (30, 2, 4),
        (3700, 3, 0), (3590, 4, 0), (3610, 4, 1),
    ]
    return [[micros(t), None, j, e, "u", 0, "name", "logical"] for t, j, e in events]


def task_rows() -> list[list]:
    events = [
        (0, 1, 0, None, 0, 0, 0.2, 0.1), (1, 1, 0, 1, 1, 0, 0.2, 0.1), (2, 1, 1, 2, 1, 0, 0.4, 0.2),
        (3, 2, 0, 1, 1, 1, 0.1, 0.3), (4, 2, 0, 1, 2, 1, 0.1, 0.3), (5, 3, 0, 3, 2, None, 0.5, None),
    ]
    return [
        [micros(t), None, j, i, m, e, "u", c, 0, cpu, mem, None, 0] for t, j, i, m, e, c, cpu, mem in events
    ]


def usage_rows() -> list[list]:
    samples = [
        (0, 1, 0, 1, 0.1, 0.05), (0, 2, 0, 1, 0.2, 0.1), (300, 1, 0, 1, 0.15, 0),
        (0, 1, 1, 2, 0.4, 0.2), (0, 3, 0, 3, None, 0.3),
    ]
    return [[micros(t), micros(t + 300), j, i, m, cpu, mem] for t, j, i, m, cpu, mem in samples]
