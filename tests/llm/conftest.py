from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from made import DOCUMENT, made_documents  # noqa: E402


@pytest.fixture(scope="session")
def rows() -> list[tuple[int, str | None]]:
    return made_documents()


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        langs = ["en", "de", None, "xx"]
        full = [(i, t, langs[(i or 0) % 4], f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENT).repartition(4)

    return make
