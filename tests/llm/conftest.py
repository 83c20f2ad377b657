import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\t", None, "a", "A b", "a b c", "A  b\tC", "Straße ñandú ÄÖÜ", "x " * 30_000, "a b c", "a b c"]


@pytest.fixture(scope="session")
def spark():
    from compare import session
    return session()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns whose names clash."""
    rows = [(None if i == 1 else i % 10, t, None if i == 2 else "en", None if i % 4 == 0 else "s", 1, 2, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, size int, label string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id > 100")
