import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from codefacts.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=2)
    # Hundreds of tiny plans: compiling each would take longer than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def text_lines(spark):
    """Line rows from a text, cut into blocks of a few lines to cross block borders."""

    def make(text: str, file: str = "f", per_block: int = 3):
        rows = [(file, n // per_block, n, line) for n, line in enumerate(text.split("\n"))]
        return spark.createDataFrame(rows, "file string, block long, pos long, line string")

    return make


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
