import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    session = build_session(
        "tidemark-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.log.level": "ERROR"},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Builds a files table from a dict path -> content (or (project, path) -> content)."""

    def build(contents: dict):
        rows = [(k[0], k[1], v) if isinstance(k, tuple) else ("p", k, v) for k, v in contents.items()]
        return spark.createDataFrame(rows, "project string, path string, content string")

    return build
