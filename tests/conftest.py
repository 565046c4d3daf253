import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kinweave.session import build_session  # noqa: E402
from kinweave.sources.records import parse_lines  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def records(spark):
    def build(*docs):
        rows = [(i, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
        return parse_lines(spark.createDataFrame(rows, "doc_ord long, value string"))

    return build
