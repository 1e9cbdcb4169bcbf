import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafgrid.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    s = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": folder,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Element rows from (doc_id, seq, page, category, markdown, html) tuples."""

    def build(rows):
        full = [(d, s, p, c, m, None, h) for d, s, p, c, m, h in rows]
        schema = "doc_id long, seq int, page int, category string, markdown string, text string, html string"
        return spark.createDataFrame(full, schema)

    return build
