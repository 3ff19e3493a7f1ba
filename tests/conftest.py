from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeloom.session import get_session, scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lakeloom-test-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def no_views_left():
    """Temp views of one test are not seen by the next: catalogs list them with
    every database's tables."""
    yield
    s = SparkSession.getActiveSession()
    for t in s.catalog.listTables() if s else []:
        if t.isTemporary:
            s.catalog.dropTempView(t.name)


@pytest.fixture
def work(spark, request):
    """A fresh folder under the shared folder for one test."""
    return scratch(spark, request.node.name.replace("[", "_").replace("]", ""))


def write_file(folder: str, name: str, text: str) -> str:
    path = os.path.join(folder.replace("file:", ""), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path
