from __future__ import annotations

import os
import uuid

import pytest

from lakeweave import sinks
from lakeweave.session import CHECKPOINT_DIR, local_session
from lakeweave.sources import CatalogBinding

TESTDATA = os.environ.get("LAKEWEAVE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = local_session(
        4,
        "tests",
        {CHECKPOINT_DIR: str(base / "shared"), "spark.sql.warehouse.dir": str(base / "warehouse")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


def new_binding(spark, tmp_path, name):
    binding = CatalogBinding(name, f"t_{uuid.uuid4().hex[:10]}_{name}", str(tmp_path / name))
    sinks.ensure_namespace(spark, binding)
    return binding


@pytest.fixture
def operational(spark, tmp_path):
    return new_binding(spark, tmp_path, "operational")


@pytest.fixture
def analytical(spark, tmp_path):
    return new_binding(spark, tmp_path, "analytical")


def rows(df, *sort):
    """All rows as tuples, sorted."""
    return sorted((tuple(row) for row in df.collect()), key=lambda row: tuple((v is not None, str(v)) for v in row))
