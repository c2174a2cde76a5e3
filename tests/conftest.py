from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from newsgraph.session import session

    return session("4", 4, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "500"})


@pytest.fixture(scope="session")
def sf():
    return SF
