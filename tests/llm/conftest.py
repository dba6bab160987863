from __future__ import annotations

import pytest

from weirflow.llm.tables import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)
