from __future__ import annotations

import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=""):
        """rows: (doc_id, text, source, lang)."""
        return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string" + extra)

    return make
