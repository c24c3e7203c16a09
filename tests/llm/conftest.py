import pytest
from corpora import ODD, corpus, frame


@pytest.fixture(scope="session")
def rows():
    return corpus() + ODD


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
