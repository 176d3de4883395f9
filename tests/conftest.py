import pytest

from kinset.plans.limits import LIMITS
from kinset.plans.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "kinset-tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def tight(monkeypatch):
    """Limits so low that small inputs take the ways for large ones."""
    monkeypatch.setattr(LIMITS, "bucket_rows", 10)
    monkeypatch.setattr(LIMITS, "pairs_per_row", 2)
    return LIMITS


@pytest.fixture
def skewed(monkeypatch):
    """Joins split off hot keys even on small inputs."""
    monkeypatch.setattr(LIMITS, "plain_join_rows", 5)
    monkeypatch.setattr(LIMITS, "hot_share", 10)
    return LIMITS
