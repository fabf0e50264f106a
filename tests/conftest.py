import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Make every group of more than seven rows take the split form."""
    spark.conf.set("spark.tidemark.maxGroupRows", "7")
    yield
    spark.conf.unset("spark.tidemark.maxGroupRows")
