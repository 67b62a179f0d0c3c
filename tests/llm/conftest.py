import pytest

from basketry.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app="basketry-llm-tests")
    yield s
    s.stop()
