import pytest

from tessella.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(2, "2g")
