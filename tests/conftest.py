"""One local session for the whole test run."""

import pytest

from concourse.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", app="concourse-tests")
    yield session
    session.stop()
