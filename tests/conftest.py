import pytest

from foliant.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "foliant-tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__sql__adaptive__coalescePartitions__enabled="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
