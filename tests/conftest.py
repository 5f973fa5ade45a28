import pytest

from quillmesh.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, spark__driver__memory="3g", spark__local__dir="/tmp/quillmesh-test-local")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted plain tuples of the given columns."""

    def plain(v):
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    def take(df, *columns):
        return sorted((tuple(plain(v) for v in r) for r in df.select(*columns or df.columns).collect()), key=repr)

    return take
