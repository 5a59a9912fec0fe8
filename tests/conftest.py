import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture
def rows():
    """Rows of a frame as sorted dicts of the named columns."""

    def read(df, *columns):
        out = [tuple(r) for r in df.select(*columns).collect()]
        return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))

    return read
