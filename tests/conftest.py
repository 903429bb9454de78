import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from caselens.session import local_session  # noqa: E402
from caselens.shipping import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4)
    ship(session)
    yield session
    session.stop()
