import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from billwright.session import local_session  # noqa: E402

# Started before collection: test modules build columns at import.
_SESSION = local_session("8")
_SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield _SESSION
    _SESSION.stop()
