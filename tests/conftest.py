import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tickloom import session

    s = session.build("local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    yield s
    s.stop()
