import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from compare import make_spark

    session = make_spark()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("supplied tables not present")
    return folder
