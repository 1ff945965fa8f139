import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quotemill.session import build_session, with_worker_path

    return with_worker_path(build_session("tests", cores=4, partitions=4))
