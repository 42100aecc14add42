import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from scanlens.session import checkpoint_dir, local_session

    s = local_session(4, shuffle_partitions=4)
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp_root(tmp_path):
    return tmp_path


@pytest.fixture(scope="session")
def text_engine():
    """A stand-in for a recognition engine: the bytes are UTF-8 text; empty input counts as damaged."""
    def make(options):
        def engine(b: bytes) -> str:
            if not b:
                raise ValueError("damaged image")
            return b.decode("utf-8")
        return engine

    return make
