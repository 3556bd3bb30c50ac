import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import awkward  # noqa: E402


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    labels = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, None, None), (7, 0, 1), (8, 1, 0), (99, 1, 1), (None, 1, 1), (11, 0, 0), (11, 1, 1)]
    return awkward.write(tmp_path_factory.mktemp("edge"), awkward.DOCS, awkward.PAGES, awkward.VECTORS, labels)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return awkward.write(tmp_path_factory.mktemp("empty"), [], [], [], [])
