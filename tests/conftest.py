import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from rookery.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "4g")


def rows(df, *columns):
    """Collected rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
