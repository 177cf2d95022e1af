import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelkit.session import build_session
    s = build_session(4, shuffle_partitions=8, app="panelkit-tests")
    yield s
    s.stop()


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
