import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from souq.session import build_session
    s = build_session("local[4]", 4, app_name="souq-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="souq-test-ckpt-")})
    yield s
    s.stop()


def rows(df, *cols):
    """Collect ``cols`` (default: all) as a sorted list of tuples."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
