import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from coursewright.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", shuffle_partitions=4, **{"spark.driver.memory": "4g", "spark.default.parallelism": "4"})
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s


def rows(df, *cols):
    """The rows as a sorted list of tuples."""
    out = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in out.collect()), key=repr)
