import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import checkpoint_root, get_session
    s = get_session("local[4]", shuffle_partitions=4)
    checkpoint_root(s)  # tests set their own shared folder (unset in local mode)
    yield s
    s.stop()


@pytest.fixture
def many_ranges(spark):
    """Shuffles of sixteen partitions, small ones too, so that ranges are cut on small tables."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in old.items():
        spark.conf.set(k, v)


SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
