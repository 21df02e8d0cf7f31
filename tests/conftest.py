import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from workload_audit.session import checkpoint_dir, local_session

    s = local_session("*", shuffle_partitions=8, app="workload-audit-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def tables_small(spark):
    from workload_audit.sources.fixtures import fixture_tables

    return fixture_tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def cfg():
    from workload_audit.config import fixture_config

    return fixture_config()
