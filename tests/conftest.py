import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from places import SF  # noqa: E402

from sleevenotes.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, partitions=4, shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def imported(spark, tmp_path_factory):
    """The catalogue of the smallest test tables, imported once."""
    from sleevenotes.sources.catalog import import_catalog, load_catalog
    from sleevenotes.sources.driver_tables import DriverCatalog

    path = str(tmp_path_factory.mktemp("catalog"))
    import_catalog(DriverCatalog(spark, SF), path)
    return load_catalog(spark, path)
