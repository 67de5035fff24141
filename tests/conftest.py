import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from acreage.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, memory="8g", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def listing(spark):
    """Make a listing frame from short rows: (country, city, rooms, area, price)."""
    def make(rows):
        full = [(c, t, r, a, 0, 5.0, "Furnished", p) for c, t, r, a, p in rows]
        return spark.createDataFrame(full, "country string, city string, rooms double, area_sqm double, balcony int, "
                                           "building_age double, furnishing_status string, price_usd double")
    return make
