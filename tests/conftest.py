import pytest

from tests.session import make_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def d1(spark):
    from affinis.sources import fixtures as fx

    return fx.stored(fx.part_ratings(spark, SF))


@pytest.fixture(scope="session")
def d3(spark):
    from affinis.sources import fixtures as fx

    return fx.stored(fx.event_ratings(spark, SF))


@pytest.fixture(scope="session")
def tags(spark):
    from affinis.sources import fixtures as fx

    return fx.stored(fx.item_tags(spark, SF))
