import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marquee import session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session.local(cores=4, memory="6g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from marquee.catalog import Inputs

    return Inputs(spark, SF_DIR)


@pytest.fixture(scope="session")
def make_ratings(spark):
    def make(rows):
        return spark.createDataFrame(
            rows, "userId int, movieId int, rating double, timestamp bigint"
        )

    return make


@pytest.fixture(scope="session")
def make_movies(spark):
    def make(rows):
        return spark.createDataFrame(rows, "movieId int, title string, genres string")

    return make
