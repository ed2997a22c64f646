import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from meterlens.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def trained(spark, sf):
    """A training run on the event readings, with a small forest."""
    from meterlens.catalog.views import readings
    from meterlens.config import AnomalyParams, JobParams
    from meterlens.plans.train import train

    params = JobParams(anomaly=AnomalyParams(n_estimators=40))
    return params, train(readings(spark, sf, "readings_e"), params)
