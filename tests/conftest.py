import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import models  # noqa: E402
from seqloom.session import build_session  # noqa: E402

# workers do not have the test folder on their path
cloudpickle.register_pickle_by_value(models)

SAMPLE = "ACGTACGTGGACGTACGT"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "seqloom-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Records from plain strings, numbered from 0."""

    def make(*seqs):
        return spark.createDataFrame(
            [(number, f">r{number}", seq) for number, seq in enumerate(seqs)],
            "record_id long, header string, seq string",
        )

    return make
