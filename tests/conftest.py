import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortry.session import release, session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
                                        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()


@pytest.fixture(scope="session")
def line(spark):
    from cohortry import cohorts
    from cohortry.session import stage
    return stage(cohorts.line_cohort(spark, SMALL), "test")


@pytest.fixture(scope="session")
def docs(spark):
    from cohortry import cohorts
    from cohortry.session import stage
    return stage(cohorts.doc_cohort(spark, SMALL), "test")
