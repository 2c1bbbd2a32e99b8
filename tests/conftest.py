import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from waferlake.session import local_session

    session = local_session(8, 2)
    # tiny inputs: compiling the stages would take longer than running them
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF
