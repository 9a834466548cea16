import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from streamloom.session import session

    base = tmp_path_factory.mktemp("spark")
    s = session("local[4]", "tests", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{base}/shared", spark__sql__warehouse__dir=f"file://{base}/warehouse", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
