import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusloom.session import local_session

    return local_session(4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture
def scratch(spark):
    from corpusloom.scratch import Scratch

    return Scratch(spark, "test")
