import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reqlens.session import local_session
    session = local_session(
        "8", spark__sql__shuffle__partitions="4",
        spark__sql__streaming__stateStore__providerClass=(
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("ckpt")))
    yield session
    session.stop()
