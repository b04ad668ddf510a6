import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sonde import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        # Inputs are tiny: interpreting plans is quicker than compiling them.  The oracle tests compile.
        "tests", "local[8]", spark__sql__shuffle__partitions="2", spark__sql__codegen__wholeStage="false", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    yield session
    session.stop()
