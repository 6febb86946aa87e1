import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import session

    spark = session(4, 4)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
