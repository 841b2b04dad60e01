"""Where the given tables lie."""

import os
from pathlib import Path

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
