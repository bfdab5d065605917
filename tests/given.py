"""Where the given tables are."""

from pathlib import Path

TESTDATA = Path("/root/testdata")
