import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scan_all(spark):
    """Scan a list of texts; one list of finding rows per text."""
    from leakscan.operators import detect

    def run(texts, policy=None, scan=detect.scan, **options):
        rows = [(i, *t) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        schema = "doc_id int, text string" + (", hostname string" if isinstance(texts[0], tuple) else "")
        df = spark.createDataFrame(rows, schema)
        if isinstance(texts[0], tuple):
            options.setdefault("host_col", "hostname")
        scanned = scan(df, policy, **options)
        return [r["findings"] for r in scanned.orderBy("doc_id").select("findings").collect()]

    return run
