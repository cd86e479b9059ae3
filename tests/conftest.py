import pytest

from reefline.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=8, memory="8g")


@pytest.fixture
def column(spark):
    """Evaluate `make(*columns)` over rows of text values, in order."""
    def run(make, rows):
        from pyspark.sql import functions as F
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        width = len(rows[0])
        schema = "n int, " + ", ".join(f"c{i} string" for i in range(width))
        df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], schema)
        out = df.select("n", make(*[F.col(f"c{i}") for i in range(width)]).alias("v"))
        return [r["v"] for r in sorted(out.collect(), key=lambda r: r["n"])]
    return run
