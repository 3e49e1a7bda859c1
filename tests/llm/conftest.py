import pytest


@pytest.fixture(scope="session")
def write_table(tmp_path_factory, spark):
    """Write rows as a table of a folder like the driver's and return the folder."""

    def write(name, rows, schema):
        folder = tmp_path_factory.mktemp("data")
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
