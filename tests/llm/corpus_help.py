import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """Documents with an extra column of a clashing name, over several partitions."""

    def make(rows, parts=3):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
        ddl = "doc_id long, text string, lang string, source string, n_chars long, fp string"
        return spark.createDataFrame(rows, ddl).repartition(parts)

    return make
