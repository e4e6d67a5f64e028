import pytest
from odd_rows import CLASHING, ODD


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, *[i] * len(CLASHING)) for i, r in enumerate(ODD)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.where("false")
