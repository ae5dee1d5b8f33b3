import pytest


@pytest.fixture
def docs(spark):
    """Makes documents from texts: ids in order unless given as (id, text)."""

    def make(texts, **more):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make


@pytest.fixture(scope="session")
def tokenizers_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path
