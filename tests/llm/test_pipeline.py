import corpus_pipeline
import pytest
from edge import documents, empty


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    got = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    assert got.columns == ["doc_id", "n_tokens", "token_ids"] and 0 < got.count() <= 2 * before


@pytest.fixture
def tables(spark, tmp_path):
    def write(docs):
        spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def through(spark, docs, sf):
    """The documents after each stage; all but the last have the columns of documents."""
    out, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{sf}/{k}")
        out.append(spark.read.parquet(f"{sf}/{k}"))
        assert k == 4 or out[-1].columns == columns
    return out


def test_edges(spark, tables):
    """Nulls, empty and long texts, repeated rows, clashing columns, odd letters."""
    words = lambda a: " ".join(f"{a}{i}" for i in range(60))
    extra = [(2**60 + 1, words("a"), "en", "a"), (None, words("b"), "en", None), (None, words("b"), "en", None), (31, words("c") + " mail a.b@c.org", None, "b"), (32, None, "en", "b")]
    docs = documents(spark, extra)
    out = through(spark, docs, tables(docs))
    quality, unique, clean, mixed, encoded = ([tuple(r) for r in x.collect()] for x in out[1:])
    ids = lambda rows: {r[0] for r in rows}
    assert {1, 2, 3, 31, 2**60 + 1, None} <= ids(quality) and not ids(quality) & {4, 5, 6, 7, 8, 32}  # no words, or too many repeats
    texts = [r[1] for r in unique]
    assert len(set(texts)) == len(texts) and texts.count(words("b")) == 1 and 2**60 + 1 in ids(unique)
    assert any(r[0] == 31 and r[1].endswith("mail [EMAIL]") for r in clean)
    assert ids(mixed) <= ids(clean) and ids(encoded) == ids(mixed) and all(r[1] == len(r[2]) for r in encoded)


def test_empty(spark, tables):
    docs = empty(spark)
    assert all(x.count() == 0 for x in through(spark, docs, tables(docs)))
