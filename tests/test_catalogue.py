"""Every registered query of the library against its SQL, over whole small tables."""

import pytest
from oracle import compare, connect

from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.SQL:
        compare(df, connect(SF), catalogue.SQL[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["ensemble_mean_documents", "lexicon_replace_documents", "postprocess_documents"])
def test_whole_documents(spark, name):
    """Every document goes through, long ones whole."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalogue.QUERIES[name](spark, SF).collect()
    assert len(got) == len(docs) and {r.doc_id for r in got} == set(docs)
    if name != "ensemble_mean_documents":
        assert all(r.result.split()[-1].lower() == docs[r.doc_id].split()[-1].lower() for r in got if docs[r.doc_id].split())


def test_props_are_read(spark):
    props = {r.event_id: r.props for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    assert {r.event_id: f'{{"k": {r.k}}}' for r in catalogue.QUERIES["json_extract"](spark, SF).collect()} == props
