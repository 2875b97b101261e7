import pytest

import __spark_entry__ as entry
import check_oracle

NAMES = [n for n in entry.oracle_sql() if n.startswith("op")]


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, folder, name):
    ok, text = check_oracle.compare(spark, check_oracle.duck(folder), name, folder)
    assert ok, text


def test_columns(spark, folder):
    want = {
        "op4": {"doc_id", "held_out", "lang_pred", "score"},
        "op6": {"doc_id", "held_out", "score", "predicted"},
        "op7": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op9": {"page_id", "url", "text", "n_chars"},
    }
    for name, query in entry.queries().items():
        columns = want.get(name.split("_")[0])
        if columns:
            assert columns <= set(query(spark, folder).columns), name
