"""Every query of the engine gives what its SQL gives."""

import pandas as pd
import pytest

from folioq import catalog
from oracle import both, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_but_one_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"ocr_lines"} and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    mine, theirs = both(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, sf_dir, con)
    assert mine == theirs


def test_text_vectors_round_ties_as_sql(spark, tmp_path):
    """Shares that end in a half at the seventh decimal, also where the product with a million is not exact, and a capital
    that lower() makes two characters of."""
    texts = ["z" * k + "x" * (n - k) for k, n in ((1, 128), (5, 128), (9, 128), (41, 640), (323, 640), (82, 1280))] + ["\u0130" + "z" * 9 + "x" * 118]
    rows = pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "role": "user", "text": texts})
    rows.to_parquet(tmp_path / "conversations.parquet")
    mine, theirs = both(catalog.QUERIES["text_vectors"], catalog.ORACLE_SQL["text_vectors"], spark, str(tmp_path), connect(str(tmp_path)))
    assert mine == theirs and len(mine) == len(texts)
