from __future__ import annotations

import pytest

from emberline.llm import queries
from tests.helpers import same_rows

COLUMNS = {
    "p1_found": ["tile_id", "det_no", "canonical_class"], "p2_found": ["subject_kind", "subject_id", "verdict"], "p4_found": ["tile_id", "det_no", "cut_field"],
    "p5_found": ["item_a", "item_b"], "p6_found": ["doc_id"], "p7_found": ["mix_name", "source"], "p8_found": ["doc_id", "reading_band"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark, sf, duck):
    same_rows(queries.queries()[name](spark, sf), duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns(name, spark, sf):
    df = queries.queries()[name](spark, sf)
    assert df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count()
