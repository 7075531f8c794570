"""Every query that has SQL is held against it on the smallest tables."""

import pytest

from strandwise.plans.catalogue import ORACLES, QUERIES
from tests.compare import assert_same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_entry_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_alignment_of_cut_and_changed_references(spark, tmp_path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    draw = random.Random(3)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    references = ["".join(draw.choice(letters) for _ in range(30)) for _ in range(4)] + ["ACDEFGHIKLMNPQRSTVWYACDEF", ""]
    texts = [None, "", "AC"]
    for k in range(40):
        text = list(draw.choice(references[:4]))
        for _ in range(k % 4):
            text[draw.randrange(30)] = draw.choice(letters)
        for _ in range(k % 5):
            del text[draw.randrange(len(text))]
        texts.append("".join(text))
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts, "source": ["s"] * len(texts)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": list(range(len(references))), "text": references}), tmp_path / "benchmark.parquet")
    got = QUERIES["raw_alignment"](spark, str(tmp_path))
    assert assert_same(got, ORACLES["raw_alignment"], str(tmp_path)) == 41
    assert {r.status for r in got.select("status").distinct().collect()} == {"invalid", "ambiguous", "direct", "mapped_unambiguously", "too_far"}
