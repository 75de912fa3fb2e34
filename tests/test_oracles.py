"""Every query of the engine against its oracle SQL, by values."""

from __future__ import annotations

import math

import pytest

from siltstone.catalogue import ORACLES, QUERIES


def canonical(rows):
    def one(v):
        return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert canonical(tuple(r) for r in df.select(*columns).collect()) == canonical(tuple(r[k] for k in at) for r in found.fetchall())


def test_every_query_has_an_oracle():
    """But for merging by a vocabulary, which SQL cannot express; tests/test_pieces.py holds it against a plain merge."""
    assert set(QUERIES) - set(ORACLES) == {"exact_document_tokens"} and set(ORACLES) <= set(QUERIES)
