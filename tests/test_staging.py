"""Which derived tables a query stores before it reads them."""

from __future__ import annotations

import pytest

from kinforge.catalog import base


@pytest.mark.parametrize("inputs, stored", [(("fx_anc", "fx_edge", "fx_src", "fx_town"), ["fx_anc", "fx_edge"]), (("fx_anc", "fx_cand", "fx_src"), ["fx_anc", "fx_cand"]), (("fx_edge",), [])])
def test_slots_and_edges_are_stored_and_citations_are_not(spark, monkeypatch, inputs, stored):
    got = []
    monkeypatch.setattr(base, "staged", lambda s, d, n: got.append(n))
    monkeypatch.setattr(base, "table", lambda s, d, n: None)
    monkeypatch.setattr(base, "QUERIES", {})
    base.query("trial", *inputs)(lambda *tables: None)
    base.QUERIES["trial"](spark, "")
    assert got == stored
