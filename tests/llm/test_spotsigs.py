"""Signatures of texts that hold no anchor."""

import pyarrow as pa

from lodestone.llm.spotsigs import fingerprint_edits, likeness, spot_components, spot_sets

CELLS = [f"cell{i}" for i in range(90)]
TABLE, OTHER = " | ".join(CELLS), " | ".join([*CELLS[:44], "changed", *CELLS[45:]])


def test_texts_without_anchors(documents):
    a, b, short, same = spot_sets(pa.array([TABLE, OTHER, "two words", "| ".join(CELLS)]))
    assert len(a) == len(b) == 88 and likeness(a, b) == 85 / 91 and len(short) == 1
    assert list(a) == list(same)
    rows = fingerprint_edits(documents([(1, TABLE), (2, OTHER)])).collect()
    assert all(r["near_next"] > 0.9 and 0.2 < r["near_edited"] <= 1 for r in rows)
    got = {r["doc_id"]: r["component_id"] for r in spot_components(documents([(1, TABLE), (2, OTHER), (3, "something else entirely")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
