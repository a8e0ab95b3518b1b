"""The memory of units is two numbers per unit and forgets without changing ids."""

import numpy as np

from tallyframe.llm import packing as P


def batch(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])


def test_remembered_units_are_arrays_and_give_the_same_ids(monkeypatch):
    texts = [" ".join(f"{w}{k * 37 % 4001}" for w in ("alpha", "Beta", "x,")) for k in range(5000)] + ["", "alpha0 é", "!"]
    own = P.UnitIds(P.tokenizer_path(P.TOKENIZER))
    ids, counts = own.rows(*batch(texts))
    assert own.keys.nbytes + own.places.nbytes == 16 * len(own.keys) and (np.diff(own.keys.astype(object)) > 0).all()
    again, more = own.rows(*batch(texts[::-1])), own.rows(*batch(texts))
    assert (more[0] == ids).all() and (again[1][::-1] == counts).all()
    monkeypatch.setattr(P, "REMEMBERED", 5000)
    small = P.UnitIds(P.tokenizer_path(P.TOKENIZER))
    parts = [small.rows(*batch(texts[k : k + 700])) for k in range(0, len(texts), 700)]
    assert (np.concatenate([p[0] for p in parts]) == ids).all() and (np.concatenate([p[1] for p in parts]) == counts).all()
    assert len(small.keys) <= 5000
