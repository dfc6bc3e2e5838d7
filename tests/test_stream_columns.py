"""Requests of one batch are summed as columns."""

import datetime as dt

import pandas as pd
from plumbline.streaming import requests


class _State(dict):
    def exists(self):
        return bool(self)

    def updateValue(self, key, value):
        self[key] = value


def test_requests_of_one_batch_are_summed_as_columns(monkeypatch):
    made = []
    monkeypatch.setattr(requests._Request, "add", lambda self, r: made.append(r))
    names = ("request_id", *requests._RESULT)
    share = requests.Requests(1000, True, "bigint", names)
    share.open = _State()
    at = int(dt.datetime(2024, 1, 1).timestamp()) * 1_000_000
    kinds = [("dispatch", None), ("chunk", ""), ("chunk", "b"), ("chunk", "a"), ("usage", None)]
    rows = [
        (i, True, at + n, n if n < 3 else 2, kind, content, i if kind == "usage" else 0, 7 if kind == "usage" else 0)
        for n, (kind, content) in enumerate(kinds) for i in range(2**60, 2**60 + 1000)
    ]
    frame = pd.DataFrame(rows, columns=["request_id", "named", "at", "seq", "kind", "content", "prompt_tokens", "completion_tokens"])
    got = pd.concat(share.handleInputRows((1,), iter([frame[:3000], frame[3000:]]), None))
    assert not made and got["request_id"].tolist() == list(range(2**60, 2**60 + 1000))
    assert got["prompt_tokens"].tolist() == got["request_id"].tolist()
    assert set(got["text"]) == {"ab"} and set(got["outcome"]) == {"done"} and set(got["num_chunks"]) == {5}
    assert set(got["first"] - got["sent"]) == {2} and set(got["last"] - got["sent"]) == {4}
