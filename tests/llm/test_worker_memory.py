"""What workers keep between tasks goes when later steps do not need it."""

import sys
from types import SimpleNamespace

import pyarrow as pa

from churnloom.llm import common, packing


def test_steps_after_the_tokenizer_let_it_go(monkeypatch):
    monkeypatch.setitem(sys.modules, "kept_by_worker", SimpleNamespace(values={}))
    common.kept("other", 1, lambda key: "stays")
    for step in (lambda: list(packing._running([pa.record_batch({"doc_tokens": [3, 4]})])), packing._cut({}, 0, 4096)):
        common.kept("pre-tokenizer", "spec", lambda key: "tokenizer")
        step()
        assert set(sys.modules["kept_by_worker"].values) == {"other"}
    common.dropped("pre-tokenizer")
    monkeypatch.delitem(sys.modules, "kept_by_worker")
    common.dropped("pre-tokenizer")
