"""The secret scan's network works on few windows at a time, hex runs are sought where a few bytes allow them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from tidemark.llm import secret_scan


def test_a_step_holds_few_windows_and_adds_up_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    windows = rng.choice(secret_scan._CODES, (700, secret_scan.WIDTH)).astype(np.uint8)
    labels, weights = (rng.random(700) < 0.3).astype(float), rng.random(700) / 700
    sizes, plain = [], secret_scan.Network._forward
    monkeypatch.setattr(secret_scan.Network, "_forward", lambda self, w: sizes.append(len(w)) or plain(self, w))

    def stepped():
        network = secret_scan.Network()
        state = secret_scan.Descent(network, 0.01)
        for _ in range(3):
            state.step(windows, labels, weights)
        return network.values()

    parts = stepped()
    assert max(sizes) <= 128 and sum(sizes) == 3 * 700
    monkeypatch.setattr(secret_scan, "STEPPED", 700)
    assert (parts == stepped()).all()


def test_looks_by_place_equal_the_convolution():
    texts = pa.array(["short", None, "a longer text with Some_Token-42 and password=abcd1234EFGH " * 9, "x" * 90, "é" * 50 + " anotherword"])
    network = secret_scan.Network()
    for _, _, scan in secret_scan._scans(pa.RecordBatch.from_arrays([pa.array(range(5)), texts], ["doc_id", "text"])):
        windows = scan.windows(np.arange(len(scan.place)))
        hidden = np.arange(len(windows)) % 3 == 1
        shown = windows.copy()
        shown[hidden, : secret_scan.BEFORE] = 0
        assert np.allclose(network.look(scan.codes, scan.place, hidden), network._forward(shown)[-1], atol=1e-5)
        assert (network.margins(scan.codes, scan.place) == network.margin(windows)).all()


def test_hex_runs_equal_those_of_a_plain_search():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("0123456789abcdef"), n)) + "g" * (n % 3) for n in range(20, 60)]
    texts += ["z" * k + "a" * 32 + "z" for k in range(40)] + ["", "f" * 5_000, "a" * 31 + " " + "b" * 31, "ab" * 40 + "G" + "9" * 33]
    body = "".join(texts).encode()
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    scan = secret_scan.Scan(np.frombuffer(body, np.uint8), edges)
    for row, text in enumerate(texts):
        assert [s[:2] for s in scan.spans.get(row, []) if s[2] == 2] == [m.span() for m in re.finditer("[0-9a-f]{32,}", text)]
