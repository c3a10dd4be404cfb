"""Windows of the secret scan, taken from one array of codes."""

from __future__ import annotations

import numpy as np

from tidemark.llm import secret_scan


def test_windows_stop_at_the_edges_of_their_document():
    texts = [b"short one", b"", b"a longer text with Some_Token-42 " * 3, b"x" * 90]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    scan = secret_scan.Scan(np.frombuffer(b"".join(texts), dtype=np.uint8), edges)
    at = np.arange(len(scan.row))
    assert len(at)
    for k, window in enumerate(scan.windows(at)):
        own, look = texts[scan.row[k]], int(scan.look[k] - edges[scan.row[k]])
        places = range(look - secret_scan.BEFORE, look + secret_scan.AFTER)
        assert window.tolist() == [int(secret_scan._LOOKS[own[p]]) if 0 <= p < len(own) else 0 for p in places]
