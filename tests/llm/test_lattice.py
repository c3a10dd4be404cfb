"""Best paths and frequent units in arrays give what plain loops give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm import pieces
from tidemark.llm.queries import PIECES


def test_frequent_units_from_a_table_in_parts():
    model = pieces.Model(PIECES)
    units = [f"▁unit{k}" for k in range(50)] + ["é"]
    ids = [[k, k + 1, k + 2][: 1 + k % 3] for k in range(50)] + [[-1]]
    units[7], ids[7] = "▁unité", [next(i for p, i, _ in model.normal if p == "▁unit"), -1]
    columns = pa.array(units + units[:3]), pa.array(ids + ids[:3], pa.list_(pa.int32()))
    plain, parts = pieces.Common(model, units, ids), pieces.Common.of(model, *columns, rows=7)
    for name in ("hashes", "ends", "ids"):
        assert getattr(plain, name).tolist() == getattr(parts, name).tolist()
    assert len(pieces.Common.of(model, *[c[:0] for c in columns]).hashes) == 0
    asked = np.concatenate([plain.hashes[::-1], plain.hashes[:5] + np.uint64(1)])
    assert pieces._lookup(parts, asked).tolist() == [*range(50, -1, -1), *[-1] * 5]


def test_best_paths_equal_a_plain_fold():
    rng = np.random.default_rng(1)
    scores = -np.round(rng.random(300) * 8) / 2  # many equal sums

    def plain(edges):
        best = {0: (0.0, 0, 0)}
        for edge in sorted(edges):
            end, long, id_ = edge >> 32, 255 - ((edge >> 24) & 255), edge & 0xFFFFFF
            total = best[end - long][0] + scores[id_]
            if end not in best or total > best[end][0]:
                best[end] = (total, long, id_ - 1)
        at, out = max(best), []
        while at:
            out.append(best[at][2])
            at -= best[at][1]
        return out[::-1]

    units = []
    for _ in range(300):
        places = [(end, long) for end in range(1, int(rng.integers(2, 20))) for long in range(1, min(end, 6) + 1) if long == 1 or rng.random() < 0.4]
        units.append(rng.permutation([(end << 32) + ((255 - long) << 24) + int(rng.integers(0, 300)) for end, long in places]).tolist())
    counts, ids = pieces.best_paths(np.array([len(u) for u in units]), np.array([e for u in units for e in u]), scores)
    ends = np.cumsum(counts)
    assert [ids[end - n : end].tolist() for end, n in zip(ends, counts)] == [plain(u) for u in units]
    assert [len(x) for x in pieces.best_paths(np.zeros(0, np.int64), np.zeros(0, np.int64), scores)] == [0, 0]
