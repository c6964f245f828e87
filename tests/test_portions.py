"""Long texts are worked on in portions of bytes: a batch has up to 10,000 rows, however long they are."""
import json

import pyarrow as pa

from quire.sources import json as J
from quire.sources import ranges as R

TEXTS = [f"{i}" * 90_000 for i in range(100)] + ["", "x" * (2 * R.PORTION if hasattr(R, "PORTION") else 4 << 20), "é"]
LIMIT = 4 << 20


def test_ranges_are_fed_in_portions():
    n = len(TEXTS)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([0] * 50 + [9] * (n - 50)), pa.array([5] * n),
                                        pa.array(TEXTS)], ["file", "block", "size", "value"])
    found = list(R.runs(iter([batch])))
    assert [t for _, _, v in found for t in v.to_pylist()] == TEXTS
    assert [k for k, _, v in found for _ in v] == [(1, 0)] * 50 + [(1, 9)] * (n - 50)
    assert all(len(v) == 1 or sum(len(t.encode()) for t in v.to_pylist()) <= LIMIT for _, _, v in found)


def test_json_documents_are_written_in_portions():
    rows = [json.dumps({"t": t}) for t in TEXTS]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[a:e])], ["value"]) for a, e in ((0, 60), (60, 60), (60, len(rows)))]
    lines = [b.column(0).to_pylist() for b in J._document(("[", "]"), iter(batches))]
    assert [r["t"] for r in json.loads("\n".join(x for b in lines for x in b))] == TEXTS
    assert all(len(b) <= 2 or sum(map(len, b)) <= LIMIT for b in lines)
