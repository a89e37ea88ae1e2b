"""The state of a run is read and written once for each id of a batch, not for each line."""

from types import SimpleNamespace as Line

import pytest

from ferrule.streaming import status


class Map(dict):
    reads = writes = 0

    def containsKey(self, k):
        self.reads += 1
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self.writes += 1
        self[k] = v


@pytest.mark.parametrize("held", [2, 10_000])
def test_each_id_once_a_batch(monkeypatch, held):
    monkeypatch.setattr(status, "HELD", held, raising=False)
    s = status.Statuses(60, 60)
    s.ids, s.ended = Map(), Line(exists=lambda: False)
    s.handle = Line(listTimers=lambda: [], deleteTimer=None, registerTimer=lambda ms: None)
    lines = [Line(seq=(i * 37) % 500, ms=i, event="start" if i % 3 else "done", id=str(i % 5), ok=True, seconds=float(i)) for i in range(500)]
    got = list(s.handleInputRows(("r",), iter(lines), None))
    best, want = {}, []
    for r in lines:
        if best.get(r.id, -1) < r.seq:
            best[r.id] = r.seq
            want.append((r.id, r.seq, "running" if r.event == "start" else "done"))
    assert [(r.id, r.seq, r.state) for r in got] == want and {k[0]: v[1] for k, v in s.ids.items()} == best
    if held > 5:
        assert s.ids.reads <= 5 and s.ids.writes <= 5
