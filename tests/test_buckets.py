"""Things share the calls of Python and of the state: their number doesn't grow with the things of a bucket."""

from types import SimpleNamespace

import pandas as pd

from driftlens.streaming import stateful


class State:
    """List and value state, timers, and a count of all calls."""

    def __init__(self):
        self.calls, self.list, self.value, self.timers = 0, [], None, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("getListState", "getValueState"):
                return SimpleNamespace(appendList=self.append, get=self.read if name == "getListState" else self.now, put=self.put, clear=self.empty if name == "getListState" else self.forget, exists=self.known, update=self.keep)
            return None

        return call

    def append(self, rows):
        self.calls += 1
        self.list += rows

    def put(self, rows):
        self.calls += 1
        self.list = list(rows)

    def read(self):
        self.calls += 1
        return iter(self.list)

    def empty(self):
        self.list = []

    def forget(self):
        self.value = None

    def known(self):
        return self.value is not None

    def now(self):
        return self.value

    def keep(self, value):
        self.value = value


def test_calls_of_the_state_do_not_grow_with_things():
    state, day = State(), 86400_000_000
    op = stateful.AsOf(3 * day)
    op.init(state)
    rows = [("c", str(i), kind, at * day, f"{kind}{i}") for i in range(500) for kind, at in (("edit", 2), ("approval", 1), ("approval", 9), ("edit", 3.5), ("edit", 4), ("edit", 20))]
    frame = pd.DataFrame(rows, columns=["community_id", "thing_id", "kind", "at_us", "payload"])
    list(op.handleInputRows((0,), iter([frame]), None))
    (out,) = op.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10 * day // 1000), None)
    edits, over = out[out["kind"] == "edit"], out[out["kind"] == "expiry"]
    assert len(edits) == 1000 and set(edits["at_us"]) == {2 * day, 3.5 * day} and len(over) == 500 and set(over["at_us"]) == {4 * day}
    assert len(state.list) == 1000 and state.value == (12 * day,)  # the later approvals, and the edits that wait
    assert state.calls < 20
