"""Calls to the state store that the visit store needs for a key do not grow with its visits or days."""

import pandas as pd

from sparkfolio.streaming.state import VisitStore


class Handle:
    def __init__(self):
        self.calls, self.timers = 0, []

    def __getattr__(self, name):
        if name.startswith("get"):
            return lambda *a: State(self, [] if name == "getListState" else None)
        raise AttributeError(name)

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter([*self.timers])

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class State:
    def __init__(self, handle, value):
        self.handle, self.value, self.map = handle, value, {}

    def _called(self, value=None):
        self.handle.calls += 1
        return value

    def exists(self):
        return self._called(self.value is not None)

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    put = update

    def containsKey(self, key):  # noqa: N802
        return self._called(key in self.map)

    def getValue(self, key):  # noqa: N802
        return self._called(self.map[key])

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = self._called(value)

    def iterator(self):
        return self._called(iter([*self.map.items()]))


def test_few_calls_a_key():
    store, handle, day = VisitStore(6 * 3600, 5), Handle(), 86_400_000_000
    store.init(handle)
    for batch in range(2):
        handle.calls = 0
        us = [(100 * batch + k) * day for k in range(100)]
        (told,) = store.handleInputRows(("u",), iter([pd.DataFrame({"us": us, "id": range(100)})]), None)
        assert handle.calls <= 6 and len(handle.timers) == 1
    assert told["total"][0] == 200 and len(told["days"][0]) == 200 and told["newest"][0] == [99, 98, 97, 96, 95]
