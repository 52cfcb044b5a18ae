"""A stand-in for a stream's typed state, with what is written counted."""


class Value:
    def __init__(self, owner):
        self.owner, self.held = owner, None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.owner.written += size(value)
        self.held = value

    def clear(self):
        self.held = None


class Map:
    def __init__(self, owner):
        self.owner, self.held = owner, {}

    def getValue(self, key):
        return self.held.get(key)

    def containsKey(self, key):
        return key in self.held

    def updateValue(self, key, value):
        self.owner.written += size(key) + size(value)
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)

    def keys(self):
        return list(self.held)

    def iterator(self):
        return list(self.held.items())

    def clear(self):
        self.held.clear()


def size(x):
    return sum(map(size, x)) if isinstance(x, (tuple, list)) else 8


class Handle:
    """Get values and maps by name; `written` counts numbers, eight bytes each."""

    def __init__(self):
        self.states, self.written = {}, 0

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value(self))

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Map(self))
