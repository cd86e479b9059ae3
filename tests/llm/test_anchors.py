"""The anchor of a window is the least symbol with its support inside, long supports first."""

import numpy as np

from reefline.llm import recompression as r


def test_anchors_are_the_least_symbols_inside(monkeypatch):
    visits = []

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        class minimum:
            def __new__(cls, *args, **kwargs):
                return np.minimum(*args, **kwargs)

            @staticmethod
            def at(found, where, values):
                visits.append(len(where))
                np.minimum.at(found, where, values)
    monkeypatch.setattr(r, "np", Counted())
    rng = np.random.default_rng(5)
    for width in (5, 13):
        for _ in range(20):
            lengths = rng.integers(0, 30, 6)
            tokens = rng.integers(0, 9, lengths.sum()).astype(np.uint64)
            visits.clear()
            key, chosen, fits = r._anchors(tokens, lengths, width)
            name, low, high, level = r.symbols(tokens, lengths)
            inside = high - low <= width
            name, low, high, level = name[inside], low[inside], high[inside], level[inside]
            # each symbol is looked at once, not once for every window around it
            assert sum(visits) <= len(name)
            keys = r.mix64(r.Rolling(tokens, r.BASES[0]).of(low, high) + r.mix64(name + level.astype(np.uint64)))
            order = [(int(k) >> 32, i) for i, k in enumerate(keys.tolist())]
            for start in np.flatnonzero(fits).tolist():
                within = [i for i in range(len(name)) if low[i] >= start and high[i] <= start + width]
                long = [i for i in within if high[i] - low[i] >= r.LEAST_SUPPORT]
                assert chosen[start] == min(long or within, key=lambda i: order[i]) and key[start] == keys[chosen[start]]
