"""The verdicts by gid against the rule itself, pass by pass."""

import random

import numpy as np

from blockloom.streaming import jobs


def by_passes(gid, held):
    out, moved = {}, True
    while moved:
        moved, rest = False, []
        for k, b, e, comp in sorted(held, key=lambda d: (-d[2], -d[1])):
            if e <= gid:
                out[k] = "too_old"
            elif b > gid:
                rest.append((k, b, e, comp))
            elif comp and b < gid:
                out[k] = "not_applicable"
            else:
                out[k] = "accepted"
                gid, moved = e, True
        held = rest
    return gid, out


def judged(gid, diffs):
    b, e, comp = (np.array(c) for c in zip(*diffs, strict=True))
    return jobs.judged(gid, b.astype(np.int64), e.astype(np.int64), comp.astype(bool))


def test_verdicts_equal_those_of_the_passes():
    r = random.Random(5)
    for _ in range(2000):
        diffs = sorted(((b := r.randrange(20), b + r.choice([-1, 0, 1, 1, 2, 5]), r.random() < 0.3) for _ in range(r.randrange(1, 25))), key=lambda d: d[0])
        gid, want = by_passes(3, [(k, *d) for k, d in enumerate(diffs)])
        got, what = judged(3, diffs)
        assert got == gid and {k: jobs._BY_GID[w] for k, w in enumerate(what) if w} == want, diffs


def test_a_long_chain_takes_one_pass_and_leaves_in_frames():
    n, state = 150_000, type("State", (), {"exists": False, "update": lambda self, v: setattr(self, "kept", v)})()
    import pandas as pd

    b = np.arange(n)[::-1]
    rows = pd.DataFrame({"b_b": b, "e_b": b + 1, "is_comp_diff": False, "uuid": "u", "size": 5, "from_proxy": True, "base_gid": 0, "base_uuid": "u", "base_size": 9})
    frames = list(jobs._accept((7,), iter([rows[:n // 2], rows[n // 2 :]]), state))
    assert sum(map(len, frames)) == n and max(map(len, frames)) == jobs.MAX_OUT and state.kept == (n, "[]")
    assert all((f["verdict"] == "accepted").all() and (f["vol_id"] == 7).all() for f in frames)
