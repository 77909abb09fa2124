"""Plain Python statements of the definitions, for small inputs."""

import math
from collections import defaultdict


def feed(own, tgt, min_users):
    """{(cohort, a0, a1): (co, users_a1, nCVU, slot)} from sets of (cohort, uid, app)."""
    o, t = defaultdict(set), defaultdict(set)
    for cohort, uid, app in own:
        o[cohort, app].add(uid)
    for cohort, uid, app in tgt:
        t[cohort, app].add(uid)
    out = {}
    for (c0, a0), u0 in t.items():
        if len(u0) < min_users:
            continue
        partners = {a1: u1 for (c1, a1), u1 in o.items() if c1 == c0 and a1 != a0 and len(u1) >= min_users}
        s_co = sum(len(u0 & u1) for u1 in partners.values())
        s_u = sum(len(u1) for u1 in partners.values())
        for a1, u1 in partners.items():
            co = len(u0 & u1)
            lift = co * s_u / (s_co * len(u1)) if s_co else None
            slot = min(max(math.floor(math.log2(lift)), -3), 5) + 3 if lift else 0
            out[c0, a0, a1] = (co, len(u1), lift, slot)
    return out


def vector(feed_, cohort, a0, bag):
    cells = [0] * 9
    for a1 in bag or ():
        if (cohort, a0, a1) in feed_:
            cells[feed_[cohort, a0, a1][3]] = 1
    return f"Array({', '.join(map(str, cells))})"
