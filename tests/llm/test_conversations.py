"""Conversation repair: edits against all sequences, hash collisions, cut conversations, edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from appconv.llm import conversations as cv

CONVERSATIONS = "conv_id long, turn long, role string, text string, header int, audit string, present boolean"
FORM = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(cv.SPACES)
        out.append(1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def all_edits(rows, most):
    """Cost and edits of every valid sequence up to a number of edits."""
    marks = faults(rows)
    for n in range(len(rows), most + 1):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            at, cost, roles, valid = 0, 0, "", True
            for x in letters:
                if x == "I":
                    cost, roles = cost + 3, roles + "*"
                    continue
                (role, _), mark = rows[at], marks[at]
                at += 1
                if x == "D":
                    cost += 4
                    continue
                valid = valid and mark not in (1, 2)
                cost += 3 * (x == "R") + 3 * (mark == 3)
                roles += "*" if x == "R" else (role[:1] or "-")
            if not valid:
                continue
            # * is a user or an assistant turn.
            for fill in itertools.product("ua", repeat=roles.count("*")):
                chosen = iter(fill)
                if FORM.fullmatch("".join(next(chosen) if c == "*" else c for c in roles)):
                    yield cost, "".join(letters)
                    break


def plain(rows):
    """Least cost and edits, by a table of texts."""
    best = {cv.START: (0, "")}
    for (role, _), mark in zip(rows, faults(rows), strict=True):
        found = {}
        for state, (cost, audit) in best.items():
            lead, at = "", state
            for _ in range(3):
                extra = 3 * (mark == 3)
                ways = [(at, 4, "D")]
                if mark not in (1, 2):
                    ways.append((cv._NEXT[at], 3 + extra, "R"))
                    if role[:1] == "s" and at == cv.START:
                        ways.append((cv.SYSTEM, extra, "K"))
                    if role[:1] and role[0] == cv._ROLE[cv._NEXT[at]][0]:
                        ways.append((cv._NEXT[at], extra, "K"))
                for to, more, x in ways:
                    way = (cost + 3 * len(lead) + more, audit + lead + x)
                    found[to] = min(found.get(to, way), way)
                at, lead = cv._NEXT[at], lead + "I"
        best = found
    ends = {cv.START: (0, ""), cv.ASSISTANT: (0, ""), cv.USER: (3, "I"), cv.SYSTEM: (6, "II")}
    return min((c + ends[s][0], a + ends[s][1]) for s, (c, a) in best.items())


def repaired(rows, audit):
    out = [(r, t) for _, r, t in cv.edited(audit, iter(rows))]
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(), out


def moves_of(rows):
    return [cv.row_moves(r[:1] if r[:1] in ("s", "u", "a") else "", f) for (r, _), f in zip(rows, faults(rows), strict=True)]


def drawn(draw, n):
    texts = ["Hi.", "No!", "so", "what?", " ", "", "and then"]
    return [(draw.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), draw.choice(texts)) for _ in range(n)]


def test_cheapest_of_all_edits():
    draw = random.Random(3)
    for _ in range(60):
        rows = drawn(draw, draw.randint(0, 4))
        assert cv.cheapest(moves_of(rows)) == min(all_edits(rows, len(rows) + 3)), rows


def test_long_conversations_and_cuts():
    draw = random.Random(4)
    for n in (30, 200, 700):
        rows = drawn(draw, n) if n < 700 else [(draw.choice(["user", "user", "assistant"]), f"{k}.") for k in range(n)]
        moves, want = moves_of(rows), plain(rows)
        assert cv.cheapest(moves) == want
        cuts = sorted(draw.sample(range(n), 5))
        parts = [moves[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        assert cv.cheapest([cv.run_moves(p, list(range(4))) for p in parts]) == want


@pytest.mark.parametrize("modulus", [1, 2, 5])
def test_colliding_hashes(modulus, monkeypatch):
    """With hashes that hardly tell anything apart the edits stay the same."""
    plain_init = cv.Audits.__init__
    monkeypatch.setattr(cv.Audits, "__init__", lambda self: plain_init(self, modulus))
    draw = random.Random(6)
    for n in (3, 12, 60, 150):
        rows = drawn(draw, n)
        assert cv.cheapest(moves_of(rows)) == plain(rows)


def test_compare_by_common_prefix():
    draw = random.Random(8)
    audits, nodes = cv.Audits(), [(0, "")]
    layer = nodes
    for _ in range(40):
        layer = [(audits.add(p, x), t + x) for p, t in draw.sample(layer, min(6, len(layer))) for x in draw.sample("DKR", 2)]
        for a, s in layer:
            assert audits.text(a) == s
            for b, t in layer:
                assert audits.compare(a, b) == (s > t) - (s < t)


def expected(groups):
    """conv_id -> rows of (turn, role, text) in order."""
    out = {}
    for conv, rows in groups.items():
        said = [(r, t) for _, r, t in rows]
        marks = faults(said)
        turns = [k for k, _, _ in rows if k is not None]
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(said)]
        cost, audit = plain(said)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[marks.count(k) for k in (1, 2, 3)],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            repaired(said, audit)[0],
        )
    return out


def frame(spark, groups):
    rows = [(c, *r, 1, "x", True) for c, rows in groups.items() for r in rows]
    return spark.createDataFrame(rows, CONVERSATIONS).repartition(4)


def ordered(groups):
    """Rows of equal turns by MD5 of role and text, as the module says."""
    mark = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r))) for c, rows in groups.items()}


@pytest.mark.parametrize("run_rows", [4096, 7])
def test_tables_of_conversations(spark, run_rows):
    """Long conversations over many runs, repeated and clashing rows, null ids, turns in any order."""
    draw = random.Random(run_rows)
    groups = {c: [(k, *r) for k, r in enumerate(drawn(draw, draw.randint(1, 9)))] for c in range(60)}
    groups[100] = [(draw.choice([None, *range(90)]), *r) for r in drawn(draw, 150)]
    groups[None] = [(k, *r) for k, r in enumerate(drawn(draw, 5))]
    groups[101] = [(2, "user", "Same.")] * 3 + [(5, "assistant", "Yes.")]
    groups[102] = [(1, "user", "long " * 40_000 + ".")]
    groups = ordered(groups)
    rows = frame(spark, groups)
    got = cv.repaired_hashes(rows, cv.audited(rows, run_rows)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(groups)
    turns = cv.repair(rows, cv.audited(rows, run_rows)).collect()
    for conv, own in groups.items():
        said = [(r, t) for _, r, t in own]
        found = sorted((t.place, t.role, t.text) for t in turns if t.conv_id == conv)
        assert [t[1:] for t in found] == repaired(said, plain(said)[1])[1]


def test_damage(spark, tmp_path):
    """The query on damaged rows, nulls and a conversation that loses all rows, against a plain version."""
    draw = random.Random(11)
    rows = [(c, k, draw.choice(["user", "assistant", None]), draw.choice(["Yes.", "no", None, "a. b! c?"])) for c in range(150) for k in range(4)]
    rows += [(None, 1, "user", "Hi."), (500, None, None, None)]
    lost = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Hi."))
    groups = {c: [] for c, *_ in rows}
    for c, k, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if k is None else k}".encode()) % 20
        role, text = "user" if kind == 4 else " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[c] += [(k, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = expected(ordered(groups))
    assert want[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = cv.op13_conversation_audit(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert Counter(r.conv_id for r in got).most_common(1)[0][1] == 1


def test_empty_table(spark):
    rows = frame(spark, {1: [(0, "user", "Hi.")]}).filter(F.lit(False))
    assert cv.repaired_hashes(rows, cv.audited(rows)).count() == 0
