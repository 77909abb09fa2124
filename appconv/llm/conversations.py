"""Repair of conversation structure by a persistent audit programme.

Every row of a conversation is kept, given another role or deleted, and empty turns may be put in before it, so that the roles'
initials become an optional s and pairs of u and a. What has been read so far matters by one of four states only (nothing, after
s, after u, after a); per row and state the programme keeps the least cost and of equal costs the edits that come first in ASCII.

Edit sequences are linked nodes: a prefix is stored once, however many sequences go on from it. A node knows its ancestors 1,
2, 4, 8, ... steps up and a rolling hash of its whole sequence, so two equally expensive sequences are compared by searching
their longest common prefix through the ancestors; as hashes may collide, the prefix found is then compared up to the node that
both share. Two sequences of as many rows never are prefixes of each other, so a decision holds whatever follows.

What a run of rows does is a table of 4 x 4 states with costs and edits, and tables of adjacent runs combine by the same
programme. So conversations of any length are cut: all rows are sorted and worked on in runs of ``RUN_ROWS``; conversations
that lie within a run are done there, the others' tables are put together. Rows that occur again are found by an aggregate
over digests. Only the hash of a repaired conversation must see its rows one after the other; it reads them as a stream, so
that memory holds the edits of one conversation and a batch of rows.

Defined cases: a null role, text, or id in the damage key is one space; null turns come first; a null conv_id is a
conversation. Rows of one turn are ordered by an MD5 of role and text. An empty role has no initial and fits nowhere. A
conversation without rows after damage has empty edits. Repeated rows are duplicates. Other columns are ignored. An empty
table gives no rows."""

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import staged, table
from appconv.llm.order import sorted_rows
from appconv.llm.sharding import CRC_TABLE, crc_of

START, SYSTEM, USER, ASSISTANT = range(4)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
RUN_ROWS = 4096
ORDERLY = ("su", "ua", "au")

# The state after the next user or assistant turn, and its role.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_MODULUS = (1 << 61) - 1
_BASE = 1_000_003

Moves = dict[int, list[tuple[int, int, str]]]

MEASURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RUNS = "conv string, at long, whole boolean, header array<long>, audit string, costs array<long>, audits array<string>, ends array<string>"


class Audits:
    """Edit sequences that share their prefixes; node 0 is the empty one."""

    def __init__(self, modulus: int = _MODULUS):
        self._modulus = modulus
        self._piece, self._hash, self._up = [""], [0], [[0]]
        self._verified: set[tuple[int, int]] = set()

    def add(self, parent: int, piece: str) -> int:
        up, node = [parent], len(self._piece)
        while up[-1] and len(self._up[up[-1]]) >= len(up):
            up.append(self._up[up[-1]][len(up) - 1])
        self._up.append(up)
        self._piece.append(piece)
        self._hash.append((self._hash[parent] * _BASE + zlib.crc32(piece.encode()) + 1) % self._modulus)
        return node

    def compare(self, a: int, b: int) -> int:
        """Of two nodes of as many pieces: -1, 0 or 1 as the sequence of ``a`` comes first, is the same or comes later."""
        x, y = a, b
        if self._hash[x] != self._hash[y]:
            for k in reversed(range(max(len(self._up[x]), len(self._up[y])))):
                if k < min(len(self._up[x]), len(self._up[y])):
                    p, q = self._up[x][k], self._up[y][k]
                    if self._hash[p] != self._hash[q]:
                        x, y = p, q
            above = self._up[x][0], self._up[y][0]
        else:
            above = a, b
        # Equal hashes only say that what is above is probably equal.
        p, q, met = *above, False
        while p != q and (p, q) not in self._verified:
            if self._piece[p] != self._piece[q]:
                x, y, met = p, q, True
            p, q = self._up[p][0], self._up[q][0]
        if not met:
            self._verified.add(above)
        first, second = self._piece[x], self._piece[y]
        return (first > second) - (first < second)

    def text(self, node: int) -> str:
        pieces = []
        while node:
            pieces.append(self._piece[node])
            node = self._up[node][0]
        return "".join(reversed(pieces))


def row_moves(initial: str, fault: int) -> Moves:
    """Cheapest edits of a row, with turns put in before it, from each state to each state."""
    out: Moves = {}
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for start in (START, SYSTEM, USER, ASSISTANT):
        best: dict[int, tuple[int, str]] = {}
        state, added = start, ""
        for _ in range(3):
            ways = [(state, DELETE_COST, "D")]
            if fault not in (BLANK, DUPLICATE):
                ways.append((_NEXT[state], REROLE_COST + extra, "R"))
                if initial == "s" and state == START:
                    ways.append((SYSTEM, extra, "K"))
                if initial == _ROLE[_NEXT[state]][0]:
                    ways.append((_NEXT[state], extra, "K"))
            for to, cost, letter in ways:
                way = (cost + INSERT_COST * len(added), added + letter)
                best[to] = min(best.get(to, way), way)
            state, added = _NEXT[state], added + "I"
        out[start] = [(to, *way) for to, way in best.items()]
    return out


# What completes a conversation; state 0 stands for its end.
_FINISH: Moves = {START: [(START, 0, "")], ASSISTANT: [(START, 0, "")], USER: [(START, 3, "I")], SYSTEM: [(START, 6, "II")]}


def advance(audits: Audits, best: dict[int, tuple[int, int]], moves: Moves) -> dict[int, tuple[int, int]]:
    """State to (cost, node), one row or run further."""
    found: dict[int, tuple[int, int, str]] = {}
    for state, (cost, node) in best.items():
        for to, more, piece in moves.get(state, ()):
            new, old = (cost + more, node, piece), found.get(to)
            if old is not None and new[0] == old[0]:
                order = audits.compare(node, old[1])
                if order < 0 or order == 0 and piece < old[2]:
                    found[to] = new
            elif old is None or new[0] < old[0]:
                found[to] = new
    return {to: (cost, audits.add(node, piece)) for to, (cost, node, piece) in found.items()}


def run_moves(rows: list[Moves], starts: list[int]) -> Moves:
    """The moves of several adjacent rows together."""
    out: Moves = {}
    for start in starts:
        audits, best = Audits(), {start: (0, 0)}
        for moves in rows:
            best = advance(audits, best, moves)
        out[start] = [(to, cost, audits.text(node)) for to, (cost, node) in best.items()]
    return out


def cheapest(parts: list[Moves]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    (_, cost, audit), = run_moves([*parts, _FINISH], [START])[START]
    return cost, audit


class _Ends:
    """What counts that cross the borders of runs need: initials and turns at both ends of a run, as texts."""

    def __init__(self):
        self.first: str | None = None
        self.last: str | None = None
        self.turns: list[int] | None = None

    def packed(self) -> list[str | None]:
        return [self.first, self.last, *(map(str, self.turns) if self.turns else (None, None))]


class _Counts:
    def __init__(self):
        self.faults, self.illegal, self.distinct, self.ends = [0, 0, 0, 0], 0, 0, _Ends()

    def add(self, distinct: int, faults: list[int], illegal: int, ends: list[str | None]) -> None:
        """A row, or a run of rows behind the earlier ones."""
        first, last, low, high = ends
        own = self.ends
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]
        self.illegal += illegal
        if first is not None:
            if own.last is not None and own.last + first not in ORDERLY:
                self.illegal += 1
            own.first = first if own.first is None else own.first
            own.last = last
        if low is not None:
            self.distinct += distinct - (own.turns is not None and own.turns[1] == int(low))
            own.turns = [own.turns[0] if own.turns else int(low), int(high)]

    def measures(self) -> list[int]:
        gaps = self.ends.turns[1] - self.ends.turns[0] + 1 - self.distinct if self.ends.turns else 0
        return [gaps, *self.faults[1:], self.illegal]


def _run(block: pd.DataFrame) -> pd.DataFrame:
    """Sorted rows in a run -> a row for each conversation in it."""
    block = block.sort_values("at")
    known: dict[tuple[str, int], Moves] = {}
    done: dict[tuple, tuple[int, str]] = {}
    parts: list[tuple] = []  # conversation, first place, counts, moves
    names = ("conv", "at", "turn", "initial", "fault", "present")
    for conv, at, turn, initial, fault, present in zip(*(block[n].tolist() for n in names), strict=True):
        if not parts or parts[-1][0] != conv:
            parts.append((conv, at, _Counts(), []))
        if not present:
            continue
        counts, moves = parts[-1][2:]
        counts.add(turn is not None, [int(fault == f) for f in range(4)], 0, [initial, initial, turn, turn])
        moves.append((initial if initial in ("s", "u", "a") else "", fault))
    rows = []
    for k, (conv, at, counts, codes) in enumerate(parts):
        moves = [known.get(c) or known.setdefault(c, row_moves(*c)) for c in codes]
        if 0 < k < len(parts) - 1:
            if (same := tuple(codes)) not in done:
                done[same] = cheapest(moves)
            cost, audit = done[same]
            rows.append((conv, at, True, [*counts.measures(), cost], audit, None, None, None))
        else:
            found = run_moves(moves, [START, SYSTEM, USER, ASSISTANT])
            costs, audits = [None] * 16, [None] * 16
            for start, ways in found.items():
                for to, cost, audit in ways:
                    costs[4 * start + to], audits[4 * start + to] = cost, audit
            rows.append((conv, at, False, [counts.distinct, *counts.faults, counts.illegal], None, costs, audits, counts.ends.packed()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])


def _joined(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
    """The runs of a conversation -> the conversation."""
    runs = runs.sort_values("at")
    counts, parts = _Counts(), []
    for header, costs, audits, ends in zip(runs["header"], runs["costs"], runs["audits"], runs["ends"], strict=True):
        distinct, *faults, illegal = (int(x) for x in header)
        counts.add(distinct, faults, illegal, list(ends))
        ways = [(k, c, a) for k, (c, a) in enumerate(zip(costs, audits, strict=True)) if a is not None]
        parts.append({s: [(k % 4, int(c), a) for k, c, a in ways if k // 4 == s] for s in range(4)})
    cost, audit = cheapest(parts)
    return pd.DataFrame({"conv": [key[0]], "header": [[*counts.measures(), cost]], "audit": [audit]})


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present -> with nulls as spaces, an order of rows of one turn and no other columns."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "present", digest.alias("digest"))


def audited(conversations: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """conversations (conv_id, turn, role, text, and present: whether the row is there) -> conv_id, the measures and audit."""
    kind = conversations.schema["conv_id"].dataType
    rows = _prepared(conversations)
    ending = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    blank, open_ = ending == "", ~ending.isin(list(ENDINGS))
    narrow = rows.select(
        "conv_id", "turn", "present", "digest", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), open_.alias("open")
    )
    placed = sorted_rows(narrow, [F.col("conv_id"), F.col("turn"), F.col("digest")])
    firsts = placed.filter("present and not blank").groupBy("conv_id", "digest")
    firsts = staged(firsts.agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    both = placed.alias("p").join(
        firsts.alias("f"), _same(F.col("p.conv_id"), F.col("f.conv_id")) & (F.col("p.digest") == F.col("f.digest")), "left"
    )
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(0)
    coded = both.select(
        F.col("p.conv_id").cast("string").alias("conv"),
        "at",
        "range",
        F.col("turn").cast("string").alias("turn"),
        "initial",
        fault.alias("fault"),
        "present",
    )
    # Places of a range are consecutive from its start on.
    within = F.col("at") - F.shiftleft("range", 33)
    run = coded.withColumn("run", F.floor(within / run_rows).cast("long"))
    runs = staged(run.groupBy("range", "run").applyInPandas(_run, RUNS))
    cut = runs.filter("not whole").groupBy("conv").applyInPandas(_joined, "conv string, header array<long>, audit string")
    found = runs.filter("whole").select("conv", "header", "audit").unionByName(cut)
    return found.select(
        F.col("conv").cast(kind).alias("conv_id"), *[F.col("header")[k].alias(n) for k, n in enumerate(MEASURES)], "audit"
    )


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edits and the (role, text) they are for -> edit, role and text of each repaired turn."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and role.startswith("s"):
            state = SYSTEM
        else:
            state = _NEXT[state]
            role = role if letter == "K" else _ROLE[state]
        yield letter, role, text


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, Iterator[tuple[str, str]]]]:
    """Sorted rows, of each conversation the one with its audit first -> that row and, to be read at once, the others."""

    def events():
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield row

    stream = events()
    head = next(stream, None)
    while head is not None:
        following = [None]

        def rows(following=following):
            for row in stream:
                if row.audit is not None:
                    following[0] = row
                    return
                yield row.role, row.text

        own = rows()
        yield head, own
        for _ in own:  # what was not read
            pass
        head = following[0]


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for head, rows in _conversations(batches):
        digest = hashlib.sha256()
        for n, (_, role, text) in enumerate(edited(head.audit, rows)):
            digest.update((("\n" if n else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        out.append((head.conv, list(head.header), head.audit, digest.hexdigest()))
        if len(out) == 1000:
            yield pd.DataFrame(out, columns=["conv", "header", "audit", "repaired_sha256"])
            out = []
    yield pd.DataFrame(out, columns=["conv", "header", "audit", "repaired_sha256"])


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["conv", "place", "edit", "role", "text"]
    out = []
    for head, rows in _conversations(batches):
        for n, (letter, role, text) in enumerate(edited(head.audit, rows)):
            out.append((head.conv, n, letter, role, text))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=columns)
                out = []
    yield pd.DataFrame(out, columns=columns)


def _streams(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """By conversation its audit and then its rows, in order."""
    rows = _prepared(conversations).filter("present")
    header = F.array(*[F.col(m) for m in MEASURES])
    heads = audits.select("conv_id", header.alias("header"), "audit")
    both = heads.unionByName(rows.select("conv_id", "turn", "digest", "role", "text"), allowMissingColumns=True)
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), F.col("digest")]
    sorted_ = both.repartition("conv_id").sortWithinPartitions(*order)
    return sorted_.select(F.col("conv_id").cast("string").alias("conv"), "header", "audit", "role", "text")


def repair(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place, edit (K, R or I), role, text. ``audits`` as from ``audited``."""
    turns = _streams(conversations, audits).mapInPandas(_turns, "conv string, place long, edit string, role string, text string")
    return turns.withColumn("conv", F.col("conv").cast(conversations.schema["conv_id"].dataType)).withColumnRenamed("conv", "conv_id")


def repaired_hashes(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """Of each conversation its measures, audit, and SHA-256 of the repaired ``role:text`` lines."""
    schema = "conv string, header array<long>, audit string, repaired_sha256 string"
    found = _streams(conversations, audits).mapInPandas(_hashes, schema)
    kind = conversations.schema["conv_id"].dataType
    measures = [F.col("header")[k].alias(n) for k, n in enumerate(MEASURES)]
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *measures, "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present after the damage; dropped rows stay as not present, so that no id is lost."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = (F.crc32(key.cast("binary")) % 20).cast("int")
    text = F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDINGS, "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def op13_conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repaired_hashes(rows, audited(rows))


_TRIMMED = r"rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLE = {
    "op13_conversation_audit": f"""
        with recursive {CRC_TABLE}, keyed as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                {crc_of("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as d
            from conversations, crc
        ), changed as (
            select conv_id, turn, case when d = 4 then 'user' else role end as role,
                case d when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
            from (select *, unnest(case when d = 3 then [1, 2] else [1] end) as copy from keyed where d <> 0)
        ), numbered as (
            select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) as n,
                left(role, 1) as initial, right({_TRIMMED}, 1) as ending
            from changed
        ), faulty as (
            select *, case when ending = '' then 'blank'
                when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate'
                when ending not in ('.', '!', '?') then 'truncated' else '' end as fault,
                lag(initial) over (partition by conv_id order by n) || initial as pair
            from numbered
        ), counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal,
                count(*) as rows
            from faulty group by conv_id
        ), follows(state, next) as (values ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')
        ), added(state, reached, lead, price) as (
            select state, state, '', 0 from follows
            union all select state, next, 'I', 3 from follows
            union all select f.state, g.next, 'II', 6 from follows f join follows g on f.next = g.state
        ), best(conv_id, n, state, least) as (
            select conv_id, 0, '', {{'cost': 0, 'audit': ''}} from counts
            union all
            select conv_id, n, state, min({{'cost': cost, 'audit': audit}}) from (
                select b.conv_id, f.n, w.state, b.least.cost + a.price + w.price as cost, b.least.audit || a.lead || w.letter as audit
                from best b join faulty f on f.conv_id is not distinct from b.conv_id and f.n = b.n + 1
                    join added a on a.state = b.state
                    join follows x on x.state = a.reached,
                    lateral (
                        select a.reached as state, 4 as price, 'D' as letter
                        union all select x.next, 3 + (f.fault = 'truncated')::int * 3, 'R' where f.fault not in ('blank', 'duplicate')
                        union all select f.initial, (f.fault = 'truncated')::int * 3, 'K' where f.fault not in ('blank', 'duplicate')
                            and (f.initial = x.next or f.initial = 's' and a.reached = '')
                    ) w
            ) group by conv_id, n, state
        ), ended as (
            select b.conv_id, min(case state when 'u' then {{'cost': least.cost + 3, 'audit': least.audit || 'I'}}
                when 's' then {{'cost': least.cost + 6, 'audit': least.audit || 'II'}} else least end) as least
            from best b join counts c on c.conv_id is not distinct from b.conv_id and b.n = c.rows group by b.conv_id
        ), letters as (
            select conv_id, generate_subscripts(string_split(least.audit, ''), 1) as k, unnest(string_split(least.audit, '')) as letter
            from ended where least.audit <> ''
        ), edits as (
            select *, sum((letter <> 'I')::int) over (partition by conv_id order by k) as n from letters
        ), turns as (
            select e.conv_id, k, letter, f.role, f.text, f.initial,
                row_number() over (partition by e.conv_id order by k) - 1 as place,
                bool_or(letter = 'K' and f.initial = 's') over (partition by e.conv_id) as system
            from edits e left join faulty f on letter <> 'I' and f.conv_id is not distinct from e.conv_id and f.n = e.n
            where letter <> 'D'
        ), repaired as (
            select conv_id, string_agg(case when letter = 'K' then role when (place - system::int) % 2 = 0 then 'user' else 'assistant' end
                || ':' || coalesce(text, ''), chr(10) order by k) as lines
            from (select * replace (coalesce(system, false) as system) from turns) group by conv_id
        )
        select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
            coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
            coalesce(illegal, 0)::bigint as illegal, coalesce(e.least.cost, 0)::bigint as cost, coalesce(e.least.audit, '') as audit,
            sha256(coalesce(lines, '')) as repaired_sha256
        from (select distinct conv_id from conversations) o
            left join counts c on c.conv_id is not distinct from o.conv_id
            left join ended e on e.conv_id is not distinct from o.conv_id
            left join repaired r on r.conv_id is not distinct from o.conv_id
    """
}
