"""Merkle manifest of a dataset by time-forward processing.

Per source the documents' digests are the leaves of a tree of fan-out 16, the subroots of all sources those of a top tree.
A node's label is the last leaf below it and its level, so labels ascend from children to parents. In the forward sweep every
node sends its digest to its parent through a priority queue ordered by the receiver's label; a node whose label is due takes
its children's digests out of the queue, and becomes their digest. Running the labels backwards, each node sends to its
children what their proofs end in: the siblings of the child, then the node's own suffix. What arrives at a leaf is its proof.

The queue is external in two ways: messages between blocks of three levels (4096 leaves, one subtree) are rows dealt and sorted
by Spark's shuffle, and only those within a block are in a heap, at most 16 a level. So a source of any size is worked on
in as many tasks as it has blocks, and each round of blocks leaves 1/4096 of the rows.

Defined cases: a null field is digested as ``-``. Leaves ascend by doc_id, null first, then by digest; rows that repeat are leaves
each, and equal ones are interchangeable. A null source is a source, ordered first. A source or a top tree of one leaf
has that leaf as its root and no siblings. Very long texts are digested whole, before any shuffle. Other columns are
ignored. An empty table gives no rows."""

import hashlib
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import lower_ascii, staged, table
from appconv.llm.order import numbered_in_groups, sorted_rows
from appconv.llm.sharding import CRC_TABLE, crc_of

FAN = 16
LEVELS = 3
BLOCK = FAN**LEVELS
DIGEST = 64
TAMPER_EVERY = 5

NODES = "tree long, number long, total long, digest string"
SUFFIXES = "tree long, number long, suffix string, subroot string"
PROOFS = "doc_id string, number long, total long, tree long, leaf string, claimed string, subroot string, folded_root string"


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(text: Column) -> Column:
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.sha2(F.concat(*[part(f) for f in fields]).cast("binary"), 256)


def height(total: int) -> int:
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN), levels + 1
    return levels


class MessageQueue:
    """Messages by the label of their receiver, equal labels in the order of sending."""

    def __init__(self):
        self._heap: list[tuple] = []
        self._sent = 0

    def send(self, label: tuple[int, int], message) -> None:
        heapq.heappush(self._heap, (label, self._sent, message))
        self._sent += 1

    def due(self, label: tuple[int, int]) -> bool:
        return bool(self._heap) and self._heap[0][0] <= label

    def receive(self) -> tuple[tuple[int, int], list]:
        """The lowest label and its messages."""
        label, messages = self._heap[0][0], []
        while self._heap and self._heap[0][0] == label:
            messages.append(heapq.heappop(self._heap)[2])
        return label, messages


def _last_leaf(number: int, level: int, total: int) -> int:
    return min((number + 1) * FAN**level, total) - 1


def forward(digests: list[str], first: int, total: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """A block's leaves from number ``first`` on -> digest of its top; level, number and children's digests of its nodes in
    the order of their labels."""
    top, queue, nodes, digest = min(LEVELS, height(total)), MessageQueue(), [], ""

    def send(number: int, level: int, digest: str) -> None:
        if level < top:
            parent = number // FAN
            queue.send((_last_leaf(parent, level + 1, total), level + 1), (parent, digest))

    for number, digest in enumerate(digests, first):  # noqa: B007
        send(number, 0, digest)
        while queue.due((number, top)):
            (_, level), messages = queue.receive()
            own, children = messages[0][0], [d for _, d in messages]
            digest = digest_of(children)
            nodes.append((level, own, children))
            send(own, level, digest)
    return digest, nodes


def backward(nodes: list[tuple[int, int, list[str]]], suffix: str, first: int, total: int) -> list[str]:
    """Nodes of ``forward`` and the suffix of the block's top -> proofs of the block's leaves."""
    if not nodes:
        return [suffix]
    queue, proofs = MessageQueue(), {}

    def send(number: int, level: int, suffix: str) -> None:
        if level:
            queue.send((-_last_leaf(number, level, total), -level), suffix)
        else:
            proofs[number] = suffix

    send(nodes[-1][1], nodes[-1][0], suffix)
    for level, number, children in reversed(nodes):
        _, (own,) = queue.receive()
        for k, _ in enumerate(children):
            send(number * FAN + k, level - 1, "".join(children[:k] + children[k + 1 :]) + own)
    return [proofs[n] for n in sorted(proofs)]


def fold(digest: str, proof: str, places: list[tuple[int, int]]) -> str:
    """The root that ``digest`` and its proof lead to; places: number and leaves, of each tree on the way."""
    at = 0
    for number, total in places:
        while total > 1:
            before = number % FAN * DIGEST
            end = at + (min(FAN, total - number // FAN * FAN) - 1) * DIGEST
            digest = digest_of([proof[at : at + before], digest, proof[at + before : end]])
            at, number, total = end, number // FAN, -(-total // FAN)
    return digest


def _forward_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("number")
    total = int(block["total"].iloc[0])
    digest, _ = forward(block["digest"].tolist(), int(block["number"].iloc[0]), total)
    return pd.DataFrame({"tree": [key[0]], "number": [key[1]], "total": [-(-total // BLOCK)], "digest": [digest]})


def _proofs(block: pd.DataFrame, suffix: str) -> tuple[pd.DataFrame, list[str]]:
    block = block.sort_values("number")
    first, total = int(block["number"].iloc[0]), int(block["total"].iloc[0])
    _, nodes = forward(block["digest"].tolist(), first, total)
    return block, backward(nodes, suffix, first, total)


def _backward_block(is_top: bool):
    """In the top tree the leaves, nodes of the last step, are the subroots themselves."""

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, suffixes = _proofs(block, above["suffix"].iloc[0])
        subroot = block["digest"] if is_top else above["subroot"].iloc[0]
        return pd.DataFrame({"tree": block["tree"], "number": block["number"], "suffix": suffixes, "subroot": subroot})

    return run


def _leaf_block(trees: int, proof: str):
    """Each leaf's proof (or its digest only, so that no more than a block's proofs are in memory) and the root to which the
    claimed leaf and the proof lead."""

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, proofs = _proofs(block, above["suffix"].iloc[0])
        rows = zip(block["claimed"], proofs, block["number"], block["total"], block["tree"], strict=True)
        block = block.rename(columns={"digest": "leaf"}).assign(
            subroot=above["subroot"].iloc[0],
            folded_root=[fold(c, p, [(n, t), (k, trees)]) for c, p, n, t, k in rows],
            **{proof: [digest_of([p]) for p in proofs] if proof == "proof_sha256" else proofs},
        )
        return block[[*(c.split()[0] for c in PROOFS.split(", ")), proof]]

    return run


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("number") / BLOCK).cast("long"))


def _rounds(leaves: DataFrame) -> list[DataFrame]:
    """Nodes of each round, from leaves to the single nodes of all trees."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    rounds = [leaves]
    while len(rounds) == 1 or most > 1:
        nodes = _blocks(rounds[-1].select("tree", "number", "total", "digest"))
        rounds.append(staged(nodes.groupBy("tree", "block").applyInPandas(_forward_block, NODES)))
        most = -(-most // BLOCK)
    return rounds


def _down(rounds: list[DataFrame], suffixes: DataFrame, is_top: bool = False) -> DataFrame:
    """Suffixes of the tops of the last round's blocks -> suffixes of the first round's nodes."""
    for nodes in reversed(rounds):
        above = suffixes.groupBy("tree", "number")
        below = _blocks(nodes).groupBy("tree", "block").cogroup(above)
        suffixes = staged(below.applyInPandas(_backward_block(is_top), SUFFIXES))
    return suffixes


def manifest(documents: DataFrame, found: Column | None = None, proof: str = "proof") -> DataFrame:
    """documents (doc_id, source, lang, n_chars, text) -> doc_id, leaf, number and total in its source's tree, tree and trees
    (the same in the top tree), subroot, root, proof (siblings' digests from the leaf to the root; with ``proof_sha256`` only
    its digest), claimed, the leaf if ``found`` were the text, and the root that claimed and proof lead to."""
    kind = documents.schema["doc_id"].dataType
    columns = ["doc_id", "source", leaf_digest(F.col("text")).alias("digest")]
    claimed = leaf_digest(F.col("text") if found is None else found).alias("claimed")
    order = [F.col("source"), F.col("doc_id"), F.col("digest")]
    placed, sources = numbered_in_groups(sorted_rows(documents.select(*columns, claimed), order), "source")
    rounds = _rounds(staged(placed.withColumn("doc_id", F.col("doc_id").cast("string"))))

    trees = sources.count()
    subroots = rounds[-1].select(F.col("tree").alias("number"), F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("total"), "digest")
    top = _rounds(subroots)
    root = top[-1].first()
    nothing = top[-1].select("tree", "number", F.lit("").alias("suffix"), F.lit("").alias("subroot"))
    above = _down(top[:-1], nothing, is_top=True)
    # A source is a leaf of the top tree and the single node of its own.
    suffixes = above.select(F.col("number").alias("tree"), F.lit(0).cast("long").alias("number"), "suffix", "subroot")
    blocks = _blocks(rounds[0]).groupBy("tree", "block").cogroup(_down(rounds[1:-1], suffixes).groupBy("tree", "number"))
    proofs = blocks.applyInPandas(_leaf_block(trees, proof), f"{PROOFS}, {proof} string").withColumn("doc_id", F.col("doc_id").cast(kind))
    return proofs.withColumns({"trees": F.lit(trees).cast("long"), "root": F.lit(root.digest if root else None).cast("string")})


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tampered = F.when(number % TAMPER_EVERY == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proofs = manifest(table(spark, sf_dir, "documents"), tampered, "proof_sha256")
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::varchar || ':' || {f}, '-')" for f in fields) + ")"


def _levels_sql(name: str, leaves: str) -> str:
    """tree, level, number, total, digest of all nodes, and of each its place and siblings."""
    return f"""{name}_nodes(tree, level, number, total, digest) as (
            select tree, 0, number::bigint, total::bigint, digest from ({leaves})
            union all
            select tree, level + 1, number // 16, (max(total) + 15) // 16, sha256(string_agg(digest, '' order by number))
            from {name}_nodes where total > 1 group by tree, level, number // 16
        ), {name}_runs as (
            select tree, level, number // 16 as run, list(digest order by number) as digests
            from {name}_nodes where total > 1 group by tree, level, number // 16
        )"""


_PROOF_SQL = """select {key}, string_agg(array_to_string(list_concat(digests[1:place], digests[place + 2:]), ''), '' order by level) as proof,
                list(array_to_string(digests[1:place], '') order by level) as lefts,
                list(array_to_string(digests[place + 2:], '') order by level) as rights"""

ORACLE = {
    "op12_merkle_manifest": f"""
        with recursive {CRC_TABLE}, docs as (
            select doc_id, source, {_leaf_sql("text")} as digest, {_leaf_sql("tampered")} as claimed
            from (select *, case when {crc_of("doc_id::varchar")} % 5 = 0
                then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as tampered
                from documents, crc)
        ), placed as (
            select *, dense_rank() over (order by source nulls first) - 1 as tree, count(*) over (partition by source) as total,
                row_number() over (partition by source order by doc_id nulls first, digest, claimed) - 1 as number
            from docs
        ), {_levels_sql("leaf", "select * from placed")},
        {_levels_sql("top", "select 0 as tree, tree as number, count(*) over () as total, digest from leaf_nodes where total = 1")},
        steps as (
            select p.tree, p.number, r.level, r.digests, (p.number // (16 ** r.level)::bigint) % 16 as place
            from placed p join leaf_runs r on p.tree = r.tree and p.number // (16 ** (r.level + 1))::bigint = r.run
            union all
            select p.tree, p.number, 100 + r.level, r.digests, (p.tree // (16 ** r.level)::bigint) % 16
            from placed p join top_runs r on p.tree // (16 ** (r.level + 1))::bigint = r.run
        ), proofs as ({_PROOF_SQL.format(key="tree, number")} from steps group by tree, number
        ), folds(tree, number, k, digest, lefts, rights) as (
            select tree, number, 1, claimed, lefts, rights from placed left join proofs using (tree, number)
            union all
            select tree, number, k + 1, sha256(lefts[k] || digest || rights[k]), lefts, rights from folds where k <= len(lefts)
        ), last as (select tree, number, arg_max(digest, k) as folded_root from folds group by tree, number)
        select doc_id, p.digest as leaf, s.digest as subroot, r.digest as root, sha256(coalesce(proof, '')) as proof_sha256, folded_root,
            folded_root = r.digest as verified
        from placed p join last using (tree, number) left join proofs using (tree, number)
            join leaf_nodes s on s.tree = p.tree and s.total = 1 join top_nodes r on r.total = 1
    """
}
