"""Prefix trie of conversations: shared beginnings and what storing them once saves.

Method: a node is known by a 128-bit fingerprint of its turns, a running xor of turn
hashes mixed with their depth; numbering and running sums go by pieces of a
range-partitioned table, so a conversation of any length spreads over tasks. Along a
path, nodes with the same members form a chain, and the smallest member and the number
of members name it. One row per conversation lists the chains of its path. Sorted, these
rows are the trie in preorder; ranges of them are shards. A shard writes its part as
balanced parentheses: find_close delimits subtrees, rank over pairs "()" counts leaves,
cumulative arrays give savings. Chains on the spines, the first and last path of a
shard, may go on in other shards; their partial numbers are added up afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvebeacon.llm.common import Scratch, scratch
from cvebeacon.llm.parentheses import Parentheses
from cvebeacon.operators.skew import lookup_join

_EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    """Conversation c begins with the first turns of conversation c - c % ``group``.

    ``most`` is one more than the largest number of turns taken over; ``rows`` and
    ``chains`` bound what one task sorts or encodes.
    """

    group: int = 20
    most: int = 4
    rows: int = 200_000
    chains: int = 500_000


def _parts(df: DataFrame, rows: int, count: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // rows))


# ---- turns -------------------------------------------------------------------


def _ordered(work: Scratch, rows: DataFrame, how: Trie, names: dict[str, str]) -> DataFrame:
    """conv, turn, id, words, part: turns in ranges of (conv, turn, id)."""
    role, text = (F.coalesce(F.col(names[k]).cast("string"), F.lit("")) for k in ("role", "text"))
    turns = rows.select(
        F.col(names["conv_id"]).cast("long").alias("conv"),
        F.col(names["turn"]).cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    ).where("conv is not null")
    ranged = turns.repartitionByRange(_parts(rows, how.rows, rows.count()), "conv", "turn", "id")
    return work.table(ranged.withColumn("part", F.spark_partition_id()), "ordered")


def _taken(c: Column, how: Trie) -> Column:
    """How many turns of the group's first conversation stand at the beginning."""
    return (F.crc32(c.cast("string").cast("binary")) % how.most).cast("int")


def _rebuilt(work: Scratch, ordered: DataFrame, how: Trie) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, part, d from 1, id, words) and conversations (conv, n_turns)."""
    by_part = Window.partitionBy("conv").orderBy("part")
    pieces = work.table(
        ordered.groupBy("conv", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(by_part) - F.col("n")),
        "pieces",
    )
    first = Window.partitionBy("conv").orderBy("turn", "id")
    heads = (
        ordered.where(F.col("conv") % how.group == 0)
        .withColumn("at", F.row_number().over(first))
        .where(F.col("at") < how.most)
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "id", "words"))).alias("head"))
    )
    convs = (
        pieces.groupBy("conv")
        .agg(F.sum("n").alias("n"))
        .withColumn("base", F.col("conv") - F.col("conv") % how.group)
        .withColumn("h", _taken(F.col("conv"), how))
        .join(heads, "base", "left")
        .withColumn("nb", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    )
    convs = work.table(
        convs.select(
            "conv", "h", "nb", F.slice("head", F.lit(1), F.col("nb")).alias("head"),
            (F.col("n") - F.least("n", "h") + F.col("nb")).alias("n_turns"),
        ),
        "convs",
    )
    inside = Window.partitionBy("conv", "part").orderBy("turn", "id")
    placed = pieces.select("conv", "part", "before").join(convs.select("conv", "h", "nb"), "conv")
    own = (
        ordered.withColumn("at", F.row_number().over(inside))
        .join(placed, ["conv", "part"])
        .withColumn("at", F.col("before") + F.col("at"))
        .where("at > h")
        .select("conv", "part", (F.col("at") - F.col("h") + F.col("nb")).alias("d"), "id", "words")
    )
    begun = convs.select("conv", F.lit(-1).alias("part"), F.inline("head")).select(
        "conv", "part", F.col("at").cast("long").alias("d"), "id", "words"
    )
    return begun.unionByName(own), convs.select("conv", "n_turns")


def _fingerprints(work: Scratch, turns: DataFrame) -> DataFrame:
    """conv, d, words, f1, f2 (prefix), cum (words of the prefix), ends (the last turn)."""
    running = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    mixed = turns.select(
        "*", F.xxhash64(F.lit(1), "id", "d").alias("m1"), F.xxhash64(F.lit(2), "id", "d").alias("m2")
    )
    local = work.table(
        mixed.select(
            "conv", "part", "d", "words",
            F.bit_xor("m1").over(running).alias("f1"), F.bit_xor("m2").over(running).alias("f2"),
            F.sum("words").over(running).alias("cum"),
        ),
        "local",
    )
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = local.groupBy("conv", "part").agg(
        F.max_by(F.struct("f1", "f2", "cum"), "d").alias("x"), F.max("d").alias("d")
    )
    before = last.select(
        "conv", "part",
        F.coalesce(F.bit_xor("x.f1").over(earlier), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("x.f2").over(earlier), F.lit(0)).alias("b2"),
        F.coalesce(F.sum("x.cum").over(earlier), F.lit(0)).alias("b3"),
        F.max("d").over(Window.partitionBy("conv")).alias("end"),
    )
    prefixes = local.join(before, ["conv", "part"]).select(
        "conv", "d", "words",
        F.col("f1").bitwiseXOR(F.col("b1")).alias("f1"),
        F.col("f2").bitwiseXOR(F.col("b2")).alias("f2"),
        (F.col("cum") + F.col("b3")).alias("cum"),
        (F.col("d") == F.col("end")).alias("ends"),
    )
    found = work.table(prefixes, "prefixes")
    work.drop(local)
    return found


# ---- shards ------------------------------------------------------------------


def encode_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the chains of one shard; the row without owner is the root's share.

    A row is a conversation and the chains of its path. Those of other owners are
    open already, or stand on the left spine of the shard; its own begin here.
    """
    owners, members, savings, own, leaf, parents = [], [], [], [], [], []
    open_chains: list[int] = []
    counts: list[int] = []
    spine: set[int] = set()
    for batch in batches:
        for conv, path in zip(batch["conv"].to_pylist(), batch["path"].to_pylist(), strict=True):
            old = sum(1 for x in path if x["o"] != conv)
            begin = old if owners else 0
            counts += [len(open_chains) - begin, len(path) - begin]
            del open_chains[begin:]
            for i in range(begin, len(path)):
                x = path[i]
                if i < old:
                    spine.add(len(owners))
                parents.append(open_chains[-1] if open_chains else -1)
                open_chains.append(len(owners))
                owners.append(x["o"])
                members.append(x["m"])
                savings.append(x["saving"] if i >= old else 0)
                own.append(i >= old)
                leaf.append(x["leaf"])
    counts += [len(open_chains)]
    spine.update(open_chains)
    n = len(owners)
    bits = np.repeat(np.arange(len(counts)) % 2, counts)
    tree = Parentheses(bits)
    at = np.flatnonzero(bits)
    close = tree.find_close(at)
    pairs = np.zeros(len(bits) + 1, np.int64)
    if n:
        pair = (bits[:-1] == 1) & (bits[1:] == 0)
        # The last path may go on in the next shard: its end is a leaf only if nothing follows.
        last = at[-1]
        pair[last] &= leaf[-1]
        pairs[1 : len(bits)] = np.cumsum(pair)
        pairs[len(bits)] = pairs[len(bits) - 1]
    saved = np.concatenate([[0], np.cumsum(np.array(savings, np.int64))])
    first = tree.rank_open(at)
    after = tree.rank_open(close)
    children = np.zeros(n + 1, np.int64)
    # The last place, -1, stands for the root.
    np.add.at(children, np.array(parents, np.int64), np.array(own, np.int64))
    own_parent = [owners[p] if p >= 0 and o else None for p, o in zip(parents, own, strict=True)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([*owners, None], pa.int64()),
            pa.array([*members, None], pa.int64()),
            pa.array([*own_parent, None], pa.int64()),
            pa.array(np.append(pairs[close] - pairs[at], pairs[-1])),
            pa.array(np.append(saved[after] - saved[first], saved[-1])),
            pa.array(children),
            pa.array([i in spine for i in range(n)] + [True]),
        ],
        names=["o", "m", "parent", "leaves", "saved", "children", "spine"],
    )


_SHARD = "o long, m long, parent long, leaves long, saved long, children long, spine boolean"


def _chains(work: Scratch, nodes: DataFrame, how: Trie) -> DataFrame:
    """o, m (minus the number of members), parent, leaves, saved, children; the root without o."""
    on_path = work.table(
        nodes.groupBy("conv", "o", "n").agg(
            F.sum("words").alias("words"),
            F.max("e").alias("e"),
        ),
        "on_path",
    )
    entry = F.struct(
        "o",
        (-F.col("n")).alias("m"),
        ((F.col("n") - 1) * F.col("words")).alias("saving"),
        (F.col("e") == F.col("n")).alias("leaf"),
    )
    # The owner changes to ever larger ones and the members get fewer: sorted is path order.
    paths = (
        on_path.groupBy("conv")
        .agg(F.sort_array(F.collect_list(entry)).alias("path"))
        .where(F.element_at("path", -1)["o"] == F.col("conv"))
    )
    shards = _parts(nodes, how.chains, on_path.count())
    encoded = work.table(
        paths.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(encode_shard, _SHARD),
        "shards",
    )
    merged = (
        encoded.where("spine")
        .groupBy("o", "m")
        .agg(*[f(c).alias(c) for c, f in (("parent", F.max), ("leaves", F.sum), ("saved", F.sum), ("children", F.sum))])
    )
    return merged.unionByName(encoded.where("not spine").drop("spine"))


# ---- digests of ids ------------------------------------------------------------


def _digest_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of groups that lie inside this range; the ids of the first and last group."""
    block = TaskContext.get().partitionId()
    key, ids, first, done = None, [], True, []

    def row(whole: bool) -> tuple:
        text = ",".join(map(str, ids))
        return (*key, block, None if whole else text, hashlib.sha256(text.encode()).hexdigest() if whole else None)

    for batch in batches:
        for o, m, conv in zip(*(batch[c].to_pylist() for c in ("o", "m", "conv")), strict=True):
            if key != (o, m):
                if key is not None:
                    done.append(row(whole=not first))
                    first = False
                key, ids = (o, m), []
            ids.append(conv)
        yield _id_rows(done)
        done = []
    if key is not None:
        yield _id_rows([row(whole=False)])


def _id_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["o", "m", "block", "ids", "digest"]
    )


def _digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of groups that span ranges, their blocks fed one after the other."""
    key, state = None, None
    for batch in batches:
        done = []
        for o, m, ids in zip(*(batch[c].to_pylist() for c in ("o", "m", "ids")), strict=True):
            if key != (o, m):
                if key is not None:
                    done.append((*key, 0, None, state.hexdigest()))
                key, state = (o, m), hashlib.sha256(ids.encode())
            else:
                state.update(("," + ids).encode())
        yield _id_rows(done)
    if key is not None:
        yield _id_rows([(*key, 0, None, state.hexdigest())])


def _digests(work: Scratch, ends: DataFrame, how: Trie) -> DataFrame:
    """SHA-256 of the ids of each group (o, m), ascending and joined by commas.

    A hash runs from the first byte to the last, so one task makes each digest; of a
    group of any size it gets one row per range of ids and holds one at a time.
    """
    schema = "o long, m long, block int, ids string, digest string"
    ends = work.table(ends, "ends")
    ranges = _parts(ends, how.rows, ends.count())
    ranged = work.table(
        ends.repartitionByRange(ranges, "o", "m", "conv")
        .sortWithinPartitions("o", "m", "conv")
        .mapInArrow(_digest_ranges, schema),
        "ranges",
    )
    spanning = (
        ranged.where("ids is not null")
        .repartition("o", "m")
        .sortWithinPartitions("o", "m", "block")
        .mapInArrow(_digest_blocks, schema)
    )
    return ranged.where("digest is not null").unionByName(spanning).select("o", "m", "digest")


# ---- the trie ------------------------------------------------------------------


def prefix_trie(
    rows: DataFrame,
    how: Trie = Trie(),
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root with depth 0.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns go by number, null first, turns of one number by the
    MD5 of role length, role and text; repeated rows are turns of their own. Null roles
    and texts are empty. Rows without conversation id are left out. ``%`` has the sign
    of the id, as in SQL. Extra columns are not read. Without conversations there is no
    root and the result is empty.
    """
    spark = rows.sparkSession
    with scratch(spark, "trie") as work:
        ordered = _ordered(work, rows, how, {"conv_id": conv_id, "turn": turn, "role": role, "text": text})
        turns, convs = _rebuilt(work, ordered, how)
        prefixes = _fingerprints(work, turns)
        work.drop(ordered)
        named = prefixes.groupBy("f1", "f2").agg(
            F.count("*").alias("n"), F.min("conv").alias("o"), F.count_if("ends").alias("e")
        )
        # Fingerprints of many conversations do not meet in one task.
        named = work.table(named.withColumn("rows", F.col("n")), "named")
        nodes = work.table(
            lookup_join(prefixes, named, ["f1", "f2"], "inner", weight="rows").drop("f1", "f2"), "nodes"
        )
        work.drop(prefixes)
        work.drop(named)
        chains = work.table(_chains(work, nodes, how), "chains")
        nothing = convs.where("n_turns = 0").select(
            F.lit(None).cast("long").alias("o"), F.lit(None).cast("long").alias("m"), "conv"
        )
        ends = nodes.where("ends").select("o", (-F.col("n")).alias("m"), "conv").unionByName(nothing)
        digests = work.table(_digests(work, ends, how), "digests")
        own = nodes.where("conv = o")
        spans = own.groupBy("o", "n").agg(
            F.min("d").alias("top"), F.max("d").alias("bottom"), F.min(F.col("cum") - F.col("words")).alias("above")
        )
        known = spans.withColumn("m", -F.col("n")).join(chains, ["o", "m"]).join(digests, ["o", "m"], "left")
        known = work.table(
            known.select(
                F.col("o").alias("conv"), "n", "parent", "leaves", "saved", "children", "top", "bottom", "above",
                "digest", (F.col("bottom") - F.col("top") + 1).alias("rows"),
            ),
            "known",
        )
        count, smallest = convs.agg(F.count("*"), F.min("conv")).first()
        at_top, at_bottom = F.col("d") == F.col("top"), F.col("d") == F.col("bottom")
        below_root = lookup_join(own.select("conv", "d", "n", "words", "cum"), known, ["conv", "n"], "inner", weight="rows")
        inner = below_root.select(
            F.col("conv").alias("conv_id"),
            F.col("d").cast("long").alias("depth"),
            F.when(at_top, F.coalesce("parent", F.lit(smallest).cast("long"))).otherwise(F.col("conv")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(at_bottom, F.col("children")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("saved") - (F.col("n") - 1) * (F.col("cum") - F.col("words") - F.col("above"))).alias("saved_tokens"),
            F.coalesce(F.when(at_bottom, F.col("digest")), F.lit(_EMPTY)).alias("ends_sha256"),
        )
        # Without any turn no shard wrote the root's share.
        shares = chains.where("o is null").agg(
            F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"),
            F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
            F.coalesce(F.sum("children"), F.lit(0)).alias("children"),
        )
        ended = digests.where("o is null").agg(F.max("digest").alias("digest"))
        root = shares.join(F.broadcast(ended)).where(F.lit(count > 0)).select(
            F.lit(smallest).cast("long").alias("conv_id"),
            F.lit(0).cast("long").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"),
            F.lit(count).cast("long").alias("n_convs"),
            F.col("children").alias("n_children"),
            F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("digest", F.lit(_EMPTY)).alias("ends_sha256"),
        )
        return work.table(inner.unionByName(root), "result", keep=True)
