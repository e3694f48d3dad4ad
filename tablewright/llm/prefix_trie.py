"""The trie of conversation prefixes, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of turns, found by running sums of turn hashes that also depend on
the place; no conversation is ever one value. Every node has an arc that enters its subtree and one
that leaves it. The arcs form one list, whose order is found by distributed list ranking: blocks of
neighbouring arcs contract their chains, what is left is dealt to blocks again, and positions are
handed back down. Weights are summed on the way, so each arc gets the leaves and the savings before
it; a subtree's are those between its two arcs.

Long groups (a conversation, the children of a node) are cut into ranges of bounded size by a global
order; a window runs in a range, and ranges hand on one row each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.store import written

RANGE_ROWS = 200_000  # rows of a range
BLOCK_ARCS = 100_000  # arcs of a block of list ranking
DEPTHS = 4096  # turns whose hashes one window sums
ENDS = 12  # bits of the conversation ids that one row of ends holds
LANES = 4
WEIGHTS = ("arcs", "leaves", "saved")


def ranged(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` stored with ``part``: the number of its range in the order of ``keys``."""
    parts = max(1, math.ceil(df.count() / RANGE_ROWS))
    return written(df.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), name)


def running_sums(df: DataFrame, group: list[str], block: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add the sums of columns over the rows of the group up to and with each; ``sums`` names them.

    Windows run inside blocks; a group hands on one row per block.
    """
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, block).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    carried = totals.select(*group, block, *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums])
    carried = carried.where(" or ".join(f"_{n} is not null" for n in sums))
    out = df.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(carried, [*group, block], "left")
    return out.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in sums}).drop(*[f"_{n}" for n in sums])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, place, digest, bytes`` of the turns of conversations (``conv_id, turn, role, text``).

    Turns are ordered by ``turn``, null first, then by the digest of role and text; null roles and
    texts are empty. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    folded = turns.groupBy("conv", "turn", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    placed = running_sums(ranged(written(folded, "turns"), ["conv", "turn", "digest"], "ranged-turns"), ["conv"], "part", ["turn", "digest"], {"until": "n"})
    place = F.explode(F.sequence(F.col("until") - F.col("n") + 1, F.col("until")))
    return written(placed.select("conv", place.alias("place"), "digest", "bytes"), "numbered-turns")


def rebuilt(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``(turns, conversations)`` after each conversation c got the first h turns of c - c % ``family`` for its own.

    h is crc32 of c in decimal, modulo ``most``. The turns have ``conv, depth, digest, bytes, length``,
    the conversations ``conv, length``.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = turns.groupBy("conv").agg(F.max("place").alias("n")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family})
    first = turns.where(F.col("place") < most)
    held = first.groupBy(F.col("conv").alias("base")).agg(F.max("place").alias("held"))
    taken = F.least("h", F.coalesce("held", F.lit(0)))
    facts = own.join(held, "base", "left").withColumn("taken", taken)
    facts = written(facts.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "rebuilt-facts")
    borrowed = first.withColumnRenamed("conv", "base").join(facts.where("h > 0").select("base", "conv", "h", "length"), "base").where("place <= h")
    kept = turns.join(facts.select("conv", "h", "taken", "length"), "conv").where("place > h")
    columns = ["digest", "bytes", "length"]
    rows = borrowed.select("conv", F.col("place").alias("depth"), *columns).unionByName(
        kept.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), *columns)
    )
    return rows, facts.select("conv", "length")


def _key(sums: list[Column]) -> Column:
    return F.concat_ws("-", *[F.hex(s) for s in sums])


def prefix_nodes(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, ends)`` of the trie of turns ``conv, depth, digest, bytes, length``.

    Nodes have ``depth, key, parent_key, conv`` (smallest member), ``n_convs, bytes``; ends name the
    node at which a conversation ends.
    """
    hashed = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    lanes = {f"x{i}": F.conv(F.substring("hash", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LANES)}
    block = F.floor((F.col("depth") - 1) / DEPTHS)
    rows = written(turns.withColumn("hash", hashed).select("conv", "depth", "bytes", "length", block.alias("block"), *[c.alias(n) for n, c in lanes.items()]), "lanes")
    summed = running_sums(rows, ["conv"], "block", ["depth"], {f"s{i}": f"x{i}" for i in range(LANES)})
    key, parent = _key([F.col(f"s{i}") for i in range(LANES)]), _key([F.col(f"s{i}") - F.col(f"x{i}") for i in range(LANES)])
    keyed = written(summed.select("conv", "depth", "bytes", "length", key.alias("key"), parent.alias("parent_key")), "prefixes")
    inner = keyed.groupBy("depth", "key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes")
    )
    none = _key([F.lit(0).cast("long")] * LANES)
    root = conversations.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), none.alias("key"), F.lit(None).cast("string").alias("parent_key"), "conv", "n_convs", F.lit(0).cast("long").alias("bytes"))
    turnless = conversations.where("length = 0").select("conv", F.lit(0).cast("long").alias("depth"), none.alias("key"))
    ends = keyed.where("depth = length").select("conv", "depth", "key").unionByName(turnless)
    return written(inner.unionByName(root), "nodes"), ends


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, key, ends_sha256``: the digest of the conversations that end at a node, in decimal, by number, with commas.

    Such a digest runs over one text from its start to its end, however long; so the ids of a node are
    joined in ranges first, and pass through one task in order, of which it holds one row at a time.
    """
    chunk = ends.groupBy("depth", "key", F.shiftright("conv", ENDS).alias("chunk")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    told = chunk.select("depth", "key", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        done: list[tuple] = []

        def sent() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["depth", "key", "ends_sha256"])

        for batch in batches:
            for depth, key, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if at == (depth, key):
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (depth, key), hashlib.sha256(ids.encode())
            if len(done) >= 10_000:
                yield sent()
                done.clear()
        if at is not None:
            done.append((*at, digest.hexdigest()))
            yield sent()

    dealt = told.repartition("depth", "key").sortWithinPartitions("depth", "key", "chunk")
    return dealt.mapInArrow(digested, "depth long, key string, ends_sha256 string")


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent`` (its ``conv``), ``n_children``, and the ``conv`` of the first child and the next sibling.

    Siblings follow each other by their smallest member. A node is named by that and its depth.
    """
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv").alias("parent"))
    placed = written(nodes.join(above, ["depth", "parent_key"], "left"), "placed-nodes")
    inner = ranged(placed.where("depth > 0").select("parent", "depth", "conv"), ["parent", "depth", "conv"], "siblings")
    here = Window.partitionBy("part", "parent", "depth").orderBy("conv")
    starts = inner.groupBy("parent", "depth", "part").agg(F.min("conv").alias("start"))
    following = starts.withColumn("after", F.lead("start").over(Window.partitionBy("parent", "depth").orderBy("part"))).where("after is not null")
    next_one = inner.withColumn("next", F.lead("conv").over(here)).join(following.drop("start"), ["parent", "depth", "part"], "left")
    siblings = next_one.select("conv", "depth", F.coalesce("next", "after").alias("next"))
    children = placed.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"))
    families = children.agg(F.count(F.lit(1)).alias("n_children"), F.min("conv").alias("child"))
    whole = placed.join(families, ["conv", "depth"], "left").join(siblings, ["conv", "depth"], "left")
    return written(whole.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "linked-nodes")


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs of linked nodes: ``conv, arc`` (twice the depth, one more to leave), the next arc, and weights."""
    arc = 2 * F.col("depth")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    down = F.col("child").isNotNull()
    enter = nodes.select(
        "conv",
        arc.alias("arc"),
        F.coalesce("child", "conv").alias("to_conv"),
        F.when(down, arc + 2).otherwise(arc + 1).alias("to_arc"),
        one.alias("arcs"),
        F.when(down, zero).otherwise(one).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    on = F.col("next").isNotNull()
    leave = nodes.select(
        "conv",
        (arc + 1).alias("arc"),
        F.coalesce("next", "parent").alias("to_conv"),
        F.when(on, arc).when(F.col("depth") > 0, arc - 1).alias("to_arc"),
        one.alias("arcs"),
        zero.alias("leaves"),
        zero.alias("saved"),
    )
    return enter.unionByName(leave)


ITEM = ["conv", "arc", "to_conv", "to_arc", *WEIGHTS]
DONE = ["conv", "arc", "head_conv", "head_arc", *[f"before_{w}" for w in WEIGHTS], "to_conv", "to_arc", *WEIGHTS]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of items whose next item lies in the same block, as ``DONE``.

    Of every item the head of its chain and the weights between; of a head also those of the whole chain and what follows it.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    n = whole.num_rows
    conv, arc = (whole.column(c).to_numpy() for c in ("conv", "arc"))
    last = whole.column("to_arc").is_null().to_numpy(zero_copy_only=False)
    to_conv, to_arc = (whole.column(c).fill_null(-1).to_numpy() for c in ("to_conv", "to_arc"))
    weights = np.stack([whole.column(c).to_numpy() for c in WEIGHTS])
    convs, at = np.unique(conv, return_inverse=True)
    span = int(arc.max()) + 1
    own = at * span + arc
    other = np.minimum(np.searchsorted(convs, to_conv), len(convs) - 1)
    wanted = np.where(~last & (convs[other] == to_conv) & (to_arc < span), other * span + to_arc, -1)
    order = np.argsort(own)
    found = order[np.minimum(np.searchsorted(own[order], wanted), n - 1)]
    inside = own[found] == wanted
    ahead, summed = np.arange(n), np.zeros_like(weights)
    ahead[found[inside]] = np.flatnonzero(inside)  # of each item the one before
    summed[:, found[inside]] = weights[:, inside]
    while True:
        further = ahead[ahead]
        if (further == ahead).all():
            break
        summed, ahead = summed + summed[:, ahead], further
    head = ahead == np.arange(n)
    totals = np.zeros_like(weights)
    for w, t in zip(weights, totals, strict=True):
        np.add.at(t, ahead, w)
    tail = np.empty(n, np.int64)
    tail[ahead[~inside]] = np.flatnonzero(~inside)
    out = [conv, arc, conv[ahead], arc[ahead], *summed]
    end = whole.select(["to_conv", "to_arc"]).take(pa.array(np.where(head, tail, 0)))
    columns = [pa.array(c) for c in out]
    columns += [pa.array(end.column(c).to_numpy(zero_copy_only=False), pa.int64(), mask=~head | end.column(c).is_null().to_numpy(zero_copy_only=False), from_pandas=True) for c in ("to_conv", "to_arc")]
    columns += [pa.array(t, mask=~head) for t in totals]
    yield pa.RecordBatch.from_arrays(columns, names=DONE)


def mated(items: DataFrame, turn: int) -> DataFrame:
    """Pairs contracted by coins: an item with heads takes in the next one if that has tails; as ``DONE``."""
    coin = lambda c, a: F.xxhash64(c, a, F.lit(turn)).bitwiseAND(F.lit(1))
    second = items.where(coin("conv", "arc") == 0).select(*[F.col(c).alias(f"n_{c}") for c in ITEM])
    first = items.where(coin("conv", "arc") == 1)
    pairs = written(first.join(second, (F.col("to_conv") == F.col("n_conv")) & (F.col("to_arc") == F.col("n_arc"))), "mates")
    taken = pairs.select(
        F.col("n_conv").alias("conv"), F.col("n_arc").alias("arc"), F.col("conv").alias("head_conv"), F.col("arc").alias("head_arc"),
        *[F.col(w).alias(f"before_{w}") for w in WEIGHTS], *[F.lit(None).cast("long").alias(c) for c in ("to_conv", "to_arc", *WEIGHTS)],
    )
    met = pairs.select("conv", "arc", F.lit(True).alias("met"), "n_to_conv", "n_to_arc", *[f"n_{w}" for w in WEIGHTS])
    single = items.join(taken.select("conv", "arc"), ["conv", "arc"], "left_anti").join(met, ["conv", "arc"], "left")
    heads = single.select(
        "conv", "arc", F.col("conv").alias("head_conv"), F.col("arc").alias("head_arc"), *[F.lit(0).cast("long").alias(f"before_{w}") for w in WEIGHTS],
        *[F.when(F.col("met"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("to_conv", "to_arc")],
        *[(F.col(w) + F.coalesce(f"n_{w}", F.lit(0))).alias(w) for w in WEIGHTS],
    )
    return taken.unionByName(heads)


def list_ranked(items: DataFrame) -> DataFrame:
    """``conv, arc`` and the weights before each item of the one list that the items (``ITEM``) form.

    Blocks of neighbours by name contract their chains until one is left. Where that leaves more
    than half of the items, the next round pairs them by coins, which shrinks any list.
    """
    schema = ", ".join(f"{c} long" for c in DONE)
    rounds: list[DataFrame] = []
    left, stuck = items.count(), False
    while left:
        blocks = math.ceil(left / BLOCK_ARCS)
        if stuck:
            done = mated(items, len(rounds))
        else:
            dealt = items.select(*ITEM)
            dealt = dealt.repartitionByRange(blocks, "conv", "arc") if blocks > 1 else dealt.coalesce(1)
            done = dealt.mapInArrow(contract, schema)
        rounds.append(written(done, "tour-round"))
        items = rounds[-1].where("arcs is not null").select(*ITEM)
        before, left = left, items.count()
        if left == 1:
            break
        stuck = blocks > 1 and not stuck and 2 * left > before
    if not rounds:
        return items.select("conv", "arc", *[F.col(w).alias(f"before_{w}") for w in WEIGHTS])
    names = ["conv", "arc", *[f"before_{w}" for w in WEIGHTS]]
    ranks = rounds[-1].select(*names)
    for done in reversed(rounds[:-1]):
        above = ranks.select(F.col("conv").alias("head_conv"), F.col("arc").alias("head_arc"), *[F.col(f"before_{w}").alias(f"up_{w}") for w in WEIGHTS])
        joined = done.select(*names, "head_conv", "head_arc").join(above, ["head_conv", "head_arc"])
        ranks = joined.select("conv", "arc", *[(F.col(f"before_{w}") + F.col(f"up_{w}")).alias(f"before_{w}") for w in WEIGHTS])
    return ranks


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are tables of ``conv_id, turn, role, text``; ``rebuilt`` says how they share turns.
    A node's ``conv_id`` is its smallest member; ``saved_tokens`` are the bytes of last turns that
    members after the first have in common, over the subtree. Turns of equal number are ordered by a
    digest, repeated rows are turns of their own, null roles and texts are empty, rows without
    ``conv_id`` are left out, as are other columns; no conversation gives no node.
    """
    turns, convs = rebuilt(numbered_turns(conversations), family, most)
    nodes, ends = prefix_nodes(turns, convs)
    linked = linked_nodes(nodes)
    ranks = list_ranked(tour(linked))
    side = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    sums = ranks.groupBy("conv", F.floor(F.col("arc") / 2).alias("depth")).agg(*[F.sum(side * F.col(f"before_{w}")).alias(w) for w in ("leaves", "saved")])
    told = linked.join(sums, ["conv", "depth"]).join(ends_digests(ends), ["depth", "key"], "left")
    return told.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
