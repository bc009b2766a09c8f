"""Near duplicates: minhash with tensored banding, confirmed on full shingle sets.

Two collections of `tables` elements, each of `depth` minhash values, are computed per
set: 2 * tables * depth values. Every pair of an element of the first and one of the second
collection is a table key, so tables * tables keys come from a number of minhash values that
grows only with their square root. At similarity 0.8, depth 3 and 12 elements a pair
shares no key with probability 0.0004.

Sets that are equal are one node from the start. Elements that only one node has are
dropped before pairs are formed. Confirmation works in two steps without ever listing the
pairs of a group:

1. Each node meets one hub: of the nodes that share a key with it and have the most keys,
   the one with which it shares most. Confirmed links give components.
2. In every key whose nodes are still in several components, each node outside of the
   most frequent one is sent to all blocks, of about `block` nodes each, of the components
   (with the nodes that met their hubs in vain) to which the key's nodes belong. Components are
   cut by the size of their sets first, into classes a link spans two neighbours of at most, and a node
   goes to its own class and those beside it. A block counts all intersections at once and
   returns at most one link for each node and component. So every pair that shares a key, lies
   in two components and has sizes that allow a link is compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.graph import components
from treeline.llm.store import lookup, parts, stored
from treeline.llm.words import buffer, inside, lowered, mix, release, slices, spans_hash, window_hashes, words

WIDTH = 5
PERCENT = 80
TABLES = 12
DEPTH = 3
BLOCK = 256
#: Homes of a key that travel as one row.
HOMES = 256
#: Nodes that one task compares with a block at a time.
PROBES = 1024


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each distinct shingle, by document and hash.

    A text of fewer than `width` words, but one at least, has its whole sequence as the only one.
    """
    data, offsets = buffer(texts)
    starts, ends, counts = words(data, offsets)
    each = spans_hash(lowered(data), starts, ends)
    at, doc = inside(counts, width)
    hashes = window_hashes(each, width)[at]
    lengths = np.diff(counts)
    few = np.flatnonzero((lengths > 0) & (lengths < width))
    short = np.zeros(len(few), dtype=np.uint64)
    for n in range(1, width):
        own = lengths[few] == n
        if own.any():
            short[own] = mix(window_hashes(each, n)[counts[few[own]]] + np.uint64(n))
    hashes, doc = np.concatenate([hashes, short]), np.concatenate([doc, few])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[first], doc[first]


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return base[:n] | np.uint64(1), base[n:]


def elements(hashes: np.ndarray, firsts: np.ndarray, tables: int, depth: int) -> np.ndarray:
    """One row per document with shingles: 2 * tables hashes of `depth` minhash values each."""
    times, plus = _factors(2 * tables * depth)
    out = np.zeros((len(firsts), 2 * tables), dtype=np.uint64)
    for k in range(2 * tables):
        for d in range(depth):
            i = k * depth + d
            values = (hashes * times[i] + plus[i]) >> np.uint64(16)
            out[:, k] = mix(out[:, k] ^ np.minimum.reduceat(values, firsts))
    return out


def _sketch(width: int, tables: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 2 << 20):
                hashes, doc = shingles(part.column("text"), width)
                n = np.bincount(doc, minlength=part.num_rows)
                past = np.cumsum(n)
                full = n > 0
                firsts = (past - n)[full]
                keys = elements(hashes, firsts, tables, depth) if len(firsts) else np.zeros((0, 2 * tables), np.uint64)
                digests = [hashlib.blake2b(hashes[b - k: b], digest_size=16).digest() if k else None
                           for k, b in zip(n.tolist(), past.tolist())]
                at = np.concatenate(([0], np.cumsum(np.where(full, 2 * tables, 0))))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                ], ["doc_id", "n_shingles", "digest", "elements"])
        release()
    return run


def _confirm(width: int, percent: int):
    """Links of the nodes on the left with the nodes of a block on the right."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        node, comp = np.asarray(left.column("node")), np.asarray(left.column("comp"))
        other, other_comp = np.asarray(right.column("node")), np.asarray(right.column("comp"))
        found: list[tuple[int, int]] = []
        if len(node) and len(other):
            hashes, of = shingles(right.column("text"), width)
            size = np.bincount(of, minlength=len(other))
            order = np.argsort(hashes, kind="stable")
            hashes, of = hashes[order], of[order]
            batch = pa.Table.from_arrays([left.column("text")], ["text"]).combine_chunks().to_batches()
            row = 0
            for whole in batch:
                for part in slices(whole, "text", 4 << 20):
                    mine, whose = shingles(part.column("text"), width)
                    n = np.bincount(whose, minlength=part.num_rows)
                    low = np.searchsorted(hashes, mine, "left")
                    many = np.searchsorted(hashes, mine, "right") - low
                    past = np.cumsum(n)
                    for i in range(part.num_rows):
                        a, b = past[i] - n[i], past[i]
                        m, s = many[a:b], low[a:b]
                        hit = np.repeat(s - (np.cumsum(m) - m), m) + np.arange(m.sum())
                        both = np.bincount(of[hit], minlength=len(other))
                        near = 100 * both >= percent * (n[i] + size - both)
                        near &= (other_comp != comp[row + i]) & (n[i] > 0)
                        at = np.flatnonzero(near)
                        at = at[np.unique(other_comp[at], return_index=True)[1]]
                        found += [(int(node[row + i]), int(other[j])) for j in at]
                    row += part.num_rows
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([y for _, y in found], pa.int64())})
    return run


def _links(probes: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed (a, b): probes (node, comp, block) against members (node, comp, block).

    A block with many probes is spread over buckets, each with a copy of the members.
    """
    n = probes.groupBy("block").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("buckets"))
    spread = probes.join(n, "block").withColumn(
        "bucket", F.pmod(F.xxhash64("node"), F.col("buckets")).cast("int")).drop("buckets")
    copied = members.join(n, "block").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("buckets")
    sides = []
    for side in (spread, copied):
        whole = side.join(texts, "node")
        # New names of their own: both sides stem from the same tables.
        sides.append(whole.select(*(F.col(c).alias(c) for c in ("block", "bucket", "node", "comp", "text"))))
    left, right = (side.groupBy("block", "bucket") for side in sides)
    return left.cogroup(right).applyInArrow(_confirm(width, percent), "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                percent: int = PERCENT, tables: int = TABLES, depth: int = DEPTH,
                block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are in lower case A-Z; a set is the distinct shingles of `width` words, or the
    whole sequence of a shorter text. Two documents are linked when
    100 * |intersection| >= percent * |union|. component_id is the smallest id reachable.
    Null texts and texts without words have an empty set and are linked with nothing. Of
    rows that share an id all get the same component when their texts are equal; with
    different texts they stand for one another. A row without an id is kept and links nothing;
    it has the component of the rows with the same set, else null. An empty table gives an empty result;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = stored(rows.mapInArrow(
        _sketch(width, tables, depth),
        "doc_id bigint, n_shingles bigint, digest binary, elements array<bigint>"), "sketches")
    total, n_parts = sketches.count(), parts(docs)
    groups = stored(sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("elements").alias("elements"),
        F.first("n_shingles").alias("size")), "groups")
    comps = _components(rows, groups, width, percent, tables, block, n_parts)
    known = groups.select("digest", "node", "n").join(comps, "node", "left").select(
        "digest", F.coalesce("comp", "node").alias("comp"), "n", F.coalesce("comp", "node").alias("node_comp"),
        "node").where("n > 1 or comp <> node").select("digest", "comp", "n")
    out = lookup(sketches.drop("elements"), known, ["digest"], "n", total, n_parts)
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _keys(groups: DataFrame, tables: int, n_parts: int) -> DataFrame:
    """(key, node) for all table keys that at least two nodes have, with the key's nodes n."""
    each = groups.select("node", F.posexplode("elements").alias("slot", "value"))
    shared = each.groupBy("slot", "value").agg(F.count("*").alias("n")).where("n > 1")
    active = lookup(each, shared, ["slot", "value"], "n", 2 * tables * groups.count(), n_parts).where("n is not null")
    pair = F.struct("slot", "value")
    sides = active.groupBy("node").agg(
        F.collect_list(F.when(F.col("slot") < tables, pair)).alias("one"),
        F.collect_list(F.when(F.col("slot") >= tables, pair)).alias("two"))
    keys = stored(sides.select("node", F.explode("one").alias("x"), "two").select(
        "node", "x", F.explode("two").alias("y")).select(F.xxhash64("x", "y").alias("key"), "node"), "keys")
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return stored(lookup(keys, several, ["key"], "n", keys.count(), n_parts).where("n is not null"), "keys")


def _components(rows: DataFrame, groups: DataFrame, width: int, percent: int, tables: int,
                block: int, n_parts: int) -> DataFrame:
    """(node, comp) of every node whose component is larger than itself."""
    keys = _keys(groups, tables, n_parts)
    total = keys.count()
    degrees = stored(keys.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    texts = stored(rows.select(F.col("doc_id").alias("node"), "text").join(
        degrees.select("node"), "node", "left_semi"), "texts")

    # Step 1: the hub of each key, then the hub with which a node shares most keys.
    ranked = keys.join(degrees.select("node", "degree"), "node")
    hubs = ranked.groupBy("key").agg(
        F.max(F.struct("degree", -F.col("node"))).alias("h"), F.count("*").alias("n")).select(
        "key", (-F.col("h.col2")).alias("hub"), "n")
    met = lookup(keys.drop("n"), hubs, ["key"], "n", total, n_parts).where("hub <> node")
    shares = met.groupBy("node", "hub").agg(F.count("*").alias("shared"))
    best = shares.groupBy("node").agg(F.max(F.struct("shared", -F.col("hub"))).alias("b"))
    chosen = stored(best.select("node", F.col("node").alias("comp"), (-F.col("b.col2")).alias("block")), "chosen")
    members = chosen.select("block").distinct().select(
        F.col("block").alias("node"), F.col("block").alias("comp"), "block")
    first = stored(_links(chosen, members, texts, width, percent), "links")
    comps = components(first, "a", "b").select(F.col("hi").alias("node"), F.col("lo").alias("comp"))

    # Step 2: what is still apart within a key, against blocks of the key's nodes.
    # A node is at home with its component; one that is alone, with that of its hub. Homes
    # are cut into blocks at random.
    linked = degrees.select("node").join(chosen.select("node", F.col("block").alias("hub")), "node", "left").join(
        comps, "node", "left").withColumn("hub", F.coalesce("hub", "node"))
    hub_comp = comps.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp"))
    at_home = stored(linked.join(hub_comp, "hub", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("comp", "hub_comp", "hub").alias("home")), "homes")
    # Linked sets differ in size by 100 / percent at most; classes are a little wider than that.
    wide = math.log(101 / percent)
    sized = groups.select("node", F.floor(F.log(F.col("size").cast("double")) / wide).cast("int").alias("cls"))
    at_home = stored(at_home.join(sized, "node"), "homes")
    own = ["home", "cls"]
    large = at_home.groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") > block)
    part = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("n", F.lit(1)) / block))
    placed = stored(lookup(at_home, large, own, "n", at_home.count(), n_parts).select(
        "node", "comp", *own, F.xxhash64(*own, part).alias("block")), "placed")
    apart = keys.drop("n").join(placed.select("node", "comp", *own), "node")
    per_comp = apart.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = per_comp.groupBy("key").agg(
        F.max(F.struct("m", "comp")).alias("most"), F.count("*").alias("comps"), F.sum("m").alias("n")).where(
        "comps > 1").select("key", F.col("most.comp").alias("most"), "n")
    mixed = stored(lookup(apart, mixed, ["key"], "n", total, n_parts).where("most is not null"), "mixed")
    # First which homes a node has to see, then all their blocks: few homes have a key.
    homes = stored(mixed.select("key", "home", "cls").distinct(), "key_homes")
    per_key = homes.groupBy("key").agg(F.count("*").alias("n"))
    outside = mixed.where("comp <> most").select("key", "node", "comp", F.col("cls").alias("own_cls"))
    beside = F.abs(F.col("cls") - F.col("own_cls")) <= 1
    # The homes of a key travel as one row, and a node's homes from all its keys meet in one set; a key
    # with more of them than such a row should hold gives its homes one by one.
    few = homes.join(per_key.where(F.col("n") <= HOMES), "key").groupBy("key").agg(
        F.collect_list(F.struct("home", "cls")).alias("homes"))
    packed = outside.join(few, "key").select("node", "comp", F.filter(
        "homes", lambda h: F.abs(h["cls"] - F.col("own_cls")) <= 1).alias("homes"))
    packed = packed.groupBy("node", "comp").agg(F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes"))
    packed = packed.select("node", "comp", F.explode("homes").alias("h")).select("node", "comp", "h.home", "h.cls")
    many = homes.join(per_key.where(F.col("n") > HOMES).select("key"), "key")
    single = outside.join(many, "key").where(beside).select("node", "comp", "home", "cls")
    sees = packed.unionByName(single).distinct()
    probes = stored(sees.join(placed.select(*own, "block").distinct(), own).select(
        "node", "comp", "block"), "probes")
    held = placed.join(probes.select("block").distinct(), "block", "left_semi").select("node", "comp", "block")
    second = _links(probes, held, texts, width, percent)
    comp_of = placed.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    joined = second.join(comp_of, "b").join(
        placed.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), "a").select("comp_a", "comp_b")
    merged = components(joined, "comp_a", "comp_b").select(F.col("hi").alias("comp"), F.col("lo").alias("to"))
    return placed.join(merged, "comp", "left").select(
        "node", F.coalesce("to", "comp").alias("comp")).where("comp <> node")
