"""Conversation prefix trie with rollups by centroid decomposition.

Turns get their place in their conversation, the head of a conversation is
taken from another one where asked for (``rebuilt``), and every prefix of a
conversation is named by its depth and the running XOR of 128-bit hashes of
(place, role, text).  A node of the trie is a distinct prefix; (smallest member,
depth) is its id, and the ancestor of a node at depth k is the node of its
smallest member at depth k, so any ancestor is one lookup by (conversation,
depth).

``rollup`` sums node weights over subtrees on the forest of parent edges.  It
begins with the whole tree as one component.  While a component has more than
``LOCAL`` nodes:

* its centroid z is the deepest node with at least half of the component's
  nodes below or at it; z's ancestors in the component are just its nodes with
  at least half, for two separate subtrees cannot both hold half;
* the total of z's part is summed and added to z and along the path from z to
  the component's top;
* z is taken out: the subtrees of its children and the rest above it are new
  components of at most half the nodes.

So the rounds grow with the logarithm of the nodes, however deep the trie is
and however many children a node has.  Components of ``LOCAL`` nodes or fewer
are split further in the same way inside a task, which holds one at a time.

Groups may be of any size: turns are numbered by ranges (``tables.running``),
sums combine map-side, and rows of hot conversations or nodes meet their one
partner row in joins of written tables, which AQE splits.  The SHA-256 of a
node's ends is sequential by nature: ids are sorted by ranges and packed into
chunks of ``CHUNK`` ids in parallel, and one task streams a node's chunks.

Defined results: null roles and texts are empty; turns are ordered by number,
null first, equal ones by role, then by the MD5 of role and text, and repeated turns all
count; rows without a conv_id belong to no conversation and are left out; very
long texts count whole; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .tables import running, written

#: Nodes of a component that one task splits by itself (about 100 bytes each).
LOCAL = 4_096
CHUNK = 4_096
LAST_RUN: dict = {}

NODE = ["conv_id", "depth"]


def _half(text: Column, first: int) -> Column:
    """A signed long from 16 hexadecimal digits."""
    return F.conv(F.substring(text, first, 16), 16, -10).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """(c, nth from 0, size in code points, h1, h2) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    md5 = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    slim = (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"),
                    F.length(text).cast("long").alias("size"), md5.alias("md5"))
            .withColumns({"h1": _half(F.col("md5"), 1), "h2": _half(F.col("md5"), 17)}))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("md5")]
    return running(slim, "c", order, "turns", drop=("turn", "role", "md5"))


def rebuilt(own: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first turns taken from another one: (c, len)
    of each and (c, d from 1, len, size, h1, h2) of their turns.  ``head`` (so
    many turns) and ``base`` (of that conversation) are functions of ``c``;
    no more than ``tables``' rows with nth below the largest head are copied."""
    n = own.groupBy("c").agg(F.count("*").alias("n")).withColumns({"h": head.cast("long"), "b": base.cast("long")})
    n = written(n, "conversations")
    lengths = n.select(F.col("c").alias("b"), F.col("n").alias("n_base"))
    e = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    conv = written(n.join(lengths, "b", "left").withColumn("e", e)
                   .withColumn("len", F.col("e") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "rebuilt")
    kept = (own.join(conv.select("c", "h", "e", "len"), "c").where(F.col("nth") >= F.col("h"))
            .select("c", (F.col("e") + F.col("nth") - F.col("h") + 1).alias("d"), "len", "size", "h1", "h2"))
    most = n.agg(F.max("h")).first()[0] or 0
    heads = own.where(F.col("nth") < most).select(F.col("c").alias("b"), "nth", "size", "h1", "h2")
    taken = (conv.where("e > 0").join(heads, "b").where("nth < e")
             .select("c", (F.col("nth") + 1).alias("d"), "len", "size", "h1", "h2"))
    return conv.select("c", "len"), kept.unionByName(taken)


def members(rows: DataFrame) -> DataFrame:
    """(c, d, len, size, k1, k2, p1, p2): the key of every prefix and of the one before it."""
    own = rows.withColumns({"x1": F.xxhash64("d", "h1", "h2"), "x2": F.xxhash64(F.lit(1), "h2", "d", "h1")})
    own = own.drop("h1", "h2").withColumns({"k1": F.col("x1"), "k2": F.col("x2")})
    keyed = running(own, "c", [F.col("d")], "prefixes", ("k1", "k2"))
    return keyed.select("c", "d", "len", "size", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"),
                        F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"))


def trie(conv: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, size,
    n_nodes in the subtree) and the node of every prefix (c, d, len, m, pm)."""
    m = written(members(rows), "members")
    found = m.groupBy("d", "k1", "k2").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"),
                                           F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = conv.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("d"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("size"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    named = written(found.unionByName(root), "nodes")
    parents = named.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    named = written(named.join(parents, ["d", "p1", "p2"], "left").drop("p1", "p2"), "named")
    at = written(m.select("c", "d", "len", "k1", "k2").join(
        named.select("d", "k1", "k2", F.col("conv_id").alias("m"), F.col("parent_conv_id").alias("pm")), ["d", "k1", "k2"])
        .select("c", "d", "len", "m", "pm"), "ancestors")
    # a conversation brings the nodes beyond the prefix that it shares with a smaller one
    shared = written(at.groupBy("c").agg(F.count_if(F.col("m") != F.col("c")).alias("shared")), "shared")
    brought = at.join(shared, "c").groupBy(F.col("m").alias("conv_id"), F.col("d").alias("depth")).agg(
        F.sum(F.least(F.col("len") - F.col("shared"), F.col("len") - F.col("d") + 1)).alias("n_nodes"))
    children = named.where("d > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("d") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    nodes = named.withColumnRenamed("d", "depth").join(brought, NODE, "left").join(children, NODE, "left")
    n_all = F.lit(named.count())
    return written(nodes.select(*NODE, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "size",
                                F.coalesce("n_nodes", n_all).alias("n_nodes")), "trie"), at


def _split(parent: list[int], weights: np.ndarray) -> np.ndarray:
    """Subtree sums of one component; ``parent`` of the top is -1, parents come first."""
    n = len(parent)
    out = np.zeros_like(weights)
    if n == 1:
        return weights.copy()
    part, todo, new = [0] * n, [list(range(n))], 1
    while todo:
        own = todo.pop()
        me, half = part[own[0]], len(own)
        if half == 1:
            out[own[0]] += weights[own[0]]
            continue
        below = dict.fromkeys(own, 1)
        for v in reversed(own):
            p = parent[v]
            if p >= 0 and part[p] == me:
                below[p] += below[v]
        z = min((v for v in own if 2 * below[v] >= half), key=below.__getitem__)
        parts: dict[int, list[int]] = {}
        upper, inside = [], [z]
        label = {z: -1}
        for v in own:  # parents first
            p = parent[v]
            if v == z:
                continue
            if p in label:
                label[v] = v if p == z else label[p]
                parts.setdefault(label[v], []).append(v)
                inside.append(v)
            else:
                upper.append(v)
        total = weights[inside].sum(axis=0)
        v = z
        while v >= 0 and part[v] == me:  # the centroid and its path to the top
            out[v] += total
            v = parent[v]
        part[z] = -1
        for vs in parts.values():
            for v in vs:
                part[v] = new
            new += 1
            todo.append(vs)
        if upper:
            todo.append(upper)
    return out


def _local(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """Subtree sums of whole components, which come one after another."""
    def solve(b: pd.DataFrame) -> pd.DataFrame:
        comp = b[["comp_c", "comp_d"]].to_numpy()
        first = np.flatnonzero(np.append(True, (comp[1:] != comp[:-1]).any(axis=1)))
        sums = np.zeros((len(b), len(names)), dtype=np.int64)
        w = b[[f"w_{n}" for n in names]].to_numpy(dtype=np.int64)
        ids, depth = b["conv_id"].tolist(), b["depth"].tolist()
        above = b["parent_conv_id"].tolist()
        for a, e in zip(first, np.append(first[1:], len(b))):
            number = {(ids[i], depth[i]): i - a for i in range(a, e)}
            sums[a:e] = _split([number.get((above[i], depth[i] - 1), -1) if i > a else -1 for i in range(a, e)], w[a:e])
        out = b[NODE].copy()
        for j, n in enumerate(names):
            out[n] = sums[:, j] + b[f"a_{n}"].to_numpy()
        return out

    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        last = (b["comp_c"] == b["comp_c"].iloc[-1]) & (b["comp_d"] == b["comp_d"].iloc[-1])
        cut = int(last.to_numpy().argmax())  # the last component may go on
        if cut:
            yield solve(b.iloc[:cut].reset_index(drop=True))
        held = b.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield solve(held)


def rollup(nodes: DataFrame, ancestors: DataFrame, weights: dict[str, Column], local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, one long a weight): sums of ``weights`` over the
    subtree of every node, itself included.  ``ancestors``: (c, d, m, pm), the
    node (m, d) of every prefix and its parent's conv_id."""
    checkpoint_dir(nodes.sparkSession)
    names = list(weights)
    top = nodes.where("depth = 0").select(F.col("conv_id").alias("comp_c"), F.col("depth").alias("comp_d"))
    now = nodes.crossJoin(F.broadcast(top)).select(  # one row: the root
        *NODE, F.coalesce("parent_conv_id", F.lit(0)).alias("parent_conv_id"), "n_nodes", "comp_c", "comp_d", *[c.cast("long").alias(f"w_{n}") for n, c in weights.items()],
        *[F.lit(0).cast("long").alias(f"a_{n}") for n in names])
    now, rounds, comp = written(now, "component"), 0, ["comp_c", "comp_d"]
    label = ancestors.select(F.col("c").alias("conv_id"), F.col("d").alias("z_next"), F.col("m").alias("label"), F.col("pm").alias("under"))
    while True:
        big = now.groupBy(*comp).agg(F.max("n_nodes").alias("all")).where(F.col("all") > local)
        z = (now.join(big, comp).where(2 * F.col("n_nodes") >= F.col("all")).groupBy(*comp, "all")
             .agg(F.min(F.struct("n_nodes", *NODE)).alias("z"))
             .select(*comp, "all", F.col("z.n_nodes").alias("z_nodes"), F.col("z.conv_id").alias("z_c"), F.col("z.depth").alias("z_d"),
                     (F.col("z.depth") + 1).alias("z_next")))
        z = written(z, "centroids")
        if z.isEmpty():
            break
        rounds += 1
        is_z = (F.col("conv_id") == F.col("z_c")) & (F.col("depth") == F.col("z_d"))
        in_part = (F.col("depth") > F.col("z_d")) & F.col("under").eqNullSafe(F.col("z_c"))
        split = written(now.join(z, comp, "left").join(label, ["conv_id", "z_next"], "left")
                        .withColumns({"is_z": F.coalesce(is_z, F.lit(False)), "in_part": F.coalesce(in_part, F.lit(False))}), "split")
        total = split.where("is_z or in_part").groupBy(*comp).agg(*[F.sum(f"w_{n}").alias(f"t_{n}") for n in names])
        on_path = ~F.col("is_z") & (2 * F.col("n_nodes") >= F.col("all"))
        out = split.join(written(total, "totals"), comp, "left")
        gain = {n: F.when(F.col("is_z"), F.col(f"t_{n}") - F.col(f"w_{n}"))  # its own weight is added at the end
                .when(on_path, F.col(f"t_{n}")).otherwise(0) for n in names}
        now = written(out.select(
            *NODE, "parent_conv_id",
            F.when(F.col("is_z"), 1).when(on_path, F.col("n_nodes") - F.col("z_nodes")).otherwise(F.col("n_nodes")).alias("n_nodes"),
            F.when(F.col("is_z"), F.col("conv_id")).when(F.col("in_part"), F.col("label")).otherwise(F.col("comp_c")).alias("comp_c"),
            F.when(F.col("is_z"), F.col("depth")).when(F.col("in_part"), F.col("z_next")).otherwise(F.col("comp_d")).alias("comp_d"),
            *[f"w_{n}" for n in names], *[(F.col(f"a_{n}") + gain[n]).alias(f"a_{n}") for n in names]), "component")
    LAST_RUN["rounds"] = rounds
    schema = "conv_id long, depth long, " + ", ".join(f"{n} long" for n in names)
    return (now.repartition(*comp).sortWithinPartitions(*comp, "depth")
            .mapInPandas(lambda it: _local(it, names), schema))


def joined_sha256(rows: DataFrame, key: list[str], value: str, chunk: int = CHUNK) -> DataFrame:
    """(key, sha256): hash of a key's numbers, ascending, comma-joined."""
    cols = [*key, value]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b[key].to_numpy()
            new = np.append(True, (k[1:] != k[:-1]).any(axis=1)) if len(b) else np.empty(0, bool)
            first = np.flatnonzero(new)
            rows = []
            text = b[value].astype(str).to_numpy()
            for a, e in zip(first, np.append(first[1:], len(b))):
                for s in range(a, e, chunk):
                    rows.append((*k[a].tolist(), part, seq, ",".join(text[s:min(e, s + chunk)])))
                    seq += 1
            yield pd.DataFrame(rows, columns=[*key, "part", "seq", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for b in batches:
            done = []
            for *k, ids in b[[*key, "ids"]].itertuples(index=False):
                if k == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = k, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=[*key, "sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*key, "sha256"])

    keys = ", ".join(f"{k} long" for k in key)
    packed = (rows.select(*cols).repartitionByRange(*cols).sortWithinPartitions(*cols)
              .mapInPandas(pack, f"{keys}, part int, seq long, ids string"))
    return (written(packed, "ends").repartition(*key).sortWithinPartitions(*key, "part", "seq")
            .mapInPandas(digest, f"{keys}, sha256 string"))


def report(conversations: DataFrame, head: Column | None = None, base: Column | None = None, local: int = LOCAL) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (code points that members
    share with an earlier one) and ends_sha256.  ``head`` and ``base``: see
    ``rebuilt``; without them conversations stay as they are."""
    own = turns(conversations)
    c = F.col("c")
    conv, rows = rebuilt(own, F.lit(0) if head is None else head, c if base is None else base)
    nodes, ancestors = trie(conv, rows)
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = rollup(nodes, ancestors, {"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("size")}, local)
    at_root = conv.where("len = 0").crossJoin(F.broadcast(nodes.where("depth = 0").select("conv_id", "depth")))
    ends = (ancestors.where("d = len").select(F.col("m").alias("conv_id"), F.col("d").alias("depth"), "c")
            .unionByName(at_root.select("conv_id", "depth", "c")))
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, NODE).join(joined_sha256(ends, NODE, "c"), NODE, "left")
            .select(*NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("sha256", F.lit(nothing)).alias("ends_sha256")))


def head_turns(c: Column, most: int = 6) -> Column:
    """0 to ``most`` - 1 first turns, by the CRC-32 of the decimal id."""
    return F.crc32(c.cast("string").cast("binary")) % most


def block_start(c: Column, block: int = 100) -> Column:
    return c - c % block
