"""Conversation prefix tries: succinct level-order tries by prefix shard, heavy upper levels apart.

Each turn is digested where it is read; from then on rows are narrow. A prefix is known by 128 bits,
the exclusive or of its turns' digests salted by their places, so prefixes come from running values
that can be cut anywhere, inside a conversation too. A node is heavy if more than most_rows rows of
conversations lie at it or below; the root always is. The light subtrees under heavy nodes are the
prefix shards: numpy builds each shard's level-order trie (LOUDS bits and an array of labels), takes
parents from the bits by rank, and sums subtrees with add.at in reverse level order. Heavy nodes
form the upper levels, which are merged by Spark: a node's smallest member carries the node, so a
subtree's sum is the running sum along one conversation plus the whole sums of other members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settled, tenant, with_groups

#: Rows of a shard at most; more below a node make it heavy.
MOST_ROWS = 100_000
#: Fixed values of the production query: conversations share beginnings within blocks of 20, of at most 3 turns.
BLOCK, SHARED = 20, 4
#: Ids in a piece of a list.
PIECE = 500
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "a", "b"]
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, pa long, pb long"
_UP_TO = Window.unboundedPreceding, Window.currentRow
_BEFORE = Window.unboundedPreceding, -1


def _salted(which: int, depth: Column, item: Column) -> Column:
    return F.xxhash64(F.lit(which), depth.cast("long"), item)


def _xor(x: Column, *more: Column) -> Column:
    for y in more:
        x = x.bitwiseXOR(F.coalesce(y, F.lit(0).cast("long")))
    return x


def _offsets(counts: DataFrame, values: dict[str, Column]) -> DataFrame:
    """counts (conv, part, ...): per further part of a conversation what lies before it. Parts are ranges, so there are fewer rows than parts."""
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(*_BEFORE)
    return counts.select("conv", "part", F.count("*").over(before).alias("parts_before"), *(v.over(before).alias(k) for k, v in values.items())).where("parts_before > 0").drop("parts_before")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, part, pos, item, words): each conversation's turns from 1, by turn (null first), ties by digest; conversations longer than a range lie in several parts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    items = settled(
        turns.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv"),
            "turn",
            F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("item"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        )
    )
    ranged = settled(items.repartitionByRange("conv", "turn", "item").withColumn("part", F.spark_partition_id()))
    offset = _offsets(ranged.groupBy("conv", "part").agg(F.count("*").alias("k")), {"offset": F.sum("k")})
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "item"))
    return ranged.withColumn("place", place).join(F.broadcast(offset), ["conv", "part"], "left").select("conv", "part", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("pos"), "item", "words")


def rebuilt(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """(conv, depth, a, b, pa, pb, words, len): all prefixes of the rebuilt conversations with their parents' digests, the empty one too.

    The first h turns of conversation c are those of c - c % block (all if fewer, none if absent),
    with h = crc32(c as decimal) % shared; then follow c's own turns after its first h.
    """
    own = settled(numbered(turns))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).cast("long")
    first = own.where(F.col("pos") < shared).select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "item", "words", _salted(1, F.col("pos"), F.col("item")).alias("ha"), _salted(2, F.col("pos"), F.col("item")).alias("hb"))
    convs = own.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", h)
    lent = convs.withColumn("base", F.col("conv") - F.col("conv") % block).join(first, "base").where("depth <= h")
    heads = lent.groupBy("conv").agg(F.count("*").alias("taken"), F.bit_xor("ha").alias("head_a"), F.bit_xor("hb").alias("head_b"))
    convs = convs.join(heads, "conv", "left").na.fill(0, ["taken", "head_a", "head_b"])
    convs = settled(convs.withColumn("len", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))))
    rest = with_groups(own, convs, ["conv"], "n").where("pos > h").withColumn("depth", F.col("taken") + F.col("pos") - F.col("h"))
    rest = settled(rest.withColumns({"ha": _salted(1, F.col("depth"), F.col("item")), "hb": _salted(2, F.col("depth"), F.col("item"))}).drop("item"))
    sums = rest.groupBy("conv", "part").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    offset = _offsets(sums, {"oa": F.bit_xor("xa"), "ob": F.bit_xor("xb")})
    run = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(*_UP_TO)
    rest = rest.withColumns({"ra": F.bit_xor("ha").over(run), "rb": F.bit_xor("hb").over(run)}).join(F.broadcast(offset), ["conv", "part"], "left")
    rest = rest.select("conv", "depth", _xor(F.col("ra"), F.col("head_a"), F.col("oa")).alias("a"), _xor(F.col("rb"), F.col("head_b"), F.col("ob")).alias("b"), "ha", "hb", "words", "len")
    run = Window.partitionBy("conv").orderBy("depth").rowsBetween(*_UP_TO)
    lent = lent.join(convs.select("conv", "len"), "conv").select("conv", "depth", F.bit_xor("ha").over(run).alias("a"), F.bit_xor("hb").over(run).alias("b"), "ha", "hb", "words", "len")
    zero = F.lit(0).cast("long")
    root = convs.select("conv", *(zero.alias(x) for x in ("depth", "a", "b", "ha", "hb", "words")), "len")
    rows = rest.unionByName(lent).unionByName(root)
    return rows.select("conv", "depth", "a", "b", _xor(F.col("a"), F.col("ha")).alias("pa"), _xor(F.col("b"), F.col("hb")).alias("pb"), "words", "len")


def louds(parents: np.ndarray) -> np.ndarray:
    """The bits of a level-order trie, its root first: for each node a 1 per child, then a 0. parents[i] is that of node i + 1."""
    degree = np.bincount(parents, minlength=len(parents) + 1)
    bits = np.ones(len(parents) + len(degree), bool)
    bits[np.cumsum(degree) + np.arange(len(degree))] = False
    return bits


def parents_of(bits: np.ndarray) -> np.ndarray:
    """The parent of the k-th 1's node is the number of 0s before that 1."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones))


def shard_nodes(conv: np.ndarray, depth: np.ndarray, la: np.ndarray, lb: np.ndarray, words: np.ndarray, last: np.ndarray, pa_: np.ndarray, pb_: np.ndarray) -> dict[str, list | np.ndarray]:
    """The nodes of a bucket of shards: each conversation is a path of labels (la, lb), whose first label tells the shard.

    Node 0 stands above all shards and isn't returned.
    """
    ids, at = np.unique(conv, return_inverse=True)
    top = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(top, at, depth)
    level = depth - top[at]
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(level.max() + 2))
    here = np.zeros(len(ids), np.int64)
    labels, starts, made = [], [0, 1], 1  # where each level's nodes begin
    of_row = np.empty(len(conv), np.int64)
    parents = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows = order[lo:hi]
        up = here[at[rows]]
        by = rows[np.lexsort((conv[rows], lb[rows], la[rows], up))]
        up = here[at[by]]
        new = np.ones(len(by), bool)
        new[1:] = (up[1:] != up[:-1]) | (la[by][1:] != la[by][:-1]) | (lb[by][1:] != lb[by][:-1])
        node = made + np.cumsum(new) - 1
        of_row[by] = node
        here[at[by]] = node
        labels.append(by[new])  # the row of the smallest member gives the label
        parents.append(up[new])
        made = node[-1] + 1
        starts.append(made)
    bits = louds(np.concatenate(parents))
    up = np.concatenate([[-1], parents_of(bits)])
    first = np.concatenate(labels)
    n = np.bincount(of_row, minlength=made)
    children = np.bincount(up[1:], minlength=made)
    leaves = (children == 0).astype(np.int64)
    saved = np.zeros(made, np.int64)
    saved[1:] = (n[1:] - 1) * words[first]
    for lo, hi in zip(starts[-2:0:-1], starts[:1:-1]):
        np.add.at(leaves, up[lo:hi], leaves[lo:hi])
        np.add.at(saved, up[lo:hi], saved[lo:hi])
    ends = [EMPTY] * made
    done = np.flatnonzero(last)
    done = done[np.lexsort((conv[done], of_row[done]))]
    nodes, begin = np.unique(of_row[done], return_index=True)
    for k, i, j in zip(nodes.tolist(), begin.tolist(), [*begin[1:].tolist(), len(done)]):
        ends[k] = hashlib.sha256(",".join(map(str, conv[done[i:j]].tolist())).encode()).hexdigest()
    rep = np.concatenate([[-1], conv[first]])
    inner = up[1:] > 0
    return {
        "conv_id": rep[1:],
        "depth": depth[first],
        "parent_conv_id": pa.array(np.where(inner, rep[up[1:]], 0), mask=~inner),
        "n_convs": n[1:],
        "n_children": children[1:],
        "n_leaves": leaves[1:],
        "saved_tokens": saved[1:],
        "ends_sha256": ends[1:],
        "pa": pa_[first],
        "pb": pb_[first],
    }


def _shard(t: pa.Table) -> pa.Table:
    tenant("conv_trie")
    got = shard_nodes(*(t.column(c).to_numpy() for c in ("conv", "depth", "la", "lb", "words", "last", "pa", "pb")))
    kinds = {n: pa.string() if k == "string" else pa.int64() for n, k in (x.split() for x in NODES.split(", "))}
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in got.items()})


def list_digests(rows: DataFrame) -> DataFrame:
    """rows (depth, a, b, conv) -> per node the digest of its comma-joined ascending ids. Ranges join pieces; one task hashes a node's pieces as they come."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("conv_trie")
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if not len(cols[0]):
                continue
            change = np.ones(len(cols[0]), bool)
            change[1:] = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
            begins = np.flatnonzero(change).tolist()
            spans = [(x, min(x + PIECE, e)) for s, e in zip(begins, [*begins[1:], len(cols[0])]) for x in range(s, e, PIECE)]
            at = [s for s, _ in spans]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols), pa.array([",".join(map(str, cols[3][s:e].tolist())) for s, e in spans])], names=[*KEY, "conv", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("conv_trie")
        node, sha = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key != node:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], names=[*KEY, "ends_sha256"])

    kept = settled(rows.select(*KEY, "conv"))
    joined = kept.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(pieces, "depth long, a long, b long, conv long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(digests, "depth long, a long, b long, ends_sha256 string")


def trie(rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """rows as rebuilt() gives them -> one row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = settled(rows)
    below = F.sum(F.col("len") - F.col("depth") + 1)
    nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv").alias("rep"), F.max("words").alias("tokens"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), below.alias("below"))
    heavy = settled(nodes.where((F.col("depth") == 0) | (F.col("below") > most_rows)).drop("below"))
    marked = settled(with_groups(rows, heavy.select(*KEY, "n", "rep"), KEY, "n"))
    # shards: a conversation's light rows follow its heavy ones and are at most most_rows
    light = marked.where("rep is null").withColumn("top", F.first(F.struct(*KEY)).over(Window.partitionBy("conv").orderBy("depth").rowsBetween(*_UP_TO)))
    is_top = F.col("top.depth") == F.col("depth")
    label = {f"l{x}": F.when(is_top, F.col(x)).otherwise(_xor(F.col(x), F.col(f"p{x}"))) for x in "ab"}
    buckets = marked.where("rep is null").count() // max(1, most_rows) + 1
    light = light.withColumns(label).withColumn("bucket", F.pmod(F.xxhash64("top.depth", "top.a", "top.b"), F.lit(buckets)))
    light = light.select("bucket", "conv", "depth", "la", "lb", "words", (F.col("depth") == F.col("len")).alias("last"), "pa", "pb")
    shards = settled(light.groupBy("bucket").applyInArrow(_shard, NODES))
    tops = shards.where("parent_conv_id is null")
    # upper levels
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    below = tops.select(*up, F.lit(1).cast("long").alias("k"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    below = below.unionByName(heavy.where("depth > 0").select(*up, F.lit(1).cast("long").alias("k"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    sums = below.groupBy(*KEY).agg(F.sum("k").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    upper = heavy.join(sums, KEY, "left").na.fill(0, ["n_children", "leaves", "saved"])
    upper = upper.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("tokens"))
    chain = Window.partitionBy("rep").orderBy(F.col("depth").desc()).rowsBetween(*_UP_TO)
    upper = settled(upper.withColumns({"leaves": F.sum("leaves").over(chain), "saved": F.sum("saved").over(chain)}))
    whole = settled(upper.groupBy(F.col("rep").alias("conv")).agg(F.count("*").alias("links"), F.max(F.struct(-F.col("depth"), "leaves", "saved")).alias("whole")).select("conv", "links", F.col("whole.leaves").alias("more_leaves"), F.col("whole.saved").alias("more_saved")))
    others = marked.where("rep is not null and rep <> conv").select(*KEY, "conv")
    others = with_groups(others, whole, ["conv"], "links").where("links is not null").groupBy(*KEY).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    ends = list_digests(marked.where("rep is not null and depth = len"))
    upper = upper.join(others, KEY, "left").join(ends, KEY, "left").na.fill(0, ["more_leaves", "more_saved"]).na.fill(EMPTY, ["ends_sha256"])
    upper = settled(upper.select(*KEY, "pa", "pb", F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), "n_children", (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved_tokens"), "ends_sha256"))
    # each upper or top node meets its parent, a heavy one
    parents = upper.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    out = [x.split()[0] for x in NODES.split(", ")[:8]]
    hang = settled(upper.where("depth > 0").select("conv_id", "depth", "n_convs", F.col("n_children").alias("own"), "n_leaves", "saved_tokens", "ends_sha256", "pa", "pb").unionByName(tops.select("conv_id", "depth", "n_convs", F.col("n_children").alias("own"), "n_leaves", "saved_tokens", "ends_sha256", "pa", "pb")))
    hung = with_groups(hang, parents, ["depth", "pa", "pb"], "n_children").drop("n_children").withColumnRenamed("own", "n_children").select(*out)
    top = upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out)
    return shards.where("parent_conv_id is not null").select(*out).unionByName(hung).unionByName(top)


def prefix_trie(turns: DataFrame, block: int = BLOCK, shared: int = SHARED, most_rows: int = MOST_ROWS) -> DataFrame:
    """The nodes of the rebuilt conversations' trie; see rebuilt() and trie().

    Null role or text: empty. Null turn: before all others. Turns that tie go by their digest, so
    reruns agree. Rows of null conv_id belong to no conversation and are passed over. Repeated rows
    are turns of their own. Very long texts are read whole, where they are stored; very long
    conversations and hot prefixes are cut into parts. Empty table: no node, since there is no
    member. Other columns are ignored, whatever their names.
    """
    return trie(rebuilt(turns.select("conv_id", "turn", "role", "text"), block, shared), most_rows)


#: prefix_trie() with its defaults over the table conversations, for DuckDB.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, n, (xor(list_reduce(list_prepend(4294967295, flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])),
                lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) % 4)::BIGINT AS h
  FROM (SELECT conv_id::BIGINT AS c, count(*) AS n FROM turns GROUP BY conv_id)),
lent AS (SELECT c, h, pos AS d, role, text FROM convs JOIN turns ON turns.conv_id = c - c % 20 AND pos <= h),
built AS (
  SELECT c, d, role, text FROM lent
  UNION ALL
  SELECT c, (SELECT count(*) FROM lent WHERE lent.c = convs.c) + pos - h, role, text FROM convs JOIN turns ON turns.conv_id = c AND pos > h),
lists AS (
  SELECT convs.c, list(sha256(length(role) || ':' || role || text) ORDER BY d) FILTER (d IS NOT NULL) AS items,
         list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY d) FILTER (d IS NOT NULL) AS words, count(d) AS n
  FROM convs LEFT JOIN built ON built.c = convs.c GROUP BY convs.c),
paths AS (
  SELECT c, d, n, coalesce(array_to_string(items[1:d], ','), '') AS key, coalesce(array_to_string(items[1:d - 1], ','), '') AS up,
         CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words
  FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM lists)),
nodes AS (
  SELECT d, key, any_value(up) AS up, min(c) AS rep, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '') AS ends FROM paths GROUP BY d, key),
counted AS (
  SELECT v.*, coalesce(k.k, 0) AS n_children, p.rep AS parent
  FROM nodes v LEFT JOIN (SELECT d - 1 AS d, up AS key, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL) k USING (d, key)
  LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.key = v.up),
subtrees AS (
  SELECT p.d, p.key, sum((u.n_children = 0)::INT) AS leaves, sum(u.saved) AS saved
  FROM counted u JOIN paths p ON p.c = u.rep AND p.d <= u.d GROUP BY p.d, p.key)
SELECT rep AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted v JOIN subtrees s USING (d, key)
"""
