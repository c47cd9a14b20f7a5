"""Near duplicates by an exact Jaccard join of word shingles.

Texts with one and the same shingle set become one node. Nodes that share a shingle of their
prefix, in an order of all shingles that puts those of many texts last, form a candidate group.
A group's members are dealt to tiles of neighbouring size bands; within a tile, hashed parity
bitmaps bound each pair's overlap from above by counting bits. Only pairs that pass go on, and
their sorted arrays are intersected.

The order. A shingle is low if its hash lies under a fixed share of the hash range, and hot if more
than HOT nodes have it. Low shingles that aren't hot come first, by hash. A node of n shingles with
n - ceil(0.8 n) + 1 of them has its whole prefix there, so each of its links shares one. The others
("deep": small texts, or texts made of what many share) can miss only each other, and are grouped
among themselves with the rarest shingles first.

Large groups. Components are asked for, so pairs of one component need no look. First a group's
members are compared with a few of them, the same few wherever the same nodes meet. Then tiles
compare members outside the group's largest component with all others, and each member names only
its best partners of other components (LIMITS); what these link is contracted, and members that had
more partners name them all in the last round. So a group of k copies costs a few k exact
comparisons, and what isn't contracted costs bit counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, columns_of, settled, slices, small_batches, tenant, unused
from .components import components

GRAM = 5
#: A link: PART * intersection >= WHOLE * union.
PART, WHOLE = 100, 80
#: Share of the hash range whose shingles are low; entities above which a shingle is hot.
LOW, HOT = 0.26, 32
#: Shingles that a mapper gathers before it deals them out; bytes of them that a reducer gets.
CHUNK, REDUCER = 300_000, 6 << 20
#: Words, and nodes already dealt, that a worker remembers.
REMEMBERED, DEALT = 100_000, 200_000
#: Members that all others of a group are compared with first; partners that a member names, by round.
CENTRES, LIMITS = 4, (8, None)
#: Rows and bytes of bitmaps on either side of a tile; sizes grow by this factor from band to band (over WHOLE / PART, so that links join neighbouring bands).
TILE_ROWS, TILE_BYTES, BAND = 1024, 4 << 20, 1.26
#: The filter that picks the texts to read again: bits for each, and at most; with more texts a join picks them.
FILTER_BITS, FILTER_MOST = 12, 1 << 25
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOW = np.uint64(int(LOW * 2**64))
#: Stands for a null doc_id where texts are read again.
NO_ID = -(1 << 63)
#: Whether the sizes na and nb leave room for a link.
SIZED = f"{PART} * least(na, nb) >= {WHOLE} * greatest(na, nb)"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < GRAM:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = len(w) - GRAM + 1
    h = w[:k] * _C[0]
    for i in range(1, GRAM):
        h += w[i : i + k] * _C[i]
    return np.unique(mixed(h))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), len(s)), "<i8")
    return int(d[0]), int(d[1])


def bitmap(s: np.ndarray) -> bytes:
    """Parities of hashed positions; the length is that of the set's size band: 2 to 4 bits a shingle, a power of two."""
    bits = min(1 << 20, max(64, 1 << (2 * len(s)).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


#: The length of bitmap() for a set of n shingles, in SQL.
BITMAP_BYTES = "least(131072L, greatest(8L, shiftleft(1L, length(bin(2 * n)) - 3)))"


def least_overlap(n: int) -> int:
    """ceil(WHOLE / PART * n)"""
    return -(-WHOLE * n // PART)


def may_link(na: int, a: bytes, nb: int, b: bytes) -> bool:
    """Whether the bit counts leave room for a link. Each differing parity needs an element of only one of the sets."""
    if PART * min(na, nb) < WHOLE * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return PART * (na + nb - apart) >= WHOLE * (na + nb + apart)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return PART * inter >= WHOLE * (len(a) + len(b) - inter)


SETS = "doc_id bigint, text_a bigint, text_b bigint, n bigint, key bigint, key2 bigint, n_low bigint, low binary, bits binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text_a, text_b) -> a row of SETS each."""
    tenant("ngram_join", _words.clear)
    for b in slices(batches, 1):
        ns, keys, low, maps = [], [], [], []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            s = shingles(t or b"")
            ns.append(len(s))
            keys.append(digest(s))
            low.append(s[: int(np.searchsorted(s, _LOW))].tobytes())
            maps.append(bitmap(s))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), b.column(3), pa.array(ns, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*keys)), pa.array([len(x) >> 3 for x in low], pa.int64()), pa.array(low, pa.binary()), pa.array(maps, pa.binary())],
            names=["doc_id", "text_a", "text_b", "n", "key", "key2", "n_low", "low", "bits"],
        )


def _blob(tok: np.ndarray, ent: np.ndarray) -> bytes:
    return tok.tobytes() + ent.tobytes()


def _deal(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, low) -> (bucket, kind, blob): shingles and their keys, dealt by shingle.

    A shingle that is hot within a chunk is hot: of its keys only the least goes on, marked as
    hot (kind 1), and the others are compared with it (kind 2); how many such shingles a key
    has is kind 3. So a shingle that a third of all texts have isn't sent to one task.
    """

    def chunk(lows: list[bytes], ents: list[int]) -> Iterator[tuple[int, int, bytes]]:
        tok = np.frombuffer(b"".join(lows), np.uint64)
        ent = np.repeat(np.array(ents, np.int64), [len(x) >> 3 for x in lows])
        order = np.lexsort((ent, tok))
        tok, ent = tok[order], ent[order]
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.append(first, len(tok)))
        hot = np.repeat(size > HOT, size)
        if hot.any():
            starts = first[size > HOT]
            yield from deal(tok[starts], ent[starts], 1)
            center = np.repeat(ent[starts], size[size > HOT])
            pairs = np.unique(np.stack([center, ent[hot]], 1)[center != ent[hot]], axis=0)
            if len(pairs):
                yield int(pairs[0, 0]) % buckets, 2, _blob(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
            e, n = np.unique(ent[hot], return_counts=True)
            yield int(e[0]) % buckets, 3, _blob(e, n.astype(np.int64))
        yield from deal(tok[~hot], ent[~hot], 0)

    def deal(tok: np.ndarray, ent: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
        bucket = (tok % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        tok, ent, bucket = tok[order], ent[order], bucket[order]
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(at)).tolist():
            yield k, kind, _blob(tok[at[k] : at[k + 1]], ent[at[k] : at[k + 1]])

    def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("ngram_join", _words.clear)
        lows, ents, seen, held = [], [], set(), 0
        for b in slices(batches, 1, 4 << 20):
            for ent, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if low and ent not in seen:
                    seen.add(ent)
                    ents.append(ent)
                    lows.append(low)
                    held += len(low) >> 3
            if held >= CHUNK:
                yield batch(list(chunk(lows, ents)))
                lows, ents, held = [], [], 0
                if len(seen) > DEALT:
                    seen = set()
        if held:
            yield batch(list(chunk(lows, ents)))

    return run


FOUND = "a bigint, b bigint, cut_a boolean, cut_b boolean"
GROUPS = "kind int, ents array<bigint>, n bigint"


def _gather(t: pa.Table) -> pa.Table:
    """A bucket's shingles -> distinct groups of 2 to HOT entities (kind 0), pairs from hot ones (kind 2), counts of hot shingles by mapper (kind 3) and of those found here (kind 4)."""
    tenant("ngram_join", _words.clear)
    toks, ents, marked, pairs, counts = [], [], [], [], []
    for kind, blob in zip(t.column("kind").to_pylist(), t.column("blob").to_pylist()):
        half = len(blob) // 2
        x, y = np.frombuffer(blob, np.uint64, half // 8), np.frombuffer(blob, np.int64, half // 8, half)
        if kind == 2:
            pairs.append(np.stack([x.view(np.int64), y], 1))
        elif kind == 3:
            counts.append((3, x.view(np.int64), y))
        else:
            toks.append(x)
            ents.append(y)
            if kind == 1:
                marked.append(x)
    kinds, groups, ns = [], [], []
    if toks:
        tok, ent = np.concatenate(toks), np.concatenate(ents)
        order = np.lexsort((ent, tok))
        tok, ent = tok[order], ent[order]
        keep = np.concatenate([[True], (tok[1:] != tok[:-1]) | (ent[1:] != ent[:-1])])
        tok, ent = tok[keep], ent[keep]
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.append(first, len(tok)))
        hot = size > HOT
        if marked:
            hot |= np.isin(tok[first], np.concatenate(marked))
        two = first[(size == 2) & ~hot]
        found = {x.tobytes() for x in np.unique(np.stack([ent[two], ent[two + 1]], 1), axis=0)} if len(two) else set()
        for i in np.flatnonzero((size > 2) & ~hot).tolist():
            found.add(ent[first[i] : first[i] + size[i]].tobytes())
        for g in found:
            kinds.append(0)
            groups.append(np.frombuffer(g, np.int64))
            ns.append(0)
        if hot.any():
            rows = np.repeat(hot, size)
            center = np.repeat(ent[first[hot]], size[hot])
            pairs.append(np.stack([center, ent[rows]], 1)[center != ent[rows]])
            counts.append((4, *np.unique(ent[rows], return_counts=True)))
    if pairs:
        for p in np.unique(np.concatenate(pairs), axis=0):
            kinds.append(2)
            groups.append(p)
            ns.append(0)
    for kind, e, n in counts:
        for x, y in zip(e.tolist(), n.tolist()):
            kinds.append(kind)
            groups.append(np.array([x]))
            ns.append(y)
    flat = np.concatenate(groups) if groups else np.empty(0, np.int64)
    at = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int32)
    return pa.table({"kind": pa.array(kinds, pa.int32()), "ents": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64())), "n": pa.array(ns, pa.int64())})


def _bits_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 3):
        rows = zip(*[b.column(i).to_pylist() for i in range(2, 6)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array([may_link(*r) for r in rows], pa.bool_()))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tenant("ngram_join", _words.clear)
    for b in slices(batches, 2):
        rows = zip(b.column(2).to_pylist(), b.column(3).to_pylist())
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def folded(maps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps folded to so many words of 64 bits, a row each."""
    out = np.empty((len(maps), words), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        out[i] = x if len(x) == words else np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)
    return out


def tile_pairs(node: np.ndarray, root: np.ndarray, n: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray, limit: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, cut_a, cut_b): for each left row its best right partners of other roots whose sizes and bit counts leave room for a link; cut: that row has more than limit."""
    words = np.array([len(m) >> 3 for m in maps])
    for w in np.unique(words[left]).tolist():
        # sizes of a link's sides are so close that their bitmaps' lengths differ by a factor of two at most
        rows, cols = np.flatnonzero(left & (words == w)), np.flatnonzero(right & (2 * words >= w) & (words <= 2 * w))
        fold = min(w, int(words[cols].min(initial=w)))
        x, y = folded([maps[i] for i in rows], fold), folded([maps[i] for i in cols], fold)
        step = max(1, (1 << 19) // max(1, len(cols) * fold))
        for k in range(0, len(rows), step):
            i = rows[k : k + step, None]
            na, nb = n[i], n[cols][None, :]
            ok = (root[i] != root[cols]) & (PART * np.minimum(na, nb) >= WHOLE * np.maximum(na, nb))
            if not ok.any():
                continue
            apart = np.bitwise_count(x[k : k + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
            ok &= PART * (na + nb - apart) >= WHOLE * (na + nb + apart)
            cut = np.zeros(len(i), np.bool_)
            if limit is not None:
                cut = ok.sum(axis=1) > limit
                for r in np.flatnonzero(cut):
                    found = np.flatnonzero(ok[r])
                    ok[r, found[np.argsort(apart[r, found], kind="stable")[limit:]]] = False
            r, c = np.nonzero(ok)
            a, b = node[i[r, 0]], node[cols[c]]
            yield np.minimum(a, b), np.maximum(a, b), cut[r] & (a < b), cut[r] & (a > b)


def _tiles(limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(tile, node, root, n, is_left, is_right, bits), sorted by tile -> FOUND. A tile's rows may be spread over batches; no more than one tile is held."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [t.column(c).to_numpy() for c in ("node", "root", "n", "is_left", "is_right")]
        if cols[3].any() and (cols[1] != cols[1][0]).any():
            for found in tile_pairs(*cols[:3], t.column("bits").to_pylist(), *cols[3:], limit):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "cut_a", "cut_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("ngram_join", _words.clear)
        held: list[pa.RecordBatch] = []
        for b in slices(batches, 6):
            tile = b.column(0).to_numpy()
            at = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            for x, y in zip(at, at[1:]):
                if held and held[0].column(0)[0].as_py() != tile[x]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _filter_slots(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mixed(ids.astype(np.int64).view(np.uint64) + _C[0])
    return [((h >> np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (0, 20, 40)]


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of so many bits over a column of longs; tasks' filters are joined in a few tasks, then one comes to the driver."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits, np.bool_)
        some = False
        for b in batches:
            some = some or b.num_rows > 0
            for s in _filter_slots(b.column(0).to_numpy(zero_copy_only=False), bits):
                out[s] = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                out |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    # settled, so that the two functions don't keep two workers a task
    got = settled(ids.mapInArrow(fill, "bits binary")).coalesce(4).mapInArrow(merge, "bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in got:
        out |= np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, full) of the nodes in reps (key, key2, node, rep): rep is a doc_id of theirs, and those texts are read again."""
    count = reps.count()
    bits = max(1 << 16, 1 << (FILTER_BITS * count).bit_length())
    small = bits <= FILTER_MOST
    if small:
        sent = docs.sparkSession.sparkContext.broadcast(_filter(reps.select("rep"), bits))
    else:
        rep = F.coalesce("doc_id", F.lit(NO_ID))
        docs = docs.join(reps.select("rep").distinct(), rep == F.col("rep"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant("ngram_join", _words.clear)
        seen: set[tuple[int, int]] = set()
        for b in slices(batches, 1):
            if small:
                hit = np.ones(b.num_rows, np.bool_)
                for s in _filter_slots(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), bits):
                    hit &= (sent.value[s >> 3] >> (7 - (s & 7)) & 1).astype(np.bool_)
                b = b.filter(pa.array(hit))
            keys, full = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = shingles(t or b"")
                k = digest(s)
                if k not in seen:
                    seen.add(k)
                    keys.append(k)
                    full.append(s.tobytes())
            if len(seen) > DEALT:
                seen = set()
            x, y = zip(*keys) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(full, pa.binary())], names=["key", "key2", "full"])

    found = docs.select("doc_id", "text").mapInArrow(run, "key bigint, key2 bigint, full binary")
    return found.join(reps.select("key", "key2", "node"), ["key", "key2"]).select("node", "full")


class NgramJoin:
    """One run of the join over docs (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.docs, self.spark = docs.select("doc_id", "text"), docs.sparkSession
        self.scratch = Scratch(self.spark, "ngram-join")

    def full(self, reps: DataFrame, name: str) -> DataFrame:
        """A row (node, full) for each of reps. Rows that share a doc_id may give a node's set from more than one task."""
        out = self.scratch.table(_sets_of(self.docs, reps), f"full-{name}")
        return out if out.count() == reps.count() else out.dropDuplicates(["node"])

    def verified(self, pairs: DataFrame, name: str) -> DataFrame | None:
        """The links among distinct pairs of nodes (a, b)."""
        x = self.ents.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        y = self.ents.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        sized = pairs.join(x, "a").join(y, "b").where(SIZED)
        near = self.scratch.table(sized.select("a", "b", "na", "bits_a", "nb", "bits_b").mapInArrow(_bits_pass, "a bigint, b bigint"), f"near-{name}")
        if near.isEmpty():
            return None
        needed = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        needed = self.scratch.table(self.ents.select("key", "key2", "node", "rep").join(needed, "node", "left_semi"), f"needed-{name}")
        full = self.full(needed, name)
        one, two = full.select(F.col("node").alias("a"), F.col("full").alias("full_a")), full.select(F.col("node").alias("b"), F.col("full").alias("full_b"))
        return self.scratch.table(near.join(one, "a").join(two, "b").select("a", "b", "full_a", "full_b").mapInArrow(_exact, "a bigint, b bigint"), f"links-{name}")

    def deep_members(self, hot: DataFrame) -> DataFrame:
        """(gid, node, n): prefixes of the deep nodes, the rarest shingles among them first. hot: (key, hot)."""
        prefix = f"n - ceil({WHOLE} * n / {PART}) + 1"
        deep = self.scratch.table(self.ents.join(hot, "key", "left").where(f"n_low - coalesce(hot, 0) < {prefix}").select("key", "key2", "node", "rep", "n"), "deep")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 1):
                sets = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
                node = np.repeat(b.column(0).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets), pa.int64()), pa.array(node, pa.int64())], names=["gid", "node"])

        rows = self.scratch.table(self.full(deep, "deep").mapInArrow(spread, "gid bigint, node bigint"), "deep-rows")
        shared = rows.groupBy("gid").agg(F.count("*").alias("df")).where("df > 1")
        kept = rows.join(shared, "gid").join(deep.select("node", "n"), "node")
        own = Window.partitionBy("node")
        ranked = kept.withColumn("rank", F.row_number().over(own.orderBy("df", "gid")) + F.col("n") - F.count("*").over(own))
        return self.scratch.table(ranked.where(f"rank <= {prefix}").select("gid", "node", "n"), "deep-members")

    def by_node(self, pairs: DataFrame) -> DataFrame:
        """Pairs of keys as pairs of nodes, without those whose sizes leave no room for a link."""
        x, y = (self.ents.select(F.col("key").alias(k), F.col("node").alias(f"node_{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
        return pairs.join(x, "a").join(y, "b").where(SIZED).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    def first_pairs(self, small: DataFrame, groups: DataFrame, deep: DataFrame) -> DataFrame:
        """Members of small groups with one of them, hot shingles' pairs, and members of deep groups with a few; sizes leave room for a link in all of them."""
        star = small.select(F.expr("ents[0]").alias("a"), F.explode(F.expr("slice(ents, 2, size(ents))")).alias("b"))
        star = star.unionByName(groups.where("kind = 2").select(F.expr("ents[0]").alias("a"), F.expr("ents[1]").alias("b"))).distinct()
        centres = deep.groupBy("gid").agg(F.array_distinct(F.array(*(F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(i))) for i in range(CENTRES)))).alias("centres"))
        around = deep.join(centres, "gid").select("node", F.col("n").alias("na"), F.explode("centres").alias("c")).select("node", "na", F.col("c.node").alias("centre"), F.col("c.n").alias("nb"))
        around = around.where(f"node <> centre and {SIZED}").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        return self.by_node(star).unionByName(around).distinct()

    def alike(self, m: DataFrame) -> DataFrame:
        """The rows of groups that are one tile each, cut where sizes in their order leave no room for a link; run is the part. Parts of one root, or without a minor, go."""
        runs = m.withColumn("apart", F.expr(f"coalesce({PART} * lag(n) over (partition by gid order by n) < {WHOLE} * n, false)").cast("int"))
        runs = runs.withColumn("run", F.sum("apart").over(Window.partitionBy("gid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
        own = Window.partitionBy("gid", "run")
        runs = runs.withColumns({"open": F.min("root").over(own) != F.max("root").over(own), "some": F.max("minor").over(own)})
        return runs.where("open and some").drop("apart", "open", "some")

    def tiles(self, members: DataFrame, roots: DataFrame, limit: int | None, name: str, again: DataFrame | None) -> DataFrame:
        """FOUND of the groups (gid, node, n, bytes) whose members have more than one root. again (node): what named as many partners as it could; all members at first."""
        m = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if again is not None:
            m = m.join(members.join(again, "node", "left_semi").select("gid").distinct(), "gid", "left_semi")
            m = m.join(again.withColumn("minor", F.lit(True)), "node", "left").withColumn("minor", F.coalesce("minor", F.lit(False)))
        counted = m.groupBy("gid", "root").agg(F.count("*").alias("k"), F.sum("bytes").alias("size"))
        large = (F.sum("k") > TILE_ROWS) | (F.sum("size") > TILE_BYTES)
        open_ = counted.groupBy("gid").agg(F.max_by("root", "k").alias("major"), large.alias("large"), F.count("*").alias("roots")).where("roots > 1")
        m = m.join(open_, "gid")
        if again is None:
            m = m.withColumn("minor", F.expr("root <> major"))
        m = self.scratch.table(m.select("gid", "node", "root", "n", "bytes", "minor", "large"), f"open-{name}")
        blocks = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("bytes") / TILE_BYTES))
        once = self.alike(m.where("not large")).select(F.xxhash64("gid", "run").alias("tile"), "node", "root", "n", F.col("minor").alias("is_left"), F.lit(True).alias("is_right"))
        m = m.where("large").withColumn("band", F.floor(F.log("n") / math.log(BAND)))
        left, right = m.where("minor"), m

        def side(x: DataFrame, y: DataFrame, is_left: bool) -> DataFrame:
            """Rows of x, once for each block of y in the bands beside theirs."""
            own = x.groupBy("gid", "band").agg(blocks.alias("own_blocks"))
            other = y.groupBy("gid", F.col("band").alias("band2")).agg(blocks.alias("blocks"))
            met = own.join(other, "gid").where("abs(band - band2) <= 1")
            rows = x.join(met, ["gid", "band"]).withColumn("mine", F.pmod(F.xxhash64("node"), "own_blocks")).withColumn("theirs", F.explode(F.expr("sequence(0L, blocks - 1)")))
            at = ("band", "mine", "band2", "theirs") if is_left else ("band2", "theirs", "band", "mine")
            return rows.select(F.xxhash64("gid", *at).alias("tile"), "node", "root", "n", F.lit(is_left).alias("is_left"), F.lit(not is_left).alias("is_right"))

        dealt = once if m.isEmpty() else once.unionByName(side(left, right, True)).unionByName(side(right, left, False))
        dealt = dealt.join(self.ents.select("node", "bits"), "node")
        dealt = dealt.select("tile", "node", "root", "n", "is_left", "is_right", "bits").repartition("tile").sortWithinPartitions("tile")
        found = dealt.mapInArrow(_tiles(limit), FOUND).groupBy("a", "b").agg(F.max("cut_a").alias("cut_a"), F.max("cut_b").alias("cut_b"))
        return self.scratch.table(found, f"found-{name}")

    def run(self) -> DataFrame:
        sets = self.scratch.table(self.docs.select("*", *(c.alias(k) for c, k in zip(text_digest(F.col("text")), ("text_a", "text_b")))).mapInArrow(_sets, SETS), "sets")
        rep = F.coalesce("doc_id", F.lit(NO_ID))
        # the written table fixes the nodes' numbers
        ents = sets.where("n > 0").groupBy("key", "key2").agg(F.first("n").alias("n"), F.first("n_low").alias("n_low"), F.first("bits").alias("bits"), F.min("doc_id").alias("least_id"), F.min(rep).alias("rep"))
        self.ents = self.scratch.table(ents.withColumn("node", F.monotonically_increasing_id()), "ents")
        total = self.ents.agg(F.sum("n_low")).first()[0] or 0
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), total * 16 // REDUCER + 1)
        dealt = sets.where("n > 0").select("key", "low").mapInArrow(_deal(buckets), "bucket bigint, kind int, blob binary")
        groups = self.scratch.table(dealt.groupBy("bucket").applyInArrow(_gather, GROUPS), "groups")
        # hot shingles of a key: at most those hot within one chunk and those found so by the reducers
        hot = groups.where("kind > 2").groupBy(F.expr("ents[0]").alias("key")).agg(
            (F.coalesce(F.max(F.expr("if(kind = 3, n, 0)")), F.lit(0)) + F.coalesce(F.sum(F.expr("if(kind = 4, n, 0)")), F.lit(0))).alias("hot")
        )
        small = groups.where("kind = 0").select("ents").distinct()
        deep = self.deep_members(hot)
        tried = self.scratch.table(self.first_pairs(small, groups, deep), "first")
        links = self.verified(tried, "first")
        roots = components(links if links is not None else tried.limit(0))
        members = small.select(F.xxhash64("ents").alias("gid"), F.explode("ents").alias("key")).join(self.ents.select("key", "node", "n"), "key").select("gid", "node", "n")
        members = self.scratch.table(members.unionByName(deep).withColumn("bytes", F.expr(BITMAP_BYTES)), "members")
        again = None
        for limit in LIMITS:
            name = f"upto-{limit}"
            found = self.tiles(members, roots, limit, name, again)
            fresh = self.scratch.table(found.select("a", "b").join(tried, ["a", "b"], "left_anti"), f"fresh-{name}")
            links = self.verified(fresh, name)
            if links is not None:
                roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
                tried = tried.unionByName(fresh)
            again = self.scratch.table(found.select(F.explode(F.expr("filter(array(if(cut_a, a, null), if(cut_b, b, null)), x -> x is not null)")).alias("node")).distinct(), f"cut-{name}")
            if again.isEmpty():
                break
        roots = settled(roots)
        least = self.ents.join(roots, "node").groupBy("root").agg(F.min("least_id").alias("component_id"))
        found = roots.join(least, "root").select("node", "root", "component_id")
        own = self.ents.select("key", "key2", "node", "least_id").join(found, "node", "left")
        own = own.select("key", "key2", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("root", "node").alias("component"))
        light = sets.select("doc_id", F.col("n").alias("n_shingles"), "key", "key2", "text_a", "text_b")
        columns = ["doc_id", "n_shingles", "component_id", "component", "text_a", "text_b"]
        out = light.where("n_shingles > 0").join(own, ["key", "key2"]).select(columns)
        out = out.unionByName(light.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("bigint")}).select(columns))
        out = settled(out)
        self.scratch.drop()
        return out


def text_digest(text: Column) -> tuple[Column, Column]:
    """128 bits of a text, as two longs."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least doc_id's (null last), then the one of the least text digest.

    Rows without words all stay. Of rows that agree in doc_id and text one stays, any of them. Null
    doc_ids: such rows are compared like all others. Very long texts are taken whole. Empty table:
    empty result. All columns stay, whatever their names.
    """
    names = [unused(docs, x) for x in ("row_known", "row_id", "row_a", "row_b")]
    text_a, text_b = text_digest(F.col("text"))
    ids = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("bigint"))
    first = F.min(F.struct(*(c.alias(k) for c, k in zip((*ids, F.col("text_a"), F.col("text_b")), names)))).alias("first")
    kept = ngram_join(docs).where("n_shingles > 0").groupBy("component").agg(first).select("first.*")
    keyed = docs.withColumns(dict(zip(names, (*ids, text_a, text_b))))
    rows = keyed.join(kept, names, "left_semi").dropDuplicates(names).select(*columns_of(docs))
    return rows.unionByName(docs.where(~F.coalesce("text", F.lit("")).rlike(WORD)))


def ngram_join(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Then component (a number of this run, null without words) and text_a, text_b (text_digest()), by
    which rows can be told apart where ids are null or repeated. Null, empty and blank texts have no shingles and are linked with nothing. Texts under five
    words have one shingle, the whole sequence. Equal texts are always linked. Very long texts are
    taken whole. Null doc_id: the row takes part; it is never a component's id unless all of the
    component's ids are null. Repeated rows appear as often as in the input. Empty table: empty
    result. Other columns are ignored, whatever their names.
    """
    with small_batches(docs.sparkSession):
        return NgramJoin(docs).run()
