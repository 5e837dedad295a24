"""SimHash near-dedup by a binary trie self-join.

Texts become fingerprints; equal fingerprints are one leaf. The trie of all leaves is joined
with itself: a pair of nodes goes on to the pairs of their children, the differing bits add
up, and a pair is dropped as soon as they exceed the budget.

The trie is spread over tasks by its upper part. With a budget of k bits, a pair of leaves
agrees fully on at least one of k + 1 stretches of the fingerprint, so the leaves are laid
out k + 1 times, each time turned so that another stretch comes first, and every subtree
below a full stretch is joined with itself (a pair may be found more than once). A
subtree with more than `group` leaves is split into the pairs of its subtrees `STEP` bits
further down, with the same budget rule, again and again until all fit: a hot prefix spreads
over many tasks, whatever its size. Within a task the links of one subtree pair are reduced
to a spanning forest, so dense groups yield as many links as leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from headwise.llm.common import cut, tokens, without
from headwise.llm.graph import components

GROUP = 4096
STEP = 6
OUT = ("fingerprint", "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The 64-bit hashes of the word shingles, repeats included; one of all words where there
    are fewer than `words`."""
    found = tokens(text)
    if not found:
        return np.empty(0, np.uint64)
    shingles = (b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int, text: str = "text", name: str = "_fp") -> DataFrame:
    """`docs` with the fingerprint as a signed 64-bit number. NULL counts as empty: zero."""
    base = without(docs, name)
    schema = base.withColumn(name, F.lit(0).cast("long")).schema
    names = base.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x.as_py(), words) for x in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.view(np.int64))], names=[*names, name])

    return base.mapInArrow(run, schema)


def _stretches(budget: int) -> list[tuple[int, int]]:
    """(first bit from the top, length) of budget + 1 stretches of 64 bits."""
    ends = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(budget + 1) for c in combinations(range(bits), n)]


def _split(rows: DataFrame, budget: int) -> DataFrame:
    """The rows of node pairs, one level of STEP bits further down: each leaf goes to the
    pairs that its own subtree forms within the budget.

    A row: turn, depth (bits used), a and b (the pair's prefixes, a <= b), v (the leaf, turned).
    Prefixes are the leading `depth` bits, right-aligned."""
    step = F.least(F.lit(STEP), 64 - F.col("depth")).cast("int")
    mine = F.expr(f"shiftrightunsigned(v, 64 - depth - least({STEP}, 64 - depth))")
    head = F.expr("shiftrightunsigned(v, 64 - depth)")
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(STEP, budget)])
    usable = F.filter(
        masks, lambda m: (F.bit_count(m) + spent <= budget) & (m < F.expr(f"shiftleft(1L, least({STEP}, 64 - depth))"))
    )
    # The partner's upper prefix is the other node of the pair.
    other = F.when(head == F.col("a"), F.col("b")).otherwise(F.col("a"))
    low = mine.bitwiseXOR(F.expr(f"shiftleft(shiftrightunsigned(v, 64 - depth), least({STEP}, 64 - depth))"))
    partner = F.expr("shiftleft(_other, _step)").bitwiseXOR(F.col("_low")).bitwiseXOR(F.col("_mask"))
    return (
        rows.withColumns({"_mine": mine, "_other": other, "_low": low, "_step": step})
        .withColumn("_mask", F.explode(usable))
        .withColumn("_partner", partner)
        .select(
            "turn", (F.col("depth") + F.col("_step")).cast("int").alias("depth"),
            F.least("_mine", "_partner").alias("a"), F.greatest("_mine", "_partner").alias("b"), "v",
        )
    )


_PAIR = ["turn", "depth", "a", "b"]


def _spread(leaves: DataFrame, budget: int, group: int) -> DataFrame:
    """Rows (turn, depth, a, b, v): the leaves of every node pair that a task joins, at most
    `group` or at full depth, and with leaves on both sides."""
    turns = F.explode(
        F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(s).alias("first"), F.lit(n).alias("depth"))
                  for i, (s, n) in enumerate(_stretches(budget))])
    )
    rows = leaves.select("fp", turns.alias("t")).select(
        "t.turn", "t.depth",
        F.when(F.col("t.first") == 0, F.col("fp"))
        .otherwise(F.expr("shiftleft(fp, t.first) | shiftrightunsigned(fp, 64 - t.first)")).alias("v"),
    )
    prefix = F.expr("shiftrightunsigned(v, 64 - depth)")
    rows = rows.withColumns({"a": prefix, "b": prefix}).select(*_PAIR, "v")
    done = None
    while True:
        head = F.expr("shiftrightunsigned(v, 64 - depth)")
        counts = rows.groupBy(*_PAIR).agg(
            F.count("*").alias("n"), F.count_if(head == F.col("a")).alias("n_a"), F.count_if(head == F.col("b")).alias("n_b")
        )
        # A lone leaf, or a pair with an empty side, links nothing.
        live = counts.filter("n > 1 AND n_a > 0 AND n_b > 0").withColumn("hot", (F.col("n") > group) & (F.col("depth") < 64))
        marked = cut(rows.join(live.select(*_PAIR, "hot"), _PAIR), "trie")
        cold = marked.filter("NOT hot").drop("hot")
        done = cold if done is None else done.unionAll(cold)
        hot = marked.filter("hot").drop("hot")
        if hot.isEmpty():
            return done
        rows = _split(hot, budget)


def _pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, splits: np.ndarray, top: np.ndarray, budget: int):
    """Links within the node pairs given as ranges of `values` (sorted in each range): a range
    is one node joined with itself, or, where start < split < end, the two nodes before and
    after the split. Walks all pairs bit by bit; yields index arrays."""
    same = splits == ends
    lo1, hi1 = starts, np.where(same, ends, splits)
    lo2, hi2 = np.where(same, starts, splits), ends
    depth = top.copy()
    one = np.uint64(1)
    ranks = {}
    while len(lo1):
        # Small products are compared at once.
        leaf = ((hi1 - lo1) * (hi2 - lo2) <= 4) | (depth >= 64)
        if leaf.any():
            for i in range(int((hi1 - lo1)[leaf].max())):
                for j in range(int((hi2 - lo2)[leaf].max())):
                    a, b = lo1[leaf] + i, lo2[leaf] + j
                    there = (a < hi1[leaf]) & (b < hi2[leaf]) & (a < b)
                    a, b = a[there], b[there]
                    near = np.bitwise_count(values[a] ^ values[b]) <= budget
                    yield a[near], b[near]
        lo1, hi1, lo2, hi2, depth = (x[~leaf] for x in (lo1, hi1, lo2, hi2, depth))
        if not len(lo1):
            return
        d = int(depth.min())
        now = depth == d
        rest = tuple(x[~now] for x in (lo1, hi1, lo2, hi2, depth))
        lo1, hi1, lo2, hi2 = (x[now] for x in (lo1, hi1, lo2, hi2))
        if d not in ranks:
            ranks = {d: np.concatenate(([0], np.cumsum((values >> np.uint64(63 - d)) & one, dtype=np.int64)))}
        r = ranks[d]
        m1, m2 = hi1 - (r[hi1] - r[lo1]), hi2 - (r[hi2] - r[lo2])
        self_join = (lo1 == lo2) & (hi1 == hi2)
        parts = []
        for x, (a, b) in enumerate(((lo1, m1), (m1, hi1))):
            for y, (c, e) in enumerate(((lo2, m2), (m2, hi2))):
                keep = (b > a) & (e > c)
                if x > y:
                    keep &= ~self_join
                # What the two nodes have in common so far bounds their difference.
                k = np.flatnonzero(keep)
                shift = np.uint64(63 - d)
                far = np.bitwise_count((values[a[k]] >> shift) ^ (values[c[k]] >> shift)) > budget
                k = k[~far]
                parts.append((a[k], b[k], c[k], e[k], np.full(len(k), d + 1)))
        lo1, hi1, lo2, hi2, depth = (np.concatenate([p[i] for p in parts] + [rest[i]]) for i in range(5))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each element's smallest reachable element."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root) and np.array_equal(root[a], root[b]):
            break
    return root


def _join(budget: int, direct: bool = False):
    stretches = _stretches(budget)

    def links(turn, depth, a, b, v) -> pa.RecordBatch:
        """The links of whole node pairs; rows come sorted by pair."""
        v = v.view(np.uint64)
        order = np.lexsort((v, b, a, depth, turn))
        turn, depth, a, b, v = (x[order] for x in (turn, depth, a, b, v))
        edge = np.flatnonzero(np.r_[True, (np.diff(turn) != 0) | (np.diff(depth) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)])
        ends = np.r_[edge[1:], len(v)]
        head = v >> (64 - depth).astype(np.uint64)
        first = a.view(np.uint64)
        # The nodes of a pair lie one after the other; within a node the values ascend.
        second_node = head != first
        swapped = np.lexsort((v, second_node, np.repeat(np.arange(len(edge)), ends - edge)))
        v, turn, second_node = v[swapped], turn[swapped], second_node[swapped]
        splits = ends - np.add.reduceat(second_node.astype(np.int64), edge) if len(edge) else ends
        found = list(_pairs(v, edge, ends, splits, depth[edge].astype(np.int64), budget))
        x = np.concatenate([f[0] for f in found] + [np.empty(0, np.int64)])
        y = np.concatenate([f[1] for f in found] + [np.empty(0, np.int64)])
        if direct:
            root = np.arange(len(v))
            np.minimum.at(root, y, x)
        else:
            root = _forest(len(v), x, y)
        moved = np.flatnonzero(root != np.arange(len(v)))
        back = np.array([s for s, _ in stretches], np.uint64)[turn]
        original = np.where(back == 0, v, (v >> back) | (v << (np.uint64(64) - np.maximum(back, np.uint64(1)))))
        data = [pa.array(original[i].view(np.int64)) for i in (moved, root[moved])]
        return pa.RecordBatch.from_arrays(data, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows arrive in batches; the last pair of a batch waits for the next."""
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = np.ones(len(held[0]), bool)
            for x in held[:4]:
                last &= x == x[-1]
            cut_at = len(last) - int(last.sum())
            if cut_at >= 1 << 16:
                yield links(*[x[:cut_at] for x in held])
                held = [x[cut_at:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def linked(leaves: DataFrame, budget: int, group: int = GROUP, direct: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all of those within
    `budget` bits of each other, directly or over others. With `direct`, every link is itself
    within the budget: each fingerprint with the first of those near it in its node pair."""
    spread = _spread(leaves, budget, group)
    return spread.repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(_join(budget, direct), "a long, b long")


def near_copies(
    docs: DataFrame, words: int, budget: int, key: str = "doc_id", text: str = "text", group: int = GROUP
) -> DataFrame:
    """`docs` with fingerprint (16 hex digits) and component_id: the smallest key among all
    rows that can be reached over links of at most `budget` differing bits, the row's own
    included.

    Whole texts are read. NULL and empty texts have fingerprint zero, linked like any other.
    Rows without a key take part; a group of only such rows has a NULL component. Repeated
    rows are in one group. An empty table gives an empty result; columns named like the new
    ones are replaced.
    """
    marked = cut(fingerprints(without(docs, *OUT), words, text), "fingerprints")
    leaves = cut(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(key).alias("least")), "leaves")
    groups = components(linked(leaves.select("fp"), budget, group))
    rooted = leaves.join(groups, leaves["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_leaf = rooted.join(least, "root").select("fp", "component_id")
    return (
        marked.join(by_leaf, marked["_fp"] == by_leaf["fp"])
        .withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0")))
        .select(*[F.col(f"`{c}`") for c in without(docs, *OUT).columns], *OUT)
    )
