"""N-gram language model in an Elias-Fano trie.

Level 1 holds the words: the ascending 64-bit hashes of the tokens, with exact counts. A node
of level k is a token after a node of level k - 1, its parent. The children of a parent are in
the shard of the parent's hash, but for parents that occur over HOT times: theirs are dealt by
the hash of parent and token, so that no shard depends on how common a word is. A shard keeps

* the parents that have children here (ascending), and for each one byte for the share that it
  leaves to the lower order (hot parents have theirs in a level of their own);
* monotone pointers to where the children of each begin;
* the children as one ascending sequence: a child is its word's number, counted from the value
  that ends the range of the parent before;

all as Elias-Fano sequences, and one byte per child for its discounted share. A look-up finds
the parent, takes the value at the end of the range before, and looks for the successor of that
value plus the word between the parent's two pointers. Shards are files in the shared folder
that workers map, so a model need not fit in memory.

N-grams of two or more tokens that occur fewer than `min_count` times are left out, which
goes for every corpus size alike. Smoothing: absolute discounting, interpolated with the next
lower order at look-up, down to (count + 1) / (tokens + words + 1) for single tokens; what the
discount and the omitted n-grams leave of a parent goes to the lower order. Shares are stored
as one of 256 evenly spread logarithms.

Counting moves packed blocks: a task counts its own n-grams first and sends one sorted,
compressed block per shard; the shard builder merges the blocks and writes the shard.
"""

from __future__ import annotations

import ast
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
import xxhash
import zstandard

from headwise.llm.common import cut, without
from headwise.llm.elias_fano import Sequence
from headwise.llm.shared_files import map_arrays, write_arrays

END = b"\n"  # no word holds a line feed
SHARD_KEYS = 1 << 21
FLUSH = 1_000_000  # tokens handled at once
PIECE = 1 << 20  # bytes of text that are split into words at once (a longer text: whole)
ASKED = 1 << 16  # keys that are looked up at once
WORDS = 400_000  # distinct words that a task holds while it counts them
COUNTED = 600_000  # tokens whose n-grams a task counts before it sends them
HOT = 1 << 15  # occurrences of a parent from which its children are spread over all shards
NONE = 256  # beside the 256 codes of a share
OUT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
_U = np.uint64


_MIX = 0x7F4A7C15  # odd and below 2 ** 31, so that its products with 32 bits fit in 63


def _shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of a product of the folded key; up to 32."""
    keys = keys.astype(_U)
    folded = (keys >> _U(32)) ^ (keys & _U(0xFFFFFFFF))
    return ((folded * _U(_MIX) & _U(0xFFFFFFFF)) >> _U(32 - bits)).astype(np.int64)


def _pair_shard(parents: np.ndarray, words: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The shard of a child."""
    keys, spread = parents.astype(_U), np.flatnonzero(hot)
    mixed = keys[spread] * _U(0x9E3779B97F4A7C15) + words[spread].astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    keys[spread] = mixed ^ mixed >> _U(29)
    return _shard_of(keys, bits)


def _by_shard(shard: np.ndarray, bits: int) -> np.ndarray:
    """Stable order by shard; small numbers are sorted by radix."""
    return np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct keys, ascending: where one of each is, and how many; and which each is."""
    order = np.argsort(keys).astype(np.int32)
    new = _changes(keys[order])
    at = np.flatnonzero(new)
    back = np.empty(len(keys), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[at], np.diff(np.r_[at, len(keys)]), back


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def _pair_keys(parents: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """One number per pair of a node (or -1) and a number below n."""
    if len(parents) and (int(parents.max()) + 2) * n >= 1 << 63:
        parents = np.unique(parents, return_inverse=True)[1]
    return (parents + 1) * n + words


def _shard_column(key: str, bits: int) -> Column:
    """The same in SQL."""
    half = F.lit(0xFFFFFFFF)
    folded = F.shiftrightunsigned(key, 32).bitwiseXOR(F.col(key).bitwiseAND(half))
    return F.shiftrightunsigned((folded * F.lit(_MIX)).bitwiseAND(half), 32 - bits).cast("long")


@dataclass(frozen=True)
class Level:
    """Where a level's shards are. first: the number of the shard's first node."""

    bits: int
    files: tuple  # per shard: (uri, places of arrays, sizes of sequences), or None
    first: tuple[int, ...]


@dataclass(frozen=True)
class Model:
    order: int
    total: int
    words: int
    levels: tuple[Level, ...] = ()
    hot: tuple[Level, ...] = ()  # per level from 2: what its hot parents leave
    min_count: int = 2
    discount: float = 0.75
    hot_over: int = HOT

    @property
    def grid(self) -> np.ndarray:
        """The logarithms that a byte stands for: from the smallest share there can be to 1."""
        least = max(min(self.min_count - self.discount, self.discount), 1e-3) / max(self.total, 1)
        return np.linspace(np.log10(least), 0.0, 256)

    def code(self, shares: np.ndarray) -> np.ndarray:
        grid = self.grid
        logs = np.log10(np.maximum(shares, 10.0 ** grid[0]))
        return np.clip(np.rint((logs - grid[0]) / (grid[1] - grid[0])), 0, 255).astype(np.uint8)


def _arrays_of(sequences: dict[str, Sequence]) -> tuple[dict, dict]:
    arrays = {f"{name}.{p}": getattr(s, p) for name, s in sequences.items() for p in Sequence.PARTS}
    return arrays, {name: (s.n, s.width) for name, s in sequences.items()}


class Shards:
    """Mapped shards of a level, opened when first asked for; the least used go again."""

    def __init__(self, level: Level, keep: int = 4096):
        self.level, self.keep, self.open = level, keep, OrderedDict()

    def __getitem__(self, i: int) -> dict:
        if i in self.open:
            self.open.move_to_end(i)
            return self.open[i]
        uri, places, sizes = self.level.files[i]
        arrays = map_arrays(uri, places)
        shard = {
            name: Sequence(n, width, *[arrays.pop(f"{name}.{p}") for p in Sequence.PARTS])
            for name, (n, width) in sizes.items()
        } | arrays
        self.open[i] = shard
        if len(self.open) > self.keep:
            self.open.popitem(last=False)
        return shard

    def each(self, keys: np.ndarray):
        """(shard number, shard, index of its keys) for the shards that the keys fall in; many keys
        of a shard come in parts."""
        yield from self.groups(_shard_of(keys, self.level.bits))

    def groups(self, at: np.ndarray):
        order = _by_shard(at, self.level.bits)
        edges = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0]) if len(at) else []
        for a, b in zip(edges, [*edges[1:], len(at)]):
            i = int(at[order[a]])
            if self.level.files[i] is not None:
                yield from ((i, self[i], order[c : min(b, c + ASKED)]) for c in range(a, b, ASKED))


class Reader:
    """Look-ups in a model, for arrays of queries."""

    def __init__(self, model: Model):
        self.model = model
        self.levels = [Shards(x) for x in model.levels]
        self.hot = [Shards(x) for x in model.hot]
        # By code; NONE stands for no child and for nothing left out.
        self.shares, self.lefts = np.r_[10.0 ** model.grid, 0.0], np.r_[10.0 ** model.grid, 1.0]

    def words(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Node (or -1) and count of each word."""
        hashes = _hashes(found).view(_U)
        nodes, counts = np.full(len(found), -1, np.int64), np.zeros(len(found), np.int64)
        level = self.levels[0]
        for i, shard, at in level.each(hashes):
            index = shard["keys"].find(hashes[at])
            hit = index >= 0
            nodes[at[hit]] = index[hit] + level.level.first[i]
            counts[at[hit]] = shard["counts"][index[hit]]
        return nodes, counts

    def children(self, k: int, parents: np.ndarray, of: np.ndarray, words: np.ndarray):
        """Of words after nodes of level k - 1 that occur `of` times, by ascending parents: node of
        level k (or -1) and its count (not on the last level), the codes of its share and of what
        the parent leaves."""
        n, last = len(parents), k == self.model.order
        nodes, counts = (None, None) if last else (np.full(n, -1, np.int64), np.zeros(n, np.int64))
        shares, left = np.full(n, NONE, np.uint16), np.full(n, NONE, np.uint16)
        level, hot = self.levels[k - 1], of > self.model.hot_over
        ask = np.flatnonzero((parents >= 0) & ((words >= 0) | ~hot)).astype(np.int32)
        for i, shard, at in level.groups(_pair_shard(parents[ask], words[ask], hot[ask], level.level.bits)):
            at = ask[at]
            # A parent is looked up once for all of its words.
            own = parents[at]
            new = _changes(own)
            own, back = own[new], np.cumsum(new) - 1
            place = shard["parents"].find(own)
            there = np.flatnonzero(place >= 0)
            begin, end, base = (np.zeros(len(own), np.int64) for _ in range(3))
            begin[there] = shard["pointers"].get(place[there]).astype(np.int64)
            end[there] = shard["pointers"].get(place[there] + 1).astype(np.int64)
            later = there[begin[there] > 0]
            base[later] = shard["children"].get(begin[later] - 1).astype(np.int64)
            some = np.flatnonzero(place[back] >= 0)
            at, back = at[some], back[some]
            calm = ~hot[at]
            left[at[calm]] = shard["left"][place[back[calm]]]
            real = words[at] >= 0
            at, back = at[real], back[real]
            index = shard["children"].find(base[back].astype(_U) + words[at].astype(_U) + _U(1))
            hit = (index >= begin[back]) & (index < end[back])
            at, index = at[hit], index[hit]
            shares[at] = shard["codes"][index]
            if not last:
                nodes[at] = index + level.level.first[i]
                counts[at] = shard["counts"][index]
        warm = np.flatnonzero(hot & (parents >= 0))
        new = _changes(parents[warm])
        own, back = parents[warm[new]], np.cumsum(new) - 1
        found = np.full(len(own), NONE, np.uint16)
        for _, shard, at in self.hot[k - 2].each(own):
            index = shard["keys"].find(own[at])
            hit = index >= 0
            found[at[hit]] = shard["codes"][index[hit]]
        left[warm] = found[back]
        return nodes, counts, shares, left

    def single(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.model.total + self.model.words + 1))

    def contexts(self, nodes: np.ndarray, counts: np.ndarray, stream: np.ndarray, upto: int):
        """Of a stream of words (by their place in `nodes` and `counts`; 0 ends a text): for k = 2
        to `upto` per token its parent of level k - 1 (or -1) and the parent's count, each
        followed, but for the last, by the codes of the token's share and of what the parent
        leaves. After the last level of the model there are no parents."""
        begins = np.zeros(len(stream), bool)
        begins[_starts(stream)] = True
        # Words that are too rare have no node beyond their own, before or behind others.
        words = np.where(counts >= self.model.min_count, nodes, -1)
        parent, of = _shifted(words[stream], begins, int(nodes[0])), _shifted(counts[stream], begins, int(counts[0]))
        for k in range(2, upto + 1):
            yield parent, of
            if k == upto or k > len(self.levels):
                break
            # Each distinct pair is looked up once.
            first, _, back = _distinct(_pair_keys(parent, stream, len(nodes)))
            asked = parent[first], of[first], words[stream[first]]
            del parent, of, first
            node, count, share, left = self.children(k, *asked)
            del asked
            yield share[back], left[back]
            if node is None:
                parent = of = None
            else:
                parent, of = _shifted(node[back], begins, -1), _shifted(count[back], begins, 0)

    def score(self, nodes: np.ndarray, counts: np.ndarray, stream: np.ndarray) -> np.ndarray:
        """log10 probability of each token of a stream."""
        best = (10.0 ** self.single(counts))[stream]
        found = self.contexts(nodes, counts, stream, len(self.levels) + 1)
        for _ in found:
            codes = next(found, None)
            if codes is not None:
                best *= self.lefts[codes[1]]
                best += self.shares[codes[0]]
        return np.log10(best)


def _shifted(values: np.ndarray, begins: np.ndarray, first: int) -> np.ndarray:
    """The value before each token; texts begin after `first`."""
    return np.where(begins, first, np.r_[first, values[:-1]]) if len(values) else values


# --- streams of tokens ---------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts by about PIECE bytes: their words, `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and
    how many each has. Arrow's ASCII functions know exactly these blanks and lower only these letters."""
    for batch in batches:
        texts = pc.fill_null(batch.column(at), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, side="right")))
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
            words = lists.flatten()
            real = pc.not_equal(words, "")  # blanks at either end leave an empty one
            kept = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
            edges = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            yield words.filter(real).cast(pa.binary()), np.diff(kept[edges])
            a = b


def _streams(batches: Iterator[pa.RecordBatch], flush: int, at: int = 0) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts put together until `flush` tokens are reached: the distinct words, and per token
    (texts end with END) the place of its word; a text begins after each END."""
    held: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    n = 0

    def out() -> tuple[pa.Array, np.ndarray]:
        coded = pa.chunked_array([pa.array([END], pa.binary()), *held]).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        many = np.concatenate(sizes)
        stream = np.zeros(int(many.sum()) + len(many), np.int32)
        real = np.ones(len(stream), bool)
        real[np.cumsum(many + 1) - 1] = False
        stream[real] = coded.indices.to_numpy()[1:]
        return coded.dictionary, stream

    for words, many in _pieces(batches, at):
        held.append(words)
        sizes.append(many)
        n += len(words) + len(many)
        if n >= flush:
            yield out()
            held, sizes, n = [], [], 0
    if sizes:
        yield out()


def _starts(stream: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(stream == 0)
    return np.r_[0, ends[:-1] + 1] if len(ends) else ends


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    texts = 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("token").aggregate([("c", "sum")]).rename_columns(["token", "c"])

    for words, many in _pieces(batches):
        texts += len(many)
        found = words.value_counts()
        held.append(pa.table({"token": found.field("values"), "c": found.field("counts")}))
        if sum(map(len, held)) > WORDS:
            held = [summed()]
            if len(held[0]) > WORDS // 2:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if texts:
        held.append(pa.table({"token": pa.array([END], pa.binary()), "c": pa.array([texts], pa.int64())}))
        yield from summed().combine_chunks().to_batches()


def _hashes(words: pa.Array) -> np.ndarray:
    found = map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False))
    return np.fromiter(found, _U, len(words)).view(np.int64)


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(batch.column("token"))), batch.column("c")], names=["key", "c"])


# --- building ------------------------------------------------------------------------------


def _build(rows: DataFrame, n: int, root: str, encode, columns: list[str]) -> Level:
    """Deal rows (key, ...) over shards and write each as one file. Only the list of files,
    one per SHARD_KEYS keys, reaches the driver."""
    bits = max(0, (n // SHARD_KEYS).bit_length())
    dealt = rows.withColumn("shard", _shard_column("key", bits)).repartition(max(1, 1 << bits), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            sequences, arrays, size = encode({c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns})
            parts, sizes = _arrays_of(sequences)
            uri, places = write_arrays(root, parts | arrays)
            row = {"shard": batch.column("shard")[0].as_py(), "uri": uri, "places": repr(places), "sizes": repr(sizes), "n": size}
            return pa.RecordBatch.from_pylist([row], schema=_FILES)

        for batch in batches:
            while batch.num_rows:
                shards = batch.column("shard").to_numpy()
                if held and held[0].column("shard")[0].as_py() != shards[0]:
                    yield out(_merged(held))
                    held = []
                same = int(np.searchsorted(shards, shards[0], side="right"))
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
        if held:
            yield out(_merged(held))

    found = (
        dealt.sortWithinPartitions("shard")
        .select("shard", *columns)
        .mapInArrow(run, "shard long, uri string, places string, sizes string, n long")
        .collect()
    )
    return _level(found, bits)


_FILES = pa.schema(
    [("shard", pa.int64()), ("uri", pa.string()), ("places", pa.string()), ("sizes", pa.string()), ("n", pa.int64())]
)


_FILES_AND_HOT = _FILES.append(pa.field("hot", pa.int64())).append(pa.field("hot_rows", pa.binary()))


def _merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _counts_array(c: np.ndarray) -> np.ndarray:
    return c.astype("<u4" if not len(c) or c.max() < 1 << 32 else "<u8")


def _encode_words(columns: dict) -> tuple[dict, dict, int]:
    keys = columns["key"].view(_U)
    order = np.argsort(keys)
    keys, c = keys[order], columns["c"][order]
    if len(keys) and (keys[1:] == keys[:-1]).any():
        raise ValueError("two words share a 64-bit hash")
    return {"keys": Sequence.build(keys)}, {"counts": _counts_array(c)}, len(keys)


def _encode_numbers(columns: dict) -> tuple[dict, dict, int]:
    order = np.argsort(columns["key"])
    return {"keys": Sequence.build(columns["key"][order])}, {"codes": columns["code"][order].astype(np.uint8)}, len(order)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: high bytes are mostly zero."""
    planes = [np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def _unsqueezed(block: bytes, n: int, many: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(many, 8, n)
    return [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes]


def _grams(model: Model, k: int, bits: int):
    """Task: its n-grams of length k, counted, as one block (parents, words, counts, counts of
    the parents; sorted by parent) per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for known, stream in _streams(batches, COUNTED):
            nodes, counts = reader.words(known)
            *_, (parent, of) = reader.contexts(nodes, counts, stream, k)
            # An n-gram that is common enough has only words and parents that are.
            kept = np.flatnonzero((parent >= 0) & (counts[stream] >= model.min_count))
            first, c, _ = _distinct(_pair_keys(parent[kept], stream[kept], len(known)))
            first = kept[first]
            parents, words, of = parent[first], nodes[stream[first]], of[first]
            shard = _pair_shard(parents, words, of > model.hot_over, bits)
            by = _by_shard(shard, bits)
            shard, parents, words, c, of = shard[by], parents[by], words[by], c[by], of[by]
            edges = np.flatnonzero(np.r_[True, np.diff(shard) != 0, True]) if len(shard) else np.zeros(1, int)
            for a, b in zip(edges[:-1], edges[1:]):
                block = _squeezed(np.diff(parents[a:b], prepend=0), words[a:b], c[a:b], of[a:b])
                yield pa.RecordBatch.from_pydict({"shard": [int(shard[a])], "n": [int(b - a)], "block": [block]})

    return run


def _children(model: Model, last: bool, root: str):
    """Task: the blocks of each shard, merged, to one file; also what its part of the hot
    parents' children holds (parents, their counts, kept occurrences and children)."""

    def write(shard: int, blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
        parts = [_unsqueezed(block, n, 4) for n, block in blocks]
        parents, words, c, of = (np.concatenate(p) for p in zip(*[(np.cumsum(p[0]), *p[1:]) for p in parts]))
        by = np.lexsort((words, parents))
        parents, words, of = parents[by], words[by], of[by]
        first = np.flatnonzero(np.r_[True, (np.diff(parents) != 0) | (np.diff(words) != 0)])
        c = np.add.reduceat(c[by], first)
        parents, words, of = parents[first], words[first], of[first]
        keep = c >= model.min_count
        parents, words, of, c = parents[keep], words[keep], of[keep], c[keep]
        begin = np.flatnonzero(np.r_[True, np.diff(parents) != 0][: len(parents)])
        own, of_own = parents[begin], of[begin]
        edges = np.r_[begin, len(parents)]
        tops = words[edges[1:] - 1] + 1
        base = np.repeat(np.cumsum(tops) - tops, np.diff(edges))
        held = np.add.reduceat(c, begin) if len(c) else c
        left = 1 - (held - model.discount * np.diff(edges)) / of_own
        sequences = {
            "parents": Sequence.build(own), "pointers": Sequence.build(edges), "children": Sequence.build(base + words + 1),
        }
        arrays = {"codes": model.code((c - model.discount) / of), "left": model.code(left)}
        if not last:
            arrays["counts"] = _counts_array(c)
        packed, sizes = _arrays_of(sequences)
        uri, places = write_arrays(root, packed | arrays)
        hot = of_own > model.hot_over
        rows = _squeezed(own[hot], of_own[hot], held[hot], np.diff(edges)[hot])
        row = {"shard": shard, "uri": uri, "places": repr(places), "sizes": repr(sizes), "n": len(c), "hot": int(hot.sum()), "hot_rows": rows}
        return pa.RecordBatch.from_pylist([row], schema=_FILES_AND_HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if held and at != r["shard"]:
                    yield write(at, held)
                    held = []
                at = r["shard"]
                held.append((r["n"], r["block"]))
        if held:
            yield write(at, held)

    return run


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            columns = _unsqueezed(r["hot_rows"], r["hot"], 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "of", "held", "n"])


def _level(rows: list, bits: int) -> Level:
    files, sizes = [None] * (1 << bits), [0] * (1 << bits)
    for r in rows:
        files[r["shard"]] = (r["uri"], ast.literal_eval(r["places"]), ast.literal_eval(r["sizes"]))
        sizes[r["shard"]] = r["n"]
    return Level(bits, tuple(files), tuple(np.r_[0, np.cumsum(sizes)[:-1]].tolist()))


def _code_column(model: Model, share: Column) -> Column:
    """`Model.code` in SQL."""
    low, step = float(model.grid[0]), float(model.grid[1] - model.grid[0])
    logs = F.log10(F.greatest(share, F.lit(10.0**low)))
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint((logs - low) / step).cast("int")))


def fit(
    docs: DataFrame, order: int = 2, text: str = "text", min_count: int = 2, discount: float = 0.75, hot_over: int = HOT
) -> Model:
    """Learn from all rows of `docs`; NULL texts are empty (one end token). Without rows the
    model knows no word and gives every token the probability 1. Parents of over `hot_over`
    occurrences have their children in all shards."""
    texts = docs.select(text)
    counts = cut(texts.mapInArrow(_count_words, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "lm-words")
    total, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not total:
        return Model(1, 0, 0)
    # Beside the table just written, whose files Spark names with their full address.
    root = counts.inputFiles()[0].rpartition("/")[0] + "-trie"
    hashed = counts.mapInArrow(_hash_words, "key long, c long")
    levels = (_build(hashed, words, root, _encode_words, ["key", "c"]),)
    model = Model(order, total, words, levels, (), min_count, discount, hot_over)
    bits = (total // SHARD_KEYS).bit_length()
    for k in range(2, order + 1):
        blocks = texts.mapInArrow(_grams(model, k, bits), "shard long, n long, block binary")
        dealt = blocks.repartition(1 << bits, "shard").sortWithinPartitions("shard")
        made = cut(
            dealt.mapInArrow(_children(model, k == order, root), "shard long, uri string, places string, sizes string, n long, hot long, hot_rows binary"),
            f"lm-{k}",
        )
        level = _level(made.drop("hot_rows").collect(), bits)
        if not any(level.files):
            break
        # The children of a hot parent are spread, so what it leaves is added up over the shards.
        summed = made.filter("hot > 0").select("hot", "hot_rows").mapInArrow(_hot_rows, "key long, of long, held long, n long")
        left = 1 - (F.sum("held") - F.lit(discount) * F.sum("n")) / F.max("of")
        hot = cut(summed.groupBy("key").agg(left.alias("left")).select("key", _code_column(model, F.col("left")).alias("code")), f"lm-hot-{k}")
        back = _build(hot, hot.count(), root, _encode_numbers, ["key", "code"])
        model = Model(order, total, words, (*model.levels, level), (*model.hot, back), min_count, discount, hot_over)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with n_tokens (words and one end), n_known (those seen in training),
    train_tokens, base_score (single tokens, log10) and score (the model, log10).

    Whole texts are read; NULL counts as empty. Rows are scored alone: no shuffle, repeated
    rows stay, an empty table gives an empty result; columns named like the new ones are
    replaced. Without `keep_text` the texts are not handed back.
    """
    base = without(docs, *OUT)
    kinds = dict(zip(OUT, ("long", "long", "long", "double", "double")))
    names = base.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text.lower())
    stay = [i for i in range(len(names)) if keep_text or i != at]
    schema = base.select(*[F.col(f"`{names[i]}`") for i in stay]).withColumns({c: F.lit(0).cast(t) for c, t in kinds.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            done = [[], [], [], []]
            for known, stream in _streams([batch], FLUSH, at):
                starts = _starts(stream)
                if model.total:
                    nodes, counts = reader.words(known)
                    single, full = reader.single(counts), reader.score(nodes, counts, stream)
                else:
                    counts, single, full = np.zeros(len(known), np.int64), np.zeros(len(known)), np.zeros(len(stream))
                done[0].append(np.diff(np.r_[starts, len(stream)]))
                done[1].append(np.add.reduceat((counts > 0)[stream], starts, dtype=np.int64))
                done[2].append(np.add.reduceat(single[stream], starts))
                done[3].append(np.add.reduceat(full, starts))
            n, known_n, single, full = (np.concatenate(d) if d else np.empty(0) for d in done)
            arrays = [pa.array(n.astype(np.int64)), pa.array(known_n.astype(np.int64)), pa.array(np.full(len(n), model.total, np.int64)), pa.array(single.astype(float)), pa.array(full.astype(float))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *arrays], names=[*(names[i] for i in stay), *OUT])

    return base.mapInArrow(run, schema)
