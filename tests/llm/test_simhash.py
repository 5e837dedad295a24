import random

import pytest
import xxhash

from headwise.llm import simhash
from headwise.llm.graph import components


def brute_fingerprint(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(marks, budget):
    """{key: smallest key} over links of at most `budget` bits."""
    root = {k: k for k in marks}
    moved = True
    while moved:
        moved = False
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= budget and root[b] < root[a]:
                    root[a], moved = root[b], True
    return root


def test_fingerprint():
    for text in ("", None, " \n ", "One", "one two", "A b c d e f", "ÄB ä x " * 50):
        for words in (3, 5):
            assert simhash.fingerprint(text, words) == brute_fingerprint(text, words)
    assert simhash.fingerprint("ABC Def", 3) == simhash.fingerprint("abc\tdef", 3)
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(long, 3) == brute_fingerprint(long, 3)


def clusters(seed):
    """Random fingerprints, dense clusters around some, and chains of single bits."""
    r = random.Random(seed)
    marks = [r.getrandbits(64) for _ in range(60)] + [0, 1, 3, 2**64 - 1, 2**63]
    for _ in range(3):
        centre = r.getrandbits(64)
        marks += [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(70)]
    walk = r.getrandbits(64)
    for _ in range(12):
        walk ^= sum(1 << b for b in r.sample(range(64), 2))
        marks.append(walk)
    return sorted(set(marks))


@pytest.mark.parametrize("budget,group", [(2, 4096), (2, 16), (3, 8), (0, 4096), (1, 4)])
def test_join_finds_all_components(spark, budget, group):
    marks = clusters(budget * 10 + group)
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    leaves = spark.createDataFrame([(m,) for m in signed], "fp long").repartition(5)
    got = {r["node"]: r["root"] for r in components(simhash.linked(leaves, budget, group)).collect()}
    unsigned = dict(zip(signed, marks))
    want = brute_components({m: unsigned[m] for m in signed}, budget)
    assert {m: got.get(m, m) for m in signed} == want


def test_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word7 ", "other ")
    rows = [
        (5, base, "a", 1), (3, base.upper(), "b", 2), (9, near, "c", 3), (4, None, None, 4), (8, "", "d", 5),
        (None, base, "e", 6), (7, "all else", "f", 7), (7, "all else", "f", 7), (2, "x" * 300_000, "g", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, Fingerprint int")
    got = simhash.near_copies(docs, 3, 2)
    assert got.columns == ["doc_id", "text", "fingerprint", "component_id"]
    found = {(r["doc_id"], r["component_id"], r["fingerprint"]) for r in got.collect()}
    marks = {r[0] if r[0] is not None else 100: brute_fingerprint(r[1]) for r in rows}
    roots = brute_components(marks, 2)
    want = {(r[0], roots[r[0] if r[0] is not None else 100], f"{brute_fingerprint(r[1]):016x}") for r in rows}
    assert found == want
    assert got.count() == len(rows)
    assert simhash.near_copies(docs.limit(0), 3, 2).count() == 0


def test_query_against_brute_force(spark):
    from headwise.llm.queries import LLM_QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    marks = {k: brute_fingerprint(t) for k, t in texts.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in LLM_QUERIES["op3_simhash"](spark, folder).collect()}
    assert got == {k: (f"{marks[k]:016x}", c) for k, c in brute_components(marks, 2).items()}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 200)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 200)}}
    assert components(df.limit(0)).count() == 0
