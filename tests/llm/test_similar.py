"""Near dedup by similarity against brute force over all pairs."""

import random

import pytest

import corpus_pipeline


def shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def brute(texts):
    """Each text's group over all links, by number of its smallest member."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def edited(r, text, n):
    words = text.split()
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((x.doc_id, x.text) for x in corpus_pipeline.near_stage(spark, docs, "").collect()), key=str)


def test_similar_texts_against_brute_force(spark):
    """Edits of 1 to 9 words in 300: similarities of about 0.74 to 0.97, 3 to over 14 bits."""
    r = random.Random(4)
    texts = []
    for g in range(30):
        base = " ".join(f"g{g}w{r.randrange(10**6)}" for _ in range(300))
        texts += [base, *[edited(r, base, r.randint(1, 9)) for _ in range(3)]]
    roots = brute(texts)
    assert kept(spark, list(enumerate(texts))) == sorted([(i, texts[i]) for i in set(roots)], key=str)


def test_groups_that_only_their_middle_joins(spark):
    """No two edits are similar to each other; the text they come from is no first text."""
    r = random.Random(5)
    base = " ".join(f"w{i}" for i in range(300))
    texts = [edited(r, base, 5) for _ in range(40)] + [base]
    assert len(set(brute(texts))) == 1
    assert kept(spark, list(enumerate(texts))) == [(0, texts[0])]


@pytest.mark.parametrize("ids", [[None] * 6, [7] * 6, [7, None, 7, None, 7, None]])
def test_unrelated_texts_without_or_with_the_same_id_stay(spark, ids):
    texts = [" ".join(f"t{t}w{i}" for i in range(60)) for t in range(6)]
    rows = list(zip(ids, texts))
    assert kept(spark, rows + rows) == sorted(rows, key=str)
