import hashlib
import math
import random
import re

import pytest

from headwise.llm import pii

# The contract's patterns, as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def weights():
    return pii.train([x for i, e in enumerate(pii.EXAMPLES * 5) for x in pii.variants(*e, random.Random(i))])


@pytest.mark.parametrize("letters", ["1239.@+- ()aZ_%\n", "0123456789 -", "a@.b", "25.0 "])
def test_patterns_against_their_regular_expressions(letters):
    r = random.Random(letters)
    for _ in range(8000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "9" * 400_000, "9." * 200_000, "+9 " * 100_000, "a@" * 200_000, "1 - " * 100_000):
        pii.base_spans(text)


def test_added_spans(weights):
    def added(text):
        return [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), weights)]

    assert added("call (202) 555-0143 now") == [("phone", "(202) 555-0143")]
    assert added("the host 10[.]0[.]0[.]1 answers") == [("ip", "10[.]0[.]0[.]1")]
    assert added("write to jane (at) mail.example.org soon") == [("email", "jane (at) mail.example.org")]
    assert added("paid with 4111.1111.1111.1111 today") == [("card", "4111.1111.1111.1111")]
    for clean in (
        "", "on 2024-01-31 at 12:30", "id 4111111111111112 x", "sum 1,234,567", "300.1.2.3",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "at noon. dot", "+1 (202) 555-0143",
    ):
        assert added(clean) == []


def test_decode_and_gradient_against_enumeration(weights):
    """All segmentations of short texts, one by one."""
    for text in ("call (202) 555-0143 now", "a 4111.1111.1111.1111 b", "x 123 4567 890 12 y", "jane at mail dot org"):
        tokens, paths = pii.lattice(text, 0, len(text), [])

        def all_from(i):
            if i == len(paths):
                yield [], 0.0
                return
            for rest, s in all_from(i + 1):
                yield rest, s
            for end, kind, found in paths[i]:
                here = sum(weights.get(f, 0.0) for f in found)
                for rest, s in all_from(end):
                    yield [(i, end, kind, tuple(found)), *rest], s + here

        every = list(all_from(0))
        best = max(s for _, s in every)
        chosen = pii.decode(paths, weights)
        assert any([x[:3] for x in seg] == chosen and math.isclose(s, best) for seg, s in every)
        total = math.log(sum(math.exp(s) for _, s in every))
        gold = {x[:3] for x in every[-1][0]}
        want: dict[str, float] = {}
        for seg, s in every:
            for x in seg:
                for f in x[3]:
                    want[f] = want.get(f, 0.0) - math.exp(s - total)
        for path_start, options in enumerate(paths):
            for end, kind, found in options:
                if (path_start, end, kind) in gold:
                    for f in found:
                        want[f] = want.get(f, 0.0) + 1
        got = pii.gradient(paths, gold, weights)
        assert all(abs(got.get(f, 0.0) - want.get(f, 0.0)) < 1e-9 for f in {*got, *want})


def test_find_personal_data(spark, weights):
    text = "é a@b.org\n+1 (202) 555-0143, 4111 1111 1111 1111 and 192.0.2.7"
    rows = [(1, text, "x"), (1, text, "x"), (None, None, None), (2, "", "y"), (3, "word " * 50_000 + text, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_personal_data(docs, weights).collect()
    assert len(got) == 5
    by = {r["doc_id"]: r for r in got}
    assert by[1]["spans"] == "email:2:9,ip:53:62,card:29:48,phone:10:27"
    assert by[1]["base_sha256"] == hashlib.sha256(by[1]["spans"].encode()).hexdigest()
    assert (by[3]["n_email"], by[3]["n_ip"], by[3]["n_card"], by[3]["n_phone"]) == (1, 1, 1, 1)
    assert by[None]["spans"] == by[2]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(docs.limit(0), weights).count() == 0
    assert pii.fit(docs.limit(0))  # trains on the built-in places alone


def test_query_against_brute_force(spark):
    from headwise.llm.queries import LLM_QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in LLM_QUERIES["op6_personal_data"](spark, folder).collect()}
    assert got.keys() == texts.keys()
    for key, t in texts.items():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t))
        assert got[key]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert {*base.split(",")} <= {*got[key]["spans"].split(","), ""}
