"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns find emails, IP addresses, payment cards and international phone numbers. The
field looks at what they leave: it scores whole candidate segments of tokens (their digits,
groups, separators, check sums, neighbours and cue words) and chooses boundaries and kinds
together by a dynamic programme over segments of bounded length. It is trained by maximum
conditional likelihood on a bounded sample of the corpus: places where a pattern matched,
the same places written in other ways (a phone number without its plus, a spelt-out email),
and numbers that are nothing of the kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from headwise.llm.common import without

KINDS = ("email", "ip", "card", "phone")
OUT = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")

# --- patterns (fixed values of the query's contract; possessive where nothing changes) ----
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All pattern matches by kind, then start."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            end = found.end()
        else:
            end = at + 1  # nothing left of this sign can begin a match any more
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- segments ------------------------------------------------------------------------------
MOST = 24  # tokens of a segment
AROUND = 48  # characters looked at on either side of a digit or at sign
_TRIGGER = re.compile(r"[0-9@]+|[\[({<] ?at ?[\])}>]|\bat [\w-]{1,64} dot\b", re.I)
_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_AT = frozenset({"@", "at"})
_DOT = frozenset({".", "dot"})
# Words that announce a kind.
CUES = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "ping"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "tél"},
}


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of a line around digits and at signs, which hold every candidate."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        line = text.rfind("\n", a, m.start())
        a = line + 1 if line >= 0 else a
        line = text.find("\n", m.end(), b)
        b = line if line >= 0 else b
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def segments(text: str, tokens: list[tuple[int, int]], i: int, blocked: list[bool]) -> Iterator[tuple[int, str, list[str]]]:
    """(end token, kind, features) of the candidates that start with token i."""
    words = [text[a:b] for a, b in tokens[i : i + MOST]]
    first = words[0]
    if not (first.isalnum() or first in "+("):
        return
    left = text[tokens[i][0] - 1] if tokens[i][0] else " "
    glued_left = not left.isspace() and (left.isalnum() or left in "@.-+/_=")
    before = {text[a:b].lower() for a, b in tokens[max(0, i - 3) : i]}
    digits, groups, letters, ats, dots, other = "", [], 0, 0, 0, 0
    for n, word in enumerate(words):
        if blocked[i + n]:
            return
        low = word.lower()
        if word.isdigit() and word.isascii():
            groups.append(len(word))
            digits += word
        elif low in _AT and n:
            ats += 1
        elif low in _DOT:
            dots += 1
        elif word.isalnum():
            letters += 1
        elif word not in "()[]{}<>-+":
            other += 1
        if other or ats > 1 or len(digits) > 19 and not ats:
            return
        if n == 0 or not word.isalnum():
            continue
        end = i + n + 1
        after = tokens[end - 1][1]
        right = text[after] if after < len(text) else " "
        glued_right = not right.isspace() and (right.isalnum() or right in "@-+/_=" or (right == "." and text[after + 1 : after + 2].isalnum()))
        span = text[tokens[i][0] : after]
        spaced = sum(1 for x, y in zip(tokens[i:end], tokens[i + 1 : end]) if x[1] < y[0])
        common = [f"glued:{glued_left}:{glued_right}"]
        for kind in _possible(digits, groups, letters, ats, dots):
            if kind == "email" and (not first.isalnum() or first.lower() in _AT):
                continue
            found = [f"cue:{bool(before & CUES[kind])}", *common]
            if kind == "email":
                tail = words[n]
                found += [
                    f"sign:{'@' in span}", f"dots:{min(dots, 3)}", f"tail:{tail.isalpha() and 2 <= len(tail) <= 6}",
                    f"spaced:{spaced > 0 and '@' in span}", f"digits_only:{letters == 0}",
                    f"spelt:{bool(re.search(r'[^ a-z]at|at[^ a-z]', span.lower()))}",
                ]
            elif kind == "ip":
                octets = re.findall(r"[0-9]+", span)
                found += [
                    f"octets:{all(map(_small, octets))}", f"dots:{dots == 3}", f"spaced:{spaced > 0}",
                    f"opening:{first == '(' or first == '+'}",
                ]
            elif kind == "card":
                found += [
                    f"luhn:{luhn(digits)}", f"digits:{len(digits)}", f"dots:{dots > 0}", f"plus:{'+' in span}",
                    f"even:{len(set(groups[:-1])) <= 1}", f"opening:{first == '('}",
                ]
            else:
                found += [
                    f"plus:{span[0] == '+'}", f"digits:{len(digits)}", f"groups:{'-'.join(map(str, groups[-3:]))}",
                    f"parens:{'(' in span and ')' in span}", f"count:{min(len(groups), 5)}",
                    f"separators:{''.join(sorted({c for c in span if not c.isalnum()}))}",
                ]
            yield end, kind, [f"{kind}|{x}" for x in found] + [f"{kind}|is"]


def _possible(digits: str, groups: list[int], letters: int, ats: int, dots: int) -> list[str]:
    if ats:
        return ["email"] if dots and letters else []
    if letters or not digits:
        return []
    out = []
    if len(groups) == 4 and len(digits) <= 12:
        out.append("ip")
    if 12 <= len(digits) <= 19:
        out.append("card")
    if 7 <= len(digits) <= 15:
        out.append("phone")
    return out


# --- the field -----------------------------------------------------------------------------
Lattice = list[list[tuple[int, str, list[str]]]]


def lattice(text: str, start: int, end: int, taken: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], Lattice]:
    """Tokens of a region and the candidates from each of them, outside taken spans."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
    blocked = [any(a < y and x < b for _, a, b in taken) for x, y in tokens]
    return tokens, [list(segments(text, tokens, i, blocked)) for i in range(len(tokens))]


def decode(paths: Lattice, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best labelling of a region: (first token, end token, kind) of its segments. A token
    outside scores 0."""
    n = len(paths)
    best, choice = [0.0] * (n + 1), [None] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        for end, kind, found in paths[i]:
            score = best[end] + sum(weights.get(f, 0.0) for f in found)
            if score > best[i]:
                best[i], choice[i] = score, (end, kind)
    out, i = [], 0
    while i < n:
        if choice[i]:
            out.append((i, *choice[i]))
            i = choice[i][0]
        else:
            i += 1
    return out


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def gradient(paths: Lattice, gold: set[tuple[int, int, str]], weights: dict[str, float]) -> dict[str, float]:
    """Of the conditional log likelihood: features of the gold segments less their expectation
    by forward and backward sums over all segmentations."""
    n = len(paths)
    scored = [[(e, k, f, sum(weights.get(x, 0.0) for x in f)) for e, k, f in p] for p in paths]
    onward = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        onward[i] = _log_add([onward[i + 1], *[s + onward[e] for e, _, _, s in scored[i]]])
    reach = [-math.inf] * (n + 1)
    reach[0] = 0.0
    incoming: list[list[float]] = [[] for _ in range(n + 1)]
    incoming[0].append(0.0)
    out: dict[str, float] = {}
    for i in range(n):
        reach[i] = _log_add(incoming[i])
        incoming[i + 1].append(reach[i])
        for end, kind, found, s in scored[i]:
            incoming[end].append(reach[i] + s)
            p = math.exp(reach[i] + s + onward[end] - onward[0])
            d = ((i, end, kind) in gold) - p
            for f in found:
                out[f] = out.get(f, 0.0) + d
    return out


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 12, rate: float = 0.2, seed: int = 7) -> dict[str, float]:
    """Weights by stochastic ascent of the penalised likelihood; examples are short texts with
    their spans."""
    r, weights, data = random.Random(seed), {}, []
    for text, spans in examples:
        tokens, paths = lattice(text, 0, len(text), [])
        starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        gold = {(starts[a], ends[b], k) for k, a, b in spans if a in starts and b in ends}
        if any(paths):
            data.append((paths, gold))
    for n in range(rounds):
        r.shuffle(data)
        step = rate / (1 + n / 4)
        for paths, gold in data:
            for f, d in gradient(paths, gold, weights).items():
                weights[f] = weights.get(f, 0.0) + step * (d - 0.002 * weights.get(f, 0.0))
    return weights


def variants(before: str, kind: str, span: str, after: str, r: random.Random) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A found span in its place, other ways of writing it, and look-alikes that are nothing."""
    def put(s: str, real: bool = True):
        return f"{before}{s}{after}", [(kind, len(before), len(before) + len(s))] if real else []

    out, digits = [put(span)], _digits(span)
    if kind == "email":
        user, _, domain = span.partition("@")
        at, dot = r.choice([(" (at) ", "."), (" [at] ", "."), ("(at)", "."), (" at ", " dot "), (" [at] ", " [dot] ")])
        if user[0].isalnum() and user.isalnum():
            out += [put(f"{user}{at}{domain.replace('.', dot)}"), put(f"{user} at noon. {domain.split('.')[0]}", False)]
    elif kind == "ip":
        out += [put(span.replace(".", "[.]")), put(span.replace(".", " [.] ")), put(span.rpartition(".")[0], False)]
        parts = span.split(".")
        parts[r.randrange(4)] = str(r.randint(256, 999))
        out += [put(".".join(parts), False), put("[.]".join(parts), False)]
    elif kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + r.randrange(9)) % 10)
        spoilt = [wrong[i : i + 4] for i in range(0, len(wrong), 4)]
        out += [put(".".join(groups)), put(" - ".join(groups))]
        out += [put(s.join(g), False) for s in ("", "-", ".") for g in (spoilt,) if not luhn(wrong)]
    else:
        last = digits[-10:]
        a, b, c = last[:3], last[3:6], last[6:]
        s = r.choice(["-", ".", " "])
        out += [put(f"({a}) {b}-{c}"), put(f"{a}-{b}-{c}"), put(f"({a}) {b}{s}{c}")]
    year, x = r.randint(1900, 2099), r.randrange
    out += [
        put(s, False)
        for s in (
            f"{year}-{x(1, 13):02}-{x(1, 29):02}", f"{x(100)}.{x(100)}.{x(100)}", str(x(10**6, 10**12)),
            f"{x(1, 13)}/{x(1, 29)}/{year}", f"{x(24):02}:{x(60):02}", f"{x(1000)},{x(1000):03},{x(1000):03}",
            f"{x(10**4):04} {x(10**4):04}", f"{year}-{year + 1}", f"{x(1000):03}-{x(10000):04}-{x(10):01}",
        )
    ]
    return out


@dataclass(frozen=True)
class Settings:
    """sample: documents looked at for training; places: pattern matches used per kind."""

    sample: int = 2000
    places: int = 60


# One invented place per kind, so that every kind is known without any data.
EXAMPLES = (
    ("write to ", "email", "jane@mail.example.org", " soon"), ("the host ", "ip", "192.0.2.17", " answers"),
    ("paid with ", "card", "4111111111111111", " today"), ("call ", "phone", "+1 (202) 555-0143", " now"),
)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> dict[str, float]:
    """Train the field on pattern matches in at most `settings.sample` documents, the first by
    md5 of the key; only short stretches around matches reach the driver."""
    chosen = docs.select(key).filter(F.col(key).isNotNull()).distinct()
    place = F.md5(F.col(key).cast("string").cast("binary"))
    chosen = chosen.orderBy(place, key).limit(settings.sample)
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key).select("_text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("_text"):
                t = x.as_py() or ""
                for kind, a, b in base_spans(t):
                    if b - a <= 64:
                        out.append({"before": t[max(0, a - 24) : a].rpartition("\n")[2], "kind": kind, "span": t[a:b], "after": t[b : b + 24].partition("\n")[0]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.string()) for c in ("before", "kind", "span", "after")]))

    found = rows.mapInArrow(find, "before string, kind string, span string, after string").distinct()
    examples = [variants(*e, random.Random(i)) for i, e in enumerate(EXAMPLES * 5)]
    for kind in KINDS:
        places = found.filter(F.col("kind") == kind).orderBy(F.md5(F.concat("before", "span", "after"))).limit(settings.places)
        for i, r in enumerate(places.collect()):
            examples.append(variants(r["before"], kind, r["span"], r["after"], random.Random(i)))
    return train([x for e in examples for x in e])


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    out = []
    taken = sorted(base, key=lambda s: s[1])
    for start, end in regions(text):
        near = [s for s in taken if s[1] < end and start < s[2]]
        tokens, paths = lattice(text, start, end, near)
        if any(paths):
            out += [(k, tokens[i][0], tokens[j - 1][1]) for i, j, k in decode(paths, weights)]
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find_personal_data(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """`docs` with n_email, n_ip, n_card, n_phone (spans of each kind), base_sha256 (of the
    pattern spans) and spans (all of them: kind:start:end in code points, end exclusive, by
    kind, then start).

    Whole texts are read. A NULL text counts as empty: no spans, the digest of the empty
    string. Added spans never overlap pattern spans. Rows are judged alone: no shuffle,
    repeated rows stay, an empty table gives an empty result; columns named like the new ones
    are replaced.
    """
    base = without(docs, *OUT)
    schema = base.withColumns(
        {**{c: F.lit(0).cast("long") for c in OUT[:4]}, "base_sha256": F.lit(""), "spans": F.lit("")}
    ).schema
    names = base.columns
    at = next(i for i, c in enumerate(names) if c.lower() == text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, all_spans = [], [], []
            for x in batch.column(at):
                t = x.as_py() or ""
                fixed = base_spans(t)
                spans = fixed + added_spans(t, fixed, weights)
                counts.append([sum(s[0] == k for s in spans) for k in KINDS])
                digests.append(hashlib.sha256(_joined(fixed).encode()).hexdigest())
                all_spans.append(_joined(spans))
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *numbers, pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                names=[*names, *OUT],
            )

    return base.mapInArrow(run, schema)
