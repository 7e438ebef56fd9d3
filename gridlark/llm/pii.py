"""Operator 8: personal data with a semi-Markov conditional random field.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Around digits
and ``@`` signs a semi-Markov chain then chooses segments and their types jointly: a candidate
segment of up to ``MAX_TOKENS`` tokens is scored by features of the whole span (digit groups,
separators, checksum, borders), and dynamic programming over (position, type) finds the best
segmentation. Its entities that touch no span of the fixed patterns are added.

The chain is trained here by conditional likelihood on labelled regions: seeded samples of common
forms and look-alikes, beyond what the fixed patterns know, and at most ``max_regions`` regions of a
bounded sample of documents, where the fixed patterns give the labels (long regions in pieces).

Defined results: null and empty texts have no spans. Spans are code-point offsets, end exclusive.
``n_pii`` counts them all. Texts without a digit or ``@`` hold no entity. Repeated rows are scanned row by row; an empty table
gives no rows and the seeded samples alone train the chain; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import outside, scan, table

KINDS = ("email", "ip", "card", "phone")
TYPES = ("none", *KINDS)
MAX_TOKENS = 24
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match can start inside a digit run if none starts at its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
_ANCHOR = re.compile(r"[0-9@]")
_SCHEMA = "doc_id long,n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string,n_added long,n_pii long"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end, "email"
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = list(_emails(text)) if "@" in text else []
    if _ANCHOR.search(text) is None:
        return found
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(*m.span(), "card") for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def ordered(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans))


def regions(text: str):
    """Stretches of words with a digit or ``@``, joined over single spaces: [start, end)."""
    held = None
    at = 0
    while m := _ANCHOR.search(text, at):
        a = b = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if held and a - held[1] == 1 and text[held[1]] == " ":
            held = (held[0], b)
        else:
            if held:
                yield held
            held = (a, b)
        at = b
    if held:
        yield held


FEATURES = (
    "bias", "email_shape", "at_sign", "ip_shape", "four_groups", "luhn", "long_not_luhn", "digits_9_15", "digits_7_8", "digits_10", "digits_few", "digits_many",
    "plus_first", "paren", "dash_or_space_only", "dots", "letters", "other", "left_clean", "right_clean", "groups", "phone_groups", "one_token", "space_inside", "ends_plain", "starts_plain", "date_groups", "inner_plus", "enclosed", "unbalanced",
)


class Region:
    """Tokens of a stretch of text and the feature rows of segments that end at a token."""

    def __init__(self, text: str, start: int, end: int):
        spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.tokens = [text[a:b] for a, b in spans]
        self.kind = ["d" if "0" <= t[0] <= "9" else "l" if t[0].isalpha() else "s" if t.isspace() else t for t in self.tokens]

    def __len__(self) -> int:
        return len(self.tokens)

    def _clean(self, k: int, step: int) -> bool:
        """Nothing that belongs to the segment stands at token k, just outside it."""
        if not 0 <= k < len(self):
            return True
        kind = self.kind[k]
        if kind in "dl@_+":
            return False
        return not (kind in ".-" and 0 <= k + step < len(self) and self.kind[k + step] in "dl")

    def ending(self, j: int) -> tuple[list[int], list[list[float]]]:
        """(starts, feature rows) of allowed segments [i, j); a single token is always allowed."""
        starts, rows = [], []
        digits, letters, other, dots, dashes, spaces, ats, parens, opened, plus = 0, 0, 0, 0, 0, 0, 0, 0, 0, 0
        groups: list[str] = []
        right = self._clean(j, 1)
        last = self.kind[j - 1]
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            kind, token = self.kind[i], self.tokens[i]
            if kind == "d":
                digits += len(token)
                groups.insert(0, token)
            elif kind in "l_%":
                letters += len(token)
            elif kind == ".":
                dots += 1
            elif kind == "-":
                dashes += 1
            elif kind == "s":
                spaces += 1
                if token != " ":
                    other += 1
            elif kind == "@":
                ats += 1
            elif kind in "()":
                parens += 1
                opened += kind == "("
            elif kind == "+":
                plus += 1
            else:
                other += 1
            if i < j - 1 and (kind == "s" or last == "s" or not (digits or ats)):
                continue
            plain = not (letters or other or ats or parens or plus)
            by_dots = plain and not dashes and not spaces
            long = plain and not dots and 12 <= digits <= 19
            passes = long and luhn("".join(groups))
            sizes = [len(g) for g in groups]
            shape = ats == 1 and not spaces and not parens and not other and kind in "dl" and last in "dl" and self._domain(i, j)
            rows.append(
                [
                    1.0, shape, ats > 0, by_dots and dots == 3 and len(groups) == 4 and max(sizes) <= 3 and all(int(g) <= 255 for g in groups), len(groups) == 4 and dots == 3, passes, long and not passes,
                    9 <= digits <= 15, 7 <= digits <= 8, digits == 10, digits <= 6, digits > 19, kind == "+", parens > 0, plain and not dots, dots > 0, letters > 0, other > 0,
                    self._clean(i - 1, -1), right, len(groups) > 1, len(sizes) >= 3 and sizes[-2:] == [3, 4], i == j - 1, spaces > 0, last in "dl", kind in "dl+(", sizes in ([4, 2, 2], [2, 2, 4]), plus > (kind == "+"), kind == "(" and last == ")", opened != parens - opened,
                ]
            )
            starts.append(i)
        return starts, rows

    def _domain(self, i: int, j: int) -> bool:
        at = self.kind.index("@", i, j)
        return at > i and "." in self.kind[at:j] and all(k in "dl.-_%+" or k == "@" for k in self.kind[i:j]) and ".." not in "".join(self.tokens[at:j])


def decode(region: Region, weights: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, str]]:
    """The best segmentation's entities, as text offsets."""
    n = len(region)
    best = np.full((n + 1, len(TYPES)), -np.inf)
    best[0, 0] = 0.0
    into = [None] * (n + 1)  # by position: the best score of entering a segment of each type here
    came = [None] * (n + 1)
    back = [None] * (n + 1)
    for j in range(n + 1):
        if j:
            starts, rows = region.ending(j)
            score = np.array(rows, float) @ weights.T
            score[[k for k, i in enumerate(starts) if i != j - 1], 0] = -np.inf
            total = score + np.array([into[i] for i in starts])
            pick = total.argmax(axis=0)
            best[j] = total[pick, np.arange(len(TYPES))]
            back[j] = [starts[p] for p in pick]
        step = best[j][:, None] + moves
        came[j] = step.argmax(axis=0)
        into[j] = step.max(axis=0)
    out = []
    j, y = n, int(best[n].argmax())
    while j:
        i = back[j][y]
        if y:
            out.append((region.starts[i], region.ends[j - 1], TYPES[y]))
        j, y = i, int(came[i][y])
    return out[::-1]


class Example:
    """A region with its gold segmentation, laid out for training."""

    def __init__(self, region: Region, spans: list[tuple[int, int, str]]):
        self.n = len(region)
        first = {a: k for k, a in enumerate(region.starts)}
        after = {b: k + 1 for k, b in enumerate(region.ends)}
        self.ok = all(a in first and b in after and after[b] - first[a] <= MAX_TOKENS for a, b, _ in spans)
        if not self.ok:
            return
        gold = {(first[a], after[b]): TYPES.index(k) for a, b, k in spans}
        inside = {t for i, j in gold for t in range(i, j)}
        gold |= {(t, t + 1): 0 for t in range(self.n) if t not in inside}
        self.at, rows = [], []
        for j in range(1, self.n + 1):
            starts, own = region.ending(j)
            self.at += [(i, j) for i in starts]
            rows += own
        self.x = np.array(rows, float)
        place = {s: k for k, s in enumerate(self.at)}
        self.ok = all(s in place for s in gold)
        if not self.ok:
            return
        self.begin, self.stop = np.array(self.at).T
        self.multi = self.stop - self.begin > 1
        self.gold = np.array([(place[s], y) for s, y in sorted(gold.items())])

    def gradient(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the conditional log-likelihood of the gold segmentation."""
        n, k = self.n, len(TYPES)
        score = self.x @ weights.T
        score[self.multi, 0] = -1e9
        lse = lambda v, axis: (m := v.max(axis=axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis=axis))
        alpha, into = np.full((n + 1, k), -1e9), np.zeros((n + 1, k))
        alpha[0, 0] = 0.0
        ending = [np.flatnonzero(self.stop == j) for j in range(n + 1)]
        beginning = [np.flatnonzero(self.begin == j) for j in range(n + 1)]
        for j in range(n + 1):
            if j:
                alpha[j] = lse(score[ending[j]] + into[self.begin[ending[j]]], 0)
            into[j] = lse(alpha[j][:, None] + moves, 0)
        beta, out = np.zeros((n + 1, k)), np.full((n + 1, k), -1e9)
        for j in range(n - 1, -1, -1):
            out[j] = lse(score[beginning[j]] + beta[self.stop[beginning[j]]], 0)
            beta[j] = lse(moves + out[j][None, :], 1)
        norm = lse(alpha[n], 0)
        p = np.exp(np.minimum(score + into[self.begin] + beta[self.stop] - norm, 0))
        gm = -sum(np.exp(np.minimum(alpha[j][:, None] + moves + out[j][None, :] - norm, 0)) for j in range(n))
        gold = np.zeros_like(p)
        gold[self.gold[:, 0], self.gold[:, 1]] = 1
        y = np.append(0, self.gold[:, 1])
        np.add.at(gm, (y[:-1], y[1:]), 1)
        return (gold - p).T @ self.x, gm


def samples(count: int = 400, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled regions: common forms of each type and look-alikes."""
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    byte = lambda: str(rng.randint(0, 255))

    def card(good: bool) -> str:
        while luhn(d := rng.choice("3456") + n(15)) is not good:
            pass
        return rng.choice([d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4))])

    good = {
        "email": lambda: f"{rng.choice([word(), word() + '.' + n(2), word() + '_' + word()])}@{rng.choice([word(), word() + n(1) + '.' + word()])}.{rng.choice(['com', 'org', 'net', 'de'])}",
        "ip": lambda: ".".join(byte() for _ in range(4)),
        "card": lambda: card(True),
        "phone": lambda: rng.choice([f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(3)} {n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}"]),
    }
    bad = [
        lambda: card(False), lambda: f"20{n(2)}-{n(2)}-{n(2)}", lambda: f"{n(2)}/{n(2)}/20{n(2)}", lambda: f"{n(1)}.{n(1)}.{n(2)}", lambda: f"{n(2)}:{n(2)}", lambda: n(rng.randint(1, 11)), lambda: n(rng.randint(12, 24)),
        lambda: f"{n(2)}.{n(2)}", lambda: f"@{word()}", lambda: f"@{word()}{n(2)}", lambda: f"{word()}@{word()}", lambda: "".join(rng.choices("0123456789abcdef", k=40)), lambda: word() + n(3), lambda: f"{n(1)},{n(3)},{n(3)}", lambda: f"{n(3)}.{n(3)}.{n(3)}.9{n(2)}", lambda: f"{word()}@{n(2)}", lambda: f"{n(3)}-{n(4)}",
    ]
    out = []
    for k in range(count):
        if k % 2:
            kind = KINDS[(k // 2) % 4]
            value = good[kind]()
            if k % 16 == 1 + 2 * (k // 16 % 8):  # two in a row, which the fixed patterns may read as one
                other = KINDS[rng.randrange(4)] if rng.random() < 0.5 else kind
                more = good[other]()
                out.append((f"{value} {more}", [(0, len(value), kind), (len(value) + 1, len(value) + 1 + len(more), other)]))
                continue
            head, tail = rng.choice([("", ""), ("", "."), ("(", ")"), ("", ","), ('"', '"'), ("<", ">"), ("", "###"), ("tel:", "")])
            if head == "(" and value[0] in "+(":
                head = tail = ""
            out.append((head + value + tail, [(len(head), len(head) + len(value), kind)]))
        else:
            out.append((bad[(k // 2) % len(bad)]() + rng.choice(["", ".", ",", ")", "%%%"]), []))
    return out


def pieces(region: str, size: int = 200) -> list[str]:
    """A region as it is, or a long one in pieces of ``size`` characters at most, cut at spaces where there are some."""
    out = []
    while len(region) > size:
        at = region.rfind(" ", 1, size) if " " in region[1:size] else size
        out.append(region[:at])
        region = region[at:].removeprefix(" ")
    return [*out, region]


def train(docs: DataFrame, max_docs: int = 3000, max_regions: int = 150, epochs: int = 14, rate: float = 0.3, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (type x feature) and moves.

    The sample is the ``max_docs`` documents with the smallest hashes of doc_id and text (equal rows count as
    one); of their different regions the ``max_regions`` with the smallest hashes come to the driver.
    """
    key = F.xxhash64("doc_id", "text")
    edge = docs.select(key.alias("h")).distinct().orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    labelled = [(t, s) for t, s in samples()]
    if edge is not None:

        def find(batch):
            out = []
            for text in batch.column(1).to_pylist():
                for a, b in regions(text or ""):
                    out += pieces(text[a:b])
            return {"region": out}

        rows = scan(docs.where(key <= edge).select("doc_id", "text").distinct(), ["doc_id", "text"], find, "region string").distinct()
        for r in rows.orderBy(F.xxhash64("region"), "region").limit(max_regions).collect():
            spans = ordered(base_spans(r["region"]))
            # overlapping labels can't be one segmentation
            if all(x[1] <= y[0] for x, y in zip(spans, spans[1:])):
                labelled.append((r["region"], spans))
    held = [e for e in (Example(Region(t, 0, len(t)), s) for t, s in labelled) if e.ok]
    w, m = np.zeros((len(TYPES), len(FEATURES))), np.zeros((len(TYPES), len(TYPES)))
    vw, vm = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
    rng = random.Random(3)
    for _ in range(epochs):
        rng.shuffle(held)
        for a in range(0, len(held), 40):
            part = held[a : a + 40]
            gw, gm = -decay * w * len(part), -decay * m * len(part)
            for e in part:
                dw, dm = e.gradient(w, m)
                gw, gm = gw + dw, gm + dm
            vw, vm = vw + gw * gw, vm + gm * gm
            w, m = w + rate * gw / np.sqrt(vw), m + rate * gm / np.sqrt(vm)
    return w, m


def find_pii(text: str, model: tuple[np.ndarray, np.ndarray]) -> tuple[list, list]:
    """(base spans, added spans)."""
    base = base_spans(text)
    added = []
    if _ANCHOR.search(text):
        for a, b in regions(text):
            added += decode(Region(text, a, b), *model)
    return base, outside(added, base)


def pii_spans(docs: DataFrame, max_docs: int = 3000, max_regions: int = 150) -> DataFrame:
    model = train(docs, max_docs, max_regions)

    def find(batch):
        out = {k.split(" ")[0]: [] for k in _SCHEMA.split(",")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base, added = find_pii(text or "", model)
            n = [sum(s[2] == k for s in base) for k in KINDS]
            for key, value in zip(out, (doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added), len(base) + len(added))):
                out[key].append(value)
        return out

    return scan(docs, ["doc_id", "text"], find, _SCHEMA)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
