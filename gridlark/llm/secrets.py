"""Operator 7: secret scan by two character Markov models.

Fixed patterns find assignments, access keys and long hex runs. Beyond them, every run of ``MIN_RUN`` or
more key characters is scored by the log-likelihood ratio of two first-order character models: one of
random strings, one of ordinary identifiers, words and numbers. Both are trained from labelled samples:
seeded strings of common key forms against seeded identifiers, dates, versions and paths; and from a
bounded sample of documents the values that the fixed patterns find against all other runs. A run is a
secret when its ratio passes ``min_llr`` nats in total, and it does not overlap a span already found; so a
short run must look the more random.

Defined results: null and empty texts have no spans. Spans are code-point offsets, end exclusive, of
whole matches. With an empty sample the seeded strings alone train the models. Repeated rows are scanned
row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import outside, scan, table

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_CUES = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The shortest run that is scored: shorter ones can't pass the ratio that a secret needs.
MIN_RUN = 8
#: A run that is long enough is met at its first character.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
_N = len(_ALPHABET)
#: Characters to numbers; what is between strings is number _N, the state before a first character.
_CODE = np.full(128, _N, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(_N)
_SCHEMA = "doc_id long,n_assign long,n_access long,n_hex long,base_sha256 string,spans string,n_markov long"


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """What the fixed patterns find. Hex runs lie inside runs of key characters."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(c in low for c in _CUES):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    for a, b in key_runs(text) if runs is None else runs:
        if b - a >= 32:
            found += [(*m.span(), "hex") for m in _HEX.finditer(text, a, b)]
    return found


def key_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def ordered(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans))


def _pairs(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character before, character, number of its string) of all strings, end to end."""
    code = _CODE[np.frombuffer(("\n" + "\n".join(strings)).encode("ascii"), np.uint8)]
    at = np.flatnonzero(code < _N)
    return code[at - 1], code[at], np.cumsum(code == _N)[at] - 1


def pair_counts(strings: list[str]) -> np.ndarray:
    """Counts of neighbouring characters; row _N counts first characters."""
    before, char, _ = _pairs(strings)
    return np.bincount(before * _N + char, minlength=(_N + 1) * _N).reshape(_N + 1, _N).astype(float)


def random_strings(count: int = 4000, seed: int = 11) -> list[str]:
    """Labelled random samples: base64, base62, hex and upper-case keys of common lengths."""
    rng = random.Random(seed)
    sets = (_ALPHABET[:64], _ALPHABET[:62], "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    return ["".join(rng.choices(sets[k % len(sets)], k=rng.choice((12, 16, 20, 24, 32, 40, 64)))) for k in range(count)]


_SYLLABLES = "ba con der en fi ge ho in ja ker lo men ni or per qua re sta ti un ver wor xa y za get set user name list index value handler manager request response config http data file test".split()


def ordinary_strings(count: int = 4000, seed: int = 13) -> list[str]:
    """Labelled ordinary samples: identifiers, numbers, dates, versions, paths, file names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3)))
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    forms = (
        lambda: word() + "".join(word().title() for _ in range(rng.randint(1, 3))), lambda: "_".join(word() for _ in range(rng.randint(2, 4))), lambda: "-".join(word() for _ in range(rng.randint(2, 5))), lambda: "/".join(word() for _ in range(rng.randint(2, 5))),
        lambda: word().upper() + "_" + word().upper(), lambda: "".join(word().title() for _ in range(rng.randint(2, 4))) + number(rng.randint(0, 2)), lambda: f"20{number(2)}-{number(2)}-{number(2)}", lambda: number(rng.randint(5, 20)), lambda: f"{number(3)}-{number(4)}", lambda: f"v{number(1)}-{number(2)}-{word()}",
        lambda: word() + word() + word(), lambda: "=" * rng.randint(8, 60), lambda: "-" * rng.randint(8, 60), lambda: f"{word()}{number(rng.randint(1, 4))}-{number(rng.randint(1, 4))}",
    )
    return [rng.choice(forms)() for _ in range(count)]


def fit(random_counts: np.ndarray, ordinary_counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of each character after each other."""
    log = lambda n: np.log((n + smooth) / (n + smooth).sum(axis=1, keepdims=True))
    return log(random_counts) - log(ordinary_counts)


def ratios(runs: list[str], ratio: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each run."""
    before, char, of = _pairs(runs)
    return np.bincount(of, ratio[before, char], len(runs))


def train(docs: DataFrame, max_docs: int = 2000) -> np.ndarray:
    """Both models from the ``max_docs`` documents with the smallest hashes of doc_id and text (equal rows count as one); only counts come back."""
    key = F.xxhash64("doc_id", "text")
    edge = docs.select(key.alias("h")).distinct().orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]

    def count(batch):
        hits, rest = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for a, b, kind in base:
                value = _ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                hits.append("".join(c for c in value if c in _ALPHABET))
            rest += [text[a:b] for a, b in outside([m.span() for m in _WORD.finditer(text)], base)]
        n = np.concatenate([pair_counts(hits).ravel(), pair_counts(rest).ravel()]).astype(int)
        at = np.flatnonzero(n)
        return {"cell": at, "n": n[at]}

    total = np.stack([pair_counts(random_strings()), pair_counts(ordinary_strings())])
    if edge is not None:
        counted = scan(docs.where(key <= edge).select("doc_id", "text").distinct(), ["doc_id", "text"], count, "cell long,n long").groupBy("cell").agg(F.sum("n").alias("n"))
        for row in counted.collect():  # a row for each pair of characters at most
            total.reshape(-1)[row["cell"]] += row["n"]
    return fit(*total)


def find_secrets(texts: list[str], ratio: np.ndarray, min_llr: float) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; the runs of all texts are scored at once."""
    out, runs, of = [], [], []
    for k, text in enumerate(texts):
        own = key_runs(text)
        base = base_spans(text, own)
        out.append((base, []))
        own = outside(own, base)
        runs += [(a, b, text[a:b]) for a, b in own]
        of += [k] * len(own)
    for i in np.flatnonzero(ratios([r[2] for r in runs], ratio) > min_llr) if runs else ():
        out[of[i]][1].append((*runs[i][:2], "markov"))
    return out


def secret_spans(docs: DataFrame, min_llr: float = 10.0, max_docs: int = 2000) -> DataFrame:
    ratio = train(docs, max_docs)

    def find(batch):
        out = {k.split(" ")[0]: [] for k in _SCHEMA.split(",")}
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for doc_id, (base, added) in zip(batch.column(0).to_pylist(), find_secrets(texts, ratio, min_llr)):
            n = {k: sum(s[2] == k for s in base) for k in KINDS}
            row = (doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))
            for key, value in zip(out, row):
                out[key].append(value)
        return out

    return scan(docs, ["doc_id", "text"], find, _SCHEMA, limit=4 << 20)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
