"""Operator 1: quality rules with a linear-chain conditional random field over lines.

Each line of a text has a feature vector (character classes, length, ending, repetition, place).
A two-state chain (content, boilerplate) is decoded by Viterbi; the share of words in content lines
decides whether the text stays, after fixed base rules.

The chain is trained here, on a bounded, documented sample: at most ``max_labelled`` rows of
``labels``, of each quality those with the smallest hashes of doc_id and text, with all lines of their
texts, up to 400 000 lines; texts of more than a sixteenth of that are judged, not trained on. Only documents are labelled, so the states of lines are hidden: a good document is all content,
and a poor one holds a boilerplate line somewhere. Training maximises the likelihood of that, so lines
of poor documents that look like those of good ones stay content. Without labels of both kinds every
line counts as content.

Defined results: null and empty texts have no words and fail the base rules. Lines are cut at
``\\n`` only. Null labels are ignored; repeated labels and repeated labelled doc_ids all count.
Repeated rows are judged row by row; empty ``documents`` give no rows, empty ``labels`` a chain that
keeps every line; other columns are not read, and ``keep_quality`` returns all columns as they were.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import release, scan, ship, slices, table, written

_SCHEMA = "doc_id long,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean,kept boolean,content_share double,n_lines long,n_content_lines long"
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Texts are trained on in runs of so many lines; all runs of a text count together.
RUN = 64
FEATURES = ("bias", "upper", "digit", "symbol", "stop", "shout", "other", "foreign", "log_words", "short", "word_length", "ends_sentence", "repeats", "first", "last")
LOWER, UPPER, DIGIT, SPACE, SYMBOL, STOP, SHOUT, OTHER, FOREIGN = range(9)


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[128:] = FOREIGN
    kind[ord("a") : ord("z") + 1] = LOWER
    kind[ord("A") : ord("Z") + 1] = UPPER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[list(_SPACE)] = SPACE
    kind[[ord(c) for c in _SYMBOLS]] = SYMBOL
    kind[[ord(c) for c in ".,;:?"]] = STOP
    kind[ord("!")] = SHOUT
    return kind


_KIND = _classes()


def base_counts(text: str) -> dict:
    """The base statistics of a text, and which of its lines repeat an earlier one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            marked = bytearray(n)
            for i, w in enumerate(windows):
                j = seen.setdefault(w, i)
                if j != i:
                    marked[i : i + 3] = b"\1\1\1"
                    marked[j : j + 3] = b"\1\1\1"
            repeated = sum(marked)
    lines = raw.split(b"\n")
    earlier: set = set()
    dup = bytearray(len(lines))
    for k, line in enumerate(lines):
        if line in earlier:
            dup[k] = 1
        elif line.strip():
            earlier.add(line)
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return {"n_words": n, "word_chars": len(text) - spaces, "n_symbols": sum(text.count(c) for c in _SYMBOLS), "n_dup_lines": sum(dup), "n_repeat_words": repeated, "dup": dup, "n_lines": len(lines)}


def base_failed(c: dict) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def line_features(texts: list[str], counts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(features by line, words by line) of all texts, end to end."""
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    n = len(ends)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    line = np.repeat(np.arange(n), size + 1)
    kind = _KIND[raw]
    by = np.bincount(line * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    by[:, SPACE] -= 1  # the line's own end
    space = kind == SPACE
    words = np.bincount(line[~space & np.append(True, space[:-1])], minlength=n).astype(float)
    chars = np.maximum(size - by[:, SPACE], 1)
    ending = raw[np.maximum(ends - 1, 0)]
    own = np.array([c["n_lines"] for c in counts])
    last = np.zeros(n)
    last[np.cumsum(own) - 1] = 1
    first = np.zeros(n)
    first[np.append(0, np.cumsum(own)[:-1])] = 1
    ratio = lambda k: by[:, k] / chars
    x = np.stack(
        [
            np.ones(n), ratio(UPPER), ratio(DIGIT), np.minimum(4 * ratio(SYMBOL), 1), ratio(STOP), np.minimum(8 * ratio(SHOUT), 1), ratio(OTHER), ratio(FOREIGN),
            np.log1p(words) / 8, words <= 3, np.minimum(chars / np.maximum(words, 1) / 16, 1), (size > 0) & (ending == ord(".")), np.frombuffer(b"".join(c["dup"] for c in counts), np.uint8), first, last,
        ],
        axis=1,
    ).astype(np.float32)
    return x, words


def viterbi(emit: list, move: list) -> bytearray:
    """The best states (1: content) of a chain, content on ties; ``emit`` has two scores a line, ``move[a][b]`` scores a step."""
    (m00, m01), (m10, m11) = move
    if not emit:
        return bytearray()
    a, b = emit[0]
    came = []
    for e0, e1 in emit[1:]:
        to0, to1 = (a + m00 <= b + m10), (a + m01 <= b + m11)
        a, b = (b + m10 if to0 else a + m00) + e0, (b + m11 if to1 else a + m01) + e1
        came.append((to0, to1))
    state = int(b > a) if a != b else 1
    out = bytearray([state])
    for step in reversed(came):
        state = int(step[state])
        out.append(state)
    out.reverse()
    return out


def train_chain(texts: list[tuple[np.ndarray, int]], epochs: int = 120, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature x state) and moves from (features by line, quality) of texts; lines have no labels.

    With p the probability that all lines of a text are content, a good text adds log p (by line) and a
    poor one log(1 - p). Both gradients are that of log p, times a factor (Adam on forward-backward).
    """
    k = len(FEATURES)
    w, move = np.zeros((k, 2)), np.zeros((2, 2))
    if len({y for _, y in texts}) < 2:
        return w, move
    runs = sorted(((x[a : a + RUN], n) for n, (x, _) in enumerate(texts) for a in range(0, len(x), RUN)), key=lambda r: -len(r[0]))
    size, owner = np.array([len(x) for x, _ in runs]), np.array([n for _, n in runs])
    steps = int(size[0])
    alive = [int((size > t).sum()) for t in range(steps)]
    flat = [np.stack([x[t] for x, _ in runs[: alive[t]]]).astype(float) for t in range(steps)]
    good = np.array([y == 1 for _, y in texts])
    # both kinds of text weigh the same
    share = np.where(good, 0.5 / good.sum() / np.maximum([len(x) for x, _ in texts], 1), 0.5 / (~good).sum())
    first, second = np.zeros(2 * k + 4), np.zeros(2 * k + 4)
    for epoch in range(1, epochs + 1):
        emit = [f @ w for f in flat]
        forward, at = [], emit[0]
        forward.append(at)
        content = np.zeros(len(runs))  # the score of all content
        content[: alive[0]] += emit[0][:, 1]
        for t in range(1, steps):
            at = np.logaddexp(forward[-1][: alive[t], 0, None] + move[0], forward[-1][: alive[t], 1, None] + move[1]) + emit[t]
            forward.append(at)
            content[: alive[t]] += emit[t][:, 1] + move[1, 1]
        back = [np.zeros((n, 2)) for n in alive]
        for t in range(steps - 2, -1, -1):
            own = back[t + 1] + emit[t + 1]
            back[t][: alive[t + 1]] = np.logaddexp(own[:, 0, None] + move[:, 0], own[:, 1, None] + move[:, 1])
        norm = np.logaddexp(*(forward[0] + back[0]).T)
        log_p = np.minimum(np.bincount(owner, content - norm, len(texts)), -1e-6)
        factor = (share * np.where(good, 1.0, 1 / np.expm1(log_p) + 1))[owner]  # a poor text's is -p / (1 - p)
        gw, gm = -decay * w, -decay * move
        for t in range(steps):
            n = alive[t]
            gap = -np.exp(forward[t] + back[t] - norm[:n, None])
            gap[:, 1] += 1
            gw = gw + flat[t].T @ (gap * factor[:n, None])
            if t + 1 < steps:
                m = alive[t + 1]
                joint = -np.exp(forward[t][:m, :, None] + move + (emit[t + 1] + back[t + 1])[:, None, :] - norm[:m, None, None])
                joint[:, 1, 1] += 1
                gm = gm + (joint * factor[:m, None, None]).sum(axis=0)
        g = np.concatenate([gw.ravel(), gm.ravel()])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8)
        w, move = w + step[: 2 * k].reshape(k, 2), move + step[2 * k :].reshape(2, 2)
    return w, move


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, max_lines: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """The chain from a bounded labelled sample; features come to the driver, not texts: ``max_lines`` of 60 bytes at most."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    # half for each kind, so that a rare kind is in the sample; what one leaves free goes to the other
    ranked = [known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for y in (0, 1)]
    held = [r.count() for r in ranked]
    half = max_labelled // 2
    take = [min(held[0], max(max_labelled - half, max_labelled - held[1])), min(held[1], max(half, max_labelled - held[0]))]
    known = ranked[0].limit(take[0]).union(ranked[1].limit(take[1]))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_labelled rows
    # doc_ids that occur again make more rows: of each kind those with the smallest hashes stay
    sample = sample.withColumn("by", F.xxhash64("doc_id", "text"))

    def features(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts = [base_counts(t) for t in texts]
        x, _ = line_features(texts, counts)
        ends = np.cumsum([c["n_lines"] for c in counts])
        return {"quality": batch.column(2), "by": batch.column(3), "x": [x[b - c["n_lines"] : b].tobytes() for b, c in zip(ends, counts)]}

    found = written(scan(sample, ["doc_id", "text", "quality", "by"], features, "quality long,by long,x binary"), "labelled")
    # what comes here is bounded in bytes too: very long texts are left out, and of each kind texts come until half of the lines are taken
    width = 4 * len(FEATURES)
    taken = F.sum(F.length("x")).over(Window.partitionBy("quality").orderBy("by", "x").rowsBetween(Window.unboundedPreceding, 0))  # over a bounded sample
    held = found.where(F.length("x") <= width * max_lines // 16)
    rows = [r for y in (0, 1) for r in held.where(F.col("quality") == y).orderBy("by").limit(max(1, take[y])).withColumn("taken", taken).where(F.col("taken") <= width * max_lines // 2).collect()]
    rows.sort(key=lambda r: (r["quality"], r["by"], bytes(r["x"])))
    return train_chain([(np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, len(FEATURES)), int(r["quality"])) for r in rows])


def judge(texts: list[str], model: tuple[np.ndarray, np.ndarray], min_share: float) -> list[dict]:
    """Base statistics and the chain's verdict for each text."""
    w, move = model
    counts = [base_counts(t) for t in texts]
    x, words = line_features(texts, counts)
    emit = (x @ w).tolist()
    move = move.tolist()
    at = 0
    for c in counts:
        n = c["n_lines"]
        states = viterbi(emit[at : at + n], move)
        own = words[at : at + n]
        total = own.sum()
        c["content_share"] = float(own[np.frombuffer(states, np.uint8) == 1].sum() / total) if total else 0.0
        c["n_content_lines"] = sum(states)
        c["base_failed"] = base_failed(c)
        c["kept"] = not c["base_failed"] and c["content_share"] >= min_share
        at += n
    return counts


MIN_SHARE = 0.5


def quality_verdicts(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE, max_labelled: int = 3000) -> DataFrame:
    model = fit(docs, labels, max_labelled)

    def run(batch):
        out = judge([t or "" for t in batch.column(1).to_pylist()], model, min_share)
        names = [f.split(" ")[0] for f in _SCHEMA.split(",")]
        return {"doc_id": batch.column(0)} | {k: [c[k] for c in out] for k in names[1:]}

    return scan(docs, ["doc_id", "text"], run, _SCHEMA, limit=4 << 20)


def keep_quality(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE, max_labelled: int = 3000) -> DataFrame:
    """The documents that pass, all columns as they were."""
    model = fit(docs, labels, max_labelled)
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        release()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                out = judge([t or "" for t in part.column(at).to_pylist()], model, min_share)
                yield part.filter(pa.array([c["kept"] for c in out], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
