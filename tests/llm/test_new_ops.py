"""Conversation repair, source divergence and packing against brute force."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from gridlark.llm import conversations, divergence, packing

SPACE = " \t\n\x0b\x0c\r"
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NAMES = {"u": "user", "a": "assistant"}


def least_repair(rows):
    """Dijkstra over (row, place) by (cost, audit): another way than cells of spans."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, place, lines = heapq.heappop(heap)
        if at == len(rows) and place in (0, 3):
            return cost, audit, lines
        if (at, place) in done:
            continue
        done.add((at, place))
        for k, name in NAMES.items():
            if place in STEP[k]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, STEP[k][place], (*lines, f"{name}:")))
        if at < len(rows):
            role, text, must_go, truncated = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, place, lines))
            if not must_go:
                for k, name in NAMES.items():
                    if place in STEP[k]:
                        heapq.heappush(heap, (cost + 3 + 3 * truncated, audit + "R", at + 1, STEP[k][place], (*lines, f"{name}:{text}")))
                if place in STEP.get(role[:1], {}):
                    heapq.heappush(heap, (cost + 3 * truncated, audit + "K", at + 1, STEP[role[:1]][place], (*lines, f"{role}:{text}")))


def brute_conversations(table):
    convs, plain = collections.defaultdict(list), lambda x: " " if x is None else str(x)
    for conv, turn, role, text in table:
        own = convs[conv]
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else plain(role), "" if kind == 1 else plain(text)
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, judged = set(), collections.Counter(), []
        for _, role, text in rows:
            end = text.strip(SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = least_repair(judged)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def test_span_cells_equal_least_repairs():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", " "])) for _ in range(rng.randint(0, 9))]
        flags = [(r, t, rng.random() < 0.2, rng.random() < 0.3) for r, t in rows]
        cells = [conversations.leaf(r[:1], gone, cut) for r, _, gone, cut in flags]
        cost, audit, _ = conversations.cheapest(conversations.parsed(cells))
        want = least_repair(flags)
        assert (cost, audit, tuple(conversations.repaired(audit, rows))) == want
        # every split of a span gives the same cell
        if len(cells) > 2:
            k = rng.randrange(1, len(cells))
            assert conversations.spanned(conversations.parsed(cells[:k]), conversations.parsed(cells[k:])) == conversations.parsed(cells)


def conversation_rows():
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Well", " ", "", "\t\n", "So?", "a　", "long one without end", "x." * 2000, None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"Line {t % 150}" + "." * (t % 3)) for t in range(700)]  # one long conversation
    rows += [(78, 5, "user", "Same.")] * 40 + [(79, None, "user", f"{k}.") for k in range(9)] + [(None, t, "assistant", "Null.") for t in (3, None, 8)]
    rows += [(80, None, None, None), (81, 2**40, "user", "far."), (81, -(2**40), "assistant", "off.")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(1024, 4 << 20, 64), (16, 4 << 20, 4), (5, 300, 2)])
def test_conversations_equal_brute_force(spark, sizes):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = conversations.repair_conversations(conversations.damaged(table), *sizes).collect()
    want = brute_conversations(rows)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert conversations.repair_conversations(conversations.damaged(table.limit(0))).count() == 0


def brute_divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        shares = {}
        for group in [None, *sorted({d[1] for d in own})]:
            n = collections.Counter(t for d in own if group in (None, d[1]) for t in d[2])
            total = sum(n[t] for t in kept) + 2 * len(kept)
            shares[group] = {t: (1 + 10**9 * (n[t] + 2) // total, n[t]) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for group, p in shares.items():
            if group is None:
                continue
            terms = [(t, f(p[t][0], shares[None][t][0])) for t in kept if p[t][1] and p[t][0] > shares[None][t][0]]
            pairs = [(other, sum(f(p[t][0], q[t][0]) for t in kept)) for other, q in shares.items() if other not in (None, group)]
            for part, found, most in (("term", terms, top), ("pair", pairs, len(pairs))):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, group, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return out


def divergence_rows():
    rng = random.Random(6)
    words = ["a", "Be", "eight888", "Straße", "ÉTÉ", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "漢字" * 6, "x" * 40, "İ", "naïve", "don't", "\U0001f600", "zz" * 30, "tail"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "s0", None, "s2"]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(220)]
    rows += [("en", "s9", None), ("en", "s9", ""), ("xx", "one", "alone"), ("yy", "a", "b c"), ("yy", "b", ""), ("de", "s0", "tail-" * 5000 + "end"), ("de", "s1", "q" * 9000), ("en", "s0", "Be"), ("en", "s1", "tail")]
    return rows + [rows[0]] * 12


def test_divergence_equals_brute_force(spark):
    rows = divergence_rows()
    table = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int").repartition(3)
    for min_docs, cells in ((10, 1 << 19), (1, 7)):
        got = divergence.divergence(table, min_docs, 10, cells).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(brute_divergence(rows, min_docs, 10))
    assert divergence.divergence(table.limit(0)).count() == 0


def test_pieces_of_long_texts_count_once(spark):
    rows = divergence_rows()
    table = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    key = ["lang", "source", "term"]
    whole, cut = (sorted(map(tuple, divergence.term_counts(table, size).groupBy(*key).sum("n", "docs").collect())) for size in (2 << 20, 13))
    assert whole == cut


def test_radix_order_is_stable():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 4, 5000).astype(np.uint64) << np.uint64(s) for s in (62, 33)]
    assert (divergence.radix_order(words) == np.lexsort((words[1], words[0]))).all()


def test_least_slack_equals_enumeration():
    rng = random.Random(8)
    for _ in range(300):
        capacity = rng.choice([16, 32, 64])
        counts = collections.Counter(rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 9)))
        lengths = sorted(counts)
        chosen, slack = packing.least_slack(lengths, counts.__getitem__, capacity)
        items = list((counts - collections.Counter([lengths[-1]])).elements())
        sums = {sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(1 << len(items))}
        assert all(counts[n] >= k > 0 for n, k in chosen.items()) and chosen[lengths[-1]]
        assert slack == min(capacity - lengths[-1] - s for s in sums if s <= capacity - lengths[-1])
        assert sum(n * k for n, k in chosen.items()) == capacity - slack


@pytest.mark.parametrize("high", [4 << 20, 5000])
def test_packing_round_trip(spark, high):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(9)
    words = ["the", "Straße", "don't", "x1y22", "é́", "漢字", "İI", "<|endoftext|>", "a　b", "ΣΑΣ", "\x1c", "zyx" * 9, "", "\n", "\r\n\t"]
    texts = [None, "", " ", "<|startoftext|>"] + [" ".join(rng.choices(words, k=rng.choice([3, 40, 400, 3000]))) for _ in range(60)] + ["same words"] * 9
    rows = [(None if k % 11 == 5 else k // 2, t, k) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    got = packing.pack(table, path, high=high, ids=True).collect()
    library = Tokenizer.from_file(path)
    want = collections.Counter((d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t, _ in rows)
    # pieces of rows that share doc_id and size can't be told apart: rebuild by chains of equal documents
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(ids) == r.ids_crc32
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, ids.tobytes()))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or (at < 2048 and at & at - 1 == 0)
    total = sum(len(ids) // 4 * n for (_, ids), n in want.items())
    assert sum(r.length for r in got) == total
    assert len(sequences) <= total // 2048 + 11 * table.rdd.getNumPartitions()
    for (doc, size), parts in by_doc.items():
        left = collections.Counter({ids: n for (d, ids), n in want.items() if d == doc and len(ids) == 4 * size})
        copies = sum(left.values())
        assert sum(n for _, n, _ in parts) == size * copies
        for start, n, ids in parts:
            assert any(w[4 * start : 4 * (start + n)] == ids for w in left)
        if copies == 1:
            assert b"".join(ids for _, _, ids in sorted(parts)) == next(iter(left))
    assert packing.pack(table.limit(0), path).count() == 0
    assert "ids" not in packing.pack(table, path).columns
