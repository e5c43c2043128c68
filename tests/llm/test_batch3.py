"""Hard negatives, packing and periodic runs against brute force and edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import op3_topk, op11_negatives, op12_packing, op13_runs, registry

VECTORS = "vec_id long, embedding array<double>, label int, Window string, cell int"
DOCS = "doc_id long, text string, start string, ids int"


def mined(rows, every=100, near=5, hard=5):
    """Brute force in Python's whole numbers."""
    live = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in live:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for i, (lab, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in live if j != i)
        for p, pid in [(-s, j) for s, j, other in scored if other == lab][:near]:
            fits = [(-s, j) for s, j, other in scored if other != lab and 80 * p <= -100 * s <= 100 * p][:hard]
            out += [(i, pid, r + 1, j, p, s) for r, (s, j) in enumerate(fits)]
    return sorted(out)


def negatives(df, **options):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in op11_negatives.mine(df, **options).collect())


def vectors_of(seed, n, terms, scale=8):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-3, 4, terms)
    return [(i, [float(x) / scale for x in centre + rng.integers(-2, 3, terms)], int(rng.integers(0, 3))) for i in range(n)]


def test_hard_negatives(spark):
    rows = vectors_of(1, 420, 6)
    rows += [(500, None, 1), (501, [1.0] * 6, None), (502, [1.0, None], 1), (503, [float("nan")] * 6, 1), (504, [float("inf")] * 6, 0), (None, [1.0] * 6, 1)]
    rows += [(600, [], 1), (601, [0.5], 2), (602, [0.25] * 11, 2), (700, [-1.0] * 6, 1), (0, [0.5] * 6, 2), (7, rows[7][1], 2), (8, rows[8][1], rows[8][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    expected = mined(rows)
    assert len({r[:2] for r in expected}) > 15 and len(expected) > 60
    assert negatives(df) == expected
    assert negatives(df.repartition(5)) == expected
    assert negatives(df.limit(0)) == [] and negatives(df.where("vec_id % 100 <> 0")) == []
    assert negatives(df, every=50, positives=2, negatives=3) == mined(rows, 50, 2, 3)


@pytest.mark.parametrize("scale", [2.0**-28, 2.0**-36])
def test_hard_negatives_with_sums_over_floats(spark, scale):
    """Sums from 2^53 (long integers) and from 2^63 (cut to the range of longs)."""
    rows = vectors_of(3, 150, 5, scale)
    expected = mined(rows)
    assert max(abs(r[4]) for r in expected) > 2**53
    if max(abs(r[4]) for r in expected) < 2**63:
        assert negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)) == expected
    else:
        assert all(abs(r[5]) < 2**63 for r in negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)))


def test_products_of_long_and_short_vectors(monkeypatch):
    monkeypatch.setattr(op11_negatives, "SLAB", 4)
    rng = np.random.default_rng(5)
    sides = []
    for n in (7, 9):
        lengths = np.array([0, 3, 4, 5, 13, 8, 1, 2, 12][:n])
        sides.append((lengths, [rng.integers(-9, 9, k) for k in lengths]))
    (a, x), (b, y) = sides
    got = op11_negatives.product(*(op11_negatives.Block(np.arange(len(k)), np.zeros(len(k)), k, np.concatenate(v)) for k, v in sides))
    assert got.tolist() == [[sum(int(p) * int(q) for p, q in zip(u, v)) for v in y] for u in x]


def test_one_label_and_tiles(spark, monkeypatch):
    """Blocks and tiles smaller than the table, one label for two thirds of the rows, equal vectors."""
    rows = vectors_of(4, 900, 4)
    rows = [(i, rows[i % 40][1], 0 if i % 3 else lab) for i, _, lab in rows]
    for module, sizes in ((op11_negatives, {"TILE": 3}), (op3_topk, {"UNIT": 16, "BLOCK": 32, "AHEAD": 64})):
        for name, size in sizes.items():
            monkeypatch.setattr(module, name, size)
    cell = op11_negatives.Mined((np.array([0, 100]), np.array([4, 4]), np.array([1, 2, 3, 4, 4, 3, 2, 1]), np.array([0, 1])), 2, 0)
    cell.see((np.array([5, 3, 0, 9]), np.array([4] * 4), np.array([1] * 16), np.array([0, 0, 0, 1])))
    assert cell.found[cell.taken].tolist() == [3, 5, 9]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    assert negatives(df) == mined(rows)


def test_cells_follow_the_work():
    for n in (500, 600_000, 15_000_000, 10**9):
        asked = max(n // 50, 1)
        parts, groups = op3_topk.dealt(n, asked, 64 * asked, 48)
        cells = parts * groups
        assert cells >= min(64, n // 1024) and (n * asked * 64 / cells < 3 * op3_topk.WORK or cells > op3_topk.MOST / 2)
    assert op3_topk.dealt(0, 0, 0)[0] == 1


TEXTS = [None, "", "  \n ", "one", "a b c d e f g " * 900, "x " * 7000, "<|endoftext|> special", "Straße ΑΣ 中文 🙂 " * 40, "word word\x1cword"]


@pytest.fixture(scope="module")
def packed_docs(spark):
    rnd = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = TEXTS + [" ".join(rnd.choice(words) + str(rnd.randrange(99)) for _ in range(rnd.choice([0, 1, 3, 30, 200, 700, 2500]))) for _ in range(90)]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(5, texts[5], "s", 1), (None, texts[20], "s", 1), (None, None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("group", [1 << 21, 10_000])
def test_packing(spark, packed_docs, group):
    from tokenizers import Tokenizer

    rows, df = packed_docs
    path = registry.tokenizer_path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    expected = collections.Counter((d, tuple(coder.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t, *_ in rows)
    got = op12_packing.pack(df, path, group=group).collect()
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(ids) == r["length"] > 0 and r["cost"] == len(ids) * 6 * 1024 + len(ids) ** 2
        by_doc[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], len(ids), r["sequence_length"]))
    for d, pieces in by_doc.items():  # every id in one piece: the ids of a document's rows, whichever row is whose
        whole = collections.Counter()
        for start, ids, n in pieces:
            whole.update((start + k, x, n) for k, x in enumerate(ids))
        own = collections.Counter()
        for (doc, ids), times in expected.items():
            if doc == d:
                for k, x in enumerate(ids):
                    own[k, x, len(ids)] += times
        assert whole == own
    assert set(by_doc) == {d for d, _ in expected}
    for parts in sequences.values():
        parts.sort()
        assert [a for a, *_ in parts] == np.r_[0, np.cumsum([n for _, n, _ in parts])][:-1].tolist()
        total = sum(n for _, n, _ in parts)
        assert {s for *_, s in parts} == {total} and total <= 2048 and total & (total - 1) == 0  # no padding
    assert op12_packing.pack(df.limit(0), path).count() == 0


def test_packing_is_balanced_and_as_stated():
    """The greedy assignment by a plain scan over all sequences; costs come close."""
    rnd = random.Random(7)
    for _ in range(30):
        lengths = [rnd.choice([1, 2, 5, 30, 60, 63]) for _ in range(rnd.randrange(1, 60))]
        rests = [op12_packing.Rest(rnd.choice([None, k]), 0, n, np.arange(n, dtype=np.uint32)) for k, n in enumerate(lengths)]
        room = op12_packing.capacities(sum(lengths), 64)
        costs, waiting, expected = [0] * len(room), [], []
        ids = sorted(range(len(rests)), key=lambda k: (rests[k].doc_id is not None, rests[k].doc_id or 0))
        waiting = [[n, turn, 0] for turn, n in enumerate(lengths[k] for k in ids)]
        while waiting:
            waiting.sort(key=lambda w: (-w[0], w[1]))
            n, turn, placed = waiting.pop(0)
            fits = [s for s in range(len(room)) if room[s] >= n] or [s for s in range(len(room)) if room[s]]
            best = min(fits, key=lambda s: (costs[s], s))
            taken = min(n, room[best])
            expected.append((best, ids[turn], placed, taken))
            room[best] -= taken
            costs[best] += op12_packing.cost(taken)
            if taken < n:
                waiting.append([n - taken, turn, placed + taken])
        got = op12_packing.balanced(rests, 64)
        assert sorted((s, r.ids[0], len(r.ids), r.doc_id is None, r.doc_id) for r, s, *_ in got) == sorted((s, p, n, rests[k].doc_id is None, rests[k].doc_id) for s, k, p, n in expected)
    rests = [op12_packing.Rest(k, 0, n, np.zeros(n, np.uint32)) for k, n in enumerate(rnd.choices([10, 100, 400, 1500], k=4000))]
    costs = collections.Counter()
    for r, s, _, length in op12_packing.balanced(rests, 2048):
        if length == 2048:
            costs[s] += op12_packing.cost(len(r.ids))
    plain = collections.Counter()
    at = 0
    for r in rests:  # filled as they come, cut where a sequence ends
        left = len(r.ids)
        while left:
            n = min(left, 2048 - at % 2048)
            plain[at // 2048] += op12_packing.cost(n)
            at, left = at + n, left - n
    spread = lambda c: np.std(list(c.values())) / np.mean(list(c.values()))
    assert spread(costs) < spread(plain)


def brute_runs(words):
    """All runs by the definition: every period, every maximal stretch, kept where no smaller period holds for all of it."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                stretch = words[i : j + q]
                if not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_texts():
    rnd, out = random.Random(8), ["", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "b " + "a " * 30 + "b", "a b c " * 3 + "a b", "a b c " * 4]
    for _ in range(300):
        words = []
        while len(words) < rnd.choice([5, 40, 200]):
            block = [rnd.choice("ab") for _ in range(rnd.choice([1, 2, 3, 5, 8]))] if rnd.random() < 0.7 else [rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 12))]
            words += block * rnd.choice([1, 1, 2, 4, 5, 9])
        out.append(" ".join(words))
    nested = ("a b " * 5 + "c ") * 6  # runs inside the periods of a run
    return [*out, nested, (nested + "d ") * 5, "x y z " * 400, ("p q " * 4 + "r s " * 4) * 12]


def test_runs_by_brute_force():
    texts = [t.split() for t in run_texts()]
    known = {}
    numbers = [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
    got = op13_runs.runs_of(numbers)
    assert got == [brute_runs(t) for t in texts]
    assert [op13_runs.runs_of([x])[0] for x in numbers] == got  # whatever lies beside a text
    assert sum(map(len, got)) > 300 and any(len({q for *_, q in r}) > 2 for r in got)
    assert op13_runs.runs_of([]) == []


def test_a_periodic_text_is_searched_in_time():
    words = np.tile(np.arange(10), 200_000)
    assert op13_runs.runs_of([words]) == [[(0, 2_000_000, 10)]]


def test_word_runs(spark):
    texts = [None, " \n", *run_texts()[:80], "the\x1cfox " * 9, "é b c " * 7, "The the " * 9]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "s", 1), (None, texts[-1], None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, op13_runs.digests(op13_runs.find(op13_runs.planted(df))).collect()), key=str)
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected, changed = [], 0
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
            changed += 1
        runs = brute_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        expected.append((i, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert changed > 3
    assert got == sorted(expected, key=str)
    assert op13_runs.digests(op13_runs.find(op13_runs.planted(df.limit(0)))).count() == 0
    found = {r["doc_id"]: r for r in op13_runs.find(df).collect()}
    assert found[1]["runs"] == [] and found[1]["collapsed"] == "" and [tuple(r) for r in found[5]["runs"]] == brute_runs(texts[5].split())
