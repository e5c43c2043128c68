"""Re-Pair shards against a one-pair-at-a-time Re-Pair, and random access."""

import collections
import random

import numpy as np
import pytest

from quarry.llm import op6_repair


def brute(docs, first):
    """Re-Pair as published: the most frequent pair is replaced everywhere, left to right, until none occurs twice."""
    docs, rules = [list(map(int, d)) for d in docs], 0
    while True:
        counts = collections.Counter()
        for d in docs:
            k = 0
            while k + 1 < len(d):
                counts[d[k], d[k + 1]] += 1
                k += 2 if k + 2 < len(d) and d[k] == d[k + 1] == d[k + 2] else 1
        pair, n = max(counts.items(), key=lambda x: (x[1], x[0]), default=(None, 0))
        if n < 2:
            return sum(map(len, docs)), rules
        for j, d in enumerate(docs):
            out, k = [], 0
            while k < len(d):
                if k + 1 < len(d) and (d[k], d[k + 1]) == pair:
                    out.append(first + rules)
                    k += 2
                else:
                    out.append(d[k])
                    k += 1
            docs[j] = out
        rules += 1


def shapes():
    rnd = random.Random(5)
    phrases = [[rnd.randrange(1, 60) for _ in range(rnd.randrange(2, 9))] for _ in range(40)]
    return {
        "phrases": [[x for _ in range(rnd.randrange(40)) for x in rnd.choice(phrases)] + [0] for _ in range(25)],
        "few ids": [[rnd.randrange(1, 4) for _ in range(500)] + [0] for _ in range(4)],
        "copies": [[*range(1, 200), 0]] * 6,
        "one id": [[7] * 1000 + [0]],
        "rising": [[*range(1, 300), 0], [*range(1, 290), 0]],
        "short": [[0], [0], [3, 0]],
    }


@pytest.mark.parametrize("shape", shapes())
def test_grammar_is_near_that_of_one_pair_at_a_time(shape):
    docs = [np.array(d, np.uint32) for d in shapes()[shape]]
    flat, ends = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    ends[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, last, rules, lengths = op6_repair.compress(flat, ends, 1000)
    least_symbols, least_rules = brute(docs, 1000)
    assert len(symbols) + 2 * len(rules) <= 1.16 * (least_symbols + 2 * least_rules) + 4
    seen = collections.Counter()
    for k in range(len(symbols) - 1):
        if not last[k]:
            seen[symbols[k], symbols[k + 1]] += 1
    assert all(n < 2 or a == b for (a, b), n in seen.items())  # overlapping occurrences of one id may remain
    assert (op6_repair.expand(symbols, rules, lengths.astype(np.int64), 1000) == flat).all()


def test_random_access_and_wide_numbers():
    rng = np.random.default_rng(1)
    docs = [(None if k == 1 else k - 3, np.append(np.tile(rng.integers(1, 70000, n), 3), 0).astype(np.uint32)) for k, n in enumerate([0, 1, 900, 5, 2000])]
    shard = op6_repair.Shard(op6_repair.pack(docs, 70001))
    flat = np.concatenate([x for _, x in docs])
    assert (shard.whole() == flat).all() and max(shard.lengths) > 255
    for k, (_, ids) in enumerate(docs):
        assert (shard.document(k) == ids).all()
    for a, b in [(0, 0), (0, 1), (5, 6), (511, 513), (17, 4000), (len(flat) - 1, len(flat)), (0, len(flat))]:
        assert (shard.ids(a, b) == flat[a:b]).all()
    assert list(shard.doc_ids[shard.nulls == 0]) == [-3, -1, 0, 1]


def test_encoder_equals_the_library():
    from quarry.llm.registry import tokenizer_path

    coder, rnd = op6_repair.Encoder(tokenizer_path("byte_bpe_50k.json")), random.Random(3)
    alphabet = "ab Zé9²'  \n\t\x85\xa0sremtvdl.,-ɏ½_"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    texts += ["don't we've they're I'll 's 'sup ''s .'s \"'ve 9've x' y'", "a" * 100 + " " + "b'" * 70, "", None, "'", " '", "'r", "\x01 a", "a\x00b", "x" * 3000 + "<|endoftext|>", "日本 don't", "long words " * 90000]
    expected = coder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    for got, want in zip(coder.encode(texts), expected):
        assert got.tolist() == want.ids
    assert list(op6_repair.parts("ab  cd ef", 3)) == ["ab  cd", " ef"] and list(op6_repair.parts("abcdef", 3)) == ["abcdef"]
