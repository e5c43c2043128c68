"""Streaming forms: texts and ids in small pieces, long runs, hot and repeated conversations."""

import collections
import hashlib
import random

import pytest

from quarry.llm import op3_topk, op4_bpe, op5_media, op9_chat, registry
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_and_decoder_states(spark, name, monkeypatch):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path(name)
    library, own = Tokenizer.from_file(path), op4_bpe.transducer(path)
    rnd = random.Random(6)
    alphabet = "abthe é😀日'  \n\t\u00a0\u3000.,9"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(300))) for _ in range(60)] + ["a " * 50 + "<|endoftext|> b", "<|endoftext|><|endoftext|>", "x" * 200, " " * 90]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    whole = [own.encode(t) for t in texts]
    monkeypatch.setattr(op4_bpe, "PIECE", 7)
    for t, ids, one in zip(texts, expected, whole):
        parts = list(own.stream(t))
        assert [i for p in parts for i in p] == ids == one
        assert len(parts) > 3 or len(t) < 60 or " " not in t.strip()
        for step in (1, 2, 5):
            machine = own.decoder()
            fed = "".join(machine.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + machine.end()
            assert fed == library.decode(ids, skip_special_tokens=False)


def test_encoding_of_empty_tables_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [(1, "the then", 5), (1, "the then", 5), (None, None, None), (2, "word " * 200000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumn("n_tokens", F.lit("x"))
    path = registry.tokenizer_path("word_bpe_49k.json")
    out = op4_bpe.encode_decode(df, path).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == [(0, 0), (1, 2), (1, 2), (2, 200000)]
    assert op4_bpe.encode_decode(df.limit(0), path, with_ids=True).count() == 0
    assert op5_media.inspect(op5_media.store(df.limit(0))).count() == 0
    held = op5_media.inspect(op5_media.store(df)).collect()
    assert len(held) == 4 and len({r["media_sha256"] for r in held}) == 3 and {r["n_bytes"] for r in held} == {8, 0, 1000000}


def test_a_hot_conversation_is_rendered_in_many_tasks(spark):
    log = [(5, k, k, "message", "user" if k % 2 else "assistant", f"</s> \\ turn {k}") for k in range(3000)] + [(5, 7, 7, "message", "user", "again"), (5, 7, 7, "message", "user", "again"), (6, 0, 0, "message", "user", "x" * 3_000_000)]
    events = spark.createDataFrame(log, "conv_id long, turn int, seq int, kind string, role string, text string").withColumns({"rank": F.lit("r"), "piece": F.lit(1)})
    pieces = op9_chat.format_log(events)
    out = {r["conv_id"]: r for r in op9_chat.read_back(pieces).collect()}
    order = sorted((r for r in log if r[0] == 5), key=lambda r: (r[1], r[4], r[5]))
    assert out[5]["n_turns"] == 3002 and out[5]["turns_sha256"] == hashlib.sha256("".join(f"{r[4]}\n{r[5]}\n" for r in order).encode()).hexdigest()
    assert out[5]["loss_sha256"] == hashlib.sha256("".join(r[5] for r in order if r[4] == "assistant").encode()).hexdigest()
    assert out[6]["formatted_chars"] == 3_000_015
    fold = events.select("conv_id", "turn").repartition(8, "conv_id", "turn").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in fold) < 700  # the exchange before folding and rendering spreads one conversation


def test_top_k_of_repeated_rows_and_clashing_columns(spark):
    rows = [(k % 120, [float((k * j) % 5 - 2) for j in range(1, 5)]) for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("s"), "query_id": F.lit("q"), "rank": F.lit(1)})
    out = op3_topk.top_k(df).collect()
    assert all(isinstance(r["score"], int) for r in out)
    assert collections.Counter(r["query_id"] for r in out)
