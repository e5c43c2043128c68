"""A training corpus from raw documents: five stages, each a table in and a table out.

1. language_id: documents whose text is in none of the known languages go.
2. ngram_join: of each group of near copies (five words, similarity 0.8 or more) the smallest id stays.
3. secret_scan: secrets in texts are replaced by [SECRET:kind].
4. mix: sources are mixed to their target weights; documents repeat or go, whole but for one cut
   document per source.
5. bpe: token ids of every text, and digests of the ids and of the text decoded from them.

Each stage handles null texts, ids and sources as its operator's docstring says.
"""

from __future__ import annotations

from quarry.llm import op1_mix, op2_secrets, op4_bpe, op7_ngram_join, op10_langid
from quarry.llm.common import cut, small_batches, table
from quarry.llm.registry import tokenizer_path


def language_id(spark, docs, sf_dir):
    small_batches(spark)
    return op10_langid.identify(docs, op10_langid.fit_folds(docs), keep=True)


def ngram_join(spark, docs, sf_dir):
    small_batches(spark)
    return op7_ngram_join.one_of_each(docs, words=5, num=80, den=100)


def secret_scan(spark, docs, sf_dir):
    small_batches(spark)
    return op2_secrets.redacted(docs)


def mix(spark, docs, sf_dir):
    return op1_mix.mixed_rows(docs)


def bpe(spark, docs, sf_dir):
    small_batches(spark)
    return op4_bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("secret_scan", secret_scan), ("mix", mix), ("bpe", bpe)]

#: Hash orders, trigram models and merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
