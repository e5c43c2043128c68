"""Language identification against a written-out Bayes computation; clashing columns of the operators that carry rows along."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import op1_mix, op2_secrets, op7_ngram_join, op10_langid, registry


def brute(rows, models, host, declared=None, address=None):
    """Posterior of every row by the formula: text, declaration and suffix, times the smoothed prior of its host."""
    names = models[0].languages

    def text_log(model, text):
        data = f" {text} ".encode() if text else b""
        out, n = [0.0] * len(names), 0
        for k in range(max(0, len(data) - 2)):
            three = [c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in data[k : k + 3]]
            if three != [32, 32, 32]:
                code = ((three[0] | three[1] << 8 | three[2] << 16) * 2654435761 % 2**32) >> 16
                out = [o + float(model.table[code, j]) for j, o in enumerate(out)]
                n += 1
        return out, n

    def add(log, named, trust):
        if named in names:
            return [x + math.log(trust if l == named else (1 - trust) / (len(names) - 1)) for x, l in zip(log, names)]
        return log

    logs, oks = [], []
    for r in rows:
        model = models[r["fold"]]
        log, n = text_log(model, r["text"])
        oks.append(n > 0 and max(log) / n >= model.floor - 15 / math.sqrt(n))
        log = [0.5 * x for x in log]
        if declared and r[declared]:
            log = add(log, r[declared].split("-")[0].lower(), 0.85)
        if address and r[address]:
            log = add(log, {"de": "de", "fr": "fr", "es": "es", "uk": "en"}.get(r[address].split("/")[2].split(".")[-1]), 0.6)
        logs.append(log)

    def share(log):
        top = max(log)
        e = [math.exp(x - top) for x in log]
        return [x / sum(e) for x in e]

    hosts, domains, whole = (collections.defaultdict(lambda: [0.0] * len(names)) for _ in range(3))
    domain = lambda h: ".".join(h.split(".")[-2:]) if h.count(".") > 1 else h
    for r, log, ok in zip(rows, logs, oks):
        if ok and r[host] is not None:
            for kind, key in ((hosts, r[host]), (domains, domain(r[host])), (whole, "")):
                kind[key] = [a + b for a, b in zip(kind[key], share(log))]
    all_ = [x + 1 for x in whole[""]]
    shares = [x / sum(all_) for x in all_]
    smooth = lambda c, q: [(a + 8 * b) / (sum(c) + 8) for a, b in zip(c, q)]
    out = []
    for r, log, ok in zip(rows, logs, oks):
        prior = smooth(hosts[r[host]], smooth(domains[domain(r[host])], shares)) if r[host] in hosts else shares
        p = share([x + math.log(q) for x, q in zip(log, prior)])
        best = max(range(len(names)), key=lambda k: (p[k], -k))
        out.append((names[best], p[best]) if ok else (None, None))
    return out


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000")


def test_documents_equal_the_written_out_formula(spark, small):
    models = op10_langid.fit_folds(small, per_language=20)
    out = {r["doc_id"]: (r["language"], r["confidence"]) for r in op10_langid.identify(small, models).collect()}
    rows = [r.asDict() for r in small.withColumn("fold", op10_langid.fold_of("doc_id")).collect()]
    for r, (language, confidence) in zip(rows, brute(rows, models, "source")):
        assert out[r["doc_id"]][0] == language
        assert confidence is None or out[r["doc_id"]][1] == pytest.approx(confidence, rel=1e-4)
    hits = [out[r["doc_id"]][0] == r["lang"] for r in rows]
    assert np.mean(hits) > 0.97  # by models that saw none of these rows' labels


def test_pages_use_declaration_address_and_host(spark, small):
    pages = [(k, f"http://a{k % 3}.site.{'de' if k % 2 else 'fr'}/{k}", f'<html lang="{"de-AT" if k % 3 else "fr"}"><head><title>no</title></head><body><p>{t}</p><script>var x = "<p>";</script>') for k, t in enumerate(["re", "la re", "", "der die und ein", "que les de la", "of the and this", "12", "re"])]
    pages += [(100, None, "<p>la re"), (101, "mailto:x", None), (None, "http://b.uk/", "<html lang='xx'>the and"), (7, "http://a1.site.de/7", pages[7][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    models = op10_langid.fit_folds(small, per_language=20)
    evidence = op10_langid.page_evidence(df)
    rows = [r.asDict() for r in evidence.withColumn("fold", op10_langid.fold_of("page_id")).collect()]
    assert [r["declared"] for r in rows[:3]] == ["fr", "de-AT", "de-AT"] and rows[0]["host"] == "a0.site.fr" and rows[8]["host"] is None
    got = op10_langid.identify(evidence, models, id_col="page_id", host="host", declared="declared", address="address").collect()
    key = lambda x: (str(x[0]), str(x[1]), round(x[2] or 0, 4))
    want = [(r["page_id"], *x) for r, x in zip(rows, brute([{**r, "address": r["address"] if (r["address"] or "").startswith("http") else None} for r in rows], models, "host", "declared", "address"))]
    assert sorted(map(key, [(r["page_id"], r["language"], r["confidence"]) for r in got])) == sorted(map(key, want))
    both = op10_langid.languages_of(small, df)
    assert both.where("page_id is null").count() == small.count() + 1 and both.where("doc_id < 0").count() == len(pages) - 1


def test_registered_query_covers_both_tables(spark):
    out = registry.op10_language_id(spark, "/root/testdata/sf0.001")
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in ("documents", "pages"))
    assert out.where("doc_id >= 0").count() == docs and out.where("page_id is not null and doc_id < 0").count() == pages


def test_labels_of_one_half_only_and_empty_tables(spark):
    rows = [(k, "alpha beta gamma delta " * 3, "a", "s") for k in range(30)]
    one = next(k for k in range(100, 200) if spark.range(k, k + 1).select(op10_langid.fold_of("id")).first()[0] == 1)
    df = spark.createDataFrame([*rows, (one, "uno dos tres cuatro cinco " * 5, "b", "s")], "doc_id long, text string, lang string, source string")
    models = op10_langid.fit_folds(df)
    assert models[0].languages == models[1].languages == ["a", "b"]
    assert {r["language"] for r in op10_langid.identify(df, models).collect()} == {"a", "b"}
    empty = df.limit(0)
    assert op10_langid.identify(empty, op10_langid.fit_folds(empty), keep=True).count() == 0
    assert op10_langid.identify(empty, models, keep=True).columns == df.columns


def test_clashing_columns_keep_their_values(spark, small):
    names = "__sk __size __total __target __taken __key __id __part __prior __host __gone __again gone again fold prior host c0 component_id kept".split()
    df = small.limit(40).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    models = op10_langid.fit_folds(small, per_language=20)
    for out in (op1_mix.mixed_rows(df), op10_langid.identify(df, models, keep=True), op7_ngram_join.one_of_each(df), op2_secrets.redacted(df)):
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    empty = df.limit(0)
    for out in (op1_mix.mixed_rows(empty), op7_ngram_join.one_of_each(empty), op2_secrets.redacted(empty)):
        assert out.count() == 0 and out.columns == df.columns
