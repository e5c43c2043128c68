"""Query expansion, similar documents, and clustering helpers."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.analysis import let
from quarry.operators.index import SearchIndex
from quarry.operators.search import Searcher
from quarry.plans import query as Q


def bo1(w: Column, cf: Column, n: Column, total: Column, top: Column) -> Column:
    f = cf / n
    return w * F.log2((1 + f) / f) + F.log2(1 + f)


def bo2(w: Column, cf: Column, n: Column, total: Column, top: Column) -> Column:
    f = w * top / total
    return w * F.log2((1 + f) / f) + F.log2(1 + f)


def kl(w: Column, cf: Column, n: Column, total: Column, top: Column) -> Column:
    share = w / top
    return F.when(share < cf / total, 0.0).otherwise(share * F.log2(share / (w / total)))


MODELS = {"bo1": bo1, "bo2": bo2, "kl": kl}


def key_terms(index: SearchIndex, docs: DataFrame, field: str, number: int = 5, model: str = "bo1", normalize: bool = True) -> DataFrame:
    """Terms that set documents (doc_id) apart, with weights; normalised by the model's value for the highest score."""
    picked = index.postings.where(F.col("field") == field).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return _scored(index, picked.groupBy("term").agg(F.sum("weight").alias("w")), field, number, model, normalize)


def key_terms_from_text(index: SearchIndex, text: str, field: str, number: int = 5, model: str = "bo1", normalize: bool = True) -> DataFrame:
    spark = index.docs.sparkSession
    words = index.specs[field][0].analyzer.analyze(text)
    counts = spark.createDataFrame([(w,) for w in words], "term string").groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return _scored(index, counts, field, number, model, normalize)


def _scored(index, counts, field, number, model, normalize):
    stats = index.term_stats.where(F.col("field") == field).select("term", "cf")
    facts = index.field_stats.where(F.col("field") == field).select("n", "total")
    all_rows = Window.partitionBy(F.lit(0))
    # a handful of documents' terms: the window runs over these only
    rows = counts.join(stats, "term").join(F.broadcast(facts), F.lit(True)).withColumn("top", F.sum("w").over(all_rows))
    rows = rows.withColumn("score", MODELS[model](F.col("w"), F.col("cf"), F.col("n"), F.col("total"), F.col("top")))
    if normalize and model == "bo1":
        m = F.max("score").over(all_rows)
        f = m / F.col("n")
        rows = rows.withColumn("score", F.col("score") / ((m * F.log((1 + f) / f) + F.log(1 + f)) / F.log(F.lit(2.0))))
    return rows.select("term", "score").orderBy(F.desc("score"), "term").limit(number)


def more_like(searcher: Searcher, doc_id: int, field: str, top: int = 10, terms: int = 5, model: str = "bo1", text: str | None = None):
    """Documents like one (or like a text): its key terms, weighted, without the document itself."""
    index = searcher.index
    spark = index.docs.sparkSession
    ids = spark.createDataFrame([(doc_id,)], "doc_id long")
    found = key_terms_from_text(index, text, field, terms, model) if text else key_terms(index, ids, field, terms, model)
    q = Q.Or(tuple(Q.Term(field, r["term"], r["score"]) for r in found.collect()))  # as many rows as terms asked for
    return searcher.search(q, limit=top, mask=ids)


def char_shingles(text: Column, size: int = 2) -> Column:

    def runs(chars: Column) -> Column:
        n = F.size(chars)
        starts = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, F.lit(size)), ""))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), runs)


def simhash(features: Column, bits: int = 32) -> Column:
    """Each bit is the majority of the features' hash bits."""

    def voted(hashes: Column) -> Column:
        def bit(k: int) -> Column:
            votes = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(F.shiftright(h, k).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
            return F.when(votes > 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))

        return functools.reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(bits)])

    return let(F.transform(features, lambda f: F.xxhash64(f)), voted)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def kmeans(values: DataFrame, column: str, k: int, rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """One-dimensional k-means from evenly spread quantiles; adds the column cluster. Centres are k numbers."""
    c = F.col(column).cast("double")
    spread = values.agg(F.percentile_approx(c, [(2 * i + 1) / (2 * k) for i in range(k)]).alias("q")).first()["q"]
    centres = sorted(spread or [])
    nearest = lambda cs: F.array_position(F.transform(F.array(*[F.lit(float(x)) for x in cs]), lambda x: F.abs(c - x)), F.array_min(F.transform(F.array(*[F.lit(float(x)) for x in cs]), lambda x: F.abs(c - x)))).cast("int") - 1
    for _ in range(rounds):
        means = {r["cluster"]: r["m"] for r in values.select(nearest(centres).alias("cluster"), c.alias("v")).groupBy("cluster").agg(F.avg("v").alias("m")).collect()}
        new = [means.get(i, x) for i, x in enumerate(centres)]
        moved = max(abs(a - b) for a, b in zip(new, centres))
        centres = new
        if moved < tolerance:
            break
    return values.withColumn("cluster", nearest(centres))


def windows_of(values: DataFrame, column: str, size: float, partition: str | None = None) -> DataFrame:
    """For each number the count and variance of those up to ``size`` above it: sliding clusters of sorted numbers.

    Numbers are dealt by steps of ``size``: a number's window ends in its own step or the next, so every step is one window
    partition that also holds a copy of the next step's numbers. Rows without a number have an empty window.
    Counts are differences of running counts, so their time grows with the numbers; variances take the time of their windows' contents.
    """
    names, v = values.columns, F.col(f"`{column}`").cast("double")
    step = F.floor(v / F.lit(float(size)))
    rows = values.withColumn("__v", v).withColumn("__home", step).withColumn("__step", F.explode(F.when(v.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(step, step - 1))))
    by = f"`{partition}`, `__step`" if partition else "`__step`"
    order = f"over (partition by {by} order by `__v`"
    upto = f"count(`__v`) {order} range between unbounded preceding and {float(size)}D following)"
    frame = f"over (partition by {by} order by `__v` range between current row and {float(size)}D following)"
    rows = rows.withColumns({"in_window": F.expr(f"case when `__v` is null then 0L else {upto} - rank() {order}) + 1L end"), "spread": F.expr(f"var_pop(`__v`) {frame}")})
    return rows.where(F.col("__step").isNull() | (F.col("__step") == F.col("__home"))).select(*[F.col(f"`{n}`") for n in names], "in_window", "spread")


def weighted_moments(values: DataFrame, value: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, n, weight, mean, variance: weighted mean and (population) variance of each group, in one pass over the rows.

    Each Arrow batch becomes one state a group (n, weight, mean, squared deviations from it) before the shuffle, and states are merged by
    their distance from the common mean, so nothing is lost where a mean is large beside the deviations, and a hot group moves as
    few rows as any other. Rows take part that have a finite value and a finite weight over 0; ``values`` without any give no group.
    """
    keys = [f"k{i}" for i in range(len(by))]
    x, w = F.col(f"`{value}`").cast("double"), F.col(f"`{weight}`").cast("double")
    rows = values.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], x.alias("x"), w.alias("w")).where("w > 0 and x is not null and not isnan(x) and not isnan(w) and abs(x) < double('Infinity') and w < double('Infinity')")
    kinds = dict(rows.dtypes)

    def states(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            code = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), np.int64)
            n = int(code.max()) + 1
            total = np.bincount(code, pdf["w"], n)
            mean = np.bincount(code, pdf["w"] * pdf["x"], n) / total
            mean += np.bincount(code, pdf["w"] * (pdf["x"] - mean[code]), n) / total  # what rounding left
            square = np.bincount(code, pdf["w"] * (pdf["x"] - mean[code]) ** 2, n)
            first = np.unique(code, return_index=True)[1]
            out = pdf.iloc[first][keys].reset_index(drop=True)
            yield out.assign(n=np.bincount(code, minlength=n), w=total, m=mean, s=square)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long, w double, m double, s double"])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    common = F.sum(F.col("w") * F.col("m")).over(group) / F.sum("w").over(group)
    merged = rows.mapInPandas(states, schema).withColumn("c", common).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("m")).alias("wm"), F.sum(F.col("s") + F.col("w") * (F.col("m") - F.col("c")) ** 2).alias("s")
    )
    return merged.where("n > 0").select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "n", "weight", (F.col("wm") / F.col("weight")).alias("mean"), (F.col("s") / F.col("weight")).alias("variance"))
