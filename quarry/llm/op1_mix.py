"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Within its source the rows are range-sorted by that key: the key
space of a source is split into about sqrt(rows) ranges, prefix sums of sizes run inside each range
and over the range totals, so the hottest source is spread over many tasks and no task sees more
than about sqrt(rows) range totals. The prefix sums give the one cut row of each source; what a row
takes follows from its key and its source's cut alone, so texts are never shuffled.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own,
last in order; a null id sorts first among equal keys; rows that are equal in id and text share the
words left at the cut evenly (rounded down, so a source may miss its budget by fewer words than it
has such copies); an empty table gives an empty result; a source without words has target 0.
The table with one row for each source is ordered in one task (targets depend on all sources).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, cut, numbered

MAX_EPOCHS = 3
LOWEST = -(2**63)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with __sk (source, never null), __size, __key (53 random bits) and __id."""
    return docs.withColumns(
        {
            "__sk": F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source))),
            "__size": word_count(F.col(text)),
            "__key": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 11),
            "__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)),
        }
    )


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds __target to one row per source (__sk, source, __total, __rows).

    Weights repeat ``cycle`` in code point order, null last. A target is min(epochs * total, level * weight)
    with the level at which all targets add up to all words: the fixed point of capping and resharing.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place + 1).cast("int"))
    ranked = sources.withColumn("__weight", weight).withColumn("__cap", F.lit(float(epochs)) * F.col("__total"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__sk"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("__all", F.sum("__total").over(whole)).withColumn("__weights", F.sum("__weight").over(whole))
    left = F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("__level", left / (F.col("__weights") - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))))
    ratio = F.col("__cap") / F.col("__weight")
    ranked = ranked.withColumn("__open", F.when(ratio >= F.col("__level"), F.struct(ratio.alias("r"), F.col("__sk").alias("k"), F.col("__level").alias("level"))))
    final = F.min("__open").over(whole)["level"]
    return ranked.withColumn("__target", F.least(F.col("__cap"), F.coalesce(final * F.col("__weight"), F.col("__cap"))))


def cuts(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: total, target, whole epochs and the cut row (key, id, size, words each equal row takes)."""
    per = sized.groupBy("__sk").agg(F.first("source").alias("source"), F.sum("__size").alias("__total"), F.count(F.lit(1)).alias("__rows"))
    per = targets(per, cycle, epochs)
    budget = F.floor(F.col("__target") + F.lit(0.5)).cast("long")
    per = per.withColumn("__epochs", F.when(F.col("__total") > 0, F.floor(budget / F.col("__total"))).otherwise(0).cast("long"))
    per = per.withColumn("__left", budget - F.col("__epochs") * F.col("__total"))
    per = cut(per.select("__sk", "source", "__total", "__rows", "__target", "__epochs", "__left"), "sources")
    ranges = F.ceil(F.sqrt(F.col("__rows").cast("double")))
    spot = F.floor(F.col("__key").cast("double") * ranges / F.lit(float(2**53))).cast("long")
    rows = sized.join(per.select("__sk", "__rows", "__left"), "__sk").where("__left > 0 and __size > 0")
    rows = rows.withColumn("__range", spot).select("__sk", "__range", "__key", "__id", "__size", "__left")
    totals = rows.groupBy("__sk", "__range").agg(F.sum("__size").alias("__sum"), F.first("__left").alias("__left"))
    so_far = Window.partitionBy("__sk").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(so_far), F.lit(0)))
    hit = totals.where("__base < __left and __left <= __base + __sum").select("__sk", "__range", "__base")
    inside = Window.partitionBy("__sk").orderBy("__key", "__id", "__size")
    found = rows.join(hit, ["__sk", "__range"]).groupBy("__sk", "__key", "__id", "__size", "__left", "__base").agg(F.count(F.lit(1)).alias("__n"))
    found = found.withColumn("__start", F.col("__base") + F.coalesce(F.sum(F.col("__size") * F.col("__n")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = found.where("__start < __left and __left <= __start + __size * __n")
    found = found.select("__sk", F.col("__key").alias("__cut_key"), F.col("__id").alias("__cut_id"), F.col("__size").alias("__cut_size"), F.floor((F.col("__left") - F.col("__start")) / F.col("__n")).cast("long").alias("__cut_words"))
    return per.join(found, "__sk", "left").drop("__rows", "__left")


def taken() -> Column:
    """Words that a keyed row joined with its source's cut takes."""
    key, id_, size = F.col("__key"), F.col("__id"), F.col("__size")
    ck, ci, cs = F.col("__cut_key"), F.col("__cut_id"), F.col("__cut_size")
    before = (key < ck) | ((key == ck) & ((id_ < ci) | ((id_ == ci) & (size < cs))))
    at = (key == ck) & (id_ == ci) & (size == cs)
    return F.col("__epochs") * size + F.when(before, size).when(at, F.col("__cut_words")).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    sized = cut(keyed(docs.select("doc_id", "text", "source"), seed).drop("text"), "sized")
    per = cut(cuts(sized, cycle, epochs).drop("source"), "cuts")
    out = sized.join(per, "__sk")
    return out.select("doc_id", "source", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), taken().alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: ``docs`` repeated as often as it is taken, the cut document up to its last taken word.

    A document taken once more in part yields one row whose text ends with that word; n_chars follows the text.
    A document without words adds none to any target and is not in the mix. Other columns, whatever their names, go along.
    """
    names = docs.columns
    sized = cut(keyed(docs.select("doc_id", "text", "source"), seed).drop("text"), "sized")
    per = cut(cuts(sized, cycle, epochs).drop("source"), "cuts")
    rows, of = numbered(docs)
    text = of["text"]
    out = keyed(rows, seed, of["doc_id"], text, of["source"]).join(per, "__sk").withColumn("__taken", taken()).where("__taken > 0")
    whole, rest = F.floor(F.col("__taken") / F.col("__size")).cast("int"), (F.col("__taken") % F.col("__size")).cast("int")
    parts = F.concat(F.when(whole > 0, F.array_repeat(F.lit(0), whole)).otherwise(F.array().cast("array<int>")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("__part", F.explode(parts))
    lead = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.greatest(F.col("__part"), F.lit(1))), "")
    out = out.withColumn(text, F.when(F.col("__part") > 0, lead).otherwise(F.col(text)))
    if "n_chars" in names:
        out = out.withColumn(of["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*of.values()).toDF(*names)
