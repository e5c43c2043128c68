"""The index: documents, postings and statistics as DataFrames, in memory or as versioned parquet tables."""

from __future__ import annotations

import functools
import json
import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.postings import POSTINGS, STORED, postings_of, unpacked
from quarry.plans import query as Q
from quarry.plans.compiler import execute
from quarry.plans.schema import Field, Schema, ensure_schema, to_boolean


#: Bytes of a table's files, and postings, that one task takes: parts grow in number with the data, not in size.
BYTES, POSTED = 16 << 20, 500_000


def spread(scan: DataFrame, size: int = BYTES) -> DataFrame:
    """A table read from few files or row groups, dealt evenly in parts of ``size`` bytes of its files, over all cores at least.

    For scans only (their number of partitions is known without running anything); a table of more partitions than that stays as it lies.
    """
    jvm, hadoop = scan.sparkSession._jvm, scan.sparkSession._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in scan.inputFiles()]
    parts = max(scan.sparkSession.sparkContext.defaultParallelism, -(-sum(f.getFileSystem(hadoop).getFileStatus(f).getLen() for f in files) // size))
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < parts else scan


def term_stats_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("weight").alias("cf"), F.max("weight").alias("max_weight"), F.min("dl").alias("min_length"), F.max("dl").alias("max_length")
    )


def field_stats_of(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Length of each field over all documents, extremes, documents that have it, and n, all documents."""
    return _with_count(postings.groupBy("field").agg(F.sum("tf").alias("total"), F.min("dl").alias("min_length"), F.max("dl").alias("max_length")), docs)


def _packed_stats(packed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same statistics of terms and fields from the counts of packed postings."""
    lengths = [F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length")]
    terms = packed.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_weight").alias("max_weight"), *lengths)
    return terms, _with_count(packed.groupBy("field").agg(F.sum("total").alias("total"), *lengths), docs)


def _with_count(totals: DataFrame, docs: DataFrame) -> DataFrame:
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    # one row with one number on the right side
    return totals.join(F.broadcast(n), F.lit(True))


def with_parents(docs: DataFrame, is_parent: Column, block: str | None = None) -> DataFrame:
    """Adds parent_id: the nearest parent at or before each document in doc_id order (within ``block``, the group key).

    Without a block, documents are range-sorted: each range finds its parents, and takes the last parent of the ranges before it
    (from a table of one row for each range) for documents ahead of its own first.
    """
    parent = F.when(is_parent, F.col("doc_id"))
    if block:
        w = Window.partitionBy(block).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
        return docs.withColumn("parent_id", F.last(parent, ignorenulls=True).over(w))
    ranged = _laid(docs.withColumn("__parent", parent).repartitionByRange("doc_id").withColumn("__p", F.spark_partition_id()), "parents")
    carried = ranged.groupBy("__p").agg(F.max("__parent").alias("__last")).withColumn("__before", F.max("__last").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("__p").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("__own", F.last("__parent", ignorenulls=True).over(w)).join(F.broadcast(carried.select("__p", "__before")), "__p")
    return found.withColumn("parent_id", F.coalesce("__own", "__before")).select(*docs.columns, "parent_id")


class SearchIndex:
    """Tables docs (doc_id and stored columns), postings, term_stats and field_stats under one schema."""

    def __init__(self, schema: Schema, docs: DataFrame, postings: DataFrame, term_stats: DataFrame | None = None, field_stats: DataFrame | None = None, path: str | None = None, version: int = 0):
        self.schema, self.docs, self.postings = schema, docs, postings
        self.term_stats = term_stats if term_stats is not None else term_stats_of(postings)
        self.field_stats = field_stats if field_stats is not None else field_stats_of(postings, docs)
        self.specs = schema.resolve(docs.columns)
        self.path, self.version = path, version

    # Building and storing

    @classmethod
    def build(cls, docs: DataFrame, schema, id_column: str | None = None, boost: Column | None = None) -> SearchIndex:
        """An index over ``docs``; doc_id is ``id_column`` if given (a unique long), else must be there or is numbered by row order."""
        schema = ensure_schema(schema)
        if id_column and id_column != "doc_id":
            docs = docs.withColumn("doc_id", F.col(id_column).cast("long"))
        if "doc_id" not in docs.columns:
            docs = numbered(docs)
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
        return cls(schema, docs, postings_of(docs, schema.resolve(docs.columns), boost))

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> SearchIndex:
        """The index held by the executors; statistics are derived from the held postings."""
        docs, postings = self.docs.persist(level), self.postings.persist(level)
        return SearchIndex(self.schema, docs, postings, term_stats_of(postings).persist(level), field_stats_of(postings, docs).persist(level))

    def laid(self, path: str | None = None, docs: bool = True, packed: DataFrame | None = None) -> SearchIndex:
        """The index with its tables stored as they come under ``path`` (by default in the shared folder): a query reads the columns it needs,
        and memory holds the statistics alone. ``docs`` False: documents are read from where they are. ``packed``: the same postings as
        ``packed_of`` gives them, which are stored instead.
        """
        spark, path = self.docs.sparkSession, path or shared_path(self.docs.sparkSession, "laid")
        if docs:
            self.docs.write.parquet(f"{path}/docs")
        held = spark.read.schema(self.docs.schema).parquet(f"{path}/docs") if docs else self.docs
        if packed is not None:
            packed.write.options(**STORED).parquet(f"{path}/postings")
            rows = spark.read.schema(packed.schema).parquet(f"{path}/postings")
            terms, fields = _packed_stats(rows, held)
            # a term's counts are found faster in the stored ones than all terms' are held
            return SearchIndex(self.schema, held, unpacked(rows), terms, fields.persist(StorageLevel.MEMORY_AND_DISK))
        self.postings.write.parquet(f"{path}/postings")
        postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        return SearchIndex(self.schema, held, postings, term_stats_of(postings).persist(StorageLevel.MEMORY_AND_DISK), field_stats_of(postings, held).persist(StorageLevel.MEMORY_AND_DISK))

    def unpersist(self) -> None:
        for t in (self.docs, self.postings, self.term_stats, self.field_stats):
            t.unpersist()

    def save(self, path: str, partitions: int | None = None) -> SearchIndex:
        """Writes a new version under ``path``; the manifest comes last, so readers see whole versions only.

        Postings are clustered by (field, term), so a term's conditions prune row groups.
        """
        spark, version = self.docs.sparkSession, _latest(self.docs.sparkSession, path) + 1
        base = f"{path}/v{version}-{uuid.uuid4().hex[:8]}"
        self.docs.write.parquet(f"{base}/docs")
        clustered = self.postings.repartitionByRange(*([partitions] if partitions else []), "field", "term").sortWithinPartitions("field", "term", "doc_id")
        clustered.write.partitionBy("field").parquet(f"{base}/postings")
        postings = spark.read.schema(POSTINGS).parquet(f"{base}/postings")
        term_stats_of(postings).repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{base}/term_stats")
        field_stats_of(postings, self.docs).coalesce(1).write.parquet(f"{base}/field_stats")
        manifest = json.dumps({"version": version, "base": base, "schema": json.loads(self.schema.describe())})
        spark.createDataFrame([(version, manifest)], "version int, manifest string").coalesce(1).write.json(f"{path}/manifest/v{version}")
        return SearchIndex.open(spark, path, self.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema, version: int | None = None) -> SearchIndex:
        version = version or _latest(spark, path)
        if not version:
            raise FileNotFoundError(f"no index at {path}")
        row = spark.read.schema("version int, manifest string").json(f"{path}/manifest/v{version}").first()
        base = json.loads(row["manifest"])["base"]
        read = lambda name: spark.read.parquet(f"{base}/{name}")
        return cls(ensure_schema(schema), read("docs"), spark.read.schema(POSTINGS).parquet(f"{base}/postings"), read("term_stats"), read("field_stats"), path, version)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return _latest(spark, path) > 0

    # Changing

    def _rebuilt(self, docs: DataFrame, postings: DataFrame) -> SearchIndex:
        return SearchIndex(self.schema, docs, postings, path=self.path, version=self.version)

    def add(self, docs: DataFrame) -> SearchIndex:
        """With more documents, whose doc_ids must be new; only the new ones are analysed."""
        added = SearchIndex.build(docs, self.schema)
        return self._rebuilt(self.docs.unionByName(added.docs, allowMissingColumns=True), self.postings.unionByName(added.postings))

    def delete(self, ids: DataFrame) -> SearchIndex:
        """Without the documents in ``ids`` (doc_id)."""
        gone = ids.select("doc_id").distinct()
        return self._rebuilt(self.docs.join(gone, "doc_id", "left_anti"), self.postings.join(gone, "doc_id", "left_anti"))

    def delete_by_query(self, q: Q.Query) -> SearchIndex:
        return self.delete(execute(q, self))

    def update(self, docs: DataFrame, arrival: str | None = None) -> SearchIndex:
        """Adds ``docs`` and drops those with an equal value in a unique field; of several new ones the last by ``arrival`` stays."""
        keys = self.schema.unique_fields()
        if not keys:
            return self.add(docs)
        docs = keep_last(docs, keys, arrival)
        gone = [self.docs.join(docs.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_semi").select("doc_id") for k in keys]
        return self.delete(functools.reduce(DataFrame.unionAll, gone)).add(docs)

    def add_field(self, name: str, spec: Field, values: DataFrame | None = None, source: str | None = None) -> SearchIndex:
        """With another field, from a column of the documents (or of ``values``: doc_id and it)."""
        docs = self.docs if values is None else self.docs.join(values, "doc_id", "left")
        schema = self.schema.add(name, spec, source)
        only = {k: v for k, v in schema.resolve(docs.columns).items() if k not in self.specs}
        return SearchIndex(schema, docs, self.postings.unionByName(postings_of(docs, only)))

    def remove_field(self, name: str) -> SearchIndex:
        return SearchIndex(self.schema.remove(name), self.docs, self.postings.where(F.col("field") != name))

    def add_sortable(self, name: str, value: Column) -> SearchIndex:
        """With a column for sorting and grouping."""
        return self._rebuilt(self.docs.withColumn(name, value), self.postings)

    def overlay(self, upper: SearchIndex) -> SearchIndex:
        """This index below another: documents of ``upper`` win where ids are equal."""
        below = self.delete(upper.docs)
        return self._rebuilt(upper.docs.unionByName(below.docs, allowMissingColumns=True), upper.postings.unionByName(below.postings))

    # Statistics

    def doc_count(self) -> DataFrame:
        return self.docs.agg(F.count(F.lit(1)).alias("n"))

    def lexicon(self, name: str, prefix: str = "") -> DataFrame:
        found = self.term_stats.where(F.col("field") == name)
        return (found.where(F.col("term").startswith(prefix)) if prefix else found).select("term")

    def frequency(self, name: str, text: str) -> DataFrame:
        return self.term_stats.where((F.col("field") == name) & (F.col("term") == text)).select(F.col("cf").alias("frequency"), F.col("df").alias("doc_frequency"))

    def field_length(self, name: str) -> DataFrame:
        return self.field_stats.where(F.col("field") == name).select("total", "min_length", "max_length", (F.col("total") / F.col("n")).alias("average"))

    def doc_lengths(self, name: str) -> DataFrame:
        return self.postings.where(F.col("field") == name).groupBy("doc_id").agg(F.first("dl").alias("length"))

    def most_frequent_terms(self, name: str, number: int = 5, prefix: str = "") -> DataFrame:
        found = self.term_stats.where((F.col("field") == name) & F.col("term").startswith(prefix))
        return found.orderBy(F.desc("cf"), F.desc("term")).limit(number).select("term", "cf")

    def most_distinctive_terms(self, name: str, number: int = 5, prefix: str = "") -> DataFrame:
        found = self.term_stats.where((F.col("field") == name) & F.col("term").startswith(prefix)).join(F.broadcast(self.field_stats.select("field", "n")), "field")
        return found.select("term", (F.col("cf") * F.log(F.col("n") / F.col("df"))).alias("score")).orderBy(F.desc("score"), F.desc("term")).limit(number)

    def terms_within(self, name: str, text: str, maxdist: int, prefix: int = 0) -> DataFrame:
        from quarry.plans.compiler import term_condition

        return self.term_stats.where(term_condition(Q.Fuzzy(name, text, maxdist=maxdist, prefix=prefix), self)).select("term", "df", "cf")

    def term_vector(self, doc_id: int, name: str) -> DataFrame:
        return self.postings.where((F.col("doc_id") == doc_id) & (F.col("field") == name)).select("term", "tf", "weight", "positions", "starts", "ends", "boosts")

    def stored(self, doc_id: int) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)

    def typed(self, q: Q.Query) -> Q.Query:
        """A leaf on a column field with its value in the column's type; values that don't fit match nothing."""
        spec = self.specs.get(getattr(q, "field", None) or "", (None, None))[0]
        if isinstance(q, Q.Every) or isinstance(q, Q.ColumnQuery):
            return q
        if q.field not in self.docs.columns:
            return Q.Null(f"no field {q.field!r}")
        if isinstance(q, (Q.Term, Q.TermRange, Q.NumericRange)):
            kind = spec.kind if spec else ""
            values = [q.text] if isinstance(q, Q.Term) else [q.start, q.end]
            read = []
            for v in values:
                if v is None or not isinstance(v, str):
                    read.append(v)
                elif kind == "numeric":
                    try:
                        read.append(float(v) if re.search(r"[.eE]", v) else int(v))
                    except ValueError:
                        return Q.Null(f"{v!r} is not a number")
                elif kind == "boolean":
                    word = {"t": True, "true": True, "yes": True, "1": True, "f": False, "false": False, "no": False, "0": False}.get(v.lower())
                    if word is None:
                        return Q.Null(f"{v!r} is neither true nor false")
                    read.append(word)
                elif kind == "datetime":
                    from quarry.plans.dates import parse_date

                    span = parse_date(v)
                    if span is None:
                        return Q.Null(f"{v!r} is not a date")
                    if isinstance(q, Q.Term):
                        return Q.DateRange(q.field, span[0], span[1], boost=q.boost)
                    read.append(span[len(read)])
                else:
                    read.append(v)
            if isinstance(q, Q.Term):
                return Q.Term(q.field, read[0], q.boost)
            return Q.NumericRange(q.field, read[0], read[1], q.start_excl, q.end_excl, q.boost)
        if isinstance(q, (Q.Prefix, Q.Wildcard, Q.Regex)):
            test = {Q.Prefix: lambda c: c.startswith(q.text), Q.Wildcard: lambda c: c.rlike(f"^(?:{Q.Wildcard.pattern(q)})$"), Q.Regex: lambda c: c.rlike(f"^(?:{q.text})")}[type(q)]
            return Q.ColumnQuery(q.field, lambda c: test(c.cast("string")), q.boost)
        return Q.Null(f"{type(q).__name__} needs an indexed field")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path that all executors share, in ``spark.checkpoint.dir`` or else beside the warehouse; deleted when the application ends."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.quarry"
    path = f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}/{tag}"
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def _laid(ranged: DataFrame, tag: str) -> DataFrame:
    """``ranged`` written once: what is computed twice may be cut into other ranges (they come from a sample, and are merged by size), and then numbers of partitions differ."""
    path = shared_path(ranged.sparkSession, tag)
    ranged.write.parquet(path)
    return ranged.sparkSession.read.schema(ranged.schema).parquet(path)


def numbered(docs: DataFrame, *order: str) -> DataFrame:
    """doc_id 0, 1, ... by the order given; without one, ids that are unique and grow along the input, but not dense.

    Dense numbers come from a range sort and one count per partition, not from a single task.
    """
    if not order:
        return docs.withColumn("doc_id", F.monotonically_increasing_id())
    return ranked(docs, "__rank", *order).withColumn("doc_id", F.col("__rank") - 1).drop("__rank")


def ranked(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with their place (from 1) in an order, as column ``name``: a range sort and one count per partition, not a single task."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    ranged = _laid(ranged.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    bases = counts.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))  # one row per partition
    return ranged.join(F.broadcast(bases), "__p").withColumn(name, F.col("__b") + F.col("__i") + 1).drop("__m", "__p", "__i", "__b")


def keep_last(docs: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """One row per key, the last by ``arrival`` (by doc_id without one); rows without key all stay, and are not ranked."""
    order = F.desc_nulls_last(arrival or "doc_id")
    missing = functools.reduce(lambda a, b: a & b, [F.col(k).isNull() for k in keys])
    rows = docs.where(~missing).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return rows.where(F.col("__r") == 1).drop("__r").unionByName(docs.where(missing))


def merge_small(spark: SparkSession, path: str, files: int, least: int = 2) -> int:
    """Merges the small batches of one table of a streamed index: those of at most ``files`` files each become one batch, if there are ``least``.

    Returns how many batches were merged. The merged rows are complete before a batch goes, and a merge that was cut short is finished
    by the next call; between the two a reader may miss batches, so merge while nobody reads.
    """
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def finish() -> None:
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("_replaces-") and fs.exists(hadoop(status.getPath(), "_SUCCESS")):
                numbers = sorted(r["batch"] for r in spark.read.schema("batch long").json(f"{path}/{name}").collect())
                made = hadoop(f"{path}/_merging-{name.removeprefix('_replaces-')}")
                if fs.exists(made):
                    for k in numbers:
                        fs.delete(hadoop(f"{path}/batch={k}"), True)
                    fs.rename(made, hadoop(f"{path}/batch={numbers[-1]}"))
                fs.delete(status.getPath(), True)

    finish()
    small = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if re.fullmatch(r"batch=\d+", name) and sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(status.getPath())) <= files:
            small.append(int(name.split("=")[1]))
    if len(small) < least:
        return 0
    mark = uuid.uuid4().hex[:8]
    spark.read.parquet(*[f"{path}/batch={k}" for k in small]).coalesce(max(1, files)).write.parquet(f"{path}/_merging-{mark}")
    spark.createDataFrame([(k,) for k in small], "batch long").coalesce(1).write.json(f"{path}/_replaces-{mark}")
    finish()
    return len(small)


def clear(index: SearchIndex) -> SearchIndex:
    """The index without documents: what a writer that clears before it adds starts from."""
    return SearchIndex(index.schema, index.docs.limit(0), index.postings.limit(0), path=index.path, version=index.version)


def compact(index: SearchIndex, path: str, partitions: int | None = None) -> SearchIndex:
    """The whole index rewritten into few files: merging and optimizing."""
    return index.save(path, partitions)


def copy_index(index: SearchIndex, path: str) -> SearchIndex:
    return index.save(path)


def _latest(spark: SparkSession, path: str) -> int:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0
    found = [0]
    for status in fs.listStatus(folder):
        m = re.fullmatch(r"v(\d+)", status.getPath().getName())
        if m and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(m[1]))
    return max(found)


__all__ = ["SearchIndex", "postings_of", "spread", "term_stats_of", "field_stats_of", "with_parents", "numbered", "ranked", "keep_last", "shared_path", "merge_small", "clear", "compact", "copy_index", "to_boolean"]
