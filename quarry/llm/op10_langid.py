"""Language identification by Bayesian fusion of evidence.

Per row: log likelihoods of its whole text under byte-trigram models (tempered, as neighbouring
trigrams overlap), plus log likelihoods of the declared markup language and of the address suffix
given each language, plus a host prior. Host priors are smoothed hierarchically (host, then its
registered domain, then all rows) from soft counts that one grouped aggregation over all
rows collects. Rows without letters, or whose text is far less likely under every model than
the training texts were under their own, are rejected.

The trigram models are fitted on a bounded sample: for every label the ``per_language`` rows with the
smallest hash of their id. Everything else covers all rows. ``fit_folds`` fits two models, each on one half of the ids
by hash, and ``identify`` judges every row by the model of the other half, so no row is judged by a model that saw its label.

``languages_of`` judges documents and pages together: a page's text is its markup without tags, its declared language
the html element's lang, its address the url, whose host has its prior from all pages; a document's host is its source.

Defined cases: a null or empty text, or one without letters, has no text evidence, is rejected and gets
language null; null hosts, declarations or suffixes add no evidence; ties go to the language first in
code point order; an empty or unlabelled training table rejects every row; repeated rows are judged each; with keep=True other
columns, whatever their names, go along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, numbered

BITS = 16
TEMPER = 0.5
#: Probability that a declared language or an address suffix names the language of the text.
TRUST_MARKUP, TRUST_SUFFIX = 0.85, 0.6
#: Pseudo-counts that a host takes from its domain, and a domain from all documents.
KAPPA = 8.0
#: Mean log likelihood per trigram below which a text counts as none of the languages: so far under the training texts'
#: lowest, and for a text of n trigrams SLACK / sqrt(n) further, as a key or an address weighs much in a short text.
MARGIN, SLACK = 1.5, 15.0
#: Address suffixes and the language they speak for.
SUFFIXES = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams (letters folded, the rest as spaces) and which of them hold a letter."""
    b = _FOLD[np.frombuffer(data, np.uint8)]
    if len(b) < 3:
        b = np.concatenate([b, np.full(3 - len(b), 32, np.uint32)])
    code = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    live = code != 0x202020
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), live


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (2**BITS, languages) float32 log likelihoods
    floor: float

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log likelihoods (texts, languages) and numbers of trigrams with letters."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                data = f" {text} ".encode()
                for at in range(0, len(data), 1 << 20):  # windows that overlap by two bytes bound the memory a text needs
                    codes, live = trigrams(data[at : at + (1 << 20) + 2])
                    codes = codes[live]
                    n[k] += len(codes)
                    if len(codes) * 4 < 1 << BITS:
                        out[k] += self.table[codes].sum(0, dtype=np.float64)
                    else:
                        out[k] += np.bincount(codes, minlength=1 << BITS) @ self.table
        return out, n


def fold_of(id_col: str):
    """The half, 0 or 1, that a row's id falls into."""
    return F.coalesce(F.xxhash64(F.col(id_col)).bitwiseAND(1), F.lit(0)).cast("int")


def fit(docs: DataFrame, label: str = "lang", per_language: int = 300) -> Model:
    """A model of every label, each from at most per_language labelled rows of ``docs`` (doc_id, text, label)."""
    rows = docs.select(F.col("text").alias("__t"), F.col(label).alias("__l"), F.xxhash64("doc_id").alias("__h")).where("__l is not null and __t is not null")
    sizes = rows.groupBy("__l").count().collect()  # one row for each label
    languages = sorted(r["__l"] for r in sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), 0.0)
    # the hash below which about twice the wanted rows lie; of those the smallest hashes are taken
    edge = F.create_map(*[F.lit(x) for r in sizes for x in (r["__l"], min(1.0, 2.0 * per_language / r["count"]))])[F.col("__l")]
    unit = F.shiftrightunsigned("__h", 11).cast("double") / F.lit(float(2**53))
    near = rows.where(unit <= edge)
    near = near.withColumn("__n", F.row_number().over(Window.partitionBy("__l").orderBy("__h", "__t"))).where(F.col("__n") <= per_language)
    place = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((1 << BITS, len(languages)))
    held = []
    for r in near.select("__l", "__t").toLocalIterator():
        codes, live = trigrams(f" {r['__t']} ".encode())
        codes, n = np.unique(codes[live], return_counts=True)
        if len(codes):
            counts[codes, place[r["__l"]]] += n
            held.append((codes.astype(np.uint16), n, place[r["__l"]]))
    table = np.log((counts + 0.02) / (counts.sum(0) + 0.02 * (1 << BITS))).astype(np.float32)
    means = [float(table[c, k] @ n / n.sum()) for c, n, k in held if n.sum() >= 20]
    return Model(languages, table, (min(means) if means else -12.0) - MARGIN)


def fit_folds(docs: DataFrame, label: str = "lang", per_language: int = 300) -> tuple[Model, Model]:
    """Two models: the first judges rows of fold 0 and is fitted on fold 1, the second the other way round. Both know the same languages."""
    models = [fit(docs.where(fold_of("doc_id") == 1 - k), label, per_language) for k in range(2)]
    names = sorted({x for m in models for x in m.languages})
    return tuple(m if m.languages == names else _widened(m, names, other) for m, other in zip(models, models[::-1]))


def _widened(model: Model, names: list[str], other: Model) -> Model:
    """``model`` with the languages that only the other half's rows are labelled with, as the other half has them."""
    columns = [model.table[:, model.languages.index(x)] if x in model.languages else other.table[:, other.languages.index(x)] for x in names]
    floor = model.floor if model.languages else other.floor
    return Model(names, np.stack(columns, 1), floor)


def _evidence(languages: list[str], named: str | None, trust: float) -> np.ndarray:
    if named not in languages or len(languages) < 2:
        return np.zeros(len(languages))
    out = np.full(len(languages), np.log((1 - trust) / (len(languages) - 1)))
    out[languages.index(named)] = np.log(trust)
    return out


def _named(declared: str | None) -> str | None:
    return re.split(r"[-_]", declared.strip().lower())[0] if declared else None


def _suffix(address: str | None) -> str | None:
    """The language an address speaks for: a two-letter first path part, or its country suffix."""
    m = re.match(r"(?:[a-z]+://)?([^/?#:]*)[^/?#]*(?:/([a-z]{2})(?=/|$))?", (address or "").lower())
    if not m:
        return None
    return m[2] or SUFFIXES.get(m[1].rpartition(".")[2])


def posterior(model: Model, texts, declared=None, address=None, prior=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (texts, languages), trigram numbers, and whether each text is accepted."""
    score, n = model.scores(texts)
    mean = score.max(1) / np.maximum(n, 1) if len(model.languages) else np.full(len(texts), -99.0)
    log = TEMPER * score
    for values, read, trust in ((declared, _named, TRUST_MARKUP), (address, _suffix, TRUST_SUFFIX)):
        if values is not None:
            log = log + np.array([_evidence(model.languages, read(v), trust) for v in values]).reshape(len(texts), -1)
    if prior is not None:
        log = log + np.log(prior)
    if len(model.languages):
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    else:
        p = log
    return p, n, (n > 0) & (mean >= model.floor - SLACK / np.sqrt(np.maximum(n, 1)))


def _domain(host):
    parts = F.split(host, r"\.")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.size(parts) - 1, 2), ".")).otherwise(host)


class _Columns:
    """Judges Arrow batches: which column holds which evidence, and the model for each row's fold."""

    def __init__(self, models: tuple[Model, ...], names: list[str], text: str, fold: str | None, declared: str | None, address: str | None):
        self.models, self.names = models, names
        self.of = {"text": text, "fold": fold, "declared": declared, "address": address}

    def get(self, part: pa.RecordBatch, what: str) -> list | None:
        name = self.of[what]
        return part.column(self.names.index(name)).to_pylist() if name else None

    def judge(self, part: pa.RecordBatch, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        evidence = [self.get(part, x) for x in ("text", "declared", "address")]
        if len(self.models) == 1:
            return posterior(self.models[0], *evidence, prior)
        folds = np.array(self.get(part, "fold"), np.int64)
        p, n, ok = np.zeros((len(folds), len(self.models[0].languages))), np.zeros(len(folds), np.int64), np.zeros(len(folds), bool)
        for k, model in enumerate(self.models):
            rows = np.flatnonzero(folds == k)
            if len(rows):
                p[rows], n[rows], ok[rows] = posterior(model, *([x[i] for i in rows] if x is not None else None for x in evidence), None if prior is None else prior[rows])
        return p, n, ok


def host_priors(frame: DataFrame, judge: _Columns, host: str) -> tuple[DataFrame, list[float]]:
    """The shares of all rows, and host and prior (array<double>): smoothed language shares of every host, from all rows."""
    languages = judge.models[0].languages
    fields = ", ".join(f"p{k} double" for k in range(len(languages)))
    schema = pa.schema([("h", pa.string()), *((f"p{k}", pa.float64()) for k in range(len(languages)))])
    at = judge.names.index(host)

    def run(batches):
        for batch in batches:
            total: dict[str | None, np.ndarray] = {}
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                p, _, ok = judge.judge(part)
                for h, row, good in zip(part.column(at).to_pylist(), p, ok):
                    if good and h is not None:
                        total[h] = total.get(h, 0) + row
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([float(total[h][k]) for h in keys], pa.float64()) for k in range(len(languages)))], schema=schema)

    soft = frame.mapInArrow(run, f"h string, {fields}")
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in range(len(languages))]
    hosts = cut(soft.groupBy("h").agg(*sums).withColumn("d", _domain(F.col("h"))), "hosts")
    domains = hosts.groupBy("d").agg(*[F.sum(f"p{k}").alias(f"d{k}") for k in range(len(languages))])
    whole = hosts.agg(*sums).collect()[0]
    total = np.array([whole[f"p{k}"] or 0.0 for k in range(len(languages))]) + 1.0
    shares = (total / total.sum()).tolist()
    arr = lambda x: F.array(*[F.col(f"{x}{k}") for k in range(len(languages))])
    smooth = lambda counts, parent: F.zip_with(counts, parent, lambda c, q: (c + KAPPA * q) / (F.aggregate(counts, F.lit(0.0), lambda s, v: s + v) + KAPPA))
    joined = hosts.join(domains, "d")
    joined = joined.withColumn("up", smooth(arr("d"), F.array(*[F.lit(x) for x in shares])))
    return cut(joined.select(F.col("h").alias("host"), smooth(arr("p"), F.col("up")).alias("prior")), "priors"), shares


def identify(docs: DataFrame, model: Model | tuple[Model, Model], id_col: str = "doc_id", text: str = "text", host: str | None = "source", declared: str | None = None, address: str | None = None, keep: bool = False) -> DataFrame:
    """Language, its posterior and acceptance of every row; with two models each row is judged by that of its fold.

    keep=False: (id_col, language, confidence, n_trigrams, accepted). keep=True: the accepted rows of
    ``docs`` with the columns of ``docs``.
    """
    models = model if isinstance(model, tuple) else (model,)
    languages = models[0].languages
    rows, of = numbered(docs if keep else docs.select(*dict.fromkeys([id_col, text, *(x for x in (host, declared, address) if x)])))
    columns = rows.columns
    frame = rows.withColumn("fold", fold_of(of[id_col]))
    judge = _Columns(models, frame.columns, of[text], "fold", of[declared] if declared else None, of[address] if address else None)
    shares = None
    if host and languages:
        priors, shares = host_priors(frame, judge, of[host])
        # rows without host need no prior and stay out of the join, which deals by host
        known = frame.where(F.col(of[host]).isNotNull()).join(priors, F.col(of[host]) == F.col("host"), "left").drop("host")
        frame = known.unionByName(frame.where(F.col(of[host]).isNull()).withColumn("prior", F.lit(None).cast("array<double>")))
    else:
        frame = frame.withColumn("prior", F.lit(None).cast("array<double>"))
    names = frame.columns
    judge.names = names
    schema = pa.schema([("id", pa.int64()), ("language", pa.string()), ("confidence", pa.float64()), ("n_trigrams", pa.int64()), ("accepted", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prior = np.array([x or shares for x in part.column(names.index("prior")).to_pylist()]) if shares else None
                p, n, ok = judge.judge(part, prior)
                if keep:
                    kept = part.filter(pa.array(ok))
                    yield pa.RecordBatch.from_arrays([kept.column(names.index(c)) for c in columns], names=columns)
                else:
                    top = p.argmax(1) if languages else np.zeros(len(n), int)
                    said = [languages[k] if good else None for k, good in zip(top, ok)]
                    sure = [float(row[k]) if good else None for row, k, good in zip(p, top, ok)]
                    yield pa.RecordBatch.from_arrays([part.column(names.index(of[id_col])).cast(pa.int64()), pa.array(said, pa.string()), pa.array(sure, pa.float64()), pa.array(n), pa.array(ok)], schema=schema)

    if keep:
        return frame.mapInArrow(run, rows.schema).toDF(*docs.columns)
    return frame.mapInArrow(run, f"{id_col} long, language string, confidence double, n_trigrams long, accepted boolean")


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, address and host of web pages (page_id, url, html), in DataFrame functions."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>|<[^>]*>", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        bare.alias("text"),
        F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1), F.lit("")).alias("declared"),
        F.col("url").alias("address"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host"),
    )


def languages_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_id, language, confidence, n_trigrams, accepted of every document (page_id null) and every page (doc_id -1 - page_id, below any document's)."""
    models = fit_folds(docs)
    said = identify(docs, models).withColumn("page_id", F.lit(None).cast("long"))
    seen = identify(page_evidence(pages), models, id_col="page_id", host="host", declared="declared", address="address").withColumn("doc_id", -1 - F.col("page_id"))
    out = ["doc_id", "page_id", "language", "confidence", "n_trigrams", "accepted"]
    return said.select(*out).unionByName(seen.select(*out))
