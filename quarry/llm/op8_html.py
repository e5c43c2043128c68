"""Main text of web pages, with suffix arrays over the pages of each host.

Pages are parsed into blocks, and what repeats are counted from is stored: hashes of blocks, and the words of those that no sure article mark encloses. The word streams of all blocks that no sure article mark encloses are concatenated,
page after page; a suffix array over them, sorted as deep as LONG words, groups equal substrings of LONG words
and counts the distinct pages of each. The arrays cover batches of pages as they lie in the table; their counts
are summed by host and substring (64-bit hashes), so what repeats does not depend on how pages are dealt.
Pages of a host are distinct if the longest blocks that hold two thirds of their text differ (outside noise elements, and without blocks that more than half of the host's pages have): copies of an article count as one page together, so
no article goes for being stored, or syndicated, many times. A substring on LEAST_PAGES distinct pages of its host and a SHARE of them
is boilerplate, and longer repeats are unions of such windows; the share bounds a host's boilerplate by the length of its pages, not by their number. A block too
short for a window is boilerplate if it is on LEAST_PAGES and half of its host's distinct pages.
Pages of a host are then dealt to tasks by a hash of their address, with the host's boilerplate at hand.

A page without a mark yields, of the blocks outside noise elements, the runs of words that no repeat covers; where repeats cover all of
them, the runs that are not on half of the host's distinct pages. A page that
marks its article (article or main elements) yields the blocks inside the mark, without the noise elements nested
there: text that articles share with other pages is the page's own text, so repetition never removes it. An element that only its name (class
or id) calls noise is noise inside a sure mark if there is a second sign: fields, buttons or further noise elements in it, half of its text in links, another element
of that name, a place behind all other text (comments), or repeats that cover it. A mark that stands in a
noise element is in doubt: the element may be an advert that was never closed before the article, or a sidebar that holds the teasers
of other articles. The arrays decide: where repeats cover all text of a page's doubtful marks, and the page has a sure mark or text of its
own besides, they are no marks of its article.

Defined cases: null html is empty and yields an empty text; a null address is a host of its own; white space
is what str.split() splits at; tags that are never closed end with the element around them; repeated rows each yield their text, and count as
one page; other columns are ignored.
"""

from __future__ import annotations

import collections
import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, cut

#: Pages of a task's group, words of a window, distinct pages and share of a host's that make it boilerplate, and the share that short blocks need.
SHARD, LONG, LEAST_PAGES, SHARE, SHORT_SHARE = 256, 8, 3, 0.01, 0.5
#: The part of a page's text that tells copies of it: so many of so many.
MAIN_PART = 2, 3
#: Elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp select object".split())
NOISE = frozenset("nav header footer aside form button menu dialog label fieldset head".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[a-z]+")
Block = tuple[str, int, bool]
#: What a block's place says of it: outside marks, in a doubtful mark, in a sure mark, in an element of a sure mark that only its name calls noise.
PLAIN, DOUBTFUL, SURE, NAMED = 0, 1, 2, 3


def _noise_sign(tag: str, attributes: str, in_main: bool) -> str:
    """What makes an element noise: "tag" (its kind, role or being hidden), the noise name in its class or id, or nothing."""
    if tag in NOISE and not (tag == "header" and in_main):
        return "tag"
    named = ""
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _NAMED.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in NOISE_ROLES:
                return "tag"
            if name in ("class", "id") and not (in_main and tag == "header"):
                named = named or next((w for w in _PARTS.findall(value) if w in NOISE_NAMES), "")
    return named


class _Named:
    """An element of a sure mark that only its name calls noise, and the signs beside the name."""

    def __init__(self, tag: str, name: str) -> None:
        self.tag, self.name, self.sign, self.text, self.linked = tag, name, False, 0, 0


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order: (text, PLAIN, DOUBTFUL, SURE or NAMED, inside noise)."""
    out: list[tuple[str, int, bool, _Named | None]] = []
    if not page:
        return []
    words: list[str] = []
    stack: list[tuple[str, int, bool, _Named | None]] = []  # of open block elements: tag, in a mark, in noise, in a named element
    main, noise, named, linked = PLAIN, False, None, False

    def close() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                out.append((text, main, noise, named))
            words.clear()

    def add(text: str) -> None:
        words.append(text)
        if named:
            named.text += len(text.strip())
            named.linked += len(text.strip()) if linked else 0

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "a":
            linked = not closing
        if closing:
            if tag in BLOCKS:
                close()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        main, noise, named = stack[-1][1:] if stack else (PLAIN, False, None)
                        break
            continue
        if named and tag in ("input", "textarea", "select"):
            named.sign = True
        if tag in RAW:
            if tag in BLOCKS:
                close()
            if not attributes.endswith("/") or tag in ("script", "style", "textarea", "title"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            words.append(" ")
        if tag not in BLOCKS:
            sign = _noise_sign(tag, attributes, bool(main)) if tag not in VOID and _SPAN_NOISE.search(attributes) else ""
            if sign == "tag" or sign and main != SURE:
                end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
                at = end.end() if end else at
            continue
        close()
        if tag in VOID:
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            main, noise, named = stack[-1][1:] if stack else (PLAIN, False, None)
        marks = tag in ("article", "main")
        sign = _noise_sign(tag, attributes, bool(main) or marks)
        if sign and named:
            named.sign = True
        if sign and sign != "tag" and main == SURE and not noise:
            named = named or _Named(tag, sign)
        elif marks and not sign:
            # an article inside an unclosed menu or advert is still the article, so the mark is in doubt there
            main, noise = main or (DOUBTFUL if noise else SURE), noise and bool(main)
        else:
            noise = noise or bool(sign)
        stack.append((tag, main, noise, named))
    add(page[at:])
    close()
    return _decided(out)


def _decided(found: list[tuple[str, int, bool, _Named | None]]) -> list[Block]:
    """Blocks of named elements with a second sign are noise; the others' are NAMED, which repeats may still remove."""
    elements = list({id(b[3]): b[3] for b in found if b[3]}.values())
    times = collections.Counter((e.tag, e.name) for e in elements)
    last = max((k for k, (_, main, noise, named) in enumerate(found) if main == SURE and not noise and not named), default=-1)
    for k, (_, _, _, e) in enumerate(found):
        if e:
            e.sign |= 2 * e.linked >= e.text or times[e.tag, e.name] > 1 or e.name == "comments" and k > last
    return [(text, NAMED if e and not e.sign and not noise else main, noise or bool(e and e.sign)) for text, main, noise, e in found]


_SPAN_NOISE = re.compile(r"class|id|role|hidden", re.I)


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` tokens (a power of two), and each suffix's rank at that depth.

    Prefix doubling: ranks of 2k tokens are ranks of pairs (rank of k tokens here, rank of k tokens further on).
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth:
        ahead = np.zeros_like(rank)
        ahead[:-k] = rank[k:]
        rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return np.argsort(rank, kind="stable"), rank


def _joined(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Streams as one array of word numbers with a separator after each: tokens, owners, starts, lengths, words."""
    lengths = np.array([len(s) for s in streams], np.int64)
    numbers: dict[str, int] = {}
    tokens = np.empty(int(lengths.sum()) + len(streams), np.int64)
    owner = np.empty(len(tokens), np.int64)
    at, starts = 0, []
    for k, stream in enumerate(streams):
        starts.append(at)
        for word in stream:
            tokens[at] = numbers.setdefault(word, len(numbers))
            at += 1
        tokens[at] = -1 - k  # no substring crosses from page to page
        owner[starts[-1] : at + 1] = k
        at += 1
    return tokens, owner, np.array(starts, np.int64), lengths, list(numbers)


def _groups(tokens: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, where groups equal in LONG tokens begin there, and each group's weight of streams."""
    order, rank = suffix_order(tokens, LONG)
    sorted_rank, sorted_owner = rank[order], owner[order]
    edges = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]])
    new_owner = np.r_[True, (sorted_rank[1:] != sorted_rank[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])]
    return order, edges, np.add.reduceat(new_owner * weight[sorted_owner], edges)


def _covers(hits: np.ndarray, total: int, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    delta = np.zeros(total + LONG + 1, np.int64)
    np.add.at(delta, hits, 1)
    np.add.at(delta, hits + LONG, -1)
    covered = np.cumsum(delta)[:total] > 0
    return [covered[s : s + n] for s, n in zip(starts, lengths)]


def _hashes(tokens: np.ndarray, words: list[str]) -> np.ndarray:
    """A hash of the LONG tokens from each place on, the same in every process; of use where they are all words."""
    of = np.array([*(int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in words), 0], np.uint64)
    ahead = np.r_[of[np.maximum(tokens, -1)], np.zeros(LONG - 1, np.uint64)]
    out = np.zeros(len(tokens), np.uint64)
    for k in range(LONG):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ahead[k : k + len(tokens)]
    return out.view(np.int64)


def windows(streams: list[list[str]], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct substrings of LONG words, and the number (or ``weight``) of the streams that hold each."""
    if sum(map(len, streams)) < LONG:
        return np.zeros(0, np.int64), np.zeros(0)
    tokens, owner, starts, lengths, words = _joined(streams)
    order, edges, pages = _groups(tokens, owner, np.ones(len(streams)) if weight is None else weight)
    first = order[edges]
    whole = first + LONG <= (starts + lengths)[owner[first]]
    return _hashes(tokens, words)[first[whole]], pages[whole]


def _short_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=b"block").digest(), "little", signed=True)


def short_blocks(parsed: list[list[Block]], weight: np.ndarray) -> dict[int, float]:
    """Hashes of the judged blocks that are shorter than a window, and the weight of their pages."""
    out: dict[int, float] = collections.defaultdict(float)
    for bs, w in zip(parsed, weight.tolist()):
        for h in {_short_hash(b[0]) for b in bs if _judged(b) and b[0].count(" ") + 1 < LONG}:
            out[h] += w
    return out


def own_blocks(parsed: list[Block]) -> list[tuple[int, int]]:
    """Length and hash of each distinct block outside noise elements, in marks or not; longest first."""
    return sorted({(len(b[0]), _short_hash(b[0])) for b in parsed if not b[2]}, key=lambda x: (-x[0], x[1]))


def page_hash(parsed: list[Block]) -> int:
    return _short_hash("\n".join(b[0] for b in parsed))


def signature(parsed: list[Block], site: set[int]) -> tuple[int, ...]:
    """What copies of a page have in common: its longest blocks outside noise elements, as many as hold MAIN_PART of their text.

    Blocks of the ``site``, on more than half of the host's pages, are left out; without others, it is all of the page's text.
    """
    own = [x for x in own_blocks(parsed) if x[1] not in site]
    total, held, out = sum(n for n, _ in own), 0, []
    for n, h in own:
        if held * MAIN_PART[1] < total * MAIN_PART[0]:
            out.append(h)
            held += n
    return tuple(out) or (page_hash(parsed),)


def covered_by(streams: list[list[str]], frequent: np.ndarray) -> list[np.ndarray]:
    """For each stream of words, which words lie in a substring of LONG words whose hash is in ``frequent``."""
    tokens, owner, starts, lengths, words = _joined(streams)
    at = np.arange(len(tokens))
    hits = at[(at + LONG <= (starts + lengths)[owner]) & np.isin(_hashes(tokens, words), frequent)]
    return _covers(hits, len(tokens), starts, lengths)


def inner_runs(cover: np.ndarray) -> np.ndarray:
    """``cover`` of one block without runs that only reach into it from its neighbours (shorter than LONG)."""
    if cover.all():
        return cover
    out, at = cover.copy(), 0
    for run in np.split(cover, np.flatnonzero(cover[1:] != cover[:-1]) + 1):
        if len(run) < LONG:
            out[at : at + len(run)] = False
        at += len(run)
    return out


def _judged(block: Block) -> bool:
    """Whether repeats have a say on a block: all outside article marks, the text of marks in doubt, and what only a name calls noise."""
    _, main, noise = block
    return main == PLAIN or main != SURE and not noise


def _stream(parsed: list[Block]) -> list[str]:
    """Words of a page's judged blocks."""
    return [w for b in parsed if _judged(b) for w in b[0].split(" ")]


Frequent = tuple[np.ndarray, np.ndarray]  # hashes of a host's frequent windows and short blocks, and which are on half of its pages


def frequent_of(parsed: list[list[Block]]) -> Frequent:
    """The frequent windows and short blocks of a host, from all its pages."""
    on = collections.Counter(h for bs in parsed for _, h in own_blocks(bs))
    site = {h for h, n in on.items() if 2 * n > len(parsed)}
    signs = [signature(bs, site) for bs in parsed]
    times = collections.Counter(signs)
    weight = np.array([1 / times[x] for x in signs])
    (found, n), short = windows([_stream(bs) for bs in parsed], weight), short_blocks(parsed, weight)
    hashes = np.r_[found, np.array([*short], np.int64)]
    pages, is_short = np.r_[n, np.array([*short.values()])], np.arange(len(hashes)) >= len(found)
    kept = pages >= np.maximum(LEAST_PAGES, np.where(is_short, SHORT_SHARE, SHARE) * len(times)) - SLACK
    return hashes[kept], (pages >= SHORT_SHARE * len(times) - SLACK)[kept]


#: Weights of copies are fractions, whose sums may miss a whole number by less than this.
SLACK = 1e-6


def extract_shard(pages: list[str | None], frequent: Frequent | None = None) -> list[str]:
    """Main texts of pages of one host, given what is ``frequent`` on it (without it, the pages are all of the host)."""
    parsed = [blocks(p) for p in pages]
    streams = [_stream(bs) for bs in parsed]
    hashes, wide = frequent or frequent_of(parsed)
    common = set(hashes.tolist())
    out = []
    for bs, cover, broad in zip(parsed, covered_by(streams, hashes), covered_by(streams, hashes[wide])):
        marked, plain, spared, at, believed = [], [], [], 0, False
        for block in bs:
            text, main, noise = block
            if not _judged(block):
                if not noise:
                    marked.append((text, main))
                continue
            words = text.split(" ")
            here = slice(at, at + len(words))
            at += len(words)
            live, known = ~inner_runs(cover[here]), len(words) < LONG and _short_hash(text) in common
            own = live.any() and not known
            if main == NAMED:
                if own:
                    marked.append((text, SURE))
            elif main:
                marked.append((text, main))
                believed = believed or own
            elif not noise:
                if own:
                    plain.append(" ".join(w for w, x in zip(words, live) if x))
                rare = ~inner_runs(broad[here])
                if rare.any() and not known:
                    spared.append(" ".join(w for w, x in zip(words, rare) if x))
        if not believed and (plain or any(main == SURE for _, main in marked)):
            marked = [m for m in marked if m[1] == SURE]
        out.append("\n\n".join([text for text, _ in marked] or plain or spared))
    return out


def host(url):
    """Host of an address in lower case, without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


PARSED = pa.schema(
    [("__host", pa.string()), ("own", pa.list_(pa.struct([("n", pa.int32()), ("hash", pa.int64())]))), ("whole", pa.int64()), ("words", pa.string()), ("short", pa.list_(pa.int64()))]
)


def parsed_pages(rows: DataFrame) -> DataFrame:
    """What repeats are counted from, of every page: __host, ``own`` (length and hash of each block outside noise elements, longest first), a
    hash of the ``whole``, the ``words`` of its judged blocks and the hashes of those that are shorter than a window."""

    def parse(batch: pa.RecordBatch) -> list:
        found = [blocks(p) for p in batch.column("html").to_pylist()]
        own = [[{"n": n, "hash": h} for n, h in own_blocks(bs)] for bs in found]
        return [batch.column("__host"), own, [page_hash(bs) for bs in found], [" ".join(_stream(bs)) for bs in found], [[*short_blocks([bs], np.ones(1))] for bs in found]]

    return rows.select("__host", "html").mapInArrow(arrow_rows(PARSED, parse, 256), "__host string, own array<struct<n: int, hash: long>>, whole long, words string, short array<long>")


def signed(parsed: DataFrame) -> DataFrame:
    """``parsed`` pages with ``__sign``, a hash of the signature of each."""
    size = parsed.groupBy("__host").agg(F.count(F.lit(1)).alias("__all"))
    on = parsed.select("__host", F.explode("own.hash").alias("block")).groupBy("__host", "block").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    # on more than half of a host's pages are at most twice as many blocks as a page has on the average
    site = on.join(size, "__host").where(2 * F.col("pages") > F.col("__all")).groupBy("__host").agg(F.collect_list("block").alias("__site"))
    rows = parsed.join(cut(site, "site"), "__host", "left")
    rows = rows.withColumn("__own", F.when(F.col("__site").isNull(), F.col("own")).otherwise(F.filter("own", lambda x: ~F.array_contains("__site", x["hash"]))))
    total = F.aggregate("__own", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    none = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("sign"))
    more = lambda s, x: F.struct((s["held"] + x["n"]).alias("held"), F.xxhash64(s["sign"], x["hash"]).alias("sign"))
    rows = rows.withColumn("__total", total)
    sign = F.aggregate("__own", none, lambda s, x: F.when(s["held"] * MAIN_PART[1] < F.col("__total") * MAIN_PART[0], more(s, x)).otherwise(s))["sign"]
    return rows.withColumn("__sign", F.when(F.size("__own") > 0, sign).otherwise(F.col("whole"))).select("__host", "__sign", "words", "short")


def repeats(rows: DataFrame) -> DataFrame:
    """__host, window, short, pages: the substrings and short blocks of each host outside sure marks, and on how many of its distinct pages they are.

    ``rows`` hold __host, words, short and __copies, the number of pages with their signature. Suffix arrays over slices of the table as it lies; no page is moved.
    """
    schema = pa.schema([("__host", pa.string()), ("window", pa.int64()), ("short", pa.bool_()), ("pages", pa.float64())])

    def count(batch: pa.RecordBatch) -> list:
        hosts: dict[str, list] = {}
        for name, *row in zip(*(batch.column(n).to_pylist() for n in ("__host", "words", "short", "__copies"))):
            hosts.setdefault(name, []).append(row)
        names, hashes, short, pages = [], [], [], []
        for name, held in hosts.items():
            found, n = windows([words.split(" ") if words else [] for words, _, _ in held], np.array([1 / copies for _, _, copies in held]))
            few: dict[int, float] = collections.defaultdict(float)
            for _, brief, copies in held:
                for h in brief:
                    few[h] += 1 / copies
            names += [name] * (len(found) + len(few))
            hashes += [*found.tolist(), *few]
            short += [False] * len(found) + [True] * len(few)
            pages += [*n.tolist(), *few.values()]
        return [names, hashes, short, pages]

    counts = rows.select("__host", "words", "short", "__copies").mapInArrow(arrow_rows(schema, count), "__host string, window long, short boolean, pages double")
    return counts.groupBy("__host", "window", "short").agg(F.sum("pages").alias("pages"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("__host", host(F.col("url")))
    parsed = signed(cut(parsed_pages(rows), "parsed"))
    signs = cut(parsed.groupBy("__host", "__sign").agg(F.count(F.lit(1)).alias("__copies")), "signs")
    shards = F.ceil(F.sum("__copies") / F.lit(float(SHARD))).cast("int")
    hosts = cut(signs.groupBy("__host").agg(F.count(F.lit(1)).cast("double").alias("__pages"), shards.alias("__shards")), "hosts")
    copied = parsed.join(signs.where(F.col("__copies") > 1), ["__host", "__sign"], "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    needed = F.greatest(F.lit(float(LEAST_PAGES)), F.when(F.col("short"), SHORT_SHARE).otherwise(SHARE) * F.col("__pages")) - SLACK
    often = repeats(copied).where(F.col("pages") >= LEAST_PAGES - SLACK).join(hosts, "__host").where(F.col("pages") >= needed)
    often = often.withColumn("wide", F.col("pages") >= SHORT_SHARE * F.col("__pages") - SLACK)
    # a host has at most 1 / SHARE times as many windows here as a page of its holds words on the average, whatever its number of pages
    frequent = often.select("__host", F.explode(F.sequence(F.lit(0), F.col("__shards") - 1)).alias("__shard"), "window", "wide")
    rows = rows.join(hosts.drop("__pages"), "__host").withColumn("__shard", F.pmod(F.xxhash64("url", "page_id"), F.col("__shards")).cast("int")).drop("__shards")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(group: pa.Table, often: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        hashes = often.column("window").to_numpy(), often.column("wide").to_numpy().astype(bool)
        texts = extract_shard(group.column("html").to_pylist(), hashes)
        return pa.Table.from_arrays([group.column("page_id"), group.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    by = ("__host", "__shard")
    return rows.groupBy(*by).cogroup(frequent.groupBy(*by)).applyInArrow(run, "page_id long, url string, text string, n_chars long")
