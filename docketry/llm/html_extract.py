"""HTML extraction: the article's blocks, with suffix arrays and counts over each whole host against boilerplate.

Markup comes first: inside ``article`` (else ``main``) every block may be main text; menus, headers, footers, sidebars,
forms, scripts, styles, and elements whose class, id or role names an advert, notice, comment or the like are not. Pages
without such an element offer all their other blocks. Then every page goes through its host: runs of at least MIN_RUN tokens
that stand on MIN_PAGES distinct pages of the host are found, and blocks mostly covered by them go; others stay whole. Pages
with equal blocks count as one, so exact copies of an article survive. Where markup names the article, more is asked: a run must
stand on SHARE of all the host's pages (and on MIN_PAGES), its blocks at the article's head or tail, and all that goes be at
most EDGE of the article's tokens. So lines that some articles share, and editions of one article, stay whole; a notice that a
host puts around its articles goes.

Pages are dealt into chunks, and the parsed pages written in buckets by chunk, so that they are never shuffled. Suffix arrays
number the runs of a chunk and count their pages; sorted keys of the runs meet in ranges, over all chunks, and each chunk gets
back, of the runs on MIN_PAGES pages, a bit and the number of pages. So no host is in one task, nor in one array. A key has SPARE bits more than the
number of tokens: two different runs have the same one with a chance of 2**-SPARE at most, at every size. A run that stands
on two pages may so, once in 2**SPARE times, be taken for one on three; one that stands on one page once in 4**SPARE.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import kernel
from docketry.llm.kernel import U, mix
from docketry.llm.shared import partitions, settle, settle_by, table
from docketry.llm.url_filter import host_path

#: A run of so many tokens on so many distinct pages of a host is boilerplate; a block goes when more than this share of it is covered.
MIN_RUN, MIN_PAGES, COVERED = 6, 3, 0.5
#: In an article named by markup: the share of the host's pages a run must stand on, and the most of an article that goes.
SHARE, EDGE = 0.5, 0.2
#: Bytes of text in a chunk, in one suffix array, and for each bucket in which the runs' keys meet.
CHUNK, BLOCK, MEET = 24_000_000, 4_000_000, 16_000_000
#: Bits of a run's key beyond those that number all tokens; the least and largest range of a key's high part.
SPARE, LEAST, MOST = 14, 2**19, 2**23

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
AWAY = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "svg", "dialog", "menu", "object", "canvas", "audio", "video", "math", "label"}
BLOCKS = {
    "p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote",
    "pre", "figure", "figcaption", "dl", "dt", "dd", "hr", "address", "details", "summary", "fieldset", "body", "html", "center", "hgroup",
}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
WHOLE = {"html", "body", "article", "main"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|ads?|adverts?|advertisement|adsbygoogle|banner|promo|promotion|sponsor|sponsored|cookies?|consent|gdpr|notice|alert|popup|modal"
    r"|newsletter|subscribe|signup|share|sharing|social|comments?|disqus|replies|respond|related|recommended|widget|toolbar|pagination|pager|complementary|contentinfo|search)(?:[\s_-]|$)",
    re.I,
)


#: Names that look like boilerplate but hold the article's own head or body.
OWN = re.compile(r"(?:article|entry|post|story|content|main)[_-]+(?:header|head|title|body|text|content)", re.I)
#: Of elements that may be left open: the containers that nest them, and the siblings that end them (fixed by HTML).
IMPLIED = {
    "li": ({"ul", "ol", "menu"}, {"li"}), "dt": ({"dl"}, {"dt", "dd"}), "dd": ({"dl"}, {"dt", "dd"}), "td": ({"table"}, {"td", "th", "tr", "thead", "tbody", "tfoot"}), "th": ({"table"}, {"td", "th", "tr", "thead", "tbody", "tfoot"}),
    "tr": ({"table"}, {"tr", "thead", "tbody", "tfoot"}),
}
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd", "body", "html"} | {"nav", "header", "footer", "aside", "form", "menu"}


def blocks(page: str) -> tuple[list[str], bool]:
    """The candidate blocks of a page, in order, and whether its markup names the article."""
    article: list[str] = []
    central: list[str] = []
    rest: list[str] = []
    held: list[str] = []
    inside = {"article": 0, "main": 0}
    away, depth, nested, at, seen = "", 0, 0, 0, {"article": False, "main": False}

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                (article if inside["article"] else central if inside["main"] else rest).append(text)

    find = TAG.search
    while True:
        m = find(page, at)
        if m is None:
            if not away:
                held.append(page[at:])
            break
        if not away and m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing, open_ended = bool(m[1]), m[3].endswith("/")
        if name in RAW and not closing:
            if not open_ended:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if away and away in IMPLIED:
            around, siblings = IMPLIED[away]
            if name in around:
                nested += -1 if closing else 1
            if nested < 0 or (nested == 0 and name in siblings and not (closing and name == away)):  # its container or a sibling ends it
                away, depth, nested = "", 0, 0
        elif away == "p" and name != "p" and ((name in ENDS_P and not closing) or (closing and name in BLOCKS)):
            away, depth = "", 0
        elif away == "p" and name == "p" and not closing:
            away, depth = "", 0
        if away:
            if name == away and not open_ended:
                depth += -1 if closing else 1
                if depth == 0:
                    away = ""
            elif closing and name in WHOLE:  # an element that was never closed ends with what holds it
                away, depth = "", 0
                flush()
                if name in inside and inside[name]:
                    inside[name] -= 1
            continue
        named = not closing and name not in WHOLE and name not in VOID and any(NAMES.search(OWN.sub(" ", a or b or c or "")) for _, a, b, c in ATTRIBUTE.findall(m[3]))
        named = named or (not closing and name == "article" and any(re.search(r"comment|repl(?:y|ies)|teaser|related", a or b or c or "", re.I) for _, a, b, c in ATTRIBUTE.findall(m[3])))
        if not closing and (name in AWAY or named):
            flush()
            if not open_ended:
                away, depth, nested = name, 1, 0
            continue
        if name in BLOCKS:
            flush()
            if name in inside:
                if closing:
                    inside[name] = max(0, inside[name] - 1)
                elif not open_ended:
                    inside[name] += 1
                    seen[name] = True
        elif name == "br":
            held.append(" ")
    flush()
    if seen["article"] and article:
        return article, True
    if seen["main"] and central:
        return central, True
    return rest + article + central, False


def _parser(most: int):
    """Blocks joined by two line breaks (a block has none inside), their bytes, and the chunk of each page: the uid of its first page."""

    def run(batches):
        chunk, held = -1, most + 1
        for batch in batches:
            found = [blocks(x or "") for x in batch.column("html").to_pylist()]
            text = ["\n\n".join(b) for b, _ in found]
            size, own = [len(x.encode()) for x in text], []
            for uid, n in zip(batch.column("uid").to_pylist(), size, strict=True):
                if held + n > most:
                    chunk, held = uid, 0
                held += n + 100  # an empty page takes some room too
                own.append(chunk)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host", "uid")), pa.array(text, pa.string()), pa.array([s for _, s in found], pa.bool_()), pa.array(size, pa.int64()), pa.array(own, pa.int64())],
                names=["page_id", "url", "host", "uid", "text", "sure", "size", "chunk"],
            )

    return run


def _suffixes(tokens: np.ndarray, run: int) -> np.ndarray:
    """The rank of each suffix by its first ``run`` tokens, equal for equal ones."""
    n = len(tokens)
    rank, length = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        later = np.full(n, -1, np.int64)
        later[:-step] = rank[step:] if step < n else later[:-step]
        order = np.lexsort((later, rank))
        new = np.concatenate(([True], (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        length += step
    return rank


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = MIN_RUN, pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that stands on ``pages`` distinct pages.

    The suffix array is built by doubling up to ``run`` tokens: suffixes that agree so far are neighbours in it.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    rank = _suffixes(tokens, run)
    whole = np.zeros(n, bool)  # runs that stay on their page
    whole[: n - run + 1] = page[run - 1 :] == page[: n - run + 1]
    at = np.flatnonzero(whole)
    pairs = np.unique(np.stack((rank[at], page[at])), axis=1)
    count = np.bincount(pairs[0], minlength=int(rank.max()) + 1)
    return _covered(at[count[rank[at]] >= pages], n, run)


def _covered(starts: np.ndarray, n: int, run: int = MIN_RUN) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + run, n), -1)
    return np.cumsum(cover[:-1]) > 0


def _runs(host: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (hashes that hold the host), the page of each, the starts of runs that stay on their page, and their hashes."""
    begin, end, first = kernel.word_spans(data, offsets)
    page = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    _, names, cut = next(kernel.blocks(host, 1 << 62))
    tokens = mix(kernel.span_hash(kernel.prefix(data), begin, end) + kernel.span_hash(kernel.prefix(names), cut[:-1], cut[1:])[page])
    last = max(0, len(tokens) - MIN_RUN + 1)
    at = np.flatnonzero(page[:last] == page[len(page) - last :]) if last else np.zeros(0, np.int64)
    return tokens, page, at, kernel.combine(tokens, MIN_RUN)[at]


class Keys:
    """How the keys of runs are made and packed, for so many bytes of text on so many buckets.

    A key is a high part below ``width`` and ``low`` bytes. A bucket is a range of high parts; the keys of a chunk in it are
    sorted, their low bytes stand end to end, and their high parts are the gaps between the ones of a bitmap.
    """

    def __init__(self, size: int, buckets: int):
        self.low, room = 3, (size // 2 + 1) << SPARE
        while room >> 8 * self.low > MOST:
            self.low += 1
        self.width = max(LEAST, room >> 8 * self.low)
        self.buckets = min(buckets, self.width)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        shift = U(8 * self.low)
        return ((hashes >> shift) % U(self.width) << shift) | (hashes & ((U(1) << shift) - U(1)))

    def _begin(self, bucket: np.ndarray) -> np.ndarray:
        """The least high part in each bucket."""
        return -(-bucket * self.width // self.buckets)

    def cells(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that sorted keys fall in, and the bounds of their keys."""
        bucket = (keys >> U(8 * self.low)).astype(np.int64) * self.buckets // self.width
        some, first = np.unique(bucket, return_index=True)
        return some, np.append(first, len(keys))

    def pack(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
        """(buckets, bounds, low bytes, high parts) of sorted distinct keys."""
        some, cuts = self.cells(keys)
        begin, each = self._begin(some), np.diff(cuts)
        ends = np.cumsum((self._begin(some + 1) - begin + each + 7) // 8)
        starts = ends - np.diff(ends, prepend=0)
        bits = np.zeros(int(ends[-1]) * 8, bool)
        high = (keys >> U(8 * self.low)).astype(np.int64)
        bits[np.repeat(starts * 8 - begin - cuts[:-1], each) + high + np.arange(len(keys))] = True
        bits, low = np.packbits(bits, bitorder="little"), np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : self.low]
        pairs = lambda x: zip(x[:-1].tolist(), x[1:].tolist(), strict=True)
        return some, cuts, [low[i:j].tobytes() for i, j in pairs(cuts)], [bits[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]

    def unpack(self, low: bytes, high: bytes) -> np.ndarray:
        """The keys of a cell, their high parts less the least of the bucket."""
        n = len(low) // self.low
        out = np.zeros((n, 8), np.uint8)
        out[:, : self.low] = np.frombuffer(low, np.uint8).reshape(n, self.low)
        rest = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little")) - np.arange(n)
        return out.reshape(-1).view(U) | (rest.astype(U) << U(8 * self.low))


def _pages(table: pa.Table):
    """Blocks of a chunk: its first page, and ``_runs`` of its pages."""
    host = table["host"].combine_chunks() if isinstance(table["host"], pa.ChunkedArray) else table["host"]
    for first, data, offsets in kernel.blocks(table["text"], BLOCK):
        size = len(offsets) - 1
        yield first, size, _runs(host.slice(first, size), data, offsets)


def _counter(keys: Keys):
    """Rows (bucket, chunk, low, high, n): the distinct runs of a chunk, and on how many of its pages each stands."""
    names = ["bucket", "chunk", "low", "high", "n"]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)))

    def run(pages: pa.Table, again: pa.Table) -> pa.Table:
        found, counts = [], []
        repeat = np.isin(pages["uid"].to_numpy(), again["uid"].to_numpy())
        for first, size, (tokens, page, at, hashes) in _pages(pages):
            if not len(at):
                continue
            rank, own, fresh = _suffixes(tokens, MIN_RUN)[at], page[at], ~repeat[first : first + size]
            order = np.lexsort((own, rank))
            new = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
            one = (new | np.concatenate(([True], own[order][1:] != own[order][:-1]))) & fresh[own[order]]
            starts = np.flatnonzero(new)
            counts.append(np.add.reduceat(one.astype(np.int64), starts))
            found.append(keys.of(hashes[order[starts]]))
        if not found:
            return kinds.empty_table()
        whole, n = np.concatenate(found), np.concatenate(counts)
        order = np.argsort(whole, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], whole[order][1:] != whole[order][:-1])))
        n = np.add.reduceat(n[order], starts).astype(np.uint32)
        some, cuts, low, high = keys.pack(whole[order[starts]])
        chunk = np.full(len(some), pages["chunk"][0].as_py(), np.int64)
        return pa.Table.from_arrays(
            [pa.array(some), pa.array(chunk), pa.array(low, pa.binary()), pa.array(high, pa.binary()), pa.array([n[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())], schema=kinds
        )

    return run


def _meet(keys: Keys):
    """(chunk, bucket, hit, n): one bit for each of a chunk's runs in a bucket, set if it stands on MIN_PAGES pages of its host over all
    chunks, and for those the number of pages."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        each = [keys.unpack(x, y) for x, y in zip(frame["low"], frame["high"], strict=True)]
        _, at = np.unique(np.concatenate(each), return_inverse=True)
        pages = np.bincount(at, np.frombuffer(b"".join(frame["n"]), np.uint32))[at].astype(np.uint32)
        cuts = np.cumsum([len(x) for x in each])[:-1]
        hit, n = np.split(pages >= MIN_PAGES, cuts), np.split(pages, cuts)
        some = np.array([x.any() for x in hit], bool)
        out = pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "hit": [np.packbits(x).tobytes() for x in hit], "n": [y[x].tobytes() for x, y in zip(hit, n, strict=True)]})
        return out[some].assign(host=None, pages=0)

    return run


def _left(blocks: list[str], gone: np.ndarray, sizes: np.ndarray, sure: bool) -> list[str]:
    """The blocks that stay. Of an article named by markup only head and tail go, and only a small part of it."""
    if sure:
        ends = np.flatnonzero(~gone)
        gone = gone.copy()
        if len(ends):
            gone[ends[0] : ends[-1] + 1] = False
        if not len(ends) or sizes[gone].sum() > EDGE * sizes.sum():
            return blocks
    return [b for b, x in zip(blocks, gone, strict=True) if not x]


def _judge(keys: Keys):
    """The pages of a chunk less their blocks that the host's repeated runs cover."""

    def run(pages: pa.Table, hits: pa.Table) -> pa.Table:
        if hits.num_rows:
            texts, sure = pages["text"].to_pylist(), pages["sure"].to_pylist()
            parts = [(first, size, len(tokens), page, at, keys.of(hashes)) for first, size, (tokens, page, at, hashes) in _pages(pages)]
            whole = np.unique(np.concatenate([x[-1] for x in parts]))
            some, cuts = keys.cells(whole)
            counts, special = np.zeros(len(whole), np.int64), hits["bucket"].to_numpy() < 0
            sizes = dict(zip(hits["host"].filter(pa.array(special)).to_pylist(), hits["pages"].filter(pa.array(special)).to_pylist(), strict=True))
            hosts, own_hits = pages["host"].to_pylist(), hits.filter(pa.array(~special))
            place = np.searchsorted(some, own_hits["bucket"].to_numpy())
            for k, bits, n in zip(place.tolist(), own_hits["hit"].to_pylist(), own_hits["n"].to_pylist(), strict=True):
                width = int(cuts[k + 1] - cuts[k])
                counts[cuts[k] : cuts[k + 1]][np.unpackbits(np.frombuffer(bits, np.uint8), count=width).astype(bool)] = np.frombuffer(n, np.uint32)
            for first, size, n, page, at, own in parts:
                least = np.array([max(MIN_PAGES, SHARE * sizes.get(hosts[first + k], 0)) if sure[first + k] else MIN_PAGES for k in range(size)])
                many = counts[np.searchsorted(whole, own)] >= least[page[at]]
                hidden = np.concatenate(([0], np.cumsum(_covered(at[many], n))))
                bounds = np.searchsorted(page, np.arange(size + 1))
                for k in np.flatnonzero(hidden[bounds[1:]] > hidden[bounds[:-1]]).tolist():
                    text = texts[first + k].split("\n\n")
                    ends = bounds[k] + np.concatenate(([0], np.cumsum([b.count(" ") + 1 for b in text])))
                    width = np.diff(ends)
                    texts[first + k] = "\n\n".join(_left(text, hidden[ends[1:]] - hidden[ends[:-1]] > COVERED * width, width, sure[first + k]))
            pages = pages.set_column(pages.column_names.index("text"), "text", pa.array(texts, pa.string()))
        return pages.select(["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, url, text) for each row of ``pages(page_id, url, html)``: blocks joined by two line breaks.

    Null or empty html has the empty text. Repeated rows come back as often as they stand there. References are decoded,
    white space inside a block is one space, nothing is cut. ``chunk`` (bytes of text) bounds a task, not the result.
    """
    host, _ = host_path(F.col("url"))
    own = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), F.monotonically_increasing_id().alias("uid"))
    kind = dict(pages.dtypes)["page_id"]
    spark = pages.sparkSession
    raw = own.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("n")).first()["n"]
    parsed = own.mapInArrow(_parser(chunk), "page_id string, url string, host string, uid long, text string, sure boolean, size long, chunk long")
    parsed = settle_by(parsed, "parsed", "chunk", max(partitions(spark), 4 * (raw // chunk + 1)))  # most buckets hold one chunk or none
    size = parsed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    if not size:
        return parsed.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text")
    # pages of a host with equal blocks count as one: all but the first are marked
    each = settle(parsed.select("uid", "chunk", "host", F.xxhash64("host", "text").alias("digest")), "digests")
    heads = each.groupBy("digest").agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = each.join(heads, "digest").filter("uid <> first").select("chunk", "uid")
    # each chunk learns how many distinct pages its hosts have
    of_host = each.select("host", "digest").distinct().groupBy("host").agg(F.count("*").cast("int").alias("pages"))
    sizes = each.select("chunk", "host").distinct().join(of_host, "host").select("chunk", F.lit(-1).cast("long").alias("bucket"), F.lit(b"").alias("hit"), F.lit(b"").alias("n"), "host", "pages")
    keys = Keys(int(size), int(max(partitions(spark), size // MEET + 1)))
    runs = parsed.select("chunk", "uid", "host", "text").groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(_counter(keys), "bucket long, chunk long, low binary, high binary, n binary")
    hits = runs.groupBy("bucket").applyInPandas(_meet(keys), "chunk long, bucket long, hit binary, n binary, host string, pages int").unionByName(sizes)
    left = parsed.select("chunk", "page_id", "url", "host", "text", "sure").groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_judge(keys), "page_id string, url string, text string")
    return left.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
