"""Main text of web pages by host suffix arrays (operator 1).

A page is read into blocks of text in page order, each with the containers around it. What stands in a container for
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments is left out, and if the
page names its main part (`article`, `main` or their roles), so is all that stands outside of it.

Suffix arrays tell the rest from the host's boilerplate: the token streams of a host's pages are concatenated (all blocks
but those of a named main part), suffixes are sorted by prefix doubling to a depth of RUN tokens, and every run of RUN
tokens that occurs in pages with different streams is boilerplate. Of pages that name no main part, what runs cover
goes and the unique runs stay. A block whose container only might be left out by its name (`share-price`, `form-factor`: a
word for such containers beside other words) goes if runs cover it from end to end, and stays otherwise, in named main
parts too. How many words of each page runs cover is part of the result.

Why the suffix array does not decide on the other blocks of a named main part: whole articles and passages recur on a
host as ordinary content, and the contract drops none of it.

Scale: parsing is row by row; the blocks, compressed, are then grouped by host, one of over GROUP_PAGES pages being dealt to
groups by page hash. Each group of such a host first sends the hashes of its runs with their owners, which are merged by
host and hash; runs found to have several owners go back to the groups that hold them. So every group sees the whole
host, results do not depend on the dealing, and a task holds 2 * GROUP_PAGES pages at a time, whatever a host has.
"""

from __future__ import annotations

import html
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

GROUP_PAGES, RUN = 256, 8
#: Up to so many hosts (with their numbers of groups) are broadcast.
BROADCAST_HOSTS = 100_000
#: What is known of a block: left out, outside or inside a named main part, and DOUBTFUL on top if only its container's name tells.
LEFT_OUT, OUTSIDE, MAIN, DOUBTFUL = 0, 1, 2, 4

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|<(?:\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements and attribute words that mark what is not main text.
SKIP_TAGS = frozenset("head nav footer aside form button select option label menu dialog canvas object audio video".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SKIP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal overlay "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner share sharing social comment comments disqus "
    "related recommended newsletter subscribe subscription pagination pager widget toolbar login signup search form".split()
)
#: Words that may stand beside those in one name without making it another thing.
BESIDE_WORDS = frozenset(
    "area article bar block blog body bottom box btn button buttons card cards cell close col column container content counter count desktop entry fixed float global grid group head heading holder icon icons id inner "
    "input item items js label large layer left link links list main medium message messages mobile modal module nav outer page panel policy post primary right row secondary section site slot small sticky story "
    "strip tab tabs text thread title top unit view wrap wrapper zone".split()
)
#: In a main part a header holds the title; elsewhere it is the page's.
OUTER_ONLY = frozenset(["header"])
MAIN_TAGS, MAIN_ROLES = frozenset(["article", "main"]), frozenset(["main", "article"])
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK_TAGS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "head"}


def _skipped(tag: str, attrs: str, in_main: bool) -> int:
    """LEFT_OUT for a container of what is no main text, DOUBTFUL where its name only has a word for one, else -1."""
    if tag in SKIP_TAGS or (tag in OUTER_ONLY and not in_main):
        return LEFT_OUT
    found = -1
    if not attrs:
        return found
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in SKIP_ROLES:
            return LEFT_OUT
        if name in ("class", "id") and tag not in ("body", "html") and tag not in MAIN_TAGS:
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one) if not w.isdigit()}
                named = words & SKIP_WORDS if in_main else words & (SKIP_WORDS | OUTER_ONLY)
                if named and words <= SKIP_WORDS | OUTER_ONLY | BESIDE_WORDS:
                    return LEFT_OUT
                if named:
                    found = DOUBTFUL
        if (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return LEFT_OUT
    return LEFT_OUT if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs) else found


def _is_main(tag: str, attrs: str) -> bool:
    return tag in MAIN_TAGS or any(n.lower() == "role" and (a or b or c).lower() in MAIN_ROLES for n, a, b, c in _ATTR.findall(attrs))


def marked_blocks(source: str | None) -> list[tuple[int, str]]:
    """(what is known, text) of each block in page order; scripts, styles and the like have no text."""
    out: list[tuple[int, str]] = []
    if not source:
        return out
    stack: list[tuple[str, bool, bool, bool]] = []  # (tag; left out, main, doubtful: here or above)
    parts: list[str] = []
    off = main = doubtful = False

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((LEFT_OUT if off else (MAIN if main else OUTSIDE) + (DOUBTFUL if doubtful else 0), text))
            parts.clear()

    def pop_to(k: int) -> None:
        nonlocal off, main, doubtful
        del stack[k:]
        off, main, doubtful = stack[-1][1:] if stack else (False, False, False)

    at = 0
    for m in _MARKUP.finditer(source):
        if m.start() > at:
            parts.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    above = stack[k - 1][1:] if k else (False, False, False)
                    if tag in BLOCK_TAGS or above != (off, main, doubtful) or any(s[0] in BLOCK_TAGS for s in stack[k:]):
                        flush()
                    pop_to(k)
                    break
            else:
                if tag in BLOCK_TAGS:
                    flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if tag in VOID_TAGS:
            continue
        attrs = m["attrs"] or ""
        ends = {"p"} if tag in ENDS_P else CLOSES.get(tag, ())
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK_TAGS:
                    break
        if attrs.endswith("/") and tag not in BLOCK_TAGS:
            continue
        told = _skipped(tag, attrs, main)
        now_off, now_doubtful = off or told == LEFT_OUT, doubtful or told == DOUBTFUL
        if (now_off, now_doubtful) != (off, doubtful):
            flush()
        now_main = main or (not now_off and _is_main(tag, attrs))
        if now_main and not main:
            flush()
        stack.append((tag, now_off, now_main, now_doubtful))
        off, main, doubtful = now_off, now_main, now_doubtful
    if at < len(source):
        parts.append(html.unescape(source[at:]))
    flush()
    return out


def page_blocks(source: str | None) -> list[tuple[bool, str]]:
    """(inside a named main part, text) of each block in page order that no container leaves out for sure."""
    return [(bool(known & MAIN), text) for known, text in marked_blocks(source) if known != LEFT_OUT]


def suffix_order(text: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the text to a depth of `run` tokens, by prefix doubling, and where its groups of equal runs begin."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    order = np.argsort(rank, kind="stable")
    return order, np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])


class Runs:
    """The runs of `run` tokens in some token streams, concatenated; negative tokens separate, equal owners are one stream."""

    def __init__(self, streams: list[np.ndarray], run: int, owners: list[int] | None = None) -> None:
        self.run = run
        self.starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])]).astype(np.int64)
        self.n = int(self.starts[-1])
        self.text = np.empty(self.n, np.int64)
        owner = np.empty(self.n, np.uint64)
        apart = -1
        for k, s in enumerate(streams):
            a = self.starts[k]
            self.text[a : a + len(s)] = s
            cut = a + np.flatnonzero(s < 0)
            self.text[cut] = apart - np.arange(len(cut))  # every separator is unlike any other token
            apart -= len(cut) + 1
            self.text[a + len(s)] = apart
            apart -= 1
            owner[a : a + len(s) + 1] = k if owners is None else owners[k]
        self.order, self.edge = suffix_order(self.text, run) if self.n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if self.n:
            self.low, self.high = np.minimum.reduceat(owner[self.order], self.edge), np.maximum.reduceat(owner[self.order], self.edge)
        else:
            self.low = self.high = np.zeros(0, np.uint64)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Which groups of equal runs have no separator, and the 64-bit hashes of these."""
        first = self.order[self.edge] if self.n else self.order
        fits = first + self.run <= self.n
        h, whole = np.full(len(first), 0x9E3779B97F4A7C15, np.uint64), fits.copy()
        for k in range(self.run):
            token = self.text[np.minimum(first + k, self.n - 1)]
            whole &= token >= 0
            h = (h ^ token.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return np.flatnonzero(whole), h[whole]

    def covered(self, elsewhere: np.ndarray | None = None) -> list[np.ndarray]:
        """For each stream, which tokens lie in a run that occurs in two streams here, or whose hash is elsewhere's (sorted)."""
        shared_group = self.low != self.high
        if elsewhere is not None and len(elsewhere) and self.n:
            at, h = self.hashes()
            place = np.minimum(np.searchsorted(elsewhere, h), len(elsewhere) - 1)
            shared_group[at[elsewhere[place] == h]] = True
        inside = np.zeros(self.n, bool)
        if self.n:
            shared = np.zeros(self.n, bool)
            shared[self.order] = np.repeat(shared_group, np.diff(np.r_[self.edge, self.n]))
            step, hit = np.zeros(self.n + self.run, np.int64), np.flatnonzero(shared)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + self.run, -1)
            inside = np.cumsum(step)[: self.n] > 0
        return [inside[a : b - 1] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]


def repeated_runs(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """For each token stream, which tokens lie in a run of `run` tokens that occurs in two of the streams."""
    return Runs(streams, run).covered()


def unique_words(block: list[str], mask: np.ndarray, run: int = RUN) -> list[str]:
    """The words of a block without covered stretches; a stretch shorter than a run goes only with the whole block."""
    if mask.all():
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    left, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= run:
            left += block[at:a]
            at = b
    return left + block[at:]


_PAD = np.arange(RUN - 1, dtype=np.int64)


class Words:
    """Numbers of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        return np.fromiter((known.get(w) or known.setdefault(w, (xxhash.xxh3_64_intdigest(w) >> 1) | RUN) for w in words), np.int64, len(words))


def page_stream(blocks: list[tuple[int, str]], words: Words) -> tuple[np.ndarray, list[tuple[int, int] | None]]:
    """The tokens of the blocks that no named main part holds for sure, and where each block's are.

    A doubtful block shorter than a run is padded to one, and all end with a separator, so a short one is covered if another page has it.
    """
    parts, spans, at = [np.zeros(0, np.int64)], [], 0
    for known, text in blocks:
        if known == MAIN:
            spans.append(None)
            continue
        tokens = words(text.split(" "))
        spans.append((at, at + len(tokens)))
        parts.append(tokens)
        at += len(tokens)
        if known & DOUBTFUL:
            parts += [_PAD[: max(0, RUN - len(tokens))], np.array([-1], np.int64)]
            at += max(0, RUN - len(tokens)) + 1
    return np.concatenate(parts), spans


class Streams:
    """Token streams of some pages of one host; copies of a page are one stream."""

    def __init__(self, streams: list[np.ndarray]) -> None:
        hashes = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in streams]
        first: dict[int, int] = {}
        for k, h in enumerate(hashes):
            first.setdefault(h, k)
        number = {h: j for j, h in enumerate(first)}
        self.of = [number[h] for h in hashes]
        self.runs = Runs([streams[k] for k in first.values()], RUN, list(first))

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, smallest and largest owner (their upper 32 bits) of every run."""
        at, h = self.runs.hashes()
        return h, (self.runs.low[at] >> np.uint64(32)).astype(np.uint32), (self.runs.high[at] >> np.uint64(32)).astype(np.uint32)

    def covered(self, elsewhere: np.ndarray | None = None) -> list[np.ndarray]:
        """Which tokens of each page's stream lie in runs of other streams."""
        masks = self.runs.covered(elsewhere)
        return [masks[k] for k in self.of]


def cleaned(pages: list[list[tuple[int, str]]], elsewhere: np.ndarray | None = None, words: Words | None = None) -> list[tuple[str, int]]:
    """The main text of each of one host's pages (blocks), and how many of its words runs of other pages cover."""
    words = words or Words()
    streams = [page_stream(blocks, words) for blocks in pages]
    out = []
    for blocks, (_, spans), covered in zip(pages, streams, Streams([s for s, _ in streams]).covered(elsewhere), strict=True):
        named = any(known & MAIN for known, _ in blocks)
        kept, repeated = [], 0
        for (known, text), span in zip(blocks, spans, strict=True):
            mask = covered[slice(*span)] if span else None
            repeated += int(mask.sum()) if span else 0
            if known == LEFT_OUT or bool(known & MAIN) != named or (known & DOUBTFUL and mask.all()):
                continue
            left = text if named else " ".join(unique_words(text.split(" "), mask))
            if left:
                kept.append(left)
        out.append(("\n".join(kept), repeated))
    return out


def main_texts(pages: list[list[tuple[int, str]]]) -> list[str]:
    """The main texts of one host's pages."""
    return [text for text, _ in cleaned(pages)]


def _parsed(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [pack.compress(json.dumps(marked_blocks(x), ensure_ascii=False).encode("utf-8", "surrogatepass")) for x in batch.column("html").to_pylist()]
        batch = batch.drop_columns(["html"])
        yield batch.append_column("blocks", pa.array(data, pa.binary()))


def _streamed(batches):
    """(host, salt, slots, stream) of each page."""
    words = Words()
    for batch in batches:
        data = [page_stream(marked_blocks(x), words)[0].tobytes() for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("salt"), batch.column("slots"), pa.array(data, pa.binary())], ["host", "salt", "slots", "stream"])


def _groups(batches, columns: int):
    """(key, rows) of runs of rows with equal first two columns, at most 2 * GROUP_PAGES at a time for hosts dealt to groups."""
    rows, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if rows and (row[:2] != key or (row[1] >= 0 and len(rows) >= 2 * GROUP_PAGES)):
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield key, rows


def _blocks(data: bytes, unpack) -> list[tuple[int, str]]:
    return json.loads(unpack.decompress(data).decode("utf-8", "surrogatepass"))


_RUN = np.dtype([("hash", np.uint64), ("low", np.uint32), ("high", np.uint32)])


def _sent(batches):
    """(host, slot, salt, runs): the runs of each group, dealt to as many slots as the host has groups."""
    for (host, salt), rows in _groups(batches, 4):
        h, low, high = Streams([np.frombuffer(r[3], np.int64) for r in rows]).sent()
        runs = np.empty(len(h), _RUN)
        runs["hash"], runs["low"], runs["high"] = h, low, high
        slots = rows[0][2]
        slot = (h % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(slot[order]) != 0]) if len(h) else []
        blobs = [(int(slot[order[a]]), runs[order[a:b]].tobytes()) for a, b in zip(edge, [*edge[1:], len(h)], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"host": pa.array([host] * len(blobs), pa.string()), "slot": pa.array([s for s, _ in blobs], pa.int32()), "salt": pa.array([salt] * len(blobs), pa.int32()), "runs": pa.array([x for _, x in blobs], pa.binary())}
        )


def _merged(batches):
    """(host, salt, runs): of one slot, the hashes with several owners that a group holds."""
    held, key = [], None

    def result():
        groups = [(salt, np.frombuffer(x, _RUN)) for salt, x in held]
        every = np.concatenate([x for _, x in groups])
        h, at = np.unique(every["hash"], return_inverse=True)
        low, high = np.full(len(h), 2**32 - 1, np.uint32), np.zeros(len(h), np.uint32)
        np.minimum.at(low, at, every["low"])
        np.maximum.at(high, at, every["high"])
        shared = h[low != high]
        found = [(salt, np.intersect1d(x["hash"], shared)) for salt, x in groups]
        found = [(salt, x.tobytes()) for salt, x in found if len(x)]
        return pa.RecordBatch.from_pydict({"host": pa.array([key[0]] * len(found), pa.string()), "salt": pa.array([s for s, _ in found], pa.int32()), "runs": pa.array([x for _, x in found], pa.binary())})

    for batch in batches:
        for host, slot, salt, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and (host, slot) != key:
                yield result()
                held = []
            key = (host, slot)
            held.append((salt, runs))
    if held:
        yield result()


def _extracted(batches):
    """From (host, salt, kind, blocks or runs, id, url) with a group's shared runs before its pages."""
    import zstandard

    unpack, words = zstandard.ZstdDecompressor(), Words()
    elsewhere, of, kind = np.zeros(0, np.uint64), None, None

    def noted():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(4).type
            yield batch

    for key, rows in _groups(noted(), 6):
        if key != of:
            elsewhere, of = np.zeros(0, np.uint64), key
        told = [np.frombuffer(r[3], np.uint64) for r in rows if r[2] == 0]
        if told:
            elsewhere = np.unique(np.concatenate([elsewhere, *told]))
        rows = [r for r in rows if r[2]]
        found = cleaned([_blocks(r[3], unpack) for r in rows], elsewhere, words)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[4] for r in rows], kind), pa.array([r[5] for r in rows], pa.string()), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
            ["page_id", "url", "text", "n_chars", "n_repeated"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points), n_repeated.

    n_repeated counts the words outside a named main part (or in doubtful blocks) that lie in runs of other pages of the host.
    Null or empty html gives the empty text. A null url, or one without a host, belongs to the host ''. Repeated rows
    are pages of their own with equal texts. Unclosed and cut-off markup is read as browsers do; a line break
    element is white space. Other columns are not read; an empty table gives an empty result.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    large = rows.groupBy("host").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > GROUP_PAGES)
    large = checkpointed(large.select("host", F.ceil(F.col("c") / GROUP_PAGES).cast("int").alias("slots")))
    n_large = large.count()
    ids = dict(rows.dtypes)["page_id"]

    def parsed(df: DataFrame) -> DataFrame:
        whole = df.select("host", "salt", "page_id", "url", "html").mapInArrow(_parsed, f"host string, salt int, page_id {ids}, url string, blocks binary")
        return whole.select("host", "salt", F.lit(1).alias("kind"), "blocks", "page_id", "url")

    if not n_large:  # hosts are groups
        units = parsed(rows.withColumn("salt", F.lit(-1)))
    else:
        sized = rows.join(F.broadcast(large) if n_large <= BROADCAST_HOSTS else large, "host", "left")
        dealt = F.pmod(F.xxhash64("page_id", F.coalesce("url", F.lit("")), F.xxhash64("html")), F.col("slots")).cast("int")
        sized = sized.withColumn("salt", F.coalesce(dealt, F.lit(-1)))
        own = sized.filter("salt >= 0").select("host", "salt", "slots", "html").mapInArrow(_streamed, "host string, salt int, slots int, stream binary")
        sent = own.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(_sent, "host string, slot int, salt int, runs binary")
        shared = sent.repartition("host", "slot").sortWithinPartitions("host", "slot").mapInArrow(_merged, "host string, salt int, runs binary")
        shared = shared.select("host", "salt", F.lit(0).alias("kind"), F.col("runs").alias("blocks"), F.lit(None).cast(ids).alias("page_id"), F.lit(None).cast("string").alias("url"))
        units = parsed(sized).unionByName(shared)
    whole = units.repartition("host", "salt").sortWithinPartitions("host", "salt", "kind", "page_id")
    return whole.mapInArrow(_extracted, f"page_id {ids}, url string, text string, n_chars long, n_repeated long")
