"""HTML extraction: page blocks by markup, boilerplate by runs of words repeated over a host's pages.

A page becomes blocks of text in page order, each with what its markup says: in a menu, header, footer, sidebar, notice,
advert, form or reader comments (it goes), in the page's declared article (it stays), or neither. A run of at least
DEPTH words that stands on two pages of different words of a host is repeated. Blocks that nothing declares are
removed where such runs cover most of them, or links do; what is unique stays. A declared article stays whole: the
same article, or a passage of it, may well stand on many pages.

Every window of DEPTH words has a fingerprint of its words and host. A task puts the windows of its pages together with
a suffix array (prefix doubling) over at most GROUP_TOKENS tokens, so what is repeated there leaves as one row; the
smallest and largest page of each fingerprint are then taken over all tasks, and the fingerprints with two pages are
joined back to the pages that hold them. The result depends on the host's pages alone, not on groups or partitions.
If repeats need not be counted, pages are not shuffled for this where their markup decides, nor windows of hosts on
which it always does.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldengine.llm.batches import bound_batches
from yieldengine.llm.textscan import document_words, gram_hashes, mix
from yieldengine.llm.urls import host_of

#: Tokens of a run that counts as repeated; a power of two.
DEPTH = 8
#: Share of an undeclared block that repeated runs, or links, may cover.
MOST_COVERED = 0.5
GROUP_TOKENS = 1_000_000
#: Slots to which hosts with undeclared pages are hashed; the windows of hosts in other slots are not asked for.
SLOTS = 1 << 16

DROPPED, ARTICLE, MAIN, NAMED, PLAIN = range(5)

# Names of the HTML vocabulary, and words by which authors name page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot munder mover munderover mstyle mpadded mspace".split()
)
OUT_TAGS = frozenset("nav footer aside form button select dialog menu svg canvas object datalist audio video map annotation annotation-xml".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu "
    "breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget pagination pager toolbar skip form".split()
)
#: What may stand beside a name within a compound one that means no more than the name: `site-footer`, `share-buttons`.
PLACE_NAMES = frozenset(
    "site page global top bottom left right main primary secondary wrapper container inner outer box block bar area section "
    "region panel list links buttons button icons slot unit holder posts articles stories teaser module row this us tools follow more".split()
)
COMMENT_NAMES = frozenset("comment comments disqus respond replies reply".split())
BODY_NAMES = frozenset("article content post entry story main".split())

#: Elements that hold text rather than parts of a page.
TEXT_TAGS = frozenset(
    "h1 h2 h3 h4 h5 h6 p li ul ol dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption address".split()
) | INLINE

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only behind an equals sign
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_NAME = re.compile(r"[a-z]+|[^a-z\s_-]+")


def _names(value: str, whole: bool) -> set[str]:
    """The words of class names or an id. With `whole`, only of those that say nothing else than the name of a page part."""
    found: set[str] = set()
    for name in value.split():
        words = _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if not whole or all(w in OUT_NAMES or w in COMMENT_NAMES or w in BODY_NAMES or w in PLACE_NAMES or w == "header" for w in words):
            found.update(words)
    return found


def _kind(tag: str, attributes: str, kind: int, strong: bool, inside: bool) -> tuple[int, bool]:
    """The kind of what an element holds, and whether an article within may not change it."""
    names: set[str] = set()
    role, hidden = "", False
    if attributes.strip():
        for name, double, single, bare in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), double or single or bare
            if name == "class" or name == "id" and tag not in TEXT_TAGS:  # a paragraph's id is where links lead
                found = _names(value, kind == ARTICLE or tag in TEXT_TAGS)
                names |= found & COMMENT_NAMES if name == "id" and tag == "section" and kind == ARTICLE else found
                if tag not in TEXT_TAGS:
                    names |= _names(value, False) & COMMENT_NAMES
            elif name == "role":
                role = value.strip().lower()
            elif name == "hidden":
                hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    if kind == DROPPED and strong:
        return DROPPED, True
    if tag in ("html", "body"):
        names -= OUT_NAMES | COMMENT_NAMES | {"header"}  # these say what the page has, not what it is
    if tag in OUT_TAGS or role in OUT_ROLES or hidden or names & COMMENT_NAMES:
        return DROPPED, True
    if tag == "header" and not inside:
        return DROPPED, True
    if names & OUT_NAMES or ("header" in names and not inside):
        return DROPPED, False
    if tag == "article" or role == "article":
        return ARTICLE, False
    if (tag == "main" or role == "main") and kind in (PLAIN, NAMED, DROPPED):
        return MAIN, False
    if names & BODY_NAMES and kind == PLAIN:
        return NAMED, False
    if names & BODY_NAMES and kind == DROPPED:
        return PLAIN, False  # content in what looked like a sidebar: repetition decides
    return kind, strong


#: Elements that end an open one of their own name, and paragraphs, which any block ends.
SELF_ENDING = frozenset("li dt dd tr td th option optgroup".split())


def page_blocks(page: str) -> list[tuple[int, str, float]]:
    """(kind, text, share of it in links) of the blocks of a page, in page order, without empty ones."""
    blocks: list[tuple[int, str, float]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements, with the kind and firmness around them
    kind, strong, links = PLAIN, False, 0
    parts: list[tuple[str, bool]] = []
    own = PLAIN  # the kind of the block at hand

    def close_block():
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p) for p, link in parts if link)
                blocks.append((own, text, linked / sum(len(p) for p, _ in parts)))
            parts.clear()

    def say(text: str):
        nonlocal own
        if text and kind != DROPPED:
            if not parts:
                own = kind
            parts.append((html.unescape(text) if "&" in text else text, links > 0))

    at, end = 0, len(page)
    while at < end:
        match = _TAG.search(page, at)
        if match is None:
            say(page[at:])
            break
        say(page[at : match.start()])
        at = match.end()
        slash, tag, attributes = match.groups()
        if tag is None:
            if match[0].startswith("<![CDATA["):
                say(html.escape(match[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        block = tag not in INLINE and tag != "br"
        if tag == "br":
            say(" ")
        elif slash:
            if block:
                close_block()
            elif tag == "a":
                links = max(links - 1, 0)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    _, kind, strong = stack[i]
                    del stack[i:]
                    break
                if not block and stack[i][0] not in INLINE:
                    break  # an inline element does not end across a block
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
        else:
            if block:
                close_block()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == tag and tag in SELF_ENDING:
                        _, kind, strong = stack[i]
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif tag == "a":
                links += 1
            if tag not in VOID:
                stack.append((tag, kind, strong))
                kind, strong = _kind(tag, attributes, kind, strong, kind in (ARTICLE, MAIN))
    close_block()
    return blocks


def repeated_classes(tokens: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of `depth` tokens that occur more than once, in the order of their class, and where each class begins.

    Prefix doubling: suffixes are ranked by their first 1, 2, 4, ... tokens; one whose rank is its own is settled and
    leaves the sort. Separators are tokens that occur once.
    """
    n, width = len(tokens), 1
    _, rank, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    alive = np.flatnonzero(counts[rank] > 1)
    own = n + np.arange(n)
    rank = np.where(counts[rank] > 1, rank, own)
    while width < depth and len(alive):
        alive = alive[alive + width < n]
        alive = alive[rank[alive + width] < n]  # what is followed by something unique is unique
        _, classes, counts = np.unique(rank[alive] * (n + 1) + rank[alive + width], return_inverse=True, return_counts=True)
        again = counts[classes] > 1
        alive, classes = alive[again], classes[again]
        rank = own.copy()
        rank[alive] = classes
        width *= 2
    suffixes = alive[np.argsort(rank[alive], kind="stable")]
    return suffixes, np.flatnonzero(np.append(True, np.diff(rank[suffixes]) != 0)) if len(suffixes) else suffixes


def covered_by(starts: np.ndarray, n: int, depth: int = DEPTH) -> np.ndarray:
    """Whether each of n tokens is in a run of `depth` tokens from one of the starts."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_cover(tokens: np.ndarray, pages: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Whether each token is in a run of at least `depth` tokens that stands on two distinct pages.

    `pages` is the page number of each token; separators are tokens that occur once.
    """
    suffixes, head = repeated_classes(tokens, depth)
    if len(suffixes):
        spread = np.minimum.reduceat(pages[suffixes], head) != np.maximum.reduceat(pages[suffixes], head)
        suffixes = suffixes[np.repeat(spread, np.diff(np.append(head, len(suffixes))))]
    return covered_by(suffixes, len(tokens), depth)


def main_text(blocks: list[tuple[int, str, float]], covered: list[float]) -> str:
    """The kept blocks of a page, joined by line feeds."""
    first = next((i for i, (kind, _, _) in enumerate(blocks) if kind == ARTICLE), len(blocks))
    for declared in (ARTICLE, MAIN, NAMED):
        kept = [
            text for i, (kind, text, links) in enumerate(blocks)
            # a title or lead may stand before the article that it belongs to
            if kind == declared or declared == ARTICLE and kind == MAIN and i < first and links <= MOST_COVERED
        ]
        if kept and any(kind == declared for kind, _, _ in blocks):
            return "\n".join(kept)
    return "\n".join(
        text for (kind, text, links), share in zip(blocks, covered)
        if kind == PLAIN and links <= MOST_COVERED and share <= MOST_COVERED
    )


def is_declared(blocks: list[tuple[int, str, float]]) -> bool:
    """Whether markup alone decides what stays: there is an article, or nothing that could stay."""
    return any(kind != PLAIN for kind, _, _ in blocks) or not blocks


def _hashed(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def block_words(pages: list[list[tuple[int, str, float]]]) -> list[list[np.ndarray]]:
    """Word fingerprints of every block of every page."""
    words = document_words(pa.array([text for blocks in pages for _, text, _ in blocks], pa.string()), lower=False)
    return [[next(words) for _ in blocks] for blocks in pages]


def window_keys(host: str, words: np.ndarray) -> np.ndarray:
    """Fingerprints of a page's windows of DEPTH words, told apart by host."""
    return mix(gram_hashes(words, DEPTH) ^ np.uint64(_hashed((host or "").encode()) % (1 << 64))).view(np.int64)


def _joined(words: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)


def content_key(host: str, words: np.ndarray) -> int:
    """Fingerprint of a page's words and host: copies of a page are one page."""
    return _hashed(words.tobytes(), (host or "").encode())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, list, np.ndarray]]]:
    """Rows (host, html) as groups of (host, blocks, words) of about GROUP_TOKENS tokens; batches bound them too."""
    for batch in batches:
        group, size = [], 0
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blocks = page_blocks(page or "")
            group.append((host, blocks))
            size += sum(text.count(" ") + 1 for _, text, _ in blocks) + 1
            if size >= GROUP_TOKENS:
                yield _with_words(group)
                group, size = [], 0
        if group:
            yield _with_words(group)


def _with_words(group):
    return [(host, blocks, _joined(own)) for (host, blocks), own in zip(group, block_words([b for _, b in group]))]


def _table(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names.split())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, low, high) of the windows of the rows: one row a window of a group, with the smallest and largest page that has it."""
    for group in _groups(batches):
        tokens, keys, contents, starts, total = [], [], [], [], 0
        for number, (host, _, words) in enumerate(group):
            if len(words) >= DEPTH:
                own = window_keys(host, words)
                salt = np.uint64(_hashed((host or "").encode()) % (1 << 64))
                tokens += [mix(words ^ salt), np.array([number], dtype=np.uint64)]
                keys.append(own)
                contents.append(np.full(len(own), content_key(host, words), dtype=np.int64))
                starts.append(total + np.arange(len(own)))
                total += len(words) + 1
        if not keys:
            continue
        keys, contents, starts = np.concatenate(keys), np.concatenate(contents), np.concatenate(starts)
        suffixes, head = repeated_classes(np.concatenate(tokens))
        if len(suffixes):
            at = np.searchsorted(starts, suffixes)
            low, high = np.minimum.reduceat(contents[at], head), np.maximum.reduceat(contents[at], head)
            yield _table("key low high", keys[at[head]], low, high)
            once = np.ones(len(keys), dtype=bool)
            once[at] = False
            keys, contents = keys[once], contents[once]
        yield _table("key low high", keys, contents, contents)


def _asked(every: bool):
    """(key, content) of the windows of the rows whose text, or count of repeats, depends on them."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            seen: set[int] = set()
            for host, blocks, words in group:
                if len(words) < DEPTH or not every and is_declared(blocks):
                    continue
                content = content_key(host, words)
                if content not in seen:
                    seen.add(content)
                    keys = np.unique(window_keys(host, words))
                    yield _table("key content", keys, np.full(len(keys), content, dtype=np.int64))

    return asked


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of the hosts of undeclared rows."""
    found = np.zeros(SLOTS, dtype=bool)
    for batch in batches:
        for slot, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not found[slot] and not is_declared(page_blocks(page or "")):
                found[slot] = True
    yield _table("slot", np.flatnonzero(found))


RESULT = "page_id long, url string, text string, n_chars long, repeated_tokens long"


def _results(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "repeated_tokens"])


def _declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the rows (page_id, url, html) that markup decides, without their repeats."""
    for batch in batches:
        done = []
        for page_id, url, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            blocks = page_blocks(page or "")
            if is_declared(blocks):
                text = main_text(blocks, [])
                done.append((page_id, url, text, len(text), None))
        yield _results(done)


BLOCKS = "page_id long, url string, host string, content long, kinds array<int>, texts array<string>, links array<double>"


def _waiting(every: bool):
    """Rows (host, html, page_id, url) that depend on repeats, as blocks."""

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page, page_id, url in zip(*(batch.column(i).to_pylist() for i in range(4))):
                blocks = page_blocks(page or "")
                if every or not is_declared(blocks):
                    words = _joined(block_words([blocks])[0])
                    kinds, texts, links = zip(*blocks) if blocks else ((), (), ())
                    rows.append((page_id, url, host, content_key(host, words), kinds, texts, links))
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.float64()))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in BLOCKS.split(", ")]
            )

    return waiting


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows of BLOCKS with the keys of their repeated windows."""
    for batch in batches:
        done = []
        for page_id, url, host, _, kinds, texts, links, keys in zip(*(c.to_pylist() for c in batch.columns)):
            blocks = list(zip(kinds, texts, links))
            own = block_words([blocks])[0]
            words = _joined(own)
            starts = np.flatnonzero(np.isin(window_keys(host, words), np.array(keys or [], dtype=np.int64)))
            cover = np.concatenate([[0], np.cumsum(covered_by(starts, len(words)))])
            ends = np.cumsum([0, *map(len, own)])
            counts = [int(n) for n in cover[ends[1:]] - cover[ends[:-1]]]
            text = main_text(blocks, [n / max(len(w), 1) for n, w in zip(counts, own)])
            done.append((page_id, url, text, len(text), sum(counts)))
        yield _results(done)


def extract_text(pages: DataFrame, count_repeats: bool = True) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text (main text, blocks joined by line feeds, empty if
    none), n_chars (its code points), repeated_tokens (tokens in runs repeated on other pages of the host).

    Without `count_repeats`, repeated_tokens is null where the text does not depend on it, which spares most of the work.
    A null or empty html has an empty text; a null url belongs to the empty host. Character references are decoded,
    white space inside a block is one space. Repeated rows give repeated results, null ids stay, other columns are
    ignored, a table without rows gives none.
    """
    bound_batches(pages.sparkSession)
    given = pages.select(
        host_of(F.col("url")).alias("host"), "html", F.col("page_id").cast("long").alias("page_id"), "url"
    )
    slot = F.pmod(F.xxhash64("host"), F.lit(SLOTS)).cast("int")
    near = given
    if not count_repeats:
        found = given.select(slot.alias("slot"), "html").mapInArrow(_slots, "slot long").distinct().collect()
        declared = given.select("page_id", "url", "html").mapInArrow(_declared, RESULT)
        if not found:
            return declared
        bits = bytearray(SLOTS // 8)
        for (n,) in found:
            bits[n // 8] |= 1 << n % 8
        # as bytes in one literal, so that the plan stays small however many hosts there are
        byte = F.conv(F.hex(F.substring(F.lit(bytes(bits)), F.floor(slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        near = given.where(F.getbit(byte, slot % 8) == 1)
    rows = near.select("host", "html")
    low_high = rows.mapInArrow(_windows, "key long, low long, high long").groupBy("key").agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    shared = low_high.where(F.col("low") != F.col("high")).select("key")
    asked = rows.mapInArrow(_asked(count_repeats), "key long, content long")
    keys = asked.join(shared, "key").groupBy("content").agg(F.collect_set("key").alias("keys"))
    waiting = near.mapInArrow(_waiting(count_repeats), BLOCKS)
    judged = waiting.join(keys, "content", "left").select(
        "page_id", "url", "host", "content", "kinds", "texts", "links", "keys"
    ).mapInArrow(_judged, RESULT)
    return judged if count_repeats else declared.unionByName(judged)
