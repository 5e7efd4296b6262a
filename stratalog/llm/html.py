"""Main text of web pages: markup where it speaks, and a host's suffix array of repeated passages where it does not."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .neardup import near_duplicates
from .textops import SPACE, mix, small_batches, word_bounds, word_hashes

#: Tokens of a passage that counts as long; a power of two, as the suffixes are sorted by doubling.
LONG = 8
#: A long passage is boilerplate if it stands on at least PAGES pages of a host and on more than half of them. Near copies, which
#: share ALIKE percent of their main texts' shingles, count as one page.
PAGES, ALIKE = 3, 60

# A quote opens a value only after an equals sign; elsewhere, as in title=it's, it is a character like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|))*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:@-][\w:.@-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# The elements of HTML by what they do here, and the names that mark what is not the article.
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav footer aside form button select datalist dialog menu canvas audio video object map head".split())
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table thead tbody tfoot tr caption blockquote pre section article main header footer nav aside form figure figcaption dl dt dd hr body html head address details summary fieldset legend center hgroup menu dialog".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promos banner cookie cookies consent gdpr notice notices notification popup modal overlay"
    " newsletter subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer"
    " comment comments disqus reply replies respond responses related recommended recommendations share sharing social pagination pager toolbar login copyright disclaimer".split()
)


def _marked(tag: str, attrs: str) -> bool:
    """Whether an element's attributes say that it is not part of the article."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            words = [w.lower() for w in _WORDS.findall(value)]
            if any(w in _NAMES for w in words) or ("side" in words and "bar" in words):
                return True
        elif name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true" or name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return tag not in ("html", "body")
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order. Kind 3: in an article, 2: in the main part, 1: neither, 0: marked as
    something else. White space is single, character references are decoded."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # element, kind within it, whether it is a header of an article
    kind, head, at, low = 1, False, 0, None

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((kind, text))

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if tag in _RAW:
            if not closing and not attrs.endswith("/"):
                if low is None:
                    low = page.lower() if len(page.lower()) == len(page) else page
                end = low.find(f"</{tag}", at)
                stop = low.find(">", end) if end >= 0 else -1
                at = stop + 1 if stop >= 0 else len(page)
            continue
        block = tag in _BLOCK
        if tag in _VOID:
            parts.append(" ") if tag == "br" else flush() if tag == "hr" else None
            continue
        if tag in ("td", "th"):
            parts.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    _, kind, head = stack[-1] if stack else ("", 1, False)
                    break
            else:
                if block:
                    flush()
            continue
        if block:
            flush()
            if stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li" or tag in ("dt", "dd") and stack and stack[-1][0] in ("dt", "dd") or tag == "tr" and stack and stack[-1][0] == "tr":
                stack.pop()
                _, kind, head = stack[-1] if stack else ("", 1, False)
        marked = tag in _DROP or _marked(tag, attrs)
        if not block and not marked:
            continue
        now, header = kind, head
        if marked or kind == 0 and not (head and tag in _HEADINGS):
            now = 0
        elif head and tag in _HEADINGS:
            now = 3
        elif tag == "header":
            now, header = 0, kind == 3
        elif tag == "article":
            now = 3
        elif tag == "main" or "role" in attrs and re.search(r"""role\s*=\s*["']?main\b""", attrs, re.I):
            now = max(now, 2)
        if not block:
            flush()
        stack.append((tag, now, header))
        kind, head = now, header
    flush()
    return out


def suffix_keys(token_hashes: np.ndarray, long: int = LONG) -> np.ndarray:
    """For every suffix of a token stream that has `long` tokens, a hash of these: the keys by which prefix doubling would
    order a suffix array after log2(long) rounds. Neighbours in that array share a passage of `long` tokens iff keys agree."""
    h, step = token_hashes, 1
    while step < long and len(h) > step:
        h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + mix(h[step:] + np.uint64(step)))
        step *= 2
    return h if step >= long else np.zeros(0, np.uint64)


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    s, e = word_bounds(data, np.array([0, len(data)]), ~SPACE)
    return word_hashes(data, s, e, lower=False), s, e


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m.group(1).rpartition("@")[2].lower() if m else ""


def _parse(batches):
    for batch in batches:
        text, free, keys, sig, host = [], [], [], [], []
        for page, url in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True):
            found = blocks(page or "")
            best = max((k for k, _ in found), default=0)
            text.append("\n\n".join(t for k, t in found if k == best) if best > 1 else "")
            free.append([t for k, t in found if k == 1] if best == 1 else [])
            host.append(host_of(url))
            stream = _hashes("\n".join(t for k, t in found if k < max(best, 2)))[0]
            keys.append(np.unique(suffix_keys(stream)).view(np.int64))
            sig.append(int(mix(stream * np.arange(1, 2 * len(stream), 2, dtype=np.uint64)).sum().view(np.int64)) if len(stream) else 0)
        keep = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(host, pa.string()), pa.array(text, pa.string()), pa.array(free, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.int64())], names=[*keep, "host", "text", "free", "keys", "sig"])


def unique_runs(text: str, repeated: np.ndarray, long: int = LONG) -> str:
    """The text without the tokens that repeated passages cover."""
    h, s, e = _hashes(text)
    k = suffix_keys(h, long)
    covered = np.zeros(len(h) + 1, np.int64)
    hit = np.flatnonzero(np.isin(k.view(np.int64), repeated)) if len(k) else np.zeros(0, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + long, -1)
    raw = text.encode()
    return " ".join(raw[a:b].decode() for a, b, c in zip(s, e, np.cumsum(covered)[:-1], strict=True) if not c)


def _clean(batches):
    for pdf in batches:
        texts = []
        for free, repeated in zip(pdf["free"], pdf["repeated"], strict=True):
            rep = np.asarray(repeated if repeated is not None else [], np.int64)
            runs = [unique_runs(t, rep) for t in free]
            texts.append("\n\n".join(r for r in runs if r))
        yield pd.DataFrame({"uid": pdf["uid"], "rest": texts})


def main_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """keep, text, n_chars for every row of pages (url, html).

    A page with an article, or else a main part, gives that part's blocks, without what markup inside it marks as something
    else. Of other pages, the blocks that markup does not mark are held against their host: the suffixes of all its pages'
    token streams outside articles are keyed by their first LONG tokens, the keys that at least PAGES pages and more than half
    of the host's pages share are boilerplate, and the runs of tokens that these do not cover are kept. Pages whose main texts
    (the article, or the unmarked blocks) are near copies count as one, whatever menus and adverts stand beside them, so
    copies of a page do not erase each other; a passage that few pages quote stays. Counts are combined before the shuffle; no
    host is gathered in one task. A null or empty page gives an empty text; a null url is a host of its own; repeated rows are
    answered each; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    cols = list(dict.fromkeys([*keep, "url", "html"]))
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(*cols).schema.fields}
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in cols if c != "html")
    parsed = pages.select(*cols).mapInArrow(_parse, f"{shape}, host string, text string, free array<string>, keys array<long>, sig long")
    parsed = materialize(parsed.withColumn("uid", F.monotonically_increasing_id()), "html-parsed")
    open_ = parsed.where(F.size("free") > 0)
    # texts that markup has settled stay where they are; only the other pages are joined
    told = parsed.where(F.size("free") == 0).select(*keep, "text")
    if open_.isEmpty():
        return told.select("*", F.char_length("text").cast("long").alias("n_chars"))
    hosts = open_.select("host").distinct()
    near = parsed.join(hosts, "host", "left_semi").where("size(keys) > 0 or size(free) > 0 or text <> ''")
    alike = near_duplicates(near.select(F.col("uid").alias("doc_id"), F.when(F.size("free") > 0, F.concat_ws("\n", "free")).otherwise(F.col("text")).alias("text")), ALIKE)
    # a page of nothing but marked blocks is told by these
    paged = near.join(alike.select(F.col("doc_id").alias("uid"), "n_shingles", "component_id"), "uid").select("host", "keys", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("sig")).alias("page"))
    paged = materialize(paged, "html-paged")
    sizes = paged.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = paged.select("host", "page", F.explode("keys").alias("key")).distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= PAGES)
    repeated = counts.join(sizes, "host").where("2 * on > pages").select("host", "key")
    mine = open_.select("uid", "host", F.explode("keys").alias("key")).join(repeated, ["host", "key"]).groupBy("uid").agg(F.collect_list("key").alias("repeated"))
    rest = open_.select("uid", "free").join(mine, "uid", "left").mapInPandas(_clean, "uid long, rest string")
    out = told.unionByName(open_.drop("text").join(rest, "uid").select(*keep, F.col("rest").alias("text")))
    return out.select("*", F.char_length("text").cast("long").alias("n_chars"))


def op6_html_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
