"""Main text of HTML pages: containers are scored per page, hosts vote on generalised paths in Spark, pages are read again by the winning paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped

# Element names of HTML by how they take part in the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
FOREIGN = frozenset("svg math".split())
SKIPPED = frozenset("script style noscript template textarea title iframe object svg math head nav header footer aside form button select dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
#: An open element that ends when one of these begins.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words that mark what isn't the article: as a whole class or id, or as the first or last part of one; those of comments as any part.
NOISE = frozenset("ad ads adv advert advertisement alert alerts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies reply responses share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split())
COMMENTS = frozenset("comment commentlist comments disqus".split())
#: Elements that hold the page or the article, whatever they are called, and roles of what isn't the article.
NEVER_NOISE, HOMES = frozenset("html body main article".split()), frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: A container is a page's best if it is the innermost with this share of its text; it may be read by a path of its host that has this other share.
BEST_SHARE, LEAST_SHARE = 0.9, 0.75
#: An article that holds this share of the text of the main element around it is read in its place.
ARTICLE_SHARE = 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def page_host(url):
    """The lower-case host of a URL column, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


@lru_cache(maxsize=1 << 14)
def _marks(attributes: str) -> tuple[str, bool, int, bool]:
    """(generalised classes, hidden?, noise: 1 if a whole name says so, -1 if only a part of one does, else 0, is a header's name all that says so?) of an element's attributes, read one by one with their quoted values."""
    classes, hidden, noise, header = [], False, 0, True
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = re.split(r"[^a-z0-9]+", token)
                hits = {token} & NOISE or {parts[0], parts[-1]} & NOISE or COMMENTS.intersection(parts)
                header = header and hits <= {"header"}
                noise = 1 if noise == 1 or token in NOISE else -1 if hits else noise
            if name == "class":
                classes += [re.sub(r"\d+", "#", w) for w in value.split()]
        elif name == "role" and value in NOISE_ROLES:
            noise, header = 1, header and value == "banner"
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
    return "".join(f".{c}" for c in sorted(set(classes))), hidden, noise, header


class Block(NamedTuple):
    """A text block: the generalised tag-class paths of the containers around it, outermost first, its text, how many of its characters are in links, the numbers of the noise-like elements around it (negative if only a part of a name says so), whether it is a headline (h1)."""

    paths: tuple[str, ...]
    text: str
    linked: int
    noise: tuple[int, ...]
    headline: bool = False


def blocks_of(html: str) -> Iterator[Block]:
    """Every text block outside elements that are never text of the article.

    Unclosed and misnested tags end as browsers end them for the elements that matter here. A header in an article or main
    element counts as noise by a whole name, but its headline (h1) belongs to the article.
    """
    stack: list[tuple[str, str, int, bool]] = []  # name, path if it is a container, number if noise-like else 0, skipped
    headers: set[int] = set()  # numbers of headers in articles
    parts: list[str] = []
    linked = serial = links = skips = 0
    at, end = 0, len(html)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            n, linked = linked, 0
            if text:
                headline = any(s[0] == "h1" for s in stack)
                return Block(tuple(s[1] for s in stack if s[1]), text, n, tuple(s[2] for s in stack if s[2] and not (headline and s[2] in headers)), headline)
        return None

    def close(k: int):
        nonlocal links, skips
        for name, _, _, skip in stack[k:]:
            links -= name == "a"
            skips -= skip
        del stack[k:]

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at and not skips:
            piece = html[at : m.start()]
            parts.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS and (b := flush()):
            yield b
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if k >= 0 and (name in BLOCKS or not any(s[0] in BLOCKS for s in stack[k + 1 :])):
                close(k)
            continue
        if stack and (ends := ENDED_BY.get(next((s[0] for s in reversed(stack) if s[0] in BLOCKS), ""))) and name in ends:
            close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS))
        closed = m[3].endswith("/")
        if name in VOID or closed and (name in FOREIGN or name not in BLOCKS and name not in RAW):
            continue
        if name in RAW:
            after = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = after.end() if after else end
            continue
        serial += 1
        classes, hidden, noise, header = ("", False, 0, True) if not m[3] else _marks(m[3]) if len(m[3]) < 512 else _marks.__wrapped__(m[3])
        inside = any(s[0] in HOMES for s in stack)
        if name in NEVER_NOISE and not (name == "article" and any(s[0] == "article" for s in stack)):
            noise, skip = 0, False
        else:
            skip = hidden or name in SKIPPED
            if name == "header" and inside and not hidden:
                noise, skip = noise or 1, False
            if noise and inside and header:
                headers.add(serial * noise)
        above = next((s[1] for s in reversed(stack) if s[1]), "")
        stack.append((name, f"{above}>{name}{classes}" if name in CONTAINERS else "", serial * noise, skip))
        skips += skip
        links += name == "a"
    if not skips and at < end:
        parts.append(html[at:])
    if b := flush():
        yield b


def in_home(path: str) -> bool:
    """Is the path that of an article or main element?"""
    return re.split(r"[.]", path.rpartition(">")[2], maxsplit=1)[0] in HOMES


def article_blocks(html: str) -> list[Block]:
    """blocks_of(html) without elements that look like noise by their class, id or role.

    Where an article or main element keeps text of its own, all of them go, however long they are. Else each goes as long
    as any text is left, but for a wrapper of the article with an odd name: one that holds a headline and more than the rest
    does. Those that are noise by a whole name are looked at before those by a part of one, smaller ones before larger. Text
    in links doesn't count as text.
    """
    blocks = list(blocks_of(html))
    size = lambda some: sum(len(b.text) - min(b.linked, len(b.text)) for b in some)
    plain = [b for b in blocks if not b.noise]
    if any(in_home(p) for b in plain for p in b.paths):
        return plain
    for n in sorted({n for b in blocks for n in b.noise}, key=lambda n: (n < 0, size(b for b in blocks if n in b.noise), n)):
        rest = [b for b in blocks if n not in b.noise]
        left = size(rest)
        if left and not (any(b.headline and n in b.noise for b in blocks) and size(blocks) > 2 * left):
            blocks = rest
    return blocks


def container_shares(blocks: list[Block]) -> dict[str, float]:
    """The share of the page's text that each generalised path holds; text in links and short blocks weigh less."""
    held: dict[str, float] = {}
    total = 0.0
    for b in blocks:
        weight = max(0.0, len(b.text) - 2.0 * b.linked) * (1.0 if len(b.text) >= 25 else 0.5)
        total += weight
        for p in set(b.paths):
            held[p] = held.get(p, 0.0) + weight
    return {p: w / total if total else 0.0 for p, w in held.items()}


def best_path(shares: dict[str, float]) -> str | None:
    """The path of the article or main element with most of the text, whatever its share; without one the innermost path that holds nearly all of the text.

    Of an article and the main element around it the article is taken if it holds ARTICLE_SHARE of the other's text, of nested articles the outer one.
    """
    homes = [p for p in shares if in_home(p)]
    if homes:
        articles = [p for p in homes if p.rpartition(">")[2].startswith("article")]
        most = lambda some: min(some, key=lambda p: (-shares[p], p.count(">"), p))
        mains = [p for p in homes if p not in articles]
        if not articles or not mains:
            return most(homes)
        article, main = most(articles), most(mains)
        return article if shares[article] >= ARTICLE_SHARE * shares[main] else main
    fit = [p for p, x in shares.items() if x >= BEST_SHARE]
    return min(fit, key=lambda p: (-p.count(">"), p)) if fit else None


def fitting_paths(shares: dict[str, float], best: str | None) -> list[str]:
    """The paths that a page may be read by in place of its best one: those with LEAST_SHARE; if the best is an article or main element, only such ones."""
    return [p for p, x in shares.items() if x >= LEAST_SHARE and (best is None or not in_home(best) or in_home(p))]


def path_number(path: str) -> int:
    """64 bits that stand for a path."""
    return int.from_bytes(blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(blocks: list[Block], number: int | None) -> str:
    """The blocks inside the path with that number, else inside the page's best one, joined by line feeds.

    Around a container that is neither an article nor a main element, text that stands directly in one of the containers
    around it (the body left out) belongs to the article too, and so does a headline where the container has none of its own;
    texts that are mostly links don't.
    """
    path = None
    if number is not None:
        path = next((p for b in blocks for p in b.paths if path_number(p) == number), None)
    path = path or best_path(container_shares(blocks))
    if path is None:
        return "\n".join(b.text for b in blocks)
    if in_home(path):
        return "\n".join(b.text for b in blocks if path in b.paths)
    own = any(b.headline for b in blocks if path in b.paths)

    def around(b: Block) -> bool:
        near = bool(b.paths) and path.startswith(b.paths[-1] + ">") and not re.match(r"body(?:[.]|$)", b.paths[-1].rpartition(">")[2])
        return 2 * b.linked <= len(b.text) and (near or b.headline and not own)

    return "\n".join(b.text for b in blocks if path in b.paths or around(b))


def ballots(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(k1, k2, host, best, fit array<long>) of each page: 128 bits of its row's html, the path it votes for, the paths it could be read by."""

    @F.pandas_udf("best long, fit array<long>")
    def score(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            shares = container_shares(article_blocks(h or ""))
            best = best_path(shares)
            rows.append((None if best is None else path_number(best), [path_number(p) for p in fitting_paths(shares, best)]))
        return pd.DataFrame({"best": pd.array([r[0] for r in rows], dtype="Int64"), "fit": [r[1] for r in rows]})

    return pages.select(*_keys(html_col), page_host(F.col(url_col)).alias("host"), score(F.col(html_col)).alias("s")).select("k1", "k2", "host", "s.best", "s.fit")


def _keys(html_col: str) -> list:
    return [F.xxhash64(html_col).alias("k1"), F.xxhash64(F.lit("page"), html_col).alias("k2")]


def host_picks(cast: DataFrame) -> DataFrame:
    """(k1, k2, host, path long): the pages that another path than their own best one is better for: of those that fit the one with most of the host's votes.

    Votes are summed per host and path in the tasks before the shuffle, so a host with a third of all pages sends a few rows
    from each. A path with a single vote can't beat a page's own, so only paths with two are looked up; all of them are.
    """
    votes = materialize(cast.where("best IS NOT NULL").groupBy("host", F.col("best").alias("path")).agg(F.count("*").alias("votes")).where("votes > 1"))
    asked = cast.where("best IS NOT NULL").select("k1", "k2", "host", "best", F.explode(F.array_distinct(F.concat("fit", F.array("best")))).alias("path"))
    heard = asked.join(votes, ["host", "path"])
    top = heard.groupBy("k1", "k2", "host", "best").agg(F.max(F.struct("votes", F.expr("path = best").alias("own"), "path")).alias("top"))
    return top.where("top.path <> best").select("k1", "k2", "host", F.col("top.path").alias("path"))


@scoped
def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text (string), the main text of each page; other columns pass through.

    Each page votes for the path of its best container; a page is then read by the path of its host with most votes among
    those that hold at least LEAST_SHARE of its text, by its own best one if none has more; a page with an article or main
    element only by the path of such a one. A null or empty html gives an
    empty text. Pages without a host (null or odd URL) vote together. Each row is read by itself, repeated ids too; a very
    long page is parsed in one pass and held as blocks. A column of pages named text is replaced. An empty table gives an
    empty one. Only pages that leave their own best path are looked up, by the hash of their html.
    """
    pages = pages.drop("text")
    cast = materialize(ballots(pages, url_col, html_col))
    picks = materialize(host_picks(cast)).withColumnsRenamed({"k1": "__1", "k2": "__2", "host": "__host", "path": "__path"}).dropDuplicates(["__1", "__2", "__host"])

    @F.pandas_udf("string")
    def read(html: pd.Series, path: pd.Series) -> pd.Series:
        numbers = [None if n is None else int(n) for n in path]
        return pd.Series([main_text(article_blocks(h), n) if h else "" for h, n in zip(html, numbers, strict=True)], dtype=object)

    k1, k2 = _keys(html_col)
    on = (k1 == F.col("__1")) & (k2 == F.col("__2")) & (page_host(F.col(url_col)) == F.col("__host"))
    # the number goes as a string: a column of numbers and nulls would become one of floats
    return pages.join(picks, on, "left").select(*pages.columns, read(F.col(html_col), F.col("__path").cast("string")).alias("text"))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op3_html_text": op3_html_text}
