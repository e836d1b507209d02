"""Main text of web pages: what a host's sorted suffixes do not show to be repeated, checked against the markup."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import map_slices, release_memory, row_id
from folioweave.session import carried, stage_table

#: Tokens of a string that counts as boilerplate if it is on two pages of a host.
LONG = 8

#: What the markup says of a word: page furniture, nothing, inside an article.
FURNITURE, OPEN, ARTICLE = range(3)

# Element names of HTML and words that name page furniture.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas", "object"}
_FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", *_RAW}
_MAIN = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
_SELF_CLOSING = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
_NAMES = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "cookie", "cookies", "consent", "disclaimer", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "reply", "replies", "respond", "search", "share",
    "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def is_furniture(name: str, attributes: str, inside_main: bool) -> bool:
    """Whether an element is page furniture by its name, role, class or id."""
    if name in _FURNITURE or (name == "header" and not inside_main):
        return True
    if not attributes or name in ("html", "body", *_MAIN):
        return False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in _ROLES:
            return True
        if key in ("class", "id") and not _NAMES.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
    return False


def page_blocks(page: str | None) -> tuple[list[str], list[int]]:
    """Words of a page in order, and what the markup says of each.

    Open elements are tracked by name, so unclosed tags do no harm beyond their
    parent's end.
    """
    stream: list[str] = []
    kinds: list[int] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, main
    block: list[str] = []
    hidden = mains = 0

    def end_block():
        words = html.unescape("".join(block)).split()
        block.clear()
        if not words:
            return
        stream.extend(words)
        kinds.extend([FURNITURE if hidden else ARTICLE if mains else OPEN] * len(words))

    def close(upto: int):
        nonlocal hidden, mains
        for _, furniture, main in stack[upto:]:
            hidden -= furniture
            mains -= main
        del stack[upto:]

    text, at = page or "", 0
    while found := _TOKEN.search(text, at):
        if found.start() > at:
            block.append(text[at : found.start()])
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            end_block()
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                if any(f or m for _, f, m in stack[depth:]):
                    end_block()
                close(depth)
            continue
        if name in _VOID or found[3].endswith("/"):
            continue
        if name in _SELF_CLOSING and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        if name in _RAW:  # up to its end tag there is no markup
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        furniture, main = is_furniture(name, found[3], mains > 0), name in _MAIN
        if furniture or main:
            end_block()
        stack.append((name, furniture, main))
        hidden += furniture
        mains += main
    block.append(text[at:])
    end_block()
    return stream, kinds


def candidates(stream: list[str], kinds: list[int], long: int) -> tuple[str, int, list[str], list[int]]:
    """Text and words of the article; the words that the host's suffixes judge, and their kinds if any of them is in doubt.

    An article can only lose against ``long`` words or more outside it, and more than
    its own.  Where there are not so many, repeated or not, it stands: its words are
    not judged, they and what its page has besides only show what the host repeats
    (see ``shared_by_articles``).
    """
    article = [w for w, k in zip(stream, kinds) if k == ARTICLE]
    outside = kinds.count(OPEN)
    if article and (outside < long or outside <= len(article)):
        return " ".join(article), len(article), [w for w, k in zip(stream, kinds) if k != ARTICLE], []
    return " ".join(article), len(article), stream, kinds if outside else []


def changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    out = np.ones(len(column), bool)
    out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


_FOUND = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("host", pa.string()), ("gram", pa.string()), ("lo", pa.binary()), ("hi", pa.binary())])


def neighbours(batches):
    """Suffixes in doubt that share their first tokens with a neighbour of another page, from a sorted partition.

    The columns are host, gram, page, row, at, asks, sorted by the first three, so
    suffixes that agree stand together and a change of page among them decides.
    What a partition cannot decide alone are its first and last group: their least
    and greatest page come as a row without ``row``, and their undecided suffixes (of
    one page) with host and gram.  Only the open group is carried between batches.
    """
    out: dict[str, list] = {name: [] for name in _FOUND.names}
    group = None  # the open group: host, gram, least page, greatest page, whether the partition starts with it
    waiting: tuple[list, list] = ([], [])  # its suffixes in doubt while it has one page

    def emit(rows, ats, host=None, gram=None, lo=None, hi=None):
        for name, values in (("row", rows), ("at", ats)):
            out[name].extend(values)
        for name, value in (("host", host), ("gram", gram), ("lo", lo), ("hi", hi)):
            out[name].extend([value] * len(rows))

    def flush():
        made = pa.RecordBatch.from_pydict(out, schema=_FOUND)
        for values in out.values():
            values.clear()
        return made

    def close(edge):
        host, gram, lo, hi, _ = group
        if edge:
            emit([None], [None], host, gram, lo, hi)
            if lo == hi:
                emit(*waiting, host, gram)

    for batch in batches:
        if not batch.num_rows:
            continue
        host, gram, page = batch.column(0), batch.column(1), batch.column(2)
        row, at, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        new = changes(host) | changes(gram)
        turn = changes(page) & ~new
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(row))
        several = np.logical_or.reduceat(turn, starts)
        # whole groups: all but the first, which may go on from the batch before, and the last, which may go on
        inner = np.zeros(len(row), bool)
        if len(starts) > 2:
            inner[starts[1] : starts[-1]] = np.repeat(several[1:-1], (ends - starts)[1:-1]) & asks[starts[1] : starts[-1]]
        emit(row[inner].tolist(), at[inner].tolist())
        for i in sorted({0, len(starts) - 1}):
            start, end = starts[i], ends[i]
            key, last = (host[start].as_py(), gram[start].as_py()), page[end - 1].as_py()
            if group is None or group[:2] != key:
                begins = group is None
                if not begins:
                    close(group[4])
                waiting[0].clear()
                waiting[1].clear()
                group = (*key, page[start].as_py(), last, begins)
            else:
                group = (*group[:3], last, group[4])
            asked = start + np.flatnonzero(asks[start:end])
            waiting[0].extend(row[asked].tolist())
            waiting[1].extend(at[asked].tolist())
            if group[2] != group[3]:
                emit(*waiting)
                waiting[0].clear()
                waiting[1].clear()
        yield flush()
    if group is not None:
        close(True)
        yield flush()
    release_memory()


def grams(words: Column, long: int) -> Column:
    """Place, from 1, and string of each ``long`` neighbouring words, as an array."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (long - 1)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i, long), " ").alias("gram")))


def shared_by_articles(keyed: DataFrame, long: int) -> DataFrame:
    """``(host, page, gram)``: strings of ``long`` words that two different articles of a host have, where it has pages in doubt.

    One article alone shows nothing: a page that repeats it may be its print version.
    Copies of an article on its host are one.  The rows name two of the articles, as a
    page may equal one.
    """
    hosts = carried(keyed.where(F.size("kinds") > 0).select("host").distinct())
    articles = keyed.where(F.size("kinds") == 0).select("host", F.unhex(F.md5("text")).alias("page"), F.split("text", " ").alias("own"))
    own = articles.join(hosts, "host", "left_semi").where(F.size("own") >= long).select("host", "page", F.explode(grams(F.col("own"), long).getField("gram")).alias("gram"))
    return own.groupBy("host", "gram").agg(F.min("page").alias("page"), F.max("page").alias("other")).where("page < other").select(
        "host", F.explode(F.array("page", "other")).alias("page"), "gram"
    )


def repeated_places(suffixes: DataFrame) -> DataFrame:
    """``(row, at)`` of the suffixes in doubt whose first tokens another page of the host repeats.

    All suffixes are sorted by host, first tokens and page, over ranges that may cut
    a group of equal ones, so a frequent string is no burden to one task.  Neighbours
    that agree in ``long`` tokens are all that counts: a longer common prefix is
    covered by the suffixes that follow in it.
    """
    order = ["host", "gram", "page"]
    ranges = suffixes.select(*order, "row", "at", "asks").repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage_table(ranges.mapInArrow(neighbours, "row bigint, at int, host string, gram string, lo binary, hi binary"))
    edges = found.where("lo is not null").groupBy("host", "gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    undecided = found.where("row is not null and host is not null").join(F.broadcast(edges.select("host", "gram")), ["host", "gram"])
    return found.where("host is null").select("row", "at").union(undecided.select("row", "at"))


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", long: int = LONG
) -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` per page.

    The token streams of a host's pages are cut into suffixes and sorted.  Suffixes
    that agree in their first ``long`` tokens are neighbours, and where they come from
    two different streams or more those tokens are covered.  Copies of a page on its
    host are one stream, so they do not cover each other.  The markup is asked after
    that: furniture goes, covered or not, and a page with article or main elements
    gives their text, whole (what two articles share stays), unless the words outside
    that are neither furniture nor covered are ``long`` or more and outnumber it, as
    beside a teaser.  On such pages and on those without an article all words that are
    neither furniture nor covered are kept in page order.

    Words of an article are judged only where it can lose (see ``candidates``);
    elsewhere they do not ask, and they show what a host repeats where two different
    articles have it, so a plain print version of one article keeps its text.  Null html gives the empty text; a page whose url is
    null or names no host is a host of its own; repeated ids stay separate rows; an
    empty table gives no rows.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = (
        f"row bigint, id {types[id_col]}, url {types[url_col]}, host string, text string, inside int, "
        "words array<string>, kinds array<tinyint>"
    )

    def start():
        def step(piece):
            made = [candidates(*page_blocks(h), long) for h in piece.column(4).to_pylist()]
            return {
                "row": piece.column(0), "id": piece.column(1), "url": piece.column(2), "host": piece.column(3),
                **{name: [m[i] for m in made] for i, name in enumerate(("text", "inside", "words", "kinds"))},
            }

        return step

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    chosen = pages.select(row_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col))
    parsed = stage_table(map_slices(chosen, schema, start, rows=128))
    # one row for each different stream of a host; ``kinds`` are part of it, they may differ in equal words
    stream = F.sha2(F.concat_ws("\n", F.array_join("words", " "), F.to_json("kinds")), 256)
    keyed = parsed.withColumns({"host": F.when(F.col("host") == "", F.concat(F.lit("/"), F.col("row"))).otherwise(F.col("host")), "stream": stream})
    streams = keyed.where(F.size("words") >= long).groupBy("host", "stream").agg(F.min("row").alias("row"))
    page = F.unhex(F.md5(F.array_join("words", " "))).alias("page")
    suffixes = keyed.join(streams.select("row"), "row", "left_semi").select("row", "words", "host", page, (F.size("kinds") > 0).alias("asks")).select(
        "row", "host", "page", "asks",
        F.explode(grams(F.col("words"), long)).alias("s"),
    ).select("row", "host", "page", "asks", "s.at", "s.gram")
    shown = shared_by_articles(keyed, long).withColumns({"row": F.lit(0).cast("bigint"), "asks": F.lit(False), "at": F.lit(0)})
    suffixes = suffixes.unionByName(shown)
    places = F.sequence(F.lit(0), F.lit(long - 1))
    gone = F.array_distinct(F.flatten(F.transform("at", lambda a: F.transform(places, lambda d: a + d))))
    covered = (
        repeated_places(suffixes).groupBy("row").agg(F.collect_list("at").alias("at"))
        .join(streams, "row").select("host", "stream", gone.alias("gone"))
    )
    stays = F.array_except(F.sequence(F.lit(1), F.size("words")), F.coalesce("gone", F.array().cast("array<int>")))
    left = F.filter(
        F.transform(stays, lambda i: F.struct(F.get("words", i - 1).alias("word"), F.get("kinds", i - 1).alias("kind"))),
        lambda w: w.kind != FURNITURE,
    )
    outside = F.size(F.filter("left", lambda w: w.kind == OPEN))
    stands = (F.col("inside") > 0) & ((outside < long) | (outside <= F.col("inside")))
    judged = (
        keyed.where(F.size("kinds") > 0).join(covered, ["host", "stream"], "left").withColumn("left", left)
        .select("id", "url", F.when(stands, F.col("text")).otherwise(F.array_join("left.word", " ")).alias("text"))
    )
    # no word in doubt: nothing is left outside the article, or too little to outweigh it
    clear = parsed.where(F.size("kinds") == 0).select("id", "url", "text")
    return clear.union(judged).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
