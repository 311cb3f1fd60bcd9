"""Interleaved document sequences from HTML.

A page becomes an ordered sequence of text blocks and media references. A reference is named by a digest: SHA-256 of the bytes of an inline (data:)
payload, else of the absolute URL. Payloads are found by a join on the digest, references of one digest sharing one lookup, and
come back to their positions. Three arrays of equal length hold the result: position i is a text, or a reference with its caption.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .text import pieces

MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "", "embed": "embed", "object": "embed", "amp-img": "image"}
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements that are left out with all they hold, where they are closed; the first two to the page's end where they aren't.
_RAW = ("script", "style")
_DROPPED = (*_RAW, "template", "noscript", "head", "nav", "footer", "iframe", "svg")
_CLOSED = {t: re.compile(rf"</{t}\s*>", re.I) for t in _DROPPED}
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]")
_TO_END = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

ITEM = pa.struct([("kind", pa.string()), ("text", pa.string()), ("url", pa.string()), ("mime", pa.string()), ("digest", pa.string()), ("payload", pa.binary())])
_ITEM_SQL = "array<struct<kind:string,text:string,url:string,mime:string,digest:string,payload:binary>>"


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of the tags outside left-out elements; comments, declarations and left-out elements have no name.

    The page is gone through once: where the end of a tag or of an element was looked for in vain, it isn't looked for again.
    A ">" in quotes doesn't end a tag; from the first tag on of which a quote is never closed, quotes count for nothing.
    """
    at, last, quoted = 0, page.rfind(">"), True
    ends: dict[str, int] = {}  # of a left-out element: where its next closing tag begins; len(page) if there is none
    stops: dict[str, int] = {}
    while m := _OPEN.search(page, at):
        start, name = m.start(), (m[2] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        if m.end() > last:
            return
        if not name:
            at = page.find(">", m.end()) + 1
            yield start, at, "", "", ""
            continue
        tail = _TO_END.match(page, m.end()) if quoted else None
        if tail is None:
            quoted = False
        at = tail.end() if tail else page.find(">", m.end()) + 1
        inside = page[m.end() : at - 1]
        if name in _CLOSED and not m[1]:
            if ends.get(name, -1) < at and ends.get(name) != len(page):
                close = _CLOSED[name].search(page, at)
                ends[name], stops[name] = (close.start(), close.end()) if close else (len(page), len(page))
            if ends[name] < len(page) or name in _RAW:
                at = stops[name]
                yield start, at, "", "", ""
                continue
        yield start, at, m[1], name, inside


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _reference(tag: str, kind: str, attrs: dict[str, str], base: str) -> dict | None:
    src = (attrs.get("src") or attrs.get("data-src") or attrs.get("data") or attrs.get("srcset", "").strip().split(" ")[0]).strip()
    if not src:
        return None
    caption = (attrs.get("alt") or attrs.get("title") or "").strip() or None
    if src[:5].lower() == "data:":
        head, _, body = src[5:].partition(",")
        try:
            payload = base64.b64decode(re.sub(r"\s+", "", body), validate=True) if head.lower().endswith(";base64") else unquote_to_bytes(body)
        except ValueError:
            payload = None
        digest = hashlib.sha256(payload if payload is not None else src.encode()).hexdigest()
        return {"kind": kind, "text": caption, "url": None, "mime": head.split(";")[0].lower() or "text/plain", "digest": digest, "payload": payload}
    try:
        url = urljoin(base, src)
    except ValueError:
        url = src
    return {"kind": kind, "text": caption, "url": url, "mime": None, "digest": hashlib.sha256(url.encode("utf-8", "replace")).hexdigest(), "payload": None}


def parse(page: str | None, url: str | None = None) -> list[dict]:
    """The items of a page in order: {"kind": "text", "text": ...}, or a reference, whose `text` is its caption.

    Scripts, styles, the head, navigation, footers and comments are left out. Text ends at the boundaries of block elements and at media;
    white space is folded and entities are resolved. A figure's figcaption captions its media in place of their alt text; a figure
    without media keeps it as text. Sources inside video, audio or picture count only where the element itself has none.
    Tags may be unclosed or wrongly nested.
    """
    page = page or ""
    items: list[dict] = []
    buffer: list[str] = []
    figure: int | None = None
    caption: int | None = None
    within: str | None = None  # video, audio or picture
    found = False
    shown: list[dict] = []  # the figure's media before its open caption

    def flush() -> None:
        if buffer:
            if text := " ".join(entities.unescape("".join(buffer)).split()):
                items.append({"kind": "text", "text": text, "url": None, "mime": None, "digest": None, "payload": None})
            buffer.clear()

    def end_caption() -> None:
        nonlocal caption
        if caption is not None and figure is not None:
            flush()
            if shown:
                text = " ".join(x["text"] for x in items[caption:] if x["kind"] == "text")
                late = [x for x in items[caption:] if x["kind"] != "text"]
                del items[caption:]
                items.extend(late)
                for x in shown if text else ():
                    x["text"] = text
        caption = None

    def end_figure() -> None:
        nonlocal figure
        end_caption()
        flush()
        if figure is not None:
            own = items[figure:]
            media = [x for x in own if x["kind"] != "text"]
            if marks and media:
                places = {i for i in marks if i < len(own) and own[i]["kind"] == "text"}
                if joined := " ".join(own[i]["text"] for i in sorted(places)):
                    for x in media:
                        x["text"] = joined
                    items[figure:] = [x for i, x in enumerate(own) if i not in places]
        marks.clear()
        figure = None

    marks: list[int] = []
    at = 0
    for start, end, closing, tag, inside in _tags(page):
        if start > at:
            buffer.append(page[at:start])
        at = end
        if not tag:
            buffer.append(" ")
            continue
        if closing:
            if tag == "figcaption":
                flush()
                if caption is not None and figure is not None:
                    if shown:
                        end_caption()
                    else:
                        marks.extend(range(caption - figure, len(items) - figure))
                        caption = None
            elif tag == "figure":
                end_figure()
            elif tag == within:
                within = None
            elif tag in _BLOCK:
                flush()
            continue
        if tag in MEDIA:
            kind = MEDIA[tag]
            if tag == "source":
                if within is None or found:
                    continue
                kind = "image" if within == "picture" else within
            if tag == "img" and within == "picture" and found and items and items[-1]["kind"] == "image":
                items.pop()  # the picture's own image stands for its sources
                if shown and caption is None:
                    shown.pop()
            flush()
            if tag in ("video", "audio"):
                within, found = tag, False
            if ref := _reference(tag, kind, _attributes(inside), url or ""):
                items.append(ref)
                found = True
                if figure is not None and caption is None:
                    shown.append(ref)
        elif tag == "picture":
            within, found = "picture", False
        elif tag in _BLOCK:
            flush()
            if tag == "figure":
                end_figure()
                figure = len(items)
                shown = []
            elif tag == "figcaption" and figure is not None:
                caption = len(items)
    buffer.append(page[at:])
    if figure is not None:
        end_figure()
    flush()
    return items


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, items): `parse` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                items = [parse(h, u) for h, u in zip(part.column("html").to_pylist(), part.column("url").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(items, pa.list_(ITEM))], ["page_id", "url", "items"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, f"page_id long, url string, items {_ITEM_SQL}")


def interleave(pages: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(page_id, url, n_items, texts, media, captions): arrays of n_items; at each position a text, or a media reference.

    `media` is a table (digest, mime, payload) of known payloads; inline payloads of the pages themselves are always known. A reference
    whose digest is in neither has a null payload and resolved false, and keeps its position and caption. A digest listed
    more than once with different payloads takes the least one; null digests and payloads are no entry. A null or empty page has
    empty arrays. Null ids and repeated rows are pages of their own. Other columns are ignored; an empty table gives an empty result.

    Pages are parsed once. Only (row key, position, digest) of references meets the payloads; pages without references are in no join.
    """
    # a key of its own for each row, written down before anything is joined
    parsed = cut(parse_pages(pages).withColumn("row", F.monotonically_increasing_id()))
    has = F.exists("items", lambda i: i["kind"] != "text")
    blank = F.transform("items", lambda i: F.when(i["kind"] == "text", i["text"]))
    ref = lambda i, mime, payload: F.when(i["kind"] != "text", F.struct(i["kind"].alias("kind"), i["digest"].alias("digest"), i["url"].alias("url"), mime.alias("mime"), payload.alias("payload"), payload.isNotNull().alias("resolved")))
    none = F.lit(None)
    captions = F.transform("items", lambda i: F.when(i["kind"] != "text", i["text"]))
    plain = parsed.where(~has).select("page_id", "url", F.size("items").alias("n_items"), blank.alias("texts"), F.transform("items", lambda i: ref(i, none.cast("string"), none.cast("binary"))).alias("media"), captions.alias("captions"))
    some = parsed.where(has)
    item = some.select("row", F.posexplode("items").alias("at", "item")).where("item.kind != 'text'").select("row", "at", "item.digest", "item.mime", "item.payload")
    known = item.where("payload is not null").select("digest", "mime", "payload")
    if media is not None:
        known = known.unionByName(media.select(F.col("digest").cast("string").alias("digest"), F.col("mime").cast("string").alias("mime"), F.col("payload").cast("binary").alias("payload")).where("digest is not null and payload is not null"))
    known = known.groupBy("digest").agg(F.min(F.struct("payload", "mime")).alias("p"))
    found = item.select("row", "at", "digest").join(known, "digest", "left").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "p"))).alias("found")).withColumnRenamed("row", "r")
    linked = some.join(found, some["row"] == found["r"])
    joined = linked.select(
        "page_id",
        "url",
        F.size("items").alias("n_items"),
        blank.alias("texts"),
        F.transform("items", lambda i, k: ref(i, F.coalesce(F.col("found")[k]["mime"], i["mime"]), F.col("found")[k]["payload"])).alias("media"),
        captions.alias("captions"),
    )
    return plain.unionByName(joined)
