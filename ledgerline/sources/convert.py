"""Documents to episodes: Markdown, HTML and EPUB (PDF where an extractor is at hand)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import date
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIER = 3
#: Blocks that end a paragraph, what is skipped, and headings that name a section's kind.
BLOCKS = {"p", "div", "section", "article", "aside", "header", "footer", "main", "nav", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "figure", "figcaption", "dl", "dt", "dd", "address", "form", "fieldset", "body", "hr", "br"}
SKIPPED = {"script", "style", "pre", "head", "template", "noscript"}
KINDS = {"praise": "praise", "copyright": "copyright", "acknowledg": "acknowledgments"}
EPISODE = "id string, text string, locator struct<kind:string,value:string>, source_type string, data_cutoff string, authority_tier smallint, tags array<string>"


def tidy(text: str) -> str:
    """Control characters dropped, white space collapsed."""
    return " ".join("".join(c if c.isspace() or c >= " " and not "\x7f" <= c <= "\x9f" else "" for c in text).split())


def slug(text: str) -> str:
    s = re.sub("[^a-z0-9]+", "-", tidy(text).lower()).strip("-")
    return s or ("untitled" if not tidy(text) else "section")


def section_tags(heading: str) -> list[str]:
    low = heading.lower()
    return [f"section-kind:{v}" for k, v in KINDS.items() if k in low]


class Ids:
    """slug, slug-2, ...: a slug is used up even if its segment is empty."""

    def __init__(self) -> None:
        self.issued: set[str] = set()

    def take(self, base: str) -> str:
        k, own = 1, base
        while own in self.issued:
            k += 1
            own = f"{base}-{k}"
        self.issued.add(own)
        return own


def episodes(segments: list[tuple[str | None, list[str]]], kind: str, prefix: str = "", cutoff: str | None = None) -> list[dict]:
    """Segments (heading or None, paragraphs) -> episodes."""
    ids, out = Ids(), []
    for heading, paragraphs in segments:
        own = ids.take(slug(heading) if heading is not None else "intro")
        text = "\n\n".join(p for p in map(tidy, paragraphs) if p)
        if text:
            locator = {"kind": "absent", "value": None} if heading is None else {"kind": "span", "value": f"heading:{tidy(heading)}"}
            out.append({"id": f"{prefix}{own}", "text": text, "locator": locator, "source_type": kind, "data_cutoff": cutoff, "authority_tier": TIER, "tags": section_tags(heading or "")})
    return out


def markdown(text: str, prefix: str = "") -> list[dict]:
    segments: list[tuple[str | None, list[str]]] = [(None, [])]
    para: list[str] = []
    fence = None

    def close() -> None:
        if para:
            segments[-1][1].append(" ".join(para))
            para.clear()

    lines = text.split("\n")
    for k, raw in enumerate(lines):
        line = raw.rstrip()
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark[1].startswith(fence):
                fence = None
            continue
        if mark:
            close()
            fence = mark[1]
        elif m := re.match(r" {0,3}#{1,6}(?:\s+(.*?))?(?:\s+#+)?\s*$", line):
            close()
            segments.append((re.sub(r"[*_`]", "", m[1] or ""), []))
        elif para and re.match(r" {0,3}(=+|-+)\s*$", line):
            heading = " ".join(para)
            para.clear()
            segments.append((heading, []))
        elif re.match(r" {0,3}([-*_])(\s*\1){2,}\s*$", line):
            close()
            segments.append((segments[-1][0], []))
        elif not line.strip() or re.match(r" {4}|\t", raw) and not para:
            close()
        else:
            item = re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line)
            if item:
                close()
            plain = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", item[1] if item else line.lstrip("> "))
            para.append(re.sub(r"(\*\*|__|\*|`)(.+?)\1", r"\2", plain.strip()))
    close()
    return episodes(segments, "markdown", prefix)


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.segments: list[tuple[str | None, list[str]]] = [(None, [])]
        self.text: list[str] = []
        self.skip, self.heading = [], None

    def flush(self) -> None:
        own = tidy("".join(self.text))
        self.text = []
        if own and self.heading is None:
            self.segments[-1][1].append(own)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip.append(tag)
        elif not self.skip:
            if re.fullmatch("h[1-6]", tag):
                self.flush()
                self.heading = tag
            elif tag in BLOCKS:
                self.flush() if self.heading is None else self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
        elif tag == self.heading:
            own = tidy("".join(self.text))
            self.text, self.heading = [], None
            self.segments.append((own, []))
        elif tag in BLOCKS:
            self.flush() if self.heading is None else self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def html_segments(text: str) -> list[tuple[str | None, list[str]]]:
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    return p.segments


def html(text: str, prefix: str = "") -> list[dict]:
    return episodes(html_segments(text), "html", prefix)


def epub(data: bytes, prefix: str = "") -> list[dict]:
    """One episode for each spine document: the label of the contents, else its first heading, else chapter-NNN."""
    z = zipfile.ZipFile(io.BytesIO(data))
    local = lambda e: e.tag.rpartition("}")[2]
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in box.iter() if local(e) == "rootfile")
    base = opf.rpartition("/")[0]
    at = lambda href: f"{base}/{href}" if base else href
    root = ElementTree.fromstring(z.read(opf))
    items = {e.get("id"): (e.get("href"), e.get("properties") or "", e.get("media-type") or "") for e in root.iter() if local(e) == "item"}
    cutoff = None
    for e in root.iter():
        if local(e) == "date" and e.text and re.match(r"\d{4}-\d{2}-\d{2}", e.text.strip()):
            try:
                cutoff = date.fromisoformat(e.text.strip()[:10]).isoformat()
            except ValueError:
                continue
            break
    labels: dict[str, str] = {}
    for href, props, media in items.values():
        if "nav" in props.split():
            for m in re.finditer(r'<a[^>]*href="([^"#]*)[^"]*"[^>]*>(.*?)</a>', z.read(at(href)).decode("utf-8", "replace"), re.S):
                labels.setdefault(m[1], tidy(re.sub("<[^>]*>", "", m[2])))
        elif media == "application/x-dtbncx+xml":
            ncx = ElementTree.fromstring(z.read(at(href)))
            for p in (e for e in ncx.iter() if local(e) == "navPoint"):
                src = next((e.get("src") for e in p.iter() if local(e) == "content"), "")
                label = next((e.text for e in p.iter() if local(e) == "text"), "") or ""
                labels.setdefault(src.partition("#")[0], tidy(label))
    segments = []
    for k, ref in enumerate((e.get("idref") for e in root.iter() if local(e) == "itemref"), 1):
        href = items[ref][0]
        own = html_segments(z.read(at(href)).decode("utf-8", "replace"))
        heading = labels.get(href) or next((h for h, _ in own if h), None) or f"chapter-{k:03d}"
        segments.append((heading, [p for h, ps in own for p in ([h] if h and h != heading else []) + ps]))
    return episodes(segments, "epub", prefix, cutoff)


def pdf(data: bytes, pages_of: Callable[[bytes], list[str]], prefix: str = "") -> list[dict]:
    """One episode a page (page-NNN, locator page:N). The text extractor is given, as none is installed here; a document without any text is an error."""
    own = [(k, tidy(t)) for k, t in enumerate(pages_of(data), 1)]
    if not any(t for _, t in own):
        raise ValueError("no page has text")
    return [{"id": f"{prefix}page-{k:03d}", "text": t, "locator": {"kind": "span", "value": f"page:{k}"}, "source_type": "pdf", "data_cutoff": None, "authority_tier": TIER, "tags": []} for k, t in own if t]


def converted(rows: DataFrame, key: str, content: str, convert: Callable[..., list[dict]]) -> DataFrame:
    """A column of documents as episodes, each id led by the row's key; documents are converted one by one in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("id", pa.string()), ("text", pa.string()), ("locator", pa.struct([("kind", pa.string()), ("value", pa.string())])), ("source_type", pa.string()), ("data_cutoff", pa.string()), ("authority_tier", pa.int16()), ("tags", pa.list_(pa.string()))])
        for batch in batches:
            for s in range(0, len(batch), 256):
                part = batch.slice(s, 256)
                out = [e for k, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if c is not None for e in convert(c, f"{k}/")]
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.select(F.col(key).cast("string"), content).mapInArrow(run, EPISODE)


def read_json_stream(spark, path: str) -> DataFrame:
    """A JSON array of episode records; a record that does not decode, or lacks a required field, refuses the whole stream."""
    s = "id string, text string, locator struct<kind:string,value:string>, source struct<source_type:string,data_cutoff:string,authority_tier:int,tags:array<string>>"
    df = spark.read.schema(s).option("multiLine", True).option("mode", "FAILFAST").json(path)
    need = ["id", "text", "locator.kind", "source.source_type", "source.authority_tier", "source.tags"]
    bad = " OR ".join(f"{c} IS NULL" for c in need) + " OR source.authority_tier NOT BETWEEN 0 AND 255 OR locator.kind NOT IN ('span', 'absent') OR (locator.kind = 'span' AND locator.value IS NULL)"
    checked = df.withColumn("id", F.when(F.expr(bad), F.raise_error(F.lit("malformed_stream"))).otherwise(F.col("id")))
    return checked.select("id", "text", "locator", "source.source_type", "source.data_cutoff", F.col("source.authority_tier").cast("smallint").alias("authority_tier"), "source.tags")
