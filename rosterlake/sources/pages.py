"""HTML page extraction in Arrow batches, standard-library parser only."""

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2",
             "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class _Page(HTMLParser):
    """Collects links, meta descriptions and the first paragraphs of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.meta, self.stack = [], {}, []
        self.paragraph = {"article": None, "main": None, "": None}
        self.open, self.scopes = None, ()

    def _end_paragraph(self):
        if self.open is not None:
            text = "".join(self.open).strip()
            for scope in self.scopes:
                self.paragraph[scope] = text
            self.open = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in _CLOSES_P and self.open is not None:
            self._end_paragraph()
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"])
        elif tag == "meta":
            self.meta.setdefault(attrs.get("name") or attrs.get("property") or "", attrs.get("content") or "")
        elif tag == "p":
            inside = ["article" in self.stack and "article", "main" in self.stack and "main", ""]
            self.scopes = tuple(s for s in inside if s is not False and self.paragraph[s] is None)
            self.open = [] if self.scopes else None
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "p" or (tag in _CLOSES_P and self.open is not None):
            self._end_paragraph()
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if self.open is not None and not {"script", "style"} & set(self.stack[-1:]):
            self.open.append(data)

    def close(self):
        super().close()
        self._end_paragraph()


_REPO = re.compile(r"^(https?)://github\.com/([^/?#]+)/([^/?#]+)")


def _links(links, own_host):
    for scheme in ("https", "http"):
        for href in links:
            m = _REPO.match(href)
            if m and m.group(1) == scheme:
                return f"https://github.com/{m.group(2)}/{m.group(3)}", ""
    for scheme in ("https://", "http://"):
        for href in links:
            off_site = own_host not in href and "github.com" not in href
            if href.startswith(scheme) and off_site and urlsplit(href).netloc:
                return "", href
    return "", ""


def _read(html: str, own_host: str):
    page = _Page()
    page.feed(html or "")
    page.close()
    repo, homepage = _links(page.links, own_host)
    meta = (page.meta.get("description") or "").strip() or (page.meta.get("og:description") or "").strip()
    para = page.paragraph["article"] or page.paragraph["main"] or page.paragraph[""] or ""
    return repo, homepage, meta, para, "\n\n".join(x for x in (meta, para) if x)


def extract(pages: DataFrame, key="page_id", html="html", own_host="mcpservers.org") -> DataFrame:
    """(key, repo_url, homepage, meta_description, first_paragraph, readme).

    One batch at a time and nothing kept between pages; select and filter pages
    before this step, since filters do not move below it.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = [_read(h, own_host) for h in pdf[html]]
            out = pd.DataFrame(rows, columns=["repo_url", "homepage", "meta_description",
                                              "first_paragraph", "readme"])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return pages.select(key, html).mapInPandas(
        run, f"{key} {kind}, repo_url string, homepage string, meta_description string, "
             "first_paragraph string, readme string")
