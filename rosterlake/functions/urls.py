"""URL, name and identity scalars."""

from pyspark.sql import Column, functions as F

from ..rules import vocab
from . import regex
from .text import or_empty, trim_blank


def storage_url(url: Column) -> Column:
    """Trim, drop one trailing slash, then ``.git``.  Case and scheme stay."""
    return F.regexp_replace(F.regexp_replace(trim_blank(url), r"/\z", ""), r"\.git\z", "")


def identity_url(url: Column) -> Column:
    """Form used for identity: lower case, no scheme, no slash, no ``.git``."""
    bare = F.regexp_replace(F.lower(trim_blank(url)), r"^(https://)?(http://)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/\z", ""), r"\.git\z", "")


def _segments(url: Column, drop_ssh=False) -> Column:
    prefix = r"^(https://)?(http://)?(ssh://git@)?" if drop_ssh else r"^(https://)?(http://)?"
    return F.split(F.regexp_replace(or_empty(url), prefix, ""), "/", -1)


def host(url: Column) -> Column:
    return F.get(_segments(url, drop_ssh=True), F.lit(0))


def owner(url: Column) -> Column:
    """Second segment, only when the URL has at least three."""
    parts = _segments(url)
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(or_empty(url), r"/\z", ""), "/", -1), -1)


def default_name(name: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), last_segment(url))


def slug(name: Column) -> Column:
    """ASCII slug; characters without an ASCII form are dropped."""
    dashed = F.translate(F.lower(name), " _.", "---")
    return F.trim(F.regexp_replace(dashed, "[^a-z0-9-]", ""), F.lit("-"))


def repo_path(url: Column) -> Column:
    """``owner/repo`` after the last ``github.com/``; '' when there is none."""
    clean = F.regexp_replace(F.regexp_replace(or_empty(url), r"\.git\z", ""), r"/\z", "")
    return F.regexp_extract(clean, r"(?s)^.*github\.com/([^/]+/[^/]+)", 1)


def page_slug(url: Column, marker="/servers/") -> Column:
    """First path segment after ``marker``; query and fragment ignored."""
    path = F.regexp_replace(or_empty(url), r"(?s)[?#].*\z", "")
    esc = regex.jvm("".join("\\" + c if not c.isalnum() else c for c in marker))
    return F.regexp_extract(path, f"{esc}/*([^/]+)", 1)


def storage_id(url: Column) -> Column:
    return F.sha2(storage_url(or_empty(url)), 256)


def short_id(url: Column) -> Column:
    return F.left(F.sha2(or_empty(url), 256), F.lit(16))


def canonical_id(name, repo_url, repo_owner, endpoint_urls, tool_names) -> Column:
    """Identity cascade: repository URL, name, sorted fingerprints, name+owner."""
    repo = identity_url(or_empty(repo_url))
    nm, own = or_empty(name), or_empty(repo_owner)
    prints = F.concat(
        F.transform(F.filter(F.coalesce(endpoint_urls, F.array().cast("array<string>")),
                             lambda u: u != ""), identity_url),
        F.coalesce(tool_names, F.array().cast("array<string>")))
    joined = F.array_join(F.concat(F.array(nm, own), F.array_sort(prints)), "|")
    return F.sha2(
        F.when(repo != "", repo).when(nm != "", nm)
         .when(F.size(prints) > 0, joined).otherwise(F.concat(nm, own)), 256)


_TOKEN_BLANKS = r"\s\u0085 "


def token_urls(text: Column) -> Column:
    """URLs that are whole whitespace-separated tokens; closing marks trimmed."""
    token = fr"(?=[hsw])(?<![^{_TOKEN_BLANKS}])(?:https?|sse|wss)://[^{_TOKEN_BLANKS}]*"
    # most texts name no URL at all
    named = F.contains(text, F.lit("://")) & regex.contains_any(text, ("http://", "https://", "sse://", "wss://"))
    found = F.when(named, F.regexp_extract_all(text, F.lit(token), F.lit(0))) \
             .when(text.isNotNull(), F.array().cast("array<string>"))
    return F.transform(found, lambda w: F.rtrim(w, F.lit(")\"'<,")))


def embedded_urls(text: Column) -> Column:
    """URLs anywhere in running text; trailing punctuation trimmed."""
    found = F.regexp_extract_all(
        text, F.lit(r"""https?://[^\t\n\f\r <>"{}|\\^`\[\]]+"""), F.lit(0))
    return F.transform(found, lambda u: F.rtrim(u, F.lit(".,;:)]}>")))


def is_protocol_endpoint(url: Column, marks=("sse", "mcp", "tool/")) -> Column:
    return regex.contains_any(url, marks)


def url_transport(url: Column) -> Column:
    return (F.when(F.startswith(url, F.lit("sse://")), "sse")
             .when(F.startswith(url, F.lit("wss://")), "websocket")
             .when(url.rlike("^https?://"),
                   F.when(F.contains(url, F.lit("sse")), "sse").otherwise("http"))
             .otherwise("stdio"))


def is_tls(url: Column) -> Column:
    return url.rlike("^(https|wss)://")


def is_streaming_transport(transport: Column) -> Column:
    return F.lower(transport).isin("sse", "streamable-http")


def readme_endpoints(text: Column, marks=("sse", "mcp", "tool/")) -> Column:
    """array<struct<url, transport, tls>> of protocol endpoints in a readme."""
    urls = F.filter(token_urls(text), lambda u: is_protocol_endpoint(u, marks))
    return F.transform(urls, lambda u: F.struct(
        u.alias("url"), url_transport(u).alias("transport"), is_tls(u).alias("tls")))


def endpoint_transports(endpoints: Column, manifest_transport: Column = None) -> Column:
    """Distinct transports in first-seen order, the manifest's own last."""
    listed = F.transform(endpoints, lambda e: e["transport"])
    if manifest_transport is not None:
        listed = F.concat(listed, F.array_compact(F.array(F.nullif(manifest_transport, F.lit("")))))
    return F.array_distinct(listed)


def readme_transports(readme: Column) -> Column:
    low = F.lower(or_empty(readme))
    found = F.array_compact(F.array(
        F.when(F.contains(low, F.lit("stdio")), "stdio"),
        F.when(F.contains(low, F.lit("http")), "http"),
        F.when(regex.contains_any(low, ("websocket", "ws://")), "websocket")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("stdio")))


def labelled_endpoint(readme: Column) -> Column:
    """URL after the first ``Endpoint:`` label that is followed by one."""
    return F.regexp_extract(
        or_empty(readme), r"[Ee]ndpoint:[ \t\r\f\x0b]*(http[^ \t\r\n]*)", 1)


def source_trust(source: Column, trust=vocab.SOURCE_TRUST, default=vocab.DEFAULT_TRUST) -> Column:
    table = F.create_map(*[F.lit(x) for kv in trust.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.lit(default))


def link_or_fallback(repo_url: Column, endpoints: Column) -> Column:
    """Repository URL, else the first repository-typed endpoint, else '#'."""
    typed = F.filter(endpoints, lambda e: e["type"] == "REPOSITORY_URL")
    return F.coalesce(F.nullif(repo_url, F.lit("")), F.get(typed, F.lit(0))["url"], F.lit("#"))
