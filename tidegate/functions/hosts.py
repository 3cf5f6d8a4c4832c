"""Where a response came from and what it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import fixed
from .text import _c, any_of, looks_like_html


def host_of(url) -> Column:
    """Lower-case host of an absolute address, without user, port or brackets; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once and its code there once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def split_host(host) -> Column:
    """struct of domain (registered), subdomain, tld; addresses and single labels stay whole."""

    def split(t: Column) -> Column:
        h, labels = t["h"], t["labels"]
        n = F.size(labels)
        tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), F.lit(k)), ".")
        shared = lambda k: (n > k) & tail(k).isin(*fixed.SHARED_HOSTING_SUFFIXES)
        own = F.when(shared(3), 4).when(shared(2), 3).when((n >= 3) & tail(2).isin(*fixed.TWO_LABEL_SUFFIXES), 3).otherwise(2)
        whole = (n == 1) | any_of(h, r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains(h, F.lit(":"))
        return _once(F.struct(own.alias("own"), whole.alias("whole")), lambda x: named(h, labels, n, x["own"], x["whole"]))

    def named(h: Column, labels: Column, n: Column, own: Column, whole: Column) -> Column:
        join = lambda a, k: F.array_join(F.slice(labels, a, k), ".")
        none = F.lit(None).cast("string")
        domain = F.when(h.isNull() | (h == ""), none).when(whole, F.regexp_replace(h, r"[\[\]]", "")).otherwise(join(F.greatest(F.lit(1), n - own + 1), own))
        sub = F.when(h.isNull() | (h == "") | whole | (n <= own), none).otherwise(join(F.lit(1), F.greatest(F.lit(0), n - own)))
        tld = F.when(h.isNull() | (h == "") | whole, none).otherwise(F.concat(F.lit("."), join(F.greatest(F.lit(1), n - own + 2), own - 1)))
        return F.struct(domain.alias("domain"), sub.alias("subdomain"), tld.alias("tld"))

    h = F.regexp_replace(F.lower(_c(host)), r"\.+$", "")
    return _once(F.struct(h.alias("h"), F.split(h, r"\.").alias("labels")), split)


def file_type(modality, path, content_type, raw) -> Column:
    """By modality, then extension, then content type or look, then the first character."""
    extension = F.lower(F.regexp_extract(_c(path), r"[^/.](\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in fixed.FILE_TYPES.items() for x in kv])
    kind = F.lower(F.coalesce(_c(content_type), F.lit("")))
    return (
        F.when(_c(modality) == "image", "IMAGE").when(_c(modality) == "pdf", "PDF").when(table[extension].isNotNull(), table[extension])
        .when(F.contains(kind, F.lit("html")) | looks_like_html(raw), "HTML").when(F.contains(kind, F.lit("json")) | F.coalesce(any_of(raw, r"^\s*[{\[]"), F.lit(False)), "JSON").otherwise("TEXT")
    )


def metadata(url, modality, tool, raw, content_type=None) -> Column:
    """struct of what is known about a response without reading it."""
    host = split_host(host_of(url))
    path = F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    scheme = F.nullif(F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit(""))
    text = F.coalesce(_c(raw), F.lit(""))
    return F.struct(
        _c(tool).alias("tool_name"), _c(modality).alias("modality"), _c(url).alias("full_url"), host["domain"].alias("domain"), host["subdomain"].alias("subdomain"), host["tld"].alias("tld"), (scheme == "https").alias("uses_https"),
        file_type(modality, path, F.lit(None).cast("string") if content_type is None else content_type, text).alias("file_type"),
        F.length(text).alias("content_length_chars"), F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).alias("content_length_words"), F.octet_length(text).alias("response_size_bytes"),
    )


def source_key(domain, tool) -> Column:
    """The identity that reputation belongs to."""
    return F.coalesce(_c(domain), F.concat(F.lit("tool:"), F.nullif(_c(tool), F.lit(""))), F.lit("unknown"))


def sniff(filename, data) -> Column:
    """pdf, image, docx, web or text, from a file's first bytes and name."""
    name = F.lower(F.coalesce(_c(filename), F.lit("")))
    head = F.hex(F.substring(_c(data), 1, 5))
    begin = F.decode(F.substring(_c(data), 1, 4000), "ISO-8859-1")
    magic = any_of(head, "^(89504E47|FFD8FF|47494638|52494646|424D)")
    page = any_of(begin, r"(?i)<\s*(?:!doctype\s+html|html|body|head|div|p|span|h[1-6])\b")
    ends = lambda x: any_of(name, rf"\.({x})$")
    return (
        F.when((head == "255044462D") | ends("pdf"), "pdf").when(magic | ends("png|jpg|jpeg|gif|webp|bmp"), "image")
        .when(ends("docx") | (F.startswith(head, F.lit("504B")) & F.contains(begin, F.lit("word/"))), "docx").when(ends("html|htm") | page, "web").otherwise("text")
    )
