"""Addresses in web archives, names of stored files, and what a transfer keeps."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.urls import host, matches_any

# Fixed values.
INDEX = "https://web.archive.org/cdx/search/cdx"
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff")
UNSAFE_IN_NAMES = '<>:"\\|?*%'
MEDIA_FOLDERS = ("images", "videos", "video", "img")


def _host_and_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")


def _quoted(value: Column) -> Column:
    """Percent-encoded, but for colons, slashes, commas and what is encoded already."""
    out = F.url_encode(value)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":"), ("%2F", "/"), ("%2C", ","), ("%25", "%")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def index_query(url: Column, prefix: bool = False, limit: int = 200) -> Column:
    """The archive index's address for the captures of a URL, or of all URLs below it."""
    tail = f"&output=json&fl=timestamp,original,statuscode,mimetype,digest&filter=statuscode:200&collapse=digest&limit={limit}" + "&matchType=prefix" * prefix
    return F.concat(F.lit(f"{INDEX}?url="), _quoted(_host_and_path(url)), F.lit(tail))


def parse_index(body: Column) -> Column:
    """An index's answer, a JSON array whose first row names the fields, as an array of maps."""
    rows = F.from_json(body, "array<array<string>>")
    return F.when(F.size(rows) > 0, F.transform(F.slice(rows, 2, F.size(rows)), lambda r: F.map_from_arrays(rows[0], r))).otherwise(F.array().cast("array<map<string,string>>"))


def snapshot_url(timestamp: Column, original: Column) -> Column:
    """The address of a capture's own bytes."""
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit("id_/"), original)


def raw_snapshot(url: Column) -> Column:
    """A replay address rewritten to ask for the original bytes; others as they are."""
    return F.regexp_replace(url, r"^(https?://web\.archive\.org/web/\d{14})(?:[a-z_]{2,3})?/(.+)$", "$1id_/$2")


def media_equivalent(url: Column) -> Column:
    """The media host's address of a file behind the image network of the same publisher, or null."""
    path = F.regexp_extract(url, r"(?i)^https?://www\.snopes\.com/tachyon/(\d{4}/\d{2}/[^/?#]+)(?:[?#].*)?$", 1)
    return F.when(path != "", F.concat(F.lit("https://media.snopes.com/"), path))


def proxied_url(url: Column) -> Column:
    """The address that a resizing proxy wraps, or null."""
    return F.nullif(F.regexp_extract(url, r"^https?://mediaproxy\.snopes\.com/width/\d+/(https?://.+)$", 1), F.lit(""))


def directory_key(url: Column, hosts: tuple[str, ...]) -> Column:
    """Host and folder of URLs that are looked up folder by folder: of these hosts, and deep enough; else null."""
    path = F.regexp_extract(_host_and_path(url), r"^[^/]*(/.*)$", 1)
    return F.when(host(url).isin(*hosts) & (F.size(F.split(path, "/")) >= 4), F.concat(host(url), F.regexp_replace(path, "[^/]*$", "")))


def file_name(key: Column, url: Column) -> Column:
    """A safe name: letters, digits, hyphens and underscores, and the URL's image suffix or .jpg."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(url, r"\?.*$", ""), r"[^/.](\.[^./]+)$", 1))
    return F.concat(F.regexp_replace(key, r"[^\p{L}\p{N}_-]", "_"), F.when(suffix.isin(*IMAGE_SUFFIXES), suffix).otherwise(".jpg"))


def portable_name(part: Column) -> Column:
    """What some file systems refuse, percent-encoded; percent-decoding inverts it."""
    out = F.replace(part, F.lit("%"), F.lit("%25"))
    for c in [*UNSAFE_IN_NAMES.replace("%", ""), *map(chr, range(32))]:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.regexp_replace(F.regexp_replace(out, r"\.\z", "%2E"), r" \z", "%20")


def kept_member(name: Column, size: Column, keep: list[str], small: int) -> Column:
    """Whether a streamed archive's member is stored: listed, or small and outside media folders."""
    listed = matches_any(name, keep) if keep else F.lit(False)
    return listed | ((size <= small) & ~F.arrays_overlap(F.split(name, "/"), F.array(*map(F.lit, MEDIA_FOLDERS))))


def scope_fingerprint(entry: dict) -> str:
    """A digest of what decides which files a source's fetch retrieves."""
    scope = {"include": sorted(entry.get("include_patterns") or []), "forbidden": sorted(entry.get("forbidden_patterns") or [])}
    scope |= {k: entry.get(k) for k in ("method", "url", "aux_url")}
    return hashlib.sha256(json.dumps(scope, sort_keys=True).encode()).hexdigest()[:16]


def redirected_to_removed(chain: Column, pattern: str = r"(?i)removed\.(png|gif|jpe?g)") -> Column:
    """Whether any address of a redirect chain is a host's notice of removal."""
    return F.exists(chain, lambda u: F.coalesce(u.rlike(pattern), F.lit(False)))
