"""Content-addressed identity as Column expressions: canonical JSON, hashes, typed short ids, URLs, slugs, file names."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query keys that never decide a page's identity.
TRACKING_PARAMS = ("gclid", "fbclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid", "wbraid", "gbraid")
#: File stems that Windows refuses.
RESERVED_STEMS = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
#: Left as they are when other characters of a URL are percent-encoded.
SAFE = "%/?#[]@!$&'()*+,;=:~|^\\"
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def bare_hash(c: Column) -> Column:
    """A hash without its sha256: prefix, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)^sha256:", ""))


def short_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(sha256_hex(key), 1, 12))


def json_string(c: Column) -> Column:
    """A string as canonical JSON."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def json_strings(c: Column) -> Column:
    """An array of strings as canonical JSON."""
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def mint_rep_id(content: Column, prefix: str = "rep-") -> Column:
    return F.concat(F.lit(prefix), F.substring(sha256_hex(content), 1, 12))


def mint_src_id(canonical: Column, primary_sha256: Column) -> Column:
    by_bytes = F.concat(F.lit("src\nsha256:"), bare_hash(primary_sha256))
    return short_id("src-", F.when(F.coalesce(canonical, F.lit("")) != "", F.concat(F.lit("src\n"), canonical)).otherwise(by_bytes))


def char_range_json(rep: Column, start: Column, end: Column) -> Column:
    """The canonical JSON of a character-range locator's identity."""
    return F.concat(F.lit('{"representation_ref":'), json_string(rep), F.lit(',"type":"char_range","value":{"end":'), end.cast("string"), F.lit(',"start":'), start.cast("string"), F.lit("}}"))


def mint_ext_id(source: Column, rep: Column, locator_json: Column, quote: Column, text: Column | None = None) -> Column:
    q = F.coalesce(quote, text if text is not None else F.lit(None).cast("string"), F.lit(""))
    return short_id("ext-", F.concat_ws("\n", F.lit("ext"), source, rep, locator_json, q))


def collect_input_ids(*lists: Column) -> Column:
    """All lists' ids, sorted, repeats kept."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.flatten(F.array(*[F.coalesce(x, empty) for x in lists])))


def mint_gen_id(kind: Column, ids: Column, digest: Column) -> Column:
    return short_id("gen-", F.concat_ws("\n", F.lit("gen"), kind, json_strings(ids), F.coalesce(digest, F.lit(""))))


def mint_syn_id(kind: Column, question: Column, ids: Column) -> Column:
    return short_id("syn-", F.concat_ws("\n", F.lit("syn"), kind, F.coalesce(question, F.lit("")), json_strings(ids)))


def mint_cbk_id(namespace: Column, slug: Column) -> Column:
    return short_id("cbk-", F.concat_ws("\n", F.lit("cbk"), F.coalesce(namespace, F.lit("")), F.coalesce(slug, F.lit(""))))


def mint_cod_id(codebook: Column, kind: Column, target: Column, coder: Column, code: Column, value_json: Column | None = None) -> Column:
    """value_json: the canonical JSON of the value, taken where the code is null or empty."""
    value = value_json if value_json is not None else F.lit(None).cast("string")
    label = F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit('{"code":'), json_string(code), F.lit("}"))).otherwise(F.concat(F.lit('{"value":'), F.coalesce(value, F.lit("null")), F.lit("}")))
    return short_id("cod-", F.concat_ws("\n", F.lit("cod"), *[F.coalesce(x, F.lit("")) for x in (codebook, kind, target, coder)], label))


def input_digest(inputs: Column) -> Column:
    """inputs: array of (id, sha256). One input: its hash; more: the hash of their list by id."""
    marked = F.array_sort(F.transform(inputs, lambda x: F.struct(x["id"].alias("id"), F.concat(F.lit("sha256:"), bare_hash(x["sha256"])).alias("sha256"))))
    return F.when(F.size(marked) == 1, marked[0]["sha256"]).otherwise(F.concat(F.lit("sha256:"), sha256_hex(F.concat(F.lit('{"inputs":'), F.to_json(marked), F.lit("}")))))


def codebook_digest(codes_json: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha256_hex(F.coalesce(codes_json, F.lit("[]"))))


def _percent(c: Column) -> Column:
    """Escapes in upper case, those of unreserved characters undone: only pieces that start with an escape change."""
    parts = F.split(c, "(?=%[0-9A-Fa-f]{2})")
    plain = F.create_map(*[F.lit(x) for u in UNRESERVED for x in (f"%{ord(u):02X}", u)])

    def piece(x: Column) -> Column:
        head = F.upper(F.substring(x, 1, 3))
        return F.when(x.rlike("^%[0-9A-Fa-f]{2}"), F.concat(F.coalesce(F.try_element_at(plain, head), head), F.substring(x, 4, 1 << 20))).otherwise(x)

    return F.array_join(F.transform(parts, piece), "")


#: Schemes with a host of their own kind, and their default ports.
SPECIAL_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def _number(part: str) -> int | None:
    """A part of a host's number: decimal, 0x hexadecimal or 0 octal."""
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        return int(part, 8) if len(part) > 1 and part[0] == "0" else int(part)
    except ValueError:
        return None


def plain_host(host: str) -> str | None:
    """A host as browsers write it: punycode outside ASCII, IPv6 shortened, numbers as four decimal ones; null for hosts that have no such
    form."""
    if host.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(host[1:-1])}]" if host.endswith("]") else None
        except ValueError:
            return None
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    parts = host.removesuffix(".").split(".")
    if not parts[-1][:1].isdigit() or not (parts[-1].isdigit() or re.fullmatch("0[xX][0-9a-fA-F]*", parts[-1])):
        return host
    numbers = [_number(x) if x else None for x in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return None
    whole = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(whole))


@F.pandas_udf(StringType())
def plain_url(s: pd.Series) -> pd.Series:
    """URLs with their host as plain_host writes it, and other characters outside plain ASCII percent-encoded; null for hosts without a form."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        head, sep, rest = x.partition("://")
        if not sep:
            return quote(x, safe=SAFE)
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        user, at, host = rest[:end].rpartition("@")
        name, colon, port = host.rpartition(":") if re.search(r":\d*$", host) else (host, "", "")
        name = plain_host(name)
        return None if name is None else head + sep + user + at + name + colon + port + quote(rest[end:], safe=SAFE)

    return s.map(one)


#: URLs whose host the JVM can't write: it isn't plain ASCII, or a number, or an IPv6 address; or whose other parts need encoding.
UNUSUAL = "[^!-~]|//(?:[^/?#@]*@)?(?:\\[|(?:[^/?#:]*\\.)?(?:[0-9]+|0[xX][0-9a-fA-F]*)\\.?(?:[:/?#]|$))"


def _without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments resolved."""
    dot = lambda x, n: F.lower(F.regexp_replace(x, "(?i)%2e", ".")) == "." * n
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(parts, -1)
    parts = F.when(dot(last, 1) | dot(last, 2), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, x: F.when(dot(x, 1), acc).when(dot(x, 2), F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x))))
    return F.when(path.rlike("(?i)/(?:\\.|%2e)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def canonical_url(raw: Column, ascii_only: bool = False) -> Column:
    """A URL's one spelling: scheme and host in lower case (punycode outside ASCII), no default port, fragment or tracking keys, dot
    segments resolved, unreserved escapes undone, no final slashes, query tokens sorted. URLs of other schemes keep their host and path;
    null if there is no scheme, or no host where the scheme needs one. ascii_only: URLs known not to be UNUSUAL stay inside the JVM;
    canonical_urls tells a table's rows apart."""
    trimmed = F.btrim(raw)
    if not ascii_only:
        trimmed = F.when(trimmed.rlike(UNUSUAL), plain_url(trimmed)).otherwise(trimmed)
    shape = "^([A-Za-z][A-Za-z0-9+.-]*):(//+)?(.*)$"
    scheme, slashes, rest = F.lower(F.regexp_extract(trimmed, shape, 1)), F.regexp_extract(trimmed, shape, 2), F.regexp_extract(trimmed, shape, 3)
    special = scheme.isin(*SPECIAL_PORTS)
    rest = F.when(special, F.regexp_replace(F.regexp_replace(rest, "^[/\\\\]+", ""), "\\\\(?=[^?#]*(?:[?#]|$))", "/")).otherwise(rest)
    held = special | (slashes != "")
    parts = "^(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@\\s]*)(?::(\\d*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(rest, parts, i)
    host, port = F.when(special, F.lower(part(1))).otherwise(part(1)), F.regexp_replace(part(2), "^0+(?=\\d)", "")
    default = F.coalesce(F.create_map(*[F.lit(x) for pair in SPECIAL_PORTS.items() for x in pair])[scheme], F.lit(""))
    at = F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise("")
    opaque = F.regexp_extract(rest, "^([^?#]*)", 1)
    path = F.when(held, part(3)).otherwise(opaque)
    path = F.when(special & (path == ""), "/").otherwise(path)
    path = _percent(F.when(path.startswith("/"), _without_dots(path)).otherwise(path))
    path = F.when(path == "/", path).when(path.rlike("^/+$"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.when(held, part(4)).otherwise(F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1))
    key = lambda t: F.lower(F.try_url_decode(F.substring_index(t, "=", 1)))
    tokens = F.filter(F.split(query, "&"), lambda t: ~F.coalesce(key(t).startswith("utm_") | key(t).isin(*TRACKING_PARAMS), F.lit(False)))
    kept = F.array_join(F.array_sort(tokens), "&")
    url = F.concat(scheme, F.lit("://"), F.when(held, F.concat(host, at)).otherwise(""), path, F.when((query != "") & (kept != ""), F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when((scheme != "") & (~special | (host != "")), url)


def canonical_urls(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the canonical form of their URLs as `name`. Usual URLs stay inside the JVM; only the others go through Python."""
    unusual = F.coalesce(F.btrim(F.col(column)).rlike(UNUSUAL), F.lit(False))
    plain = rows.where(~unusual).withColumn(name, canonical_url(F.col(column), ascii_only=True))
    return plain.unionByName(rows.where(unusual).withColumn(name, canonical_url(plain_url(F.btrim(F.col(column))), ascii_only=True)))


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; no built-in function decomposes."""
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn")
    return s.map(lambda x: x if x is None or x.isascii() else plain(x))


def slugify(basis: Column, ascii_only: bool = False) -> Column:
    """A directory name: marks stripped, lower case, runs of others as one hyphen, 60 characters at most. ascii_only: text known to be ASCII
    needs no decomposition and stays inside the JVM."""
    text = F.coalesce(basis, F.lit(""))
    s = F.lower(text if ascii_only else strip_marks(text))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, 60), "-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def slug_with_suffix(slug: Column, object_id: Column, taken: Column) -> Column:
    """taken: how many earlier rows hold the slug."""
    hexes = F.regexp_replace(object_id, "^[a-z]+-", "")
    return F.when((taken == 0) & ~slug.isin(*RESERVED_STEMS), slug).otherwise(F.concat(slug, F.lit("--"), F.substring(hexes, 1, 6)))


def safe_title(value: Column) -> Column:
    """A title that is safe as a file name and as a link target; idempotent."""
    s = F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " "))
    s = F.regexp_replace(s, "[\\x00-\\x1f]", "")
    s = F.translate(s, "[]|#^/\\:*?\"<>", "()-")
    s = F.regexp_replace(F.regexp_replace(s, "\\s+", " "), "^[ .]+|[ .]+$", "")
    return F.regexp_replace(F.substring(s, 1, 120), "[ .]+$", "")


def filename_problem(path: Column) -> Column:
    """The first reason why a relative path isn't portable, or null."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))

    def reason(seg: Column) -> Column:
        stem = F.lower(F.regexp_replace(seg, "\\.[^.]*$", ""))
        return F.when(seg == "..", F.lit(".. segment")).when(seg.rlike('[\\x00-\\x1f<>:"|?*]'), "forbidden character").when(seg.rlike("[ .]$"), "trailing dot/space").when(stem.isin(*RESERVED_STEMS), "reserved name")

    first = F.filter(F.transform(parts, reason), lambda x: x.isNotNull())
    whole = F.when(F.coalesce(path, F.lit("")) == "", F.lit("empty path")).when(path.rlike("^(/|[A-Za-z]:)"), "absolute path").when(path.contains("\\"), "backslash separator")
    return F.coalesce(whole, F.get(first, 0))


def id_format_ok(c: Column, prefix: str) -> Column:
    return c.rlike(f"^{prefix}-[0-9a-f]{{12}}$")


def lexically_inside(path: Column) -> Column:
    return ~(path.startswith("/") | F.array_contains(F.split(path, "/"), ".."))


def satisfies(version: Column, requirement: Column) -> Column:
    """`^x.y.z` (same major, not older) and `>=x.y.z`; a bare version must be equal."""
    number = lambda c: F.transform(F.slice(F.concat(F.split(F.regexp_replace(c, "^(\\^|>=)", ""), "[.+-]"), F.array(F.lit("0"), F.lit("0"))), 1, 3), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    v, r = number(version), number(requirement)
    newer = F.struct(*[v[i] for i in range(3)]) >= F.struct(*[r[i] for i in range(3)])
    return F.when(requirement.startswith("^"), newer & (v[0] == r[0])).when(requirement.startswith(">="), newer).otherwise(v == r)


def pseudonym(name: Column, key: str, prefix: str = "User-") -> Column:
    """A keyed hash (HMAC-SHA256) of a name, six hex digits of it."""
    import hashlib

    block = hashlib.sha256(key.encode()).digest() if len(key.encode()) > 64 else key.encode()
    block = block.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), name.cast("binary")), 256))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 6))
