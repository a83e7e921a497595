"""URLs: validity, parts and the normal form, as columns.

Plain ASCII URLs are taken apart by built-in expressions. All others (spaces, dot
segments, escapes, hosts that are addresses or hold letters beyond ASCII) go through
one Arrow function that parses as the URL standard says; plain rows send it a null.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = ("scheme", "host", "port", "path", "query", "fragment")
PARTS = T.StructType([T.StructField(n, T.IntegerType() if n == "port" else T.StringType()) for n in (*_NAMES, "error")])

# Messages of validity checks.
NO_URL = "No URL provided"
NO_SCHEME = "Invalid URL: missing scheme (try adding http:// or https://)"
RELATIVE, EMPTY_HOST, BAD_PORT = "relative URL without a base", "empty host", "invalid port number"
BAD_DOMAIN, BAD_CHARACTER = "invalid international domain name", "invalid domain character"
BAD_IPV4, BAD_IPV6 = "invalid IPv4 address", "invalid IPv6 address"

# Fixed values of the URL standard: default ports and characters that are escaped.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_IN_FRAGMENT, _IN_QUERY, _IN_PATH = ' "<>`', " \"#<>'", ' "#<>?`{}'
_NOT_IN_DOMAIN = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")

_PLAIN = r"^[Hh][Tt][Tt][Pp][Ss]?://(?=[A-Za-z])[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*(?:\.[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)*\.[A-Za-z][A-Za-z0-9]*(?::[0-9]{1,4})?(?:/(?:[A-Za-z0-9_~!$&'()*+,;=:@-][A-Za-z0-9._~!$&'()*+,;=:@-]*)?)*(?:\?[A-Za-z0-9._~!$&()*+,;=:@/?-]*)?(?:#[A-Za-z0-9._~!$&'()*+,;=:@/?-]*)?$"
_SPLIT = r"^([A-Za-z]+)://([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _escaped(text: str, special: str) -> str:
    return "".join(c if "\x20" <= c <= "\x7e" and c not in special else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _ipv4(host: str) -> str | None:
    """The dotted form of a host whose last label is a number, null for other hosts."""
    labels = host.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    if not re.fullmatch(r"[0-9]+|0[xX][0-9A-Fa-f]*", labels[-1]):
        return None
    numbers = []
    for label in labels:
        kind = next((base for base, form in ((16, r"0[xX][0-9A-Fa-f]*"), (8, r"0[0-7]+"), (10, r"0|[1-9][0-9]*")) if re.fullmatch(form, label)), None)
        if kind is None:
            raise ValueError(BAD_IPV4)
        numbers.append(int(label[2:] or "0", 16) if kind == 16 else int(label, kind))
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(BAD_IPV4)
    whole = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(whole))


def _host(text: str) -> str:
    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1] if text.endswith(']') else '')}]"
        except ValueError:
            raise ValueError(BAD_IPV6) from None
    try:
        plain = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode()
        labels = re.split(r"[.。．｡]", unicodedata.normalize("NFKC", plain.lower()).replace("­", ""))
        host = ".".join(x if x.isascii() else "xn--" + unicodedata.normalize("NFC", x).encode("punycode").decode() for x in labels)
    except UnicodeError:
        raise ValueError(BAD_DOMAIN) from None
    if not host:
        raise ValueError(EMPTY_HOST if not text else BAD_DOMAIN)
    if _NOT_IN_DOMAIN.search(host):
        raise ValueError(BAD_CHARACTER)
    return _ipv4(host) or host


def _path(text: str) -> str:
    out: list[str] = []
    steps = re.split(r"[/\\]", text)
    for i, step in enumerate(steps):
        dots = re.sub("%2[eE]", ".", step)
        last = i == len(steps) - 1
        if dots == "..":
            del out[-1:]
        elif dots != ".":
            out.append(_escaped(step, _IN_PATH))
        if dots in (".", "..") and last:
            out.append("")
    return "/" + "/".join(out)


def parse(url: str) -> tuple:
    """scheme, host, port, path, query, fragment of an absolute URL; ValueError says what is wrong.

    Of schemes without hosts of their own only the scheme is found out.
    """
    url = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    start = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    if not start:
        raise ValueError(RELATIVE)
    scheme, rest = start[1].lower(), url[start.end() :]
    if scheme not in PORTS:
        return scheme, None, None, None, None, None
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    authority, path = re.fullmatch(r"[/\\]*([^/\\]*)[/\\]?(.*)", rest, re.S).groups()
    host, colon, port = re.fullmatch(r"(\[[^\]]*\]?|[^:]*)(:?)(.*)", authority.rpartition("@")[2], re.S).groups()
    if not host:
        raise ValueError(EMPTY_HOST)
    host = _host(host)
    if port and (not re.fullmatch("[0-9]+", port) or int(port) > 65535) or (not colon and port):
        raise ValueError(BAD_PORT)
    number = int(port) if port and int(port) != PORTS[scheme] else None
    return scheme, host, number, _path(path), _escaped(query, _IN_QUERY) if mark else None, _escaped(fragment, _IN_FRAGMENT) if hash_ else None


@F.arrow_udf(PARTS)
def _parsed(urls: pa.Array) -> pa.Array:
    rows = []
    for url in urls:
        text = url.as_py()
        try:
            row = dict.fromkeys((*_NAMES, "error")) if text is None else dict(zip(_NAMES, parse(text), strict=True)) | {"error": None}
        except ValueError as e:
            row = dict.fromkeys(_NAMES) | {"error": str(e)}
        rows.append(row)
    kinds = [(n, pa.int32() if n == "port" else pa.string()) for n in (*_NAMES, "error")]
    return pa.array(rows, pa.struct(kinds))


_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normal_path(path: Column) -> Column:
    """A path that starts with a slash; one trailing slash goes unless it is all there is."""
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.regexp_replace(path, r"(.)/$", "$1")


def _mark(mark: str, part: Column) -> Column:
    return F.coalesce(F.concat(F.lit(mark), part.cast("string")), F.lit(""))


def resolved(df: DataFrame, url_col: str = "url", into: str = "parts") -> DataFrame:
    """`df` with a struct of scheme, host, port, path, query, fragment, normalized, robots_url and error.

    The normal form has no userinfo, no default port, and one trailing slash less; `error`
    says why a URL is not valid, and then the rest is null. Checked in this order: blank
    (a null counts as blank), no `://`, what the parser finds, a scheme other than http and
    https. Each step is a projection of its own, so that no expression is worked out twice.
    """
    text = F.regexp_replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), f"^{_BLANK}|{_BLANK}$", "")
    df = df.withColumn("_u", text)
    text = F.col("_u")
    df = df.withColumns({"_plain": text.rlike(_PLAIN) & ~F.lower(text).contains("xn--"), "_early": F.when(text == "", NO_URL).when(~text.contains("://"), NO_SCHEME)})
    df = df.withColumn("_other", _parsed(F.when(~F.col("_plain") & F.col("_early").isNull(), text)))
    piece = lambda i: F.regexp_extract(text, _SPLIT, i)
    quick = F.struct(
        F.lower(piece(1)).alias("scheme"),
        F.lower(piece(2)).alias("host"),
        F.when(piece(3) != "", piece(3)).try_cast("int").alias("port"),
        F.when(piece(4) == "", "/").otherwise(piece(4)).alias("path"),
        F.when(text.rlike(r"^[^#]*\?"), piece(5)).alias("query"),
        F.when(text.contains("#"), piece(6)).alias("fragment"),
        F.lit(None).cast("string").alias("error"),
    )
    df = df.withColumn("_f", F.when(F.col("_plain"), quick).otherwise(F.col("_other")))
    f = F.col("_f")
    odd = ~f["scheme"].isin("http", "https")
    error = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(f["error"].isNotNull(), F.concat(F.lit("Invalid URL: "), f["error"]))
        .when(odd, F.concat(F.lit("Invalid URL: scheme '"), f["scheme"], F.lit("' not allowed (only http and https)")))
    )
    default = ((f["scheme"] == "http") & (f["port"] == 80)) | ((f["scheme"] == "https") & (f["port"] == 443))
    df = df.withColumns({"_error": error, "_port": F.when(~default, f["port"]), "_path": normal_path(f["path"])})
    site = F.concat(f["scheme"], F.lit("://"), f["host"], _mark(":", F.col("_port")))
    whole = F.concat(site, F.col("_path"), _mark("?", f["query"]), _mark("#", f["fragment"]))
    good = F.col("_error").isNull()
    out = {"scheme": f["scheme"], "host": f["host"], "port": F.col("_port"), "path": F.col("_path"), "query": f["query"], "fragment": f["fragment"], "normalized": whole, "robots_url": F.concat(site, F.lit("/robots.txt"))}
    kept = F.struct(*(F.when(good, c).alias(n) for n, c in out.items()), F.col("_error").alias("error"))
    return df.withColumn(into, kept).drop("_u", "_plain", "_early", "_other", "_f", "_error", "_port", "_path")
