"""Canonical form of links."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only name a session, and default ports.
SESSION_PARAMETERS = ("jsessionid", "phpsessid", "aspsessionid")
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}


def _path(path: str) -> str:
    """Dot segments and repeated slashes resolved; leading ``..`` dropped; an empty path is the root."""
    out: list[str] = []
    parts = re.sub(r"/{2,}", "/", path.replace("%7E", "~").replace("%7e", "~")).split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "..":
            if out and out[-1] != "":
                out.pop()
            if last:
                out.append("")
        elif part == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    joined = quote("/".join(out), safe="/%:@!$&'()*+,;=~-._")
    return joined if joined.startswith("/") else "/" + joined


def _encode(value: str) -> str:
    return quote(value, safe="-_.~")


def _query(query: str) -> str:
    """Parameters sorted by name, the last of equal names kept, session ids dropped."""
    found: dict[str, str] = {}
    for pair in query.split("&"):
        if not pair:
            continue
        name, eq, value = pair.partition("=")
        name = unquote_plus(name)
        if name and not name.lower().startswith(SESSION_PARAMETERS):
            found[name] = f"{_encode(name)}={_encode(unquote_plus(value))}" if eq else _encode(name)
    return "&".join(found[k] for k in sorted(found))


def canonical(href: str | None, context: str | None, drop_query: bool = False, same_host: bool = True) -> str | None:
    """``href`` seen from page ``context``, in canonical form; None if it can't be resolved or, with ``same_host``, leads to another host.

    Protocol and host are lower-cased, default port and fragment dropped, the path resolved, parameters sorted. The form is its own canonical form.
    """
    if href is None or context is None:
        return None
    try:
        base = urlsplit(context.strip())
        url = urlsplit(urljoin(context.strip(), href.strip()))
        port = url.port
    except ValueError:
        return None
    scheme, host = url.scheme.lower(), (url.hostname or "").lower()
    if not scheme or not host or (same_host and host != (base.hostname or "").lower()):
        return None
    where = host if port is None or port == DEFAULT_PORTS.get(scheme) else f"{host}:{port}"
    query = "" if drop_query else _query(url.query)
    return f"{scheme}://{where}{_path(url.path)}{'?' + query if query else ''}"


def canonical_url(href: Column, context: Column, drop_query: bool = False, same_host: bool = True) -> Column:
    """The same as a column, in Arrow batches."""

    @F.pandas_udf("string")
    def resolve(h: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([canonical(x, y, drop_query, same_host) for x, y in zip(h, c, strict=True)], dtype=object)

    return resolve(href, context)


def without_query(url: Column) -> Column:
    """Protocol, host and path of a URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*)", 1)


def host_key(url: Column) -> Column:
    """``protocol://host[:port]`` in lower case, '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def twin_key(key: Column) -> Column:
    """The same host under the other of http and https."""
    return F.when(key.startswith("https://"), F.concat(F.lit("http://"), F.substr(key, F.lit(9)))).otherwise(F.concat(F.lit("https://"), F.substr(key, F.lit(8))))
