"""URL parts, identities and masking without any network access."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import let


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def query(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"))


def fragment(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("REF"))


def path_parts(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")


def query_value(url: Column, keys) -> Column:
    """Value of the first listed key that is present and not empty."""
    return F.coalesce(
        *[F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)), F.lit("")) for k in keys]
    )


def decoded(text: Column) -> Column:
    """Percent-decoded text; a malformed escape leaves the text as it is. '+' stays '+'."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def drop_empty_fragment(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "#$", "")


def access_code(url: Column) -> Column:
    return F.coalesce(query_value(url, rules.ACCESS_KEYS), F.lit(""))


def with_access_code(url: Column, code: Column) -> Column:
    """Append a code found beside the link, before the fragment, unless the link carries one."""
    base, frag = F.split_part(url, F.lit("#"), F.lit(1)), F.regexp_extract(url, "(#.*)$", 1)
    key = F.when(provider_of(url) == "123", F.lit("pwd")).otherwise(F.lit("password"))
    joiner = F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    named = "password=|pwd="
    has_code = F.lower(url).rlike(named) & F.lower(F.coalesce(query(url), F.lit(""))).rlike(named)
    return F.when(code.isNull() | has_code, url).otherwise(F.concat(base, joiner, key, F.lit("="), code, frag))


def masked_url(url: Column) -> Column:
    keys = "|".join(rules.SECRET_KEYS)
    return F.regexp_replace(url, rf"(?i)([?&](?:{keys})=)[^&#]*", "$1****")


#: A link to a known host of nothing but signs that every parser takes.
_SIGNS = "[A-Za-z0-9._~/?=&-]*"
_PLAIN = f"^(?i:https?://(?:www[.])?({'|'.join(re.escape(h) for h in rules.HOST_PROVIDERS)}))(?:[/?]{_SIGNS})?(?:#{_SIGNS})?\\z"


def provider_of(url: Column) -> Column:
    """Provider of a share link by its host, ``ed2k`` for hash links, else null.

    The host of a link of plain signs alone is what stands there; only other links are parsed, which costs much more.
    """
    by_host = F.create_map(*[F.lit(x) for pair in rules.HOST_PROVIDERS.items() for x in pair])
    return F.when(F.lower(url).startswith("ed2k://"), F.lit("ed2k")).otherwise(
        F.coalesce(F.try_element_at(by_host, F.lower(F.regexp_extract(url, _PLAIN, 1))), F.try_element_at(by_host, F.coalesce(host(url), F.lit(""))))
    )


def share_identity(url: Column) -> Column:
    """Struct(provider, code, password) of a share link; null when the link is not a share.

    The link is taken apart once, for its host: a known host has only a well-formed link, whose path and query are plain text
    pieces. Reading a host that begins with a digit costs the parser an exception.
    """
    parts = F.filter(F.split(F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    query_ = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)

    def first_of(*keys: str) -> Column:
        return let(query_, lambda q: F.coalesce(*[F.nullif(F.regexp_extract(q, f"(?:&|^){k}=([^&]*)", 1), F.lit("")) for k in keys], F.lit("")))

    def of(provider: Column, parts: Column) -> Column:
        folder = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
        code = F.try_element_at(parts, F.lit(-1))
        ok = F.when(provider == "123", folder.isin("s", "share", "123pan")).when(provider.isin("115", "guangya"), folder == "s").otherwise(F.lit(False))
        password = (
            F.when(provider == "115", first_of("password", "pwd")).when(provider == "123", first_of("pwd", "password")).otherwise(first_of("pwd", "password", "code"))
        )
        clean = F.when(provider == "123", F.regexp_replace(code, r"\.html$", "")).otherwise(code)
        return F.when(ok & code.isNotNull(), F.struct(provider.alias("provider"), clean.alias("code"), password.alias("password")))

    return let(provider_of(url), lambda provider: let(parts, lambda p: of(provider, p)))
