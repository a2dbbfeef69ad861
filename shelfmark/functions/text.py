"""Text normalisation and heading helpers as native column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .udfs import fold_width, nfkc


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated, and planned, once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_else(value: Column, default: Column) -> Column:
    """``value`` unless it is null or empty."""
    return let(value, lambda v: F.when(F.coalesce(v, F.lit("")) == "", default).otherwise(v))


def staged(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """The steps one after the other, each on the result of the one before; the plan grows by one step each."""
    return reduce(let, steps, value)


def settled(value: Column, step: Callable[[Column], Column], rounds: Column) -> Column:
    """``step`` over and over until it changes nothing; ``rounds`` is to be as many as can change anything."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))
    again = lambda s: let(step(s["v"]), lambda v: F.struct(v.alias("v"), v.eqNullSafe(s["v"]).alias("done")))
    return F.aggregate(F.sequence(F.lit(1), rounds), start, lambda s, _: F.when(s["done"], s).otherwise(again(s)), lambda s: s["v"])


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, the case rule of the literal text search."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def strip_chars(text: Column, chars: str) -> Column:
    """Strip a regex character class (without brackets) from both ends."""
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def casefold(text: Column) -> Column:
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def title_key(text: Column, exact: bool = True) -> Column:
    """Identity of a title: compatibility folded, case folded, letters and digits only.

    Not ``exact``: only one-to-one forms are folded, as where no function of rows can be called (lambdas).
    """
    folded = nfkc(text) if exact else fold_width(text)
    return F.regexp_replace(casefold(folded), r"[^\p{L}\p{N}]", "")


_NUL = "\0"


def title_keys(texts: Column) -> Column:
    """``title_key`` of each text of an array, each key once; texts without letters and digits have none.

    The texts are folded as one, joined by a character that no key has; it becomes a blank in texts that hold it.
    """
    joined = F.array_join(texts, _NUL, "")
    whole = F.size(F.split(joined, _NUL)) == F.greatest(F.size(texts), F.lit(1))
    apart = F.when(whole, joined).otherwise(F.array_join(F.transform(texts, lambda t: F.replace(t, F.lit(_NUL), F.lit(" "))), _NUL, ""))
    keys = F.regexp_replace(casefold(nfkc(apart)), r"[^\p{L}\p{N}\x00]", "")
    return F.array_distinct(F.array_remove(F.split(keys, _NUL), ""))


def name_key(text: Column) -> Column:
    """Identity of a name: case folded, blanks collapsed, punctuation kept."""
    return F.trim(F.regexp_replace(casefold(fold_width(text)), r"\s+", " "))


def first_line(text: Column) -> Column:
    return F.substring_index(F.translate(text, "\r", "\n"), "\n", 1)


def drop_icons(text: Column) -> Column:
    return F.regexp_replace(text, rules.ICON_PREFIX, "")


def clean_person_name(text: Column) -> Column:
    """Title line without icons and edge punctuation, so that variants group together."""
    body = drop_icons(F.regexp_replace(text, "^\uFEFF+", ""))
    return strip_chars(F.trim(first_line(body)), rules.NAME_EDGE)


def last_year(text: Column) -> Column:
    """Last 19xx/20xx that is neither part of a longer number nor a resolution."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rules.YEAR), F.lit(1)), F.lit(-1)).cast("int")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_int(text: Column, pattern: str, group: int = 1) -> Column:
    return first_match(text, pattern, group).try_cast("int")


def heading_year(text: Column) -> Column:
    """Bracketed year first, then the first free-standing one."""
    return F.coalesce(first_int(text, rules.BRACKETED_YEAR), first_int(text, rules.YEAR))


def cut_at_first(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Text before the earliest match of any pattern.

    One alternation: the leftmost match of all is by definition the earliest start.
    """
    alternatives = "|".join(f"(?:{p})" for p in patterns)
    return F.regexp_replace(text, f"(?:{alternatives})(?s:.*)", "")


def strip_trailing_date(text: Column) -> Column:
    return let(text, lambda t: or_else(strip_chars(F.regexp_replace(t, rules.TRAILING_DATE, ""), rules.EDGE), t))


# The nine digits and the tens sign of written numbers.
_CN_DIGITS, _CN_TEN = "一二三四五六七八九", "十"


def cjk_number(text: Column) -> Column:
    """Written number up to ninety-nine; null for anything else."""
    plain = F.translate(text, _CN_DIGITS, "123456789")
    tens = F.split_part(plain, F.lit(_CN_TEN), F.lit(1))
    ones = F.split_part(plain, F.lit(_CN_TEN), F.lit(2))
    with_ten = F.when(tens.rlike("^[1-9]$"), tens.try_cast("int")).otherwise(F.lit(1)) * 10 + F.when(
        ones.rlike("^[1-9]$"), ones.try_cast("int")
    ).otherwise(F.lit(0))
    return (
        F.when(~text.rlike(f"^[{_CN_DIGITS}{_CN_TEN}]+$"), F.lit(None).cast("int"))
        .when(text.contains(_CN_TEN), with_ten)
        .when(F.length(text) == 1, plain.try_cast("int"))
    )


def written_number(text: Column) -> Column:
    """Number in digits, or written with signs for ten and hundred, up to 999; null for anything else."""
    plain = F.translate(text, "两" + _CN_DIGITS + "零", "2123456789")
    hundreds = F.regexp_extract(plain, "^([1-9]?)百", 1)
    tail = F.regexp_replace(plain, "^[1-9]?百", "")
    tens, ones = F.regexp_extract(tail, "^([1-9]?)十", 1), F.regexp_extract(tail, "([1-9])$", 1)
    part = lambda sign, digit, whole, times: F.when(F.contains(whole, F.lit(sign)), F.coalesce(digit.try_cast("int"), F.lit(1)) * times).otherwise(0)
    total = part("百", hundreds, plain, 100) + part(_CN_TEN, tens, tail, 10) + F.coalesce(ones.try_cast("int"), F.lit(0))
    formed = text.rlike(f"^(?:[两{_CN_DIGITS}]?百)?零?(?:[两{_CN_DIGITS}]?{_CN_TEN})?[两{_CN_DIGITS}]?$")
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).when(formed & (total > 0), total)


def number_or_cjk(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text.try_cast("int")), cjk_number(text))


def padded(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "%02d", number)


def range_label(prefix: str, first: Column, last: Column, pad: bool = True) -> Column:
    """``E01-E05``, or ``E01`` for a run of one."""

    def one(n):
        return padded(prefix, n) if pad else F.concat(F.lit(prefix), n.cast("string"))

    return F.when(first == last, one(first)).otherwise(F.concat(one(first), F.lit("-"), one(last)))


def episode_label(season: Column, season_end: Column, episode: Column, episode_end: Column) -> Column:
    """Label of one resource: ``S01E01-E25``, ``S01-S03``, ``S01`` or null."""
    tail = F.when(episode_end > episode, F.concat(F.lit("-"), padded("E", episode_end))).otherwise(F.lit(""))
    numbered = F.concat(padded("S", F.coalesce(season, F.lit(1))), padded("E", episode), tail)
    return (
        F.when(episode.isNotNull(), numbered)
        .when(season_end > season, F.concat(padded("S", season), F.lit("-"), padded("S", season_end)))
        .when(season.isNotNull(), padded("S", season))
    )


def collapse_blank_lines(text: Column) -> Column:
    """Trim every line, keep at most one blank line in a row, none at the ends."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    return strip_chars(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"\n")


_PAIRS = ((r"\(", r"\)"), ("（", "）"), (r"\[", r"\]"), ("【", "】"))
#: Brackets at the head whose partner is nowhere behind them, and blanks and dashes after each.
_LONE_BRACKETS = (
    "(?s)^(?:(?:" + "|".join(f"{one}(?!.*{other})" for pair in _PAIRS for one, other in (pair, pair[::-1])) + ")[ _-]*)+"
)


def trim_unbalanced(text: Column) -> Column:
    """Strip all edge brackets without a partner; balanced ones stay.

    A bracket that is stripped has no partner, so stripping never parts a pair and one pass from either end does.
    """
    head = F.regexp_replace(text, _LONE_BRACKETS, "")
    return F.reverse(F.regexp_replace(F.reverse(head), _LONE_BRACKETS, ""))


def cut_unclosed(text: Column) -> Column:
    """Drop the tail from the first opening bracket that never closes."""
    def cut(left: str, right: str) -> Callable[[Column], Column]:
        def one(out: Column) -> Column:
            at = F.instr(out, left)
            tail = F.substring(out, at, F.length(out))
            head = F.regexp_replace(F.substring(out, F.lit(1), at - 1), f"[{rules.EDGE}]+$", "")
            return F.when((at > 0) & (F.instr(tail, right) == 0), head).otherwise(out)

        return one

    return staged(text, *[cut(*pair) for pair in (("（", "）"), ("(", ")"), ("【", "】"), ("[", "]"), ("《", "》"))])


def is_search_title(title: Column) -> Column:
    """Usable as a query: has letters or digits, is not the placeholder, not only technical words."""
    key = title_key(title)
    return (key != "") & (title != rules.PLACEHOLDER_TITLE) & ~key.rlike(rules.TECHNICAL_TITLE)


def channel_username(value: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(value), "^@+", ""))
    return F.nullif(F.regexp_extract(bare, r"^([A-Za-z0-9_]{5,32})$", 1), F.lit(""))


def channel_identity(value: Column) -> Column:
    """Comparable form of a channel's username or name."""
    return casefold(F.regexp_replace(value, r"[\s@]+", ""))


def stable_code(text: Column) -> Column:
    """Upper-cased stable code at the head of a title or file name, else null."""
    code = F.upper(F.regexp_extract(text, rules.STABLE_CODE, 1))
    return F.when((code != "") & ~code.startswith("TMDBID-"), code)


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(filename), r"\.([^.]*)$", 1))


def stem(filename: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(filename), r"\.[^.]*$", "")))


def like_literal(column: Column, needle: str) -> Column:
    """Substring search that ignores ASCII case; wildcards in the needle are ordinary text."""
    return F.contains(ascii_lower(column), ascii_lower(F.lit(needle)))


def like_sequence(column: Column, needle: str) -> Column:
    """Blank-separated pieces must occur in order, anything between them."""
    pieces = [p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for p in needle.split()]
    return F.like(ascii_lower(column), ascii_lower(F.lit("%" + "%".join(pieces) + "%")))


def redact(text: Column) -> Column:
    """Mask codes and tokens in free text or in a URL query."""
    out = F.regexp_replace(
        text,
        r"(?i)((?:password|pwd|receive_code|access_code|access_token|token|code)=)[^\s&#]+",
        "$1****",
    )
    return F.regexp_replace(
        out, r"(?i)((?:访问密码|访问码|提取码|密码)\s*[:：=]?\s*)[a-z0-9]{2,32}", "$1****"
    )
