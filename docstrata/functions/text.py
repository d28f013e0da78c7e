"""Column functions for text: Python-compatible white space, rounding, normalisation, masking and escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's ``str.split`` and ``str.strip`` treat as white space.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same characters one by one.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed patterns: glyphs without a mapping, and what separates tokens (dots at their ends do, too).  What is no
# part of a token is listed: the negated class of its parts takes Java's matcher several times as long.
UNMAPPABLE = r"[\uE000-\uF8FF\uFFFD]"
NO_PART = r"[\x00-\x22\x24-\x2a\x2c\x2d\x2f:-@\[-`{-\x{10ffff}]"
NO_TOKEN = rf"{NO_PART}++|\.(?<!\.\.)\.*+(?:{NO_PART}++|$)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(x: str | Column, digits: int) -> Column:
    """Round half to even on the exact binary value, as Python's ``round`` does."""
    return F.regexp_replace(F.format_number(col(x), digits), ",", "").cast("double")


def stripped(x: str | Column) -> Column:
    return F.btrim(col(x), F.lit(WHITE))


def right_stripped(x: str | Column) -> Column:
    return F.regexp_replace(col(x), f"{SPACE}+$", "")


def words(x: str | Column) -> Column:
    return F.array_remove(F.split(col(x), f"{SPACE}+"), "")


def word_count(x: str | Column) -> Column:
    return F.size(words(x))


def drop_glyphs(x: str | Column) -> Column:
    """Remove private-use and replacement characters."""
    return F.regexp_replace(col(x), UNMAPPABLE, "")


def is_upper_case(x: str | Column) -> Column:
    """At least one letter, and no letter that is not upper case."""
    return col(x).rlike(r"\p{L}") & ~col(x).rlike(r"[\p{L}&&[^\p{Lu}]]")


def heading_norm(x: str | Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks to blanks, runs of blanks to one."""
    kept = F.regexp_replace(F.lower(stripped(x)), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def furniture_key(x: str | Column) -> Column:
    """What stays of a running header or footer when its numbers change."""
    return F.lower(stripped(F.regexp_replace(col(x), r"(?U)\d+", "")))


def font_family(x: str | Column) -> Column:
    """The name without subset prefix, style and variant."""
    bare = F.regexp_replace(col(x), r"^[^+]*\+", "")
    return F.substring_index(F.substring_index(bare, "-", 1), ",", 1)


def slug(x: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def collapsed(x: str | Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return stripped(F.regexp_replace(col(x), f"{SPACE}+", " "))


def surface(x: str | Column) -> Column:
    """A skill name or alias as the matcher sees it: tokens in lower case with single blanks."""
    parts = F.split(F.lower(col(x)), r"[^a-z0-9+#.]+")
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def tokens(x: str | Column) -> Column:
    """Tokens as written, without trailing dots."""
    return F.array_remove(F.split(col(x), NO_TOKEN), "")


def excerpt(x: str | Column, most: int = 200) -> Column:
    """At most ``most`` characters, the last an ellipsis if something is cut."""
    text = stripped(x)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(right_stripped(F.substring(text, 1, most - 1)), F.lit("…")))


def html_escape(x: str | Column) -> Column:
    out = col(x)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def percent_half_even(x: str | Column) -> Column:
    return F.rint(col(x) * 100).cast("int")


def percent_half_up(x: str | Column) -> Column:
    return F.floor(col(x) * 100 + 0.5).cast("int")


def request_id(x: str | Column, most: int = 64) -> Column:
    """Letters, digits, ``-`` and ``_`` of the supplied id, cut off; a random id where nothing is left."""
    cleaned = F.substring(F.regexp_replace(col(x), r"[^\p{L}\p{N}_-]", ""), 1, most)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.regexp_replace(F.expr("uuid()"), "-", ""))


def client_key(forwarded: str | Column, peer: str | Column, trusted: int) -> Column:
    """The ``trusted``-th address from the right of a forwarding list, else the peer, else 'unknown'."""
    chosen = F.lit(None).cast("string")
    if trusted > 0:
        hops = F.filter(F.transform(F.split(F.coalesce(col(forwarded), F.lit("")), ","), stripped), lambda h: h != "")
        chosen = F.try_element_at(hops, F.lit(-trusted))
    return F.coalesce(chosen, col(peer), F.lit("unknown"))


def retry_after(seconds: str | Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(col(seconds))).cast("int")


# Fixed patterns of the masks, in the order in which they apply.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HANDLE = r"(?iU)\b(?:linkedin\.com/in|github\.com|gitlab\.com)/[\w./-]+"
URL = r"(?iU)(?:https?://|www\.)\S+"
PHONE = r"(?U)(?<!\w)(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?){2,4}\d{2,4}(?!\w)"
POSTAL = r"(?U)\b\d{5}(?:-\d{4})?\b"
YEARS = r"(?U)^(?:19|20)\d{2}\s*-\s*(?:19|20)\d{2}$"
MIN_PHONE_DIGITS = 8


def mask_emails(x: str | Column) -> Column:
    return F.regexp_replace(col(x), EMAIL, "[EMAIL]")


def mask_handles(x: str | Column) -> Column:
    return F.regexp_replace(col(x), HANDLE, "[URL]")


def mask_urls(x: str | Column) -> Column:
    return F.regexp_replace(col(x), URL, "[URL]")


def mask_postal_codes(x: str | Column) -> Column:
    return F.regexp_replace(col(x), POSTAL, "[POSTAL]")


def digit_count(x: str | Column) -> Column:
    return F.length(F.regexp_replace(col(x), r"(?U)\D", ""))


def mask_phones(x: str | Column) -> Column:
    """Mask what looks like a phone number, but neither a range of years nor fewer than eight digits."""
    found = F.regexp_extract_all(col(x), F.lit(PHONE), F.lit(0))
    masked = F.transform(
        found,
        lambda m: F.when(stripped(m).rlike(YEARS) | (digit_count(m) < MIN_PHONE_DIGITS), m).otherwise(F.lit("[PHONE]")),
    )
    woven = F.zip_with(F.split(col(x), PHONE, -1), masked, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(woven, "")).otherwise(col(x))


def scrubbed(x: str | Column) -> Column:
    """E-mails, profile handles, links, phone numbers, postal codes, in that order."""
    return mask_postal_codes(mask_phones(mask_urls(mask_handles(mask_emails(x)))))
