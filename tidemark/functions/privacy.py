"""Masking, hashing and personal-data patterns as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Personal-data patterns in the order they are applied.
PATTERNS = {
    "Email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "Phone": r"\b(\+?1[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CreditCard": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "IPAddress": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "ZipCode": r"\b\d{5}(-\d{4})?\b",
}
# The table scanner reads phones and cards by these patterns instead.
SCAN_PATTERNS = PATTERNS | {
    "Phone": r"\b(\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b",
    "CreditCard": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
}


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)).cast("int"))


def mask_keep_first(v: Column, visible: int = 0) -> Column:
    """Keep the first characters, star the rest; short and empty values stay."""
    return F.when(F.length(v) > visible, F.concat(F.substring(v, 1, visible), _stars(F.length(v) - visible))).otherwise(v)


def sha256_hex(v: Column) -> Column:
    """Upper-case hex SHA-256; empty text stays empty."""
    return F.when(v == "", v).otherwise(F.upper(F.sha2(v, 256)))


def policy_full(v: Column) -> Column:
    return F.when(v.isNotNull(), F.lit("***"))


def policy_partial(v: Column) -> Column:
    """Two characters at each end; four or fewer characters become ``***``."""
    s = v.cast("string")
    kept = F.concat(F.left(s, F.lit(2)), _stars(F.length(s) - 4), F.right(s, F.lit(2)))
    return F.when(F.length(s) <= 4, "***").when(s.isNotNull(), kept)


def policy_hash(v: Column) -> Column:
    return F.left(F.upper(F.sha2(v.cast("string"), 256)), F.lit(16))


def _last4(s: Column) -> Column:
    return F.right(s, F.lit(4))


def mask_email(v: Column) -> Column:
    """First and last letter of the user stay; two letters or fewer are starred."""
    user, host = F.split_part(v, F.lit("@"), F.lit(1)), F.split_part(v, F.lit("@"), F.lit(2))
    masked = F.when(
        F.length(user) > 2, F.concat(F.left(user, F.lit(1)), _stars(F.length(user) - 2), F.right(user, F.lit(1)))
    ).otherwise(_stars(F.length(user)))
    one_at = F.length(v) - F.length(F.replace(v, F.lit("@"), F.lit(""))) == 1
    return F.when(one_at, F.concat(masked, F.lit("@"), host)).otherwise(v)


def mask_phone(v: Column) -> Column:
    digits = F.regexp_replace(v, r"\D", "")
    return F.when(F.length(digits) >= 4, F.concat(_stars(F.length(digits) - 4), _last4(digits))).otherwise(
        _stars(F.length(digits)))


def mask_card(v: Column) -> Column:
    digits = F.regexp_replace(v, r"\D", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit("**** **** **** "), _last4(digits))).otherwise(
        _stars(F.length(digits)))


def mask_ssn(v: Column) -> Column:
    return F.concat(F.lit("***-**-"), _last4(v))


def mask_tail(v: Column) -> Column:
    return F.concat(_stars(F.length(v) - 4), _last4(v))


PARTIAL = {"Email": mask_email, "Phone": mask_phone, "SSN": mask_ssn, "CreditCard": mask_card}


def mask_value(v: Column, pii_type: str) -> Column:
    """Partial mask of a column that holds one whole value of ``pii_type``."""
    return PARTIAL.get(pii_type, mask_tail)(v)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once: a lambda variable is evaluated a single time however
    often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def _replace_each(text: Column, pattern: str, change) -> Column:
    """Replace every match by ``change(match)``: the text between matches (split)
    and the changed matches (extract) are zipped back together."""

    def zipped(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), change)
        pieces = F.zip_with(F.split(t, pattern, -1), found, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    return _let(text, zipped)


def mask_pii(text: Column, strategy: str = "redact") -> Column:
    """Mask all personal data in free text, type after type in the fixed order."""

    def step(acc: Column, item: tuple[str, str]) -> Column:
        name, pattern = item
        if strategy == "redact":
            return F.regexp_replace(acc, pattern, f"[{name}]")
        if strategy == "remove":
            return F.regexp_replace(acc, pattern, "")
        if strategy == "hash":
            return _replace_each(acc, pattern, lambda m: F.concat(
                F.lit(f"[{name}:"), F.left(F.upper(F.sha2(m, 256)), F.lit(8)), F.lit("]")))
        if strategy == "partial":
            return _replace_each(acc, pattern, lambda m: mask_value(m, name))
        raise ValueError(f"unknown strategy {strategy}")

    return reduce(step, PATTERNS.items(), text)


def contains(text: Column, pii_type: str, patterns: dict[str, str] = PATTERNS) -> Column:
    return text.rlike(patterns[pii_type])


def redact_value(v: Column, strategy: str, key: Column | None = None) -> Column:
    """Whole-value redaction: replace, mask, hash or a keyed, repeatable token."""
    s = v.cast("string")
    if strategy == "replace":
        out = F.lit("[REDACTED]")
    elif strategy == "mask":
        out = _stars(F.length(s))
    elif strategy == "hash":
        out = F.upper(F.sha2(s, 256))
    elif strategy == "tokenize":
        out = F.concat(F.lit("TOKEN_"), F.left(F.sha2(F.concat_ws(":", key, s), 256), F.lit(32)))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return F.when(s.isNotNull(), out)
