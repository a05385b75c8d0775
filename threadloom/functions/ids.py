"""Identifier and timestamp expressions over dump attributes, which are all strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second precision, optional fraction of any length, nothing else.
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"


def reference(c: Column | str) -> Column:
    """An attribute's digits without outer blanks and leading zeros, as a string; null where it refers to nothing."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(c, r"^\s*0*([1-9][0-9]*)\s*$", 1)
    return F.when(digits != "", digits)


def reference_number(c: Column | str) -> Column:
    """reference() as int64; null also beyond int64."""
    return F.expr("bigint(null)") if c is None else reference(c).try_cast("bigint")


def positive_id(c: Column | str) -> Column:
    """A row's own id as int64, null where it is no positive number."""
    return reference_number(c)


def valid_timestamp(c: Column | str) -> Column:
    """TIMESTAMP_NTZ of a strictly written timestamp; fractions beyond microseconds are cut off, bad ones are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(TIMESTAMP), c.try_cast("timestamp_ntz"))


def fraction_digits(c: Column | str) -> Column:
    """All fraction digits without trailing zeros: with the second it orders timestamps exactly."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_extract(c, r"\.([0-9]+)$", 1), "0+$", "")


def valid_second(c: Column | str) -> Column:
    """The whole second of a strictly written timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(TIMESTAMP), F.substring(c, 1, 19).try_cast("timestamp_ntz"))


def exact_instant(c: Column | str) -> Column:
    """Struct (second, fraction digits) that orders exactly like the instant; null where the text is no timestamp."""
    second = valid_second(c)
    return F.when(second.isNotNull(), F.struct(second.alias("second"), fraction_digits(c).alias("fraction")))


def instant_text(c: Column | str) -> Column:
    """A valid timestamp as text that sorts exactly like the instant, all fraction digits counting; null for others."""
    c = F.col(c) if isinstance(c, str) else c
    fraction = fraction_digits(c)
    return F.when(valid_second(c).isNotNull(), F.concat(F.substring(c, 1, 19), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise("")))


#: Entities of blanks and of characters without width.
BLANK_ENTITY = (
    r"(?i)&(?:nbsp|ensp|emsp|thinsp|hairsp|numsp|puncsp|emsp13|emsp14|tab|newline|zwnj|zwj|lrm|rlm|shy|zerowidthspace|nobreak|mediumspace|nonbreakingspace);?"
    r"|&#(?:0*(?:9|1[0-3]|32|133|160|173|5760|6158|819[2-9]|820[0-7]|8232|8233|8239|8287|8288|12288|65279)(?![0-9])|x0*(?:[9a-d]|20|85|a0|ad|1680|180e|200[0-9a-f]|2028|2029|202f|205f|2060|3000|feff)(?![0-9a-f]));?"
)
BLANK = r"\s\p{Z}\x{1c}-\x{1f}\x{85}\x{ad}\x{180e}\x{200b}-\x{200f}\x{2060}\x{feff}"


def shows_something(c: Column | str) -> Column:
    """Whether HTML has visible text; false for null. Agrees with functions.text.visible_text."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->|<[a-zA-Z/!?][^>]*>", " "), BLANK_ENTITY, " ")
    return F.coalesce(text.rlike(f"[^{BLANK}]"), F.lit(False))
