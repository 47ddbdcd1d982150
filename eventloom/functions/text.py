"""Small text rules: addresses, bands, masks, topics and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address shape, topic shape and the topics replies may go to.
MAC_PATTERN = "^[0-9a-f]{2}(:[0-9a-f]{2}){5}$"
TOPIC_PATTERN = "^[A-Za-z0-9._-]{1,249}$"
INBOX_PREFIX = "_INBOX.atheros_sensor."
REPLY_TOPICS = ("_INBOX.atheros_sensor", "wireless.mac.lookup.reply", "wireless.networks.authorized.reply")

# What makes a database failure worth retrying.
RETRYABLE_STATE_PREFIXES = ("08", "40")
RETRYABLE_STATES = ("HYT00", "HYT01", "70100")
RETRYABLE_CODES = (1205, 1213, 1218, 2006, 2013, 2059, 8002, 9007, 9013, 9014, 40001)
RETRYABLE_WORDS = (
    "timeout",
    "temporarily unavailable",
    "connection reset",
    "deadlock",
    "write conflict",
    "lock wait",
    "region unavailable",
)


def is_mac(value: Column) -> Column:
    """True when the lower-cased value is a colon-separated MAC address."""
    return F.coalesce(F.lower(value).rlike(MAC_PATTERN), F.lit(False))


def normalize_bssid(first: Column, second: Column) -> Column:
    """Lower-cased first non-blank of two addresses."""
    return F.lower(F.coalesce(F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(second), F.lit(""))))


def band_for_channel(channel: Column) -> Column:
    return F.when(channel.between(1, 14), "2.4GHz").otherwise("5GHz")


def hash_mac(mac: Column) -> Column:
    """First two and last two characters around a mask."""
    masked = F.concat(F.substring(mac, 1, 2), F.lit("***"), F.right(mac, F.lit(2)))
    return F.when(F.length(mac) >= 4, masked).otherwise("invalid")


def sanitize(message: Column) -> Column:
    """One-line text; NULL becomes empty."""
    return F.coalesce(F.translate(message, "\n\r", "  "), F.lit(""))


def is_blank(value: Column) -> Column:
    """NULL, empty or whitespace only."""
    return F.coalesce(value.rlike(r"^\s*$"), F.lit(True))


def is_valid_topic(topic: Column) -> Column:
    return F.coalesce(topic.rlike(TOPIC_PATTERN) & ~topic.isin(".", ".."), F.lit(False))


def is_allowed_reply_topic(topic: Column) -> Column:
    return F.coalesce(topic.isin(*REPLY_TOPICS) | topic.startswith(INBOX_PREFIX), F.lit(False))


def reply_topic(requested: Column, default: Column | str) -> Column:
    """The requested topic when it is well formed and allowed, else the default."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.when(is_valid_topic(requested) & is_allowed_reply_topic(requested), requested).otherwise(fallback)


def error_class(sqlstate: Column, code: Column, message: Column, transient: Column | None = None) -> Column:
    """``retryable`` or ``permanent`` from SQLSTATE, vendor code and message of a failure."""
    state = F.upper(sqlstate)
    tests = [state.startswith(p) for p in RETRYABLE_STATE_PREFIXES]
    tests += [state.isin(*RETRYABLE_STATES), F.abs(code).isin(*RETRYABLE_CODES)]
    tests += [F.lower(message).contains(word) for word in RETRYABLE_WORDS]
    if transient is not None:
        tests.append(transient)
    hit = F.lit(False)
    for test in tests:
        hit = hit | F.coalesce(test, F.lit(False))
    return F.when(hit, "retryable").otherwise("permanent")


def chain_error_class(failures: Column) -> Column:
    """Class of a cause chain given as ``array<struct<sqlstate, code, message, transient>>``."""
    hit = F.exists(
        failures,
        lambda f: error_class(f["sqlstate"], f["code"], f["message"], f["transient"]) == "retryable",
    )
    return F.when(F.coalesce(hit, F.lit(False)), "retryable").otherwise("permanent")


def clock_text(value: Column) -> Column:
    """ISO-8601 text with a Z suffix of a UTC NTZ timestamp."""
    return F.concat(F.replace(value.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
