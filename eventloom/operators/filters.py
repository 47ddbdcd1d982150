"""Row predicates of the ledger, the detection and the message paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_mac, reply_topic
from ..functions.timestamps import seconds_before
from ..schemas import KNOWN_ORIGINS


def origin_error(origin: Column, known: Iterable[str] = KNOWN_ORIGINS) -> Column:
    """Message for an origin outside the registry (compared without case), else NULL."""
    names = [k.lower() for k in known]
    text = F.concat(F.lit("unknown origin '"), origin, F.lit(f"' not in known origins: {', '.join(names)}"))
    return F.when(~F.lower(origin).isin(*names), text)


def filter_origin(df: DataFrame, known: Iterable[str] = KNOWN_ORIGINS, origin: str = "origin") -> DataFrame:
    return df.filter(origin_error(F.col(origin), known).isNull())


def filter_claimable(ledger: DataFrame, streams: Iterable[str], max_attempts: int, backoff_seconds: int, as_of) -> DataFrame:
    """Events that may be claimed: pending, or failed long enough ago, with attempts left."""
    waited = F.col("updated_at") <= seconds_before(as_of, max(backoff_seconds, 1))
    return ledger.filter(
        F.col("status").isin("pending", "failed")
        & F.col("stream_name").isin(*streams)
        & (F.col("attempt_count") < max_attempts)
        & ((F.col("status") == "pending") | waited)
    )


def filter_pending(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status").isin("pending", "processing"))


def filter_mac_valid(df: DataFrame, mac: str = "source_mac") -> DataFrame:
    return df.filter(is_mac(F.col(mac)))


def filter_recent_strong(
    df: DataFrame, as_of, window_seconds: int = 60, signal_threshold: int = -50, payload: str | None = "payload"
) -> DataFrame:
    """Frames seen within the look-back whose signal reaches the threshold."""
    hit = (F.col("observed_at") >= seconds_before(as_of, window_seconds)) & (F.col("signal_dbm") >= signal_threshold)
    return df.filter(hit if payload is None else hit & F.col(payload).isNotNull())


def filter_scan_valid(df: DataFrame) -> DataFrame:
    return df.filter(~is_blank(F.col("dedupe_key")) & ~is_blank(F.col("payload_ref")))


def filter_threshold(windows: DataFrame) -> DataFrame:
    return windows.filter(F.col("threshold_exceeded") != 0)


def filter_enabled_networks(networks: DataFrame) -> DataFrame:
    return networks.filter(F.col("enabled"))


def filter_reply_topic(requests: DataFrame, default: str, requested: str = "reply_topic") -> DataFrame:
    """Add ``topic``: where the reply to each request goes."""
    return requests.withColumn("topic", reply_topic(F.col(requested), default))
