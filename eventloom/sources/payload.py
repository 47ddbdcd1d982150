"""Payload references -> payload text -> one row per JSON element."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_fields as J
from ..functions.hashing import INLINE_PREFIX, base64url_decode
from ..session import durable, run_folder

OUTBOX_PREFIX = "outbox://"
GLOB_CHARACTERS = r"[\\{}*?\[\]^]"  # of a path pattern
PASS_FOLDERS, PASS_FILES = 20_000, 10_000

# fixed values: texts that consumers of the error messages know
EMPTY_PAYLOAD = "payload_ref resolved an empty JSON payload"
NOT_JSON_PAYLOAD = "payload_ref resolved non-JSON payload"
BAD_BASE64 = "payload_ref is not valid base64"
BLANK_OUTBOX = "invalid blank outbox path"
ESCAPING_OUTBOX = "invalid outbox path escapes base"
UNREADABLE_OUTBOX = "outbox payload read failed"
PROBES_MISSING = "wireless probe payload must contain a probes array"
PROBES_NOT_ARRAY = "wireless probe payload: 'probes' must be an array"
CLIENTS_MISSING = "wireless client inventory payload must contain a clients array"
CLIENTS_NOT_ARRAY = "wireless client inventory: 'clients' must be an array"
CLIENT_NOT_OBJECT = "wireless client inventory: each client must be a JSON object"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column as a generator's output, so that filters moved below it do not compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _document(df: DataFrame) -> DataFrame:
    """Add ``document``, the parsed payload: the one parse that all later steps share."""
    return _once(df, "document", J.parse_json(F.col("payload")))


def document_error(document: Column) -> Column:
    """Why a payload cannot be used, else NULL."""
    return F.when(document.isNull(), NOT_JSON_PAYLOAD).when(F.is_variant_null(document), EMPTY_PAYLOAD)


def payload_inline(df: DataFrame, ref: str = "payload_ref") -> DataFrame:
    """Decode ``inline://json/<base64url>``: adds ``payload``, ``document``, ``payload_error``."""
    body = F.substr(F.col(ref), F.lit(len(INLINE_PREFIX) + 1))
    inline = F.coalesce(F.col(ref).startswith(INLINE_PREFIX), F.lit(False))
    outbox = F.coalesce(F.col(ref).startswith(OUTBOX_PREFIX), F.lit(False))
    unsupported = F.concat(F.lit("unsupported payload_ref scheme: "), F.coalesce(F.col(ref), F.lit("")))
    out = _document(_once(df, "payload", F.when(inline, base64url_decode(body))))
    error = (
        F.when(~inline & ~outbox, unsupported)
        .when(inline & F.col("payload").isNull(), BAD_BASE64)
        .when(inline, document_error(F.col("document")))
    )
    return out.withColumns({"payload_error": error, "payload_retryable": F.lit(False)})


def outbox_path(ref: Column) -> Column:
    """Normalised relative path of an outbox reference: ``.`` and empty steps removed."""
    relative = F.substr(ref, F.lit(len(OUTBOX_PREFIX) + 1))
    steps = F.filter(F.split(relative, "/"), lambda s: ~s.isin("", "."))
    # each ".." takes back the step before it; one that has nothing to take back stays
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda path, step: F.when(
            (step == "..") & (F.size(path) > 0) & (F.element_at(F.concat(F.array(F.lit("")), path), -1) != ".."),
            F.slice(path, F.lit(1), F.size(path) - 1),
        ).otherwise(F.concat(path, F.array(step))),
    )
    return F.array_join(walked, "/")


def outbox_error(ref: Column) -> Column:
    """Why an outbox path is refused, else NULL."""
    relative = F.substr(ref, F.lit(len(OUTBOX_PREFIX) + 1))
    clean = outbox_path(ref)
    return F.when(F.trim(relative) == "", BLANK_OUTBOX).when(
        relative.startswith("/") | clean.isin("..", "") | clean.startswith("../"), ESCAPING_OUTBOX
    )


def _outbox_files(spark: SparkSession, base: str, folders: set[str]) -> DataFrame | None:
    """Scan of the files below those of ``folders`` that ``base`` has; it opens a file for its ``content`` only."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    store, root = path(base).getFileSystem(conf), base.rstrip("/")
    named = sorted(folders)
    with ThreadPoolExecutor(16) as threads:  # one look-up at the store each
        there = threads.map(lambda folder: store.exists(path(f"{root}/{folder}")), named)
        literal = [f"{root}/{re.sub(GLOB_CHARACTERS, _escaped, f)}" for f, found in zip(named, there) if found]
    if not literal:
        return None
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(literal)


def _escaped(character: re.Match) -> str:
    return "\\" + character[0]


def _outbox_texts(spark: SparkSession, base: str, paths: DataFrame) -> DataFrame | None:
    """``_path`` and ``_text`` of the files of ``paths`` (``_path, _folder``) that ``base`` has; the last pass is read in place, others are stored."""
    root, store, passed, last = base.split(":", 1)[-1].rstrip("/"), run_folder(spark, "outbox-texts"), False, None
    passes = max(1, -(-paths.select("_folder").distinct().count() // PASS_FOLDERS))
    uri = F.col("_metadata.file_path")
    below = F.substring_index(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), f"{root}/", -1)
    for n in range(passes):
        mine = paths.filter(F.pmod(F.xxhash64("_folder"), F.lit(passes)) == n)
        files = _outbox_files(spark, base, {r[0] for r in mine.select("_folder").distinct().collect()})
        if files is None:
            continue
        named = files.select(uri.alias("_uri"), below.alias("_path")).join(mine, "_path", "left_semi").select("_uri")
        matched = [_literal(r["_uri"]) for r in named.collect()]
        for start in range(0, max(1, len(matched)), PASS_FILES):
            if last is not None:
                last.write.mode("append").option("compression", "none").parquet(store)  # the planner goes by their size
                passed = True
            # a condition on the path alone leaves the other files out of the scan before any task is made
            listed = ", ".join(matched[start : start + PASS_FILES])
            wanted = F.expr(f"_metadata.file_path IN ({listed})") if listed else F.lit(False)
            last = files.filter(wanted).select(below.alias("_path"), F.col("content").cast("string").alias("_text"))
    return last.unionByName(spark.read.schema(last.schema).parquet(store)) if passed else last


def payload_outbox(df: DataFrame, base: str, ref: str = "payload_ref") -> DataFrame:
    """Join ``outbox://<relative>`` references with the files under ``base``.

    The folders directly below ``base`` that a reference names are listed, however many they are; then the paths
    of their files are matched with the references, and only matched files are opened, as whole texts.  No path
    outside ``base`` can match, but a symbolic link inside it is followed.  A reference whose file is missing is
    retryable.  About ``PASS_FOLDERS`` folders and at most ``PASS_FILES`` matched paths pass the driver at a time,
    and the texts of a pass are stored before the next one, so it holds the paths of a pass only.  Lay an outbox out by day or
    batch, so that few folders are listed.
    """
    spark = df.sparkSession
    allowed = df.filter(F.col(ref).isNotNull() & outbox_error(F.col(ref)).isNull())
    paths = allowed.select(outbox_path(F.col(ref)).alias("_path")).distinct()
    paths = durable(paths.withColumn("_folder", F.split("_path", "/")[0]))
    refs = df.withColumns({"_path": outbox_path(F.col(ref)), "_refused": outbox_error(F.col(ref))})
    texts = _outbox_texts(spark, base, paths)
    if texts is None:
        joined = refs.withColumn("_text", F.lit(None).cast("string"))
    else:
        joined = refs.join(texts, "_path", "left")
    joined = _document(joined.withColumn("payload", F.when(F.col("_refused").isNull(), F.col("_text"))))
    error = F.coalesce(
        F.col("_refused"), F.when(F.col("_text").isNull(), UNREADABLE_OUTBOX), document_error(F.col("document"))
    )
    return joined.select(
        *df.columns,
        "payload",
        "document",
        error.alias("payload_error"),
        (F.col("_refused").isNull() & F.col("_text").isNull()).alias("payload_retryable"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def resolve_payload(df: DataFrame, outbox_base: str | None = None, ref: str = "payload_ref") -> DataFrame:
    """Resolve every reference: inline ones from their own text, outbox ones from files."""
    inline = payload_inline(df, ref)
    if outbox_base is None:
        return inline
    is_outbox = F.coalesce(F.col(ref).startswith(OUTBOX_PREFIX), F.lit(False))
    read = payload_outbox(df.filter(is_outbox), outbox_base, ref)
    return inline.filter(~is_outbox).unionByName(read)


def explode_rows(df: DataFrame, elements: Column, text: Column | None) -> DataFrame:
    """One row per element: ``pos``, ``row`` (VARIANT) and ``raw``.

    ``raw`` is the element's compact text with its key order, which a VARIANT
    does not keep; it costs a second pass over ``text`` and is NULL without one.
    """
    kept = [c for c in df.columns if c not in ("document", "payload", "payload_ref")]
    if text is None:
        out = df.select(*kept, F.posexplode(elements).alias("pos", "row"))
        return out.withColumn("raw", F.lit(None).cast("string"))
    places = F.sequence(F.lit(0), F.size(elements) - 1)
    texts = F.from_json(text, "array<string>")
    zipped = F.arrays_zip(places.alias("pos"), elements.alias("row"), texts.alias("raw"))
    return df.filter(F.size(elements) > 0).select(*kept, F.inline(zipped).alias("pos", "row", "raw"))


def _as_array(document: Column, path: str = "$") -> Column:
    return F.try_variant_get(document, path, "array<variant>")


def payload_rows(df: DataFrame, raw: bool = True) -> DataFrame:
    """Rows of a payload: the elements of an array, else the value itself."""
    text, document = F.col("payload"), F.col("document")
    listed = text.rlike(r"^\s*\[")
    elements = F.when(listed, _as_array(document)).otherwise(F.array(document))
    array_text = F.when(listed, text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return explode_rows(df, elements, array_text if raw else None)


def member_error(document: Column, member: str, absent: str, not_array: str) -> Column:
    """Why the rows of a payload cannot be listed, else NULL."""
    return F.when(J.field(document, member).isNull(), absent).when(
        _as_array(document, f"$.{member}").isNull(), not_array
    )


def payload_rows_probes(df: DataFrame) -> DataFrame:
    """Rows of the ``probes`` array. Payloads without one give no rows; see ``rows_error``."""
    return explode_rows(df, _as_array(F.col("document"), "$.probes"), None)


def client_inventory_merge(df: DataFrame) -> DataFrame:
    """Rows of the ``clients`` array with the parent's sensor, location and snapshot time set on each.

    A parent field wins over the client's own, also when it is an explicit null;
    the three merged fields are in ``head``, the client's others in ``row``.
    ``row_error`` marks clients that are not objects.
    """
    document = F.col("document")
    snapshot = F.coalesce(J.field(document, "snapshot_at"), J.field(document, "observed_at"))
    base = df.withColumns(
        {"_sensor": J.field(document, "sensor_id"), "_location": J.field(document, "location_id"), "_snapshot": snapshot}
    )
    rows = explode_rows(base, _as_array(document, "$.clients"), None)
    r = F.col("row")
    head = F.struct(
        F.coalesce("_sensor", J.field(r, "sensor_id")).alias("sensor_id"),
        F.coalesce("_location", J.field(r, "location_id")).alias("location_id"),
        F.coalesce("_snapshot", J.field(r, "snapshot_at")).alias("snapshot_at"),
    )
    return rows.withColumns(
        {"head": F.to_variant_object(head), "row_error": F.when(~J.is_object(r), CLIENT_NOT_OBJECT)}
    ).drop("_sensor", "_location", "_snapshot")


def rows_error(target: Column, document: Column) -> Column:
    """Payload-level error of the row listing for a target, else NULL."""
    return F.when(
        target == "wireless.probe.flush", member_error(document, "probes", PROBES_MISSING, PROBES_NOT_ARRAY)
    ).when(
        target == "wireless.client.inventory", member_error(document, "clients", CLIENTS_MISSING, CLIENTS_NOT_ARRAY)
    )


# Targets whose rows store their text or hash it.
RAW_TARGETS = (
    "proxy.events",
    "proxy.payload_audit",
    "wireless.audit",
    "wireless.alert.rogue_ap",
    "wireless.alert.deauth_flood",
)


def rows_for_target(df: DataFrame, target: str) -> DataFrame:
    """Rows of resolved payloads of one target."""
    if target == "wireless.probe.flush":
        return payload_rows_probes(df)
    if target == "wireless.client.inventory":
        return client_inventory_merge(df)
    return payload_rows(df, raw=target in RAW_TARGETS)
