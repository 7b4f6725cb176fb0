"""JSON events on the wire: encode (Kafka sink rows), decode, validate.

Decoding uses Spark's VARIANT type (``try_parse_json``): it keeps each
field's JSON token type, so "missing key", "JSON null", "number" and
"text" can be told apart with built-in expressions - the same distinctions
the two rule sets below depend on:

* **strict** (the ingest contract, V1-V5): typed fields, the five event types,
  defaults for an absent ``event_id`` / ``quantity`` / ``timestamp`` /
  ``metadata``, unknown fields dropped; a bad record goes to the reject
  channel with its reasons instead of failing the job.
* **lenient** (the processor's reading, V6/T6/T7): every key has a default;
  price/quantity are converted the way Python's ``float()`` / ``int()``
  would, and an unconvertible value marks the row (amount null) instead of
  stopping the stream.  Unparseable JSON goes to the reject channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType

from ..schema import EVENT_TYPES, UNKNOWN

WIRE_FIELDS = ("event_id", "event_type", "user_id", "product_id", "product_name",
               "price", "quantity", "timestamp", "metadata")


# ---------------------------------------------------------------------------
# Encoding (S3 / P11)
# ---------------------------------------------------------------------------
def iso_text(ts: Column, ntz: bool = True) -> Column:
    """Python ``datetime.isoformat()``: fraction only when microseconds != 0."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.regexp_replace(full, r"\.000000$", "")
    return text if ntz else F.concat(text, F.lit("+00:00"))


def to_wire(events: DataFrame) -> DataFrame:
    """Kafka sink rows: ``key`` = user id, ``value`` = the event as JSON text.

    Field order and null handling follow the producer (``json.dumps`` of the
    event model: nulls are written, timestamps in ISO form).
    """
    ntz = isinstance(events.schema["ts"].dataType, TimestampNTZType)
    body = F.struct(
        F.col("event_id"), F.col("event_type"), F.col("user_id"), F.col("product_id"),
        F.col("product_name"), F.col("price"), F.col("quantity"),
        iso_text(F.col("ts"), ntz).alias("timestamp"),
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    return events.select(F.col("user_id").alias("key"),
                         F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


# ---------------------------------------------------------------------------
# Decoding helpers
# ---------------------------------------------------------------------------
# Decoding runs as staged projections: parse once, then read every field's
# token kind once, then derive typed values and reasons from those columns.
# (Expressions referenced several times are not inlined across projections,
# so each variant lookup is evaluated once per row.)

def _kind_col(name: str) -> str:
    return f"_k_{name}"


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _decoded(raw: DataFrame, value_col: str) -> DataFrame:
    """Stage 1 + 2: ``_v`` (VARIANT or null), ``_top`` (its kind) and, per wire
    field, ``_k_<field>``: NULL when absent, 'VOID' for JSON null, else the
    token kind ('STRING', 'BIGINT', 'DECIMAL(p,s)', 'DOUBLE', 'BOOLEAN', 'OBJECT<..>', ...).

    Row-local: no shuffle, and the input is never looked at to plan it.  A
    JSON object that repeats a key is read with its last value where the
    session sets ``spark.sql.variant.allowDuplicateKeys`` (see ``session``).
    The bare tokens NaN and Infinity are no JSON: such rows are rejected."""
    parsed = raw.withColumn("_v", F.try_parse_json(F.col(value_col)))
    v = F.col("_v")
    return parsed.select(
        "*",
        F.schema_of_variant(v).alias("_top"),
        *[F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")).alias(_kind_col(f))
          for f in WIRE_FIELDS],
    )


def _is_object() -> Column:
    return F.coalesce(F.col("_top").startswith("OBJECT"), F.lit(False))


def _get(name: str, type_: str) -> Column:
    return F.try_variant_get(F.col("_v"), f"$.{name}", type_)


_WHOLE = ("BIGINT", "INT", "SMALLINT", "TINYINT")
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _micros_after_epoch(micros: Column) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) of epoch microseconds; no session time zone involved."""
    return F.expr(_EPOCH) + F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def _utc_wall(instant: Column) -> Column:
    """UTC wall time of an instant, whatever the session time zone."""
    return _micros_after_epoch(F.unix_micros(instant))


def _time(name: str, kind: Column) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) of a JSON timestamp, else null.

    ISO-8601 text with a zone is converted to UTC, without one it is taken as
    UTC; numbers, and text that is a number, are epoch seconds, or
    milliseconds beyond 2e10 (as the model layer reads them).
    """
    text = F.trim(_get(name, "string"))
    zoned = text.rlike(r"(?i)(Z|[+-]\d{2}:?(\d{2})?)$") & text.rlike(r"[T ]\d")
    number = F.when(_is_number(kind) | (kind == "STRING"), text.try_cast("double"))
    micros = (number * F.when(F.abs(number) > 2e10, 1_000).otherwise(1_000_000)).try_cast("bigint")
    return (F.when(number.isNotNull(), _micros_after_epoch(micros))
            .when(kind == "STRING", F.when(zoned, _utc_wall(text.try_cast("timestamp")))
                  .otherwise(text.try_cast("timestamp_ntz"))))


# ---------------------------------------------------------------------------
# Strict rules (V1-V5)
# ---------------------------------------------------------------------------
def _strict_typed(dec: DataFrame) -> DataFrame:
    """Stage 3: typed values (null when unusable) next to the kinds."""
    k = {f: F.col(_kind_col(f)) for f in WIRE_FIELDS}

    def text(name: str) -> Column:
        return F.when(k[name] == "STRING", _get(name, "string"))

    pk, qk, tk, mk = k["price"], k["quantity"], k["timestamp"], k["metadata"]
    q_num = _get("quantity", "double")
    q_text = _get("quantity", "string")
    return dec.select(
        "*",
        F.when(k["event_id"].isNull(), F.expr("uuid()")).otherwise(text("event_id")).alias("_event_id"),
        text("event_type").alias("_event_type"),
        text("user_id").alias("_user_id"),
        text("product_id").alias("_product_id"),
        text("product_name").alias("_product_name"),
        # price: a JSON number, true / false (1 / 0), or text that reads as a number
        F.when(_is_number(pk), _get("price", "double"))
        .when(pk == "BOOLEAN", _get("price", "boolean").cast("double"))
        .when(pk == "STRING", _get("price", "string").try_cast("double")).alias("_price"),
        # quantity: an integer, a number without fraction, or integer text; default 1
        F.when(qk.isNull(), F.lit(1))
        .when(qk.isin(*_WHOLE), _get("quantity", "bigint"))
        .when(_is_number(qk) & (q_num == F.floor(q_num)), q_num.try_cast("bigint"))
        .when((qk == "STRING") & q_text.rlike(r"^\s*[-+]?\d+\s*$"), F.trim(q_text).try_cast("bigint"))
        .alias("_quantity"),
        # timestamp: ISO-8601 text (zone honoured, kept as UTC wall time) or epoch number; default now
        F.when(tk.isNull(), _utc_wall(F.current_timestamp()))
        .otherwise(_time("timestamp", tk)).alias("_ts"),
        # metadata: an object (values kept as text); null or absent -> empty
        F.when(mk.isNull() | (mk == "VOID"), F.create_map().cast("map<string,string>"))
        .when(mk.startswith("OBJECT"), _get("metadata", "map<string,string>")).alias("_metadata"),
    )


def _reasons() -> Column:
    """Comma-separated reasons ('' = valid), from the stage-3 columns."""
    k = {f: F.col(_kind_col(f)) for f in WIRE_FIELDS}
    parts = []
    for name in ("event_id", "event_type", "user_id", "product_id", "product_name"):
        if name == "event_id":
            parts.append(F.when(k[name].isNotNull() & (k[name] != "STRING"), F.lit("invalid_event_id")))
            continue
        parts.append(F.when(k[name].isNull(), F.lit(f"missing_{name}"))
                     .when(k[name] != "STRING", F.lit(f"invalid_{name}")))
        if name == "event_type":
            parts.append(F.when((k[name] == "STRING") & ~F.col("_event_type").isin(*EVENT_TYPES),
                                F.lit("invalid_event_type_value")))
    parts.append(F.when(k["price"].isNull(), F.lit("missing_price"))
                 .when(F.col("_price").isNull(), F.lit("invalid_price")))
    parts.append(F.when(F.col("_quantity").isNull(), F.lit("invalid_quantity")))
    parts.append(F.when(F.col("_ts").isNull(), F.lit("invalid_timestamp")))
    parts.append(F.when(F.col("_metadata").isNull(), F.lit("invalid_metadata")))
    return F.when(~_is_object(), F.lit("malformed_json")).otherwise(F.concat_ws(",", *parts))


def validate_strict(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Typed canonical columns plus ``reasons`` (comma separated; '' = valid).

    The result carries observed metrics (``strict_validation``: records,
    rejected).  The observation also keeps a later ``where`` on ``reasons``
    above the decode, instead of being inlined into every field lookup.
    """
    typed = _strict_typed(_decoded(raw, value_col))
    checked = typed.select(
        F.col(value_col).alias("raw_value"),
        F.col("_event_id").alias("event_id"), F.col("_event_type").alias("event_type"),
        F.col("_user_id").alias("user_id"), F.col("_product_id").alias("product_id"),
        F.col("_product_name").alias("product_name"), F.col("_price").alias("price"),
        F.col("_quantity").alias("quantity"), F.col("_ts").alias("ts"),
        F.col("_metadata").alias("metadata"),
        _reasons().alias("reasons"),
    )
    return checked.observe("strict_validation", F.count(F.lit(1)).alias("records"),
                           F.count_if(F.col("reasons") != "").alias("rejected"))


def valid_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """V1-V4: the records that pass the ingest contract, in canonical form."""
    checked = validate_strict(raw, value_col)
    return checked.where(F.col("reasons") == "").drop("raw_value", "reasons")


def rejected_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """V5: the reject channel - original text and every reason, comma separated."""
    checked = validate_strict(raw, value_col)
    return checked.where(F.col("reasons") != "").select("raw_value", "reasons")


# ---------------------------------------------------------------------------
# Lenient rules
# ---------------------------------------------------------------------------
def _py_float(name: str) -> Column:
    """Python ``float(x)``: numbers, booleans, numeric text; else null (error)."""
    kind = F.col(_kind_col(name))
    return (F.when(_is_number(kind), _get(name, "double"))
            .when(kind == "BOOLEAN", _get(name, "boolean").cast("double"))
            .when(kind == "STRING", F.trim(_get(name, "string")).try_cast("double")))


def _py_int(name: str) -> Column:
    """Python ``int(x)``: numbers truncate toward zero, integer text parses; else null."""
    kind = F.col(_kind_col(name))
    text = F.trim(_get(name, "string"))
    return (F.when(kind.isin(*_WHOLE), _get(name, "bigint"))
            .when(_is_number(kind), _get(name, "double").try_cast("bigint"))
            .when(kind == "BOOLEAN", _get(name, "boolean").cast("bigint"))
            .when((kind == "STRING") & text.rlike(r"^[-+]?\d+$"), text.try_cast("bigint")))


def _text_or(name: str, default: str) -> Column:
    """Text of a field; a missing key and a JSON null both take ``default``."""
    return F.coalesce(_get(name, "string"), F.lit(default))


def decode(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse once: the raw rows plus the VARIANT and token-kind columns that
    ``lenient_from_decoded`` and ``rejects_from_decoded`` read."""
    return _decoded(raw, value_col)


# when a row arrived, from where, and its place there
ARRIVAL = ("arrived", "arrived_from", "arrived_at")


def with_arrival(raw: DataFrame) -> DataFrame:
    """Raw rows of a batch with the ``ARRIVAL`` columns, as far as the source tells them."""
    have = set(raw.columns)
    if {"timestamp", "partition", "offset"} <= have:                 # Kafka
        return raw.withColumns({"arrived": F.col("timestamp"), "arrived_from": F.col("partition").cast("string"),
                                "arrived_at": F.col("offset")})
    out = raw if "arrived" in have else raw.withColumns(
        {"arrived": F.current_timestamp(), "arrived_from": F.lit("")})
    return out.withColumn("arrived_at", F.monotonically_increasing_id())      # in a file, rows keep their order


def lenient_from_decoded(dec: DataFrame, arrival: str | None = None, keep=()) -> DataFrame:
    """Canonical events from decoded rows (JSON objects only).

    A missing ``event_id`` stays null (only the feed prints ``unknown``):
    events without an id are different events.  A missing or unreadable
    timestamp becomes the arrival time: the column named by ``arrival``, or
    the time of the query.
    """
    pk, qk = F.col(_kind_col("price")), F.col(_kind_col("quantity"))
    if arrival is not None and isinstance(dec.schema[arrival].dataType, TimestampNTZType):
        arrived = F.col(arrival)
    else:
        arrived = _utc_wall(F.current_timestamp() if arrival is None else F.col(arrival))
    return dec.where(_is_object()).select(
        _get("event_id", "string").alias("event_id"),
        _text_or("event_type", UNKNOWN).alias("event_type"),
        _text_or("user_id", UNKNOWN).alias("user_id"),
        _get("product_id", "string").alias("product_id"),
        _get("product_name", "string").alias("product_name"),
        F.when(pk.isNull(), F.lit(0.0)).otherwise(_py_float("price")).alias("price"),
        F.when(qk.isNull(), F.lit(1)).otherwise(_py_int("quantity")).alias("quantity"),
        F.coalesce(_time("timestamp", F.col(_kind_col("timestamp"))),
                   arrived).alias("ts"),
        _get("metadata", "map<string,string>").alias("metadata"), *keep,
    )


def rejects_from_decoded(dec: DataFrame, value_col: str = "value") -> DataFrame:
    """The decoded rows that are not a JSON object."""
    return (dec.where(~_is_object())
            .select(F.col(value_col).alias("raw_value"), F.lit("malformed_json").alias("reasons")))


def parse_lenient(raw: DataFrame, value_col: str = "value", arrival: str | None = None) -> DataFrame:
    """Canonical events the way the processor reads them.

    Missing keys take their defaults (type/user 'unknown', price 0,
    quantity 1); a present-but-unconvertible price or quantity gives a null
    (the event still counts, but adds no revenue, product or feed row).
    Rows that are not a JSON object are dropped here; see ``lenient_rejects``.
    """
    dec = _decoded(raw, value_col).observe(
        "lenient_decode", F.count(F.lit(1)).alias("records"), F.count_if(~_is_object()).alias("malformed"))
    return lenient_from_decoded(dec, arrival or ("arrived" if "arrived" in raw.columns else None))


def lenient_rejects(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Messages that are not a JSON object, kept instead of killing the stream."""
    parsed = raw.withColumn("_top", F.schema_of_variant(F.try_parse_json(F.col(value_col))))
    return rejects_from_decoded(parsed, value_col)


# ---------------------------------------------------------------------------
# Sources / sinks
# ---------------------------------------------------------------------------
def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 batch: one JSON event per line, kept as text in ``value``."""
    return spark.read.text(path)


def stream_json_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = 100) -> DataFrame:
    """S1 stream: new JSON-lines files in a folder, as ``value`` text with the
    file's time and name; a trigger takes at most ``max_files_per_trigger``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path).select("value", F.col("_metadata.file_modification_time").alias("arrived"),
                                    F.col("_metadata.file_path").alias("arrived_from"))


def read_kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True,
               starting_offsets: str = "earliest", max_offsets_per_trigger: int | None = 1_000_000) -> DataFrame:
    """Kafka records as ``(key, value)`` text, earliest offsets first; a
    trigger takes at most ``max_offsets_per_trigger``.

    Needs the spark-sql-kafka connector on the classpath; it is not bundled.
    """
    reader = spark.readStream if stream else spark.read
    df = (reader.format("kafka").option("kafka.bootstrap.servers", servers)
          .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if stream and max_offsets_per_trigger:
        df = df.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    df = df.load()
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                     "topic", "partition", "offset", "timestamp")


def write_kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str):
    """S3: publish ``(key, value)`` rows (see ``to_wire``) with acks=all."""
    return (rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("kafka.acks", "all").option("topic", topic)
            .option("checkpointLocation", checkpoint).start())
