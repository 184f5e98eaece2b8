"""Span files: the plain dialect {"spans": [...]} and OTLP JSON {"resourceSpans": [...]}, parsed by Catalyst alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import first_nonblank, last_wins, let, map_over, strip

_ROW = "array<map<string,string>>"  # nested values come as their JSON text
PLAIN = f"struct<spans: {_ROW}>"
_SCOPES = f"array<struct<spans: {_ROW}>>"
OTLP = f"struct<resourceSpans: array<struct<resource: struct<attributes: string>, scopeSpans: {_SCOPES}, instrumentationLibrarySpans: {_SCOPES}>>>"

#: Ranges of file names, and the bits of seq for a file within its range and for a span within its file: 6 + 27 + 30 are 63.
PARTS, ROW_BITS, AT_BITS = 64, 27, 30

# Attributes that a plain span may give at its top level, and the names they may have there.
SHORTCUTS = (
    ("http.request.method", ("http.request.method", "http.method", "method")),
    ("http.route", ("http.route", "route")),
    ("http.target", ("http.target", "target")),
    ("url.path", ("url.path", "path")),
    ("messaging.system", ("messaging.system",)),
    ("messaging.destination", ("messaging.destination", "messaging.destination.name", "topic")),
    ("messaging.operation", ("messaging.operation", "operation")),
    ("rpc.system", ("rpc.system", "protocol")),
    ("rpc.method", ("rpc.method",)),
)


def span_kind(c: Column) -> Column:
    """1 to 5 or their names; other numbers are internal, other text stays as it is. Enum names count as their kind."""
    k = F.regexp_replace(F.lower(strip(c)), "^span_kind_", "")
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("1", "internal"), ("2", "server"), ("3", "client"), ("4", "producer"), ("5", "consumer"), ("", "internal"), ("unspecified", "internal")) for x in p]), k), k)
    return F.when(named.rlike(r"^[+-]?\d+$"), "internal").otherwise(named)


def time_ns(*columns: Column) -> Column:
    """Epoch nanoseconds of the first that is an integer or an RFC 3339 time with up to nine decimals; 0 and other text are absent."""
    def one(c: Column) -> Column:
        shape = r"^(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:[.,](\d{1,9}))?([Zz]|[+-]\d\d:\d\d)$"

        def read(x: Column) -> Column:
            whole = F.unix_seconds(F.try_to_timestamp(F.concat(F.regexp_extract(x, shape, 1), F.lit("T"), F.regexp_extract(x, shape, 2), F.upper(F.regexp_extract(x, shape, 4)))))
            return F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("bigint")).when(x.rlike(shape), whole * 1_000_000_000 + F.rpad(F.regexp_extract(x, shape, 3), 9, "0").cast("bigint"))

        return let(strip(c), read)

    return F.nullif(F.coalesce(*[one(c) for c in columns]), F.lit(0).cast("bigint"))


def otlp_value(c: Column) -> Column:
    """The text of a typed value, unwrapped through up to three levels."""
    names = ("stringValue", "intValue", "doubleValue", "boolValue", "value")
    for _ in range(3):
        c = let(c, lambda x: F.when(x.startswith("{"), F.coalesce(*[F.from_json(x, "map<string,string>")[n] for n in names], x)).otherwise(x))
    return c


def otlp_attributes(c: Column) -> Column:
    """A list of {key, value}, of which the last of a key counts, or a plain object, as a map."""
    def pairs(x: Column) -> Column:
        entries = F.filter(F.from_json(x, "array<struct<key: string, value: string>>"), lambda e: (strip(e["key"]) != "") & e["value"].isNotNull())
        return last_wins(F.transform(entries, lambda e: F.named_struct(F.lit("key"), strip(e["key"]), F.lit("value"), otlp_value(e["value"]))))

    return let(c, lambda x: F.when(x.startswith("["), pairs(x)).when(x.startswith("{"), F.from_json(x, "map<string,string>")))


def _otlp_items(resources: Column) -> Column:
    """All spans of a document in their order, as (shared, span); shared: the attributes of the span's resource."""
    filled = lambda arrays: F.flatten(F.filter(arrays, lambda x: x.isNotNull()))  # noqa: E731  flatten() is null if any array is

    def of_resource(r: Column) -> Column:
        scopes = F.coalesce(r["scopeSpans"], r["instrumentationLibrarySpans"])
        return let(otlp_attributes(r["resource"]["attributes"]), lambda shared: filled(F.transform(scopes, lambda c: F.transform(c["spans"], lambda s: F.struct(shared.alias("shared"), s.alias("span"))))))

    return filled(F.transform(resources, of_resource))


def _items(value: Column) -> Column:
    """All spans of a document of either dialect in their order, as (plain, shared, span); null for other documents. Each dialect is tried once."""
    nothing = F.lit(None).cast("map<string,string>")
    item = lambda plain, shared, span: F.struct(F.lit(plain).alias("plain"), shared.alias("shared"), span.alias("span"))

    def of_otlp(doc: Column) -> Column:
        return F.transform(_otlp_items(doc["resourceSpans"]), lambda x: item(False, x["shared"], x["span"]))

    return let(F.from_json(value, PLAIN), lambda doc: F.when(doc["spans"].isNotNull(), F.transform(doc["spans"], lambda s: item(True, nothing, s))).otherwise(let(F.from_json(value, OTLP), of_otlp)))


def _spans(files: DataFrame) -> DataFrame:
    """(file, at, ...span) of (file, value) rows, in one pass over the documents.

    Plain spans may give attributes at their top level; an OTLP span's attributes override its resource's, the service name too.
    """
    rows = files.select("file", F.posexplode(_items(F.col("value"))).alias("at", "item")).select("file", F.col("at").cast("bigint").alias("at"), "item.*").where("span is not null")
    s = F.col("span")
    either = lambda plain, other: F.when(F.col("plain"), plain).otherwise(other)
    got = lambda *names: first_nonblank(*[s[n] for n in names])
    swapped = lambda one, two: (either(s[one], s[two]), either(s[two], s[one]))  # noqa: E731  a plain span's `one` comes first, of the others `two`
    given = F.map_from_entries(F.filter(F.array(*[F.named_struct(F.lit("key"), F.lit(k), F.lit("value"), got(*names)) for k, names in SHORTCUTS]), lambda e: e["value"] != ""))
    rows = rows.withColumn("attributes", map_over(either(given, F.col("shared")), either(F.from_json(s["attributes"], "map<string,string>"), otlp_attributes(s["attributes"]))))
    return rows.select(
        "file", "at", *[first_nonblank(*swapped(one, two)).alias(one) for one, two in (("trace_id", "traceId"), ("span_id", "spanId"), ("parent_span_id", "parentSpanId"))],
        first_nonblank(either(s["service"], F.col("attributes")["service.name"]), either(s["service_name"], s["service"]), either(s["service.name"], F.lit(None).cast("string"))).alias("service"),
        got("name").alias("name"), either(F.lower(got("kind")), span_kind(s["kind"])).alias("kind"),
        time_ns(either(s["start_time"], s["startTimeUnixNano"]), either(s["startTime"], s["start_time_unix_nano"])).alias("start_ns"),
        time_ns(either(s["end_time"], s["endTimeUnixNano"]), either(s["endTime"], s["end_time_unix_nano"])).alias("end_ns"), "attributes",
    )


def file_numbers(files: DataFrame) -> DataFrame:
    """(file, file_no): distinct names with numbers that rise in their order, with gaps, below 2**33.

    The names are dealt to PARTS ranges and sorted there, so no task and no driver sees all of them. monotonically_increasing_id()
    has the range above bit 33 and the row below it; the row may take ROW_BITS bits.
    """
    names = files.select("file").distinct().repartitionByRange(PARTS, "file").sortWithinPartitions("file")
    names = names.select("file", F.monotonically_increasing_id().alias("id"))
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    number = F.when(row < 1 << ROW_BITS, F.shiftleft(part, ROW_BITS) + row).otherwise(F.raise_error(F.lit(f"more than 2**{ROW_BITS} files in a range")).cast("bigint"))
    return names.select("file", number.alias("file_no")).groupBy("file").agg(F.min("file_no").alias("file_no"))


def parse_spans(files: DataFrame) -> DataFrame:
    """Spans of (file, value) rows of whole JSON documents of either dialect, in file order as seq; other documents give none.

    seq is the file's number, then the span's place in its document. A place takes AT_BITS bits: a document has at most 2**31
    bytes, and a span at least three. The numbers are joined by file, by whatever join their size allows, and not at all where
    seq is not read.
    """
    rows = _spans(files).join(file_numbers(files), "file", "left")
    return rows.select("trace_id", "span_id", "parent_span_id", "service", "name", "kind", "start_ns", "end_ns", "attributes", (F.shiftleft("file_no", AT_BITS) + F.col("at")).alias("seq"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): a single file of any name, or all *.json below a folder, upper or lower case."""
    reader = spark.read.option("recursiveFileLookup", True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder)
    if status.isDirectory():
        reader = reader.option("pathGlobFilter", "*.[jJ][sS][oO][nN]")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return parse_spans(read_files(spark, path))


def unreadable_files(files: DataFrame) -> DataFrame:
    """Files that are of neither dialect."""
    return files.where(F.from_json("value", PLAIN)["spans"].isNull() & F.from_json("value", OTLP)["resourceSpans"].isNull()).select("file")
