"""Text and number rules as Column expressions; '' stands for absent throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as Unicode has it; trim() alone takes U+0020.
SPACES = " \t\n\x0b\f\r" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, however often f uses it: expressions stay as long as they are written."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends; null gives ''."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))


def first_filled(*columns: Column) -> Column:
    """The first argument that is not ''; '' if none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def first_nonblank(*columns: Column) -> Column:
    """The first argument that is not blank, stripped; '' if none."""
    return first_filled(*[strip(c) for c in columns])


_NAME = rf"(?is)^({'|'.join(HTTP_METHODS)})\s+(\S+)"


def name_method(name: Column) -> Column:
    """HTTP method of a span name such as 'GET /path', else ''."""
    return F.upper(F.regexp_extract(strip(name), _NAME, 1))


def name_path(name: Column) -> Column:
    """Path of a span name such as 'GET /path', else ''."""
    return F.regexp_extract(strip(name), _NAME, 2)


def span_path(path: Column) -> Column:
    """Path without query; of http(s) URLs their percent-decoded path; at least '/'; '' stays ''."""
    def decode(inner: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))), inner)

    def bare(p: Column) -> Column:
        web = p.startswith("http://") | p.startswith("https://")
        return F.when(web, let(F.regexp_extract(p, r"(?s)^https?://[^/?]*([^?#]*)", 1), decode)).otherwise(F.substring_index(p, "?", 1))

    def rooted(p: Column) -> Column:
        return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))

    return let(strip(path), lambda p: F.when(p == "", "").otherwise(let(bare(p), rooted)))


def document_path(path: Column) -> Column:
    """The plainer rule for topology documents and overlays: stripped, with a leading '/'."""
    p = strip(path)
    return F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def query_escape(c: Column) -> Column:
    """Percent-encoding of query values: space as +, and - _ . ~ as they are."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def round3(c: Column) -> Column:
    """Half up at three decimals, after multiplying, for values from 0."""
    return F.floor(c * 1000.0 + 0.5) / 1000.0


def round2(c: Column) -> Column:
    return F.floor(c * 100.0 + 0.5) / 100.0


def string_set(a: Column, lower: bool = False) -> Column:
    """Stripped, without blanks, distinct and sorted; null counts as empty."""
    each = F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(strip(x)) if lower else strip(x))
    return F.array_sort(F.array_distinct(F.filter(each, lambda x: x != "")))


def string_map(m: Column) -> Column:
    """Keys and values stripped, empty keys dropped, of equal keys the last; empty gives null."""
    entries = F.transform(F.map_entries(m), lambda e: F.named_struct(F.lit("key"), strip(e["key"]), F.lit("value"), strip(e["value"])))
    out = last_wins(F.filter(entries, lambda e: e["key"] != ""))
    return F.when(F.size(out) > 0, out)


def last_wins(entries: Column) -> Column:
    """array<struct<key,value>> to a map; of equal keys the last entry stays."""
    start = F.create_map().cast("map<string,string>")
    return F.aggregate(entries, start, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def map_over(base: Column, over: Column) -> Column:
    """base with over's entries on top."""
    none = F.create_map().cast("map<string,string>")
    return let(F.coalesce(over, none), lambda o: F.map_concat(F.map_filter(F.coalesce(base, none), lambda k, v: ~F.map_contains_key(o, k)), o))


def map_text(m: Column) -> Column:
    """Entries as sorted k=v text, which compares and groups as maps cannot."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "|")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
