"""Scalar functions as column expressions; Python only where Spark has no equivalent (exact FNV-1a, real compression)."""

from __future__ import annotations

import sys
from urllib.parse import parse_qs, unquote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(s: Column | str) -> Column:
    """Lower case of A-Z only; other letters stay."""
    return F.translate(_col(s), UPPER, LOWER)


def doc_id(collection: Column | str, key: Column | str, lang: Column | str) -> Column:
    return ascii_lower(F.concat(_col(collection), F.lit("|"), _col(key), F.lit("|"), _col(lang)))


def apply_env(text: Column | str, env: dict[str, str] | Column) -> Column:
    """Every %%name%% of env replaced, names in sorted order; unknown names stay."""
    text = _col(text)
    if isinstance(env, dict):
        for k in sorted(env):
            text = F.replace(text, F.lit(f"%%{k}%%"), F.lit(env[k]))
        return text
    entries = F.array_sort(F.map_entries(env))
    return F.coalesce(F.aggregate(entries, text, lambda a, e: F.replace(a, F.concat(F.lit("%%"), e["key"], F.lit("%%")), e["value"])), text)


def safe_name(s: Column | str) -> Column:
    return F.regexp_replace(_col(s), "[^a-zA-Z0-9_-]", "-")


def slugify(file_name: Column | str) -> Column:
    """A key from a file name: without .md, lower case, other characters as single dashes."""
    s = F.regexp_replace(ascii_lower(F.regexp_replace(_col(file_name), r"\.md$", "")), "[^a-z0-9]", "-")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")


def _last_wins(entries: Column) -> Column:
    """A map of (key, value) entries in which the last of equal keys holds."""
    entry = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.lit(0), F.size(entries) - i - 1)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, entry))


def parse_meta(s: Column | str) -> Column:
    """'k=v1|v2,k2=v' as a map of lists; parts without '=' are dropped."""
    pairs = F.filter(F.split(_col(s), ","), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.split(F.substr(p, F.instr(p, "=") + 1), r"\|").alias("value")))
    return _last_wins(entries)


def parse_env(s: Column | str) -> Column:
    """'k=v,k2=v2' as a map; parts without '=' are dropped."""
    pairs = F.filter(F.split(_col(s), ","), lambda p: F.instr(p, "=") > 0)
    return _last_wins(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.instr(p, "=") + 1).alias("value"))))


def frontmatter(text: Column | str, first_of_list: bool = False) -> Column:
    """The 'key: value' lines between the leading '---' lines, as a map; quotes around values go.

    first_of_list cuts a value at its first comma, as loading through the command line's mini-syntax does.
    """
    block = F.regexp_extract(_col(text), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    value = lambda x: F.regexp_replace(F.trim(F.substr(x, F.instr(x, ":") + 1)), "^[\"']|[\"']$", "")
    cut = (lambda v: F.substring_index(v, ",", 1)) if first_of_list else (lambda v: v)
    return _last_wins(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), cut(value(x)).alias("value"))))


def zero_pad(ts: Column | str) -> Column:
    return F.lpad(_col(ts).cast("string"), 20, "0")


def nth_part(s: Column | str, sep: str, n: int) -> Column:
    """The nth part from 0; null past the end."""
    return F.try_element_at(F.split(_col(s), "\\Q" + sep + "\\E"), F.lit(n + 1))


def index_of(s: Column | str, part: str) -> Column:
    """Place of the first occurrence from 0, or -1."""
    return F.instr(_col(s), part) - 1


def last_index_of(s: Column | str, char: str) -> Column:
    s = _col(s)
    return F.when(F.instr(s, char) == 0, -1).otherwise(F.length(s) - F.instr(F.reverse(s), char))


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by byte order."""
    a, b = _col(a), _col(b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def storage_tier(content: Column | str) -> Column:
    """The encoding that a content of so many bytes is stored with."""
    n = F.octet_length(_col(content))
    return F.when(n < 1024, "none").when(n < 10240, "snappy").otherwise("zstd")


def human_bytes(n: Column | str) -> Column:
    """1536 -> '1.5 KB'."""
    n = _col(n).cast("double")
    step = F.least(F.lit(4.0), F.floor(F.log(n) / F.log(F.lit(1024.0))).cast("double"))
    amount = F.round(n / F.pow(F.lit(1024.0), step), 2)
    shown = F.regexp_replace(F.format_string("%.2f", amount), r"\.?0+$", "")
    return F.when(n == 0, "0 B").otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), (step + 1).cast("int"))))


def iso_time(ts: Column | str) -> Column:
    """Epoch seconds as an RFC 3339 time in UTC (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(_col(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def canonical_meta(meta: Column | str) -> Column:
    """A comparable form of a metadata map: entries by key; the order within lists counts."""
    return F.coalesce(F.array_sort(F.map_entries(_col(meta))), F.array().cast("array<struct<key:string,value:array<string>>>"))


def meta_changed(old: Column | str, new: Column | str) -> Column:
    return canonical_meta(old) != canonical_meta(new)


def normal_meta(meta: Column | str) -> Column:
    return F.coalesce(_col(meta), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")))


def as_list(value: Column | str) -> Column:
    """A scalar or list given as JSON as a list of strings; list items that aren't strings become ''."""
    v = _col(value)
    many = F.from_json(v, "array<string>")
    items = F.transform(F.from_json(v, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")).otherwise(""))
    return F.when(F.ltrim(v).startswith("["), F.coalesce(items, many)).otherwise(F.array(F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"), F.lit(""))))


def _utf8(s: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where every string's UTF-8 bytes begin, how many they are (0 of a null), the bytes as they lie in the Arrow batch, without a copy, and which are null."""
    _, at, data = s.buffers()
    kind = np.int64 if pa.types.is_large_string(s.type) else np.int32
    ends = np.frombuffer(at, kind)[s.offset : s.offset + len(s) + 1].astype(np.int64) if len(s) else np.zeros(1, np.int64)
    null = s.is_null().to_numpy(zero_copy_only=False)
    return ends[:-1], np.where(null, 0, np.diff(ends)), np.frombuffer(data or b"", np.uint8), null


def _fnv1a(s: pa.Array, start: int, prime: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a of the UTF-8 bytes of every string, byte by byte over all strings that are so long, and which are null."""
    begin, size, data, null = _utf8(s)
    order = np.argsort(-size, kind="stable")
    at, sizes = begin[order], size[order].tolist()
    h, prime = np.full(len(s), start, kind), kind(prime)
    n, j = len(s), 0
    while True:
        while n and sizes[n - 1] <= j:
            n -= 1  # strings of over j bytes
        if n < 16:
            break
        h[:n] = (h[:n] ^ data[at[:n] + j]) * prime
        j += 1
    mask, p = (1 << 8 * h.itemsize) - 1, int(prime)
    for i in range(n):  # the few longest, one by one
        x = int(h[i])
        for b in memoryview(data[at[i] + j : at[i] + sizes[i]]):
            x = ((x ^ b) * p) & mask
        h[i] = x
    out = np.empty_like(h)
    out[order] = h
    return out, null


@F.arrow_udf(T.LongType())
def fnv1a32(s: pa.Array) -> pa.Array:
    """Exact 32-bit FNV-1a of the UTF-8 bytes."""
    h, null = _fnv1a(s, 0x811C9DC5, 0x01000193, np.uint32)
    return pa.array(h.astype(np.int64), mask=null)


@F.arrow_udf(T.StringType())
def fnv1a64(s: pa.Array) -> pa.Array:
    """Exact 64-bit FNV-1a in hexadecimal."""
    h, null = _fnv1a(s, 0xCBF29CE484222325, 0x100000001B3, np.uint64)
    return pa.array([None if no else f"{y:016x}" for no, y in zip(null, h.tolist())], pa.string())


def _delta(old: bytes, new: bytes) -> bytes:
    """flag, new length, common prefix, common suffix and the middle; the whole content where that is shorter."""
    n = min(len(old), len(new))
    a = 0
    while a < n and old[a] == new[a]:
        a += 1
    z = 0
    while z < n - a and old[len(old) - 1 - z] == new[len(new) - 1 - z]:
        z += 1
    middle = new[a : len(new) - z]
    if 13 + len(middle) < len(new) + 1:
        return b"\x01" + len(new).to_bytes(4, "big") + a.to_bytes(4, "big") + z.to_bytes(4, "big") + middle
    return b"\x00" + new


def _undelta(old: bytes, d: bytes) -> bytes:
    if d[:1] == b"\x00":
        return d[1:]
    a, z = int.from_bytes(d[5:9], "big"), int.from_bytes(d[9:13], "big")
    return old[:a] + d[13:] + (old[len(old) - z :] if z else b"")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _common(n: Column, equal) -> Column:
    """The largest k <= n for which the first k bytes are equal; equal(k, step) compares the step bytes after k. All steps together compare at most 3 n bytes."""
    steps = F.array(*(F.lit(1 << b) for b in range(30, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda k, step: F.when(step > n - k, k).when(equal(k, step), k + step).otherwise(k))


def _be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def delta_encode(old: Column | str, new: Column | str) -> Column:
    """What _delta gives for the UTF-8 bytes; of a null new text null, a null old one is empty."""
    empty = F.lit("").cast("binary")

    def coded(p: Column) -> Column:
        a, z = p["a"], p["z"]
        size = F.octet_length(p["new"])
        middle = size - a - z
        head = F.concat(F.lit(b"\x01"), _be32(size), _be32(a), _be32(z))
        return F.when(middle + 12 < size, F.concat(head, F.substr(p["new"], a + 1, middle))).otherwise(F.concat(F.lit(b"\x00"), p["new"]))

    def suffix(p: Column) -> Column:
        m, n = F.octet_length(p["old"]), F.octet_length(p["new"])
        part = lambda x, size, k, step: F.substr(x, size - k - step + 1, step)
        z = _common(F.least(m, n) - p["a"], lambda k, step: part(p["old"], m, k, step) == part(p["new"], n, k, step))
        return _let(F.struct(p["new"].alias("new"), p["a"].alias("a"), z.alias("z")), coded)

    def prefix(p: Column) -> Column:
        a = _common(F.least(F.octet_length(p["old"]), F.octet_length(p["new"])), lambda k, step: F.substr(p["old"], k + 1, step) == F.substr(p["new"], k + 1, step))
        return _let(F.struct(p["old"].alias("old"), p["new"].alias("new"), a.alias("a")), suffix)

    texts = F.struct(F.coalesce(_col(old).cast("binary"), empty).alias("old"), F.coalesce(_col(new).cast("binary"), empty).alias("new"))
    return F.when(_col(new).isNotNull(), _let(texts, prefix))


def delta_decode(old: Column | str, delta: Column | str) -> Column:
    """The new text from the old one and what delta_encode gave; of a null delta null."""
    old, d = F.coalesce(_col(old).cast("binary"), F.lit("").cast("binary")), _col(delta)
    number = lambda at: F.conv(F.hex(F.substr(d, F.lit(at), F.lit(4))), 16, 10).cast("int")
    rest = lambda at: F.substr(d, F.lit(at), F.octet_length(d))
    a, z = number(6), number(10)
    whole = F.concat(F.substr(old, F.lit(1), a), rest(14), F.substr(old, F.octet_length(old) - z + 1, z))
    return F.when(F.substr(d, F.lit(1), F.lit(1)) == F.lit(b"\x00"), rest(2)).otherwise(whole).cast("string")


@F.arrow_udf(T.DoubleType())
def zstd_ratio(content: pa.Array) -> pa.Array:
    """Compressed by plain size with zstd; 1 where it doesn't shrink. Bytes are compressed where they lie in the Arrow batch."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    begin, size, data, null = _utf8(content)
    ratio = np.ones(len(content))
    for i in np.flatnonzero(size):
        ratio[i] = min(1.0, len(z.compress(data[begin[i] : begin[i] + size[i]])) / int(size[i]))
    return pa.array(ratio, mask=null)


def parse_uri(uri: str) -> dict:
    """A resource or search address: //collection/key?lang=&env.X= or //collection?meta.K=V&sort=&limit=&offset=."""
    scheme, sep, rest = uri.partition("://")
    path, _, query = rest.partition("?")
    args = parse_qs(query, keep_blank_values=True)
    if not sep or not path:
        raise ValueError(f"not a resource address: {uri!r}")
    whole = lambda k: int(args[k][0]) if k in args and args[k][0].lstrip("-").isdigit() else 0
    collection, slash, key = path.partition("/")
    meta = {k[5:]: v for k, v in args.items() if k.startswith("meta.")}
    out = {"collection": unquote(collection), "lang": args.get("lang", ["en_US"])[0], "env": {k[4:]: v[0] for k, v in args.items() if k.startswith("env.")}}
    if slash and not scheme.endswith("-search"):
        return out | {"key": unquote(key)}
    return out | {"filter": meta, "sort": args.get("sort", [""])[0], "asc": args.get("asc", ["false"])[0] == "true", "limit": whole("limit"), "offset": whole("offset")}

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
