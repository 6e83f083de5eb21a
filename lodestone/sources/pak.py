"""Archives as a Spark data source: spark.read.format("pak").load(path).

One row per entry. The catalog is read from an archive's tail and index only; with option
content=true the payloads are read too, by ranges, and an archive's entries are dealt over
several partitions. A payload that cannot be read gives its reason in `error` and the scan goes
on; an archive that cannot be opened, or whose entries reach past its end, fails the read unless
option badArchives=rows, which gives one row with the reason. Equality filters on path and bounds on
size are taken into the scan.

For very large archives read the catalog, filter it, and pass it to `contents`: an entry's own
record stands before its payload, so no task reads an index again.

Options: path (one, or several separated by commas; globs in the last component), content,
badArchives, entriesPerPartition (512), verifyIndex (false: whether an index must have the hash that
its footer claims). Paths may be any URI that pyarrow.fs opens.
"""

from __future__ import annotations

import fnmatch
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, pos int, path string, offset long, size long, compressed_size long, method string, encrypted boolean, sha1 string, content binary, error string"
#: Fixed values of the format: mark, footers by size (versions, method slots, frozen flag), numeric methods.
MAGIC = 0x5A6F12E1
FOOTERS = ((222, (9,), 5, True), (221, (8, 10, 11), 5, False), (189, (8,), 4, False), (61, (7,), 0, False), (44, (1, 2, 3, 4, 5, 6), 0, False))
METHOD_IDS = {0: "none", 1: "zlib", 2: "gzip", 4: "oodle"}
MAX_ENTRIES = 10_000_000


class BadArchive(ValueError):
    """The bytes are no archive that can be read."""


@dataclass(frozen=True)
class Footer:
    version: int
    index_offset: int
    index_size: int
    index_sha1: str
    encrypted: bool
    methods: tuple[str, ...]
    short_method: bool  # one byte in entry records
    guid: str | None  # of the key, as 32 hexadecimal digits; None for all zeros and for footers without one


@dataclass(frozen=True)
class Entry:
    path: str
    offset: int
    size: int
    compressed_size: int
    method: str
    encrypted: bool
    sha1: str | None
    blocks: tuple[tuple[int, int], ...]  # in the file
    start: int  # of the payload, in the file
    block_size: int


class Cursor:
    """Little-endian reads that raise BadArchive past the end."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise BadArchive(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, form: str):
        got = struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))
        return got[0] if len(got) == 1 else got

    def text(self) -> str:
        n = self.read("i")
        raw, code, end = (self.take(n), "utf-8", b"\0") if n >= 0 else (self.take(-2 * n), "utf-16-le", b"\0\0")
        if not raw.endswith(end):
            raise BadArchive("string without end")
        return raw[: -len(end)].decode(code)


def read_footer(tail: bytes, file_size: int) -> Footer:
    """The footer in the last bytes of a file; the newest layout that fits."""
    foreign = None
    for size, versions, slots, frozen in FOOTERS:
        if len(tail) < size:
            continue
        c = Cursor(tail[-size:])
        encrypted, guid = False, None
        if size > 44:
            guid = c.take(16).hex()
            guid = guid if guid.strip("0") else None
            encrypted = bool(c.read("B"))
        magic, version, offset, length = c.read("IIQQ")
        if magic != MAGIC:
            continue
        if version not in versions:
            foreign = version
            continue
        sha1 = c.take(20).hex()
        if frozen and c.read("B"):
            raise BadArchive("frozen index")
        methods = tuple(c.take(32).rstrip(b"\0").decode("ascii").lower() for _ in range(slots))
        if version < 3:
            raise BadArchive(f"version {version} is not read")
        if offset + length > file_size:
            raise BadArchive("index past the end")
        return Footer(version, offset, length, sha1, encrypted, methods, size == 189, guid)
    raise BadArchive("no footer" if foreign is None else f"version {foreign} in a footer of another size")


def method_name(footer: Footer, code: int) -> str:
    if footer.version < 8:
        return METHOD_IDS.get(code, f"unknown {code}")
    return "none" if code == 0 else footer.methods[code - 1] if code <= len(footer.methods) else f"unknown {code}"


def header_size(footer: Footer, method: str, n_blocks: int) -> int:
    """Bytes of the record that stands before a payload."""
    return (50 if footer.short_method else 53) + (4 + 16 * n_blocks if method != "none" else 0)


def flat_entry(c: Cursor, footer: Footer, path: str) -> Entry:
    offset, size, whole = c.read("QQQ")
    method = method_name(footer, c.read("B" if footer.short_method else "I"))
    sha1 = c.take(20).hex()
    blocks = [tuple(c.read("QQ")) for _ in range(c.read("I"))] if method != "none" else []
    encrypted, block_size = c.read("BI")
    base = offset if footer.version >= 5 else 0
    return Entry(path, offset, whole, size, method, bool(encrypted & 1), sha1, tuple((a + base, b + base) for a, b in blocks), offset + header_size(footer, method, len(blocks)), block_size)


def packed_entry(c: Cursor, footer: Footer, path: str) -> Entry:
    bits = c.read("I")
    block_size = c.read("I") if bits & 0x3F == 0x3F else (bits & 0x3F) << 11
    offset = c.read("I" if bits >> 31 & 1 else "Q")
    whole = c.read("I" if bits >> 30 & 1 else "Q")
    method, encrypted, n = method_name(footer, bits >> 23 & 0x3F), bool(bits >> 22 & 1), bits >> 6 & 0xFFFF
    size = whole if method == "none" else c.read("I" if bits >> 29 & 1 else "Q")
    if method != "none" and not n:
        raise BadArchive("compressed entry without blocks")
    at, blocks = offset + header_size(footer, method, n), []
    start = at
    for length in [size] if n == 1 and not encrypted else [c.read("I") for _ in range(n)]:
        blocks.append((at, at + length))
        at += -(-length // 16) * 16 if encrypted else length
    return Entry(path, offset, whole, size, method, encrypted, None, tuple(blocks), start, block_size)


def read_index(data: bytes, footer: Footer, region) -> list[Entry]:
    """Entries of an index, in its order; of equal paths the last stays, where it stands. region(offset, size) reads the file."""
    c = Cursor(data)
    mount, n = c.text(), c.read("I")
    if n > MAX_ENTRIES:
        raise BadArchive(f"{n} entries")
    if footer.version < 10:
        found = [flat_entry(c, footer, c.text()) for _ in range(n)]
    else:
        c.read("Q")
        if c.read("I"):
            c.take(36)
        if not c.read("I"):
            raise BadArchive("index without directories")
        at, length = c.read("QQ")
        c.take(20)
        blob = c.take(c.read("I"))
        loose = [flat_entry(c, footer, "") for _ in range(c.read("I"))]
        d, found = Cursor(region(at, length)), []
        for _ in range(d.read("I")):
            folder = d.text().removeprefix("/")
            for _ in range(d.read("I")):
                path, where = folder + d.text(), d.read("i")
                if where < 0 and -where > len(loose):
                    raise BadArchive(f"{path}: no such record")
                found.append(packed_entry(Cursor(blob, where), footer, path) if where >= 0 else Entry(**{**loose[-where - 1].__dict__, "path": path}))
    last = {e.path: i for i, e in enumerate(found)}
    return [e for i, e in enumerate(found) if last[e.path] == i]


def lz4_block(data: bytes, size: int) -> bytes:
    """A raw LZ4 block of known size."""
    out, c = bytearray(), Cursor(data)

    def longer(n: int) -> int:
        while n >= 15 and (more := c.read("B")) is not None:
            n += more
            if more < 255:
                break
        return n

    while c.at < len(data):
        token = c.read("B")
        out += c.take(longer(token >> 4))
        if c.at >= len(data):
            break
        back, n = c.read("H"), longer(token & 15) + 4
        if not 0 < back <= len(out) or len(out) + n > size:
            raise BadArchive("bad LZ4 match")
        for i in range(0, n, back):  # a match may run into its own output
            out += out[-back:][: n - i] if back < n else out[len(out) - back : len(out) - back + n]
    if len(out) != size:
        raise BadArchive(f"{len(out)} bytes of {size}")
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, size + 1)
    if len(out) != size:
        raise BadArchive(f"{len(out)} bytes of {size}")
    return out


def payload(e: Entry, region) -> bytes:
    """An entry's bytes; BadArchive for what cannot be read here."""
    if e.encrypted:
        raise BadArchive("encrypted")
    if e.method == "none":
        return region(e.start, e.size)
    if e.method not in ("zlib", "lz4"):
        raise BadArchive(f"method {e.method} is not supported")
    out, left = [], e.size
    for i, (a, b) in enumerate(e.blocks):
        want = left if i == len(e.blocks) - 1 else min(left, e.block_size)
        out.append((inflate if e.method == "zlib" else lz4_block)(region(a, b - a), want))
        left -= want
    if left:
        raise BadArchive(f"{left} bytes missing")
    return b"".join(out)


def opened(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    return fs.open_input_file(path)


def regions(f):
    def region(at: int, n: int) -> bytes:
        data = f.read_at(n, at)
        if len(data) != n:
            raise BadArchive("past the end")
        return data

    return region


def footer_of(f) -> Footer:
    """The footer, from an open file's tail alone."""
    n = f.size()
    return read_footer(f.read_at(min(n, 222), n - min(n, 222)), n)


def scan(uri: str, verify: bool = False) -> list[Entry]:
    """The entries of an archive, all inside it."""
    with opened(uri) as f:
        footer, n, region = footer_of(f), f.size(), regions(f)
        if footer.encrypted:
            raise BadArchive("encrypted index")
        index = region(footer.index_offset, footer.index_size)
        if verify and footer.index_sha1.strip("0") and hashlib.sha1(index).hexdigest() != footer.index_sha1:
            raise BadArchive("the index has another hash than its footer claims")
        found = read_index(index, footer, region)
    for e in found:
        end = max([e.start, *(b for _, b in e.blocks)]) if e.blocks else e.start + e.compressed_size
        if end > n or max(e.size, e.compressed_size) >= 1 << 63:
            raise BadArchive(f"{e.path}: past the end")
    return found


def entry_count(uri: str) -> int:
    """What the head of an archive's index says."""
    with opened(uri) as f:
        footer, region = footer_of(f), regions(f)
        size = struct.unpack("<i", region(footer.index_offset, 4))[0]
        head = min(footer.index_size, 8 + (size if size >= 0 else -2 * size))
        c = Cursor(region(footer.index_offset, head))
        c.text()
        return min(c.read("I"), MAX_ENTRIES)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(source, version, key_guid, encrypted_index, index_sha1, error) of archives, from their tails alone."""

    def run(batches):
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                try:
                    with opened(source) as f:
                        x = footer_of(f)
                    rows.append((source, x.version, x.guid, x.encrypted, x.index_sha1, None))
                except (BadArchive, OSError, UnicodeDecodeError) as e:
                    rows.append((source, None, None, None, None, str(e)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["source", "version", "key_guid", "encrypted_index", "index_sha1", "error"])

    sources = expand(path)
    return spark.createDataFrame([(s,) for s in sources], "source string").repartition(min(len(sources), 1000)).mapInArrow(run, "source string, version int, key_guid string, encrypted_index boolean, index_sha1 string, error string")


def contents(entries: DataFrame, spread: int | None = None) -> DataFrame:
    """entries (source, path, offset and more) with content and error in place of their own, read by ranges from the entries' own records.

    spread: partitions over which the entries are dealt.
    """
    kept = [c for c in entries.columns if c not in ("content", "error")]
    at = {c: kept.index(c) for c in ("source", "path", "offset")}
    rows = entries.select(*kept)

    def run(batches):
        for batch in batches:
            source, path, offset = (batch.column(at[c]).to_pylist() for c in ("source", "path", "offset"))
            content, error = [None] * len(source), [None] * len(source)
            by: dict[str, list[int]] = {}
            for i, s in enumerate(source):
                by.setdefault(s, []).append(i)
            for s, mine in by.items():
                try:
                    with opened(s) as f:
                        footer, region, n = footer_of(f), regions(f), f.size()
                        for i in mine:
                            try:
                                content[i] = payload(record_at(f, n, footer, offset[i], path[i]), region)
                            except UNREADABLE as x:
                                error[i] = str(x)
                except (BadArchive, OSError, UnicodeDecodeError) as x:
                    for i in mine:
                        error[i] = error[i] or str(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary()), pa.array(error, pa.string())], [*kept, "content", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return (rows.repartition(spread) if spread else rows).mapInArrow(run, schema + ", content binary, error string")


def record_at(f, file_size: int, footer: Footer, offset: int, path: str) -> Entry:
    """The entry whose record stands at offset, which counts from there."""
    size = 4096
    while True:
        data = f.read_at(max(0, min(size, file_size - offset)), offset)
        try:
            e = flat_entry(Cursor(data), replace(footer, version=max(footer.version, 5)), path)  # blocks relative to the record
            break
        except BadArchive:
            if offset + size >= file_size:
                raise
            size *= 16
    shift = offset if footer.version >= 5 else 0
    return replace(e, offset=offset, start=offset + header_size(footer, e.method, len(e.blocks)), blocks=tuple((a - e.offset + shift, b - e.offset + shift) for a, b in e.blocks))


def expand(paths: str) -> list[str]:
    """Archives of a list of paths and globs, sorted, each once; none at all is an error."""
    out = set()
    for p in filter(None, map(str.strip, paths.split(","))):
        folder, _, name = p.rpartition("/")
        if not any(c in name for c in "*?["):
            out.add(p)
            continue
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder or ".")
        out |= {f"{folder}/{x.base_name}" if folder else x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and fnmatch.fnmatchcase(x.base_name, name)}
    if not out:
        raise FileNotFoundError(f"no archive matches {paths!r}")
    return sorted(out)


class Slice(InputPartition):
    def __init__(self, source: str, first: int, stop: int | None):
        self.source, self.first, self.stop = source, first, stop


#: What a payload that cannot be read raises.
UNREADABLE = (BadArchive, zlib.error, pa.ArrowException, OSError, OverflowError, MemoryError)


class PakReader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = expand(options["path"])
        self.content = options.get("content", "false").lower() == "true"
        self.rows = options.get("badarchives", "fail").lower() == "rows"
        self.each = int(options.get("entriesperpartition", "512"))
        self.verify = options.get("verifyindex", "false").lower() == "true"
        self.paths: set | None = None
        self.least, self.most = 0, 1 << 64

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Narrow the scan by path and size; Spark evaluates all filters again."""
        for x in filters:
            column, value = getattr(x, "attribute", ()), getattr(x, "value", None)
            if column == ("path",) and isinstance(x, EqualTo | In):
                wanted = {value} if isinstance(x, EqualTo) else set(value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif column == ("size",) and isinstance(x, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.least = max(self.least, value + isinstance(x, GreaterThan))
            if column == ("size",) and isinstance(x, LessThan | LessThanOrEqual | EqualTo):
                self.most = min(self.most, value - isinstance(x, LessThan))
            yield x

    def wanted(self, e: Entry) -> bool:
        return (self.paths is None or e.path in self.paths) and self.least <= e.size <= self.most

    def partitions(self) -> list[Slice]:
        if not self.content:
            return [Slice(s, 0, None) for s in self.sources]
        out = []
        for s in self.sources:
            try:
                n = entry_count(s)
            except (BadArchive, OSError, UnicodeDecodeError):
                n = 1  # the task reports it
            out += [Slice(s, i, i + self.each) for i in range(0, max(n, 1), self.each)]
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        try:
            entries = [(i, e) for i, e in list(enumerate(scan(part.source, self.verify)))[part.first : part.stop] if self.wanted(e)]
        except (BadArchive, OSError, UnicodeDecodeError) as x:
            if not self.rows:
                raise
            yield (part.source, *[None] * 9, str(x))
            return
        with opened(part.source) as f:
            region = regions(f)
            for i, e in entries:
                content = error = None
                if self.content:
                    try:
                        content = payload(e, region)
                    except UNREADABLE as x:
                        error = str(x)
                yield (part.source, i, e.path, e.offset, e.size, e.compressed_size, e.method, e.encrypted, e.sha1, content, error)


class PakSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pak"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PakReader:
        return PakReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PakSource)


def packed(files: list[tuple[str, bytes]], compress: bool = True, block: int = 1 << 16) -> bytes:
    """A version 9 archive of (path, bytes), as small fixtures and queries need one; payloads in zlib blocks or as they are."""

    def text(x: str) -> bytes:
        return struct.pack("<i", len(x) + 1) + x.encode() + b"\0" if x.isascii() else struct.pack("<i", -len(x.encode("utf-16-le")) // 2 - 1) + x.encode("utf-16-le") + b"\0\0"

    body, index = bytearray(), bytearray()
    for path, data in files:
        parts = [zlib.compress(data[i : i + block], 1) for i in range(0, max(len(data), 1), block)] if compress else []
        stored = b"".join(parts) if compress else data
        ends = [53 + 4 + 16 * len(parts)]
        for p in parts:
            ends.append(ends[-1] + len(p))
        table = struct.pack("<I", len(parts)) + b"".join(struct.pack("<QQ", *x) for x in zip(ends, ends[1:], strict=False)) if compress else b""
        rest = struct.pack("<QQI", len(stored), len(data), int(compress)) + hashlib.sha1(stored).digest() + table + struct.pack("<BI", 0, block if compress else 0)
        index += text(path) + struct.pack("<Q", len(body)) + rest
        body += struct.pack("<Q", 0) + rest + stored
    listing = text("../../../") + struct.pack("<I", len(files)) + index
    return bytes(body) + listing + bytes(17) + struct.pack("<IIQQ", MAGIC, 9, len(body), len(listing)) + hashlib.sha1(listing).digest() + b"\0" + b"Zlib".ljust(32, b"\0") + bytes(128)
