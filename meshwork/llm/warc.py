"""WARC archives: written in parallel, and read in byte ranges.

Writing.  Every task writes its rows to files of its own in the shared folder, one gzip
member a record; a file's name holds the attempt, and only files that a finished task has
listed are ever read, so that what a lost or repeated task leaves behind does no harm.
Pages of equal payloads (of ``SHORTEST`` bytes at least) are stored once: the one of the
smallest id is a response, the others are revisits of it.  Copies are found on digests
alone; payloads are not shuffled but for copies of one page id.

Reading.  Files are cut into byte ranges of ``SPLIT`` bytes.  A task looks for gzip magic
from where its range begins, takes a place for the start of a member only if what it
decodes to is the header of a WARC record, and goes on from member to member; it owns the
records that start inside its range, however far they reach.  A payload may itself hold
archives, so that a range that begins within one may take their members for records:
members never overlap and leave nothing out, and wherever the ranges of a file do not fit
together, members inside another are dropped, and bytes that no record covers raise an
error.

Files are opened by pyarrow, which knows local, shared, HDFS and object stores; listing
and all tables go through Spark.

Defined results: a null payload is an empty one; a null URL is left out; blanks and
control bytes of URLs are written percent-encoded; a null id comes after all others; of rows that agree in
id and payload one is the response, that of the smallest URL; every row makes one record,
an empty table no file; other columns take no part.  Payloads of any length are written
and digested piece by piece.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, released, shared_folder, small_batches

SPLIT, FILE_BYTES, SHORTEST = 32 << 20, 1 << 30, 100
PIECE = 1 << 20
#: Digests of copies that are broadcast, at most.
MOST_HOT = 100_000
#: Rows of copies of one page that one task spells out.
RUN = 4096
MAGIC = b"\x1f\x8b\x08"
#: A record's head is longer than this in no archive that this reader takes.
LONGEST_HEAD = 1 << 20

RECORDS = (
    "path string, range long, offset long, stop long, place long, version string, record_type string, record_id string, target_uri string, refers_to string, "
    "date string, payload_bytes long, payload_digest string, payload binary"
)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":" in path else (pafs.LocalFileSystem(), path)


# Writing


def _fields(kind: str, record_id: str, date: str, length: int, more: dict[str, str | None]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"Content-Length: {length}"]
    lines += [f"{k}: {v}" for k, v in more.items() if v is not None]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _uri(url: str | None) -> str | None:
    """The URL without bytes that would end or break a header line."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


class _Archive:
    """One file; every record is a gzip member."""

    def __init__(self, folder: str, date: str) -> None:
        context = TaskContext.get()
        self.name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        system, path = _opened(self.name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file, self.date, self.records, self.bytes = system.open_output_stream(path, compression=None), date, 0, 0
        info = b"format: WARC File Format 1.1\r\n"
        self.add("warcinfo", f"urn:uuid:{uuid.uuid4()}", [info], {"Content-Type": "application/warc-fields"})

    def add(self, kind: str, record_id: str, block: list, more: dict[str, str | None]) -> None:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        head = _fields(kind, record_id, self.date, sum(map(len, block)), more)
        for part in (head, *block, b"\r\n\r\n"):
            for at in range(0, len(part), PIECE):
                self._put(squeeze.compress(part[at : at + PIECE]))
        self._put(squeeze.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def close(self) -> pa.RecordBatch:
        self.file.close()
        return pa.RecordBatch.from_arrays(
            [pa.array([self.name]), pa.array([self.bytes], pa.int64()), pa.array([self.records], pa.int64())], names=["path", "length", "records"]
        )


def _named(page: int | None, digest: str) -> str:
    return f"urn:page:{'' if page is None else page}:{digest}"


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            pages, urls, payloads, lengths, digests, kinds, firsts = batch.columns
            for i in range(batch.num_rows):
                if archive is None:
                    archive = _Archive(folder, date)
                page, digest, length, kind = pages[i].as_py(), digests[i].as_py(), lengths[i].as_py(), kinds[i].as_py()
                more = {"WARC-Target-URI": _uri(urls[i].as_py()), "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
                name = _named(page, digest)
                if kind == "first":  # the record that others may refer to
                    archive.add("response", name, [_http(length), memoryview(payloads[i].as_buffer())], more)
                elif kind == "response":
                    archive.add("response", f"{name}:{uuid.uuid4().hex}", [_http(length), memoryview(payloads[i].as_buffer())], more)
                else:
                    more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{_named(firsts[i].as_py(), digest)}>", "WARC-Truncated": "length"}
                    archive.add("revisit", f"{name}:{uuid.uuid4().hex}", [_http(length)], more)
                if archive.bytes >= file_bytes:
                    yield archive.close()
                    archive = None
        if archive is not None:
            yield archive.close()

    return run


def _copies(rows: DataFrame, shortest: int) -> DataFrame:
    """Digests that several rows share: the smallest page id, and how many rows of that id have the payload."""
    keys = rows.filter(F.col("length") >= shortest).select("digest", "page")
    # Rows of a page are counted first: a page with very many rows is one key, and is merged before it is sent.
    by_page = keys.groupBy("digest", "page").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page").isNull(), "page", "n")
    found = by_page.groupBy("digest").agg(F.sum("n").alias("rows"), F.min(order).alias("first"))
    return found.filter("rows > 1").select("digest", "rows", F.col("first.page").alias("first"), F.col("first.n").alias("of_first"))


def _judged(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows with ``first`` and ``of_first`` where their payload has copies; payloads stay where they are.

    Digests of the most copies are broadcast: those of more than a ``MOST_HOT``-th of all copied
    rows, so that there are fewer than that.  The others, if there are any, meet in a shuffle
    in which no digest has more rows than that.
    """
    total = copies.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    if total["n"] <= MOST_HOT:
        return rows.join(F.broadcast(copies), "digest", "left")
    least = total["rows"] / MOST_HOT
    hot, cold = copies.filter(F.col("rows") > least), copies.filter(F.col("rows") <= least)
    known = rows.join(F.broadcast(hot), "digest", "left")
    rest = known.filter("rows IS NULL").drop(*[c for c in copies.columns if c != "digest"]).join(cold, "digest", "left")
    return known.filter("rows IS NOT NULL").unionByName(rest)


def write_pages(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    shortest: int = SHORTEST, file_bytes: int = FILE_BYTES, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for every row; returns ``path, length, records`` of the files written.

    Without a folder, a new one in that of ``spark.checkpoint.dir`` is taken.
    """
    folder = f"{(folder or shared_folder(pages.sparkSession)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"length": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    copies = checkpointed(_copies(rows, shortest))
    judged = _judged(rows, copies)
    same = F.col("page").eqNullSafe(F.col("first"))
    unclear = F.coalesce((F.col("of_first") > 1) & same & (F.col("length") >= shortest), F.lit(False))
    copied = F.col("rows").isNotNull() & (F.col("length") >= shortest)
    kind = F.when(~copied, "response").when(same, "first").otherwise("revisit")
    columns = ["page", "url", "payload", "length", "digest", "kind", "first"]
    clear = judged.filter(~unclear).withColumn("kind", kind).withColumn("payload", F.when(F.col("kind") != "revisit", F.col("payload"))).select(columns)
    out = clear
    if copies.filter("of_first > 1").limit(1).count():
        # Rows that agree in page and payload: equal ones are merged to a count, one of the smallest URL is the response.
        twins = judged.filter(unclear).groupBy("page", "digest", "length", "first", "url").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
        twins = checkpointed(twins)
        chosen = twins.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull(), "url")).alias("c")).select("digest", F.col("c.url").alias("of"))
        marked = twins.join(chosen, "digest").withColumn("heads", F.col("url").eqNullSafe(F.col("of")))
        heads = marked.filter("heads").withColumn("kind", F.lit("first")).select(columns)
        again = marked.drop("payload").withColumn("more", F.col("n") - F.col("heads").cast("long")).filter("more > 0")
        # Very many copies of one row are spelt out by many tasks, RUN at a time.
        runs = again.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / RUN)))).repartition("digest", "url", "run")
        spelt = runs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN).cast("long"), F.col("more") - F.col("run") * RUN))))
        spelt = spelt.withColumns({"payload": F.lit(None).cast("binary"), "kind": F.lit("revisit")}).select(columns)
        out = clear.unionByName(heads).unionByName(spelt)
    return checkpointed(small_batches(out).mapInArrow(released(_writer(folder, date, file_bytes)), "path string, length long, records long"))


# Reading


class _Member:
    """What the members from ``at`` on decode to, one member at a time."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        self.file, self.at, self.inflate, self.raw, self.read, self.held = file, at, zlib.decompressobj(31), b"", at, bytearray()

    def more(self) -> bool:
        """Decode some more; false where the member ends."""
        while not self.inflate.eof:
            if not self.raw:
                self.file.seek(self.read)
                self.raw = self.file.read(PIECE)
                self.read += len(self.raw)
                if not self.raw:
                    raise zlib.error("the file ends within a member")
            data = self.inflate.decompress(self.raw, PIECE)
            self.raw = self.inflate.unconsumed_tail
            if data:
                self.held += data
                return True
        return False

    def end(self) -> int:
        while self.more():
            self.held.clear()
        return self.read - len(self.inflate.unused_data)

    def head(self) -> bytes | None:
        """Up to the next empty line; null at the end of the member."""
        looked = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(self.held)
            if looked > LONGEST_HEAD or not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise zlib.error("a record is cut short")
            part = bytes(self.held[:n])
            del self.held[:n]
            n -= len(part)
            yield part


def _header(head: bytes | None) -> dict[str, str] | None:
    """Fields of a record's head, names in lower case; null if it is none."""
    if head is None or not re.match(rb"WARC/\d+\.\d+\r\n", head):
        return None
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    fields = {"version": lines[0]}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if colon:
            fields.setdefault(key.strip().lower(), value.strip())
    return fields if fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _record(member: _Member, fields: dict[str, str], payload: bool) -> dict:
    """The rest of a record whose head was read; the payload of HTTP messages begins after their own head."""
    left, held, said = int(fields["content-length"]), bytearray(), None
    pieces = member.take(left)
    kept = bytearray() if payload else None
    digest, size = hashlib.sha256(), 0
    in_head = fields.get("content-type", "").lower().startswith("application/http")
    for piece in pieces:
        if in_head:
            held += piece
            at = held.find(b"\r\n\r\n")
            if at < 0:
                continue
            said, piece, in_head, held = bytes(held[:at]), bytes(held[at + 4 :]), False, bytearray()
        digest.update(piece)
        size += len(piece)
        if kept is not None:
            kept += piece
    kind, known = fields["warc-type"].lower(), fields.get("warc-payload-digest", "")
    out = {
        "version": fields["version"], "record_type": kind, "record_id": fields.get("warc-record-id", "").strip("<>"), "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "date": fields.get("warc-date"),
        "payload_bytes": size, "payload_digest": digest.hexdigest(), "payload": bytes(kept) if kept is not None else None,
    }
    if kind == "revisit":  # the payload is elsewhere; its head tells the length, the digest is that of the other
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", said or bytes(held))
        out |= {"payload_bytes": int(length[1]) if length else None, "payload_digest": known.partition(":")[2].lower() if known.lower().startswith("sha256:") else None, "payload": None}
    return out


def _next_magic(file: pa.NativeFile, at: int, stop: int) -> int | None:
    """The next place in ``at <= place < stop`` where a gzip member may begin."""
    while at < stop:
        file.seek(at)
        piece = file.read(min(PIECE, stop - at) + len(MAGIC) - 1)
        found = piece.find(MAGIC)
        if found >= 0:
            return at + found if at + found < stop else None
        at += PIECE
    return None


def records_in(file: pa.NativeFile, start: int, stop: int, payload: bool) -> Iterator[dict]:
    """Records whose members begin in ``start <= offset < stop``."""
    at, synced = start, start == 0
    while (place := at if synced else _next_magic(file, at, stop)) is not None and place < stop:
        member = _Member(file, place)
        try:
            fields = _header(member.head())
            found = []
            while fields is not None:
                found.append(_record(member, fields, payload))
                b"".join(member.take(4))
                fields = _header(member.head())
            end = member.end()
        except zlib.error:
            found = []
        if not found:  # no member of an archive: look on
            at, synced = place + 1, False
            continue
        for i, record in enumerate(found):
            yield {"offset": place, "stop": end, "place": i} | record
        # A member that begins where the last one ended needs no search.
        file.seek(end)
        at, synced = end, file.read(len(MAGIC)) == MAGIC


def _reader(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for n, t in (c.split() for c in RECORDS.split(", "))]
        )
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _opened(row["path"])
                with system.open_input_file(path) as file:
                    held, size = [], 0
                    for record in records_in(file, row["start"], row["stop"], payload):
                        held.append({"path": row["path"], "range": row["start"]} | record)
                        size += 1000 + len(record["payload"] or b"")
                        if size > PIECE:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _fitted(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records that are not inside another; raises where bytes of a file belong to no record."""
    covered = F.sum(F.when(F.col("place") == 0, F.col("stop") - F.col("offset")))
    spans = records.groupBy("path", "range").agg(F.min("offset").alias("first"), F.max("stop").alias("last"), covered.alias("covered"))
    in_order = Window.partitionBy("path").orderBy("range")
    before = F.coalesce(F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Ranges of files are few beside their records; most archives end here.
    unfit = (F.col("first") != before) | (F.col("covered") != F.col("last") - F.col("first"))
    odd = spans.withColumn("odd", unfit).groupBy("path").agg(F.max("odd").alias("odd"), F.max("last").alias("last"))
    odd = files.join(odd, "path", "left").filter(F.coalesce(F.col("odd") | (F.col("last") != F.col("length")), F.col("length") > 0)).select("path", "length")
    odd = checkpointed(odd)
    if not odd.limit(1).count():
        return records
    members = records.join(odd, "path").select("path", "length", "offset", "stop").distinct()
    by_offset = Window.partitionBy("path").orderBy("offset")
    reached = F.coalesce(F.max("stop").over(by_offset.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = checkpointed(members.withColumn("reached", reached))
    ends = odd.join(placed.groupBy("path").agg(F.max("stop").alias("last")), "path", "left").filter(F.coalesce(F.col("last"), F.lit(0)) != F.col("length"))
    gaps = placed.filter("offset > reached").select("path", F.col("reached").alias("at")).unionByName(ends.select("path", F.coalesce("last", F.lit(0)).alias("at")))
    if bad := gaps.orderBy("path", "at").first():
        raise ValueError(f"no record covers {bad['path']} from byte {bad['at']} on")
    return records.join(placed.filter("offset < reached").select("path", "offset"), ["path", "offset"], "left_anti")


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the archives below a folder; nothing of them is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder)
    return listed.select("path", "length")


def read_records(spark: SparkSession, files: DataFrame, split: int = SPLIT, payload: bool = False) -> DataFrame:
    """Records of the archives ``path, length``, in ranges of ``split`` bytes, with their payloads if asked for."""
    files = files.select("path", F.col("length").cast("long").alias("length"))
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long")))
    ranges = checkpointed(files.withColumn("start", F.explode(starts)).select("path", "start", F.least("length", F.col("start") + split).alias("stop")))
    tasks = max(1, ranges.count())
    dealt = ranges.repartitionByRange(tasks, "path", "start")
    return _fitted(checkpointed(dealt.mapInArrow(released(_reader(payload)), RECORDS)), files)


def _page(name: Column) -> Column:
    """The page id in a record's name."""
    return F.split_part(name, F.lit(":"), F.lit(3)).try_cast("long")


def pages_of(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the pages that ``write_pages`` wrote."""
    told = records.filter(F.col("record_type").isin("response", "revisit"))
    return told.select(_page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page(F.col("refers_to")).alias("refers_to"))
