"""WARC archives: a writer with one gzip member per record, and a splittable reader.

The reader gives each task a byte range of a file. The task looks for the gzip magic inside its
range, accepts a hit only if the member there decodes to a WARC header, and from then on walks
from member to member. It owns the records whose member starts inside its range and reads past its
end to finish the last one, so every record is read by exactly one task, however the file is cut.

Archives of other writers are read too: header names in any case, folded header lines, every record
type, ids that are no numbers of ours, several records in one member. ``page_id`` and ``refers_to``
are null where an id is foreign; ``record_id`` is the text as it stands. The payload of a record of
type application/http is what follows the HTTP header, as stored; of others it is the whole block.
A revisit has no payload; its size and digest are those that it declares, or null. A member that
can't be decoded is one row of type ``broken``, and reading goes on at the next member found.
Where a payload is itself an archive that the compressor left as it was, a range that begins inside
it takes the inner members for records: cut such files at member borders, or not at all.

Payloads of at least ``least_revisit`` bytes that occur more than once are stored once, with the
largest key; the others become revisit records that name it.

Defined cases: a null payload is empty and is a response; a null url is written without a target;
rows of one key and payload repeat each other: the largest key is response in every such row; a
null key is written as such and comes before all others. Other columns are not written. An empty
table gives no records. Files are written through Arrow's file systems, under a name of the
attempt, and renamed when whole, so a task may run again.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_REVISIT = 1000
SPLIT_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
# Bytes of a candidate read at once to decode the first line of its header, and at most.
PROBE_BYTES = 512
MOST_PROBE_BYTES = 128 << 10
# A member is read in steps that double between these.
FIRST_BYTES = 16 << 10
READ_BYTES = 1 << 20
FILE_BYTES = 128 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

RECORDS = (
    "path string, start long, record_no int, record_id string, page_id long, url string, "
    "record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
)


def record_id(key):
    """A URN that holds the key: its 64 bits, and a mark in front for null."""
    number = (1 << 64) if key is None else key & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def key_of(urn):
    """The key that ``record_id`` put into a URN; null for null, and for ids of other writers."""
    try:
        number = uuid.UUID((urn or "").strip("<> ").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if number >> 64:
        return None
    return number - (1 << 64) if number >> 63 else number


def member(key, url, payload, refers_to=None):
    """One gzip member with the record of a page; a revisit if ``refers_to`` is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def header_fields(lines):
    """Header lines as a dict with lower-case names; of a repeated name the first value."""
    joined = []
    for line in lines:
        if line[:1] in (" ", "\t") and joined:
            joined[-1] += " " + line.strip()
        else:
            joined.append(line)
    fields = {}
    for line in joined:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def _whole(text):
    """A header's number, or None."""
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


def sha1_hex(declared):
    """A declared digest as bare lower-case hex, or None if it is no SHA-1."""
    name, _, value = (declared or "").partition(":")
    if name.strip().lower() != "sha1":
        return None
    try:
        data = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return data.hex() if len(data) == 20 else None


class Broken(Exception):
    """A member that is no row of whole records."""


def head_of(data):
    """(header fields, start of the block, its size) of a decoded record, or None if it isn't all there."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = header_fields(bytes(data[:end]).decode("utf-8", "replace").split("\r\n")[1:])
    size = _whole(fields.get("content-length"))
    if size is None:
        raise Broken("a record without its length")
    return fields, end + 4, size


def parse(fields, block):
    """A record as a dict, from its header fields and its block."""
    kind = fields.get("warc-type", "").lower()
    payload, size, digest = block, None, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = _whole(header_fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length"))
    if kind == "revisit":
        payload, digest = None, sha1_hex(fields.get("warc-payload-digest"))
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return {
        "record_id": fields.get("warc-record-id"),
        "page_id": key_of(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": key_of(fields.get("warc-refers-to")),
    }


BROKEN = {
    "record_id": None, "page_id": None, "url": None, "record_type": "broken", "payload": None,
    "payload_bytes": None, "payload_digest": None, "refers_to": None,
}


class RangeReader:
    """Records of one file that start in [start, stop)."""

    def __init__(self, file, start, stop, size):
        self.file, self.start, self.stop, self.size = file, start, stop, size

    def _at(self, place, count):
        return self.file.read_at(max(0, min(count, self.size - place)), place)

    def _probe(self, place):
        """Whether a member with a WARC header starts here."""
        decoder, got, read = zlib.decompressobj(31), b"", 0
        try:
            while len(got) < 5 and read < MOST_PROBE_BYTES and not decoder.eof:
                data = self._at(place + read, PROBE_BYTES)
                if not data:
                    break
                read += len(data)
                got += decoder.decompress(decoder.unconsumed_tail + data, 5 - len(got))
        except zlib.error:
            return False
        return got == b"WARC/"

    def _next(self, place):
        """Where the first record at or after ``place`` starts, or None beyond the range."""
        while place < self.stop:
            data = self._at(place, min(READ_BYTES, self.stop - place) + len(MAGIC) - 1)
            if not data:
                return None
            at = data.find(MAGIC)
            while at >= 0 and place + at < self.stop:
                if self._probe(place + at):
                    return place + at
                at = data.find(MAGIC, at + 1)
            place += READ_BYTES
        return None

    def _member(self, place):
        """Yields the decoded parts of the member at ``place``; ``self.after`` is what follows it."""
        decoder, step = zlib.decompressobj(31), FIRST_BYTES
        while not decoder.eof:
            data = self._at(place, step)
            if not data:
                raise Broken("a member is cut short")
            step = min(2 * step, READ_BYTES)
            part = decoder.decompress(data)
            place += len(data) - len(decoder.unused_data)
            self.after = place
            yield part

    def _member_records(self, place):
        """The records of one member, each as soon as its block is whole."""
        held, head = bytearray(), None
        for part in self._member(place):
            held += part
            while True:
                if head is None:
                    # Records are parted by empty lines.
                    del held[: len(held) - len(held.lstrip(b"\r\n"))]
                    if held[:5] != b"WARC/"[: len(held)]:
                        raise Broken("no record where one should start")
                    head = head_of(held)
                if head is None or len(held) < head[1] + head[2]:
                    break
                fields, start, size = head
                yield parse(fields, bytes(held[start : start + size]))
                del held[: start + size]
                head = None
        if held:
            raise Broken("a record is cut short")

    def records(self):
        """(start of the member, number in the member, record) of every record of the range."""
        place = self._next(self.start)
        while place is not None:
            number = 0
            try:
                for found in self._member_records(place):
                    yield place, number, found
                    number += 1
                after = self.after
            except (zlib.error, Broken):
                yield place, number, dict(BROKEN)
                after = place + 1
            follows = after < min(self.stop, self.size) and self._probe(after)
            place = after if follows else self._next(after)


def mark_revisits(pages, key="page_id", payload="html", least_revisit=LEAST_REVISIT):
    """page_id, url, payload, refers_to: which rows repeat the payload of a larger key."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), url.alias("url"), body.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least_revisit, F.sha1("payload"))
    rows = rows.withColumns({"digest": digest, "n": F.octet_length("payload")})
    shared = (
        rows.filter("digest is not null")
        .groupBy("digest", "n")
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
        .filter("first < last")
        .select("digest", "n", "last")
    )
    return rows.join(shared, ["digest", "n"], "left").select(
        "page_id",
        "url",
        "payload",
        F.when(F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()), F.col("last")).alias("refers_to"),
    )


def write(pages, folder, key="page_id", payload="html", least_revisit=LEAST_REVISIT, file_bytes=FILE_BYTES):
    """Write archives to ``folder``, a URI on shared storage; return the list of their files."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        number, out, name, size, rows = 0, None, None, 0, 0
        made = []

        def close():
            out.close()
            final = name.rpartition(".tmp-")[0]
            store.move(name, final)
            made.append((final, size, rows))

        for batch in batches:
            for page, url, body, refers in zip(*(c for c in batch.columns)):
                if out is None:
                    final = f"{base}/part-{context.partitionId():06d}-{number:04d}.warc.gz"
                    name = f"{final}.tmp-{context.taskAttemptId()}"
                    out, size, rows, number = store.open_output_stream(name, compression=None), 0, 0, number + 1
                data = member(page.as_py(), url.as_py(), body.as_py(), refers.as_py())
                out.write(data)
                size, rows = size + len(data), rows + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        paths, sizes, counts = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=["path", "bytes", "records"],
        )

    marked = mark_revisits(pages, key, payload, least_revisit)
    return marked.mapInArrow(run, "path string, bytes long, records long")


def archives(spark, folder):
    """path and bytes of the archives in ``folder``, a file or a folder URI."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    info = store.get_file_info(base)
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
    else:
        found = [info] if info.type == fs.FileType.File else []
    files = sorted((x.path, x.size) for x in found if x.path.endswith(".warc.gz"))
    return spark.createDataFrame(files, "path string, bytes long")


def read(spark, folder, split_bytes=SPLIT_BYTES, payloads=True, files=None):
    """All records of the archives in ``folder``, a file or a folder URI.

    ``files`` has the path and bytes of the archives to read, such as the list that ``write`` gives;
    files that a lost attempt left in the folder are then not read. Without it the folder is listed.
    """
    listed = (archives(spark, folder) if files is None else files).select("path", F.col("bytes").cast("long"))
    step = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = listed.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("bytes") / split_bytes)))).first()[0]
    splits = listed.select("path", "bytes", F.explode(step).alias("start"))
    splits = splits.repartition(max(1, int(ranges or 0)))

    schema = T._parse_datatype_string(RECORDS)

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        target = pa.schema(
            [("path", pa.string()), ("start", pa.int64()), ("record_no", pa.int32()), ("record_id", pa.string()),
             ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
             ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("refers_to", pa.int64())]
        )
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for place, number, found in RangeReader(file, start, start + split_bytes, size).records():
                        held += len(found["payload"] or b"")
                        if not payloads:
                            found["payload"] = None
                        rows.append({"path": path, "start": place, "record_no": number, **found})
                        if held >= READ_BYTES * 8:
                            yield pa.RecordBatch.from_pylist(rows, target)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, target)

    return splits.mapInArrow(run, schema)
