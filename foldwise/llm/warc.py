"""WARC archives as seekable Zstandard bundles.

General web pages with id, address and content.  Records are grouped into frames of
about ``frame_bytes`` bytes, each compressed for itself, so a reader decompresses the one
frame that holds its record and nothing else.  A bundle ends with a skippable frame that
lists the sizes of all frames (the public seekable format), and an index maps record ids
to bundle, frame, and offset and length inside the frame; ``read_record`` reads by it.

Pages with equal payloads of at least ``revisit_min_bytes`` bytes are stored once:
the page with the smallest id is the ``response``, the others are ``revisit``
records that refer to it.  Digests that many pages share are salted before they are
joined, so that copies of one page do not meet in one task.

The name of a bundle holds the attempt of the task that wrote it, and the index is
committed by the same task.  A bundle that the index does not name is left from an
attempt that was lost, and is not read.
Bundles hold at most ``bundle_bytes`` of payload and frames at most ``frame_bytes`` of
records, except a single larger record.

Defined results: NULL content is an empty payload, a NULL address an empty one; rows
with equal ids are separate records (the first to be stored is the one revisited);
an empty table gives no bundle and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.tables import small_side
from foldwise.operators.storage import materialize, shared_folder

#: Numbers of the public seekable format (fixed values).
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Date of every record; archives made again from the same pages are equal.
RECORD_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COPIES_PER_SALT = 4096


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", RECORD_DATE), ("WARC-Target-URI", " ".join(url.split())), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict, bytes, bytes]:
    """Fields, HTTP head and payload of one record; lengths are checked."""
    (fields, head, payload, _), *more = split_frame(data)
    if more:
        raise ValueError(f"more than one record at {fields.get('WARC-Record-ID')}")
    return fields, head, payload


def split_frame(data: bytes):
    """Fields, HTTP head, payload and offset of every record of a frame, in turn."""
    at = 0
    while at < len(data):
        top = data.find(b"\r\n\r\n", at)
        first, *lines = data[at:top].decode().split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        begin, size = top + 4, int(fields.get("Content-Length", -1))
        block, end = data[begin:begin + size], begin + size + 4
        if top < 0 or first != "WARC/1.1" or size < 0 or data[begin + size:end] != b"\r\n\r\n":
            raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
        head, _, payload = block.partition(b"\r\n\r\n")
        yield fields, head, payload, at
        at = end


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: compressed and plain size of every frame, count, flags, magic."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle) -> list[tuple[int, int, int]]:
    """``(offset, compressed size, plain size)`` of every frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", bundle[-9 - 8 * n:-9]):
        out.append((at, c, d))
        at += c
    return out


_INDEX = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int64()),
                    ("offset", pa.int64()), ("length", pa.int64())])


def _writer(folder: str, bundle_bytes: int, frame_bytes: int, level: int):
    from pyspark import TaskContext

    def run(batches):
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        state = {"n": 0, "frames": [], "data": bytearray(), "plain": 0, "rows": [], "frame": bytearray()}

        def close_frame():
            if state["frame"]:
                frame = packer.compress(bytes(state["frame"]))
                state["frames"].append((len(frame), len(state["frame"])))
                state["data"] += frame
                state["frame"] = bytearray()

        def close():
            close_frame()
            name = f"bundle-{context.partitionId():06d}-{state['n']:06d}-{context.taskAttemptId()}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
                sink.write(bytes(state["data"]))
                sink.write(seek_table(state["frames"]))
            rows = [(p, r, name, f, o, c) for p, r, f, o, c in state["rows"]]
            state.update(n=state["n"] + 1, frames=[], data=bytearray(), plain=0, rows=[])
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)

        for batch in batches:
            for page, url, html, digest, refers in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                payload = (html or "").encode()
                if state["plain"] and state["plain"] + len(payload) > bundle_bytes:
                    yield close()
                record = warc_record(page, url or "", payload, digest, refers)
                if len(state["frame"]) + len(record) > frame_bytes:
                    close_frame()
                state["rows"].append((page, record_id(page), len(state["frames"]), len(state["frame"]), len(record)))
                state["frame"] += record
                state["plain"] += len(payload)
        if state["rows"]:
            yield close()

    return run


def _base32(hexed: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal number."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*[F.substring(F.lit(letters), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def _with_first(pages: DataFrame, revisit_min_bytes: int) -> DataFrame:
    """``page_id, url, html, digest, refers_to`` with the first page of each payload."""
    light = pages.select("page_id", _digest().alias("digest")).where(_bytes() >= revisit_min_bytes) if revisit_min_bytes else \
        pages.select("page_id", _digest().alias("digest"))
    seen = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = materialize(seen.withColumn("salts", F.ceil(F.col("n") / COPIES_PER_SALT).cast("int")))
    hot = materialize(seen.where("salts > 1").select("digest", "salts"))
    spread = seen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("digest", "salt", "first")
    known = pages.withColumn("digest", _digest()).join(small_side(hot), "digest", "left")
    salted = known.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    joined = salted.join(spread, ["digest", "salt"], "left")
    refers = F.when((F.col("first") != F.col("page_id")) & (_bytes() >= revisit_min_bytes), F.col("first"))
    return joined.select("page_id", "url", "html", _base32(F.col("digest")).alias("digest"), refers.alias("refers_to"))


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")


def _digest() -> Column:
    return F.sha1(_payload())


def _bytes() -> Column:
    return F.octet_length(_payload())


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               revisit_min_bytes: int = 0, bundle_bytes: int = 16 << 20, frame_bytes: int = 256 << 10, level: int = 3) -> DataFrame:
    """Write bundles below ``folder`` (a shared one) and return their index, one row per record.

    ``offset`` and ``length`` are bytes inside the decompressed frame.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    records = _with_first(own, revisit_min_bytes)
    _make_folder(pages.sparkSession, folder)
    return materialize(records.mapInArrow(_writer(folder, bundle_bytes, frame_bytes, level),
                                          "page_id long, record_id string, bundle string, frame long, offset long, length long"))


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def new_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as an address all executors can open."""
    folder = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    return folder if ":" in folder else f"file://{folder}"


def _reader(batches):
    import zstandard

    opener = zstandard.ZstdDecompressor()
    names = ["page_id", "record_id", "record_type", "refers_to", "url", "digest", "payload", "full_bytes", "bundle", "frame"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            name, data, rows = path.as_py().rsplit("/", 1)[-1], memoryview(content.as_buffer()), []
            for k, (at, size, _) in enumerate(read_seek_table(data)):
                for fields, head, payload, _ in split_frame(opener.decompress(data[at:at + size])):
                    rows.append((*_values(fields, head, payload), name, k))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names)


def _values(fields: dict, head: bytes, payload: bytes) -> tuple:
    """``page_id, record_id, record_type, refers_to, url, digest, payload, full_bytes``; the digest of a response is checked."""
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
    return (int(page) if page != "None" else None, fields["WARC-Record-ID"], fields["WARC-Type"], None if refers is None else int(refers),
            fields["WARC-Target-URI"], digest, payload, int(head.rsplit(b"Content-Length: ", 1)[1]))


def read_record(folder: str, row) -> tuple[dict, bytes, bytes]:
    """Fields, HTTP head and payload of one record, given its row of the index.

    Reads the seek table and one frame of the bundle, nothing else of it.
    """
    import zstandard
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{row['bundle']}") as bundle:
        size = bundle.size()
        frames = struct.unpack("<IBI", bundle.read_at(9, size - 9))[0]
        # Footer: magic and length, two numbers a frame, then count, flags and magic.
        table = 8 * frames + 9
        at, packed, _ = read_seek_table(bundle.read_at(table, size - table))[row["frame"]]
        plain = zstandard.ZstdDecompressor().decompress(bundle.read_at(packed, at))
    return parse_record(plain[row["offset"]:row["offset"] + row["length"]])


def read_warc(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All records of the bundles that ``index`` names: ids, type, address, digest, payload (empty in revisits), full length."""
    named = materialize(index.select("bundle").distinct())
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
             .withColumn("bundle", F.element_at(F.split("path", "/"), -1)).join(small_side(named), "bundle", "left_semi"))
    return files.select("path", "content").mapInArrow(_reader, "page_id long, record_id string, record_type string, refers_to long, url string, digest string, "
                                     "payload binary, full_bytes long, bundle string, frame long")
