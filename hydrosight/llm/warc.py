"""WARC archives with an index, and reading by coalesced byte ranges.

``write_warc`` writes one ``.warc.gz`` a task (each record its own gzip member)
and returns the index: file, offset, length, url, digest, type and ids of each
record. A task streams its rows; the name of its file holds the attempt, so a
repeated task leaves an orphan that no index row names. Of records with equal
payloads the largest id is the response; the others become revisit records
that name it, decided by one row a digest (pre-aggregated), so a payload that
a third of the rows share is split by AQE's skew join.

``read_warc`` takes the index rows that are wanted, sorts them by place, joins
neighbours whose gap is at most ``max_gap`` into reads of at most ``max_read``
bytes, and parses the records out of them. A response's digest is computed
again from the bytes read; a difference stops the job.

Files are reached by URI through Arrow's file systems, in the folder given
(the query: the shared folder of ``spark.checkpoint.dir``).

Defined cases
    null payload         the empty payload
    very long payload    one record, written and read whole
    payloads < min_bytes all responses, never revisited
    null id              read back as null; a digest held by null ids only has
                         responses only
    repeated rows        rows of the largest id are all responses
    null url, line ends  the header holds the url with CR and LF as %0D and %0A,
                         and nothing for a null; the index has the url itself
    empty table          an empty index and no file
    clashing columns     only id, url and payload columns are read
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.llm.common import arrow_fs, arrow_uri, bound_batches, parallelism

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("page_id bigint, url string, file string, offset bigint, length bigint, "
         "record_type string, payload_digest string, refers_to bigint")
RECORD = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, "
          "record_type string, refers_to bigint, payload binary")


def _urn(i) -> str:
    return f"<urn:x-page:{'null' if i is None else i}>"


def _id(urn: str):
    text = urn.strip().removeprefix("<urn:x-page:").removesuffix(">")
    return None if text == "null" else int(text)


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A WARC 1.1 record; a revisit (``refers_to`` given) has the HTTP header only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; checks a response's digest against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "")
                  for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sized = next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    out = {"page_id": _id(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
           "payload_bytes": int(sized.split(b":")[1]),
           "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
           "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = _id(fields["WARC-Refers-To"])
    else:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (out["payload_digest"], out["payload_bytes"]):
            raise ValueError(f"record {fields['WARC-Record-ID']}: payload differs from its header")
        out["payload"] = payload
    return out


def _writer(folder: str, date: str, level: int):
    def run(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        out, place = None, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        fs, root = arrow_fs(folder)
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        info = b"software: hydrosight\r\nformat: WARC File Format 1.1\r\n"
                        head = gzip.compress(
                            f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}>\r\n"
                            f"WARC-Date: {date}\r\nContent-Type: application/warc-fields\r\n"
                            f"Content-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n",
                            level, mtime=0)
                        out.write(head)
                        place = len(head)
                    digest = base64.b32encode(r["digest"]).decode()
                    data = gzip.compress(record(r["page_id"], r["url"], r["payload"], digest,
                                                r["refers_to"], date), level, mtime=0)
                    out.write(data)
                    rows.append((r["page_id"], r["url"], f"{folder}/{name}", place, len(data),
                                 "response" if r["refers_to"] is None else "revisit", digest,
                                 r["refers_to"]))
                    place += len(data)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                         pa.string(), pa.int64())
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)
        finally:
            if out is not None:
                out.close()
    return run


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
               level: int = 4) -> DataFrame:
    """Write the rows as archives under ``folder`` and return the index, which
    is itself a Parquet table in ``folder``/index."""
    spark = df.sparkSession
    arrow_uri(folder)  # a store that tasks cannot write to is refused before the first stage
    bound_batches(spark)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.col(id_col).cast("bigint").alias("page_id"),
                     F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    latest = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
              .agg(F.max("page_id").alias("latest")))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))
    decided = (rows.join(latest.hint("shuffle_hash"), "digest", "left")
               .select("page_id", "url", "payload", "digest", refers.alias("refers_to")))
    decided.mapInArrow(_writer(f"{folder}/archives", date, level), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(max_gap: int, max_read: int, with_payload: bool):
    def run(batches):
        fs, name, source = None, None, None

        def fetch(run_):
            nonlocal fs, name, source
            if run_[0]["file"] != name:
                name = run_[0]["file"]
                fs, path = arrow_fs(name)
                if source is not None:
                    source.close()
                source = fs.open_input_file(path)
            first, last = run_[0], run_[-1]
            data = source.read_at(last["offset"] + last["length"] - first["offset"], first["offset"])
            out = []
            for x in run_:
                a = x["offset"] - first["offset"]
                out.append(parse(zlib.decompress(data[a:a + x["length"]], 31)) | {"url": x["url"]})
                if not with_payload:
                    out[-1]["payload"] = None
            kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(),
                     "payload_digest": pa.string(), "record_type": pa.string(),
                     "refers_to": pa.int64(), "payload": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in kinds.items()],
                                              names=list(kinds))
        held: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                if held and (x["file"] != held[0]["file"]
                             or x["offset"] - held[-1]["offset"] - held[-1]["length"] > max_gap
                             or x["offset"] + x["length"] - held[0]["offset"] > max_read):
                    yield fetch(held)
                    held = []
                held.append(x)
        if held:
            yield fetch(held)
        if source is not None:
            source.close()
    return run


def read_warc(index: DataFrame, max_gap: int = 64 << 10, max_read: int = 8 << 20,
              with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name. A revisit has no payload."""
    # tasks by the bytes that they will read, not by the size of the index rows
    wanted = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(parallelism(index.sparkSession), wanted // (64 << 20))
    places = (index.select("file", "offset", "length", "url")
              .repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset"))
    return places.mapInArrow(_reader(max_gap, max_read, with_payload), RECORD)
