"""WARC archives: a deterministic sharded writer and a reader.

Shards are stretches of page_id that hold about equal bytes; their bounds come from exact sums over id intervals, heavy intervals being
split again, so the same table gives the same archives whatever its partitions. A shard is a partition of a range sort. Within a shard, records stand by page_id; a
file is closed once its compressed size passes `roll_bytes`. Files are written under temporary names and renamed; names and contents
depend on the data alone, so a task that runs twice replaces a file by itself. The manifest, written last, says which files
count.

Records are one gzip member each. Of equal payloads the smallest page_id is a response, the others are revisits
that refer to it. Which ones is found on (digest, page_id) alone: payloads are shuffled once, to their shard, where each page meets its decision row.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, table_path

#: Payloads under so many bytes are always written whole.
REVISIT_BYTES = 100
ROLL_BYTES = 16 << 20
SHARD_BYTES = 64 << 20
LEAST_SHARDS = 64
#: Id intervals summed for each shard.
INTERVALS = 4
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("b7f4c2f0-6f0e-4b55-9d0e-2f6f4f0d9a11")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def member(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; equal input gives equal bytes."""
    fields = [
        ("WARC-Type", kind),
        *fields,
        ("WARC-Date", DATE),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id, url: str, payload: bytes, digest: str, first) -> bytes:
    """The record of one page: a revisit of page `first`, or a response where that is None."""
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if first is None:
        return member("response", fields, http + payload)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-Id", str(first))]
    return member("revisit", fields, http)


def shard_map(sizes: DataFrame, shard_bytes: int, least: int) -> tuple[list[tuple[int, int, int]], int]:
    """([(shift, interval, shard)], number of shards): shards are stretches of page ids. sizes: (page_id, bytes).

    Bytes are summed over id intervals, the ids that share all but their lowest `shift` bits, about INTERVALS a shard; intervals heavier than a quarter
    shard are summed again over 64 parts each, until none is or they are single ids. What the driver sees are a few numbers for each
    shard of `shard_bytes`.
    """
    lo, hi, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if lo is None or not total:
        return [], 1
    want = max(1, min(total // least, shard_bytes))
    shift = max(0, (hi - lo).bit_length() - (INTERVALS * (total // want + 1)).bit_length())
    rows, light = sizes.where("page_id is not null"), []
    while True:
        sums = rows.groupBy(F.shiftright("page_id", shift).alias("j")).agg(F.sum("bytes").alias("n")).collect()
        light += [(r["j"] << shift, shift, r["j"], r["n"]) for r in sums if not shift or r["n"] <= want / INTERVALS]
        heavy = [(r["j"],) for r in sums if shift and r["n"] > want / INTERVALS]
        if not heavy:
            break
        listed = sizes.sparkSession.createDataFrame(heavy, "j long")
        rows = rows.join(F.broadcast(listed), F.shiftright("page_id", shift) == F.col("j"), "left_semi")  # INTERVALS rows a shard at most
        shift = max(0, shift - 6)
    out, shard, filled = [], 0, 0
    for _, by, j, n in sorted(light):
        if filled and filled + n > want:
            shard, filled = shard + 1, 0
        filled += n
        out.append((by, j, shard))
    return out, shard + 1


def with_shard(rows: DataFrame, placed: list[tuple[int, int, int]]) -> DataFrame:
    """rows (page_id, ...) with their shard; null ids are in the first. One lookup for each width of intervals, of which there are a few."""
    spark = rows.sparkSession
    shard = F.lit(None).cast("int")
    for shift in sorted({x[0] for x in placed}):
        listed = spark.createDataFrame([(j, k) for by, j, k in placed if by == shift], f"__j{shift} long, __k{shift} int")
        rows = rows.join(F.broadcast(listed), F.shiftright("page_id", shift) == F.col(f"__j{shift}"), "left").drop(f"__j{shift}")  # a few rows a shard
        shard = F.coalesce(shard, F.col(f"__k{shift}"))
    found = rows.withColumn("shard", F.coalesce(shard, F.lit(0)))
    return found.drop(*[c for c in found.columns if c.startswith("__k")])


def write(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Write pages (page_id, url, html, any more columns) under `path`, a folder all executors share; returns the manifest.

    The manifest (file, records, bytes, sha256) has a row per committed file and is stored at path/manifest. A null html is an empty
    payload and a null url an empty one. Rows with the smallest page_id of a payload are responses, however
    often they repeat; a null page_id is no smallest one unless all are null. An empty table writes no file and an empty manifest.
    """
    spark = pages.sparkSession
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    # digests once: what decides on revisits never reads a payload again
    slim = materialise(full.select("page_id", "digest", "bytes"), "warc-digests")
    placed, shards = shard_map(slim.select("page_id", "bytes"), shard_bytes, least_shards)
    large = slim.where(F.col("bytes") >= REVISIT_BYTES)
    first = (
        large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    )
    verdicts = large.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    records = full.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first")).unionByName(
        verdicts.select(
            "page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first",
        )
    )
    # shard numbers are partition numbers: every task has one whole shard, a stretch of ids, which it sorts
    rows = (
        with_shard(records, placed)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")
        .select("shard", "page_id", "digest", "kind", "url", "payload", "first")
    )

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out = None

        def close(o):
            data = b"".join(o["members"])
            name = f"pages-{o['shard']:06d}-{o['roll']:05d}.warc.gz"
            with store.open_output_stream(temp := f"{root}/.{name}.{uuid.uuid4().hex}.tmp") as f:
                f.write(data)
            store.move(temp, f"{root}/{name}")
            return {"file": name, "records": o["records"], "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}

        def opened(at, roll):
            info = [("WARC-Record-ID", record_id("info", f"{at}:{roll}")), ("Content-Type", "application/warc-fields")]
            m = member("warcinfo", info, b"software: tempora\r\nformat: WARC File Format 1.1\r\n")
            return {"shard": at, "roll": roll, "members": [m], "size": len(m), "records": 0}

        verdict = None
        for pdf in batches:
            done = []
            for at, page, digest, kind, url, payload, first_id in zip(
                pdf["shard"], pdf["page_id"], pdf["digest"], pdf["kind"], pdf["url"], pdf["payload"], pdf["first"], strict=True
            ):
                page = None if pd.isna(page) else int(page)
                if kind == 0:
                    verdict = (at, page, digest, int(first_id))
                    continue
                if out and (out["shard"] != at or out["size"] >= roll_bytes):
                    done.append(close(out))
                    out = opened(at, out["roll"] + 1 if out["shard"] == at else 0)
                out = out or opened(at, 0)
                first = verdict[3] if verdict and verdict[:3] == (at, page, digest) else None
                m = page_record(page, url, bytes(payload), digest, first)
                out["members"].append(m)
                out["size"] += len(m)
                out["records"] += 1
            if done:
                yield pd.DataFrame(done)
        if out:
            yield pd.DataFrame([close(out)])

    manifest = rows.mapInPandas(run, "file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def parse(data: bytes):
    """(header fields, block) of each record of an archive, one gzip member after the other."""
    import zlib

    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(memoryview(data)[at:])
        at = len(data) - len(z.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read(spark, path: str) -> DataFrame:
    """Records of the archives that the manifest at `path` lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    Sizes and digests of responses are taken from the payload as read, and a block or payload that differs from its header fails the
    job. A revisit has no payload: html is null, size and digest are those its header states.
    """
    listed = spark.read.parquet(f"{path}/manifest").select("file", F.col("sha256").alias("_sha"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(listed, "file")

    def run(batches):
        for pdf in batches:
            for data, sha in zip(pdf["content"], pdf["_sha"], strict=True):
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError("an archive differs from its manifest")
                out = []
                for fields, block in parse(bytes(data)):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    if fields["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
                    digest, size, html = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Bytes"]), None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                        html = payload.decode("utf-8", "replace")
                    page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                    out.append(
                        {
                            "page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
                            "record_type": kind, "refers_to": int(refers) if refers else None, "html": html,
                        }
                    )
                if out:
                    got = pd.DataFrame(out)
                    yield got.astype({"page_id": "Int64", "refers_to": "Int64"})

    return named.mapInPandas(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into the shared folder and read the archives back, without the payloads."""
    path = table_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
