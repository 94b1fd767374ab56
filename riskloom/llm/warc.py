"""WARC archives of pages, and an external merge of their capture indexes.

Each task writes archives of bounded size into the shared folder and names them in its result;
archives of lost tasks are named nowhere and never read. Reading an archive back gives one run:
its captures sorted by URL key, time and id, in a file of small row groups. Runs are merged by
loser trees: splitters taken from the runs cut the key space into ranges, and a task merges one
range of up to FAN_IN runs, reading only the row groups that meet it. More runs than that are
merged in several passes; which files a job reads is named by a table of runs and by file names, so the
driver holds no more than RANGES splitters, however many runs there are. Ranges in order are the global capture histories; a hot URL is cut
like anything else, as the time and the id belong to the key.

Of records with equal payloads of at least `least` bytes the one with the largest id is stored
whole; the others become revisits that refer to it.

Defined results: a null html is the empty payload; a null URL has the empty key; a null id
is written as such and sorts first; rows repeated with their id are responses all of them; an
empty table gives no rows. Pages of any length are one record each. Only the columns named are
read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import BROADCAST_BYTES, free, scratch_path, spread, stash

ARCHIVE_BYTES = 64 << 20
FAN_IN = 64
GROUP_ROWS = 4096
RANGE_ROWS = 200_000
#: Splitters are chosen from about so many keys; there are so many ranges at most.
SAMPLES, RANGES = 50_000, 1 << 16
#: Digests on more than this share of the pages are decided before any shuffle.
SUPPORT = 1 / 2000
NAMES = ["url_key", "captured", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "archive", "offset"]
SCHEMA = "url_key string, captured long, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long"
ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in SCHEMA.split(", "))])


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, without scheme, fragment and www; query parameters sorted."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/").lower() + ("?" + query if query else "")


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stamp(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url: str | None, captured: int, payload: bytes, refers_to=None) -> bytes:
    """One gzipped WARC record: a response, or a revisit if it refers to another."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}",
        f"WARC-Date: {stamp(captured)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream."""
    at, left = 0, b""
    while left or (left := stream.read(size)):
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(inflate.decompress(left))
            used += len(left)
            if inflate.eof:
                left = inflate.unused_data
                break
            left = stream.read(size)
            if not left:
                raise ValueError(f"the archive ends inside the record at {at}")
        used -= len(left)
        yield at, b"".join(parts)
        at += used


def parse(content: bytes) -> dict:
    """Type, id, URL, time, digest and payload size of a record; a response's digest is checked."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't the one that was written")
    number = lambda name: (lambda x: None if x == "None" else int(x))(fields[name][10:-1]) if name in fields else None
    when = datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    return {"type": fields["WARC-Type"], "id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "captured": int(when.timestamp()), "digest": named, "bytes": size, "refers_to": number("WARC-Refers-To")}


def with_winners(source: DataFrame, winners: DataFrame) -> DataFrame:
    """source with winner, by its sha; winners: sha, winner, n.

    Few winners are broadcast, and no page is shuffled. Of many, those of frequent digests still are,
    and the pages of all others meet their winners by sha, decided ones spread evenly.
    """
    count, total = winners.agg(F.count("*"), F.sum("n")).first()
    named = winners.select("sha", "winner")
    if count * 64 <= BROADCAST_BYTES:
        return source.join(F.broadcast(named), "sha", "left")
    frequent = F.col("n") > F.lit(max(1.0, SUPPORT * total))  # fewer than 1/SUPPORT digests
    hot, rest = winners.filter(frequent).select("sha", F.col("winner").alias("hot")), winners.filter(~frequent)
    some = source.join(F.broadcast(hot), "sha", "left")
    key = F.when(F.col("hot").isNull() & F.col("sha").isNotNull(), F.col("sha")).otherwise(F.unhex(F.md5(F.monotonically_increasing_id().cast("string"))))
    found = some.withColumn("key", key).join(rest.select(F.col("sha").alias("key"), "winner"), "key", "left")
    return found.withColumn("winner", F.coalesce("hot", "winner")).drop("hot", "key")


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Archives of all pages in folder; one row per archive: path, n_records.

    time_col: seconds since 1970 of the capture; without it the id stands for them.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    when = F.coalesce(F.col(time_col or id_col).cast("long"), F.lit(0))
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.greatest(F.lit(0), F.least(when, F.lit(253_402_300_799))).alias("captured"))
    source = source.withColumn("sha", F.when(F.octet_length("html") >= least, F.unhex(F.sha1("html"))))
    repeated = source.filter(F.col("sha").isNotNull()).select("sha", "id").groupBy("sha").agg(F.max("id").alias("winner"), F.count("*").alias("n")).filter("n > 1")
    decided = with_winners(source, stash(repeated, "winners"))
    refers = F.when(~F.col("winner").eqNullSafe(F.col("id")), F.col("winner"))

    def run(batches):
        import uuid

        from pyspark import TaskContext

        disk, base = file_system(folder)
        disk.create_dir(base, recursive=True)
        out, path, size, count = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, captured, refers_to in zip(*(c if k == 2 else c.to_pylist() for k, c in enumerate(batch.columns)), strict=True):
                if out is None:
                    path, size, count = f"part-{TaskContext.get().partitionId():05d}-{len(done):03d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = disk.open_output_stream(f"{base}/{path}", compression=None)  # records are compressed one by one
                data = record(page_id, url, captured, payload.as_py().encode(), refers_to)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])

    rows = decided.select("id", "url", "html", "captured", refers.alias("refers_to"))
    return stash(rows.mapInArrow(run, "path string, n_records long"), "archives")


def _sort_key(row: dict | tuple) -> tuple:
    return (row[0], row[1], -(1 << 63) if row[2] is None else row[2], row[7], row[8])


def read_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Reads every archive and writes its sorted captures; one row per run: path, n_rows, keys (a sample)."""

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                disk, place = file_system(archive)
                rows = []
                with disk.open_input_stream(place, compression=None) as stream:
                    for offset, content in members(stream):
                        r = parse(content)
                        rows.append((url_key(r["url"]), r["captured"], r["id"], r["type"], r["digest"], r["bytes"], r["refers_to"], archive, offset))
                rows.sort(key=_sort_key)
                path = f"{folder}/{archive.rsplit('/', 1)[-1].removesuffix('.warc.gz')}.parquet"
                write_run(path, iter([rows]))
                step = max(1, len(rows) // 64)
                keys = [[k[0], str(k[1]), str(k[2]), k[3], str(k[4])] for k in map(_sort_key, rows[step // 2 :: step])]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(rows)], pa.int64()), pa.array([keys], pa.list_(pa.list_(pa.string())))], ["path", "n_rows", "keys"])

    n = max(1, archives.count())
    spark = archives.sparkSession
    tasks = archives.select("path").repartition(min(n, 4 * spread(spark)))
    return stash(tasks.mapInArrow(run, "path string, n_rows long, keys array<array<string>>"), "runs")


def write_run(path: str, chunks: Iterator[list[tuple]]) -> None:
    disk, place = file_system(path)
    disk.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with disk.open_output_stream(place) as f, pq.ParquetWriter(f, ARROW) as out:
        for rows in chunks:
            if rows:
                out.write_batch(to_batch(rows), row_group_size=GROUP_ROWS)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def read_slice(path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple[tuple, tuple]]:
    """(key, row) of a run with low <= key < high, reading only row groups that may hold some."""
    disk, place = file_system(path)
    with disk.open_input_file(place) as f:
        table = pq.ParquetFile(f)
        for g in range(table.num_row_groups):
            stats = table.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and (high is not None and stats.min > high[0] or low is not None and stats.max < low[0]):
                continue
            part = table.read_row_group(g)
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                key = _sort_key(row)
                if (low is None or key >= low) and (high is None or key < high):
                    yield key, row


def merged(runs: list[Iterator[tuple[tuple, tuple]]]) -> Iterator[tuple]:
    """The rows of sorted runs in order, by a tree of losers: one path of matches for each row."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    beats = lambda a, b: heads[b] is None or heads[a] is not None and (heads[a][0], a) <= (heads[b][0], b)
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while heads[top] is not None:
        yield heads[top][1]
        heads[top] = next(runs[top], None)
        node = (top + k) // 2
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


def chunked(rows: Iterator[tuple], size: int = GROUP_ROWS) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def splitters(runs: DataFrame, total: int, range_rows: int) -> list[tuple]:
    """Keys that cut the captures into about equal ranges, from a bounded sample of the runs' keys."""
    count = runs.count()
    kept = runs if count <= SAMPLES else runs.filter(F.pmod(F.xxhash64("path"), F.lit(count // SAMPLES + 1)) == 0)
    every = max(1, 64 * min(count, SAMPLES) // SAMPLES)
    sample = kept.select(F.explode(F.filter("keys", lambda _, i: i % every == 0)).alias("k"))
    keys = sorted((k[0], int(k[1]), int(k[2]), k[3], int(k[4])) for (k,) in sample.toLocalIterator())
    n = max(1, min(len(keys), RANGES, -(-total // range_rows)))
    return sorted({keys[len(keys) * i // n] for i in range(1, n)})


def grouped(files: DataFrame, fan_in: int, tasks: int) -> DataFrame:
    """job, files: the names in groups of up to fan_in, numbered by the task and the place where they stand."""

    def run(batches):
        from pyspark import TaskContext

        task, held, k = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= fan_in:
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{k}"]), pa.array([held[:fan_in]], pa.list_(pa.string()))], ["job", "files"])
                held, k = held[fan_in:], k + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{k}"]), pa.array([held], pa.list_(pa.string()))], ["job", "files"])

    return files.repartitionByRange(tasks, "file").sortWithinPartitions("file").mapInArrow(run, "job string, files array<string>")


def merge_runs(spark: SparkSession, runs: DataFrame, folder: str, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order: partitions are consecutive ranges, each in order.

    A file is a run's own, or `<pass>/<job>/` with one file for each range. Jobs of one name write
    the same rows; the first to end names the file.
    """
    total, left = runs.agg(F.sum("n_rows"), F.count("*")).first()
    cuts = splitters(runs, total or 0, range_rows)
    bounds = spark.sparkContext.broadcast(list(zip([None, *cuts], [*cuts, None], strict=True)))
    n = len(cuts) + 1
    files = stash(runs.select(F.col("path").alias("file")), "files")
    step = 0
    while left > fan_in:
        target = f"{folder}/pass-{step}"

        def merge_group(batches, target=target):
            for batch in batches:
                for job, names, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    write_run_once(f"{target}/{job}/{r}.parquet", chunked(merged([read_slice(part_of(f, r), *bounds.value[r]) for f in names])))
                    yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{job}/"])], ["file"])

        jobs = stash(grouped(files, fan_in, max(1, left // (16 * fan_in))), "jobs")
        every = jobs.select("job", "files", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("r"))
        done = stash(every.repartition(min(left // fan_in * n + 1, 64 * spread(spark)), "job", "r").mapInArrow(merge_group, "file string"), "merged")
        free(files, jobs)
        files = stash(done.distinct(), "files")
        left = files.count()
        step += 1
    last = sorted(r.file for r in files.collect())  # fan_in names at most

    def merge_range(batches):
        for batch in batches:
            for r in batch.column(0).to_pylist():
                for rows in chunked(merged([read_slice(part_of(f, r), *bounds.value[r]) for f in last])):
                    yield to_batch(rows)

    return spark.range(0, n, 1, n).mapInArrow(merge_range, SCHEMA)


def part_of(file: str, r: int) -> str:
    return f"{file}{r}.parquet" if file.endswith("/") else file


def write_run_once(path: str, chunks: Iterator[list[tuple]]) -> None:
    """Write a run under another name and give it its own at the end, unless another attempt has done so."""
    import uuid

    disk, place = file_system(path)
    own = f"{path}.{uuid.uuid4().hex}"
    write_run(own, chunks)
    hidden = file_system(own)[1]
    try:
        disk.move(hidden, place)
    except OSError:
        if disk.get_file_info(place).type.name != "File":
            raise
        disk.delete_file(hidden)


def capture_histories(pages: DataFrame, least: int = 0, **columns) -> DataFrame:
    """Write pages to archives, read them back, and merge their indexes: SCHEMA, in global order."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    archives = write_archives(pages, f"{folder}/archives", least, **columns)
    return merge_runs(spark, read_runs(archives, f"{folder}/runs"), folder)
