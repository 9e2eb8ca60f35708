"""Transfer requests as plans: advertise refs, fetch object sets, take pushes; and the framing they use."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import ref_command_kind, ref_kind
from ..operators.graph import full_set, incremental_set

SMALL_BAND, LARGE_BAND = 995, 65_515
CAPABILITIES = "report-status delete-refs ofs-delta side-band-64k agent=quarrybed"


def packet(data: bytes | str) -> bytes:
    """A line with its length in four hex digits."""
    data = data.encode() if isinstance(data, str) else data
    if len(data) > 65_516:
        raise ValueError("too long for a packet")
    return b"%04x" % (len(data) + 4) + data


FLUSH = b"0000"


def read_packets(data: bytes) -> tuple[list[bytes | None], int]:
    """(packets, place after them); None stands for a flush. Stops at what is no packet."""
    out, at = [], 0
    while at + 4 <= len(data):
        try:
            n = int(data[at : at + 4], 16)
        except ValueError:
            break
        if n == 0:
            out.append(None)
            at += 4
        elif n < 4 or at + n > len(data):
            break
        else:
            out.append(data[at + 4 : at + n])
            at += n
    return out, at


def side_band(data: bytes, band: int = 1, large: bool = True) -> list[bytes]:
    """Packets of a byte stream: 1 data, 2 progress, 3 error."""
    size = LARGE_BAND if large else SMALL_BAND
    return [packet(bytes((band,)) + data[k : k + size]) for k in range(0, len(data), size)]


def chunk_table(rows: DataFrame, key: str, data: str, size: int = LARGE_BAND) -> DataFrame:
    """key, seq, start, length, chunk: payloads cut as a side band does."""
    n = F.octet_length(F.col(data).cast("binary"))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cut = rows.select(key, F.col(data).cast("binary").alias("_d"), F.posexplode(starts).alias("seq", "start"))
    return cut.select(key, "seq", "start", F.least(F.lit(size), F.octet_length("_d") - F.col("start")).alias("length"), F.substring("_d", F.col("start") + 1, F.lit(size)).alias("chunk"))


def head_ref(refs: DataFrame) -> DataFrame:
    """The ref that stands for the head: HEAD, or the first one that ends in /main or /master."""
    rank = F.when(F.col("name") == "HEAD", 0).when(F.endswith("name", F.lit("/main")), 1).when(F.endswith("name", F.lit("/master")), 1)
    return refs.withColumn("_k", rank).where("_k IS NOT NULL").orderBy("_k", "name").limit(1).drop("_k")


def advertise(refs: DataFrame, service: str, capabilities: str = CAPABILITIES, id_hex: int = 40) -> bytes:
    """The ref advertisement: refs by name, the head first, capabilities on the first line. Ids of another length are an error."""
    if not refs.where(F.length("oid") != id_hex).limit(1).isEmpty():
        raise ValueError("a ref's id has another hash's length")
    head = head_ref(refs).first()
    rows = ([(head["oid"], "HEAD")] if head else []) + [(r["oid"], r["name"]) for r in refs.where("name != 'HEAD'").orderBy("name").toLocalIterator()]
    rows = rows or [("0" * id_hex, "capabilities^{}")]
    lines = [packet(f"{oid} {name}" + (f"\0{capabilities}" if k == 0 else "") + "\n") for k, (oid, name) in enumerate(rows)]
    return packet(f"# service=git-{service}-pack\n") + FLUSH + b"".join(lines) + FLUSH


@dataclass
class FetchRequest:
    want: list[str]
    have: list[str]
    capabilities: list[str]
    done: bool


def parse_fetch(data: bytes) -> FetchRequest:
    want, have, caps, done = [], [], [], False
    for p in read_packets(data)[0]:
        words = (p or b"").decode().split()
        if words[:1] == ["want"] and len(words) > 1:
            want.append(words[1])
            caps += words[2:]
        elif words[:1] == ["have"] and len(words) > 1:
            have.append(words[1])
        elif words[:1] == ["done"]:
            done = True
    return FetchRequest(want, have, caps, done)


def fetch(spark: SparkSession, request: FetchRequest, commits: DataFrame, commit_parents: DataFrame, tree_items: DataFrame) -> tuple[DataFrame, list[str]]:
    """((oid, kind) to send, common ids): the full closure, or what the client lacks where it has a commit of ours."""
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "node string")
    want = ids(request.want)
    if request.have:
        common = [r["node"] for r in ids(request.have).join(commits, F.col("node") == commits.oid, "left_semi").collect()]
        if common:
            return incremental_set(want, ids(common), commits, commit_parents, tree_items), sorted(common)
    return full_set(want, commits, commit_parents, tree_items), []


def parse_commands(lines: DataFrame, line: str = "line") -> DataFrame:
    """old_oid, new_oid, ref_name, ref_type, command of ref update lines."""
    text = F.regexp_replace(F.split_part(F.col(line), F.lit("\0"), F.lit(1)), r"\s+$", "")
    part = lambda k: F.split_part(text, F.lit(" "), F.lit(k))
    rows = lines.select(part(1).alias("old_oid"), part(2).alias("new_oid"), part(3).alias("ref_name"))
    return rows.withColumn("ref_type", ref_kind(F.col("ref_name"))).withColumn("command", ref_command_kind(F.col("old_oid"), F.col("new_oid")))


def apply_commands(refs: DataFrame, commands: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs afterwards, commands with status and error): each command is judged on its own.

    A new id must be an object; the old id must be the ref's; the last of several commands
    on a ref fails with the others unless it is alone.
    """
    now = refs.select(F.col("name").alias("ref_name"), F.col("oid").alias("now"))
    known = objects.select(F.col("oid").alias("new_oid"), F.lit(True).alias("known")).distinct()
    many = commands.groupBy("ref_name").agg(F.count(F.lit(1)).alias("times"))
    judged = commands.join(now, "ref_name", "left").join(known, "new_oid", "left").join(many, "ref_name")
    stale = F.when(F.col("command") == "create", F.col("now").isNotNull()).otherwise(~F.col("now").eqNullSafe(F.col("old_oid")))
    error = F.when(F.col("times") > 1, "several commands").when(stale, "stale old id").when((F.col("command") != "delete") & F.col("known").isNull(), "unknown object")
    judged = judged.withColumn("error", error).withColumn("status", F.when(error.isNull(), "success").otherwise("failed"))
    done = judged.where("status = 'success'")
    kept = refs.join(done.select(F.col("ref_name").alias("name")), "name", "left_anti").select("name", "oid")
    after = kept.unionByName(done.where("command != 'delete'").select(F.col("ref_name").alias("name"), F.col("new_oid").alias("oid")))
    return after, judged.select("old_oid", "new_oid", "ref_name", "ref_type", "command", "status", "error")


def report(judged: DataFrame, unpack: str = "ok") -> bytes:
    """The report of a push: unpack, then a line a command."""
    lines = [packet(f"unpack {unpack}\n")]
    lines += [packet(f"ok {r['ref_name']}\n" if r["status"] == "success" else f"ng {r['ref_name']} {r['error']}\n") for r in judged.orderBy("ref_name").toLocalIterator()]
    return b"".join(lines) + FLUSH


@dataclass
class Push:
    """What a push leaves: objects that are new, refs afterwards, its commands with status, and the report to send."""

    new: DataFrame
    refs: DataFrame
    judged: DataFrame
    report: bytes


REQUEST = "path string, line string, error string"


def parse_requests(requests: DataFrame, hash_kind: str = "sha1") -> DataFrame:
    """Pushes (path, content) taken apart in tasks: rows with a command line, an entry of the pack, or the error of a damaged one."""
    from ..sources import formats
    from ..sources.readers import ENTRIES, ENTRY_ARROW, pack_batches

    head = [pa.field(n, pa.string()) for n in ("path", "line", "error")]
    schema = pa.schema([*head, *ENTRY_ARROW])

    def texts(path, lines, errors):
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(lines, pa.string()), pa.array(errors, pa.string()), *(pa.nulls(n, f.type) for f in ENTRY_ARROW)], schema=schema)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packets, at = read_packets(data)
                lines = [p.decode("utf-8", "replace") for p in packets[: packets.index(None) if None in packets else len(packets)]]
                yield texts(path, lines, [None] * len(lines))
                try:
                    for e in pack_batches(path, data[at:], hash_kind) if at < len(data) else ():
                        none = pa.nulls(len(e), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(e), pa.string()), none, none, *e.columns], schema=schema)
                except formats.CodecError as e:
                    yield texts(path, [None], [str(e)])

    return requests.select("path", "content").mapInArrow(run, f"{REQUEST}, {ENTRIES}")


def receive(spark: SparkSession, request: bytes, refs: DataFrame, objects: DataFrame, hash_kind: str = "sha1") -> Push:
    """Take a push: update commands up to a flush, then a pack, whose deltas may build on ``objects`` (oid, obj_type, data)."""
    rows = parse_requests(spark.createDataFrame([("push", bytearray(request))], "path string, content binary"), hash_kind)
    return take(rows, refs, objects, hash_kind)


def take(rows: DataFrame, refs: DataFrame, objects: DataFrame, hash_kind: str = "sha1") -> Push:
    """Take a push that ``parse_requests`` took apart.

    A pack that is damaged, or has a delta without a base, fails all commands and adds
    nothing. Only the damage and the report reach the driver.
    """
    from ..operators.chains import rebuild
    from ..sources.readers import ENTRY_ARROW
    from ..storage import written

    rows = written(rows, "request")
    commands = written(parse_commands(rows.where("line IS NOT NULL")), "commands")
    damage = rows.where("error IS NOT NULL").select("error").first()
    problem = damage["error"] if damage else "ok"
    entries = rows.where("offset IS NOT NULL").select(*ENTRY_ARROW.names)
    if damage:
        entries = entries.limit(0)
    wanted = entries.where("base_oid IS NOT NULL").select(F.col("base_oid").alias("oid")).distinct()
    known = objects.join(wanted, "oid", "left_semi").select("oid", "obj_type", "data")
    made = written(rebuild(entries, hash_kind, known).where("pack_id IS NOT NULL"), "made")
    if problem == "ok" and made.count() < entries.count():
        problem = "a delta's base is missing"
    new = made.dropDuplicates(["oid"]).join(objects.select("oid"), "oid", "left_anti")
    if problem != "ok":
        new = new.limit(0)
    after, judged = apply_commands(refs, commands, objects.select("oid").unionByName(new.select("oid")))
    if problem != "ok":
        after, judged = refs, judged.withColumn("status", F.lit("failed")).withColumn("error", F.lit("unpack failed"))
    new, after, judged = written(new, "new"), written(after, "refs"), written(judged, "judged")
    return Push(new, after, judged, report(judged, problem))
