"""Named queries over packs, indexes, loose objects, commit graphs and transfers made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import identity, labels, text
from ..operators import aggregates, chains, events, graph, parse, snapshots, windows
from ..sources import formats, readers, writers
from ..storage import fresh_path
from . import transfer
from .queries import OID, document_blobs, table

DISTINCT = f"SELECT DISTINCT {OID} AS oid, strlen(text)::BIGINT AS size FROM documents"
OID256 = "sha256('blob ' || strlen(text)::VARCHAR || chr(0) || text)"


def _packed(spark, sf_dir, **options) -> str:
    """The folder of packs of all document texts, each text in one of them."""
    blobs, folder = document_blobs(spark, sf_dir), fresh_path(spark, "packs")
    if options.get("hash_kind") == "sha256":
        blobs = blobs.withColumn("oid", identity.object_id("blob", "data", "sha256"))
    writers.write_packs(blobs, folder, **options)
    return folder


# packs, indexes, loose objects and staging files


@query("pack_index", DISTINCT.replace("SELECT DISTINCT", "SELECT DISTINCT true AS same_id, true AS same_crc,"))
def pack_index(spark, sf_dir):
    """The indexes of written packs against the packs: ids and checksums of the objects at their offsets."""
    folder = _packed(spark, sf_dir)
    index = readers.read_pack_indexes(spark, folder).select("pack_id", F.col("offset").alias("pack_offset"), F.col("oid").alias("listed"), F.col("crc32").alias("listed_crc"))
    both = chains.load(spark, folder).join(index, ["pack_id", "pack_offset"], "full_outer")
    return both.select("oid", "size", F.col("oid").eqNullSafe(F.col("listed")).alias("same_id"), F.col("crc32").eqNullSafe(F.col("listed_crc")).alias("same_crc"))


@query("pack_sha256", f"SELECT DISTINCT {OID256} AS oid, strlen(text)::BIGINT AS size FROM documents")
def pack_sha256(spark, sf_dir):
    """Packs with SHA-256 ids and dictionary deltas, and their indexes."""
    folder = _packed(spark, sf_dir, hash_kind="sha256", dictionary=True)
    objects = chains.load(spark, folder, "sha256")
    return objects.join(readers.read_pack_indexes(spark, folder, "sha256").select("oid"), "oid").select("oid", "size")


@query("pack_ref_deltas", DISTINCT)
def pack_ref_deltas(spark, sf_dir):
    """Packs whose deltas name their bases by id, rebuilt by joins."""
    return chains.rebuild(readers.read_packs(spark, _packed(spark, sf_dir, by_id=True))).select("oid", "size")


@query("pack_ranges", DISTINCT)
def pack_ranges(spark, sf_dir):
    """A pack a task by the data source, read again in ranges by the indexes, and rebuilt."""
    readers.register(spark)
    folder = fresh_path(spark, "packs").removeprefix("file:")
    objects = aggregates.distinct_objects(document_blobs(spark, sf_dir).select("oid", "obj_type", "data"))
    objects.write.format("packfile").mode("append").save(folder)
    return chains.rebuild(spark.read.format("packfile").option("splitBytes", str(1 << 20)).load(folder)).select("oid", "size")


@query("pack_scan", "SELECT 0::BIGINT AS commits, 0::BIGINT AS trees, count(DISTINCT text) AS blobs, 0::BIGINT AS tags, 0::BIGINT AS deltas, count(DISTINCT text) AS total FROM documents")
def pack_scan(spark, sf_dir):
    """Statistics of packs of whole objects, scanned without keeping payloads."""
    return aggregates.pack_stats(readers.read_packs(spark, _packed(spark, sf_dir, window=0), payload=False))


@query("pack_check", "SELECT count(DISTINCT text) AS object_count, true AS sound FROM documents")
def pack_check(spark, sf_dir):
    """Objects of all packs by their headers, and whether each pack is whole."""
    checked = readers.check_packs(spark, _packed(spark, sf_dir))
    sound = F.col("error").isNull() & F.coalesce(F.col("trailer") == F.col("computed"), F.lit(False))
    return checked.agg(F.coalesce(F.sum("object_count"), F.lit(0).cast("long")).alias("object_count"), F.coalesce(F.bool_and(sound), F.lit(True)).alias("sound"))


@query("pack_users", "SELECT true AS all_known, count(DISTINCT text) AS objects FROM documents")
def pack_users(spark, sf_dir):
    """Users of the bases of delta packs, by their headers: each base is an entry of the same pack."""
    entries = readers.read_packs(spark, _packed(spark, sf_dir), payload=False)
    users = aggregates.dependency_counts(entries, "base_offset", "pack_id")
    lost = users.join(entries.select("pack_id", F.col("offset").alias("base_offset")), ["pack_id", "base_offset"], "left_anti")
    return entries.agg(F.count(F.lit(1)).alias("objects")).join(lost.agg((F.count(F.lit(1)) == 0).alias("all_known")))


@query("loose_objects", f"SELECT DISTINCT {OID} AS oid, 'blob' AS obj_type, strlen(text)::BIGINT AS size FROM documents")
def loose_objects(spark, sf_dir):
    """Texts written as loose objects and read again."""
    folder = fresh_path(spark, "loose").removeprefix("file:")
    writers.write_loose(aggregates.distinct_objects(document_blobs(spark, sf_dir)), folder)
    return readers.read_loose(spark, folder).select("oid", "obj_type", "size")


@query("stored_by_type", "SELECT obj_type, count(*) AS n, sum(size)::BIGINT AS size FROM (SELECT 'blob' AS obj_type, strlen(text) AS size FROM documents UNION ALL SELECT 'tag', strlen(html) FROM pages) GROUP BY 1")
def stored_by_type(spark, sf_dir):
    """Objects of two types in the typed store."""
    path = fresh_path(spark, "store")
    pages = table(spark, sf_dir, "pages").select(F.col("html").cast("binary").alias("data"), F.lit("tag").alias("obj_type"))
    writers.store_objects(document_blobs(spark, sf_dir).select("data", "obj_type").unionByName(pages), path)
    stored = spark.read.schema("data binary, obj_type string").parquet(path)
    return stored.groupBy("obj_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).cast("long").alias("size"))


def _stage(spark, sf_dir):
    d = document_blobs(spark, sf_dir)
    k = F.col("doc_id")
    return d.select(F.col("file_path").alias("name"), "oid", F.pmod(k, F.lit(4)).cast("int").alias("stage"), F.when(k % 5 == 0, 0o100755).otherwise(0o100644).cast("int").alias("mode"), F.octet_length("data").cast("long").alias("size"), (1_700_000_000 + k).alias("mtime_s"), (k * 7 % 1_000_000_000).alias("mtime_ns"), (k % 3 == 0).alias("assume_valid"))


STAGE = f"SELECT doc_id, 'docs/' || source || '/' || doc_id || '.txt' AS name, {OID} AS oid, (doc_id % 4)::INTEGER AS stage, CASE WHEN doc_id % 5 = 0 THEN 33261 ELSE 33188 END AS mode, strlen(text)::BIGINT AS size, 1700000000 + doc_id AS mtime_s, doc_id * 7 % 1000000000 AS mtime_ns, doc_id % 3 = 0 AS assume_valid FROM documents"


@query("stage_index", f"SELECT * EXCLUDE (doc_id) FROM ({STAGE})")
def stage_index(spark, sf_dir):
    """Texts as entries of a staging index file, read again."""
    folder = fresh_path(spark, "stage")
    writers.write_stage_index(_stage(spark, sf_dir), f"{folder}/index")
    return readers.read_stage_indexes(spark, folder).select("name", "oid", "stage", "mode", "size", "mtime_s", "mtime_ns", "assume_valid")


@query("stage_states", f"WITH s AS ({STAGE}) SELECT name, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 7 = 1 THEN 'modified' ELSE 'same' END AS state FROM s WHERE stage = 0")
def stage_states(spark, sf_dir):
    """Entries of stage 0 against file stats: some files are gone, some are longer."""
    s = _stage(spark, sf_dir).where("stage = 0")
    k = F.col("mtime_s") - 1_700_000_000
    return snapshots.modified(s, s.where(k % 7 != 0).select("name", (F.col("size") + F.when(k % 7 == 1, 1).otherwise(0)).alias("size"), "mtime_s"))


@query("stage_folders", f"WITH s AS ({STAGE}), d AS (SELECT min(source) AS source FROM documents) SELECT name, starts_with(name, 'docs/' || source || '/') AS removed, stage = 0 AS tracked FROM s, d")
def stage_folders(spark, sf_dir):
    """One folder taken out of the staging table, and which paths are tracked."""
    s = _stage(spark, sf_dir)
    folder = "docs/" + table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    if not snapshots.holds_dir(s, folder):
        raise ValueError("the folder holds nothing")
    left, gone = snapshots.remove_dir(s, folder)
    both = left.select("name").withColumn("removed", F.lit(False)).unionByName(gone.withColumn("removed", F.lit(True)))
    known = snapshots.tracked(s, s.select("name")).select(F.col("name").alias("known"))
    return both.join(known, both.name == known.known, "left").select("name", "removed", F.col("known").isNotNull().alias("tracked"))


NAME_HASH = r"""
    WITH f AS (SELECT doc_id, doc_id % 2 = 0 AS has, 'docs/' || source AS dir, hex(encode(doc_id || '.txt')) AS h, left(hex(encode(text)), 16) AS head, strlen(text) AS n, {oid} AS oid, text FROM documents),
    g AS (SELECT *, list_reduce(list_prepend(0::UBIGINT, [('0x' || substr(h, 2 * i - 1, 2))::UBIGINT FOR i IN range(1, 1 + length(h) // 2)]), lambda a, x: ((a // 4 + x * 16777216) % 4294967296)::UBIGINT)::BIGINT AS name_hash FROM f)"""


@query("pack_order", NAME_HASH.format(oid=OID) + """
    SELECT doc_id, row_number() OVER (ORDER BY has DESC, CASE WHEN has THEN dir ELSE rpad(head, 16, '0') END, CASE WHEN has THEN -name_hash ELSE 0 END, n DESC, oid, doc_id) AS rank FROM g""")
def pack_order(spark, sf_dir):
    """Ranks in pack order: half of the texts have a path, the others don't."""
    d = document_blobs(spark, sf_dir).withColumn("file_path", F.when(F.col("doc_id") % 2 == 0, F.col("file_path")))
    keyed = windows.pack_order(d)
    return windows.ranked(keyed.drop("data"), [c for c in keyed.columns if c.startswith("k")] + ["doc_id"], "rank").select("doc_id", "rank")


# commit graphs: a turn is a commit with a tree of its own, which holds the text and a folder a role


def _id(prefix, *parts):
    return F.sha1(F.concat_ws(":", F.lit(prefix), *[p.cast("string") for p in parts]))


def _commits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    parents = F.when(F.col("turn") > 0, F.array(_id("c", F.col("conv_id"), F.col("turn") - 1))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", "turn", _id("c", F.col("conv_id"), F.col("turn")).alias("oid"), _id("t", F.col("conv_id"), F.col("turn")).alias("tree_oid"), parents.alias("parents"))


def _tree_items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    tree, folder = _id("t", F.col("conv_id"), F.col("turn")), _id("s", F.col("role"))
    item = lambda tree, mode, oid, name: c.select(tree.alias("tree_oid"), F.lit(mode).alias("mode"), oid.alias("oid"), F.lit(name).alias("name"))
    rows = item(tree, "100644", F.sha1("text"), "text").unionByName(item(tree, "40000", folder, "role")).unionByName(item(tree, "120000", _id("l", F.col("turn")), "link")).unionByName(item(tree, "160000", _id("m", F.col("turn")), "module"))
    rows = rows.unionByName(item(folder, "100755", _id("r", F.col("role")), "run"))
    return rows.withColumn("kind", labels.mode_kind(F.col("mode"))).distinct()


GRAPH = """
    WITH w AS (SELECT *, sha1('c:' || conv_id || ':' || turn) AS c, sha1('t:' || conv_id || ':' || turn) AS t, sha1('s:' || role) AS s, sha1('r:' || role) AS r, sha1(text) AS b FROM conversations),
    o AS (SELECT conv_id, turn, c AS oid, 'commit' AS kind FROM w UNION ALL SELECT conv_id, turn, t, 'tree' FROM w UNION ALL SELECT conv_id, turn, s, 'tree' FROM w UNION ALL SELECT conv_id, turn, b, 'blob' FROM w UNION ALL SELECT conv_id, turn, r, 'blob' FROM w)"""


def _heads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"))
    return c.select("conv_id", _id("c", F.col("conv_id"), F.col("t")).alias("node"))


@query("full_objects", GRAPH + " SELECT DISTINCT oid, kind FROM o WHERE conv_id % 2 = 0")
def full_objects(spark, sf_dir):
    """All that the heads of every second conversation need."""
    commits = _commits(spark, sf_dir)
    want = _heads(spark, sf_dir).where("conv_id % 2 = 0").select("node")
    return graph.full_set(want, commits, parse.commit_parents(commits), _tree_items(spark, sf_dir))


@query("incremental_objects", GRAPH + " SELECT DISTINCT oid, kind FROM o WHERE (oid, kind) NOT IN (SELECT (oid, kind) FROM o WHERE turn = 0 AND conv_id % 2 = 0)")
def incremental_objects(spark, sf_dir):
    """What all heads need beyond the first turns of every second conversation; an unknown id is left out."""
    commits = _commits(spark, sf_dir)
    have = commits.where("turn = 0 AND conv_id % 2 = 0").select(F.col("oid").alias("node")).unionByName(spark.range(1).select(F.lit("unknown").alias("node")))
    return graph.incremental_set(_heads(spark, sf_dir).select("node"), have, commits, parse.commit_parents(commits), _tree_items(spark, sf_dir))


@query("fetch_objects", GRAPH + " SELECT DISTINCT oid, kind FROM o WHERE (oid, kind) NOT IN (SELECT (oid, kind) FROM o WHERE turn = 0)")
def fetch_objects(spark, sf_dir):
    """A fetch request in packets, with every head wanted and every first commit held, answered."""
    commits = _commits(spark, sf_dir)
    want, have = (sorted(r[0] for r in x.collect()) for x in (_heads(spark, sf_dir).select("node"), commits.where("turn = 0").select("oid")))
    lines = [f"want {x}" + (" side-band-64k ofs-delta" if k == 0 else "") for k, x in enumerate(want)]
    request = b"".join(map(transfer.packet, lines)) + transfer.FLUSH + b"".join(transfer.packet(f"have {x}") for x in have) + transfer.packet("done")
    parsed = transfer.parse_fetch(request)
    sent, common = transfer.fetch(spark, parsed, commits, parse.commit_parents(commits), _tree_items(spark, sf_dir))
    if common != have or not parsed.done or parsed.capabilities != ["side-band-64k", "ofs-delta"]:
        raise ValueError("the request was misread")
    return sent


@query("tree_objects", """
    WITH w AS (SELECT *, sha1('t:' || conv_id || ':' || turn) AS t FROM conversations WHERE turn = 0)
    SELECT t AS oid, 'tree' AS kind FROM w UNION SELECT sha1('s:' || role), 'tree' FROM w UNION SELECT sha1(text), 'blob' FROM w UNION SELECT sha1('r:' || role), 'blob' FROM w UNION SELECT sha1('l:' || turn), 'blob' FROM w UNION SELECT sha1('m:' || turn), 'commit' FROM w""")
def tree_objects(spark, sf_dir):
    """Below the trees of all first turns, links and submodules included."""
    roots = _commits(spark, sf_dir).where("turn = 0").select(F.col("tree_oid").alias("node"))
    return graph.tree_objects(roots, _tree_items(spark, sf_dir), include_links=True)


# transfers


@query("ref_advertisement", """
    WITH r AS (SELECT 'refs/heads/' || lower(replace(n_name, ' ', '-')) AS name, sha1(n_name) AS oid FROM nation UNION ALL SELECT 'refs/heads/main', sha1(r_name) FROM region WHERE r_regionkey = 0),
    a AS (SELECT oid, 'HEAD' AS name, '' AS k FROM r WHERE name = 'refs/heads/main' UNION ALL SELECT oid, name, name FROM r)
    SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS pos, oid, name FROM a""")
def ref_advertisement(spark, sf_dir):
    """The advertisement's packets, read again."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    refs = n.select(F.concat(F.lit("refs/heads/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))).alias("name"), F.sha1("n_name").alias("oid"))
    refs = refs.unionByName(r.where("r_regionkey = 0").select(F.lit("refs/heads/main").alias("name"), F.sha1("r_name").alias("oid")))
    packets, _ = transfer.read_packets(transfer.advertise(refs, "upload"))
    lines = [p.decode().rstrip("\n") for p in packets[2:-1]]
    if packets[0] != b"# service=git-upload-pack\n" or packets[1] is not None or packets[-1] is not None or not lines[0].endswith("\0" + transfer.CAPABILITIES):
        raise ValueError("the advertisement is malformed")
    rows = [(k, *line.split("\0")[0].split(" ", 1)) for k, line in enumerate(lines)]
    return spark.createDataFrame(rows, "pos int, oid string, name string")


def _push(spark, sf_dir):
    """A push that creates, updates, deletes and mistakes a branch a nation; its pack has an object for each."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    zero, oid = "0" * 40, lambda t: formats.oid_of("blob", t.encode())
    refs = spark.createDataFrame([(f"refs/heads/{r[0]}", oid(f"old {r[1]}")) for r in rows if r[0] % 4], "name string, oid string")
    lines, pack = [], []
    for k, name in rows:
        old = zero if k % 4 == 0 else oid(f"other {name}") if k % 4 == 3 else oid(f"old {name}")
        lines.append(f"{old} {zero if k % 4 == 2 else oid(name)} refs/heads/{k}\n")
        pack.append(formats.encode_entry(formats.BLOB, name.encode()))
    request = b"".join(map(transfer.packet, lines)) + transfer.FLUSH + formats.pack_bytes(pack)
    known = spark.createDataFrame([], "oid string, obj_type string, data binary")
    return transfer.receive(spark, request, refs, known)


@query("push_status", """
    SELECT 'refs/heads/' || n_nationkey AS ref_name, CASE n_nationkey % 4 WHEN 0 THEN 'create' WHEN 2 THEN 'delete' ELSE 'update' END AS command,
    CASE WHEN n_nationkey % 4 = 3 THEN 'failed' ELSE 'success' END AS status, CASE WHEN n_nationkey % 4 = 3 THEN 'stale old id' END AS error FROM nation""")
def push_status(spark, sf_dir):
    return _push(spark, sf_dir).judged.select("ref_name", "command", "status", "error")


@query("push_refs", """
    SELECT 'refs/heads/' || n_nationkey AS name, sha1('blob ' || strlen(t)::VARCHAR || chr(0) || t) AS oid
    FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN 'old ' ELSE '' END || n_name AS t FROM nation WHERE n_nationkey % 4 <> 2)""")
def push_refs(spark, sf_dir):
    return _push(spark, sf_dir).refs


@query("push_objects", "SELECT sha1('blob ' || strlen(n_name)::VARCHAR || chr(0) || n_name) AS oid, strlen(n_name)::BIGINT AS size FROM nation")
def push_objects(spark, sf_dir):
    return _push(spark, sf_dir).new.select("oid", "size")


@query("stream_packs", DISTINCT)
def stream_packs(spark, sf_dir):
    """Packs taken by a stream in two batches: those with deltas, then those with ids for bases."""
    from ..streaming.ingest import ingest

    source, store = fresh_path(spark, "source"), fresh_path(spark, "ingested")
    blobs = document_blobs(spark, sf_dir)
    first = writers.write_packs(blobs, source)
    writers.write_packs(blobs, source, by_id=True)
    running, target = ingest(spark, source, store, files_per_trigger=max(1, len(first)))
    running.awaitTermination()
    return target.objects().select("oid", "size")


# labels, capabilities and other column functions


@query("capability_rows", """
    WITH c AS (SELECT o_orderkey, ['multi_ack', 'ofs-delta', 'agent=x/' || o_orderkey, 'symref=HEAD:refs/heads/main', 'symref=a:b', 'odd-' || o_orderkey, 'thin-pack=1'][1 + o_orderkey % 3:4 + o_orderkey % 4] AS caps FROM orders),
    u AS (SELECT o_orderkey, unnest(caps) AS cap, generate_subscripts(caps, 1) - 1 AS pos FROM c)
    SELECT o_orderkey, pos::INTEGER AS pos, split_part(cap, '=', 1) AS name, CASE WHEN contains(cap, '=') THEN substr(cap, strpos(cap, '=') + 1) ELSE '' END AS value, NOT starts_with(cap, 'odd') AND cap <> 'thin-pack=1' AS known FROM u""")
def capability_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    caps = F.array(F.lit("multi_ack"), F.lit("ofs-delta"), F.concat(F.lit("agent=x/"), k.cast("string")), F.lit("symref=HEAD:refs/heads/main"), F.lit("symref=a:b"), F.concat(F.lit("odd-"), k.cast("string")), F.lit("thin-pack=1"))
    some = F.slice(caps, (1 + k % 3).cast("int"), (4 + k % 4 - k % 3).cast("int"))
    parsed = labels.capabilities(labels.capability_text(labels.capabilities(F.array_join(some, " "))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(parsed).alias("pos", "c")).select("o_orderkey", "pos", "c.name", "c.value", "c.known")


@query("object_labels", """
    WITH t AS (SELECT o_orderkey, ['blob', 'commit', 'offset_delta', 'run_event', 'snapshot', 'zz'][1 + o_orderkey % 6] AS kind, ['100644', '100755', '40000', '040000', '120000', '160000', '100664', '1'][1 + o_orderkey % 8] AS mode FROM orders)
    SELECT o_orderkey, kind IN ('blob', 'commit') AS is_base, kind IN ('run_event', 'snapshot') AS is_workflow, CASE mode WHEN '100755' THEN 'executable' WHEN '40000' THEN 'tree' WHEN '040000' THEN 'tree' WHEN '120000' THEN 'link' WHEN '160000' THEN 'commit' WHEN '1' THEN NULL ELSE 'blob' END AS kind,
    CASE mode WHEN '040000' THEN '40000' WHEN '100664' THEN '100644' WHEN '1' THEN NULL ELSE mode END AS mode FROM t""")
def object_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + k % len(values)).cast("int"))
    kind, mode = pick(["blob", "commit", "offset_delta", "run_event", "snapshot", "zz"]), pick(["100644", "100755", "40000", "040000", "120000", "160000", "100664", "1"])
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.is_base(kind).alias("is_base"), labels.is_workflow(kind).alias("is_workflow"), labels.mode_kind(mode).alias("kind"), labels.kind_mode(labels.mode_kind(mode)).alias("mode"))


@query("index_flag_bits", "SELECT l_orderkey, l_linenumber, ((CASE WHEN l_linenumber % 2 = 1 THEN 32768 ELSE 0 END) + (l_orderkey % 4) * 4096 + least(l_partkey, 4095))::INTEGER AS flags FROM lineitem")
def index_flag_bits(spark, sf_dir):
    bits = labels.index_flag_bits(F.col("l_linenumber") % 2 == 1, F.lit(False), (F.col("l_orderkey") % 4).cast("int"), F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.alias("flags"))


@query("id_forms", f"WITH o AS (SELECT doc_id, {OID} AS a, {OID256} AS b FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sha1' WHEN doc_id % 3 = 1 THEN 'sha256' END AS kind, hex(unhex(a)) AS bytes, CASE WHEN doc_id % 5 = 0 THEN '0000000' ELSE left(a, 7) END AS short, repeat('0', 40) AS zero FROM o")
def id_forms(spark, sf_dir):
    """Ids as bytes and back, their kinds, short forms and the zero id."""
    k, data = F.col("doc_id"), F.col("text").cast("binary")
    one, two = identity.object_id("blob", data), identity.object_id("blob", data, "sha256")
    given = F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise(F.lit("short"))
    return table(spark, sf_dir, "documents").select("doc_id", identity.id_kind(given).alias("kind"), F.upper(identity.id_from_bytes(identity.id_to_bytes(one))).alias("bytes"), identity.short_id(F.when(k % 5 != 0, one)).alias("short"), identity.zero_id().alias("zero"))


@query("tag_parse", "SELECT sha1(o_orderkey::VARCHAR) AS target_oid, 'commit' AS target_type, 'v' || o_orderkey AS tag_name, 'Clerk ' || o_custkey AS tagger, 1700000000 + o_orderkey AS epoch, o_orderpriority AS message FROM orders")
def tag_parse(spark, sf_dir):
    """Tags written and parsed."""
    o = table(spark, sf_dir, "orders")
    who = F.struct(F.lit("tagger").alias("role"), F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")).alias("name"), F.lit("clerk@example.org").alias("email"), (1_700_000_000 + F.col("o_orderkey")).alias("epoch"), F.lit("-0230").alias("tz"))
    tags = o.select(F.sha1(F.col("o_orderkey").cast("string")).alias("target_oid"), F.lit("commit").alias("target_type"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("tag_name"), who.alias("tagger"), F.col("o_orderpriority").alias("message"))
    return parse.parse_tags(parse.tag_data(tags)).select("target_oid", "target_type", "tag_name", F.col("tagger.name").alias("tagger"), F.col("tagger.epoch").alias("epoch"), "message")


@query("note_rows", "SELECT sha1('blob ' || strlen(o_orderpriority)::VARCHAR || chr(0) || o_orderpriority) AS oid, sha1(o_orderkey::VARCHAR) AS target_oid, o_orderpriority AS content, strlen(o_orderpriority)::INTEGER AS size FROM orders")
def note_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return parse.notes(o.select(F.sha1(F.col("o_orderkey").cast("string")).alias("target_oid"), F.col("o_orderpriority").alias("content")))


@query("touched_totals", "SELECT l_orderkey AS run, count(DISTINCT l_partkey) AS files, sum(l_linenumber)::BIGINT AS added, sum(l_suppkey)::BIGINT AS deleted FROM lineitem GROUP BY 1")
def touched_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    touched = F.array(F.struct(F.col("l_partkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("lines_added"), F.col("l_suppkey").cast("long").alias("lines_deleted")))
    return aggregates.touched_totals(li.select(F.col("l_orderkey").alias("run"), touched.alias("touched")))


@query("reverse_pairs", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
def reverse_pairs(spark, sf_dir):
    return events.reverse_pairs(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("request_urls", """
    WITH u AS (SELECT n_nationkey, lower(replace(n_name, ' ', '-')) || '/repo' AS repo, ['/info/refs?service=git-upload-pack', '/git-receive-pack', '/git-upload-pack'][1 + n_nationkey % 3] AS tail FROM nation)
    SELECT n_nationkey, repo AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'upload' ELSE '' END AS service, CASE WHEN n_nationkey % 2 = 0 THEN 'upload' ELSE 'receive' END AS ssh_service, repo AS ssh_path FROM u""")
def request_urls(spark, sf_dir):
    """Repository and service of request URLs and remote commands."""
    k = F.col("n_nationkey")
    repo = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit("/repo"))
    tail = F.element_at(F.array(*[F.lit(x) for x in ("/info/refs?service=git-upload-pack", "/git-receive-pack", "/git-upload-pack")]), (1 + k % 3).cast("int"))
    url = F.concat(F.lit("https://example.org/"), repo, tail)
    ssh = text.ssh_command(F.concat(F.lit("git-"), F.when(k % 2 == 0, "upload").otherwise("receive"), F.lit("-pack '"), repo, F.lit("'")))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.repo_path(url).alias("path"), text.service_of_query(url).alias("service"), ssh["service"].alias("ssh_service"), ssh["path"].alias("ssh_path"))


STEPPED = """
    WITH r AS (SELECT doc_id, lang, hex(encode(text)) AS x, row_number() OVER (PARTITION BY lang ORDER BY strlen(text) DESC, doc_id) AS rn FROM documents),
    p AS (SELECT a.doc_id AS target, b.doc_id AS base, a.x AS ax, b.x AS bx, least(length(a.x), length(b.x)) // 2 AS low, greatest(length(a.x), length(b.x)) // 2 AS high FROM r a JOIN r b ON a.lang = b.lang AND b.rn = a.rn - 1),
    q AS (SELECT *, CASE WHEN high < 4096 THEN 16 WHEN high < 65536 THEN 128 WHEN high < 1048576 THEN 512 ELSE 1024 END AS step FROM p),
    s AS (SELECT target, base, low, high, list_sum([CASE WHEN substr(ax, 2 * step * i + 1, 2 * least(16, low - step * i)) = substr(bx, 2 * step * i + 1, 2 * least(16, low - step * i)) THEN least(16, low - step * i) ELSE 0 END FOR i IN range((low + step - 1) // step)]) AS hit, list_sum([least(16, low - step * i) FOR i IN range((low + step - 1) // step)]) AS seen FROM q)
    SELECT target, base, floor(10000 * CASE WHEN high = 0 THEN 1.0 WHEN low = 0 THEN 0.0 WHEN hit / (seen + high - low) < 0.5 THEN 0.0 ELSE hit / (seen + high - low) END)::BIGINT AS rate FROM s"""


@query("stepped_rate", STEPPED)
def stepped_rate(spark, sf_dir):
    """Sampled rates whose step grows with the length, of each text and its nearest candidate."""
    from .queries import _candidates, _with_texts

    near = _with_texts(_candidates(spark, sf_dir).where("distance = 1").select("target", "base"), spark, sf_dir)
    return near.select("target", "base", F.floor(text.stepped_rate("b", "t") * 10000).alias("rate"))


# workflow records


def _workflow(spark, sf_dir):
    """Workflow tables of customers (intents), suppliers (plans), orders (tasks) and items (runs and what they left)."""
    c, s, o, li = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    li = li.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(k).alias(k) for k in ("l_suppkey", "l_quantity", "l_returnflag")])
    run = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object_id")
    tables = {
        "intent": c.select(F.col("c_custkey").alias("object_id")),
        "plan": s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("object_id"), F.col("s_nationkey").alias("intent")),
        "task": o.select(F.col("o_orderkey").alias("object_id"), F.col("o_custkey").alias("intent"), F.array(F.col("o_orderkey") + 1, F.col("o_orderkey")).alias("dependencies")),
        "run": li.select(run, F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("plan")),
        "patch_set": li.where("l_linenumber = 1").select((run * 10).alias("object_id"), run.alias("run")),
    }
    evidence = li.where("l_quantity > 25").select(run.alias("run_id"))
    decisions = li.where("l_returnflag = 'R'").select(run.alias("run_id"), F.lit("commit").alias("decision_type"), (run * 10).alias("chosen_patchset_id"))
    return tables, evidence, decisions


ITEMS = "WITH li AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)"


@query("audit_chain", ITEMS + """
    SELECT c_custkey AS intent_id, o_orderkey AS task_id, id AS run_id, l_suppkey AS run_plan_id, CASE WHEN l_linenumber = 1 THEN id * 10 END AS patchset_id, CASE WHEN l_quantity > 25 THEN 1 END::BIGINT AS evidence,
    CASE WHEN l_returnflag = 'R' THEN 'commit' END AS decision_type, CASE WHEN l_returnflag = 'R' THEN id * 10 END AS chosen, coalesce(l_suppkey % 2 = 0, false) AS plan_known
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey""")
def audit_chain(spark, sf_dir):
    t, evidence, decisions = _workflow(spark, sf_dir)
    return events.audit_chain(t["intent"], t["plan"], t["task"], t["run"], t["patch_set"], evidence, decisions)


@query("broken_links", ITEMS + """
    SELECT 'task' AS child, 'dependencies' AS "column", (SELECT count(*) FROM orders WHERE o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders)) AS missing
    UNION ALL SELECT 'run', 'plan', (SELECT count(*) FROM li WHERE l_suppkey % 2 = 1) UNION ALL SELECT 'run', 'task', 0 UNION ALL SELECT 'patch_set', 'run', 0 UNION ALL SELECT 'task', 'intent', 0
    UNION ALL SELECT 'plan', 'intent', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey NOT IN (SELECT c_custkey FROM customer))""")
def broken_links(spark, sf_dir):
    t, *_ = _workflow(spark, sf_dir)
    edges = [("task", "dependencies", "task"), ("run", "plan", "plan"), ("run", "task", "task"), ("patch_set", "run", "run"), ("task", "intent", "intent"), ("plan", "intent", "intent")]
    return events.broken_links(t, edges)
