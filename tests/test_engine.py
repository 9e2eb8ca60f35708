"""Readers, writers, rebuilding, graphs, snapshots, transfers and streams on small synthetic stores."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarrybed.functions import codecs, identity, labels
from quarrybed.functions import text as tx
from quarrybed.operators import aggregates, chains, events, graph, parse, snapshots, windows
from quarrybed.plans import transfer
from quarrybed.sources import formats as fm
from quarrybed.sources import readers, writers
from quarrybed.streaming import ingest


def oid(data, kind="blob", h="sha1"):
    return fm.oid_of(kind, data, h)


def mixed_pack(kind="sha1"):
    """All base types, a ref delta before its base, a chain of depth 3 of both kinds, a dictionary delta."""
    base = b"the quick brown fox jumps over the lazy dog\n" * 8
    texts = [base] + [base + b"line %d\n" % k for k in range(1, 5)]
    commit = b"tree " + b"0" * 40 + b"\nauthor A <a@b> 1 +0000\ncommitter A <a@b> 1 +0000\n\nhello\n"
    b = fm.PackBuilder(kind)
    b.add(oid(texts[1], h=kind), fm.encode_entry(fm.REF_DELTA, codecs.encode_rabin(base, texts[1]), base_oid=oid(base, h=kind)))
    at = b.add(oid(base, h=kind), fm.encode_entry(fm.BLOB, base))
    two = b.add(oid(texts[2], h=kind), fm.encode_entry(fm.OFFSET_DELTA, codecs.encode_rabin(base, texts[2]), b.at - at))
    b.add(oid(texts[3], h=kind), fm.encode_entry(fm.REF_DELTA, codecs.encode_lines(texts[1], texts[3]), base_oid=oid(texts[1], h=kind)))
    b.add(oid(texts[4], h=kind), fm.encode_entry(fm.ZSTD_DELTA, codecs.dictionary_delta(texts[2], texts[4]), b.at - two))
    b.add(oid(commit, "commit", kind), fm.encode_entry(fm.COMMIT, commit))
    b.add(oid(b"", "tree", kind), fm.encode_entry(fm.TREE, b""))
    b.add(oid(b"object x\n\n", "tag", kind), fm.encode_entry(fm.TAG, b"object x\n\n"))
    want = {(oid(t, h=kind), "blob", len(t)) for t in texts} | {(oid(commit, "commit", kind), "commit", len(commit)), (oid(b"", "tree", kind), "tree", 0), (oid(b"object x\n\n", "tag", kind), "tag", 10)}
    return b.finish(), want


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.mark.parametrize("kind", ["sha1", "sha256"])
def test_read_and_rebuild(spark, tmp_path, kind):
    (pack, index), want = mixed_pack(kind)
    put(f"{tmp_path}/a.pack", pack)
    put(f"{tmp_path}/a.idx", index)
    entries = readers.read_packs(spark, str(tmp_path), kind)
    made = chains.rebuild(entries, kind)
    rows = made.collect()
    assert {(r["oid"], r["obj_type"], r["size"]) for r in rows} == want and max(r["chain_len"] for r in rows) == 2
    idx = readers.read_pack_indexes(spark, str(tmp_path), kind)
    assert {(r["oid"], r["crc32"], r["offset"]) for r in idx.collect()} == {(r["oid"], r["crc32"], r["pack_offset"]) for r in rows}
    assert chains.orphans(entries, made).count() == 0
    assert aggregates.pack_stats(entries).first().asDict() == {"commits": 1, "trees": 1, "blobs": 1, "tags": 1, "deltas": 4, "total": 8}
    readers.register(spark)
    assert spark.read.format("packfile").option("hashKind", kind).load(str(tmp_path)).count() == 8


def test_missing_base_and_damage(spark, tmp_path):
    lost = fm.pack_bytes([fm.encode_entry(fm.REF_DELTA, b"\1\1\1a", base_oid="ab" * 20), fm.encode_entry(fm.BLOB, b"z")])
    put(f"{tmp_path}/one.pack", lost)
    entries = readers.read_packs(spark, str(tmp_path))
    made = chains.rebuild(entries)
    assert made.count() == 1 and chains.orphans(entries, made).count() == 1
    put(f"{tmp_path}/two.pack", lost[:-1] + b"\0")
    got = {r["pack_id"]: r["error"] for r in readers.check_packs(spark, str(tmp_path)).collect()}
    assert got["one"] is None and "checksum" in got["two"]


@pytest.mark.parametrize("window,dictionary", [(10, False), (0, False), (4, True)])
def test_write_pack_reads_back(spark, tmp_path, window, dictionary):
    base = "some text that is shared by all of them\n" * 10
    objects = spark.createDataFrame([(oid((base + f"tail {k}").encode()), "blob", bytearray((base + f"tail {k}").encode()), f"dir/{k % 3}/f{k}.txt" if k % 2 else None) for k in range(40)], "oid string, obj_type string, data binary, file_path string")
    name = writers.write_pack(objects, str(tmp_path), window, dictionary=dictionary)
    rows = chains.rebuild(readers.read_packs(spark, str(tmp_path))).collect()
    assert {(r["oid"], bytes(r["data"])) for r in rows} == {(r["oid"], bytes(r["data"])) for r in objects.collect()}
    assert any(r["is_delta"] for r in rows) == bool(window)
    columns = ["oid", "obj_type", "size", "data", "chain_len", "pack_id", "pack_offset", "crc32", "is_delta"]
    assert sorted(map(tuple, chains.load(spark, str(tmp_path)).select(*columns).collect())) == sorted(tuple(r[c] for c in columns) for r in rows)
    with open(f"{tmp_path}/{name}.idx", "rb") as f:
        assert {r[0] for r in fm.parse_pack_index(f.read())[0]} == {r["oid"] for r in rows}
    with pytest.raises(ValueError):
        writers.write_pack(objects.withColumn("obj_type", F.lit("task")), str(tmp_path))


def test_deltas_that_name_their_bases_by_id(spark, tmp_path):
    """Rebuilt in the pack's task, and by joins where the base is in another pack or comes later."""
    base = b"some text that is shared by all of them\n" * 10
    texts = [base + b"tail %d" % k for k in range(30)]
    objects = spark.createDataFrame([(oid(t), "blob", bytearray(t)) for t in texts], "oid string, obj_type string, data binary")
    writers.write_pack(objects, f"{tmp_path}/a", by_id=True)
    entries = readers.read_packs(spark, f"{tmp_path}/a")
    assert entries.where("base_oid IS NOT NULL").count() > 20 and entries.where("base_offset IS NOT NULL").count() == 0
    assert {bytes(r["data"]) for r in chains.load(spark, f"{tmp_path}/a").collect()} == set(texts)
    b = fm.PackBuilder()
    late, more, far = base + b"late", base + b"more", base + b"far"
    first = b.add(oid(more), fm.encode_entry(fm.REF_DELTA, codecs.encode_rabin(late, more), base_oid=oid(late)))  # its base follows
    second = b.at
    b.add(oid(far), fm.encode_entry(fm.OFFSET_DELTA, codecs.encode_rabin(more, far), second - first))
    b.add(oid(late), fm.encode_entry(fm.REF_DELTA, codecs.encode_rabin(texts[3], late), base_oid=oid(texts[3])))  # its base is in the other pack
    (tmp_path / "b.pack").write_bytes(b.finish()[0])
    got = chains.load(spark, str(tmp_path)).collect()
    assert {bytes(r["data"]) for r in got} == {*texts, late, more, far} and all(r["oid"] == oid(bytes(r["data"])) for r in got)
    alone = chains.load(spark, f"{tmp_path}/b.pack", known=objects).collect()
    assert {bytes(r["data"]): r["chain_len"] for r in alone} == {late: 1, more: 2, far: 3}
    with pytest.raises(RuntimeError):
        chains.rebuild(entries, max_depth=1)


def test_loose_and_stage(spark, tmp_path):
    objects = spark.createDataFrame([(oid(b"a"), "blob", bytearray(b"a")), (oid(b"", "tree"), "tree", bytearray(b""))], "oid string, obj_type string, data binary")
    assert writers.write_loose(objects, f"{tmp_path}/objects") == 2
    assert {(r["oid"], r["obj_type"]) for r in readers.read_loose(spark, f"{tmp_path}/objects").collect()} == {(oid(b"a"), "blob"), (oid(b"", "tree"), "tree")}
    stage = spark.createDataFrame([("b/x", "ab" * 20, 0, 5), ("a", "cd" * 20, 1, 6)], "name string, oid string, stage int, size long")
    writers.write_stage_index(stage, f"{tmp_path}/stage/index")
    table = readers.read_stage_indexes(spark, f"{tmp_path}/stage")
    assert [(r["name"], r["stage"], r["size"]) for r in table.orderBy("name").collect()] == [("a", 1, 6), ("b/x", 0, 5)]
    assert snapshots.holds_dir(table, "b") and not snapshots.holds_dir(table, "a")
    left, gone = snapshots.remove_dir(table, "b")
    assert (left.count(), gone.first()["name"]) == (1, "b/x")
    stats = spark.createDataFrame([("a", 7), ("zz", 1)], "name string, size long")
    assert {tuple(r) for r in snapshots.modified(table, stats).collect()} == {("a", "modified"), ("b/x", "missing")}


def history(spark):
    """Two commits over trees that share a blob, with a link and a nested tree."""
    blobs = {n: oid(n.encode()) for n in ("one", "two", "three")}
    sub = fm.tree_bytes([("100644", blobs["two"], "two.txt")])
    t1 = fm.tree_bytes([("100644", blobs["one"], "one.txt"), ("40000", oid(sub, "tree"), "sub"), ("120000", blobs["three"], "link")])
    t2 = fm.tree_bytes([("100755", blobs["three"], "run"), ("40000", oid(sub, "tree"), "sub")])
    who = "A U Thor <a@example.org> 1700000000 +0100"
    c1 = f"tree {oid(t1, 'tree')}\nauthor {who}\ncommitter {who}\n\nfirst parent author\n".encode()
    c2 = f"tree {oid(t2, 'tree')}\nparent {oid(c1, 'commit')}\nauthor {who}\ncommitter {who}\nencoding x\n\n\nsecond\n\nbody".encode()
    rows = [(oid(d, k), k, bytearray(d)) for k, d in (("tree", sub), ("tree", t1), ("tree", t2), ("commit", c1), ("commit", c2))]
    rows += [(o, "blob", bytearray(n.encode())) for n, o in blobs.items()]
    return spark.createDataFrame(rows, "oid string, obj_type string, data binary"), blobs, {"c1": oid(c1, "commit"), "c2": oid(c2, "commit"), "t1": oid(t1, "tree"), "t2": oid(t2, "tree"), "sub": oid(sub, "tree")}


def test_parse_and_serialise(spark):
    objects, _, ids = history(spark)
    commits = parse.parse_commits(objects)
    rows = {r["oid"]: r for r in commits.collect()}
    assert rows[ids["c2"]]["parents"] == [ids["c1"]] and rows[ids["c1"]]["parents"] == []
    assert rows[ids["c2"]]["author"]["epoch"] == 1700000000 and rows[ids["c2"]]["author"]["tz"] == "+0100" and rows[ids["c2"]]["extra"] == "encoding x"
    assert {r["oid"] for r in parse.commit_data(commits).collect()} == {ids["c1"], ids["c2"]}
    assert {r[0] for r in commits.select(parse.subject(F.col("message"))).collect()} == {"first parent author", "second"}
    items = parse.parse_trees(objects)
    assert {r["oid"] for r in parse.tree_data(items, "tree_oid").collect()} == {ids["t1"], ids["t2"], ids["sub"]}
    assert {r["kind"] for r in items.collect()} == {"blob", "tree", "link", "executable"}
    tag = b"object " + b"ab" * 20 + b"\ntype commit\ntag v1\ntagger T <t@x> 5 -0200\n\nnote\n"
    tags = parse.parse_tags(spark.createDataFrame([(oid(tag, "tag"), "tag", bytearray(tag))], "oid string, obj_type string, data binary"))
    assert tags.first()["tag_name"] == "v1" and parse.tag_data(tags).first()["oid"] == oid(tag, "tag")


def test_fetch_sets(spark):
    objects, blobs, ids = history(spark)
    commits, items = parse.parse_commits(objects), parse.parse_trees(objects)
    links = parse.commit_parents(commits)
    request = transfer.parse_fetch(transfer.packet(f"want {ids['c2']} ofs-delta\n") + transfer.FLUSH + transfer.packet("done\n"))
    assert request.done and request.capabilities == ["ofs-delta"]
    full, common = transfer.fetch(spark, request, commits, links, items)
    assert common == [] and {r["oid"] for r in full.collect()} == set(ids.values()) | set(blobs.values())
    request.have = [ids["c1"], "ff" * 20]
    part, common = transfer.fetch(spark, request, commits, links, items)
    assert common == [ids["c1"]] and {r["oid"] for r in part.collect()} == {ids["c2"], ids["t2"], blobs["three"]}


def test_push_commands(spark):
    zero, a, b = "0" * 40, "aa" * 20, "bb" * 20
    lines = [f"{zero} {a} refs/heads/new\0caps", f"{a} {b} refs/heads/main\n", f"{b} {zero} refs/heads/stale", f"{zero} {'cc' * 20} refs/tags/v1"]
    commands = transfer.parse_commands(spark.createDataFrame([(x,) for x in lines], "line string"))
    refs = spark.createDataFrame([("refs/heads/main", a), ("refs/heads/stale", a)], "name string, oid string")
    objects = spark.createDataFrame([(a,), (b,)], "oid string")
    after, judged = transfer.apply_commands(refs, commands, objects)
    assert {tuple(r) for r in after.collect()} == {("refs/heads/main", b), ("refs/heads/stale", a), ("refs/heads/new", a)}
    assert {r["ref_name"]: r["error"] for r in judged.collect()} == {"refs/heads/new": None, "refs/heads/main": None, "refs/heads/stale": "stale old id", "refs/tags/v1": "unknown object"}
    text = transfer.report(judged)
    assert b"ng refs/tags/v1 unknown object" in text and text.endswith(b"0000")
    packets, _ = transfer.read_packets(transfer.advertise(refs, "upload"))
    assert packets[0] == b"# service=git-upload-pack\n" and packets[2].startswith(a.encode() + b" HEAD\0")
    assert b"".join(p[5:] for p in transfer.side_band(b"x" * 3000, large=False)) == b"x" * 3000


def test_graph_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("b", "d")], "src string, dst string")
    got = {tuple(r) for r in graph.closure(spark.createDataFrame([("a",)], "node string"), edges).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d")], "node string, needs string")
    assert {tuple(r) for r in graph.layers(nodes, deps).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    ready = graph.ready_tasks(nodes, deps, spark.createDataFrame([("a",)], "node string"))
    assert {r["node"] for r in ready.collect()} == {"b"}
    revisions = spark.createDataFrame([("p", ["p", "q", "q", None], 1), ("q", [], 2)], "oid string, parents array<string>, own int")
    assert graph.clean_parents(revisions).where("oid = 'p'").first()["parents"] == ["q"]
    assert [r["oid"] for r in graph.mixed_parents(revisions, "own").collect()] == ["p"]


def test_running_total_over_ranges(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), (F.col("id") % 7).alias("v"))
    got = {r["k"]: r["t"] for r in windows.running_total(df, ["k"], F.col("v"), "t", 12, parts=7).collect()}
    total, values = 12, {r["k"]: r["v"] for r in df.collect()}
    for k in range(500):
        assert got[k] == total
        total += values[k]


def test_functions(spark):
    row = spark.createDataFrame([("Hello, world!", "a/b c.txt")], "t string, p string").select(
        identity.object_id("blob", F.col("t").cast("binary")).alias("sha1"), identity.object_id("blob", F.col("t").cast("binary"), "sha256").alias("sha256"),
        identity.short_id(F.lit(None).cast("string")).alias("none"), identity.id_kind(F.lit("ab" * 32)).alias("kind"),
        tx.path_under("p", "a").alias("under"), tx.path_under("p", "a/b").alias("not_under"),
        tx.sampled_rate(F.lit(""), F.lit("")).alias("both_empty"), tx.sampled_rate(F.lit("x"), F.lit("x")).alias("same"), tx.sampled_rate(F.lit(""), F.lit("x")).alias("one_empty"),
        tx.stepped_rate(F.lit("x" * 5000), F.lit("x" * 5000)).alias("stepped"),
        identity.integrity_hash(F.lit('{"a":1,"b":{"d":2,"c":3}}')).alias("h1"), identity.integrity_hash(F.lit('{"b":{"c":3,"d":2},"a":1}')).alias("h2"),
        labels.capabilities(F.lit("side-band-64k agent=x/1  ofs-delta")).alias("caps"), labels.open_label(F.lit('{"other":"zz"}')).alias("other"), labels.mode_kind(F.lit("100755")).alias("mode"),
        labels.index_flags(labels.index_flag_bits(F.lit(True), F.lit(False), F.lit(2), F.lit(77)))["stage"].alias("stage"),
        tx.ssh_command(F.lit("git-upload-pack '/a/b'")).alias("ssh"), tx.service_of_query(F.lit("/x/info/refs?service=git-receive-pack")).alias("service"),
    ).first()
    assert row["sha1"] == oid(b"Hello, world!") and row["sha256"] == oid(b"Hello, world!", h="sha256")
    assert (row["none"], row["kind"], row["under"], row["not_under"]) == ("0000000", "sha256", True, False)
    assert (row["both_empty"], row["same"], row["one_empty"], row["stepped"]) == (1, 1, 0, 1)
    assert row["h1"] == row["h2"] and len(row["h1"]) == 64
    assert [tuple(c) for c in row["caps"]] == [("side-band-64k", "", True), ("agent", "x/1", True), ("ofs-delta", "", True)] and (row["other"], row["mode"], row["stage"]) == ("zz", "executable", 2)
    assert (row["ssh"]["service"], row["ssh"]["path"], row["service"]) == ("upload", "/a/b", "receive")
    names = ["abc.txt", "dir/x y", "ü"]
    want = []
    for n in names:
        h = 0
        for c in n.rsplit("/", 1)[-1].encode():
            if c not in b" \t\n\v\f\r":
                h = ((h >> 2) + (c << 24)) & 0xFFFFFFFF
        want.append(h)
    got = spark.createDataFrame([(n,) for n in names], "p string").select(tx.path_name_hash("p")).collect()
    assert [r[0] for r in got] == want


def test_workflow_json(spark):
    head = {"object_id": "1", "object_type": "run_event", "version": 1, "created_at": "2025-01-02T03:04:05Z", "created_by": {"kind": "human", "id": "me"}}
    docs = [head | {"run_id": "r", "kind": "completed", "metrics": {"n": [1, 2]}}, head | {"object_type": "task"}, head | {"version": 0, "run_id": "r", "kind": "x", "odd": 1}]
    df = spark.createDataFrame([(bytearray(json.dumps(d).encode()),) for d in docs], "data binary")
    rows = parse.parse_workflow(df, "run_event")
    assert [r["problem"] for r in rows.orderBy("version").select("problem").collect()] == ["unknown: odd", None]
    assert rows.where("version = 1").select(F.variant_get("metrics", "$.n[1]", "int")).first()[0] == 2
    assert "created_by" in rows.select(parse.workflow_json(rows.drop("metrics"))).first()[0]


def test_audit_chain(spark):
    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = events.audit_chain(
        t([("i1",), ("i2",)], "object_id string"), t([("p1", "i1")], "object_id string, intent string"), t([("t1", "i1")], "object_id string, intent string"),
        t([("r1", "t1", "p1"), ("r2", "t1", "gone")], "object_id string, task string, plan string"), t([("s1", "r1")], "object_id string, run string"),
        t([("r1",), ("r1",)], "run_id string"), t([("r1", "commit", "s1")], "run_id string, decision_type string, chosen_patchset_id string"),
    )
    got = {(r["intent_id"], r["run_id"], r["patchset_id"], r["evidence"], r["decision_type"], r["plan_known"]) for r in out.collect()}
    assert got == {("i1", "r1", "s1", 2, "commit", True), ("i1", "r2", None, None, None, False), ("i2", None, None, None, None, False)}
    lost = events.broken_links({"run": t([("r1", "t9")], "object_id string, task string"), "task": t([("t1",)], "object_id string")}, [("run", "task", "task")])
    assert lost.first()["missing"] == 1


def test_snapshot_diffs(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("d/c", "3")], "path string, oid string")
    new = spark.createDataFrame([("a", "1"), ("b", "4"), ("d/e", "5")], "path string, oid string")
    objects = spark.createDataFrame([("2", "x\n"), ("4", "y\n"), ("3", "gone\n"), ("5", "new\n")], "oid string, data string")
    assert {(r["path"], r["change"]) for r in snapshots.changed_paths(old, new).collect()} == {("b", "modify"), ("d/c", "delete"), ("d/e", "add")}
    got = {r["path"]: r["data"] for r in snapshots.diff_snapshots(old, new, objects, ["d"]).collect()}
    assert set(got) == {"d/c", "d/e"} and "+++ /dev/null" in got["d/c"] and "+new" in got["d/e"]


def test_stream_waits_for_late_bases(spark, tmp_path):
    base, late = b"shared words " * 30, b"shared words " * 30 + b"!"
    source, store = f"{tmp_path}/in", f"{tmp_path}/out"
    put(f"{source}/one.pack", fm.pack_bytes([fm.encode_entry(fm.REF_DELTA, codecs.encode_rabin(base, late), base_oid=oid(base)), fm.encode_entry(fm.BLOB, b"other")]))
    query, target = ingest.ingest(spark, source, store)
    query.awaitTermination()
    assert {r["oid"] for r in target.objects().collect()} == {oid(b"other")} and target.waiting().count() == 1
    put(f"{source}/two.pack", fm.pack_bytes([fm.encode_entry(fm.BLOB, base)]))
    query, target = ingest.ingest(spark, source, store)
    query.awaitTermination()
    assert {r["oid"] for r in target.objects().collect()} == {oid(b"other"), oid(base), oid(late)} and target.waiting().count() == 0


def test_event_time_counts(spark, tmp_path):
    spark.createDataFrame([("2025-01-01 00:01:00", "a"), ("2025-01-01 00:02:00", "a"), ("2025-01-01 00:07:00", "b")], "s string, kind string").select(F.to_timestamp("s").alias("ts"), "kind").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/ev")
    q = ingest.event_counts(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["kind"], r["n"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_packfile_writes_a_pack_per_task_and_reads_ranges(spark, tmp_path):
    readers.register(spark)
    base = "words that most of these share, a line of them\n" * 12
    texts = [(base + f"tail {k}").encode() for k in range(60)]
    objects = spark.createDataFrame([(oid(t), "blob", bytearray(t)) for t in texts], "oid string, obj_type string, data binary").repartition(2)
    objects.write.format("packfile").mode("append").option("window", "4").save(f"{tmp_path}/packs")
    assert sorted(n.rsplit(".", 1)[1] for n in os.listdir(f"{tmp_path}/packs")) == ["idx", "idx", "pack", "pack"]
    whole = spark.read.format("packfile").load(f"{tmp_path}/packs")
    split = spark.read.format("packfile").option("splitBytes", "200").load(f"{tmp_path}/packs")
    assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions() == 2
    key = lambda df: {(r["pack_id"], r["seq"], r["offset"], r["next_offset"], r["type_bits"], r["base_offset"], r["crc32"], bytes(r["payload"])) for r in df.collect()}
    assert key(split) == key(whole)
    made = chains.rebuild(split).collect()
    assert {(r["oid"], bytes(r["data"])) for r in made} == {(oid(t), t) for t in texts} and any(r["is_delta"] for r in made)
    assert {r["error"] for r in readers.check_packs(spark, f"{tmp_path}/packs").collect()} == {None}
    idx = {(r["oid"], r["offset"]) for r in readers.read_pack_indexes(spark, f"{tmp_path}/packs").collect()}
    assert idx == {(r["oid"], r["pack_offset"]) for r in made}
    with pytest.raises(Exception, match="only commits"):
        objects.withColumn("obj_type", F.lit("task")).write.format("packfile").mode("append").save(f"{tmp_path}/bad")


@pytest.mark.parametrize("kind", ["sha1", "sha256"])
def test_index_sections_equal_the_plain_writer(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(writers, "INDEX_RANGE", 7)
    rows = [(oid(b"%d" % k, h=kind), k * 977, 12 + k if k % 5 else (1 << 31) + k) for k in range(40)]
    check = "ab" * fm.ID_SIZE[kind]
    writers.write_pack_index(spark.createDataFrame(rows, "oid string, crc32 long, offset long"), f"{tmp_path}/x/a.idx", check, kind)
    with open(f"{tmp_path}/x/a.idx", "rb") as f:
        got, checksum = fm.parse_pack_index(f.read(), kind)
    assert got == sorted(rows) and checksum == check
    with open(f"{tmp_path}/x/a.idx", "rb") as f:
        assert f.read() == fm.pack_index_bytes(rows, check, kind)


def push_request(commands, entries):
    body = b"".join(transfer.packet(c) for c in commands) + transfer.FLUSH
    return body + (fm.pack_bytes(entries) if entries else b"")


def test_pushes(spark, tmp_path):
    zero, base, more = "0" * 40, b"shared words " * 30, b"shared words " * 30 + b"!"
    first = push_request([f"{zero} {oid(base)} refs/heads/main\0report-status\n"], [fm.encode_entry(fm.BLOB, base)])
    thin = push_request([f"{oid(base)} {oid(more)} refs/heads/main\n", f"{zero} {'ee' * 20} refs/tags/none\n"], [fm.encode_entry(fm.REF_DELTA, codecs.encode_rabin(base, more), base_oid=oid(base))])
    lost = push_request([f"{zero} {oid(b'z')} refs/heads/z\n"], [fm.encode_entry(fm.BLOB, b"z"), fm.encode_entry(fm.REF_DELTA, b"\1\1\1a", base_oid="ab" * 20)])
    broken = push_request([f"{oid(more)} {zero} refs/heads/main\n"], [fm.encode_entry(fm.BLOB, b"q")])[:-1] + b"\0"
    put(f"{tmp_path}/in/1.push", first)
    put(f"{tmp_path}/in/2.push", thin)
    query, target = ingest.ingest_pushes(spark, f"{tmp_path}/in", f"{tmp_path}/store")
    query.awaitTermination()
    assert {tuple(r) for r in target.refs().collect()} == {("refs/heads/main", oid(more))}
    put(f"{tmp_path}/in/3.push", lost)
    put(f"{tmp_path}/in/4.push", broken)
    put(f"{tmp_path}/in/5.push", push_request([f"{oid(more)} {zero} refs/heads/main\n"], []))
    query, target = ingest.ingest_pushes(spark, f"{tmp_path}/in", f"{tmp_path}/store")
    query.awaitTermination()
    assert target.refs().count() == 0 and {r["oid"] for r in target.store.objects().collect()} == {oid(base), oid(more)}
    said = {r["path"].rsplit("/", 1)[1][0]: bytes(r["report"]) for r in target.reports().collect()}
    assert b"unpack ok" in said["2"] and b"ok refs/heads/main" in said["2"] and b"ng refs/tags/none unknown object" in said["2"]
    assert b"unpack a delta's base is missing" in said["3"] and b"ng refs/heads/z" in said["3"]
    assert b"checksum" in said["4"] and b"ng refs/heads/main" in said["4"] and b"ok refs/heads/main" in said["5"]


def test_write_pack_of_copies_under_many_paths(spark, tmp_path):
    """Groups and offsets agree though equal objects come with different paths, in any order."""
    rows = [(oid(b"text %d" % (k % 150)), "blob", bytearray(b"text %d" % (k % 150)), f"d{k % 7}/f{k}") for k in range(450)]
    objects = spark.createDataFrame(rows, "oid string, obj_type string, data binary, file_path string").repartition(5, F.rand())
    writers.write_pack(objects, str(tmp_path), window=0, group=8)
    got = readers.read_packs(spark, str(tmp_path)).collect()
    assert len(got) == 150 and {oid(bytes(r["payload"])) for r in got} == {r[0] for r in rows}


def test_utf8_check_of_cut_characters_and_nulls(spark, tmp_path):
    """Bytes behind half a character, which 80 would end, and behind no text."""
    from quarrybed import catalogue

    rows = [(k, "é" * 60) for k in range(90, 180)] + [(k, None) for k in range(180, 190)] + [(k, "") for k in range(190, 200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["utf8_check"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, k % 3 == 0) for k in range(90, 200)]
