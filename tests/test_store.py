"""The store: objects, refs, requests and hooks."""

import pytest
from pyspark.sql import functions as F

from quarrybed.plans import transfer
from quarrybed.sources import formats as fm
from quarrybed.store import Store


def test_a_store_takes_and_gives(spark, tmp_path):
    seen = []
    store = Store(spark, f"file://{tmp_path}/s", authenticate=lambda who, action: action != "push" or who.get("token") == "t", after_push=seen.append, parsers={"note": lambda o: o.select(F.col("data").cast("string").alias("text"))})
    oid = lambda kind, data: fm.oid_of(kind, data)
    blob = b"hello\n"
    tree = fm.tree_bytes([("100644", oid("blob", blob), "a.txt")])
    commit = f"tree {oid('tree', tree)}\nauthor A <a@x> 1 +0000\ncommitter A <a@x> 1 +0000\n\nfirst\n".encode()
    head, zero = oid("commit", commit), "0" * 40
    assert store.default_branch() is None and store.objects().count() == 0
    lines = [f"{zero} {head} refs/heads/main\n", f"{zero} {'ab' * 20} refs/heads/lost\n"]
    pack = fm.pack_bytes([fm.encode_entry(c, d) for c, d in ((fm.BLOB, blob), (fm.TREE, tree), (fm.COMMIT, commit))])
    request = b"".join(map(transfer.packet, lines)) + transfer.FLUSH + pack
    with pytest.raises(PermissionError):
        store.push(request)
    push = store.push(request, {"token": "t"})
    assert b"ok refs/heads/main" in push.report and b"ng refs/heads/lost unknown object" in push.report and len(seen) == 1
    assert store.default_branch() == "refs/heads/main" and {tuple(r) for r in store.refs().collect()} == {("refs/heads/main", head)}
    assert head.encode() in store.advertise("upload")
    got, common = store.fetch(transfer.packet(f"want {head}") + transfer.FLUSH + transfer.packet("done"))
    assert {bytes(r["data"]) for r in got.collect()} == {blob, tree, commit} and common == []
    ids = spark.createDataFrame([(head,), ("zz",)], "oid string")
    assert [r["oid"] for r in store.has(ids).collect()] == [head] and store.get(ids).count() == 1
    more = spark.createDataFrame([("blob", bytearray(blob), None), ("note", bytearray(b"text"), "extra")], "obj_type string, data binary, origin string")
    assert (store.put(more), store.put(more)) == (1, 0)
    assert store.table("note").first()["text"] == "text" and store.objects().where("origin = 'extra'").count() == 1
    assert store.table("commit").first()["message"] == "first\n"
    with pytest.raises(ValueError):
        store.table("blob")
    judged = store.update(transfer.parse_commands(spark.createDataFrame([(f"{head} {zero} refs/heads/main",)], "line string")))
    assert judged.first()["status"] == "success" and store.refs().count() == 0
    name = store.pack_for(spark.createDataFrame([(head,)], "node string"), None, f"{tmp_path}/out")
    assert fm.pack_header((tmp_path / "out" / f"{name}.pack").read_bytes()) == 3
