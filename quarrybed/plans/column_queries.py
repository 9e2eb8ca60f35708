"""Named queries of column functions: labels, headers, packets, fingerprints, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import codecs, identity, labels
from ..operators import parse
from . import transfer
from .queries import table


def _pick(values, k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.pmod(k, F.lit(len(values)))).cast("int"))


@query("service_requests", """
    WITH u AS (SELECT o_orderkey, '/r' || o_orderkey || ['/info/refs', '/git-upload-pack', '/git-receive-pack', '/HEAD'][1 + o_orderkey % 4] AS path, ['upload', 'receive'][1 + o_orderkey % 2] AS service FROM orders)
    SELECT o_orderkey, o_orderkey % 4 < 3 AS is_request, 'application/x-git-' || service || '-pack-advertisement' AS advertised, 'application/x-git-' || service || '-pack-result' AS result FROM u""")
def service_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/r"), k.cast("string"), _pick(["/info/refs", "/git-upload-pack", "/git-receive-pack", "/HEAD"], k))
    service = _pick(["upload", "receive"], k)
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.is_service_request(path).alias("is_request"), labels.content_type(service, True).alias("advertised"), labels.content_type(service).alias("result"))


@query("workflow_labels", """
    SELECT o_orderkey, ['commit', 'zz', 'retry', '', 'rollback'][1 + o_orderkey % 5] AS label, o_orderkey % 5 <> 3 AS decision, o_orderkey % 3 <> 2 AS status, ['patchset', 'run', 'zz'][1 + o_orderkey % 3] AS plain FROM orders""")
def workflow_labels(spark, sf_dir):
    """Labels stored plainly or as another, whether an open and a closed domain take them, and plain names of types."""
    k = F.col("o_orderkey")
    stored = _pick(['"commit"', '{"other":"zz"}', "retry", "", "rollback"], k)
    opened = labels.open_label(stored)
    return table(spark, sf_dir, "orders").select("o_orderkey", opened.alias("label"), labels.in_domain("decision", opened).alias("decision"), labels.in_domain("tool_status", _pick(["ok", "error", "done"], k)).alias("status"), labels.plain_type(_pick(["patch_set", "run", "zz"], k)).alias("plain"))


@query("header_problems", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'version 0' WHEN o_orderkey % 4 = 1 THEN 'empty actor kind' WHEN o_orderkey % 4 = 2 THEN 'empty actor' END AS problem FROM orders")
def header_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    row = F.struct(F.when(k % 4 == 0, 0).otherwise(1).alias("version"), F.struct(F.when(k % 4 == 1, "").otherwise("human").alias("kind"), F.when(k % 4 != 2, "a").alias("id")).alias("created_by"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.header_problem(row).alias("problem"))


@query("canonical_hashes", """
    SELECT event_id, sha256('{"a":[' || event_id || ',{"x":1,"y":null}],"kind":"' || event_type || '","user":' || user_id || '}') AS hash FROM events""")
def canonical_hashes(spark, sf_dir):
    """Hashes of JSON whose keys come in no order."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{ "user": '), F.col("user_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('", "a": ['), F.col("event_id").cast("string"), F.lit(', {"y": null, "x": 1}]}'))
    return e.select("event_id", identity.integrity_hash(text).alias("hash"))


@query("packet_lines", """
    SELECT n_nationkey, printf('%04x', 5 + strlen(n_name)) AS head, n_name AS line, n_nationkey % 3 = 0 AS flushed FROM nation""")
def packet_lines(spark, sf_dir):
    """Packets of names, some followed by a flush, framed and read again."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    out = []
    for k, name in rows:
        stream = transfer.packet(name + "\n") + (transfer.FLUSH if k % 3 == 0 else b"")
        packets, at = transfer.read_packets(stream + b"zz")
        if at != len(stream):
            raise ValueError("a packet was misread")
        out.append((k, stream[:4].decode(), packets[0].decode().rstrip("\n"), packets[1:] == [None]))
    return spark.createDataFrame(out, "n_nationkey long, head string, line string, flushed boolean").withColumn("n_nationkey", F.col("n_nationkey").cast(table(spark, sf_dir, "nation").schema["n_nationkey"].dataType))


#: The window as a polynomial over two elements, modulo the one of degree 31: the sum of what each set bit leaves.
PRINTS = """
    WITH RECURSIVE x(bit, v) AS (SELECT 0, 1::UBIGINT UNION ALL SELECT bit + 1, CASE WHEN v >= 1073741824 THEN xor(v * 2, 2147483657::UBIGINT) ELSE v * 2 END FROM x WHERE bit < 127),
    d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= 16),
    b AS (SELECT doc_id, unnest([i FOR i IN range(16)]) AS i, h FROM d), y AS (SELECT doc_id, i, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS byte FROM b)
    SELECT doc_id, bit_xor(v)::BIGINT AS print FROM y JOIN x ON bit // 8 = 15 - i AND (byte >> (bit % 8)) & 1 = 1 GROUP BY doc_id"""


@query("window_prints", PRINTS)
def window_prints(spark, sf_dir):
    """Rabin fingerprints of the first window of each text."""
    d = table(spark, sf_dir, "documents").where(F.octet_length("text") >= 16)
    return d.select("doc_id", codecs.first_print_udf(F.col("text").cast("binary")).alias("print"))


@query("tree_order", """
    WITH i AS (SELECT s_nationkey AS tree, 'n' || (s_suppkey % 50) || CASE WHEN s_suppkey % 4 = 0 THEN '.x' ELSE '' END AS name, s_suppkey % 3 = 0 AS is_dir, s_suppkey FROM supplier)
    SELECT name, CASE WHEN is_dir THEN 'tree' ELSE 'blob' END AS kind, sha1(s_suppkey::VARCHAR) AS oid, (row_number() OVER (PARTITION BY tree ORDER BY encode(name || CASE WHEN is_dir THEN '/' ELSE '' END), sha1(s_suppkey::VARCHAR)) - 1)::INTEGER AS pos FROM i""")
def tree_order(spark, sf_dir):
    """Items of trees in the order of trees, in which a folder's name ends in a slash."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("n"), (k % 50).cast("string"), F.when(k % 4 == 0, ".x").otherwise(""))
    items = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tree"), F.when(k % 3 == 0, "40000").otherwise("100644").alias("mode"), F.sha1(k.cast("string")).alias("oid"), name.alias("name"))
    return parse.parse_trees(parse.tree_data(items, "tree")).select("name", "kind", "oid", "pos")


@query("ref_lines", "SELECT o_orderkey, o_orderkey % 2 = 0 AS tagged, CASE WHEN o_orderkey % 3 = 0 THEN 'create' ELSE 'update' END AS command FROM orders")
def ref_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, "refs/tags/").otherwise("refs/heads/"), k.cast("string"))
    old = F.when(k % 3 == 0, identity.zero_id()).otherwise(F.sha1(k.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", (labels.ref_kind(name) == "tag").alias("tagged"), labels.ref_command_kind(old, F.sha1(F.lit("x"))).alias("command"))
