"""The named queries over the driver's tables, each with the SQL that must give the same rows.

Blobs are document texts and page html; a path is a page's url; a commit chain is a
conversation (a turn's parent is the turn before); region, nation, customer, orders and
lineitem are levels of a tree; events are an event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import codecs, labels, text
from ..functions.identity import digest, object_id, payload_crc32, short_id
from ..operators import aggregates, chains, events, graph, parse, snapshots, windows
from ..storage import BATCH_BYTES, fresh_path, small_batches, written
from . import transfer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """oid, obj_type, data, file_path of document texts."""
    d = table(spark, sf_dir, "documents")
    data = F.col("text").cast("binary")
    return d.select("doc_id", object_id("blob", data).alias("oid"), F.lit("blob").alias("obj_type"), data.alias("data"), F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"))


OID = "sha1('blob ' || strlen(text)::VARCHAR || chr(0) || text)"


@query("blob_oid_sha1", f"SELECT doc_id, {OID} AS oid, left({OID}, 7) AS short FROM documents")
def blob_oid_sha1(spark, sf_dir):
    return document_blobs(spark, sf_dir).select("doc_id", "oid", short_id("oid").alias("short"))


@query("blob_oid_sha256", "SELECT doc_id, sha256('blob ' || strlen(text)::VARCHAR || chr(0) || text) AS oid, sha256(text) AS digest FROM documents")
def blob_oid_sha256(spark, sf_dir):
    data = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", object_id("blob", data, "sha256").alias("oid"), digest(data, "sha256").alias("digest"))


@query("oid_dedup", f"SELECT DISTINCT {OID} AS oid, strlen(text)::BIGINT AS size FROM documents")
def oid_dedup(spark, sf_dir):
    blobs = parse.blobs(table(spark, sf_dir, "documents"), "text")
    return aggregates.distinct_objects(blobs).select("oid", "size")


@query("oid_collision_groups", f"SELECT {OID} AS oid, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def oid_collision_groups(spark, sf_dir):
    return document_blobs(spark, sf_dir).groupBy("oid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("loose_and_packed", f"SELECT DISTINCT oid FROM (SELECT {OID} AS oid FROM documents UNION ALL SELECT sha1('blob ' || strlen(html)::VARCHAR || chr(0) || html) FROM pages)")
def loose_and_packed(spark, sf_dir):
    return aggregates.distinct_objects(parse.blobs(table(spark, sf_dir, "documents"), "text"), parse.blobs(table(spark, sf_dir, "pages"), "html")).select("oid")


@query("idx_fanout", f"""
    WITH ids AS (SELECT DISTINCT {OID} AS oid FROM documents),
    counts AS (SELECT ('0x' || left(oid, 2))::INTEGER AS slot, count(*) AS n FROM ids GROUP BY 1)
    SELECT range::INTEGER AS slot, coalesce(n, 0)::BIGINT AS n, (sum(coalesce(n, 0)) OVER (ORDER BY range ROWS UNBOUNDED PRECEDING))::BIGINT AS total
    FROM range(256) LEFT JOIN counts ON slot = range""")
def idx_fanout(spark, sf_dir):
    return aggregates.fan_out(document_blobs(spark, sf_dir).select("oid").distinct())


@query("idx_sorted_rows", f"""
    WITH o AS (SELECT {OID} AS oid, strlen(text) AS n, min(doc_id) AS d FROM documents GROUP BY 1, 2)
    SELECT oid, (12 + coalesce(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", row_number() OVER (ORDER BY oid) AS rank FROM o""")
def idx_sorted_rows(spark, sf_dir):
    o = document_blobs(spark, sf_dir).groupBy("oid").agg(F.min("doc_id").alias("d"), F.first(F.octet_length("data")).alias("n"))
    placed = windows.running_total(o, ["d"], F.col("n"), "offset", 12)
    return windows.ranked(placed.select("oid", "offset"), ["oid"], "rank")


#: Checksums by the table of the polynomial 0xEDB88320, byte by byte.
CRC = """
    WITH RECURSIVE t0(k, v, step) AS (SELECT range::UBIGINT, range::UBIGINT, 0 FROM range(256) UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, step + 1 FROM t0 WHERE step < 8),
    crc_table AS (SELECT list(v ORDER BY k) AS tab FROM t0 WHERE step = 8)"""


@query("crc32_rows", CRC + f""", d AS (SELECT doc_id, {OID} AS oid, hex(encode(text)) AS h FROM documents),
    b AS (SELECT doc_id, oid, list_prepend(4294967295::UBIGINT, [('0x' || substr(h, 2 * i - 1, 2))::UBIGINT FOR i IN range(1, 1 + length(h) // 2)]) AS codes FROM d)
    SELECT doc_id, oid, xor(list_reduce(codes, lambda c, x: xor(c // 256, tab[(xor(c, x) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc32 FROM b, crc_table""")
def crc32_rows(spark, sf_dir):
    return document_blobs(spark, sf_dir).select("doc_id", "oid", payload_crc32("data").alias("crc32"))


@query("pack_name_hash", r"""
    WITH b AS (SELECT page_id, url, hex(encode(regexp_extract(url, '([^/]*)$', 1))) AS h FROM pages),
    c AS (SELECT page_id, url, list_filter([('0x' || substr(h, 2 * i - 1, 2))::UBIGINT FOR i IN range(1, 1 + length(h) // 2)], lambda x: x NOT IN (9, 10, 11, 12, 13, 32)) AS codes FROM b)
    SELECT page_id, list_reduce(list_prepend(0::UBIGINT, codes), lambda a, x: ((a // 4 + x * 16777216) % 4294967296)::UBIGINT)::BIGINT AS name_hash FROM c""")
def pack_name_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.path_name_hash("url").alias("name_hash"))


@query("content_key", "SELECT doc_id, rpad(left(hex(encode(text)), 16), 16, '0') AS content_key FROM documents")
def content_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_key("text").alias("content_key"))


@query("magic_sort_rank", "SELECT doc_id, row_number() OVER (ORDER BY left(hex(encode(text)), 16), strlen(text) DESC, doc_id) AS rank FROM documents")
def magic_sort_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.content_key("text").alias("k"), (-F.octet_length("text")).alias("n"))
    return windows.ranked(d, ["k", "n", "doc_id"], "rank").select("doc_id", "rank")


@query("pack_offsets", 'SELECT doc_id, (12 + coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM documents')
def pack_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return windows.running_total(d, ["doc_id"], F.col("n"), "offset", 12).select("doc_id", "offset")


RANKED = "SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY strlen(text) DESC, doc_id) AS rn FROM documents"


def _candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").alias("n"))
    numbered = windows.ranked(d.withColumn("m", -F.col("n")), ["lang", "m", "doc_id"])
    return windows.delta_candidates(numbered, "lang", 10, "rn", "doc_id")


@query("delta_candidates", f"WITH r AS ({RANKED}) SELECT a.lang, a.doc_id AS target, b.doc_id AS base, a.rn - b.rn AS distance FROM r a JOIN r b ON a.lang = b.lang AND b.rn BETWEEN a.rn - 10 AND a.rn - 1")
def delta_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


def _with_texts(pairs, spark, sf_dir):
    """Pairs (target, base) with their texts t and b."""
    small_batches(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pairs.join(d.select(F.col("doc_id").alias("target"), F.col("text").alias("t")), "target").join(d.select(F.col("doc_id").alias("base"), F.col("text").alias("b")), "base")


def _with_marks(pairs, marks):
    """Pairs with narrow columns of both sides, (t_...) and (b_...)."""
    for side, key in (("t", "target"), ("b", "base")):
        pairs = pairs.join(marks.select(F.col("doc_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in marks.columns if c != "doc_id"]), key)
    return pairs


def _likely_pairs(spark, sf_dir):
    """(target, base, likely) of the delta candidates: whether chunk hashes allow a sampled rate above 0. No text meets another for it."""
    d = table(spark, sf_dir, "documents")
    marks = d.select("doc_id", F.octet_length("text").alias("n"), text.chunk_hashes("text").alias("chunks"))
    bound = text.rate_bound("b_chunks", "t_chunks", "b_n", "t_n")
    return written(_with_marks(_candidates(spark, sf_dir), marks).select("target", "base", (bound >= 0.5).alias("likely")), "likely")


def _alike(spark, sf_dir):
    """Candidates with a sampled rate above 0, and their texts."""
    near = _with_texts(_likely_pairs(spark, sf_dir).where("likely").drop("likely"), spark, sf_dir)
    return near.withColumn("rate", text.sampled_rate("b", "t")).where("rate > 0")


def _nearest_texts(spark, sf_dir):
    """Each text with the one before it in its candidate order, however unlike, as binary."""
    near = _with_texts(_candidates(spark, sf_dir).where("distance = 1").select("target", "base"), spark, sf_dir)
    return near.select("target", "base", F.col("t").cast("binary").alias("t"), F.col("b").cast("binary").alias("b"))


@query("head_tail_similar", f"""
    WITH r AS ({RANKED}), h AS (SELECT lang, doc_id, rn, hex(encode(text)) AS x FROM r),
    p AS (SELECT a.doc_id AS target, b.doc_id AS base, a.x AS ax, b.x AS bx, least(length(a.x), length(b.x)) AS n FROM h a JOIN h b ON a.lang = b.lang AND b.rn BETWEEN a.rn - 10 AND a.rn - 1)
    SELECT target, base FROM p WHERE left(ax, least(128, n)) = left(bx, least(128, n)) AND substr(ax, n - least(128, n) + 1, least(128, n)) = substr(bx, n - least(128, n) + 1, least(128, n))""")
def head_tail_similar(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"), F.substring(F.col("text").cast("binary"), 1, 64).alias("head"))
    size = F.least(F.lit(64), "t_n", "b_n")
    same_head = _with_marks(_candidates(spark, sf_dir), d).where(F.substring("t_head", F.lit(1), size) == F.substring("b_head", F.lit(1), size))
    return _with_texts(same_head.select("target", "base"), spark, sf_dir).where(text.head_tail_similar("t", "b")).select("target", "base")


RATE = f"""
    WITH r AS ({RANKED}), h AS (SELECT lang, doc_id, rn, hex(encode(text)) AS x FROM r),
    p AS (SELECT a.doc_id AS target, b.doc_id AS base, a.x AS ax, b.x AS bx, least(length(a.x), length(b.x)) // 2 AS low, greatest(length(a.x), length(b.x)) // 2 AS high FROM h a JOIN h b ON a.lang = b.lang AND b.rn BETWEEN a.rn - 10 AND a.rn - 1),
    s AS (SELECT target, base, low, high, list_sum([CASE WHEN substr(ax, 128 * i + 1, 2 * least(64, low - 64 * i)) = substr(bx, 128 * i + 1, 2 * least(64, low - 64 * i)) THEN least(64, low - 64 * i) ELSE 0 END FOR i IN range((low + 63) // 64)]) AS hit FROM p),
    q AS (SELECT target, base, CASE WHEN high = 0 THEN 1.0 WHEN low = 0 THEN 0.0 WHEN hit / high < 0.5 THEN 0.0 ELSE hit / high END AS rate FROM s)"""


@query("sampled_rate_64", RATE + " SELECT target, base, floor(rate * 10000)::BIGINT AS rate FROM q")
def sampled_rate_64(spark, sf_dir):
    pairs = _likely_pairs(spark, sf_dir)
    near = _with_texts(pairs.where("likely").drop("likely"), spark, sf_dir).select("target", "base", F.floor(text.sampled_rate("b", "t") * 10000).alias("rate"))
    return near.unionByName(pairs.where("NOT likely").select("target", "base", F.lit(0).cast("long").alias("rate")))


@query("best_sampled_base", RATE + " SELECT target, arg_min(base, (-floor(rate * 10000), base)) AS base, max(floor(rate * 10000))::BIGINT AS score FROM q WHERE rate > 0 GROUP BY target")
def best_sampled_base(spark, sf_dir):
    pairs = _alike(spark, sf_dir).select("target", "base", F.floor(F.col("rate") * 10000).alias("rate"))
    return windows.best_by(pairs, "target", "base", F.col("rate"), most=True)


@query("best_base")
def best_base(spark, sf_dir):
    """The base with the smallest Rabin delta, of candidates whose sampled rate says they are alike."""
    sized = _alike(spark, sf_dir).select("target", "base", F.octet_length(codecs.rabin_delta_udf(F.col("b").cast("binary"), F.col("t").cast("binary"))).alias("n"))
    return windows.best_by(sized, "target", "base", F.col("n"))


@query("exact_rates")
def exact_rates(spark, sf_dir):
    """Shares of each text's bytes that its nearest candidate has: by lines, by the Rabin delta, by sampled windows."""
    rate = lambda f: F.round(f("b", "t"), 6)
    return _nearest_texts(spark, sf_dir).select("target", "base", rate(codecs.shared_rate_udf).alias("lines"), rate(codecs.rabin_rate_udf).alias("rabin"), rate(codecs.rabin_sampled_rate_udf).alias("sampled"))


CODE = "CASE WHEN doc_id % 7 < 3 THEN 3 WHEN doc_id % 7 = 3 THEN 1 WHEN doc_id % 7 = 4 THEN 2 WHEN doc_id % 7 = 5 THEN 4 ELSE 6 END"


@query("pack_stats", f"WITH t AS (SELECT {CODE} AS c FROM documents) SELECT count(*) FILTER (c = 1) AS commits, count(*) FILTER (c = 2) AS trees, count(*) FILTER (c = 3) AS blobs, count(*) FILTER (c = 4) AS tags, count(*) FILTER (c >= 5) AS deltas, count(*) AS total FROM t")
def pack_stats(spark, sf_dir):
    return aggregates.pack_stats(table(spark, sf_dir, "documents").select(F.expr(CODE).alias("type_bits")))


@query("type_codes", "SELECT source, CASE WHEN lang = 'en' THEN 3 WHEN lang = 'de' THEN 1 WHEN lang = 'fr' THEN 2 ELSE 4 END AS code, lang <> 'es' AS is_file, count(*) AS n FROM documents GROUP BY ALL")
def type_codes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "blob").when(F.col("lang") == "de", "commit").when(F.col("lang") == "fr", "tree").otherwise("tag")
    coded = d.select("source", labels.pack_code(kind).alias("code"), (labels.pack_type(labels.pack_code(kind)) != "tag").alias("is_file"))
    return coded.groupBy("source", "code", "is_file").agg(F.count(F.lit(1)).alias("n"))


@query("index_flags", "SELECT l_orderkey, l_linenumber, (f >> 15) & 1 = 1 AS assume_valid, ((f >> 12) & 3)::INTEGER AS stage, (f & 4095)::INTEGER AS name_length FROM (SELECT *, ((l_orderkey * 31 + l_linenumber * 4096) % 65536)::INTEGER AS f FROM lineitem)")
def index_flags(spark, sf_dir):
    f = F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 4096, F.lit(65536)).cast("int")
    x = labels.index_flags(f)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x["assume_valid"].alias("assume_valid"), x["stage"].alias("stage"), x["name_length"].alias("name_length"))


LANES = ", ".join(f"bit_xor(('0x' || substr(oid, {8 * k + 1}, 8))::BIGINT) AS lane{k}" for k in range(5))


SUMS = ", ".join(f"sum(('0x' || substr(oid, {8 * k + 1}, 8))::BIGINT)::BIGINT AS sum{k}" for k in range(4))


@query("fingerprint_xor", f"WITH o AS (SELECT {OID} AS oid FROM documents) SELECT count(*) AS n, {LANES}, {SUMS} FROM o")
def fingerprint_xor(spark, sf_dir):
    return aggregates.fingerprint(document_blobs(spark, sf_dir))


@query("compression_totals", "SELECT lang, count(*) AS objects, sum(strlen(text))::BIGINT AS raw_bytes, sum(n_chars)::BIGINT AS stored_bytes, floor(sum(n_chars) * 1000 / sum(strlen(text)))::BIGINT AS per_mille FROM documents GROUP BY lang")
def compression_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("raw", F.octet_length("text"))
    return aggregates.compression_totals(d, "raw", "n_chars", "lang")


OLD_NEW = """
    WITH old AS (SELECT url AS path, sha1(html) AS oid FROM pages WHERE page_id % 35 <> 0),
    new AS (SELECT url AS path, sha1(html || CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '' END) AS oid FROM pages WHERE page_id % 35 <> 1)"""


def _snapshots(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    old = p.where("page_id % 35 <> 0").select(F.col("url").alias("path"), digest("html").alias("oid"))
    more = F.when(F.col("page_id") % 3 == 0, F.lit("x")).otherwise(F.lit(""))
    new = p.where("page_id % 35 <> 1").select(F.col("url").alias("path"), F.sha1(F.concat("html", more)).alias("oid"))
    return old, new


@query("changed_paths", OLD_NEW + """
    SELECT path, o.oid AS old_oid, n.oid AS new_oid, CASE WHEN o.oid IS NULL THEN 'add' WHEN n.oid IS NULL THEN 'delete' ELSE 'modify' END AS change
    FROM old o FULL JOIN new n USING (path) WHERE o.oid IS DISTINCT FROM n.oid""")
def changed_paths(spark, sf_dir):
    return snapshots.changed_paths(*_snapshots(spark, sf_dir))


@query("path_under_dir", "SELECT page_id, url FROM pages WHERE regexp_extract(url, '://[^/]*(/[a-z]+)/', 1) = '/en' AND starts_with(regexp_extract(url, '://[^/]*(/.*)$', 1), '/en/')")
def path_under_dir(spark, sf_dir):
    path = F.regexp_extract("url", "://[^/]*(/.*)$", 1)
    return table(spark, sf_dir, "pages").where(text.path_under(path, "/en")).select("page_id", "url")


@query("files_by_dir", r"""
    WITH p AS (SELECT string_split(regexp_extract(url, '://(.*)$', 1), '/') AS s FROM pages),
    d AS (SELECT unnest([array_to_string(s[1:i], '/') FOR i IN range(1, len(s))]) AS dir FROM p) SELECT dir, count(*) AS files FROM d GROUP BY dir""")
def files_by_dir(spark, sf_dir):
    return aggregates.files_by_dir(table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://(.*)$", 1).alias("path")))


LINES = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END"


@query("large_file_marker", f"SELECT doc_id, ({LINES})::BIGINT AS lines, CASE WHEN {LINES} > 20 THEN 'large file: ' || source || ' has ' || ({LINES})::BIGINT || ' lines, limit 20' END AS marker FROM documents")
def large_file_marker(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count("text").cast("long").alias("lines"), text.large_file_marker("source", "text", F.lit(""), 20).alias("marker"))


@query("utf8_check", """
    WITH h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(hex(encode(text)), 2 * (doc_id % 50)) || CASE doc_id % 9 WHEN 0 THEN '80' WHEN 3 THEN 'C0AF' ELSE 'EDA080' END ELSE hex(encode(text)) END AS h FROM documents)
    SELECT doc_id, doc_id % 3 = 0 AS is_binary FROM h""")
def utf8_check(spark, sf_dir):
    """Texts (null: empty), a third of them with bytes that no UTF-8 has, behind whole characters: after the first byte of a cut one, 80 could end it."""
    k, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    wrong = F.unhex(F.when(k % 9 == 0, "80").when(k % 9 == 3, "C0AF").otherwise("EDA080"))
    broken = F.when(k % 3 == 0, F.concat(F.substring(t, F.lit(1), (k % 50).cast("int")).cast("binary"), wrong)).otherwise(t.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_binary(broken, F.lit("").cast("binary")).alias("is_binary"))


def _turn_pairs(spark, sf_dir):
    small_batches(spark, BATCH_BYTES // 4)  # each line of a text becomes an object of its own
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", F.lag("text").over(w).alias("old"), F.col("text").alias("new")).where("old IS NOT NULL")
    return pairs.withColumn("path", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


@query("line_multiset_diff", r"""
    WITH p AS (SELECT conv_id || '/' || turn AS path, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old, text AS new FROM conversations),
    l AS (SELECT path, unnest(string_split(old, chr(10))) AS line, -1 AS n FROM p WHERE old IS NOT NULL UNION ALL SELECT path, unnest(string_split(new, chr(10))), 1 FROM p WHERE old IS NOT NULL)
    SELECT path, line, sum(n)::BIGINT AS delta FROM l GROUP BY path, line HAVING sum(n) <> 0""")
def line_multiset_diff(spark, sf_dir):
    return snapshots.line_bag_changes(_turn_pairs(spark, sf_dir), "path", "old", "new")


@query("line_ops")
def line_ops(spark, sf_dir):
    return snapshots.line_changes(_turn_pairs(spark, sf_dir), "path", "old", "new")


@query("line_ops_applied", r"""
    WITH p AS (SELECT conv_id || '/' || turn AS path, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old, text AS new FROM conversations), c AS (SELECT path, old, new FROM p WHERE old IS NOT NULL),
    n AS (SELECT path, old, new, [regexp_replace(x, '\r+$', '') FOR x IN string_split(CASE WHEN ends_with(old, chr(10)) THEN left(old, length(old) - 1) ELSE old END, chr(10))] AS a, [regexp_replace(x, '\r+$', '') FOR x IN string_split(CASE WHEN ends_with(new, chr(10)) THEN left(new, length(new) - 1) ELSE new END, chr(10))] AS b FROM c)
    SELECT path, CASE WHEN old = '' THEN '' ELSE array_to_string(a, chr(10)) END AS old, CASE WHEN new = '' THEN '' ELSE array_to_string(b, chr(10)) END AS new FROM n WHERE old <> '' OR new <> ''""")
def line_ops_applied(spark, sf_dir):
    """Both sides of each pair of texts, put together again from the line operations."""
    ops = line_ops(spark, sf_dir)
    side = lambda gone, at: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") != gone, F.struct(at, "content")))), lambda x: x["content"]), "\n")
    return ops.groupBy("path").agg(side("insert", "old_line").alias("old"), side("delete", "new_line").alias("new"))


@query("unified_diff")
def unified_diff(spark, sf_dir):
    p = _turn_pairs(spark, sf_dir)
    a, b = object_id("blob", "old"), object_id("blob", "new")
    old, new = p.select("path", a.alias("oid")), p.select("path", b.alias("oid"))
    content = p.select(a.alias("oid"), F.col("old").alias("data")).unionByName(p.select(b.alias("oid"), F.col("new").alias("data")))
    return snapshots.diff_snapshots(old, new, content)


@query("unified_diff_balance", r"""
    WITH p AS (SELECT conv_id || '/' || turn AS path, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old, text AS new FROM conversations),
    n AS (SELECT path, old, new, [CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, chr(10), '')) + CASE WHEN ends_with(x, chr(10)) THEN 0 ELSE 1 END END FOR x IN [old, new]] AS k FROM p WHERE old <> new)
    SELECT path, (k[2] - k[1])::BIGINT AS balance FROM n""")
def unified_diff_balance(spark, sf_dir):
    """Added less removed lines of each file's diff; texts that differ have one."""
    d = unified_diff(spark, sf_dir)
    lines = F.split("data", "\n")
    count = lambda sign: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3 + " "))))
    return d.select("path", (count("+") - count("-")).cast("long").alias("balance"))


def _levels(spark, sf_dir):
    """Edges region -> nation -> customer -> orders, as named nodes."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edges = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    edges = edges.unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    return edges.unionByName(o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))


LEVELS = """
    WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL
      SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query("tree_descent", LEVELS + ", w(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT dst, depth + 1 FROM w JOIN e ON src = node) SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node")
def tree_descent(spark, sf_dir):
    roots = spark.range(1).select(F.lit("r1").alias("node"))
    return graph.closure(roots, _levels(spark, sf_dir))


@query("want_have_objects", LEVELS + """, w(root, node) AS (SELECT x, x FROM (VALUES ('r1'), ('n6'), ('n4')) v(x) UNION ALL SELECT root, dst FROM w JOIN e ON src = node)
    SELECT DISTINCT node FROM w WHERE root = 'r1' AND node NOT IN (SELECT node FROM w WHERE root <> 'r1')""")
def want_have_objects(spark, sf_dir):
    edges = _levels(spark, sf_dir)
    node = lambda *x: spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in x])).alias("node"))
    return graph.closure(node("r1"), edges).join(graph.closure(node("n6", "n4"), edges), "node", "left_anti").select("node")


TURN_EDGES = "SELECT conv_id || ':' || turn AS src, conv_id || ':' || (turn - 1) AS dst FROM conversations WHERE turn > 0"


def _turn_edges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("src"), F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("dst"))


@query("commit_closure", f"WITH RECURSIVE e AS ({TURN_EDGES}), w(node, depth) AS (SELECT conv_id || ':' || max(turn), 0 FROM conversations GROUP BY conv_id UNION ALL SELECT dst, depth + 1 FROM w JOIN e ON src = node) SELECT node, depth::INTEGER AS depth FROM w")
def commit_closure(spark, sf_dir):
    heads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"))
    return graph.closure(heads.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("t").cast("string")).alias("node")), _turn_edges(spark, sf_dir))


@query("revision_heads", f"WITH e AS ({TURN_EDGES}) SELECT conv_id || ':' || turn AS oid FROM conversations WHERE conv_id || ':' || turn NOT IN (SELECT dst FROM e)")
def revision_heads(spark, sf_dir):
    return graph.heads(_revisions(spark, sf_dir)).select("oid")


def _revisions(spark, sf_dir):
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    c = table(spark, sf_dir, "conversations")
    parents = F.when(F.col("turn") > 0, F.array(name(F.col("turn") - 1), name(F.col("turn")), name(F.col("turn") - 1))).otherwise(F.array().cast("array<string>"))
    return graph.clean_parents(c.select(name(F.col("turn")).alias("oid"), "conv_id", parents.alias("parents")))


@query("parents_dedup", "SELECT conv_id || ':' || turn AS oid, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) ELSE '' END AS parents, (turn > 0)::BIGINT AS n FROM conversations")
def parents_dedup(spark, sf_dir):
    return _revisions(spark, sf_dir).select("oid", F.array_join("parents", ",").alias("parents"), F.size("parents").cast("long").alias("n"))


@query("mixed_parents", "SELECT conv_id || ':' || turn AS oid FROM conversations WHERE turn > 0 AND role <> (SELECT role FROM conversations b WHERE b.conv_id = conversations.conv_id AND b.turn = conversations.turn - 1)")
def mixed_parents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = _revisions(spark, sf_dir).join(c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("oid"), "role"), "oid")
    return graph.mixed_parents(r, "role")


@query("ref_delta_missing", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def ref_delta_missing(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return graph.missing_bases(table(spark, sf_dir, "lineitem"), "l_orderkey", known, "o_orderkey").select("l_orderkey", "l_linenumber")


@query("dep_counts", "SELECT l_orderkey, count(*) AS users FROM lineitem GROUP BY 1")
def dep_counts(spark, sf_dir):
    return aggregates.dependency_counts(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("releasable", "SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) <= (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def releasable(spark, sf_dir):
    users = table(spark, sf_dir, "lineitem")
    return aggregates.releasable(table(spark, sf_dir, "orders"), "o_orderkey", users, users.where("l_linestatus = 'F'"), "l_orderkey")


@query("common_commits", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def common_commits(spark, sf_dir):
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("oid"))
    return graph.common_commits(have, known).select(F.col("node").alias("c_custkey"))


@query("index_upsert", """
    WITH b AS (SELECT DISTINCT ON (user_id) user_id AS name, event_id AS oid FROM events WHERE event_id % 2 = 0 ORDER BY user_id, event_id),
    c AS (SELECT user_id AS name, event_id AS oid, event_id AS seq, event_type = 'view' AS gone FROM events WHERE event_id % 2 = 1),
    l AS (SELECT name, arg_max(oid, seq) AS oid, arg_max(gone, seq) AS gone FROM c GROUP BY name)
    SELECT coalesce(l.name, b.name) AS name, coalesce(l.oid, b.oid) AS oid FROM b FULL JOIN l ON b.name = l.name WHERE l.gone IS NOT TRUE""")
def index_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("name")).agg(F.min("event_id").alias("oid"))
    changes = e.where("event_id % 2 = 1").select(F.col("user_id").alias("name"), F.col("event_id").alias("oid"), (F.col("event_type") == "view").alias("deleted"), F.col("event_id").alias("seq"))
    return snapshots.upsert(base, changes, ("name",))


@query("latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS created_at, arg_max(event_id, (ts, event_id)) AS object_id FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.col("event_id").alias("object_id"))
    return events.current_state(e, "user_id")


@query("latest_patchset", "SELECT conv_id AS run, max(turn) AS sequence, conv_id * 100 + max(turn) AS object_id FROM conversations GROUP BY conv_id")
def latest_patchset(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("sequence"), (F.col("conv_id") * 100 + F.col("turn")).alias("object_id"))
    return events.latest_patch_sets(c)


@query("reverse_index", "SELECT l_orderkey, count(DISTINCT l_partkey) AS n, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM lineitem GROUP BY 1")
def reverse_index(spark, sf_dir):
    out = events.reverse_index(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return out.select("l_orderkey", "n", F.array_join(F.col("values").cast("array<string>"), ",").alias("parts"))


@query("context_budget", "WITH w AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id, turn, used::BIGINT AS used FROM w WHERE used <= 1000")
def context_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("tokens"))
    return windows.context_budget(c, "conv_id", ["turn"], "tokens", 1000).select("conv_id", "turn", "used")


@query("ready_tasks", "SELECT o_orderkey AS node FROM orders WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 3 <> 0)")
def ready_tasks(spark, sf_dir):
    o, li, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    tasks = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("node"))
    deps = li.select(F.col("l_orderkey").alias("node"), (-F.col("l_suppkey")).alias("needs"))
    done = s.where("s_suppkey % 3 = 0").select((-F.col("s_suppkey")).alias("node"))
    all_done = done.unionByName(li.where("l_suppkey % 3 = 0").select((-F.col("l_suppkey")).alias("node"))).distinct()
    return graph.ready_tasks(tasks, deps, all_done)


@query("dependency_layers", f"WITH RECURSIVE e AS ({TURN_EDGES}) SELECT conv_id || ':' || turn AS node, turn::INTEGER AS layer FROM conversations")
def dependency_layers(spark, sf_dir):
    nodes = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"))
    return graph.layers(nodes, _turn_edges(spark, sf_dir).select(F.col("src").alias("node"), F.col("dst").alias("needs")))


@query("usage_totals", """
    SELECT l_orderkey AS run_id, sum(l_linenumber * 0.25)::DOUBLE AS cost_usd, sum(l_quantity::BIGINT)::BIGINT AS input_tokens, sum(l_linenumber)::BIGINT AS output_tokens, sum(l_quantity::BIGINT + l_linenumber + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS total_tokens,
    bool_and(l_returnflag <> 'R') AS consistent FROM lineitem GROUP BY 1""")
def usage_totals(spark, sf_dir):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    extra = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), q.alias("input_tokens"), n.alias("output_tokens"), (q + n + extra).alias("total_tokens"), (n * 0.25).alias("cost_usd"))
    return aggregates.usage_totals(u)


@query("props_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def props_json(spark, sf_dir):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return table(spark, sf_dir, "events").select("event_id", v.alias("k"))


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("page"))


@query("sideband_chunks", "SELECT doc_id, (i // 995)::INTEGER AS seq, i::INTEGER AS start, least(995, strlen(text) - i)::INTEGER AS length FROM (SELECT doc_id, text, unnest(range(0, strlen(text), 995)) AS i FROM documents)")
def sideband_chunks(spark, sf_dir):
    return transfer.chunk_table(table(spark, sf_dir, "documents"), "doc_id", "text", transfer.SMALL_BAND).drop("chunk")


VARINT = lambda first: f"(CASE WHEN {{0}} < {2**first} THEN 1 ELSE 1 + ceil((length(bin({{0}})) - {first}) / 7.0) END)::INTEGER"


@query("varint_len", f"SELECT o_orderkey, {VARINT(7).format('o_orderkey * 977')} AS plain, {VARINT(4).format('o_orderkey * 977')} AS header, CASE WHEN o_orderkey * 977 < 128 THEN 1 WHEN o_orderkey * 977 < 16512 THEN 2 WHEN o_orderkey * 977 < 2113664 THEN 3 WHEN o_orderkey * 977 < 270549120 THEN 4 ELSE 5 END AS distance FROM orders")
def varint_len(spark, sf_dir):
    n = F.col("o_orderkey") * 977
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.varint_length(n).alias("plain"), labels.varint_length(n, 4).alias("header"), labels.offset_varint_length(n).alias("distance"))


@query("ref_commands", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'create' WHEN o_orderkey % 3 = 1 THEN 'delete' ELSE 'update' END AS command, CASE WHEN o_orderkey % 2 = 0 THEN 'tag' ELSE 'branch' END AS ref_type FROM orders""")
def ref_commands(spark, sf_dir):
    zero, some = F.lit("0" * 40), F.sha1(F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, "refs/tags/").otherwise("refs/heads/"), k.cast("string"))
    line = F.concat_ws(" ", F.when(k % 3 == 0, zero).otherwise(some), F.when(k % 3 == 1, zero).otherwise(some), name)
    out = transfer.parse_commands(table(spark, sf_dir, "orders").select(line.alias("line")))
    return out.select(F.regexp_extract("ref_name", r"(\d+)$", 1).cast("long").alias("o_orderkey"), "command", "ref_type")


@query("bucket_cull", """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    k AS (SELECT DISTINCT l_returnflag, floor(r.range * n / 64)::BIGINT AS i FROM n, range(64) r) SELECT l_returnflag, l_orderkey, l_linenumber FROM n JOIN k USING (l_returnflag, i)""")
def bucket_cull(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber"))
    return windows.cull_buckets(li, "l_returnflag", "o").select("l_returnflag", "l_orderkey", "l_linenumber")


NEAREST = f"WITH r AS ({RANKED}) SELECT a.doc_id AS target, b.doc_id AS base, strlen(a.text)::BIGINT AS size, true AS same FROM r a JOIN r b ON a.lang = b.lang AND b.rn = a.rn - 1"


@query("delta_roundtrip", NEAREST)
def delta_roundtrip(spark, sf_dir):
    """Line deltas of every text against its nearest candidate, and whether they rebuild the text."""
    return _roundtrip(spark, sf_dir, codecs.encode_lines, codecs.apply_delta)


@query("rabin_roundtrip", NEAREST)
def rabin_roundtrip(spark, sf_dir):
    """Rabin deltas, likewise."""
    return _roundtrip(spark, sf_dir, codecs.encode_rabin, codecs.apply_delta)


@query("zstd_roundtrip", NEAREST)
def zstd_roundtrip(spark, sf_dir):
    """Dictionary deltas, likewise."""
    return _roundtrip(spark, sf_dir, codecs.dictionary_delta, codecs.apply_dictionary_delta)


def _roundtrip(spark, sf_dir, encode, apply):
    same = F.coalesce(codecs.rebuilds_udf(encode, apply)("b", "t"), F.col("t").isNull())
    return _nearest_texts(spark, sf_dir).select("target", "base", F.octet_length("t").cast("long").alias("size"), same.alias("same"))


@query("delta_sizes")
def delta_sizes(spark, sf_dir):
    """Sizes of the three kinds of delta."""
    d = _nearest_texts(spark, sf_dir)
    size = lambda encode: codecs.delta_size_udf(encode)("b", "t")
    return d.select("target", "base", size(codecs.encode_lines).alias("lines"), size(codecs.encode_rabin).alias("rabin"), size(codecs.dictionary_delta).alias("dictionary"))


@query("chain_depths", """
    WITH RECURSIVE e AS (SELECT conv_id, turn FROM conversations) SELECT conv_id::VARCHAR AS pack_id, turn AS "offset", 0::BIGINT AS root, turn AS depth FROM e""")
def chain_depths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    entries = c.select(F.col("conv_id").cast("string").alias("pack_id"), F.col("turn").alias("offset"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("base_offset"))
    return chains.chain_depths(entries).select("pack_id", "offset", "root", F.col("depth").cast("long").alias("depth"))


@query("pack_roundtrip", f"SELECT DISTINCT {OID} AS oid, 'blob' AS obj_type, strlen(text)::BIGINT AS size FROM documents")
def pack_roundtrip(spark, sf_dir):
    """Documents written as delta packs, read again and rebuilt."""
    from ..sources import writers

    blobs = document_blobs(spark, sf_dir)
    folder = fresh_path(spark, "packs")
    writers.write_packs(blobs, folder)
    return chains.load(spark, folder).select("oid", "obj_type", "size")


@query("block_overlap", f"""
    WITH r AS ({RANKED}), h AS (SELECT lang, doc_id, rn, hex(encode(text)) AS x FROM r),
    b AS (SELECT lang, doc_id, rn, list_distinct([substr(x, 32 * i + 1, 32) FOR i IN range(length(x) // 32)]) AS s FROM h)
    SELECT a.doc_id AS target, b.doc_id AS base, floor(len(list_intersect(a.s, b.s)) * 10000 / len(a.s))::BIGINT AS share FROM b a JOIN b ON a.lang = b.lang AND b.rn BETWEEN a.rn - 10 AND a.rn - 1 WHERE len(a.s) > 0""")
def block_overlap(spark, sf_dir):
    sets = table(spark, sf_dir, "documents").select("doc_id", text.block_set("text").alias("s"))
    c = _candidates(spark, sf_dir)
    c = c.join(sets.select(F.col("doc_id").alias("target"), F.col("s").alias("t")), "target").join(sets.select(F.col("doc_id").alias("base"), F.col("s").alias("b")), "base")
    pairs = c.select("target", "base", text.block_overlap("b", "t").alias("share"))
    return pairs.where("share IS NOT NULL").withColumn("share", F.floor(F.col("share") * 10000))


@query("deflate_roundtrip", "SELECT doc_id, strlen(text)::BIGINT AS size, true AS same FROM documents")
def deflate_roundtrip(spark, sf_dir):
    """Texts deflated and inflated, and whether they come back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data")).withColumn("small", codecs.deflate_udf("data"))
    return d.select("doc_id", F.octet_length("data").cast("long").alias("size"), codecs.inflate_udf("small").eqNullSafe(F.col("data")).alias("same"))


def _turn_commits(spark, sf_dir):
    """Commits made of conversation turns."""
    c = table(spark, sf_dir, "conversations")
    who = lambda role: F.struct(F.lit(role).alias("role"), F.col("role").alias("name"), F.lit("turn@example.org").alias("email"), (F.lit(1_700_000_000) + F.col("turn") * 60).cast("long").alias("epoch"), F.lit("+0100").alias("tz"))
    parents = F.when(F.col("turn") > 0, F.array(F.sha1(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))))).otherwise(F.array().cast("array<string>"))
    return c.select(F.sha1(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("tree_oid"), parents.alias("parents"), who("author").alias("author"), who("committer").alias("committer"), F.lit("").alias("extra"), F.col("text").alias("message"))


@query("commit_parse", """
    SELECT sha1(conv_id || '/' || turn) AS tree_oid, CASE WHEN turn > 0 THEN sha1(conv_id || ':' || (turn - 1)) ELSE '' END AS parents, role AS author, 1700000000 + turn * 60 AS epoch, text AS message,
    trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS subject FROM conversations""")
def commit_parse(spark, sf_dir):
    parsed = parse.parse_commits(parse.commit_data(_turn_commits(spark, sf_dir)))
    return parsed.select("tree_oid", F.array_join("parents", ",").alias("parents"), F.col("author.name").alias("author"), F.col("author.epoch").alias("epoch"), "message", parse.subject(F.col("message")).alias("subject"))


@query("tree_parse", f"""
    WITH i AS (SELECT source, doc_id || '.txt' AS name, {OID} AS oid FROM documents)
    SELECT '100644' AS mode, 'blob' AS kind, oid, name, (row_number() OVER (PARTITION BY source ORDER BY name) - 1)::INTEGER AS pos FROM i""")
def tree_parse(spark, sf_dir):
    items = document_blobs(spark, sf_dir).select(F.split_part("file_path", F.lit("/"), F.lit(2)).alias("source"), F.lit("100644").alias("mode"), "oid", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    return parse.parse_trees(parse.tree_data(items, "source")).select("mode", "kind", "oid", "name", "pos")


@query("workflow_events", """
    SELECT event_id::VARCHAR AS object_id, user_id::VARCHAR AS run_id, event_type AS kind, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def workflow_events(spark, sf_dir):
    """Events written as workflow JSON and parsed again; free-form metrics are read as variants."""
    e = table(spark, sf_dir, "events")
    head = [F.col("event_id").cast("string").alias("object_id"), F.lit("run_event").alias("object_type"), F.lit(1).alias("version"), F.struct(F.lit("system").alias("kind"), F.lit("log").alias("id")).alias("created_by")]
    row = F.struct(*head, F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("kind"), F.col("props").alias("metrics"))
    parsed = parse.parse_workflow(e.select(F.to_json(row).cast("binary").alias("data")), "run_event")
    return parsed.select("object_id", "run_id", "kind", F.try_variant_get("metrics", "$.k", "bigint").alias("k"))


@query("event_windows", "SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Hourly counts by a stream over the event log, with a watermark."""
    from ..streaming.ingest import event_counts

    schema = table(spark, sf_dir, "events").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        source = source.parquet(f"{sf_dir}/events.parquet")
    else:
        source = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = source.withColumn("at", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")))
    out, checkpoint = fresh_path(spark, "counts"), fresh_path(spark, "counts-checkpoint")
    # each batch writes the windows it changed; the last state of a window counts
    put = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/b={batch}")
    event_counts(stream, "at", "event_type", "1 hour").writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.schema("start timestamp, end timestamp, event_type string, n long, batch long").parquet(out)
    last = counts.groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n"))
    return last.select("event_type", F.unix_micros("start").alias("start_us"), "n")
