"""Parsers and serialisers of objects: commits, trees, tags, notes, signatures and workflow JSON."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import object_id
from ..functions.labels import mode_kind
from ..sources import formats


def signature(line: Column, role: str) -> Column:
    """Struct of a signature: ``name <email> seconds zone``."""
    pattern = r"^(?:author |committer |tagger )?(.*?) ?<([^>]*)> (-?\d+) ([+-]\d{4})$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    epoch = part(3).try_cast("long")
    return F.struct(F.lit(role).alias("role"), part(1).alias("name"), part(2).alias("email"), epoch.alias("epoch"), part(4).alias("tz"), F.timestamp_seconds(epoch).alias("ts"))


def signature_text(sig: Column) -> Column:
    return F.concat(sig["role"], F.lit(" "), sig["name"], F.lit(" <"), sig["email"], F.lit("> "), sig["epoch"].cast("string"), F.lit(" "), sig["tz"])


def _head(text: Column) -> Column:
    return F.split_part(text, F.lit("\n\n"), F.lit(1))


def _line(head: Column, key: str) -> Column:
    return F.regexp_extract(head, rf"(?m)^{key} (.*)$", 1)


def _message(text: Column) -> Column:
    at = F.instr(text, "\n\n")
    return F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(F.lit(""))


def parse_commits(objects: DataFrame) -> DataFrame:
    """oid, tree_oid, parents, author, committer, extra (other header lines), message. Lines are anchored, so words in the message don't count."""
    text = F.decode("data", "UTF-8")
    head = _head(text)
    extra = F.filter(F.split(head, "\n"), lambda x: ~x.rlike("^(tree|parent|author|committer) "))
    return objects.where("obj_type = 'commit'").select(
        "oid", _line(head, "tree").alias("tree_oid"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), 1).alias("parents"),
        signature(_line(head, "author"), "author").alias("author"), signature(_line(head, "committer"), "committer").alias("committer"),
        F.array_join(extra, "\n").alias("extra"), _message(text).alias("message"),
    )


def commit_parents(commits: DataFrame) -> DataFrame:
    return commits.select("oid", F.posexplode("parents").alias("pos", "parent"))


def commit_data(commits: DataFrame) -> DataFrame:
    """oid (computed) and data of commit rows."""
    lines = F.concat(F.array(F.concat(F.lit("tree "), "tree_oid")), F.transform("parents", lambda p: F.concat(F.lit("parent "), p)), F.array(signature_text(F.col("author")), signature_text(F.col("committer"))))
    extra = F.when(F.coalesce("extra", F.lit("")) != "", F.concat(F.lit("\n"), "extra")).otherwise(F.lit(""))
    data = F.concat(F.array_join(lines, "\n"), extra, F.lit("\n\n"), "message").cast("binary")
    return commits.select(object_id("commit", data).alias("oid"), F.lit("commit").alias("obj_type"), data.alias("data"))


def subject(message: Column) -> Column:
    """First line that isn't blank, after a signature block if there is one."""
    after = F.when(message.contains("-----END PGP SIGNATURE-----"), F.split_part(message, F.lit("-----END PGP SIGNATURE-----"), F.lit(2))).otherwise(message)
    return F.trim(F.element_at(F.filter(F.split(after, "\n"), lambda x: F.trim(x) != ""), 1))


def parse_trees(objects: DataFrame, hash_kind: str = "sha1") -> DataFrame:
    """tree_oid, pos, mode, kind, oid, name of tree items."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for oid, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for pos, (mode, item, name) in enumerate(formats.parse_tree(data, hash_kind)):
                    for column, value in zip(out, (oid, pos, mode, item, name)):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["tree_oid", "pos", "mode", "oid", "name"])

    items = objects.where("obj_type = 'tree'").select("oid", "data").mapInArrow(run, "tree_oid string, pos int, mode string, oid string, name string")
    return items.select("tree_oid", "pos", "mode", mode_kind(F.col("mode")).alias("kind"), "oid", "name")


def tree_data(items: DataFrame, by: str = "tree_key") -> DataFrame:
    """oid, data of trees, from items (mode, oid, name) grouped by a key; items are sorted as trees are."""
    name = F.concat(F.col("name").cast("binary"), F.when(F.ltrim(F.col("mode"), F.lit("0")) == "40000", F.lit("/")).otherwise(F.lit("")).cast("binary"))
    piece = F.concat(F.concat_ws(" ", "mode", "name").cast("binary"), F.unhex(F.lit("00")), F.unhex("oid"))
    rows = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.hex(name).alias("k"), piece.alias("p")))).alias("items"))
    data = F.aggregate("items", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["p"]))
    return rows.select(by, data.alias("data")).select(by, object_id("tree", "data").alias("oid"), F.lit("tree").alias("obj_type"), "data")


def parse_tags(objects: DataFrame) -> DataFrame:
    """oid, target_oid, target_type, tag_name, tagger, message."""
    text = F.decode("data", "UTF-8")
    head = _head(text)
    return objects.where("obj_type = 'tag'").select("oid", _line(head, "object").alias("target_oid"), _line(head, "type").alias("target_type"), _line(head, "tag").alias("tag_name"), signature(_line(head, "tagger"), "tagger").alias("tagger"), _message(text).alias("message"))


def tag_data(tags: DataFrame) -> DataFrame:
    head = F.concat(F.lit("object "), "target_oid", F.lit("\ntype "), "target_type", F.lit("\ntag "), "tag_name", F.lit("\n"), signature_text(F.col("tagger")))
    data = F.concat(head, F.lit("\n\n"), "message").cast("binary")
    return tags.select(object_id("tag", data).alias("oid"), F.lit("tag").alias("obj_type"), data.alias("data"))


def notes(rows: DataFrame) -> DataFrame:
    """oid, target_oid, content, size of notes: a note is a blob about another object."""
    data = F.col("content").cast("binary")
    return rows.select(object_id("blob", data).alias("oid"), "target_oid", "content", F.octet_length(data).alias("size"))


def blobs(rows: DataFrame, content: str, hash_kind: str = "sha1") -> DataFrame:
    """Objects (oid, obj_type, size, data) of contents."""
    data = F.col(content).cast("binary")
    return rows.select(object_id("blob", data, hash_kind).alias("oid"), F.lit("blob").alias("obj_type"), F.octet_length(data).cast("long").alias("size"), data.alias("data"))


def index_rows(entries: DataFrame) -> DataFrame:
    """Rows of a pack index; every entry needs an offset; a missing crc32 is that of the packed bytes."""
    place = F.coalesce("offset", F.raise_error(F.lit("an entry without an offset")).cast("long"))
    return entries.select("oid", F.coalesce("crc32", F.crc32("entry")).alias("crc32"), place.alias("offset"))


def parse_workflow(objects: DataFrame, kind: str) -> DataFrame:
    """Rows of one workflow type from JSON (column data), typed by its schema; free-form fields become variants.

    Rows of other types are left out; unknown header fields, a zero version or empty actor
    are reported in ``problem``.
    """
    from ..schemas import HEADER, VARIANT_FIELDS, WORKFLOW

    text = F.col("data").cast("string")
    parsed = F.from_json(text, f"{HEADER}, {WORKFLOW[kind]}")
    names = F.json_object_keys(text)
    allowed = [x.strip().split(" ")[0] for x in _top(f"{HEADER}, {WORKFLOW[kind]}")]
    rows = objects.select(parsed.alias("r"), names.alias("names")).where(F.col("r.object_type") == kind)
    unknown = F.filter("names", lambda x: ~x.isin(*allowed))
    problem = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ","))).otherwise(header_problem(F.col("r")))
    out = rows.select("r.*", problem.alias("problem"))
    for c in VARIANT_FIELDS.get(kind, ()):
        out = out.withColumn(c, F.try_parse_json(c))
    return out


def environment() -> Column:
    """The driver's system, machine and working directory, as a map."""
    import os
    import platform

    return F.create_map(*[F.lit(x) for pair in (("os", platform.system().lower()), ("arch", platform.machine()), ("cwd", os.getcwd())) for x in pair])


def header_problem(row: Column) -> Column:
    """What is wrong with a workflow header: an empty actor or a zero version; null for none."""
    by = row["created_by"]
    return F.when(row["version"] == 0, "version 0").when(F.coalesce(by["kind"], F.lit("")) == "", "empty actor kind").when(F.coalesce(by["id"], F.lit("")) == "", "empty actor")


def _top(ddl: str) -> list[str]:
    """Fields of a schema string at its top level."""
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def workflow_json(rows: DataFrame) -> Column:
    """JSON of workflow rows, without nulls."""
    return F.to_json(F.struct(*[c for c in rows.columns if c != "problem"]))
