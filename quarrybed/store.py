"""A store of objects and refs on shared tables, with hooks for authentication, object types and what follows a push."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import parse
from .operators.graph import full_set, incremental_set
from .operators.parse import commit_parents
from .plans import transfer

Allow = Callable[[dict, str], bool]


class Store:
    """Objects (oid, obj_type, size, data, and any further columns) and refs (name, oid) below a folder.

    ``authenticate`` takes a request's credentials and the action (advertise, fetch, push);
    without it all are let in. ``after_push`` is called with each push that changed a ref.
    ``parsers`` adds object types: a type's parser makes a table of its objects. Objects are
    only added; refs are written as a new version, so a failed write leaves the last one.
    """

    OBJECTS, REFS = "oid string, obj_type string, size long, data binary", "name string, oid string"

    def __init__(self, spark: SparkSession, folder: str, hash_kind: str = "sha1", authenticate: Allow | None = None, after_push: Callable[[transfer.Push], None] | None = None, parsers: dict | None = None):
        self.spark, self.folder, self.hash_kind = spark, folder.rstrip("/"), hash_kind
        self.authenticate, self.after_push = authenticate, after_push
        self.parsers = {"commit": parse.parse_commits, "tree": lambda o: parse.parse_trees(o, hash_kind), "tag": parse.parse_tags} | (parsers or {})

    def _parts(self, name: str) -> list[int]:
        """Numbers of a table's finished parts."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(p.getName()[1:]) for p in found if fs.exists(sc._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{max(self._parts(name), default=-1) + 1}")

    def objects(self) -> DataFrame:
        parts = self._parts("objects")
        if not parts:
            return self.spark.createDataFrame([], self.OBJECTS)
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/objects/v{k}" for k in parts])

    def refs(self) -> DataFrame:
        parts = self._parts("refs")
        return self.spark.read.schema(self.REFS).parquet(f"{self.folder}/refs/v{parts[-1]}") if parts else self.spark.createDataFrame([], self.REFS)

    def has(self, ids: DataFrame) -> DataFrame:
        """Of the ids (oid) those that are here."""
        return ids.join(self.objects().select("oid"), "oid", "left_semi")

    def get(self, ids: DataFrame) -> DataFrame:
        return self.objects().join(ids.select("oid").distinct(), "oid", "left_semi")

    def put(self, objects: DataFrame) -> int:
        """Add objects that aren't here yet; their ids are computed anew. Returns how many were added."""
        from .functions.identity import object_id
        from .storage import written

        sized = objects.withColumn("oid", object_id(F.col("obj_type"), "data", self.hash_kind)).withColumn("size", F.octet_length("data").cast("long"))
        new = written(sized.dropDuplicates(["oid"]).join(self.objects().select("oid"), "oid", "left_anti"), "put")
        n = new.count()
        if n:
            self._add("objects", new)
        return n

    def update(self, commands: DataFrame) -> DataFrame:
        """Apply ref commands (see ``transfer.parse_commands``); returns them with their status."""
        from .storage import written

        after, judged = transfer.apply_commands(self.refs(), commands, self.objects().select("oid"))
        judged = written(judged, "judged")
        self._add("refs", after)
        return judged

    def table(self, kind: str) -> DataFrame:
        """The objects of a type as its parser's table; types without one are kept and not parsed."""
        if kind not in self.parsers:
            raise ValueError(f"no parser for {kind}")
        return self.parsers[kind](self.objects().where(F.col("obj_type") == kind))

    def default_branch(self) -> str | None:
        head = transfer.head_ref(self.refs()).first()
        return head["name"] if head else None

    def _let_in(self, who: dict | None, action: str) -> None:
        if self.authenticate and not self.authenticate(who or {}, action):
            raise PermissionError(f"{action} is not allowed")

    def advertise(self, service: str, who: dict | None = None) -> bytes:
        self._let_in(who, "advertise")
        return transfer.advertise(self.refs(), service, id_hex=40 if self.hash_kind == "sha1" else 64)

    def fetch(self, request: bytes, who: dict | None = None) -> tuple[DataFrame, list[str]]:
        """(objects to send, common ids) for a fetch request."""
        self._let_in(who, "fetch")
        commits, items = self.table("commit"), self.table("tree")
        need, common = transfer.fetch(self.spark, transfer.parse_fetch(request), commits, commit_parents(commits), items)
        return self.get(need.select("oid")), common

    def pack_for(self, want: DataFrame, have: DataFrame | None, folder: str) -> str:
        """Write the pack of what ``want`` (node) needs beyond ``have`` below a folder; returns its name."""
        from .sources.writers import write_pack

        commits, items = self.table("commit"), self.table("tree")
        sets = (commits, commit_parents(commits), items)
        need = full_set(want, *sets) if have is None else incremental_set(want, have, *sets)
        return write_pack(self.get(need.select("oid")), folder, hash_kind=self.hash_kind)

    def push(self, request: bytes, who: dict | None = None) -> transfer.Push:
        """Take a push: objects first, then refs; the report is ready to send."""
        self._let_in(who, "push")
        push = transfer.receive(self.spark, request, self.refs(), self.objects().select("oid", "obj_type", "data"), self.hash_kind)
        if push.new.limit(1).count():
            self._add("objects", push.new.select("oid", "obj_type", "size", "data"))
        self._add("refs", push.refs)
        if self.after_push and push.judged.where("status = 'success'").limit(1).count():
            self.after_push(push)
        return push
