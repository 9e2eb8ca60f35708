"""Codes, flags and enumerated labels as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

PACK_CODES = {"commit": 1, "tree": 2, "blob": 3, "tag": 4, "zstd_delta": 5, "offset_delta": 6, "ref_delta": 7}
BASE_TYPES = ("commit", "tree", "blob", "tag")
#: Labels in a JSON header, and the plain names of the same types.
WORKFLOW_TYPES = {
    "context_snapshot": "snapshot", "decision": "decision", "evidence": "evidence", "patch_set": "patchset", "plan": "plan",
    "provenance": "provenance", "run": "run", "task": "task", "intent": "intent", "tool_invocation": "invocation",
    "context_frame": "context_frame", "intent_event": "intent_event", "task_event": "task_event", "run_event": "run_event",
    "plan_step_event": "plan_step_event", "run_usage": "run_usage",
}
MODES = {"100644": "blob", "100664": "blob", "100640": "blob", "100755": "executable", "40000": "tree", "040000": "tree", "160000": "commit", "120000": "link"}
MODE_OF = {"blob": "100644", "executable": "100755", "tree": "40000", "commit": "160000", "link": "120000"}
DOMAINS = {
    "actor": ("human", "agent", "system", "mcp_client"),
    "signature": ("author", "committer", "tagger"),
    "goal": ("feature", "bugfix", "refactor", "docs", "perf", "test", "chore", "build", "ci", "style", "other"),
    "task_event": ("created", "running", "blocked", "done", "failed", "cancelled"),
    "run_event": ("created", "patching", "validating", "completed", "failed", "checkpointed"),
    "intent_event": ("analyzed", "completed", "cancelled"),
    "step_status": ("pending", "progressing", "completed", "failed", "skipped"),
    "tool_status": ("ok", "error"),
    "evidence": ("test", "lint", "build"),
    "decision": ("commit", "checkpoint", "abandon", "retry", "rollback"),
    "frame": ("intent_analysis", "step_summary", "code_change", "system_state", "error_recovery", "checkpoint", "tool_call", "other"),
    "change": ("add", "modify", "delete", "rename", "copy"),
    "ref_command": ("create", "update", "delete"),
}
#: Domains that take any other string too.
OPEN = ("actor", "intent_event", "evidence", "decision")


def _lookup(table: dict, column: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), column)


def pack_code(kind: Column) -> Column:
    """Three-bit code of a type in a pack; null for types that packs can't hold."""
    return _lookup(PACK_CODES, kind)


def pack_type(code: Column) -> Column:
    return _lookup({v: k for k, v in PACK_CODES.items()}, code)


def is_base(kind: Column) -> Column:
    return kind.isin(*BASE_TYPES)


def is_workflow(kind: Column) -> Column:
    return kind.isin(*WORKFLOW_TYPES, *WORKFLOW_TYPES.values())


def plain_type(header_label: Column) -> Column:
    """The plain name of a type label as JSON headers have it."""
    return F.coalesce(_lookup(WORKFLOW_TYPES, header_label), header_label)


def mode_kind(mode: Column) -> Column:
    """Kind of a tree item by its mode, in any of the seven spellings."""
    return _lookup(MODES, mode)


def kind_mode(kind: Column) -> Column:
    return _lookup(MODE_OF, kind)


def in_domain(domain: str, value: Column) -> Column:
    """Whether a label is allowed; open domains take any that isn't empty."""
    return (F.length(value) > 0) if domain in OPEN else value.isin(*DOMAINS[domain])


def open_label(value: Column) -> Column:
    """A label that may be stored as a string or as {"other": label}."""
    return F.coalesce(F.get_json_object(value, "$.other"), F.regexp_replace(value, '^"|"$', ""))


def index_flags(flags: Column) -> Column:
    """Fields of the 16 flag bits of a staging index entry."""
    bit = lambda k: F.shiftright(flags, k).bitwiseAND(F.lit(1)) == 1
    return F.struct(bit(15).alias("assume_valid"), bit(14).alias("extended"), F.shiftright(flags, 12).bitwiseAND(F.lit(3)).alias("stage"), flags.bitwiseAND(F.lit(0xFFF)).alias("name_length"))


def index_flag_bits(assume_valid: Column, extended: Column, stage: Column, name_length: Column) -> Column:
    one = lambda c, k: F.shiftleft(c.cast("int"), k)
    return one(assume_valid, 15).bitwiseOR(one(extended, 14)).bitwiseOR(one(stage, 12)).bitwiseOR(F.least(name_length, F.lit(0xFFF)).cast("int"))


def content_type(service: Column, advertisement: bool = False) -> Column:
    return F.concat(F.lit("application/x-git-"), service, F.lit("-pack-advertisement" if advertisement else "-pack-result"))


def is_service_request(path: Column) -> Column:
    return F.endswith(path, F.lit("/info/refs")) | F.endswith(path, F.lit("/git-upload-pack")) | F.endswith(path, F.lit("/git-receive-pack"))


#: Names of the transfer capabilities, plain ones and those that take a value.
CAPABILITIES = (
    "multi_ack", "multi_ack_detailed", "no-done", "side-band", "side-band-64k", "report-status", "report-status-v2", "ofs-delta",
    "deepen-since", "deepen-not", "deepen-relative", "thin-pack", "shallow", "include-tag", "delete-refs", "quiet", "atomic",
    "no-thin", "no-progress", "allow-tip-sha1-in-want", "allow-reachable-sha1-in-want", "push-options",
)
VALUED_CAPABILITIES = ("agent", "session-id", "push-cert", "object-format", "filter", "symref")


def capabilities(text: Column) -> Column:
    """Space-separated capabilities in their order, as structs: name, value (empty where there is none), known. Names may repeat."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    def one(x: Column) -> Column:
        name, value = F.split_part(x, F.lit("="), F.lit(1)), F.regexp_extract(x, "=(.*)$", 1)
        known = F.when(F.contains(x, F.lit("=")), name.isin(*VALUED_CAPABILITIES)).otherwise(name.isin(*CAPABILITIES))
        return F.struct(name.alias("name"), value.alias("value"), known.alias("known"))

    return F.transform(parts, one)


def capability_text(parsed: Column) -> Column:
    """Capabilities as they are sent."""
    return F.array_join(F.transform(parsed, lambda c: F.when(c["value"] != "", F.concat(c["name"], F.lit("="), c["value"])).otherwise(c["name"])), " ")


def ref_kind(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("refs/tags/")), "tag").otherwise("branch")


def ref_command_kind(old_oid: Column, new_oid: Column) -> Column:
    none = "^0+$"
    return F.when(old_oid.rlike(none), "create").when(new_oid.rlike(none), "delete").otherwise("update")


def varint_length(size: Column, first_bits: int = 7) -> Column:
    """Bytes that a number takes when the first byte holds ``first_bits`` bits and the others seven."""
    bits = F.when(size <= 0, 1).otherwise(F.length(F.bin(size)))
    return (1 + F.ceil(F.greatest(bits - first_bits, F.lit(0)) / 7)).cast("int")


def offset_varint_length(distance: Column) -> Column:
    """Bytes of the biased big-endian form: each longer form starts where the shorter ends."""
    out, start = F.lit(1), 128
    for n in range(2, 10):
        out = F.when(distance >= start, n).otherwise(out)
        start += 128**n
    return out.cast("int")
