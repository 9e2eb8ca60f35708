"""Schemas of the workflow tables: a header that all share, and the fields of each type."""

HEADER = "object_id string, object_type string, version int, created_at timestamp, created_by struct<kind:string,id:string,display_name:string>"
_REF = "struct<store:string,key:string>"
WORKFLOW = {
    "intent": "parents array<string>, prompt string, spec string, analysis_context_frames array<string>",
    "plan": "intent string, parents array<string>, context_frames array<string>, steps array<struct<step_id:string,description:string,inputs:string,checks:string>>",
    "task": "title string, description string, goal string, constraints array<string>, acceptance_criteria array<string>, requester struct<kind:string,id:string,display_name:string>, parent string, intent string, origin_step_id string, dependencies array<string>",
    "run": "task string, plan string, commit string, snapshot string, environment map<string,string>",
    "patch_set": f"run string, sequence long, commit string, format string, artifact {_REF}, touched array<struct<path:string,change_type:string,lines_added:long,lines_deleted:long>>, rationale string",
    "context_snapshot": "selection_strategy string, items array<struct<kind:string,path:string,preview:string,blob:string>>, summary string",
    "provenance": "run_id string, provider string, model string, parameters string, temperature double, max_tokens long",
    "intent_event": "intent_id string, kind string, reason string, result_commit string, next_intent_id string",
    "task_event": "task_id string, kind string, reason string, run_id string",
    "run_event": "run_id string, kind string, reason string, error string, metrics string, patchset_id string",
    "plan_step_event": "plan_id string, step_id string, run_id string, status string, reason string, consumed_frames array<string>, produced_frames array<string>, spawned_task_id string, outputs string",
    "run_usage": "run_id string, input_tokens long, output_tokens long, total_tokens long, cost_usd double",
    "tool_invocation": f"run_id string, tool_name string, io_footprint struct<paths_read:array<string>,paths_written:array<string>>, args string, status string, result_summary string, artifacts array<{_REF}>",
    "evidence": f"run_id string, patchset_id string, kind string, tool string, command string, exit_code int, summary string, report_artifacts array<{_REF}>",
    "decision": "run_id string, decision_type string, chosen_patchset_id string, result_commit_sha string, checkpoint_id string, rationale string",
    "context_frame": "intent_id string, run_id string, plan_id string, step_id string, kind string, summary string, data string, token_estimate long",
}
VARIANT_FIELDS = {"intent": ("spec",), "run_event": ("metrics",), "tool_invocation": ("args",), "context_frame": ("data",), "provenance": ("parameters",), "plan_step_event": ("outputs",)}
#: (child table, column, parent): edges of the workflow graph. A column may be an array of ids; a parent is a table's object_id or a nested column of it.
FOREIGN_KEYS = (
    ("plan", "intent", "intent"), ("task", "intent", "intent"), ("task", "parent", "task"), ("run", "task", "task"), ("run", "plan", "plan"),
    ("run", "snapshot", "context_snapshot"), ("patch_set", "run", "run"), ("provenance", "run_id", "run"), ("intent_event", "intent_id", "intent"),
    ("intent_event", "next_intent_id", "intent"), ("task_event", "task_id", "task"), ("task_event", "run_id", "run"), ("run_event", "run_id", "run"),
    ("run_event", "patchset_id", "patch_set"), ("plan_step_event", "plan_id", "plan"), ("plan_step_event", "run_id", "run"),
    ("plan_step_event", "spawned_task_id", "task"), ("run_usage", "run_id", "run"), ("tool_invocation", "run_id", "run"), ("evidence", "run_id", "run"),
    ("evidence", "patchset_id", "patch_set"), ("decision", "run_id", "run"), ("decision", "chosen_patchset_id", "patch_set"),
    ("context_frame", "intent_id", "intent"), ("context_frame", "run_id", "run"), ("context_frame", "plan_id", "plan"),
    ("intent", "parents", "intent"), ("intent", "analysis_context_frames", "context_frame"), ("plan", "parents", "plan"), ("plan", "context_frames", "context_frame"),
    ("task", "dependencies", "task"), ("task", "origin_step_id", "plan.steps.step_id"), ("plan_step_event", "step_id", "plan.steps.step_id"), ("context_frame", "step_id", "plan.steps.step_id"),
)
