"""Explicit schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

_S, _L, _D = StringType(), LongType(), DoubleType()
_NAMES = ArrayType(_S)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


TESTSET = _struct(CVE=_S, functions=_NAMES, binaries=_NAMES, vuln=_NAMES, patch=_NAMES, not_affected=_NAMES)
GROUNDTRUTH = _struct(CVE=_S, vuln=_NAMES, patch=_NAMES, not_affected=_NAMES)
SOURCE_DIFF = _struct(project=_S, cve=_S, commit=_S, analysis=ArrayType(_struct(function=_S, type=_S)))
CVEINFO = _struct(id=_S, cve=_S, upper_cve=_S, summary=_S, cwe=_NAMES)
DIFF_FILE = _struct(path=_S, text=_S)
BLOB = _struct(repo=_S, rev=_S, path=_S, text=_S)
COMMIT = _struct(repo=_S, commit=_S, title=_S, message=_S)
TASK = _struct(run_id=_S, cve=_S, binaries=_NAMES)
ANON_MAP = _struct(cve=_S, ord=IntegerType(), anonymous=_S, original=_S, actual=_S)
VERDICT_RAW = _struct(run_id=_S, cve=_S, returncode=IntegerType(), final_text=_S, stderr=_S)
VERDICT = _struct(cve=_S, binary=_S, status=_S, confidence=_S, evidence=_NAMES, reasoning=_S)
TRACE_EVENT = _struct(run_id=_S, seq=_L, stream=_S, time=_D, line=_S)
SYMBOL = _struct(addr=_L, kind=_S, name=_S, seq=_L)
ASM_LINE = _struct(binary=_S, line_no=_L, text=_S)
AST_NODE = _struct(fn_id=_S, node_id=IntegerType(), parent_id=IntegerType(), last_id=IntegerType(), type=_S, field=_S, start_line=IntegerType(), end_line=IntegerType(), text=_S)
# a profile's api_key_env is a name or a list of names; as a string, a list is its JSON text
MODEL_PROFILE = _struct(provider=_S, base_url=_S, wire_api=_S, model=_S, reasoning=_struct(mode=_S, effort=_S), api_key_env=_S, requires_openai_auth=BooleanType(), codex_provider_name=_S)
MODEL_CONFIG = _struct(active_profile=_S, aliases=MapType(_S, _S), profiles=MapType(_S, MODEL_PROFILE))
#: The keys of a view's configuration, and the columns that they become.
VIEW_KEYS = {
    "default_window": "default_window", "max_window": "max_window", "default_context": "default_context", "max_context": "max_context", "default_max_output_bytes": "default_max_output", "min_max_output_bytes": "min_max_output", "max_output_bytes": "max_max_output",
}

#: What a verdict may say, and what the result schema offers the judge.
STATUSES = ("present", "absent", "not_affected", "inconclusive", "not_found", "error")
JUDGED = tuple(s for s in STATUSES if s != "error")
CONFIDENCES = ("high", "medium", "low")
