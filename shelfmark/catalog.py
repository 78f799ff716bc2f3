"""The sample tables in the roles of a catalogue: files, libraries, jobs, journals, observations.

Each role is a list of SQL expressions that Spark and other engines read alike, so
the same binding feeds the operators and the SQL they are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import JOB_STATES, OPERATION_STATES, PLAN_STATES


def pick(number: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


NAMES = ("Report ", "notes_", "Budget-", "_draft", "7 items ")
ENDINGS = (".pdf", ".txt", ".MD", ".png", ".docx", ".zip", "", ".json", ".html")
HEADERS = ("504B0304", "255044462D312E37", "89504E470D0A1A0A", "FFD8FFE0", "1F8B08", "526172211A07", "48656C6C6F")

FILES = {
    "id": "'f' || cast(doc_id as string)",
    "library_id": "source",
    "path": "'/' || source || '/' || lang || CASE WHEN doc_id % 11 = 0 THEN '/.cache' ELSE '' END || '/' || "
    f"{pick('doc_id', NAMES)} || cast(doc_id as string) || {pick('doc_id', ENDINGS)}",
    "size": "n_chars",
    "modified_at_ns": "1600000000000000000 + (doc_id % 2000) * 86400000000000 + doc_id",
    "missing_since_ms": "CASE WHEN doc_id % 13 = 0 THEN 1000 + doc_id END",
    "header_hex": pick("doc_id", HEADERS),
    "content": "text",
    "ordinary": "doc_id % 17 <> 0",
}
LIBRARIES = {"id": "cast(r_regionkey as string)", "name": "r_name", "updated_at_ms": "cast(100 - r_regionkey as bigint)"}
ROOTS = {
    "id": "cast(n_nationkey as string)", "library_id": "cast(n_regionkey as string)", "path": "'/' || lower(n_name)",
    "enabled": "n_nationkey % 4 <> 0", "created_at_ms": "cast(n_nationkey as bigint)",
}
CREATED = "1000000 + (o_orderkey * 7919) % 1000003"
_LEASED = "(o_orderkey % 8) IN (1, 2, 4)"
JOBS = {
    "id": "'job' || cast(o_orderkey as string)",
    "kind": "CASE WHEN o_orderkey % 3 = 0 THEN 'snapshot_reconcile' ELSE 'scan' END",
    "status": pick("o_orderkey", JOB_STATES),
    "progress_current": "o_orderkey % 100",
    "progress_total": "CASE WHEN o_orderkey % 5 <> 0 THEN cast(100 as bigint) END",
    "priority": "cast(substr(o_orderpriority, 1, 1) as int) * 10",
    "lease_owner": f"CASE WHEN {_LEASED} THEN 'w' || cast(o_custkey % 5 as string) END",
    "lease_expires_at_ms": f"CASE WHEN {_LEASED} THEN {CREATED} + (o_orderkey % 1000) * 1000 END",
    "created_at_ms": CREATED,
    "updated_at_ms": f"{CREATED} + (o_orderkey % 97) * 60000",
}
OPERATIONS = {
    "id": "'op' || cast(o_orderkey as string)",
    "plan_id": "'plan' || cast(o_orderkey % 50 as string)",
    "status": pick("o_orderkey", OPERATION_STATES),
    "created_at_ms": CREATED,
}
PLANS = {
    "id": "'plan' || cast(c_custkey as string)",
    "library_id": "c_mktsegment",
    "status": pick("c_custkey", PLAN_STATES),
    "created_at_ms": "cast(c_custkey as bigint) * 1000",
    "expires_at_ms": "cast(c_custkey as bigint) * 1000 + 900000",
}
ITEMS = {
    "operation_id": "'op' || cast(l_orderkey as string)",
    "ordinal": "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 as int)",
    "status": "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END",
    "source_path": "'/in/' || cast(l_partkey as string)",
    "target_path": "'/out/' || cast(l_suppkey as string)",
    "source_exists": "l_partkey % 3 <> 0",
    "source_matches": "l_partkey % 3 = 1",
    "target_exists": "l_suppkey % 3 <> 0",
    "target_matches": "l_suppkey % 3 = 1",
}
OBSERVED = {
    "library_id": "'lib'", "platform": "'linux'", "volume_id": "'v1'", "native_file_id": "cast(user_id as string)",
    "generation": "CASE WHEN user_id % 2 = 0 THEN '' END", "new_file_id": "'n' || cast(event_id as string)",
    "path": "'/data/' || event_type || '/' || cast(event_id % 3 as string)", "size": "cast(floor(value) as bigint)",
    "modified_at_ns": "cast(floor(value) as bigint) % 7", "changed_at_ns": "cast(floor(value) as bigint) % 3", "observed_at_ms": "event_id",
}

BINDINGS = {
    "files": ("documents", FILES), "libraries": ("region", LIBRARIES), "roots": ("nation", ROOTS), "jobs": ("orders", JOBS),
    "operations": ("orders", OPERATIONS), "plans": ("customer", PLANS), "items": ("lineitem", ITEMS), "observed": ("events", OBSERVED),
}


def bind(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """A sample table in ``role``."""
    source, columns = BINDINGS[role]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{x} as {n}" for n, x in columns.items()])


def sql(role: str) -> str:
    """The same as a query over the sample table."""
    source, columns = BINDINGS[role]
    return f"SELECT {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {source}"


def with_roles(query: str, *roles: str) -> str:
    return "WITH " + ", ".join(f"{r} AS ({sql(r)})" for r in roles) + " " + query
