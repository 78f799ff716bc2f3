"""Named queries over the sample tables, each with SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import bind, with_roles
from .functions import names, paths
from .operators import classify, duplicates, index, journal, query, ranks, reconcile, rules, search, similarity
from .plans import organize
from .sources import content, directory, events, sinks
from .sources.written import new_path
from .streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: SQL over the roles, as it was registered.
PLAIN: dict[str, str] = {}
NOW_MS = 1_400_000
NOW_NS = 1_700_000_000_000_000_000

NAME = "regexp_extract(path, '[^/]*$')"
EXT = rf"lower(regexp_extract({NAME}, '^.+\.([^.]*)$', 1))"
ACTIVE = "missing_since_ms IS NULL"


def register(name: str, roles: str = "", sql: str = ""):
    """Record a query on bound roles (by space), and its SQL over views of their names."""
    names = roles.split()

    def add(make):
        QUERIES[name] = lambda spark, sf_dir: make(*[bind(spark, sf_dir, r) for r in names])
        if sql:
            PLAIN[name] = sql
            SQL[name] = with_roles(sql, *names)
        return make

    return add


# Projections


@register("prj1_file_view", "files", f"SELECT id, CASE WHEN {NAME} = '' THEN path ELSE {NAME} END AS name, path, size, modified_at_ns FROM files")
def _(files):
    return query.file_view(files)


@register("prj2_path_parts", "files", rf"""SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, {EXT} AS ext,
  CASE WHEN regexp_matches({NAME}, '^.+\.[^.]*$') THEN regexp_extract({NAME}, '^(.+)\.[^.]*$', 1) ELSE {NAME} END AS stem FROM files""")
def _(files):
    p = F.col("path")
    return files.select("id", paths.parent(p).alias("parent"), paths.extension(p).alias("ext"), paths.stem(p).alias("stem"))


GROUPS_SQL = """SELECT sha256(content) AS content_hash, size, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths, min(path) AS suggested_keep,
  cast(size * (count(*) - 1) AS BIGINT) AS potential_savings FROM files {where} GROUP BY sha256(content), size HAVING count(*) > 1"""


@register("anl1_exact_duplicates", "files", GROUPS_SQL.format(where=""))
def exact_duplicates(files):
    return duplicates.groups(files).withColumn("paths", F.array_join("paths", "|"))


@register("agg4_duplicate_groups", "files", GROUPS_SQL.format(where=f"WHERE {ACTIVE}"))
def _(files):
    return duplicates.groups(query.scoped(files)).withColumn("paths", F.array_join("paths", "|"))


MEMBERS_SQL = """SELECT content_hash, size, path, path = first AS keep FROM (SELECT sha256(content) AS content_hash, size, path,
  count(*) OVER w AS n, min(path) OVER w AS first FROM files {where} WINDOW w AS (PARTITION BY sha256(content), size)) WHERE n > 1"""


@register("anl1_duplicate_members", "files", MEMBERS_SQL.format(where=""))
def _(files):
    return duplicates.members(files)


@register("agg4_group_members", "files", MEMBERS_SQL.format(where=f"WHERE {ACTIVE}"))
def _(files):
    return duplicates.members(query.scoped(files))


@register("agg4_empty_files", "files", f"""{MEMBERS_SQL.format(where="WHERE true")}""".replace("FROM files WHERE true", "FROM (SELECT path, CASE WHEN size % 3 = 0 THEN '' ELSE content END AS content, CASE WHEN size % 3 = 0 THEN 0 ELSE size END AS size FROM files)"))
def _(files):
    """A third of the files are empty here, and form one group."""
    empty = F.col("size") % 3 == 0
    rows = files.select("path", F.when(empty, "").otherwise(F.col("content")).alias("content"), F.when(empty, 0).otherwise(F.col("size")).alias("size"))
    return duplicates.members(rows)


@register("prj3_duplicate_view", "files", f"SELECT content_hash, size, potential_savings, suggested_keep FROM ({GROUPS_SQL.format(where='')})")
def _(files):
    return duplicates.classes(files).select("content_hash", "size", "potential_savings", "suggested_keep")


@register("prj4_record_id", "observed", """SELECT DISTINCT new_file_id,
  'file_' || sha256(library_id || chr(0) || platform || chr(0) || volume_id || chr(0) || native_file_id || chr(0) || coalesce(generation, '') || chr(0)) AS record_id FROM observed""")
def _(observed):
    return observed.select("new_file_id", paths.record_id(*map(F.col, reconcile.KEY)).alias("record_id"))


@register("prj5_move_view", "items", "SELECT operation_id, ordinal, regexp_extract(target_path, '^(.*)/[^/]*$', 1) AS category, source_path, target_path FROM items")
def _(items):
    return items.select("operation_id", "ordinal", paths.parent(F.col("target_path")).alias("category"), "source_path", "target_path")


def _in(known) -> str:
    return "(" + ", ".join(f"'{x}'" for x in known) + ")"


MAGIC_SQL = "header_hex LIKE '504B0304%'"
CLASS_CASES = [
    (f"{MAGIC_SQL} AND {EXT} IN {_in(classify.OFFICE_DOCUMENTS)}", "document", 0.96, "container_format"),
    (f"{MAGIC_SQL} AND {EXT} IN {_in(classify.OFFICE_DATA)}", "data", 0.96, "container_format"),
    ("header_hex LIKE '255044462D%'", "document", 0.99, "magic_bytes"),
    ("header_hex LIKE '89504E470D0A1A0A%' OR header_hex LIKE 'FFD8FF%'", "image", 0.99, "magic_bytes"),
    (f"{MAGIC_SQL} OR header_hex LIKE '1F8B%'", "archive", 0.99, "magic_bytes"),
    *[(f"{EXT} IN {_in(known)}", category, 0.82, "extension") for category, known in classify.BY_EXTENSION.items()],
]


def _case(column: int, otherwise: str) -> str:
    shown = lambda v: f"'{v}'" if isinstance(v, str) else f"cast({v} as double)"
    return "CASE " + " ".join(f"WHEN {c[0]} THEN {shown(c[column])}" for c in CLASS_CASES) + f" ELSE {otherwise} END"


CATEGORY_SQL = _case(1, "'other'")


@register("anl5_classify_file", "files", f"SELECT id, {CATEGORY_SQL} AS category, {_case(2, 'cast(0.2 as double)')} AS confidence, {_case(3, chr(39) + 'extension' + chr(39))} AS reason FROM files")
def _(files):
    return files.withColumn("c", classify.classify(F.col("path"), F.unhex("header_hex"))).select("id", "c.*")


LABEL_SQL = "CASE ({x}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.LABELS.items()) + " END"


@register("prj6_category_label", "files", f"SELECT label, count(*) AS n FROM (SELECT {LABEL_SQL.format(x=CATEGORY_SQL)} AS label FROM files) GROUP BY label")
def _(files):
    told = classify.label(classify.classify(F.col("path"), F.unhex("header_hex"))["category"])
    return files.groupBy(told.alias("label")).agg(F.count(F.lit(1)).alias("n"))


GROUP_SQL = "CASE " + " ".join(f"WHEN {EXT} IN {_in(known)} THEN '{label}'" for t in (classify.GROUPS, classify.MEDIA_TYPES) for label, known in t.items()) + f" ELSE '{classify.OTHER_GROUP}' END"
INITIAL_SQL = f"CASE WHEN regexp_matches(substr(upper(ltrim({NAME})), 1, 1), '^[A-Z]$') THEN substr(upper(ltrim({NAME})), 1, 1) ELSE '其他' END"


@register("anl6_legacy_classify", "files", f"""SELECT id, {GROUP_SQL} AS by_type, {INITIAL_SQL} AS by_name,
  strftime(make_timestamp((modified_at_ns // 1000000000) * 1000000), '%Y-%m') AS by_date FROM files""")
def _(files):
    p, m = F.col("path"), F.col("modified_at_ns")
    return files.select("id", *[classify.group_by_rule(p, m, r).alias(f"by_{r}") for r in ("type", "name", "date")])


ALLOWED_SQL = "CASE " + " ".join(f"WHEN header_hex LIKE '{digits}%' THEN '{'|'.join(known)}'" for digits, known in classify.MAGIC) + " ELSE '' END"


@register("anl10_magic_detection", "files", f"SELECT id, {ALLOWED_SQL} AS allowed FROM files")
def _(files):
    return files.select("id", F.array_join(classify.allowed_extensions(F.unhex("header_hex")), "|").alias("allowed"))


@register("flt13_suspicious", "files", f"SELECT id, path FROM files WHERE {ALLOWED_SQL} <> '' AND NOT list_contains(string_split({ALLOWED_SQL}, '|'), {EXT})")
def _(files):
    return files.where(classify.suspicious(F.col("path"), F.unhex("header_hex"))).select("id", "path")


# Filters


@register("flt1_active_files", "files", f"SELECT id, path FROM files WHERE {ACTIVE}")
def _(files):
    return query.scoped(files).select("id", "path")


@register("flt2_library_scope", "files", f"SELECT id, path FROM files WHERE {ACTIVE} AND library_id = 'src3'")
def _(files):
    return query.scoped(files, "src3").select("id", "path")


@register("flt3_extension", "files", "SELECT id, path FROM files WHERE lower(path) LIKE '%.md'")
def _(files):
    return files.where(paths.has_extension(F.col("path"), "md")).select("id", "path")


@register("flt4_size_range", "files", "SELECT id, size FROM files WHERE size >= 1025 AND size <= 4096")
def _(files):
    low, high = query.parse_size(">1KB")[0], query.parse_size("<=4kb")[1]
    spec = query.SearchSpec("", None, low, high)
    return files.where(query.filters(spec)[0] & query.filters(spec)[1]).select("id", "size")


@register("flt5_keyset_predicate", "files", f"SELECT id, path FROM files WHERE {ACTIVE} AND library_id = 'src3' AND (path > '/src3/en/n' OR (path = '/src3/en/n' AND id > 'f1')) ORDER BY path, id LIMIT 500")
def _(files):
    return query.page(files, "src3", 9999, ("/src3/en/n", "f1"))[0].select("id", "path")


@register("flt6_directory_prefix", "files", "SELECT id, path FROM files WHERE path = '/src1/en' OR starts_with(path, '/src1/en/')")
def _(files):
    return query.under(files, "/src1/en").select("id", "path")


@register("flt7_status_list", "operations", f"SELECT id, status FROM operations WHERE status NOT IN {_in(journal.TERMINAL_STATES)}")
def _(operations):
    return journal.recovery_queue(operations).select("id", "status")


@register("flt8_lease_validity", "jobs", f"SELECT id, lease_expires_at_ms < {NOW_MS} AS expired FROM jobs WHERE lease_expires_at_ms IS NOT NULL")
def _(jobs):
    return jobs.where("lease_expires_at_ms is not null").select("id", journal.expired_lease(NOW_MS).alias("expired"))


@register("flt12_hidden", "files", "SELECT id, path FROM files WHERE regexp_matches(path, '/\\.')")
def _(files):
    return files.where(paths.hidden(F.col("path"))).select("id", "path")


@register("flt14_empty_files", "files", "SELECT id FROM files WHERE size = 0")
def _(files):
    return files.where("size = 0").select("id")


@register("flt15_authorised_path", "files", "SELECT id FROM files WHERE ordinary AND starts_with(path, '/src2/')")
def _(files):
    return files.where(F.col("ordinary") & paths.within(F.col("path"), "/src2")).select("id")


FOLDER = r"regexp_extract(path, '^(.*)/[^/]*$', 1)"
DENIED = ("/src4", "/src5/en")


@register("flt16_protected_directories", "files", f"""SELECT DISTINCT folder, folder IN ('', '/', '/src6', '/src7/de')
  OR {" OR ".join(f"folder = '{d}' OR starts_with(folder, '{d}/')" for d in (*DENIED, *paths.SYSTEM_FOLDERS))} AS protected
  FROM (SELECT {FOLDER} AS folder FROM files UNION ALL SELECT unnest(['/', '/etc', '/etc/x', '/etcetera', '/usr/bin', '/src6', '/src6/sub', '/private/tmp']))""")
def _(files):
    named = files.sparkSession.createDataFrame([(d,) for d in ("/", "/etc", "/etc/x", "/etcetera", "/usr/bin", "/src6", "/src6/sub", "/private/tmp")], "folder string")
    folders = files.select(paths.parent(F.col("path")).alias("folder")).union(named).distinct()
    return folders.select("folder", paths.protected(F.col("folder"), home="/src6", application="/src7/de", denied=DENIED).alias("protected"))


@register("flt17_due_automations", "jobs", f"SELECT id, greatest({NOW_MS}, updated_at_ms) + priority * 1000 AS next_run FROM jobs WHERE status <> 'cancelled' AND updated_at_ms <= {NOW_MS}")
def _(jobs):
    return jobs.where((F.col("status") != "cancelled") & (F.col("updated_at_ms") <= NOW_MS)).select("id", (F.greatest(F.lit(NOW_MS), "updated_at_ms") + F.col("priority") * 1000).cast("long").alias("next_run"))


@register("flt18_ordinary_gate", "files", "SELECT count(*) AS input_files, count(*) FILTER (NOT ordinary) AS skipped_files FROM files")
def _(files):
    return files.agg(F.count(F.lit(1)).alias("input_files"), F.count_if(~F.col("ordinary")).alias("skipped_files"))


# Joins


@register("jn1_roots_libraries", "roots libraries", "SELECT r.id AS root_id, r.path, l.name FROM roots r JOIN libraries l ON r.library_id = l.id WHERE r.enabled")
def _(roots, libraries):
    joined = roots.alias("r").join(libraries.alias("l"), F.col("r.library_id") == F.col("l.id"))
    return joined.where("enabled").select(F.col("r.id").alias("root_id"), "path", "name")


@register("jn4_operations_plans", "operations plans", "SELECT o.id, p.library_id, p.status AS plan_status FROM operations o JOIN plans p ON o.plan_id = p.id")
def _(operations, plans):
    return operations.alias("o").join(plans.alias("p"), F.col("o.plan_id") == F.col("p.id")).select("o.id", "p.library_id", F.col("p.status").alias("plan_status"))


@register("jn5_header_items", "operations items", """SELECT o.id, count(i.ordinal) AS n_items, coalesce(string_agg(i.source_path, ',' ORDER BY i.ordinal), '') AS sources
  FROM operations o LEFT JOIN items i ON i.operation_id = o.id GROUP BY o.id""")
def _(operations, items):
    listed = journal.with_items(operations, items, "operation_id", "source_path")
    return listed.select("id", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("items.source_path", ","), F.lit("")).alias("sources"))


LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY native_file_id ORDER BY observed_at_ms DESC) AS rn,
  observed_at_ms % 2 AS half FROM observed) WHERE rn = 1)"""
HALVES = """old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY native_file_id ORDER BY observed_at_ms DESC) AS rn FROM observed WHERE observed_at_ms % 2 = 0) WHERE rn = 1),
  new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY native_file_id ORDER BY observed_at_ms DESC) AS rn FROM observed WHERE observed_at_ms % 2 = 1) WHERE rn = 1)"""
KIND_SQL = """CASE WHEN o.native_file_id IS NULL THEN 'inserted' WHEN n.path <> o.path THEN 'moved'
  WHEN n.size <> o.size OR n.modified_at_ns <> o.modified_at_ns OR n.changed_at_ns <> o.changed_at_ns THEN 'metadata_updated' ELSE 'unchanged' END"""


def _halves(observed):
    """The catalogue from even observations, and the odd ones as the new scan."""
    old = reconcile.last_observations(observed.where("observed_at_ms % 2 = 0"))
    files = old.withColumn("id", F.col("new_file_id")).withColumn("last_seen_at_ms", F.col("observed_at_ms")).withColumn("missing_since_ms", F.when(F.col("observed_at_ms") % 5 == 0, 7).cast("long"))
    return files, reconcile.last_observations(observed.where("observed_at_ms % 2 = 1"))


def _spliced(sql: str) -> str:
    return with_roles("", "observed").rstrip() + ", " + HALVES + " " + sql


def register_halves(name: str, sql: str):
    def add(make):
        register(name, "observed")(make)
        SQL[name] = _spliced(sql)
        return make

    return add


@register_halves("jn6_observation_lookup", "SELECT n.new_file_id, o.new_file_id AS known_id FROM new n LEFT JOIN old o USING (native_file_id)")
def _(observed):
    files, seen = _halves(observed)
    changes = reconcile.kinds(files, seen)
    return changes.select("new_file_id", F.when(F.col("kind") != "inserted", F.col("file_id")).alias("known_id"))


@register_halves("cdc1_reconcile", f"SELECT coalesce(o.new_file_id, n.new_file_id) AS file_id, n.path, {KIND_SQL} AS kind FROM new n LEFT JOIN old o USING (native_file_id)")
def _(observed):
    return reconcile.kinds(*_halves(observed)).select("file_id", "path", "kind")


@register_halves("agg9_kind_counts", f"SELECT {KIND_SQL} AS kind, count(*) AS n FROM new n LEFT JOIN old o USING (native_file_id) GROUP BY 1")
def _(observed):
    return reconcile.kinds(*_halves(observed)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register_halves("agg8_scan_counters", f"""SELECT count(*) AS indexed, count(*) FILTER (kind = 'inserted') AS inserted, count(*) FILTER (kind IN ('moved', 'metadata_updated')) AS updated,
  count(*) FILTER (kind = 'unchanged') AS unchanged FROM (SELECT {KIND_SQL} AS kind FROM new n LEFT JOIN old o USING (native_file_id))""")
def _(observed):
    return reconcile.counters(reconcile.kinds(*_halves(observed)))


AFTER_SQL = """SELECT coalesce(o.new_file_id, n.new_file_id) AS id, coalesce(n.path, o.path) AS path, coalesce(n.observed_at_ms, o.observed_at_ms) AS last_seen_at_ms,
  CASE WHEN n.native_file_id IS NOT NULL THEN NULL WHEN starts_with(o.path, '/data/') AND o.observed_at_ms < 1000000000
    THEN coalesce(CASE WHEN o.observed_at_ms % 5 = 0 THEN 7 END, 1000000000) ELSE CASE WHEN o.observed_at_ms % 5 = 0 THEN 7 END END AS missing_since_ms
  FROM old o FULL JOIN new n USING (native_file_id)"""


@register_halves("cdc4_authoritative_snapshot", AFTER_SQL)
def _(observed):
    files, seen = _halves(observed)
    return reconcile.apply(files, seen, "/data", 1_000_000_000).select("id", "path", "last_seen_at_ms", "missing_since_ms")


@register_halves("cdc3_mark_missing", f"SELECT id, missing_since_ms FROM ({AFTER_SQL}) WHERE missing_since_ms IS NOT NULL")
def _(observed):
    files, seen = _halves(observed)
    return reconcile.apply(files, seen, "/data", 1_000_000_000).where("missing_since_ms is not null").select("id", "missing_since_ms")


SOME_SQL = AFTER_SQL.replace("FULL JOIN new n", "FULL JOIN (SELECT * FROM new WHERE cast(native_file_id AS BIGINT) % 3 <> 0) n")


@register_halves("cdc3_some_missing", f"SELECT id, missing_since_ms FROM ({SOME_SQL}) WHERE missing_since_ms IS NOT NULL")
def _(observed):
    """Every third file is not seen again."""
    files, seen = _halves(observed)
    return reconcile.apply(files, seen.where("cast(native_file_id as bigint) % 3 <> 0"), "/data", 1_000_000_000).where("missing_since_ms is not null").select("id", "missing_since_ms")


HISTORY_SQL = """SELECT native_file_id, path, observed_at_ms AS valid_from_ms, lead(observed_at_ms) OVER (PARTITION BY native_file_id ORDER BY observed_at_ms) AS valid_until_ms
  FROM (SELECT *, lag(path) OVER (PARTITION BY native_file_id ORDER BY observed_at_ms) AS before FROM observed) WHERE before IS NULL OR before <> path"""


@register("cdc2_path_history", "observed", HISTORY_SQL)
def _(observed):
    return reconcile.path_history(observed, "native_file_id")


@register("cdc5_dirty_directories", "files", """, d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files)
  SELECT directory FROM d WHERE NOT EXISTS (SELECT 1 FROM d a WHERE starts_with(d.directory, a.directory || '/'))""")
def _(files):
    return reconcile.dirty_directories(files.select("path"), "/")


WATCH_SQL = """SELECT n.native_file_id AS automation_id, n.path, cast(CASE WHEN o.path IS NOT NULL AND o.size = n.size AND o.modified_at_ns = n.modified_at_ns THEN 1 ELSE 0 END AS INT) AS stable_count,
  o.path IS NOT NULL AND o.size = n.size AND o.modified_at_ns = n.modified_at_ns AS handled, o.path IS NOT NULL AND o.size = n.size AND o.modified_at_ns = n.modified_at_ns AS candidate
  FROM new n LEFT JOIN old o ON o.native_file_id = n.native_file_id AND o.path = n.path"""


def _watched(observed):
    files, seen = _halves(observed)
    previous = files.select(F.col("native_file_id").alias("automation_id"), "path", "size", F.col("modified_at_ns").alias("mtime_ns"), F.lit(0).alias("stable_count"), F.lit(False).alias("handled"))
    return previous, seen.select(F.col("native_file_id").alias("automation_id"), "path", "size", F.col("modified_at_ns").alias("mtime_ns"))


@register_halves("cdc6_watch_stability", WATCH_SQL)
def _(observed):
    return reconcile.watch(*_watched(observed), F.lit(True)).select("automation_id", "path", "stable_count", "handled", "candidate")


@register_halves("jn7_watch_state", """SELECT coalesce(n.native_file_id, o.native_file_id) AS automation_id, coalesce(n.path, o.path) AS path,
  CASE WHEN n.path IS NULL THEN 'gone' WHEN o.path IS NULL THEN 'new' ELSE 'known' END AS presence FROM old o FULL JOIN new n ON o.native_file_id = n.native_file_id AND o.path = n.path""")
def _(observed):
    previous, current = (x.select("automation_id", "path") for x in _watched(observed))
    joined = previous.withColumn("p", F.lit(1)).join(current.withColumn("c", F.lit(1)), ["automation_id", "path"], "full_outer")
    return joined.select("automation_id", "path", F.when(F.col("c").isNull(), "gone").when(F.col("p").isNull(), "new").otherwise("known").alias("presence"))


@register("jn9_hash_cache", "files", "SELECT id, CASE WHEN size % 2 = 0 THEN sha256(content) END AS content_hash FROM files")
def _(files):
    cache = files.where("size % 2 = 0").select("path", "size", F.col("modified_at_ns").alias("mtime_ns"), F.lit("").alias("partial_hash"), F.sha2("content", 256).alias("content_hash"))
    return content.cached_hashes(files.select("id", "path", "size", "modified_at_ns"), cache).select("id", "content_hash")


@register("jn10_preview_runs", "operations plans", "SELECT o.id, p.id AS plan_id FROM operations o JOIN plans p ON o.plan_id = p.id WHERE o.status = 'planned' AND p.status = 'ready'")
def _(operations, plans):
    joined = operations.alias("o").join(plans.alias("p"), F.col("o.plan_id") == F.col("p.id"))
    return joined.where("o.status = 'planned' and p.status = 'ready'").select("o.id", F.col("p.id").alias("plan_id"))


@register("jn11_missing_ids", "files", f"SELECT DISTINCT CASE WHEN size % 3 = 0 THEN id ELSE 'x' || id END AS id FROM files WHERE size % 5 = 0 AND NOT (size % 3 = 0 AND {ACTIVE})")
def _(files):
    wanted = files.where("size % 5 = 0").select(F.when(F.col("size") % 3 == 0, F.col("id")).otherwise(F.concat(F.lit("x"), "id")).alias("id"))
    return organize.missing_ids(files, wanted)


# Aggregations


@register("agg1_overview", "files", f"SELECT count(*) AS file_count, cast(coalesce(sum(size), 0) AS BIGINT) AS total_size, max(modified_at_ns) AS latest_modified_at_ns FROM files WHERE {ACTIVE}")
def _(files):
    return query.overview(files)


@register("agg2_size_buckets", "files", "SELECT size, count(*) AS n FROM files GROUP BY size HAVING count(*) > 1")
def _(files):
    return duplicates.buckets(files, "size")


@register("agg3_quick_buckets", "files", "SELECT size, count(*) AS n FROM files GROUP BY size, content HAVING count(*) > 1")
def _(files):
    return duplicates.buckets(duplicates.samples(files), "size", "quick").select("size", "n")


@register("agg5_duplicate_stats", "files", """, o AS (SELECT * FROM files WHERE ordinary) SELECT (SELECT count(*) FROM files) AS input_files, (SELECT count(*) FROM files WHERE NOT ordinary) AS skipped_files,
  (SELECT count(*) FROM o WHERE size IN (SELECT size FROM o GROUP BY size HAVING count(*) > 1)) AS quick_hashed_files,
  (SELECT count(*) FROM o WHERE (size, content) IN (SELECT (size, content) FROM o GROUP BY size, content HAVING count(*) > 1)) AS fully_hashed_files""")
def _(files):
    return duplicates.statistics(files)


@register("agg6_legacy_duplicates", "files", "SELECT substr(sha256(content), 1, 12) AS id, size, count(*) AS n, cast(size * (count(*) - 1) AS BIGINT) AS reclaimable FROM files WHERE size > 0 GROUP BY sha256(content), size HAVING count(*) > 1")
def _(files):
    return duplicates.classes(files, skip_empty=True).select(F.substring("content_hash", 1, 12).alias("id"), "size", "n", F.col("potential_savings").alias("reclaimable"))


@register("agg7_reclaimable", "files", "SELECT cast(sum(r) AS BIGINT) AS reclaimable FROM (SELECT size * (count(*) - 1) AS r FROM files WHERE size > 0 GROUP BY sha256(content), size)")
def _(files):
    return duplicates.classes(files, skip_empty=True).agg(F.sum("potential_savings").alias("reclaimable"))


@register("agg10_execution_tally", "items", """SELECT operation_id, count(*) FILTER (status = 'completed') AS completed, count(*) AS total,
  CASE WHEN count(*) FILTER (status = 'completed') = count(*) THEN 'completed' WHEN count(*) FILTER (status = 'completed') > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM items GROUP BY operation_id""")
def _(items):
    return journal.execution_tally(items)


@register("agg13_selection_counts", "files", "SELECT library_id, count(*) FILTER (missing_since_ms IS NULL) AS visible, count(*) AS loaded FROM files GROUP BY library_id")
def _(files):
    return files.groupBy("library_id").agg(F.count_if(query.active()).alias("visible"), F.count(F.lit(1)).alias("loaded"))


# Orders, pages and top-k


@register("srt1_keyset_page", "files", f"SELECT id, path FROM files WHERE {ACTIVE} AND library_id = 'src1' ORDER BY path, id LIMIT 20")
def _(files):
    return query.page(files, "src1", 20)[0].select("id", "path")


@register("srt1_next_cursor", "files", f"SELECT max(path) AS path, max_by(id, path) AS id FROM (SELECT path, id FROM files WHERE {ACTIVE} AND library_id = 'src1' ORDER BY path, id LIMIT 20) HAVING (SELECT count(*) FROM files WHERE {ACTIVE} AND library_id = 'src1') > 20")
def _(files):
    return query.page(files, "src1", 20)[1].select("path", "id")


def _top(name: str, role: str, columns: str, limit: int, most: int, order: str, where: str = "true"):
    register(name, role, f"SELECT {columns} FROM {role} WHERE {where} ORDER BY {order} LIMIT {limit}")(
        lambda rows: query.top(rows.where(where), limit, most, *[F.expr(o.split()[0]).desc() if o.strip().endswith("DESC") else F.expr(o.split()[0]) for o in order.split(",")]).select(*columns.split(", "))
    )


_top("srt4_history", "operations", "id, status, created_at_ms", 100, query.HISTORY_ROWS, "created_at_ms DESC, id")
_top("srt5_recent_jobs", "jobs", "id, status, updated_at_ms", 200, query.JOB_ROWS, "updated_at_ms DESC, id")
_top("srt7_latest_library", "libraries", "id, name", 1, 1, "updated_at_ms DESC, id")
_top("srt8_largest_files", "files", "id, size", 20, 20, "size DESC, path")
_top("srt9_legacy_history", "operations", "id, created_at_ms", 30, 30, "created_at_ms DESC, id")
_top("srt12_folder_list", "libraries", "id, name", 200, 200, "name, id")
_top("srt15_recovery_queue", "operations", "id, status", 50, 50, "created_at_ms, id", f"status NOT IN {_in(journal.TERMINAL_STATES)}")


@register("srt3_filter_search", "files", f"SELECT id, path, cast(0 as double) AS rank FROM files WHERE {ACTIVE} AND lower(path) LIKE '%.pdf' AND size >= 2049 ORDER BY path, id LIMIT 200")
def _(files):
    return search.search(files, "ext:PDF size:>2KB").select("id", "path", "rank")


@register("srt10_plan_order", "files", "SELECT id, row_number() OVER (PARTITION BY library_id ORDER BY path, id) - 1 AS ordinal FROM files")
def _(files):
    rows = files.select("id", "library_id", "path")
    return ranks.positions(rows, ["library_id"], [F.col("path").asc(), F.col("id").asc()], "ordinal").select("id", "ordinal")


@register("srt10_legacy_order", "files", f"""SELECT id, row_number() OVER (ORDER BY lower({NAME}), path) - 1 AS ordinal FROM files""")
def _(files):
    """The order of a legacy plan: names without case, then whole paths."""
    order = [names.fold_case(paths.basename(F.col("path"))).asc(), F.col("path").asc()]
    return ranks.positions(files.select("id", "path"), [], order, "ordinal").select("id", "ordinal")


@register("srt14_undo_order", "items", "SELECT operation_id, ordinal, row_number() OVER (PARTITION BY operation_id ORDER BY ordinal DESC) AS step FROM items")
def _(items):
    return items.select("operation_id", "ordinal", F.row_number().over(Window.partitionBy("operation_id").orderBy(F.desc("ordinal"))).cast("long").alias("step"))


# Text search

STATS = """, t AS (SELECT *, {count} AS tf, cast({length} AS DOUBLE) AS d FROM files), s AS (SELECT count(*) AS n, avg(d) AS a, count(*) FILTER (tf > 0) AS df FROM t)
  SELECT id, path, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d / a)) AS rank
  FROM t, s WHERE tf > 0 AND missing_since_ms IS NULL ORDER BY round(rank, 12), path, id LIMIT 200"""
TOKENS_SQL = r"regexp_extract_all(lower(path), '[\p{L}\p{N}]+')"


def _ranked(found):
    return found.select("id", "path", F.round("rank", 9).alias("rank"))


def _rounded(sql: str) -> str:
    at = sql.index("SELECT id, path, -")
    return sql[:at] + "SELECT id, path, round(rank, 9) AS rank FROM (" + sql[at:] + ")"


@register("txt2_prefix_search", "files", _rounded(STATS.format(count=f"2.0 * len(list_filter({TOKENS_SQL}, lambda t: starts_with(t, 'b')))", length=f"2 * len({TOKENS_SQL})")))
def _(files):
    return _ranked(search.search(files, "b"))


@register("txt3_substring_search", "files", _rounded(STATS.format(count="CAST((length(lower(path)) - length(replace(lower(path), 'dget', ''))) / 4 AS DOUBLE)", length="greatest(length(path) - 2, 0)")))
def _(files):
    return _ranked(search.search(files, "DGET"))


@register("txt4_bm25", "files", _rounded(STATS.format(count=f"2.0 * len(list_filter({TOKENS_SQL}, lambda t: starts_with(t, 're')))", length=f"2 * len({TOKENS_SQL})").replace("missing_since_ms IS NULL", "missing_since_ms IS NULL AND library_id = 'src1'")))
def _(files):
    return _ranked(search.search(files, "re", "src1"))


@register("txt4_bm25_numbers", "files", _rounded(STATS.format(count=f"2.0 * len(list_filter({TOKENS_SQL}, lambda t: starts_with(t, '1')))", length=f"2 * len({TOKENS_SQL})").replace("missing_since_ms IS NULL", "missing_since_ms IS NULL AND library_id = 'src1'")))
def _(files):
    return _ranked(search.search(files, "1", "src1"))


@register("txt1_parsed_search", "files", f"SELECT id, path, size FROM files WHERE {ACTIVE} AND lower(path) LIKE '%.txt' AND size <= 1535 ORDER BY path, id LIMIT 200")
def _(files):
    return search.search(files, "ext:.TXT size:<1.5KB").select("id", "path", "size")


@register("txt5_tokens", "files", f"SELECT id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM files")
def _(files):
    return files.select("id", F.array_join(search.tokens(F.col("path")), " ").alias("tokens"))


@register("txt6_trigrams", "files", "SELECT id, CASE WHEN length(path) < 3 THEN '' ELSE array_to_string(list_transform(range(1, length(path) - 1), lambda i: substr(lower(path), i, 3)), '|') END AS grams FROM files")
def _(files):
    return files.select("id", F.array_join(search.trigrams(F.col("path")), "|").alias("grams"))


@register("txt7_empty_search", "files", "SELECT id, path FROM files WHERE false")
def _(files):
    return search.search(files, "   ").select("id", "path")


STEM = rf"CASE WHEN regexp_matches({NAME}, '^.+\.[^.]*$') THEN regexp_extract({NAME}, '^(.+)\.[^.]*$', 1) ELSE {NAME} END"


@register("txt10_safe_filename", "files", f"SELECT id, trim(regexp_replace('ab' || ({STEM}), ' +', ' ', 'g'), ' .') || CASE WHEN {EXT} = '' THEN '' ELSE '.' || {EXT} END AS name FROM files")
def _(files):
    from .functions.names import safe_filename_column

    p = F.col("path")
    return files.select("id", safe_filename_column(F.concat(F.lit(' a:b*"'), paths.stem(p), F.lit(" .")), paths.extension(p)).alias("name"))


def _copies(files):
    """Many files of one name in each library, every seventh of which exists there."""
    order = Window.partitionBy("library_id").orderBy("path", "id")
    name = F.concat(F.lit("copy."), F.coalesce(F.nullif(paths.extension(F.col("path")), F.lit("")), F.lit("bin")))
    plan = files.select(F.col("library_id").alias("folder"), F.row_number().over(order).alias("ordinal"), "id", name.alias("name"))
    return plan, plan.where("ordinal % 7 = 0").select("folder", "name")


COPIES_SQL = f""", c AS (SELECT library_id AS folder, row_number() OVER (PARTITION BY library_id ORDER BY path, id) AS ordinal, id, CASE WHEN {EXT} = '' THEN 'bin' ELSE {EXT} END AS ext FROM files),
  e AS (SELECT DISTINCT folder, ext, 1 AS there FROM c WHERE ordinal % 7 = 0),
  n AS (SELECT c.*, row_number() OVER (PARTITION BY folder, ext ORDER BY ordinal) - 1 + coalesce(there, 0) AS k FROM c LEFT JOIN e USING (folder, ext))
  SELECT folder, cast(ordinal AS INT) AS ordinal, id, CASE WHEN k = 0 THEN 'copy.' ELSE 'copy (' || cast(k + {{first}} AS VARCHAR) || ').' END || ext AS unique_name FROM n"""


@register("txt11_unique_filename", "files", COPIES_SQL.format(first=1))
def _(files):
    return organize.unique_names(*_copies(files))


@register("txt13_destination", "files", f"""SELECT id, '归档/' || strftime(make_timestamp((modified_at_ns // 1000000000) * 1000000), '%Y') || '/' || strftime(make_timestamp((modified_at_ns // 1000000000) * 1000000), '%m')
  || '/' || CASE WHEN {EXT} = '' THEN '无扩展名' ELSE {EXT} END || '/' || {INITIAL_SQL} || '/' || {GROUP_SQL} AS destination FROM files""")
def _(files):
    p = F.col("path")
    return files.select("id", rules.destination("归档/{YYYY}/{MM}/{ext}/{initial}/{category}", p, F.col("modified_at_ns"), classify.group(p)).alias("destination"))


# Rules and plans

RULES = [
    rules.sanitize({"name": "reports", "priority": 100, "conditions": {"extensions": ["PDF", ".docx"], "name_contains": "report"}, "action": {"destination": "reports/{YYYY}"}}) | {"created_at": "2"},
    rules.sanitize({"name": "old", "priority": 50, "conditions": {"older_than_days": 900}, "action": {"destination": "old/{category}"}}) | {"created_at": "1"},
    rules.sanitize({"name": "small", "priority": 50, "conditions": {"max_size": 1000, "newer_than_days": 800}, "action": {"destination": "small"}}) | {"created_at": "3"},
]
AGE = f"(({NOW_NS} - modified_at_ns) / cast({rules.DAY_NS} as double))"
RULE_SQL = [(f"{EXT} IN ('pdf', 'docx') AND contains(lower({NAME}), 'report') AND {AGE} >= 0", "reports"), (f"{AGE} >= 900", "old"), (f"size <= 1000 AND {AGE} >= 0 AND {AGE} <= 800", "small")]


@register("anl7_rule_evaluation", "files", "SELECT id, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in RULE_SQL) + " END AS rule FROM files")
def _(files):
    return rules.evaluate(files, RULES, NOW_NS).select("id", "rule")


@register("flt11_folded_names", "files", f"SELECT id FROM files WHERE contains(lower({NAME}), 'report')")
def _(files):
    """Names in another case, with a letter that only folding makes equal. A whole rule would leave out files changed after its moment."""
    other = F.replace(F.upper("path"), F.lit("REPORT"), F.lit("STRASSE"))
    rule = rules.sanitize({"name": "f", "conditions": {"name_contains": "stra\u00dfe"}, "action": {"destination": "x"}})
    return files.withColumn("path", other).where(rules.named(rule["conditions"]["name_contains"])).select("id")


@register("flt11_rule_match", "files", f"SELECT id FROM files WHERE {RULE_SQL[0][0]}")
def _(files):
    return files.where(rules.matches(RULES[0]["conditions"], NOW_NS)).select("id")


@register("jn8_first_rule", "files", f"""SELECT id, rule, CASE rule WHEN 'reports' THEN 'reports/' || strftime(make_timestamp((modified_at_ns // 1000000000) * 1000000), '%Y') WHEN 'old' THEN 'old/' || {GROUP_SQL} ELSE 'small' END AS destination
  FROM (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{n}'" for c, n in RULE_SQL)} END AS rule FROM files) WHERE rule IS NOT NULL""")
def _(files):
    return rules.evaluate(files, RULES, NOW_NS).where("rule is not null").select("id", "rule", "destination")


@register("jn8_rule_table", "files", PLAIN["jn8_first_rule"])
def _(files):
    """The same rules, and one that is not enabled, as rows of a table."""
    table = rules.rule_rows(files.sparkSession, [*RULES, {**RULES[1], "enabled": False, "priority": 9999}])
    return rules.evaluate_table(files, table, NOW_NS).where("rule is not null").select("id", "rule", "destination")


@register("anl9_move_plan", "files", f"""SELECT row_number() OVER (PARTITION BY library_id ORDER BY path, id) - 1 AS ordinal, id AS file_id, path AS source_path,
  '/r/sorted/' || folder || '/' || CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '(\\.[^.]*)?$', ' (' || cast(k + 1 AS VARCHAR) || ')\\1') END AS target_path,
  cast({NOW_MS} as bigint) AS created_at_ms, cast({NOW_MS + organize.LIFETIME_MS} as bigint) AS expires_at_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY id) - 1 AS k FROM (SELECT *, {LABEL_SQL.format(x=CATEGORY_SQL)} AS folder, {NAME} AS name FROM files))""")
def _(files):
    rows = files.withColumn("header", F.unhex("header_hex"))
    none = files.where("false").select(F.lit("").alias("folder"), F.lit("").alias("name"))
    return organize.move_plan(rows, rows, "/r", NOW_MS, none, "sorted").withColumn("ordinal", F.col("ordinal").cast("long"))


@register("cdc7_plan_validity", "plans", f"SELECT id, expires_at_ms < {NOW_MS} AS expired FROM plans")
def _(plans):
    return plans.select("id", organize.expired(F.col("expires_at_ms"), NOW_MS).alias("expired"))


# Recovery and states


@register("cdc8_recovery_verdict", "items", """SELECT operation_id, ordinal, CASE WHEN source_matches AND NOT target_exists THEN 'resume_from_source' WHEN target_matches AND NOT source_exists THEN 'operation_completed'
  WHEN source_matches AND target_matches THEN 'remove_published_source' ELSE 'manual_review' END AS verdict FROM items""")
def _(items):
    return items.select("operation_id", "ordinal", journal.verdict(*map(F.col, ("source_matches", "target_matches", "source_exists", "target_exists"))).alias("verdict"))


@register("cdc9_recovery_audit", "items", """SELECT operation_id, CASE WHEN a THEN 'failed' WHEN b THEN 'completed' ELSE 'recovery_needed' END AS status, CASE WHEN a THEN 'ready' WHEN b THEN 'completed' END AS plan_status
  FROM (SELECT operation_id, bool_and(source_matches AND NOT target_exists) AS a, bool_and(target_matches AND NOT source_exists) AS b FROM items GROUP BY operation_id)""")
def _(items):
    return journal.audit(items)


LEGAL_SQL = " OR ".join(f"(before = '{a}' AND status IN {_in(b)})" for a, b in journal.TRANSITIONS.items())


@register("cdc10_illegal_steps", "operations", f"SELECT id, before AS previous_status, status FROM (SELECT *, lag(status) OVER (PARTITION BY plan_id ORDER BY created_at_ms, id) AS before FROM operations) WHERE before IS NOT NULL AND NOT ({LEGAL_SQL})")
def _(operations):
    return journal.illegal_steps(operations, "plan_id", "created_at_ms", "id").select("id", "previous_status", "status")


@register("cdc11_presence_verdict", "items", """SELECT operation_id, ordinal, CASE WHEN target_exists AND NOT source_exists THEN 'completed' WHEN source_exists AND NOT target_exists THEN 'pending' ELSE 'recovery_needed' END AS verdict FROM items""")
def _(items):
    return items.select("operation_id", "ordinal", journal.presence_verdict(F.col("source_exists"), F.col("target_exists")).alias("verdict"))


def _registered(roots, libraries):
    """A third of the roots are registered again under other ids, and as many new ones."""
    again = roots.where("cast(id as int) % 3 = 0")
    wanted = again.select("path", F.lit("x").alias("library_id"), F.lit("y").alias("root_id"), F.lit("z").alias("name"))
    new = again.select(F.concat("path", F.lit("/new")).alias("path"), F.concat(F.lit("l"), "id").alias("library_id"), F.concat(F.lit("r"), "id").alias("root_id"), "path")
    return reconcile.register_roots(roots, libraries, wanted.union(new), NOW_MS)


@register("cdc12_root_registration", "roots libraries", f"""SELECT path, id, library_id, enabled OR cast(id AS INT) % 3 = 0 AS enabled, created_at_ms FROM roots
  UNION ALL SELECT path || '/new', 'r' || id, 'l' || id, true, cast({NOW_MS} AS BIGINT) FROM roots WHERE cast(id AS INT) % 3 = 0""")
def _(roots, libraries):
    return _registered(roots, libraries)[0].select("path", "id", "library_id", "enabled", "created_at_ms")


@register("cdc12_library_touch", "roots libraries", f"""SELECT id, name, CASE WHEN id IN (SELECT library_id FROM roots WHERE cast(id AS INT) % 3 = 0) THEN {NOW_MS} ELSE updated_at_ms END AS updated_at_ms FROM libraries
  UNION ALL SELECT 'l' || id, path, cast({NOW_MS} AS BIGINT) FROM roots WHERE cast(id AS INT) % 3 = 0""")
def _(roots, libraries):
    return _registered(roots, libraries)[1].select("id", "name", "updated_at_ms")


@register("snk1_upsert", "observed", "SELECT native_file_id, max(observed_at_ms) AS observed_at_ms FROM observed GROUP BY native_file_id")
def _(observed):
    files, seen = _halves(observed)
    return sinks.upserted(files.select(*seen.columns), seen, "native_file_id", "observed_at_ms").select("native_file_id", "observed_at_ms")


@register("snk4_json", "libraries", """SELECT '{"id":"' || id || '","name":"' || name || '","updated_at_ms":' || cast(updated_at_ms as string) || '}' AS json FROM libraries""")
def _(libraries):
    return sinks.as_json(libraries)


# Job queue

EXPIRED = f"coalesce(lease_expires_at_ms < {NOW_MS}, false)"
EXPIRED_STATUS = f"CASE WHEN {EXPIRED} AND status = 'pause_requested' THEN 'paused' WHEN {EXPIRED} AND status = 'cancel_requested' THEN 'cancelled' WHEN {EXPIRED} AND status = 'running' THEN 'queued' ELSE status END"


@register("job3_expire_leases", "jobs", f"SELECT id, {EXPIRED_STATUS} AS status FROM jobs")
def _(jobs):
    return journal.expire(jobs, NOW_MS).select("id", "status")


CLAIM_SQL = f"SELECT id, priority FROM (SELECT id, priority, created_at_ms, {EXPIRED_STATUS} AS s FROM jobs) WHERE s = 'queued' ORDER BY priority DESC, created_at_ms, id LIMIT 1"


@register("job2_claim", "jobs", CLAIM_SQL)
def _(jobs):
    return journal.claim(jobs, NOW_MS).select("id", "priority")


@register("srt6_claim_order", "jobs", f"""SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, created_at_ms, id) AS place
  FROM (SELECT *, {EXPIRED_STATUS} AS s FROM jobs) WHERE s = 'queued'""")
def _(jobs):
    return journal.claim_order(jobs, NOW_MS, "kind").select("kind", "id", F.col("place").cast("long").alias("place"))


HELD_SQL = f"lease_owner = 'w1' AND lease_expires_at_ms >= {NOW_MS} AND status IN ('running', 'pause_requested', 'cancel_requested')"


@register("job4_progress", "jobs", f"""SELECT id, CASE WHEN ok THEN 50 ELSE progress_current END AS progress_current, CASE WHEN ok THEN 60 ELSE progress_total END AS progress_total
  FROM (SELECT *, coalesce({HELD_SQL}, false) AS ok FROM jobs)""")
def _(jobs):
    return journal.progress(jobs, "w1", NOW_MS, F.lit(50).cast("long"), F.lit(60).cast("long")).select("id", "progress_current", "progress_total")


@register("job4_renewal", "jobs", f"SELECT id, coalesce({HELD_SQL}, false) AS renewed, CASE WHEN {HELD_SQL} THEN {NOW_MS + 5000} ELSE lease_expires_at_ms END AS lease_expires_at_ms FROM jobs")
def _(jobs):
    return journal.renew(jobs, "w1", NOW_MS, 5000).select("id", "renewed", "lease_expires_at_ms")


@register("job4_late_progress", "jobs", "SELECT id, progress_current, progress_total FROM jobs")
def _(jobs):
    return journal.progress(jobs, "w1", NOW_MS, F.lit(70).cast("long"), F.lit(60).cast("long")).select("id", "progress_current", "progress_total")


@register("job5_requests", "jobs", """SELECT id, CASE WHEN status = 'running' THEN 'pause_requested' WHEN status = 'queued' THEN 'paused' ELSE status END AS paused,
  CASE WHEN status = 'running' THEN 'cancel_requested' WHEN status IN ('queued', 'paused') THEN 'cancelled' ELSE status END AS cancelled FROM jobs""")
def _(jobs):
    both = journal.request(jobs.withColumn("original", F.col("status")), "pause").withColumnRenamed("status", "paused").withColumnRenamed("original", "status")
    return journal.request(both, "cancel").select("id", "paused", F.col("status").alias("cancelled"))


@register("job6_resume", "jobs", """SELECT id, CASE WHEN status = 'paused' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'paused' THEN 0 ELSE progress_current END AS progress_current,
  CASE WHEN status <> 'paused' THEN progress_total END AS progress_total FROM jobs""")
def _(jobs):
    return journal.resume(jobs).select("id", "status", "progress_current", "progress_total")


@register("job7_finish", "jobs", f"""SELECT id, CASE WHEN ok THEN 'completed' ELSE status END AS status, ok AS applied
  FROM (SELECT *, coalesce(lease_owner = 'w2' AND lease_expires_at_ms >= {NOW_MS}, false) AND status = 'running' AS ok FROM jobs)""")
def _(jobs):
    return journal.finish(jobs, "w2", NOW_MS, "running", "completed").select("id", "status", "applied")


# Fingerprints


@register("anl2_text_simhash", "files")
def _(files):
    return files.select("id", similarity.text_simhash(F.col("content")).alias("hash"))


@register("anl3_similar_pairs", "files")
def _(files):
    return similarity.similar_pairs(files.select("id", similarity.text_simhash(F.col("content")).alias("hash")))


@register("anl3_hash_classes", "files", """, h AS (SELECT id, (size % 1024) * 2654435761 % 4294967296 AS hash FROM files), c AS (SELECT hash, min(id) AS rep FROM h GROUP BY hash)
  SELECT a.rep AS left_id, b.rep AS right_id, 1 - bit_count(xor(a.hash, b.hash)) / 64 AS similarity FROM c a JOIN c b ON a.rep < b.rep AND bit_count(xor(a.hash, b.hash)) <= 3
  UNION ALL SELECT rep, id, cast(1 AS DOUBLE) FROM h JOIN c USING (hash) WHERE id <> rep""")
def _(files):
    return similarity.similar_pairs(files.select("id", (F.col("size") % 1024 * 2654435761 % 4294967296).alias("hash")))


SAMPLES = "transform(sequence(0, 71), i -> cast((size * (i + 3) + i * i * 7) % 256 as int))"


GREY = "(size * (9 * r + c + {k} + 3) + (9 * r + c + {k}) * (9 * r + c + {k}) * 7) % 256"


@register("anl4_image_dhash", "files", f"""SELECT id, string_agg(CASE WHEN {GREY.format(k=0)} > {GREY.format(k=1)} THEN '1' ELSE '0' END, '' ORDER BY 8 * r + c DESC) AS bits
  FROM files, unnest(range(8)) a(r), unnest(range(8)) b(c) GROUP BY id""")
def _(files):
    return files.select("id", F.lpad(F.bin(similarity.image_dhash(F.expr(SAMPLES))), 64, "0").alias("bits"))


@register("src4_header", "files", "SELECT id, substr(header_hex, 1, 32) AS header_hex FROM files")
def _(files):
    return files.select("id", F.hex(content.header(F.unhex("header_hex"))).alias("header_hex"))


@register("src7_preview", "files", f"SELECT id, CASE WHEN {EXT} IN {_in(content.TEXT_EXTENSIONS)} THEN 'text' ELSE 'metadata' END AS kind, {EXT} IN {_in(content.TEXT_EXTENSIONS)} AND strlen(content) > 262144 AS truncated FROM files")
def _(files):
    return files.select("id", content.preview(F.col("path"), F.col("content").cast("binary")).alias("p")).select("id", "p.kind", "p.truncated")


# The index as a table, and what else the catalogue answers

WORD_TABLE = f", w AS (SELECT DISTINCT id, unnest({TOKENS_SQL}) AS token FROM files)"
GRAM_TABLE = ", w AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(path) - 1), lambda i: substr(lower(path), i, 3))) AS token FROM files)"


@register("flt9_prefix_match", "files", WORD_TABLE + " SELECT id FROM files WHERE id IN (SELECT id FROM w WHERE starts_with(token, 're')) AND id IN (SELECT id FROM w WHERE starts_with(token, 'e'))")
def _(files):
    return search.matching(files.select("id", "path"), search.token_table(files), ["re", "e"]).select("id")


@register("flt10_trigram_match", "files", GRAM_TABLE + " SELECT id FROM files WHERE id IN (SELECT id FROM w WHERE token = 'bud') AND id IN (SELECT id FROM w WHERE token = 'get')")
def _(files):
    return search.matching(files.select("id", "path"), search.token_table(files, grams=True), ["bud", "get"], prefix=False).select("id")


@register("jn2_words_files", "files", WORD_TABLE + " SELECT token, count(*) AS n, cast(sum(size) AS BIGINT) AS bytes FROM w JOIN files USING (id) GROUP BY token")
def _(files):
    joined = search.token_table(files).join(files.select("id", "size"), "id")
    return joined.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@register("jn3_trigrams_files", "files", GRAM_TABLE + " SELECT token, count(*) AS n, max(size) AS largest FROM w JOIN files USING (id) GROUP BY token")
def _(files):
    joined = search.token_table(files, grams=True).join(files.select("id", "size"), "id")
    return joined.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"))


@register("agg12_index_statistics", "files", f""", w AS (SELECT id, unnest({TOKENS_SQL}) AS token FROM files), s AS (SELECT count(*) AS n, avg(cast(2 * len({TOKENS_SQL}) AS DOUBLE)) AS average_length FROM files)
  SELECT token, count(DISTINCT id) AS df, 2 * count(*) AS tf, max(n) AS n, max(average_length) AS average_length FROM w, s GROUP BY token""")
def _(files):
    return search.index_statistics(files)


@register("srt2_search_topk", "files", _rounded(STATS.format(count=f"2.0 * len(list_filter({TOKENS_SQL}, lambda t: starts_with(t, 'no')))", length=f"2 * len({TOKENS_SQL})").replace("LIMIT 200", "LIMIT 25")))
def _(files):
    return _ranked(search.search(files, "no", limit=25))


def _indexed(files: DataFrame) -> tuple[DataFrame, str]:
    """What a search shows and filters by, indexed in a new folder."""
    rows = files.select("id", "path", "size", "library_id", "missing_since_ms")
    root = new_path(files.sparkSession, "index")
    index.build(rows, root, shards=4)
    return rows, root


def _found(files: DataFrame, text: str, library: str | None = None, limit: int = query.SEARCH_ROWS) -> DataFrame:
    rows, root = _indexed(files)
    return _ranked(index.Search(files.sparkSession, root, rows.schema, text, library, limit).rows())


@register("txt2_indexed_prefix", "files", PLAIN["txt2_prefix_search"])
def _(files):
    return _found(files, "b")


@register("txt3_indexed_substring", "files", PLAIN["txt3_substring_search"])
def _(files):
    return _found(files, "DGET")


@register("srt2_indexed_topk", "files", PLAIN["srt2_search_topk"])
def _(files):
    return _found(files, "no", limit=25)


@register("srt2_updated_index", "files", PLAIN["srt2_search_topk"])
def _(files):
    """An index of an older state, in which some files are missing, some have gone since and some other names, is brought up to date."""
    spark, rows = files.sparkSession, files.select("id", "path", "size", "library_id", "missing_since_ms")
    old = F.when(F.crc32("id") % 5 == 1, F.concat("path", F.lit(" notes notes"))).otherwise(F.col("path"))
    stale = rows.where(F.crc32("id") % 5 != 0).withColumn("path", old).union(rows.withColumn("id", F.concat(F.lit("gone"), "id")).where(F.crc32("id") % 5 == 2))
    root = new_path(spark, "index")
    index.build(stale, root, shards=4)
    index.update(spark, root, rows.where(F.crc32("id") % 5 < 2), stale.where(F.col("id").startswith("gone")).select("id"))
    return _ranked(index.Search(spark, root, rows.schema, "no", limit=25).rows())


NATURAL_SQL = f"""list_aggregate(list_transform(regexp_extract_all(lower({NAME}), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
  THEN '0' || lpad(cast(length(coalesce(nullif(ltrim(x, '0'), ''), '0')) AS VARCHAR), 6, '0') || coalesce(nullif(ltrim(x, '0'), ''), '0') ELSE x END), 'string_agg', '')"""


@register("srt11_natural_order", "files", f"""SELECT id, row_number() OVER (PARTITION BY library_id ORDER BY {NATURAL_SQL}, path) AS place,
  row_number() OVER (PARTITION BY library_id ORDER BY {NATURAL_SQL} DESC, path DESC) AS place_down FROM files""")
def _(files):
    # Descending turns the ties round too, so it is the same order from the other end.
    up = ranks.positions(files.select("id", "library_id", "path"), ["library_id"], query.natural_order(F.col("path")), "place")
    sizes = files.groupBy(F.col("library_id").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    return up.join(sizes, F.col("library_id").eqNullSafe(F.col("of"))).select("id", (F.col("place") + 1).alias("place"), (F.col("n") - F.col("place")).alias("place_down"))


@register("srt13_rule_order", "jobs", "SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, created_at_ms, id) AS place FROM jobs")
def _(jobs):
    order = Window.partitionBy("kind").orderBy(*rules.order("priority", "created_at_ms"), "id")
    return jobs.select("kind", "id", F.row_number().over(order).cast("long").alias("place"))


@register("txt8_smart_folder", "files", f"SELECT id, path FROM files WHERE {ACTIVE} AND lower(path) LIKE '%.html' AND size <= 3000 ORDER BY path, id LIMIT 200")
def _(files):
    saved = query.smart_folder(" small pages ", "ext:html size:<=3000B")
    return search.search(files, query.from_rule(saved["rule"])).select("id", "path")


@register("txt12_legacy_names", "files", COPIES_SQL.format(first=0))
def _(files):
    return organize.unique_names(*_copies(files), "legacy")


TENTHS = "cast(floor(size * 10 / 1024.0 + 0.5) AS BIGINT)"


@register("txt15_readable_size", "files", f"""SELECT id, CASE WHEN size < 1024 THEN cast(size AS VARCHAR) || ' B' WHEN size < 10240 THEN cast({TENTHS} // 10 AS VARCHAR) || '.' || cast({TENTHS} % 10 AS VARCHAR) || ' KB'
  ELSE cast(cast(floor(size / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' END AS shown FROM files""")
def _(files):
    return files.select("id", paths.readable_size(F.col("size")).alias("shown"))


@register("anl8_rule_plan", "files")
def _(files):
    found = rules.evaluate(files, RULES, NOW_NS).where("destination is not null")
    order = Window.partitionBy("destination").orderBy(F.lower(paths.basename(F.col("path"))), "path", "id")
    plan = found.select(F.col("destination").alias("folder"), F.row_number().over(order).alias("ordinal"), "id", paths.basename(F.col("path")).alias("name"))
    return organize.unique_names(plan, plan.limit(0).select("folder", "name"), "legacy")


@register("agg11_bit_votes", "files", """, b AS (SELECT library_id, bit, sum(CASE WHEN (size * 2654435761 >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM files, unnest(range(32)) t(bit) GROUP BY library_id, bit)
  SELECT library_id, cast(sum(CASE WHEN votes >= 0 THEN cast(1 AS BIGINT) << bit ELSE 0 END) AS BIGINT) AS hash FROM b GROUP BY library_id""")
def _(files):
    return similarity.bit_votes(files.select("library_id", (F.col("size") * 2654435761).alias("h")), "library_id", "h", 32)


@register("job1_enqueue", "jobs", "SELECT id AS job_id, 'queued' AS event, created_at_ms FROM jobs")
def _(jobs):
    return journal.first_events(jobs)


@register("job8_event_log", "jobs", """SELECT job_id, event, created_at_ms, row_number() OVER (PARTITION BY job_id ORDER BY created_at_ms, event) AS number
  FROM (SELECT id AS job_id, 'queued' AS event, created_at_ms FROM jobs UNION ALL SELECT id, status, updated_at_ms FROM jobs)""")
def _(jobs):
    later = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("event"), F.col("updated_at_ms").alias("created_at_ms"))
    return journal.event_log(journal.first_events(jobs).union(later)).withColumn("number", F.col("number").cast("long"))


@register("job9_scheduling", "jobs", """SELECT id, n <= 900000 AS due, CASE WHEN n <= 900000 THEN 900000 + least(greatest(progress_current, CASE WHEN kind = 'scan' THEN 10 ELSE 60 END), 2592000) ELSE n END AS next_run
  FROM (SELECT *, created_at_ms - 500000 AS n FROM jobs WHERE status <> 'cancelled')""")
def _(jobs):
    automations = jobs.select("id", F.when(F.col("kind") == "scan", "watch").otherwise("schedule").alias("kind"), F.col("progress_current").alias("seconds"), (F.col("created_at_ms") - 500_000).alias("next_run"), (F.col("status") != "cancelled").alias("enabled"))
    return journal.next_runs(automations, 900_000)


# Sources and sinks that have no table of their own


@register("snk2_journal", "operations items", "SELECT i.operation_id, i.ordinal, i.source_path, o.status FROM items i JOIN operations o ON o.id = i.operation_id")
def _(operations, items):
    """Half of all operations in one commit, then all in another: what is there already is not repeated."""
    spark, root = items.sparkSession, new_path(items.sparkSession, "journal")
    header, rows = operations.select("id", "status"), items.select("operation_id", "ordinal", "source_path")
    sinks.journal(header.where(F.crc32("id") % 2 == 0), rows, root)
    sinks.journal(header, rows, root)
    written = sinks.journalled(spark, root, header.schema, rows.schema)
    return written[1].join(written[0], F.col("operation_id") == F.col("id")).select("operation_id", "ordinal", "source_path", "status")


@register("snk1_merge_stream", "observed", PLAIN["snk1_upsert"])
def _(observed):
    """Observations arrive as a stream and are merged batch by batch."""
    spark, root = observed.sparkSession, new_path(observed.sparkSession, "merge")
    rows = observed.select("native_file_id", "path", "size", "observed_at_ms")
    rows.repartition(4).write.parquet(f"{root}/arriving")
    stream = watch.event_stream(spark, f"{root}/arriving", rows.schema, files_at_once=2)
    sinks.merge_stream(stream, f"{root}/table", "native_file_id", "observed_at_ms", "observer", f"{root}/state").awaitTermination()
    return sinks.merged(spark, f"{root}/table", rows.schema).select("native_file_id", "observed_at_ms")


@register("snk3_job_events", "jobs", "SELECT id AS job_id, 'queued' AS event, created_at_ms FROM jobs")
def _(jobs):
    path, events_ = new_path(jobs.sparkSession, "job-events"), journal.first_events(jobs)
    for part in (events_.where("created_at_ms % 2 = 0"), events_, events_):
        sinks.append_events(part, path)
    return jobs.sparkSession.read.parquet(path)


LEAST_SQL = """, d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM files WHERE ordinary)
  SELECT directory FROM d WHERE NOT EXISTS (SELECT 1 FROM d a WHERE starts_with(d.directory, a.directory || '/'))"""


def _events(files: DataFrame) -> DataFrame:
    return files.where("ordinary").select("path", F.lit("modify").alias("event"), F.col("modified_at_ns").alias("observed_at_ms"))


def _stream(rows: DataFrame, path: str, query_name: str) -> DataFrame:
    """Everything that is available now, through the stream and into a table."""
    rows.writeStream.queryName(query_name).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/out")


@register("src9_file_events", "files", LEAST_SQL)
def _(files):
    """Events that arrive as files, all in one micro-batch of as many tasks as there are files: its directories are written."""
    spark, path = files.sparkSession, new_path(files.sparkSession, "events")
    _events(files).write.parquet(f"{path}/events")
    write = lambda found, number: found.select("directory").write.mode("overwrite").parquet(f"{path}/found/batch={number}")
    watch.dirty_batches(watch.event_stream(spark, f"{path}/events"), "/", write, f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/found").select("directory")


@register("cdc5_dirty_over_batches", "files", LEAST_SQL)
def _(files):
    """The same events in several micro-batches, the deepest directories first, through tries that are kept from batch to batch."""
    path, rows = new_path(files.sparkSession, "events"), _events(files)
    depth = F.size(F.split("path", "/"))
    for hidden in (True, False):
        rows.where((depth > 4) == hidden).write.mode("append").parquet(f"{path}/events")
    changes = watch.dirty_changes(watch.event_stream(files.sparkSession, f"{path}/events", files_at_once=3), "/")
    return watch.still_dirty(_stream(changes, path, "dirty"), "/")


#: Six looks at all files, of which each look misses some and finds some changed.
SIGHTINGS = ("library_id AS automation_id", "path", "size + ((cast(substr(id, 2) AS bigint) + look) // 3) % 2 AS size", "cast(7 AS bigint) AS mtime_ns", "look")
LOOKS, THERE = 6, "(cast(substr(id, 2) AS bigint) * 7 + look * 3) % 5 <> 0"


@register("cdc6_watch_stream", "files", f""", s AS (SELECT {', '.join(SIGHTINGS)} FROM files, range({LOOKS}) l(look) WHERE {THERE}),
  b AS (SELECT *, coalesce(lag(look) OVER w = look - 1 AND lag(size) OVER w = size, false) AS same FROM s WINDOW w AS (PARTITION BY automation_id, path ORDER BY look)),
  r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY automation_id, path ORDER BY look) AS run FROM b)
  SELECT automation_id, path, min(look) + 1 AS look FROM r GROUP BY automation_id, path, run HAVING count(*) > 1 AND min(look) > 0""")
def _(files):
    """One micro-batch for each look, the state of every file kept by the stream."""
    spark, path = files.sparkSession, new_path(files.sparkSession, "looks")
    out = []
    for look in range(LOOKS):
        seen = files.withColumn("look", F.lit(look).cast("long")).where(F.expr(THERE)).selectExpr(*[x.replace("//", "div") for x in SIGHTINGS])
        seen.withColumn("seen_at", F.timestamp_millis(F.col("look") * 60_000 + NOW_NS // 1_000_000)).write.mode("append").parquet(f"{path}/looks")
        settled = watch.settled_files(watch.event_stream(spark, f"{path}/looks", watch.SIGHTING), grace_ms=90_000)
        out = _stream(settled, path, "settled")
    return out


LITERALS = {"=1.5KB": (1536, 1536), ">10MB": (10485761, None), ">=7B": (7, None), "<1b": (None, 0), "<=2kb": (None, 2048), "3": (3, 3), ".5KB": (512, 512), "1TB": (1099511627776, 1099511627776)}


@register("txt1a_size_literals", "files", "SELECT id, literal FROM files, (VALUES " + ", ".join(f"('{k}', {a if a is not None else 'NULL'}, {b if b is not None else 'NULL'})" for k, (a, b) in LITERALS.items()) + ") t(literal, low, high) WHERE (low IS NULL OR size >= low) AND (high IS NULL OR size <= high)")
def _(files):
    bounds = files.sparkSession.createDataFrame([(x, *query.parse_size(x)) for x in LITERALS], "literal string, low long, high long")
    met = files.join(F.broadcast(bounds), (F.coalesce("low", F.lit(0)) <= F.col("size")) & (F.col("size") <= F.coalesce("high", F.lit(2**62))))
    return met.select("id", "literal")


#: Names of folders, some of them too long, and searches, some of them blank.
GIVEN_NAME = "CASE WHEN size % 3 = 0 THEN repeat('n', cast(70 + size % 20 AS int)) ELSE '  ' || id || chr(10) END"
GIVEN_QUERY = "CASE WHEN size % 5 = 0 THEN '  ' ELSE chr(9) || 'ext:md ' END"


@register("txt9_trimmed_folder", "files", f"""SELECT id, CASE WHEN size % 5 <> 0 AND length(n) <= 80 THEN n END AS name, CASE WHEN size % 5 <> 0 AND length(n) <= 80 THEN 'ext:md' END AS query
  FROM (SELECT id, size, trim({GIVEN_NAME}, ' ' || chr(10)) AS n FROM files)""")
def _(files):
    saved = query.smart_folders(F.expr(GIVEN_NAME), F.expr(GIVEN_QUERY))
    return files.select("id", "size", saved.alias("saved")).select("id", "saved.name", "saved.query")


#: Rules for each file, of which some break one law or another.
NUMBER = "cast(substr(id, 2) AS bigint)"
GIVEN_DESTINATION = f"CASE {NUMBER} % 7 WHEN 0 THEN 'a/../b' WHEN 1 THEN '{{year}}' WHEN 2 THEN '/docs/{{YYYY}}/' ELSE 'docs/{{category}}' END"
LAWFUL = f"{NUMBER} % 83 BETWEEN 1 AND 80 AND {NUMBER} % 11 <> 0 AND {NUMBER} % 130 <= 120 AND size % 70 >= size % 50 AND {NUMBER} % 7 > 1"


@register("txt14_rule_sanitiser", "files", f"""SELECT id, {LAWFUL} AS valid, CASE WHEN {LAWFUL} THEN greatest(0, least(9999, ({NUMBER} * 37) % 20001 - 5000)) END AS priority,
  CASE WHEN {LAWFUL} THEN '["c++", "md", "tar"]' END AS extensions, CASE WHEN {LAWFUL} THEN CASE {NUMBER} % 7 WHEN 2 THEN 'docs/{{YYYY}}' ELSE 'docs/{{category}}' END END AS destination FROM files""")
def _(files):
    number = F.expr(NUMBER)
    extensions = F.when(number % 11 == 0, F.array(F.lit("a b"))).otherwise(F.array(*map(F.lit, (".MD", "c++", " ", "md", "..Tar"))))
    conditions = F.struct(extensions.alias("extensions"), F.repeat(F.lit("x"), (number % 130).cast("int")).alias("name_contains"), (F.col("size") % 50).alias("min_size"), (F.col("size") % 70).alias("max_size"))
    action = F.struct(F.expr(GIVEN_DESTINATION).alias("destination"))
    rule = F.struct(F.repeat(F.lit("n"), (number % 83).cast("int")).alias("name"), (number * 37 % 20001 - 5000).alias("priority"), conditions.alias("conditions"), action.alias("action"))
    told = files.select("id", rules.sanitized(F.to_json(rule)).alias("t"))
    part = lambda path: F.get_json_object("t.normal", path)
    return told.select("id", F.col("t.wrong").isNull().alias("valid"), part("$.priority").cast("long").alias("priority"), F.regexp_replace(part("$.conditions.extensions"), '","', '", "').alias("extensions"), part("$.action.destination").alias("destination"))


def _watched_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watcher of the tables' folder tells at its first poll."""
    path = new_path(spark, "watched")
    local = lambda address: re.sub("^file:/+", "/", address)
    rows = events.file_events(spark, local(sf_dir), local(path) + "/log")
    return _stream(rows, path, "watched").select("path", "event")


QUERIES["src9_watched_folder"] = _watched_folder
QUERIES["src1_directory_scan"] = lambda spark, sf_dir: directory.scan(spark, sf_dir).select("name", "size", "depth", "issue")
QUERIES["src2_scan_options"] = lambda spark, sf_dir: directory.scan(spark, sf_dir, exclude="labels.parquet", maxDepth="1", hidden="false", batchSize="3").select("name", "depth")
QUERIES["src3_observe"] = lambda spark, sf_dir: directory.scan(spark, sf_dir).select("path", "platform", "volume_id", "native_file_id", "generation", "size", "modified_at_ns")
QUERIES["src5_samples"] = lambda spark, sf_dir: content.file_hashes(directory.scan(spark, sf_dir).where("issue is null")).select("path", "quick")
QUERIES["src6_full_read"] = lambda spark, sf_dir: content.whole_files(spark, sf_dir).select("path", "size", "full")
QUERIES["src6_tree_hashes"] = lambda spark, sf_dir: content.tree_hashes(content.listed(spark, sf_dir), 1 << 16)
QUERIES["src1_listing_rounds"] = lambda spark, sf_dir: content.listed(spark, sf_dir).select("path", "size", "modified_at_ns")
QUERIES["src8_legacy_scan"] = lambda spark, sf_dir: directory.legacy_scan(spark, sf_dir, reserved=("documents.parquet",), recursive=True).select("name", "size")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(bind(spark, sf_dir, "files"))
