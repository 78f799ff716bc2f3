"""Every query with SQL gives the rows that DuckDB finds on the same tables."""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import unicodedata
from pathlib import Path

import duckdb
import pytest

from shelfmark.catalog import sql as bound
from shelfmark.operators import classify
from shelfmark.queries import NOW_NS, QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    wanted = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = wanted.fetchall()
    order = sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in found.collect())
    theirs = sorted(tuple(plain(r[wanted.columns.index(c)]) for c in order) for r in rows)
    assert mine == theirs


def test_folded_names_of_files_changed_later(spark, tmp_path):
    """The names of files changed after ``NOW_NS`` (doc_id 1158 to 1999 of each 2000) count too."""
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT doc_id * 37 AS doc_id, text, lang, source, n_chars FROM '{DATA}/documents.parquet' WHERE doc_id < 60) TO '{tmp_path}/documents.parquet'")
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    wanted = sorted(duck.sql(SQL["flt11_folded_names"]).fetchall())
    later = duck.sql(f"SELECT count(*) FROM ({bound('files')}) WHERE modified_at_ns > {NOW_NS}").fetchall()[0][0]
    assert later and sorted(map(tuple, QUERIES["flt11_folded_names"](spark, str(tmp_path)).collect())) == wanted


def tree():
    """Name, path and depth of the files of the sample's folder, by walking it."""
    top = Path(DATA).resolve()
    for path in sorted(top.rglob("*")):
        if path.is_file() and not path.is_symlink():
            yield path.name, path, len(path.relative_to(top).parts) - 1


def samples(data):
    out = hashlib.sha256(str(len(data)).encode())
    for at in sorted({0, max(0, (len(data) - 65536) // 2), max(0, len(data) - 65536)}):
        out.update(at.to_bytes(8, "little") + data[at : at + 65536])
    return out.hexdigest()


def hash_tree(data, segment=1 << 16):
    parts = [data[i : i + segment] for i in range(0, len(data), segment)] or [b""]
    return hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()


def votes(text):
    """The fingerprint of a text, one vote after the other."""
    plain = "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())
    sums = [0] * 64
    for gram in [plain[i : i + 3] for i in range(len(plain) - 2)] or [plain]:
        value = int.from_bytes(hashlib.sha256(gram.encode()).digest()[:8], "little")
        sums = [s + (1 if value >> b & 1 else -1) for b, s in enumerate(sums)]
    value = sum(1 << b for b, s in enumerate(sums) if s >= 0)
    return value - 2**64 if value >> 63 else value


@functools.cache
def prints():
    rows = duckdb.sql(f"SELECT 'f' || doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    return {i: votes(t) for i, t in rows}


def similar():
    classes = {}
    for i, h in prints().items():
        classes[h] = min(i, classes.get(h, i))
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    links = {(x, y, 1 - near(a, b) / 64) for a, x in classes.items() for b, y in classes.items() if x < y and near(a, b) <= 3}
    return links | {(classes[h], i, 1.0) for i, h in prints().items() if i != classes[h]}


def rule_plan():
    """Names of the legacy plan, given one after the other in each folder."""
    rows = duckdb.sql(f"WITH documents AS (SELECT * FROM '{DATA}/documents.parquet') SELECT id, path, size, modified_at_ns FROM ({bound('files')})").fetchall()
    taken, out = set(), set()
    made = []
    for i, path, size, at in rows:
        name, age = path.rsplit("/", 1)[1], (NOW_NS - at) / 86_400e9
        ext = name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
        moment = datetime.datetime.fromtimestamp(at // 10**9, datetime.UTC)
        if ext in ("pdf", "docx") and "report" in name.casefold() and age >= 0:
            folder = f"reports/{moment:%Y}"
        elif age >= 900:
            folder = f"old/{category(ext)}"
        elif size <= 1000 and 0 <= age <= 800:
            folder = "small"
        else:
            continue
        made.append((folder, name.lower(), path, i, name))
    for folder, _, _, i, name in sorted(made):
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        number, chosen = 0, name
        while (folder, chosen.casefold()) in taken:
            number += 1
            chosen = f"{stem} ({number}){dot}{ext}"
        taken.add((folder, chosen.casefold()))
        out.add((folder, i, chosen))
    return out


def category(ext):
    tables = (classify.GROUPS, classify.MEDIA_TYPES)
    return next((label for t in tables for label, known in t.items() if ext in known), classify.OTHER_GROUP)


#: For queries that SQL can't express: the columns compared, and what they must hold.
BRUTE = {
    "anl2_text_simhash": (("id", "hash"), lambda: set(prints().items())),
    "anl3_similar_pairs": (("left_id", "right_id", "similarity"), similar),
    "anl8_rule_plan": (("folder", "id", "unique_name"), rule_plan),
    "src1_directory_scan": (("name", "size", "depth", "issue"), lambda: {(n, p.stat().st_size, d, None) for n, p, d in tree()}),
    "src2_scan_options": (("name", "depth"), lambda: {(n, d) for n, p, d in tree() if d <= 1 and not any(x.startswith(".") for x in p.relative_to(Path(DATA).resolve()).parts) and "labels.parquet" not in p.relative_to(Path(DATA).resolve()).parts[:-1]}),
    "src3_observe": (("path", "native_file_id", "size", "modified_at_ns"), lambda: {(str(p), str(p.stat().st_ino), p.stat().st_size, p.stat().st_mtime_ns) for _, p, _ in tree()}),
    "src5_samples": (("path", "quick"), lambda: {(str(p), samples(p.read_bytes())) for _, p, _ in tree()}),
    "src6_full_read": (("path", "size", "full"), lambda: {(str(p), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for _, p, _ in tree()}),
    "src6_tree_hashes": (("path", "size", "tree"), lambda: {(str(p), p.stat().st_size, hash_tree(p.read_bytes())) for _, p, _ in tree()}),
    "src1_listing_rounds": (("path", "size", "modified_at_ns"), lambda: {(str(p), p.stat().st_size, p.stat().st_mtime_ns) for _, p, _ in tree()}),
    "src9_watched_folder": (("path", "event"), lambda: {(str(p), "create") for _, p, _ in tree()}),
    "src8_legacy_scan": (("name", "size"), lambda: {(n, p.stat().st_size) for n, p, _ in tree() if n[0] != "." and p.relative_to(Path(DATA).resolve()).parts[0] != "documents.parquet" or (n == "documents.parquet" and p.parent == Path(DATA).resolve())}),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_against_brute_force(spark, name):
    columns, wanted = BRUTE[name]
    rows = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()]
    assert set(rows) == wanted() and len(rows) == len(set(rows)) > 0
