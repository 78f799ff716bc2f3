"""A Merkle manifest of a table: a digest of each row, a tree over each group, one root over all.

Rows of a group stand in order and are cut into aligned blocks of 8**4 leaves. Each task hands
blocks to DuckDB as Arrow tables; one ordered ``string_agg`` and one ``sha256`` for each level
give a block's root. Spark combines the blocks' roots, and then the groups' roots, in the
same way; a block gets the steps above it as one row, and its leaves' proofs are whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import positions
from .common import materialize, table

#: A run has 8 nodes, a power of two, so that places are bits of the position.
FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Levels of a block, which has up to FAN ** LEVELS leaves.
LEVELS = 4
#: Hex digits of a digest.
WIDTH = 64
STEPS = "array<struct<place:int,siblings:string>>"
#: One document in so many is tampered with, by the CRC-32 of its id.
TAMPERED = 3


def digest(*values: Column) -> Column:
    """SHA-256 over the values, each ``-`` if null, else the number of its UTF-8 bytes, ``:`` and itself."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown]), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give: each step puts the node between its siblings and hashes."""

    def up(node: Column, step: Column) -> Column:
        left = step["place"] * WIDTH
        return F.sha2(F.concat(F.substr(step["siblings"], F.lit(1), left), node, F.substr(step["siblings"], left + 1)), 256)

    return F.aggregate(steps, start, up)


def _climb(block: pa.Table):
    """DuckDB with a table of the runs of each level of ``block``, their number, and the last nodes in ``top``."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.register("leaves", block.select(["nth", "leaf"]))
    con.execute("CREATE TABLE top AS SELECT nth, leaf AS h FROM leaves")
    nodes, level = block["nodes"][0].as_py(), 0
    while nodes > 1 and level < LEVELS:
        con.execute(f"CREATE TABLE run{level} AS SELECT nth // {FAN} AS run, string_agg(h, '' ORDER BY nth) AS whole FROM top GROUP BY nth // {FAN}")
        con.execute(f"CREATE OR REPLACE TABLE top AS SELECT run AS nth, sha256(whole) AS h FROM run{level}")
        nodes, level = -(-nodes // FAN), level + 1
    return con, level


def _block_root(block: pa.Table) -> pa.Table:
    con, _ = _climb(block)
    with con:
        root = con.execute("SELECT h FROM top").fetchone()[0]
    return pa.table({"tree": block["tree"][:1], "block": block["block"][:1], "nodes": block["nodes"][:1], "root": pa.array([root])})


def _block_proofs(block: pa.Table, above: pa.Table) -> pa.Table:
    """The block's leaves with their steps inside it and those above it."""
    con, levels = _climb(block)
    steps, joins = [], []
    for level in range(levels):
        before = f"{WIDTH} * ((b.nth >> {FAN_BITS * level}) & {FAN - 1})"
        steps.append(f"{{'place': ({before} // {WIDTH})::INTEGER, 'siblings': substr(r{level}.whole, 1, {before}) || substr(r{level}.whole, {before} + {WIDTH + 1})}}")
        joins.append(f"JOIN run{level} r{level} ON r{level}.run = b.nth >> {FAN_BITS * (level + 1)}")
    own = f"[{', '.join(steps)}] || a.steps" if steps else "a.steps"
    with con:
        con.register("block", block)
        con.register("above", above)
        return con.sql(f"SELECT b.key, b.leaf, b.forged, {own} AS steps, a.subroot, a.root FROM block b CROSS JOIN above a {' '.join(joins)}").to_arrow_table()


def _combine(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes`` (tree, nth, h, n: the tree's nodes): its root for each tree, and the steps of each node.

    Each round groups by runs of at most 8 nodes and leaves an eighth of the rows.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    steps, level = nodes.select("tree", "nth", F.array().cast(STEPS).alias("steps")), 0
    while most > 1:
        run = F.shiftright("nth", FAN_BITS)
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "h"))), lambda x: x["h"]), "")
        runs = materialize(nodes.where("n > 1").groupBy("tree", run.alias("run"), "n").agg(inside.alias("whole")))
        nodes = runs.select("tree", F.col("run").alias("nth"), F.sha2("whole", 256).alias("h"), F.ceil(F.col("n") / FAN).alias("n")).union(nodes.where("n = 1"))
        place = F.shiftright("nth", FAN_BITS * level).bitwiseAND(F.lit(FAN - 1)).cast("int")
        siblings = F.concat(F.substr("whole", F.lit(1), WIDTH * place), F.substr("whole", WIDTH * place + WIDTH + 1))
        more = F.when(F.col("whole").isNotNull(), F.array(F.struct(place.alias("place"), siblings.alias("siblings")))).otherwise(F.array().cast(STEPS))
        parent = F.shiftright("nth", FAN_BITS * (level + 1)).alias("run")
        steps = steps.withColumn("run", parent).join(runs.drop("n"), ["tree", "run"], "left").select("tree", "nth", F.concat("steps", more).alias("steps"))
        most, level = -(-most // FAN), level + 1
    return nodes.select("tree", "h"), steps


def manifest(rows: DataFrame) -> DataFrame:
    """``key``, ``leaf``, ``forged``, ``steps``, ``subroot``, ``root`` of every row of ``rows`` (tree, key, leaf, forged).

    Leaves of a tree (a null is one too) stand by ``key`` (null first), then by digest. While a
    tree has several nodes, every 8 consecutive ones (the last run: fewer, even one) become the
    SHA-256 of their hex digests; what is left is its ``subroot``. Subroots in the order of trees
    (null first, then by bytes) give ``root`` likewise. ``steps`` is the proof: for each level up
    to the root, the run's other nodes and the leaf's place among them; ``fold`` rebuilds the
    root from it. ``forged`` is carried along. Rows that repeat are leaves each. An empty table
    has no rows and no root.

    A tree of any size is cut into blocks of 8**4 leaves, and no task holds more than a block.
    """
    placed = positions(rows, ["tree"], [F.col("key").asc_nulls_first(), F.col("leaf")])
    sizes = placed.groupBy(F.col("tree").alias("of")).agg(F.count(F.lit(1)).alias("nodes"))
    # A text of its own for each tree, null among them, that sorts as trees do.
    code = F.when(F.col("tree").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("tree").cast("string")))
    bits = FAN_BITS * LEVELS
    leaves = placed.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).select(
        code.alias("tree"), F.shiftright("position", bits).alias("block"), F.col("position").bitwiseAND(F.lit((1 << bits) - 1)).alias("nth"), "nodes", "key", "leaf", "forged"
    )
    blocks = materialize(leaves.groupBy("tree", "block").applyInArrow(_block_root, "tree string, block long, nodes long, root string"))
    subroots, inner = _combine(blocks.select("tree", F.col("block").alias("nth"), F.col("root").alias("h"), F.ceil(F.col("nodes") / (1 << bits)).alias("n")))
    tops = positions(subroots.withColumn("subroot", F.col("h")), [], [F.col("tree").asc()], "nth")
    trees = materialize(tops.select(F.lit("").alias("all"), "nth", "h", "tree"))
    root, outer = _combine(trees.select(F.col("all").alias("tree"), "nth", "h", F.lit(trees.count()).cast("long").alias("n")))
    above = outer.join(trees.select("nth", F.col("tree").alias("of"), F.col("h").alias("subroot")), "nth").join(root.select(F.col("tree").alias("all"), F.col("h").alias("root")), F.col("tree") == F.col("all"))
    above = above.select("of", F.col("steps").alias("later"), "subroot", "root")
    over = inner.join(above, F.col("tree") == F.col("of")).select("tree", F.col("nth").alias("block"), F.concat("steps", "later").alias("steps"), "subroot", "root")
    kind = dict(rows.dtypes)["key"]
    both = leaves.groupBy("tree", "block").cogroup(materialize(over).groupBy("tree", "block"))
    return both.applyInArrow(_block_proofs, f"key {kind}, leaf string, forged string, steps {STEPS}, subroot string, root string")


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    """The tree of all documents by language, and what tampering with every third id's text (A-Z in lower case) does.

    A null id is not tampered with; a null text stays null, and a text without A-Z as it is.
    """
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    values = {c: F.col(c) for c in COLUMNS}
    rows = docs.select(
        F.col("lang").alias("tree"), F.col("doc_id").alias("key"), digest(*values.values()).alias("leaf"), F.when(hit, digest(*(values | {"text": lower}).values())).alias("forged")
    )
    proven = manifest(materialize(rows)).withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("steps")))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: s["siblings"]), ""), 256)
    return proven.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode(cast({c} as varchar)))::varchar || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


OP13_SQL = f"""WITH RECURSIVE crc(i, step, v) AS (
    SELECT i, 0, i FROM range(256) x(i)
    UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE step < 8),
  codes AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE step = 8),
  docs AS (SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
      CASE WHEN xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {TAMPERED} = 0
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged FROM documents, codes),
  leaves AS (SELECT *, coalesce('=' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM docs),
  tree(l, g, p, h, n) AS (
    SELECT 0, g, p, leaf, count(*) OVER (PARTITION BY g) FROM leaves
    UNION ALL SELECT l + 1, g, p // 8, sha256(string_agg(h, '' ORDER BY p)), any_value((n + 7) // 8) FROM tree WHERE n > 1 GROUP BY l, g, p // 8),
  subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p FROM tree WHERE n = 1),
  top(l, p, h, n) AS (
    SELECT 0, p, h, count(*) OVER () FROM subroots
    UNION ALL SELECT l + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY l, p // 8),
  inner_steps AS (SELECT d.doc_id, d.leaf, d.g, d.p, r.l, (d.p >> 3 * r.l) & 7 AS place, r.whole
    FROM leaves d JOIN (SELECT l, g, p // 8 AS run, string_agg(h, '' ORDER BY p) AS whole FROM tree WHERE n > 1 GROUP BY l, g, p // 8) r ON r.g = d.g AND r.run = d.p >> 3 * (r.l + 1)),
  outer_steps AS (SELECT s.g, r.l + 1000 AS l, (s.p >> 3 * r.l) & 7 AS place, r.whole
    FROM subroots s JOIN (SELECT l, p // 8 AS run, string_agg(h, '' ORDER BY p) AS whole FROM top WHERE n > 1 GROUP BY l, p // 8) r ON r.run = s.p >> 3 * (r.l + 1)),
  steps AS (SELECT g, p, l, place, whole FROM inner_steps UNION ALL SELECT d.g, d.p, o.l, o.place, o.whole FROM leaves d JOIN outer_steps o ON o.g = d.g),
  sides AS (SELECT g, p, row_number() OVER (PARTITION BY g, p ORDER BY l) AS k, substr(whole, 1, 64 * place) AS a, substr(whole, 64 * place + 65) AS b FROM steps),
  proofs AS (SELECT g, p, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256 FROM sides GROUP BY g, p),
  folded(g, p, k, h) AS (
    SELECT g, p, 0::BIGINT, coalesce(forged, leaf) FROM leaves
    UNION ALL SELECT f.g, f.p, s.k, sha256(s.a || f.h || s.b) FROM folded f JOIN sides s ON s.g = f.g AND s.p = f.p AND s.k = f.k + 1),
  last AS (SELECT g, p, max_by(h, k) AS folded_root FROM folded GROUP BY g, p)
  SELECT d.doc_id, d.leaf, s.h AS subroot, t.h AS root, coalesce(o.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
  FROM leaves d JOIN subroots s ON s.g = d.g JOIN top t ON t.n = 1 LEFT JOIN proofs o ON o.g = d.g AND o.p = d.p JOIN last e ON e.g = d.g AND e.p = d.p"""
