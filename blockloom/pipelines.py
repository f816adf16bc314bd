"""Registered queries of the core's data-pipeline problems, over their whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import drift, features, hierarchy, structure
from blockloom.session import materialize
from blockloom.sources.tables import load, normal




def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every non-null element of the nested collections of each transaction."""
    return structure.flatten(load(spark, root, "sol_transactions"), structure.TRANSACTION_KEYS, structure.TRANSACTION_NESTED, structure.TRANSACTION_CHILDREN)


def p2_lookup_indexes(spark: SparkSession, root: str) -> DataFrame:
    """The lookups' index elements linked to their lookup's account key: two of the flat tables joined along their link."""
    flat = p2_found(spark, root)
    flat, _ = materialize(flat.where(F.col("child").startswith("lookup")))
    tables = structure.related_tables(flat, structure.TRANSACTION_CHILDREN)
    parents = tables["lookup"].select("block_number", "transaction_index", F.col("pos").alias("parent_pos"), F.col("value").alias("account_key"))
    children = tables["lookup_readonly"].withColumn("writable", F.lit(False)).unionByName(tables["lookup_writable"].withColumn("writable", F.lit(True)))
    return children.join(parents, ["block_number", "transaction_index", "parent_pos"]).select("block_number", "transaction_index", "parent_pos", "pos", "writable", "account_key", F.col("value").cast("int").alias("index"))


def _raw_lines(spark: SparkSession, root: str) -> DataFrame:
    raw = load(spark, root, "raw_files")
    return materialize(drift.parse(raw, "feed", "file_no", "line_no", "payload", [drift.TRANSACTION_KEY, drift.FILL_KEY]))[0]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Every change between consecutive files of a feed."""
    return drift.changes(_raw_lines(spark, root), load(spark, root, "raw_files").select("feed", "file_no"))


def _of_kind(spark: SparkSession, root: str, key: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The lines of a kind (those with the kind's second key) and the correspondences of their names."""
    lines = _raw_lines(spark, root).where(F.exists("fields", lambda x: x["name"] == key[1]))
    return lines, drift.matches(lines)


def p4_transactions(spark: SparkSession, root: str) -> DataFrame:
    """All transactions of all files in one consistent table."""
    return drift.unify(*_of_kind(spark, root, drift.TRANSACTION_KEY), drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS)


def p4_fills(spark: SparkSession, root: str) -> DataFrame:
    """All fills of all files in one consistent table."""
    return drift.unify(*_of_kind(spark, root, drift.FILL_KEY), drift.FILL_KEY, drift.FILL_FIELDS)


def p4_uncastable(spark: SparkSession, root: str) -> DataFrame:
    """How many values of each field of both tables can't be cast to the field's type."""
    parts = [drift.uncastable(*_of_kind(spark, root, key), key, fields).groupBy("field").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "field", "n") for kind, key, fields in (("transaction", drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS), ("fill", drift.FILL_KEY, drift.FILL_FIELDS))]
    return parts[0].unionByName(parts[1])


_FILL_EVENT = ["block_number", "fill_index"]


def p5_features(spark: SparkSession, root: str) -> DataFrame:
    """One row per user: count, total closed_pnl and last time of each kind of dir."""
    fills = load(spark, root, "fills")
    table = features.feature_table(fills, normal("user"), features.type_name("dir"), F.col("time"), F.col("closed_pnl"), _FILL_EVENT)
    return table.withColumnRenamed("entity", "user")


def p5_entries(spark: SparkSession, root: str) -> DataFrame:
    """The same in rows (user, kind): the sparse vectors' entries with their type names."""
    fills = load(spark, root, "fills")
    rows = features.events(fills, normal("user"), features.type_name("dir"), F.col("time"), F.col("closed_pnl"), _FILL_EVENT)
    return features.entries_by_name(rows).select(F.col("entity").alias("user"), "kind", "n", F.round("total", 6).alias("total"), "last")


#: Types for a table of fixed columns, as partial tables of different days need it; ``withdraw`` doesn't occur.
KINDS = ("buy", "close long", "close short", "none", "open long", "open short", "sell", "withdraw")


def p5_chosen(spark: SparkSession, root: str) -> DataFrame:
    """One row per user with columns for a fixed list of kinds, merged from the entries of two parts of the table's days; other kinds are left out."""
    fills = load(spark, root, "fills").select(*_FILL_EVENT, "user", "dir", "time", "closed_pnl").distinct()
    odd = F.coalesce(F.pmod(F.unix_date(F.to_date("time")), F.lit(2)), F.lit(0)) == 1
    parts = [features.entries(features.events(df, normal("user"), features.type_name("dir"), F.col("time"), F.col("closed_pnl"), _FILL_EVENT), KINDS) for df in (fills.where(odd), fills.where(~odd))]
    return features.expand(features.vectors(features.merge(parts[0].unionByName(parts[1]))), KINDS).withColumnRenamed("entity", "user")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Headers on or behind a cycle."""
    tree = hierarchy.hierarchy(load(spark, root, "hl_blocks"), "hash", "parent_hash", "number", with_paths=False)
    return tree.where("cycle is not null").select(F.col("id").alias("hash"), F.col("cycle").alias("cycle_hash"), "hops")


def _tree(tree: DataFrame) -> DataFrame:
    return tree.select(F.col("id").alias("hash"), "root", F.coalesce("depth", F.lit(-1)).alias("depth"), F.array_join("path", "/").alias("path"), F.when(F.coalesce("hops", F.lit(1)) > 0, F.col("descendants")).otherwise(-1).alias("descendants"), F.col("cycle").alias("cycle_hash"))


def p6_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    """Every header's root, depth, path and number of descendants; depth -1 for headers on or behind a cycle, descendants -1 for those on one."""
    return _tree(hierarchy.hierarchy(load(spark, root, "hl_blocks"), "hash", "parent_hash", "number"))


def p6_any_order(spark: SparkSession, root: str) -> DataFrame:
    """The same from an order column that says nothing: almost all links cross buckets where there are several."""
    return _tree(hierarchy.hierarchy(load(spark, root, "hl_blocks"), "hash", "parent_hash", F.crc32(normal("hash"))))


def p6_descendants(spark: SparkSession, root: str) -> DataFrame:
    """All descendants of every header that has a root, with their distance."""
    return hierarchy.descendants(hierarchy.hierarchy(load(spark, root, "hl_blocks"), "hash", "parent_hash", "number"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_lookup_indexes, p4_found, p4_transactions, p4_fills, p4_uncastable, p5_features, p5_entries, p5_chosen, p6_found, p6_hierarchy, p6_any_order, p6_descendants)
}

_T = "WITH t AS (SELECT DISTINCT block_number, transaction_index, signatures AS s, address_table_lookups AS l, loaded_addresses AS a FROM sol_transactions)"


def _elements(source: str, child: str, column: str, parent: str = "-1") -> str:
    return f"SELECT block_number, transaction_index, '{child}' AS child, CAST({parent} AS INTEGER) AS parent_pos, CAST(i - 1 AS INTEGER) AS pos, CAST({column}[i] AS VARCHAR) AS value FROM (SELECT *, unnest(range(1, len({column}) + 1)) AS i FROM {source}) WHERE {column}[i] IS NOT NULL"


_L = "(SELECT block_number, transaction_index, j - 1 AS p, l[j] AS e, l[j].readonly_indexes AS r, l[j].writable_indexes AS w FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM t))"
_A = "(SELECT block_number, transaction_index, a.readonly AS r, a.writable AS w FROM t)"
_P2 = " UNION ALL ".join(
    [
        _elements("t", "signature", "s"),
        f"SELECT block_number, transaction_index, 'lookup', -1, CAST(p AS INTEGER), coalesce(e.account_key, '') FROM {_L} WHERE e IS NOT NULL",
        _elements(_L, "lookup_readonly", "r", "p"),
        _elements(_L, "lookup_writable", "w", "p"),
        _elements(_A, "loaded_readonly", "r"),
        _elements(_A, "loaded_writable", "w"),
    ]
)
_EVENTS = """SELECT DISTINCT block_number, fill_index, lower(trim("user", ' ')) AS "user",
    CASE WHEN coalesce(trim(regexp_replace(dir, '[\\s_\\-]+', ' ', 'g'), ' '), '') = '' THEN 'none' ELSE lower(trim(regexp_replace(dir, '[\\s_\\-]+', ' ', 'g'), ' ')) END AS kind,
    "time", CASE WHEN isnan(closed_pnl) THEN NULL ELSE closed_pnl END AS v FROM fills WHERE coalesce(trim("user", ' '), '') <> ''"""
_ENTRIES = f'SELECT "user", kind, count(*) AS n, round(sum(v), 6) AS total, max("time") AS "last" FROM ({_EVENTS}) GROUP BY 1, 2'


def _wide(kinds: Sequence[str], only: bool = False) -> str:
    """One row per user and three columns per kind; ``only``: users with an event of one of them."""
    quoted = lambda k: "'" + k.replace("'", "''") + "'"
    columns = ", ".join(f"""coalesce(max(n) FILTER (kind = {quoted(k)}), 0) AS "{k}_n", max(total) FILTER (kind = {quoted(k)}) AS "{k}_total", max("last") FILTER (kind = {quoted(k)}) AS "{k}_last\"""" for k in kinds)
    return f"""SELECT "user", {columns} FROM ({_ENTRIES}) {"WHERE kind IN (" + ", ".join(map(quoted, kinds)) + ")" if only else ""} GROUP BY 1"""


def features_sql(root: str) -> str | None:
    """The SQL of p5_features over a directory: its columns are the kinds that occur there. None where it isn't there."""
    try:
        spellings = pq.read_table(f"{root}/fills.parquet", columns=["dir", "user"])
    except OSError:
        return None
    known = {d for d, u in zip(*(c.to_pylist() for c in spellings.columns)) if u is not None and u.strip(" ")}
    return _wide(sorted({re.sub(r"[\s_\-]+", " ", d or "").strip(" ").lower() or "none" for d in known}))


_WALK = """WITH RECURSIVE h AS (SELECT lower(trim(hash, ' ')) AS id, min(CASE WHEN lower(trim(parent_hash, ' ')) IN ('', '0x') THEN NULL ELSE lower(trim(parent_hash, ' ')) END) AS p
    FROM hl_blocks WHERE lower(trim(hash, ' ')) NOT IN ('', '0x') GROUP BY 1),
  links AS (SELECT c.id, c.p FROM h c JOIN h q ON c.p = q.id),
  above AS (SELECT id, p AS a FROM links UNION SELECT x.id, l.p FROM above x JOIN links l ON x.a = l.id),
  rings AS (SELECT id FROM above WHERE id = a),
  caught AS (SELECT id, min(a) AS cycle_hash FROM (SELECT id, a FROM above WHERE a IN (SELECT id FROM rings)) GROUP BY 1)"""

#: The definition of a change spelled out: values of complete lines by dotted name, files with the one before, shared records.
_P4 = """WITH v AS (SELECT r.feed, r.file_no, r.line_no, substr(t.fullkey, 3) AS name, CASE t.type WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'NULL' THEN NULL ELSE t.type END AS kind,
      CASE WHEN t.type = 'NULL' THEN NULL ELSE t.type || ' ' || CAST(t.value AS VARCHAR) END AS value
    FROM (SELECT * FROM raw_files WHERE json_valid(payload) AND json_type(payload) = 'OBJECT') r, json_tree(r.payload) t WHERE t.type <> 'OBJECT' AND t.fullkey NOT LIKE '%[%'),
  k AS (SELECT feed, file_no, line_no, max(CASE WHEN name = 'block_number' THEN value END) || '/' || coalesce(max(CASE WHEN name = 'transaction_index' THEN value END), max(CASE WHEN name = 'fill_index' THEN value END)) AS rec FROM v GROUP BY ALL),
  n AS (SELECT feed, file_no, name, coalesce(string_agg(DISTINCT kind, '+' ORDER BY kind), '') AS kinds FROM v GROUP BY ALL),
  f AS (SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS prev FROM (SELECT DISTINCT feed, file_no FROM raw_files)),
  d AS (SELECT f.feed, f.file_no, f.prev, coalesce(a.name, b.name) AS name, a.name IS NULL AS came, b.name IS NULL AS gone, a.kinds AS old_kinds, b.kinds AS kinds FROM f
    JOIN (SELECT feed, file_no, name FROM n UNION SELECT f2.feed, f2.file_no, n2.name FROM f f2 JOIN n n2 ON n2.feed = f2.feed AND n2.file_no = f2.prev) x ON x.feed = f.feed AND x.file_no = f.file_no
    LEFT JOIN n a ON a.feed = f.feed AND a.file_no = f.prev AND a.name = x.name LEFT JOIN n b ON b.feed = f.feed AND b.file_no = f.file_no AND b.name = x.name WHERE f.prev IS NOT NULL),
  s AS (SELECT f.feed, f.file_no, k1.rec, k1.line_no AS old_line, k2.line_no AS new_line, f.prev FROM f JOIN k k1 ON k1.feed = f.feed AND k1.file_no = f.prev JOIN k k2 ON k2.feed = f.feed AND k2.file_no = f.file_no AND k2.rec = k1.rec),
  p AS (SELECT g.feed, g.file_no, g.name AS old_name, c.name AS new_name FROM d g JOIN d c ON g.feed = c.feed AND g.file_no = c.file_no WHERE g.gone AND c.came),
  e AS (SELECT p.feed, p.file_no, p.old_name, p.new_name, bool_and(o.value IS NOT DISTINCT FROM w.value) AS same, count(o.value) AS known FROM p JOIN s ON s.feed = p.feed AND s.file_no = p.file_no
    LEFT JOIN v o ON o.feed = s.feed AND o.file_no = s.prev AND o.line_no = s.old_line AND o.name = p.old_name LEFT JOIN v w ON w.feed = s.feed AND w.file_no = s.file_no AND w.line_no = s.new_line AND w.name = p.new_name GROUP BY 1, 2, 3, 4),
  m AS (SELECT feed, file_no, old_name, new_name FROM e WHERE same AND known > 0)
  SELECT feed, file_no, 'renamed' AS change, old_name, new_name FROM m
  UNION ALL SELECT feed, file_no, 'removed', name, '' FROM d WHERE gone AND NOT EXISTS (SELECT 1 FROM m WHERE m.feed = d.feed AND m.file_no = d.file_no AND m.old_name = d.name)
  UNION ALL SELECT feed, file_no, 'added', '', name FROM d WHERE came AND NOT EXISTS (SELECT 1 FROM m WHERE m.feed = d.feed AND m.file_no = d.file_no AND m.new_name = d.name)
  UNION ALL SELECT feed, file_no, 'retyped', name, name FROM d WHERE NOT gone AND NOT came AND old_kinds <> '' AND kinds <> '' AND old_kinds <> kinds"""

#: What the names of sf0.01 stand for beside the documented fields; last parts without underlines and case.
_MEANING = {"costunits": "cost_units", "computeunitsconsumed": "compute_units_consumed", "clientoid": "cloid", "twap": "twap_id", "twapid": "twap_id", "parenttwap": "twap_id"}


def _united_sql(key: tuple[str, str], fields: dict[str, str], lost: str | None = None) -> str:
    """One table of a kind by these meanings: each record's last value of each field, cast to its type; ``lost``: the name of the kind, for
    the number of values of each field that can't be cast."""
    meaning = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MEANING.items())
    text = "CASE WHEN json_type(value) = 'ARRAY' AND json_array_length(value) = 1 THEN value ->> '$[0]' ELSE value ->> '$' END"
    number = "CASE WHEN regexp_matches(x, '^-?[0-9]+$') THEN CAST(x AS BIGINT) WHEN regexp_matches(x, '^0[xX][0-9a-fA-F]{1,15}$') THEN CAST(lower(x) AS BIGINT) WHEN TRY_CAST(x AS DOUBLE) = floor(TRY_CAST(x AS DOUBLE)) THEN CAST(TRY_CAST(x AS DOUBLE) AS BIGINT) END"
    truth = "CASE WHEN lower(trim(x)) IN ('true', '1', '1.0', 'yes', 't', 'y') THEN true WHEN lower(trim(x)) IN ('false', '0', '0.0', 'no', 'f', 'n') THEN false END"
    casts = {"string": "x", "long": number, "double": "TRY_CAST(x AS DOUBLE)", "boolean": truth, "array<string>": "CASE WHEN json_type(value) = 'ARRAY' THEN CAST(value AS VARCHAR[]) ELSE [value ->> '$'] END"}
    columns = ", ".join(f"max({casts[kind]}) FILTER (field = '{name}') AS {name}" for name, kind in fields.items())
    failed = " ".join(f"WHEN '{name}' THEN ({casts[kind]}) IS NULL" for name, kind in fields.items())
    result = f"SELECT k0 AS {key[0]}, k1 AS {key[1]}, {columns} FROM l GROUP BY 1, 2" if lost is None else f"SELECT '{lost}' AS kind, field, count(*) AS n FROM l WHERE CASE field {failed} ELSE false END GROUP BY 2"
    return f"""WITH v AS (SELECT r.file_no, r.line_no, CAST(r.payload ->> '$.{key[0]}' AS BIGINT) AS k0, CAST(r.payload ->> '$.{key[1]}' AS BIGINT) AS k1, substr(t.fullkey, 3) AS name, t.value
        FROM (SELECT * FROM raw_files WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND (payload ->> '$.{key[1]}') IS NOT NULL) r, json_tree(r.payload) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%'),
      n AS (SELECT *, lower(replace(regexp_replace(name, '^.*[.]', ''), '_', '')) AS short FROM v),
      f AS (SELECT *, CASE short {meaning} ELSE regexp_replace(name, '^.*[.]', '') END AS field FROM n),
      l AS (SELECT k0, k1, field, value, {text} AS x FROM f QUALIFY row_number() OVER (PARTITION BY k0, k1, field ORDER BY file_no DESC, line_no DESC, name DESC) = 1)
      {result}"""


SQL: dict[str, str] = {
    "p4_transactions": _united_sql(drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS),
    "p4_fills": _united_sql(drift.FILL_KEY, drift.FILL_FIELDS),
    "p4_uncastable": f"SELECT * FROM ({_united_sql(drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS, 'transaction')}) UNION ALL SELECT * FROM ({_united_sql(drift.FILL_KEY, drift.FILL_FIELDS, 'fill')})",
    "p4_found": _P4,
    "p2_found": f"{_T} {_P2}",
    "p2_lookup_indexes": f"""{_T}, f AS ({_P2}) SELECT c.block_number, c.transaction_index, c.parent_pos, c.pos, c.child = 'lookup_writable' AS writable, p.value AS account_key, CAST(c.value AS INTEGER) AS "index"
        FROM f c JOIN f p ON p.child = 'lookup' AND c.child IN ('lookup_readonly', 'lookup_writable') AND p.block_number = c.block_number AND p.transaction_index = c.transaction_index AND p.pos = c.parent_pos""",
    "p5_chosen": _wide(KINDS, only=True),
    "p5_entries": _ENTRIES,
    "p6_found": f"""{_WALK} SELECT id AS hash, cycle_hash, (SELECT count(*) FROM above x WHERE x.id = c.id AND x.a NOT IN (SELECT id FROM rings)) + CASE WHEN c.id IN (SELECT id FROM rings) THEN 0 ELSE 1 END AS hops FROM caught c""",
    "p6_descendants": f"""{_WALK}, free AS (SELECT * FROM above WHERE id NOT IN (SELECT id FROM caught)), depths AS (SELECT id, count(*) AS d FROM free GROUP BY 1)
        SELECT f.a AS ancestor, f.id AS descendant, x.d - coalesce(y.d, 0) AS distance FROM free f JOIN depths x ON f.id = x.id LEFT JOIN depths y ON f.a = y.id""",
    "p6_hierarchy": f"""{_WALK}, down AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, id AS path FROM h WHERE id NOT IN (SELECT id FROM links) UNION ALL SELECT l.id, d.root, d.depth + 1, d.path || '/' || l.id FROM down d JOIN links l ON l.p = d.id),
        below AS (SELECT a AS id, count(*) AS n FROM above GROUP BY 1)
        SELECT h.id AS hash, d.root, coalesce(d.depth, -1) AS depth, d.path, CASE WHEN h.id IN (SELECT id FROM rings) THEN -1 ELSE coalesce(b.n, 0) END AS descendants, c.cycle_hash FROM h LEFT JOIN down d ON h.id = d.id LEFT JOIN caught c ON h.id = c.id LEFT JOIN below b ON h.id = b.id""",
}
SQL["p6_any_order"] = SQL["p6_hierarchy"]
