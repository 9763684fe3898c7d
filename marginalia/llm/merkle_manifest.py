"""A Merkle manifest of a dataset: parents keep the concatenated hashes of their children (their preimages), so a leaf's proof is
its ancestors' preimages without the leaf's own 64 characters in each.

Leaves of a lane (a language) ascend by doc_id, ties by the hash; every two neighbours become the hash of their concatenation, a last
single one the hash of itself, until one is left, the subroot. Subroots in order of language (null first) are joined in the same way to the root.

The tree is built in tiers: GROUP neighbours of a lane meet in one row, which holds the preimages of all their ancestors up to one node;
those nodes are the next tier's leaves. A lane may hold all rows: its positions come from ranges, and no task sees more
than groups of GROUP. Paths are put together from the top down on tables a GROUPth in size each, so the leaves themselves are dealt out
once, by group, and meet their upper ancestors where they are.

Defined results: a null field is hashed as `-`, an empty text as `0:`; repeated doc_ids, and repeated rows, are leaves of their own; a null
doc_id comes first and is not tampered with; an empty table has no rows, and a root of none; a text of any length is hashed whole;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.numbering import numbered

from .common import Scratch, table

#: Levels of a tier, and so the leaves that meet in a row.
LEVELS = 8
GROUP = 1 << LEVELS
#: A hash as hexadecimal text.
HEX = 64
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """`-` for null, else the length in bytes and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The hash of a row's FIELDS, some of them replaced."""
    return sha(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lane, hash, start: the leaf, and what its path is folded from, which for every TAMPERED-th crc32 of an id is a leaf with one more in n_chars.

    A lane is `-` for a null language, `=` and the language for others, so lanes sort as languages do.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    changed = leaf_hash(n_chars=(F.col("n_chars").cast("decimal(20,0)") + 1))
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("lane"), leaf_hash().alias("hash"), F.when(tampered, changed).alias("changed")).select(
        "doc_id", "lane", "hash", F.coalesce("changed", "hash").alias("start")
    )


def preimages(hashes: Column, levels: Column) -> Column:
    """An array for each level above the hashes, of what its nodes are hashes of."""
    pair = lambda h: F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / 2).cast("int")), lambda i: F.concat(F.get(h, 2 * i), F.coalesce(F.get(h, 2 * i + 1), F.lit(""))))
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    below = lambda found: F.when(F.size(found) == 0, hashes).otherwise(F.transform(F.try_element_at(found, F.lit(-1)), sha))
    return F.aggregate(steps, F.array().cast("array<array<string>>"), lambda found, _: F.concat(found, F.array(let(below(found), pair))))


def tier(nodes: DataFrame, key: list[str], payload: list[str] = ()) -> DataFrame:
    """key, pos (of the group in its lane), of (groups in the lane), nodes, preimages and hash (of the node that the group comes to) of nodes (key, pos, of, hash)."""
    rows = nodes.withColumn("group", F.shiftright("pos", LEVELS)).groupBy(*key, "group", "of").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", *payload))).alias("nodes"))
    levels = F.least(F.lit(LEVELS), F.when(F.col("of") > 1, F.length(F.bin(F.col("of") - 1))).otherwise(F.lit(0)))
    grown = rows.withColumn("hashes", F.col("nodes.hash")).withColumn("preimages", preimages(F.col("hashes"), levels))
    top = F.when(F.size("preimages") == 0, F.get("hashes", F.lit(0))).otherwise(sha(F.get(F.try_element_at("preimages", F.lit(-1)), F.lit(0))))
    return grown.select(*key, F.col("group").alias("pos"), F.shiftright(F.col("of") + (GROUP - 1), LEVELS).alias("of"), "nodes", "preimages", top.alias("hash"))


def tiers(scratch: Scratch, nodes: DataFrame, key: list[str], payload: list[str] = ()) -> list[DataFrame]:
    """Tables of groups, from the leaves' up to the one in which each lane is one group."""
    found = [scratch.keep(tier(nodes, key, payload), "tier")]
    while (found[-1].agg(F.max("of")).first()[0] or 0) > 1:
        found.append(scratch.keep(tier(found[-1].select(*key, "pos", "of", "hash"), key), "tier"))
    return found


#: The nodes of a group, each with its ancestors' preimages in the group and its own place in them, from the bottom up.
OWN = "transform(nodes, (x, i) -> struct(x AS node, transform(preimages, (p, j) -> struct(get(p, shiftright(i, j + 1)) AS preimage, shiftright(i, j) & 1 AS slot)) AS path))"


def paths(groups: DataFrame, above: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """The groups' nodes with their whole path; above (key, pos, path, carried) has the groups' own."""
    met = groups.select(*key, "pos", F.expr(OWN).alias("own")).join(above.withColumnRenamed("path", "upper"), [*key, "pos"])
    rows = met.select(*key, "upper", *carried, F.explode("own").alias("own"))
    return rows.select(*key, "own.node.*", F.concat("own.path", "upper").alias("path"), *carried)


def siblings(path: Column) -> Column:
    """The hashes of the others in each preimage of a path."""
    cut = lambda p: F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * HEX), F.substr(p["preimage"], p["slot"] * HEX + HEX + 1))
    return F.array_join(F.transform(path, cut), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path come to: each preimage with the hash so far in the leaf's place, hashed."""
    splice = lambda h, p: sha(F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * HEX), h, F.substr(p["preimage"], p["slot"] * HEX + HEX + 1)))
    return F.aggregate(path, start, splice)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, start, path, subroot, root of every row of docs."""
    scratch = Scratch(docs.sparkSession, "merkle")
    placed = numbered(scratch.keep(leaves(docs), "leaves"), ["lane"], ["doc_id", "hash", "start"], "pos")
    lanes = tiers(scratch, placed.withColumnRenamed("pos_of", "of"), ["lane"], ["doc_id", "start"])
    subroots = lanes[-1].select("lane", F.col("hash"))
    roots = tiers(scratch, numbered(subroots, [], ["lane"], "pos").withColumnRenamed("pos_of", "of"), [], ["lane"])
    none = F.array().cast("array<struct<preimage:string,slot:int>>")
    above = roots[-1].select("pos", none.alias("path"), F.col("hash").alias("root"))
    for groups in reversed(roots[1:]):
        above = paths(groups, above, [], ["root"]).drop("hash")
    above = paths(roots[0], above, [], ["root"]).select("lane", F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("subroot"), "root")
    for groups in reversed(lanes[1:]):
        above = scratch.keep(paths(groups, above, ["lane"], ["subroot", "root"]).drop("hash"), "paths")
    return paths(lanes[0], above, ["lane"], ["subroot", "root"]).select("doc_id", F.col("hash").alias("leaf"), "start", "path", "subroot", "root")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(table(spark, sf_dir, "documents")).withColumn("folded_root", folded(F.col("start"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", sha(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


def _tree_sql(name: str, start: str) -> str:
    """All levels of each tree, as lists of hashes; start gives (key, hashes)."""
    grown = "list_transform(range(0, (len(hashes) + 1) // 2), lambda i: sha256(hashes[2 * i + 1] || coalesce(hashes[2 * i + 2], '')))"
    return f"{name} AS (SELECT key, 0 AS level, hashes FROM ({start}) UNION ALL SELECT key, level + 1, {grown} FROM {name} WHERE len(hashes) > 1)"


#: A leaf's place is followed up its language's levels and the root's; each step has the sibling there, if any, and whether it comes first.
ORACLE = f"""WITH RECURSIVE c(k, v) AS (SELECT k, list_reduce(list_prepend(k, range(0, 8)), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM (SELECT unnest(range(0::BIGINT, 256::BIGINT)) AS k)),
tab AS (SELECT list(v ORDER BY k) AS t FROM c),
d AS (SELECT doc_id, lang, sha256({' || '.join(map(_field_sql, FIELDS))}) AS leaf, sha256({' || '.join(_field_sql(f) if f != 'n_chars' else _field_sql('(n_chars + 1)') for f in FIELDS)}) AS changed,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % {TAMPERED} = 0 AS tampered FROM documents, tab),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_tree_sql('t', 'SELECT lang AS key, list(leaf ORDER BY pos) AS hashes FROM p GROUP BY lang')},
s AS (SELECT key AS lang, hashes[1] AS subroot, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS lane FROM t WHERE len(hashes) = 1),
{_tree_sql('u', "SELECT 0 AS key, list(subroot ORDER BY lane) AS hashes FROM s")},
steps AS (SELECT lang, level, hashes, false AS upper FROM (SELECT key AS lang, level, hashes FROM t WHERE len(hashes) > 1) UNION ALL SELECT s.lang, u.level, u.hashes, true FROM s, u WHERE len(u.hashes) > 1),
w AS (SELECT p.doc_id, p.leaf, p.pos, p.lang, x.n, CASE WHEN x.at % 2 = 1 THEN x.hashes[x.at] ELSE '' END AS l, CASE WHEN x.at % 2 = 0 THEN coalesce(x.hashes[x.at + 2], '') ELSE '' END AS r
 FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang, LATERAL (SELECT steps.hashes, (CASE WHEN upper THEN s.lane ELSE p.pos END) // (2 ** level)::BIGINT AS at, row_number() OVER (ORDER BY upper, level) AS n FROM steps WHERE steps.lang IS NOT DISTINCT FROM p.lang) x),
f AS (SELECT doc_id, leaf, pos, lang, 0 AS n, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM p
 UNION ALL SELECT f.doc_id, f.leaf, f.pos, f.lang, w.n, sha256(w.l || f.h || w.r) FROM f JOIN w ON w.pos = f.pos AND w.lang IS NOT DISTINCT FROM f.lang AND w.n = f.n + 1),
e AS (SELECT pos, lang, arg_max(h, n) AS folded_root FROM f GROUP BY pos, lang),
q AS (SELECT p.*, coalesce(x.proof, '') AS proof FROM p LEFT JOIN (SELECT pos, lang, string_agg(l || r, '' ORDER BY n) AS proof FROM w GROUP BY pos, lang) x ON x.pos = p.pos AND x.lang IS NOT DISTINCT FROM p.lang)
SELECT q.doc_id, q.leaf, s.subroot, o.root, sha256(q.proof) AS proof_sha256, e.folded_root, e.folded_root = o.root AS verified
FROM q JOIN s ON q.lang IS NOT DISTINCT FROM s.lang JOIN e ON e.pos = q.pos AND e.lang IS NOT DISTINCT FROM q.lang, (SELECT hashes[1] AS root FROM u WHERE len(hashes) = 1) o"""
