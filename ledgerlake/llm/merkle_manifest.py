"""A Merkle manifest of documents, and what tampering with single rows makes of its root.

Rows are leaves, ordered by id within their language; every 8 consecutive nodes become one node until
one is left. The roots of all languages are the leaves of one more tree, whose root is the
manifest.

The tree is cut into aligned blocks of 512 leaves, three levels each. A task builds the part of the
tree inside a block; block roots are the leaves of the next round, which is cut into blocks in turn,
until every language is down to one node. A round passes on a 512th of its nodes. The way from a
block's root up to the manifest, with the siblings on each level, is the same for all leaves of the
block, so it is handed down once per block.

The tree is persistent: a tampered leaf makes a new version, which copies the ancestors of that leaf
inside its block and shares all other nodes with the original; it goes on from the block's root up the
handed-down way, again copying only ancestors. Versions are never in one place: each is folded where
its block is. A leaf's proof is the siblings of these ancestors.

Positions in the order come from range partitions: each counts its rows, and starts where the earlier
ones end. A language that holds most rows is just more partitions and more blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.tables import stored

FAN = 8
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_NODES = "tree string, at long, total long, hash binary"
_WAYS = "tree string, at long, lefts array<binary>, rights array<binary>, subroot binary, root binary"
MANIFEST = (
    "doc_id long, tree string, at long, leaf string, subroot string, root string, "
    "proof_sha256 string, folded_root string, verified boolean"
)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its number of bytes, a colon and its bytes, or "-" if NULL."""

    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(told(f) for f in fields)), 256))


def is_tampered(doc_id: Column) -> Column:
    """Whether 3 divides the checksum of the id in decimals; a NULL id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): tampered is NULL for rows that are left as they are."""
    changed = {"text": F.translate("text", _UPPER, _UPPER.lower())}
    lang = F.col("lang").cast("string")
    return docs.select(
        F.when(lang.isNull(), "-").otherwise(F.concat(F.lit("="), lang)).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash([F.col(f) for f in FIELDS]).alias("leaf"),
        F.when(
            is_tampered(F.col("doc_id")), leaf_hash([changed.get(f, F.col(f)) for f in FIELDS])
        ).alias("tampered"),
    )


def positions(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Adds at (from 0 in the tree, by `order`, NULL first) and total (rows of the tree)."""
    # a number of their own keeps any number of equal rows from falling into one range
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), f"{label}-rows")
    by = ["tree", *order, "_row"]
    placed = numbered.repartitionByRange(*by).sortWithinPartitions(*by)
    # such ids hold the partition and, in the order of its rows, the place in it
    placed = stored(
        placed.withColumn("_id", F.monotonically_increasing_id()).withColumn(
            "_part", F.shiftright("_id", 33)
        ),
        f"{label}-placed",
    )
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("tree", "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .select(
            "tree",
            "_part",
            "_first",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy("tree")).alias("total"),
        )
    )
    return (
        placed.join(starts, ["tree", "_part"])
        .withColumn("at", F.col("_id") - F.col("_first") + F.col("_before"))
        .drop("_row", "_id", "_part", "_first", "_before")
    )


def _parent(hexes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


def block_levels(total: int) -> int:
    """Levels that a block goes up in a tree of `total` nodes: three, or fewer to the root."""
    levels = 0
    while total > 1 and levels < BLOCK_LEVELS:
        total, levels = -(-total // FAN), levels + 1
    return levels


def block_nodes(hexes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of a block, from its leaves up."""
    nodes = [hexes]
    for _ in range(levels):
        below = nodes[-1]
        nodes.append([_parent(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    return nodes


def way_up(nodes: list[list[bytes]], at: int) -> tuple[list[bytes], list[bytes]]:
    """On each level of the block the siblings of the leaf's ancestor, left of it and right of it."""
    lefts, rights = [], []
    for level in nodes[:-1]:
        first = at // FAN * FAN
        lefts.append(b"".join(level[first:at]))
        rights.append(b"".join(level[at + 1 : first + FAN]))
        at //= FAN
    return lefts, rights


def new_version(leaf: bytes, lefts: Sequence[bytes], rights: Sequence[bytes]) -> list[bytes]:
    """The nodes that a version with this leaf has of its own: the leaf, then its new ancestors."""
    own = [leaf]
    for left, right in zip(lefts, rights, strict=True):
        own.append(_parent((left, own[-1], right)))
    return own


def _in_order(block: pa.Table) -> tuple[pa.Table, list[bytes], int, int]:
    """The block by position, its hashes, the position of its first row, and its levels."""
    block = block.sort_by("at")
    hexes = [h.hex().encode() for h in block["hash"].to_pylist()]
    return block, hexes, block["at"][0].as_py(), block_levels(block["total"][0].as_py())


def _block_root(block: pa.Table) -> pa.Table:
    tree, total = block["tree"][0].as_py(), block["total"][0].as_py()
    _, hexes, first, levels = _in_order(block)
    root = block_nodes(hexes, levels)[-1][0]
    row = [tree, first // BLOCK, -(-total // BLOCK), bytes.fromhex(root.decode())]
    names = ("tree", "at", "total", "hash")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds, strict=True)})


def _block_roots(nodes: DataFrame, label: str) -> DataFrame:
    """One round up: the roots of all blocks, which are the nodes of the next round."""
    blocks = nodes.select("tree", "at", "total", "hash", F.expr(f"at div {BLOCK}").alias("block"))
    return stored(blocks.groupBy("tree", "block").applyInArrow(_block_root, _NODES), label)


_WAYS_ARROW = pa.schema(
    [
        ("tree", pa.string()),
        ("at", pa.int64()),
        ("lefts", pa.list_(pa.binary())),
        ("rights", pa.list_(pa.binary())),
        ("subroot", pa.binary()),
        ("root", pa.binary()),
    ]
)


def _ways_down(block: pa.Table, above: pa.Table) -> pa.Table:
    """The ways from the nodes of a block up to the manifest, from that of the block's root."""
    if not block.num_rows:
        return _WAYS_ARROW.empty_table()
    block, hexes, _, levels = _in_order(block)
    nodes = block_nodes(hexes, levels)
    upper = above.to_pylist()[0]
    rows = []
    for k, (tree, at) in enumerate(zip(block["tree"].to_pylist(), block["at"].to_pylist(), strict=True)):
        lefts, rights = way_up(nodes, k)
        ends = upper["subroot"], upper["root"]
        rows.append((tree, at, lefts + upper["lefts"], rights + upper["rights"], *ends))
    columns = zip(*rows, strict=True)
    return pa.table(
        [pa.array(c, f.type) for c, f in zip(columns, _WAYS_ARROW, strict=True)], schema=_WAYS_ARROW
    )


_MANIFEST_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("tree", pa.string()), ("at", pa.int64())]
    + [(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    + [("verified", pa.bool_())]
)


def _judged(block: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and version root of every document of a block."""
    if not block.num_rows:
        return _MANIFEST_ARROW.empty_table()
    block, hexes, _, levels = _in_order(block)
    nodes = block_nodes(hexes, levels)
    upper = above.to_pylist()[0]
    subroot, root = upper["subroot"].decode(), upper["root"].decode()
    upper_siblings = b"".join(x for pair in zip(upper["lefts"], upper["rights"], strict=True) for x in pair)
    proofs, folded = [], []
    for k, other in enumerate(block["tampered"].to_pylist()):
        lefts, rights = way_up(nodes, k)
        siblings = [x for pair in zip(lefts, rights, strict=True) for x in pair]
        proofs.append(hashlib.sha256(b"".join(siblings) + upper_siblings).hexdigest())
        if other is None:  # no version of its own: it shares the original's root
            folded.append(root)
            continue
        inside = new_version(other.hex().encode(), lefts, rights)
        folded.append(new_version(inside[-1], upper["lefts"], upper["rights"])[-1].decode())
    n = block.num_rows
    return pa.table(
        {
            "doc_id": block["doc_id"],
            "tree": block["tree"],
            "at": block["at"],
            "leaf": [h.decode() for h in hexes],
            "subroot": [subroot] * n,
            "root": [root] * n,
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [f == root for f in folded],
        },
        schema=_MANIFEST_ARROW,
    )


def _with_ways(nodes: DataFrame, ways: DataFrame, told, schema: str) -> DataFrame:
    """Each block of nodes with the way of its root, in one task."""
    blocks = nodes.withColumn("block", F.expr(f"at div {BLOCK}"))
    above = ways.withColumn("block", F.col("at"))
    return (
        blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(told, schema)
    )


def _rounds(total: int) -> int:
    """How often block roots are taken until one node is left."""
    rounds = 0
    while total > 1:
        total, rounds = -(-total // BLOCK), rounds + 1
    return rounds


def _roots(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The nodes of every round, ending with one node per tree."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    tables = [nodes]
    for k in range(_rounds(most)):
        tables.append(_block_roots(tables[-1], f"{label}-{k}"))
    return tables


def _ways_of(tables: list[DataFrame], tops: DataFrame, label: str) -> DataFrame:
    """The ways of the nodes of the first table, from those of the last table's."""
    ways = tops
    for k, nodes in reversed(list(enumerate(tables[:-1]))):
        told = _with_ways(nodes.select("tree", "at", "total", "hash"), ways, _ways_down, _WAYS)
        ways = stored(told, f"{label}-{k}")
    return ways


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: see MANIFEST; `tree` is "-" or "=" and the language, `at` its place.

    A NULL in any field is part of the leaf as "-", so it differs from an empty text. A NULL
    language is a language of its own and the first one. Ids that repeat are ordered by leaf; rows
    that are equal throughout have equal leaves, so which of them comes first makes no difference. NULL
    ids come first and are never tampered with. An empty table gives no rows. Of the input only FIELDS
    are read; other columns, whatever their names, are ignored. A text of any length is hashed where it
    is read; only hashes are shuffled.
    """
    docs_placed = positions(leaves(docs), ["doc_id", "leaf"], "op12-leaves").withColumnRenamed("leaf", "hash")
    tables = _roots(docs_placed, "op12-roots")
    subroots = tables[-1].select(
        F.lit("*").alias("tree"), F.col("tree").alias("lang"), F.col("hash").alias("hash")
    )
    # "-" sorts before "=", and text by its bytes
    langs = stored(positions(subroots, ["lang"], "op12-langs"), "op12-subroots")
    upper = _roots(langs, "op12-upper")
    manifest_root = upper[-1].select(
        "tree",
        "at",
        F.array().cast("array<binary>").alias("lefts"),
        F.array().cast("array<binary>").alias("rights"),
        F.encode(F.lower(F.hex("hash")), "UTF-8").alias("subroot"),
        F.encode(F.lower(F.hex("hash")), "UTF-8").alias("root"),
    )
    of_langs = _ways_of(upper, manifest_root, "op12-upper-ways")
    tops = (
        langs.select("at", "lang", "hash")
        .join(of_langs.drop("tree", "subroot"), "at")
        .select(
            F.col("lang").alias("tree"),
            F.lit(0).cast("long").alias("at"),
            "lefts",
            "rights",
            F.encode(F.lower(F.hex("hash")), "UTF-8").alias("subroot"),
            "root",
        )
    )
    # the last round's nodes are the roots themselves, those of the first are the documents
    ways = _ways_of(tables[1:], tops, "op12-ways") if len(tables) > 1 else tops
    return _with_ways(docs_placed, ways, _judged, MANIFEST)
