"""N-gram Jaccard self-join by signature trees, and its connected components.

Sets of word shingles are first reduced to classes of equal sets. A set with n shingles needs
ceil(share * n) of them in common with any partner, so two partners share one of the first
n - ceil(share * n) + 1 shingles of any fixed order (prefix filter). These shingles deal the sets
out over the cluster: sets that meet at a shingle, and whose sizes are within reach of each other,
form a group. In each group a signature tree is walked against itself; a large group is cut into
blocks and every two blocks are walked against each other. What the bounds can't exclude is
compared exactly.

The order of shingles puts those of passages that very many texts share last, so that such a passage
makes no group of all its texts. They are found by counting within some thousand texts at a time;
any order gives the same result, so a table of the most frequent ones will do.

It is done in rounds. The first one (or more) takes a few shingles of least hash of each set, which similar
sets share with high chance, and keeps, per group, a forest of likely pairs; these are compared and
give provisional components, which already hold nearly all copies together. The last round takes all
prefix shingles, and only groups in which different components still meet. What its walks can't
exclude is not passed on pair by pair, as a group of near copies has a square of these: each walk gives
a forest over the components that it found near each other, one row per component at most. Components
tied together in this way, directly or through others, are a family. Every link lies within a
family.

Families are then compared exactly: every class with every other one that is near enough in size, in
blocks that hold their shingles. A block gives, per class, the number of documents it is linked with
and its root in a forest of the block's links; the forests make the final components. No
pairs are stored, unless the links themselves are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.components import components
from ledgerlake.llm.signature_tree import Tree, bitmap, dual_traversal, fold
from ledgerlake.llm.tables import in_small_batches, stored
from ledgerlake.llm.words import blocks, mix, shingles

WORDS = 4
SHARE = 85
#: Shingles of least hash looked at in each of the first rounds.
FIRST = (4,)
#: Sets per block of a large group.
BLOCK = 1024
#: Shingles per block of a component whose links are looked for, and columns compared at a time.
BLOCK_TOKENS = 1 << 20
COLUMNS = 1024
#: A shingle is frequent if it occurs so often among FREQUENT_AMONG shingles of one task.
FREQUENT = 8
FREQUENT_AMONG = 1 << 21
#: Entries of the table of frequent shingles, the most frequent first.
FREQUENT_TABLE = 1 << 18
#: Bits per shingle in a bitmap, before rounding up to a power of two.
BITS = 2
#: Bits of the filter that holds back texts without any candidate pair.
FILTER_BITS = 1 << 23

_U = np.uint64


def _sets(texts: pa.Array, words: int):
    """The distinct shingles of each text, in the order of the rows."""
    for block in blocks(texts):
        yield from shingles(block.word_hashes(), block.word_ptr, words)


def _frequent(df: DataFrame, words: int) -> np.ndarray:
    """Shingles that many texts hold, ascending, with the logarithm of their counts."""

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for tokens in _sets(batch["text"], words):
                held.append(tokens)
                n += len(tokens)
                if n >= FREQUENT_AMONG:
                    yield often(held)
                    held, n = [], 0
        if held:
            yield often(held)

    def often(held):
        # sorted in place: the copies that np.unique makes are several times as large
        tokens = np.concatenate(held)
        held.clear()
        tokens.sort()
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        first = np.flatnonzero(new)
        tokens, counts = tokens[first], np.diff(first, append=len(tokens))
        some = counts >= FREQUENT
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens[some].view(np.int64)), pa.array(counts[some])], names=["token", "n"]
        )

    found = (
        df.select("text")
        .mapInArrow(count, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(FREQUENT_TABLE)
        .toPandas()
    )
    tokens = found["token"].to_numpy(np.int64).view(_U)
    level = np.log2(found["n"].to_numpy(np.float64) + 1).astype(np.int64)
    order = np.argsort(tokens)
    return np.stack([tokens[order], level[order].view(_U)])


def prefix_length(n: int, share: int) -> int:
    return n - (share * n + 99) // 100 + 1


def _checksums(df: DataFrame, words: int) -> DataFrame:
    """doc_id, n, k1, k2 of every text: the size of its set and two checksums of it."""

    def sums(batches):
        for batch in batches:
            n, k1, k2 = [], [], []
            for tokens in _sets(batch["text"], words):
                n.append(len(tokens))
                k1.append(tokens.sum(dtype=_U))
                k2.append(mix(tokens).sum(dtype=_U))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.array(np.array(k1, _U).view(np.int64)),
                    pa.array(np.array(k2, _U).view(np.int64)),
                ],
                names=["doc_id", "n", "k1", "k2"],
            )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sums, "doc_id long, n long, k1 long, k2 long"
    )


def _profiles(df: DataFrame, words: int, share: int) -> DataFrame:
    """doc_id, the least hashes of its set, its prefix in order, its bitmap, for texts with a shingle."""
    frequent, level = _frequent(df, words)

    def ordered(tokens: np.ndarray) -> np.ndarray:
        n = prefix_length(len(tokens), share)
        if not len(frequent):
            return tokens[:n]
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        known = frequent[at] == tokens
        if not known.any():
            return tokens[:n]
        return tokens[np.lexsort((tokens, np.where(known, level[at], _U(0))))[:n]]

    def profile(batches):
        for batch in batches:
            prefixes, bitmaps, some = [np.zeros(0, np.int64)], [], []
            heads = [np.zeros(0, np.int64)]
            for tokens in _sets(batch["text"], words):
                some.append(len(tokens) > 0)
                if len(tokens):
                    heads.append(tokens[: sum(FIRST)].view(np.int64))
                    prefixes.append(ordered(tokens).view(np.int64))
                    wide = 1 << max(0, (len(tokens) * BITS - 1).bit_length() - 6)
                    bitmaps.append(bitmap(tokens, wide).tobytes())
            ends = lambda lists: np.cumsum([len(x) for x in lists]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].filter(pa.array(some, pa.bool_())),
                    pa.ListArray.from_arrays(ends(heads), np.concatenate(heads)),
                    pa.ListArray.from_arrays(ends(prefixes), np.concatenate(prefixes)),
                    pa.array(bitmaps, pa.binary()),
                ],
                names=["doc_id", "heads", "prefix", "bits"],
            )

    return (
        df.select(F.col("doc_id").cast("long"), "text")
        .where(F.col("doc_id").isNotNull())
        .mapInArrow(profile, "doc_id long, heads array<long>, prefix array<long>, bits binary")
    )


def _meeting(entries: DataFrame, keys: list[str], alike: bool) -> DataFrame:
    """The entries of groups in which different components meet, with the size of the group.

    With `alike`, of groups with the very same members (by count and checksums) only one is kept.
    """
    groups = (
        entries.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("in_group"),
            F.min("comp").alias("lo"),
            F.max("comp").alias("hi"),
            *(F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"sum{k}") for k in (0, 1) if alike),
        )
        .where(F.col("lo") < F.col("hi"))
        .drop("lo", "hi")
    )
    if alike:
        groups = (
            groups.groupBy("sum0", "sum1", "in_group")
            .agg(F.min(F.struct(*keys)).alias("one"))
            .select("one.*", "in_group")
        )
    return entries.join(groups, keys)


def _groups(entries: DataFrame, share: int) -> DataFrame:
    """Entries (token, rep, n, comp) that meet at a token and have sizes within reach.

    Sizes fall into bands; partners are in the same band or in neighbouring ones, so every set is
    also a guest in the band above its own. Texts that are alike meet at many tokens; where a group
    has the same members at several of them, one is enough.
    """
    # bands a little wider than partners can be apart, so that rounding is harmless
    width = 1.001 * float(np.log(100 / min(share, 99)))
    own = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    banded = _meeting(entries, ["token"], alike=False).drop("in_group").withColumn(
        "band", F.explode(F.array(own, own + 1))
    )
    return _meeting(banded, ["token", "band"], alike=True)


def _column(column: pa.Array, of: str, binary: str):
    """Numbers as an array, bitmaps or shingles as views of the batch's bytes."""
    if of != binary:
        return column.to_numpy(zero_copy_only=False)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).tolist()
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [data[a:b].view(_U) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _runs(batches, keys: list[str], names: list[str], binary: str):
    """Consecutive rows with the same keys, as columns; only the rows of one run are held."""
    held: dict[str, list] = {}
    of = None

    def whole():
        return {
            c: [x for part in parts for x in part] if c == binary else np.concatenate(parts)
            for c, parts in held.items()
        }

    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for mark in marks:
            new[1:] |= mark[1:] != mark[:-1]
        starts = np.flatnonzero(new).tolist()
        columns = {c: _column(batch[c], c, binary) for c in names}
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(mark[a] for mark in marks)
            if key != of:
                if of is not None:
                    yield whole()
                held, of = {c: [] for c in names}, key
            for c, values in columns.items():
                held[c].append(values[a:b])
    if of is not None:
        yield whole()
    pa.default_memory_pool().release_unused()


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes the smallest one that the edges (i, j) tie it to."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _walk(share: int, forest: bool):
    """Runs of rows of one group (and pair of blocks) become rows (a, b).

    With `forest` these are pairs of sets, each set with its likeliest partner; else every component
    that is near another one with its root among the components tied to each other here.
    """
    names = ["rep", "n", "comp", "bits", "side", "across"]

    def pairs(run):
        comp = run["comp"]
        if len(comp) < 2 or comp.min() == comp.max():
            return None
        words = min(map(len, run["bits"]))
        maps = np.stack([fold(x, words) for x in run["bits"]])
        sizes, rep, side = run["n"], run["rep"], run["side"]
        trees, of = [], []
        for s in (0, 1):
            mine = np.flatnonzero(side == s)
            mine = mine[np.lexsort((rep[mine], sizes[mine], comp[mine]))]
            of.append(mine)
            trees.append(Tree(maps[mine], sizes[mine], comp[mine]) if len(mine) else None)
        across = bool(run["across"][0])
        if trees[0] is None or (trees[1] is None and across):
            return None
        x, y = (trees[0], trees[1]) if across else (trees[0], trees[0])
        i, j = dual_traversal(x, y, share)
        p, q = of[0][i], of[1 if across else 0][j]
        if not len(p):
            return None
        if not forest:
            named, at = np.unique(comp, return_inverse=True)
            root = _roots(len(named), at[p], at[q])
            tied = np.flatnonzero(root != np.arange(len(named)))
            return named[root[tied]], named[tied]
        common = np.zeros(len(p), np.int64)
        for at in range(0, len(p), 4096):
            s = slice(at, at + 4096)
            common[s] = np.bitwise_count(maps[p[s]] & maps[q[s]]).sum(1, dtype=np.int64)
        # per set its likeliest partner among those before it
        order = np.lexsort((p, -common / (sizes[p] + sizes[q]), q))
        first = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
        p, q = p[first], q[first]
        return np.minimum(rep[p], rep[q]), np.maximum(rep[p], rep[q])

    def walk(batches):
        for run in _runs(batches, ["token", "band", "s", "t"], names, "bits"):
            if found := pairs(run):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return walk


def _candidates(entries: DataFrame, sets: DataFrame, share: int, forest: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b: of sets of different components, or of the components themselves.

    A large group is cut into blocks by a hash of group and set. With `forest`, blocks are walked
    alone and give one pair of sets per set at most; else every two blocks are walked against each
    other, and give a forest over the components that may be linked.
    """
    found = _groups(entries, share).withColumn("blocks", F.ceil(F.col("in_group") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("token", "rep"), F.col("blocks")).cast("int")
    found = found.withColumn("own", own)
    if forest:
        found = found.withColumns({"s": F.col("own"), "t": F.col("own")})
    else:
        found = found.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns(
            {"s": F.least("own", "with"), "t": F.greatest("own", "with")}
        )
    key = ["token", "band", "s", "t"]
    rows = (
        found.join(sets.select("rep", "bits"), "rep")
        .withColumn("across", F.col("s") != F.col("t"))
        .withColumn("side", F.when(F.col("across") & (F.col("own") == F.col("t")), 1).otherwise(0))
        .select(*key, "rep", "n", "comp", "bits", "side", "across")
    )
    return (
        rows.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(_walk(share, forest), "a long, b long")
        .distinct()
    )


def _filter_of(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash of the ids: FILTER_BITS bits at most come to the driver."""
    at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    rows = (
        ids.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(_U)


def _shingles_of(ids: DataFrame, df: DataFrame, words: int) -> DataFrame:
    """id, tokens: the shingles of the documents with these ids."""
    bits = _filter_of(ids, "id")

    def tokens(batches):
        for batch in batches:
            at = batch["at"].to_numpy()
            wanted = (bits[at // 64] >> (at % 64).astype(_U)) & _U(1) == 1
            some = batch.filter(pa.array(wanted))
            held = [x.tobytes() for x in _sets(some["text"], words)]
            if some.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], pa.array(held, pa.binary())], names=["id", "tokens"]
                )

    return (
        df.select(F.col("doc_id").cast("long"), "text")
        .where(F.col("doc_id").isNotNull())
        .withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
        .mapInArrow(tokens, "id long, tokens binary")
        .join(ids.distinct(), "id", "left_semi")
        .dropDuplicates(["id"])
    )


def _similar(pairs: DataFrame, df: DataFrame, words: int, share: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by exact comparison of the shingles of both."""
    pairs = stored(pairs, "op2-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = _shingles_of(ids, df, words)

    def compare(batches):
        for batch in batches:
            keep = []
            columns = (batch["of_a"].to_pylist(), batch["of_b"].to_pylist())
            for x, y in zip(*columns, strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= share * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("of_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("of_b")), "b")
        .mapInArrow(compare, "a long, b long")
    )


def _in_common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of shingles that each of x shares with each of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    tokens = np.concatenate([*x, *y])
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    _, column, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    # a shingle of one set is shared with none
    some = counts[column] > 1
    column = (np.cumsum(counts > 1) - 1)[column[some]]
    row = row[some]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        held = np.zeros((len(x) + len(y), min(COLUMNS, width - low)), np.float32)
        held[row[part], column[part] - low] = 1
        out += (held[: len(x)] @ held[len(x) :].T).astype(np.int64)
    return out


def _compare(share: int, listed: bool):
    """Runs of rows of one pair of blocks become links (a, b, common), or rows (rep, links, root).

    links is the number of documents that a set is linked with in this run, root the least set that
    the links of this run tie it to.
    """
    names = ["rep", "copies", "guest", "tokens", "side", "across"]

    def links(run):
        side, across = run["side"], bool(run["across"][0])
        rep, copies, guest = run["rep"], run["copies"], run["guest"].astype(bool)
        sets = run["tokens"]
        size = np.array([len(x) for x in sets], np.int64)
        p = np.flatnonzero(side == 0)
        q = np.flatnonzero(side == 1) if across else p
        if not len(p) or not len(q):
            return None
        common = _in_common([sets[k] for k in p], [sets[k] for k in q])
        ok = 100 * common >= share * (size[p][:, None] + size[q][None, :] - common)
        # two guests are compared where they are at home
        ok &= ~(guest[p][:, None] & guest[q][None, :])
        if not across:
            np.fill_diagonal(ok, False)
        i, j = np.nonzero(ok if across else np.triu(ok))
        if listed:
            a, b = rep[p[i]], rep[q[j]]
            return np.minimum(a, b), np.maximum(a, b), common[i, j]
        if not len(i):
            return None
        total = np.zeros(len(rep), np.int64)
        np.add.at(total, p[i], copies[q[j]])
        np.add.at(total, q[j], copies[p[i]])
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root = rep[order][_roots(len(rep), place[p[i]], place[q[j]])][place]
        some = np.flatnonzero(total)
        return rep[some], total[some], root[some]

    def compare(batches):
        for run in _runs(batches, ["comp", "band", "s", "t"], names, "tokens"):
            if found := links(run):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in found],
                    names=["a", "b", "common"] if listed else ["rep", "links", "root"],
                )

    return compare


def _links(classes: DataFrame, df: DataFrame, words: int, share: int, listed: bool) -> DataFrame:
    """Links between classes (rep, n, copies, family): (a, b, common), a < b, or (rep, links, root).

    A family too large for one block is taken by bands of sizes, as in `_groups`; there a class is a
    guest in the band above its own.
    """
    width = 1.001 * float(np.log(100 / min(share, 99)))
    own = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    light = classes.select("rep", "n", "copies", F.col("family").alias("comp"))
    needed = F.ceil(
        F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_TOKENS))
    ).cast("int")
    wholes = (
        light.groupBy("comp").agg(F.count(F.lit(1)).alias("sets"), needed.alias("most")).where("sets > 1")
    )
    placed = (
        light.join(wholes.select("comp", "most"), "comp")
        .withColumn("home", F.when(F.col("most") > 1, own).otherwise(0))
        .withColumn(
            "band",
            F.explode(F.when(F.col("most") > 1, F.array(F.col("home"), F.col("home") + 1)).otherwise(F.array("home"))),
        )
        .withColumn("guest", F.col("band") != F.col("home"))
    )
    groups = (
        placed.groupBy("comp", "band")
        .agg(
            F.count(F.lit(1)).alias("sets"),
            F.bool_and("guest").alias("strange"),
            needed.alias("blocks"),
        )
        .where((F.col("sets") > 1) & ~F.col("strange"))
        .select("comp", "band", "blocks")
    )
    found = (
        placed.join(groups, ["comp", "band"])
        .withColumn("own", F.pmod(F.xxhash64("band", "rep"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns({"s": F.least("own", "with"), "t": F.greatest("own", "with")})
        .withColumn("across", F.col("s") != F.col("t"))
        .withColumn("side", F.when(F.col("across") & (F.col("own") == F.col("t")), 1).otherwise(0))
    )
    ids = stored(placed.select(F.col("rep").alias("id")).distinct(), "op2-ids")
    key = ["comp", "band", "s", "t"]
    rows = found.join(_shingles_of(ids, df, words).withColumnRenamed("id", "rep"), "rep").select(
        *key, "rep", "copies", "guest", "tokens", "side", "across"
    )
    return (
        rows.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(
            _compare(share, listed), "a long, b long, common long" if listed else "rep long, links long, root long"
        )
    )


_CLASS = ["k1", "k2", "n"]


def _families(df: DataFrame, words: int, share: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, n, k1, k2 of every row; the classes of equal sets that are not empty; and known ties.

    A class has its least doc_id (rep), the number of its documents (copies), its provisional component
    (comp) and its family, within which all its links lie. Ties (a, b) are the links behind the
    provisional components.
    """
    in_small_batches(df.sparkSession)
    rows = stored(_checksums(df, words), "op2-checksums")
    named = (
        rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        .groupBy(*_CLASS)
        .agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"))
    )
    profiles = _profiles(df, words, share).withColumnRenamed("doc_id", "rep")
    sets = stored(
        named.join(profiles, "rep").dropDuplicates(["rep"]).select(
            *_CLASS, "rep", "copies", "heads", "prefix", "bits"
        ),
        "op2-sets",
    )

    def entries(tokens: Column, comp: DataFrame) -> DataFrame:
        return comp.select("rep", "n", "comp", F.explode(tokens).alias("token"))

    parts, edges = sets.withColumn("comp", F.col("rep")), None
    for k, size in enumerate(FIRST):
        heads = entries(F.slice("heads", sum(FIRST[:k]) + 1, size), parts)
        links = _similar(_candidates(heads, sets, share, forest=True), df, words, share)
        edges = stored(components(links if edges is None else links.unionByName(edges)), "op2-edges")
        parts = sets.join(edges.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "comp", F.coalesce("component", "rep")
        )
        edges = edges.select(F.col("node").alias("a"), F.col("component").alias("b"))
    near = _candidates(entries(F.col("prefix"), parts), sets, share, forest=False)
    families = components(near).select(F.col("node").alias("comp"), F.col("component").alias("family"))
    classes = parts.join(families, "comp", "left").select(
        *_CLASS, "rep", "copies", "comp", F.coalesce("family", "comp").alias("family")
    )
    return rows, stored(classes, "op2-classes"), edges


def _with_components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds component_id, the least set that the edges (a, b) tie a class to."""
    final = components(edges).withColumnRenamed("node", "rep")
    return classes.join(final, "rep", "left").withColumn("component_id", F.coalesce("component", "rep")).drop(
        "component"
    )


def _members(rows: DataFrame, classed: DataFrame, **columns: Column) -> DataFrame:
    """doc_id, n_shingles, component_id and more columns of every row; one without shingles is alone."""
    return (
        rows.join(classed, _CLASS, "left")
        .withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")))
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            *(c.alias(name) for name, c in columns.items()),
        )
    )


def jaccard_components(df: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of (doc_id, text).

    Two texts are linked if 100 * common shingles >= share * all their shingles; a component is named
    by its smallest doc_id. n_links is the number of other documents that a text is linked with, those
    of the same shingles included. A NULL text, and one without a word, has no shingles, is linked with
    nothing and is its own component. Rows that repeat a doc_id stand for one document and are
    expected to repeat its text. A NULL doc_id gives a row with the component of its equals, or
    NULL. An empty table gives an empty result; other columns are ignored.
    """
    rows, classes, edges = _families(df, words, share)
    found = stored(_links(classes, df, words, share, listed=False), "op2-links")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = edges.unionByName(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    linked = _with_components(classes, edges).join(counted, "rep", "left")
    others = F.col("copies") - F.col("doc_id").isNotNull().cast("long") + F.coalesce("links", F.lit(0))
    return _members(rows, linked, n_links=F.coalesce(others, F.lit(0)).cast("long"))


def jaccard_links(df: DataFrame, words: int = WORDS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """All links: doc_id, n_shingles, component_id, class_id of every row, and those between classes.

    Documents of one class_id have the same shingles and are linked with each other. Rows (a, b,
    common), a < b, link all documents of class a with all of class b. Rows are those of
    `jaccard_components`.
    """
    rows, classes, edges = _families(df, words, share)
    found = stored(_links(classes, df, words, share, listed=True), "op2-links")
    classed = _with_components(classes, edges.unionByName(found.select("a", "b")))
    return _members(rows, classed, class_id=F.col("rep")), found


def one_of_each(df: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """The rows whose doc_id names their component, one row each; all columns are kept.

    Rows with a NULL doc_id can't be told apart from their copies and are kept as they are. Texts
    stay where they are read, but for those whose ids look like ones that go or that repeat.
    """
    rows, classes, edges = _families(df, words, share)
    # families of one component hold no link that could change anything
    open_ = classes.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    apart = classes.join(open_.select("family"), "family")
    links = stored(_links(apart, df, words, share, listed=False), "op2-links")
    edges = edges.unionByName(links.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    members = _members(rows, _with_components(classes, edges)).where(F.col("doc_id").isNotNull())
    found = stored(members, "op2-members")
    judged = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays")
    )
    bits = _filter_of(judged.where((F.col("n") > 1) | ~F.col("stays")), "doc_id")
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS))
    placed = df.withColumn("__at", F.when(F.col("doc_id").isNotNull(), hashed))

    columns, schema = df.columns, df.schema

    def split(listed: bool):
        def pick(batches):
            for batch in batches:
                at = batch["__at"].fill_null(0).to_numpy(zero_copy_only=False)
                hit = (bits[at // 64] >> (at % 64).astype(_U)) & _U(1) == 1
                hit &= batch["__at"].is_valid().to_numpy(zero_copy_only=False)
                yield batch.select(columns).filter(pa.array(hit == listed))

        return placed.mapInArrow(pick, schema)

    kept = judged.where("stays").select("doc_id")
    doubtful = split(True).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return split(False).unionByName(doubtful.select(*df.columns))
