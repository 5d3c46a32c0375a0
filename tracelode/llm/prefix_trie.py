"""Operator 13: a trie of conversation prefixes from sorted turns and a sparse table of shared lengths.

Each conversation becomes one string of digests, 32 characters a turn, so that sorting the strings puts conversations
with equal first turns side by side, shorter ones first. The sorted table is range-partitioned, with the id as the
last key, so neither a common first turn nor thousands of equal conversations meet in one task. A task works on
blocks of rows: between neighbours it takes the number of shared turns, builds a sparse table of range minima
over those, and every shared length is a candidate prefix whose left and right extents are found by binary search, each
on its own. Prefixes of one conversation alone are intervals of one row. What a subtree sums up are differences of
running sums over the sorted rows.

Nodes whose rows reach the edge of a block may go on in the next one. They are few (the prefixes of a block's first
and last rows) and carry a digest of their turns; their parts are added up by it, and the shared turns of the two rows at
a seam, found by joining both sides, supply what only the pair of rows knows. The ids of conversations that end in such
a node are written as strings, block by block, and digested in order by a stream, never held together.

Results: one row per distinct prefix, the empty one included. Rows without `conv_id` take no part. Null role or text is
empty; turns of equal number are ordered by role and text, repeated rows are turns of their own; other columns are
ignored; an empty table gives no rows. Turns are compared by 128-bit digests of role and text. A conversation is held
as its digests, some 40 bytes a turn, in one row; its texts never are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm.common import forget, load, shared_table
from tracelode.scale import hot_ordinal

#: Turns of the common opening: crc32(id) modulo this many.
OPENINGS = 6
#: Conversations that share an opening.
FAMILY = 100
#: Rows and turns of a block.
BLOCK_ROWS = 50_000
BLOCK_TURNS = 500_000
_DIGEST = 32
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODES = pa.schema([
    ("task", pa.int32()), ("block", pa.int32()), ("at_left", pa.bool_()), ("at_right", pa.bool_()), ("key", pa.string()),
    ("parent_key", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("size", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.string()),
])
_NODES_DDL = (
    "task int, block int, at_left boolean, at_right boolean, key string, parent_key string, conv_id long, depth long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string, ends string"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size): the turns of every conversation after its opening is replaced.

    The first h turns are those of the conversation whose id is the next lower multiple of 100, h being the unsigned
    crc32 of the id in decimal modulo 6; its own turns after its first h follow. One row per turn; a conversation
    that is left without turns has one row with a null `pos`.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.char_length(text).cast("long").alias("size"),
    )
    bucket = F.coalesce(F.floor(F.col("_turn") / 1024), F.lit(-(2**62)))
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text")]
    turns = hot_ordinal(turns, ["conv_id"], order, bucket, "pos").select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "digest", "size"
    )
    turns = shared_table(turns, "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select(
        "conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    )
    convs = convs.join(
        convs.where("conv_id = base").select(F.col("conv_id").alias("_base"), F.col("own").alias("_n")),
        F.col("base") == F.col("_base"), "left",
    ).select("conv_id", "own", "h", "base", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken"))
    opening = convs.where("taken > 0").join(
        turns.where((F.col("pos") < OPENINGS) & (F.col("conv_id") % FAMILY == 0))
        .select(F.col("conv_id").alias("base"), "pos", "digest", "size"), "base",
    ).where("pos <= taken").select("conv_id", "pos", "digest", "size")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "size"
    )
    none = convs.where("taken = 0 and own <= h").select(
        "conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("size")
    )
    return opening.union(rest).union(none)


def _sparse(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4, ... values."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        below, half = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(below[:-half], below[half:]))
    return levels


def _least(levels: list[np.ndarray], a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """min(values[a .. z])."""
    level = np.frexp((z - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), levels[0].dtype)
    for i in np.unique(level):
        some = np.flatnonzero(level == i)
        out[some] = np.minimum(levels[i][a[some]], levels[i][z[some] - 2**i + 1])
    return out


def _extents(shared: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval of each row's shared length: everything between shares as much."""
    n = len(shared)
    left, right = np.arange(n), np.arange(n)
    for i in range(len(levels) - 1, -1, -1):
        step = 2**i
        go = np.flatnonzero(left - step >= 0)
        go = go[levels[i][left[go] - step] >= shared[go]]
        left[go] -= step
        go = np.flatnonzero(right + step < n)
        go = go[levels[i][right[go] + 1] >= shared[go]]
        right[go] += step
    return left - 1, right  # the pair of rows (i - 1, i) belongs to row i


def _shared_turns(turns: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of first turns that each row shares with the row before it; the first row: -1."""
    both = np.minimum(sizes[1:], sizes[:-1])
    start = np.cumsum(both) - both
    k = np.arange(both.sum()) - np.repeat(start, both)
    same = (turns[np.repeat(at[1:], both) + k] == turns[np.repeat(at[:-1], both) + k]).all(axis=1)
    out = np.full(len(sizes), -1, np.int64)
    out[1:] = both
    wrong = np.flatnonzero(~same)
    row = np.repeat(np.arange(len(both)), both)[wrong]
    first = np.ones(len(wrong), bool)
    first[1:] = row[1:] != row[:-1]
    out[1 + row[first]] = k[wrong[first]]
    return out


def _chain(row: bytes) -> list[str]:
    """A digest of each prefix of a row, the empty one first."""
    state, out = hashlib.md5(), [hashlib.md5().hexdigest()]
    for i in range(0, len(row), _DIGEST):
        state.update(row[i : i + _DIGEST])
        out.append(state.hexdigest())
    return out


def block_nodes(ids: np.ndarray, rows: list[bytes], lengths: list[np.ndarray]) -> dict[str, object]:
    """Columns of the nodes of sorted conversations: `rows` are their digests, `lengths` the sizes of their texts.

    Nodes that hold the first or the last row have a key, and sums over this block only.
    """
    n = len(rows)
    sizes = np.fromiter(map(len, rows), np.int64, n) // _DIGEST
    at = np.cumsum(sizes) - sizes
    turns = np.frombuffer(b"".join(rows), np.uint64).reshape(-1, _DIGEST // 8)
    upto = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if n else np.zeros(1, np.int64)
    shared = _shared_turns(turns, at, sizes)
    after = np.append(shared[1:], -1)
    # what a row shares with the one before it, and the leaves it brings; the last row's is known only at the seam
    common = np.where(shared > 0, upto[at + np.maximum(shared, 0)] - upto[at], 0)
    common_upto = np.cumsum(common)
    leaf = after < sizes
    leaf[-1] = False
    leaves_upto = np.concatenate([[0], np.cumsum(leaf)])

    # candidates: the shared length of each pair of neighbours, as intervals of rows
    levels = _sparse(shared)
    left, right = _extents(shared, levels)
    pair = np.arange(1, n)
    whole, of_pair = np.unique(left[pair] * (n + 1) + right[pair], return_inverse=True) if n > 1 else (np.empty(0, np.int64),) * 2
    first = np.concatenate([whole // (n + 1), np.arange(n)]).astype(np.int64)
    last = np.concatenate([whole % (n + 1), np.arange(n)]).astype(np.int64)
    deepest = np.concatenate([_least(levels, whole // (n + 1) + 1, whole % (n + 1)) if n > 1 else np.empty(0, np.int64), sizes])
    before, behind = shared[first], after[last]
    top = np.maximum(before, behind) + 1
    # the interval around: that of the pair at the side where more is shared
    of_row = np.concatenate([[0], of_pair, [0]]).astype(np.int64)
    around = np.where(before >= behind, of_row[first], of_row[np.minimum(last + 1, n)])
    some = np.flatnonzero(deepest >= top)
    children = np.bincount(around[some][top[some] > 0], minlength=len(first))
    least = _least(_sparse(ids), first, last)

    count = (deepest - top + 1)[some]
    i = np.repeat(some, count)
    depth = np.repeat(top[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    is_top, is_deep = depth == top[i], depth == deepest[i]
    a, z = first[i], last[i]
    text_end = at[a] + depth
    over = upto[at[a] + np.maximum(depth - 1, 0)] - upto[at[a]]
    edge_left, edge_right = a == 0, z == n - 1
    parent = np.where(is_top, around[i], i)
    parent_edge = (depth > 0) & ((first[parent] == 0) | (last[parent] == n - 1))

    chains = {0: _chain(rows[0]), n - 1: _chain(rows[-1])}

    def key(interval: int, d: int) -> str:
        return chains[0 if first[interval] == 0 else n - 1][d]

    keys = [None] * len(i)
    for j in np.flatnonzero(edge_left | edge_right):
        keys[j] = key(i[j], depth[j])
    parents = [None] * len(i)
    for j in np.flatnonzero(parent_edge):
        parents[j] = key(parent[j], depth[j] - 1)

    # conversations that end in a node are the first rows of its interval
    sha, ends = [_EMPTY] * len(i), [None] * len(i)
    stop = a.copy()
    runs = np.append(np.flatnonzero(shared[1:] < np.maximum(sizes[1:], sizes[:-1])) + 1, n)
    run_end = runs[np.searchsorted(runs, np.arange(n), "right")]
    ending = np.flatnonzero(sizes[a] == depth)
    stop[ending] = np.minimum(run_end[a[ending]], z[ending] + 1)
    for j in ending:
        listed = ",".join(map(str, ids[a[j] : stop[j]].tolist()))
        if keys[j] is None:
            sha[j] = hashlib.sha256(listed.encode()).hexdigest()
        else:
            ends[j] = listed
    return {
        "at_left": edge_left, "at_right": edge_right, "key": keys, "parent_key": parents, "conv_id": least[i], "depth": depth,
        "parent_conv_id": pa.array(least[parent], mask=(depth == 0) | parent_edge), "n_convs": z - a + 1,
        "n_children": np.where(is_deep, children[i], 1), "n_leaves": leaves_upto[z + 1] - leaves_upto[a],
        "saved_tokens": common_upto[z] - common_upto[a] - (z - a) * over,
        "size": np.where(depth > 0, upto[text_end] - upto[np.maximum(text_end - 1, 0)], 0), "ends_sha256": sha, "ends": ends,
    }


def _blocks(batches):
    """Nodes of each block of a sorted partition."""
    task = TaskContext.get().partitionId()
    ids, rows, lengths, turns, block = [], [], [], 0, 0

    def done():
        columns = block_nodes(np.array(ids, np.int64), rows, lengths)
        n = len(columns["depth"])
        columns |= {"task": np.full(n, task, np.int32), "block": np.full(n, block, np.int32)}
        whole = pa.RecordBatch.from_pydict({f.name: pa.array(columns[f.name], f.type) for f in _NODES}, schema=_NODES)
        for at in range(0, n, 20_000):
            yield whole.slice(at, 20_000)

    for batch in batches:
        ends = batch.column("lengths").offsets.to_numpy()
        values = batch.column("lengths").values.to_numpy()
        for k, (conv, row) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist())):
            ids.append(conv)
            rows.append(row.encode())
            lengths.append(values[ends[k] : ends[k + 1]])
            turns += len(row) // _DIGEST
            if len(ids) >= BLOCK_ROWS or turns >= BLOCK_TURNS:
                yield from done()
                ids, rows, lengths, turns, block = [], [], [], 0, block + 1
    if ids:
        yield from done()


def _digests(batches):
    """SHA-256 of the strings of each key, which come in order, joined by commas."""
    key, state = None, None
    schema = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])

    def row():
        return pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]}, schema=schema)

    for batch in batches:
        for at, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if at != key:
                if key is not None:
                    yield row()
                key, state = at, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.encode())
    if key is not None:
        yield row()


def trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in (conv_id, pos, digest, size); see the contract."""
    whole = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", "size")))).alias("_t")
    ).select(
        "conv_id", F.array_join(F.col("_t.digest"), "").alias("turns"), F.col("_t.size").alias("lengths")
    )
    rows = shared_table(whole, "sequences")
    parts = shared_table(
        rows.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id").mapInArrow(_blocks, _NODES_DDL), "trie"
    )
    forget(rows)
    edge = parts.where("key is not null")
    numbered = edge.select("task", "block").distinct().withColumn("no", F.row_number().over(Window.orderBy("task", "block")))
    edge = edge.join(numbered, ["task", "block"])

    # a seam lies after each block: nodes on both sides go on, the deepest of them is what the two rows share
    behind = edge.where("at_left").select((F.col("no") - 1).alias("no"), "key", F.lit(True).alias("goes_on"))
    seam = edge.where("at_right").select("no", "key", "depth", "size").join(behind, ["no", "key"], "left")
    deeper = Window.partitionBy("no").orderBy(F.col("depth").desc())
    of_seam = Window.partitionBy("no")
    seam = seam.select(
        "key",
        F.when(F.col("goes_on"), F.sum(F.when(F.col("goes_on"), F.col("size"))).over(deeper)).otherwise(0).alias("saved_tokens"),
        F.when(F.max(F.when(F.col("goes_on"), F.col("depth"))).over(of_seam) == F.max("depth").over(of_seam), 0).otherwise(1).alias("n_leaves"),
    )
    merged = (
        edge.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_leaves", "saved_tokens")
        .unionByName(seam, allowMissingColumns=True)
        .groupBy("key").agg(
            F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        )
    )
    merged = shared_table(merged, "edge-nodes")
    children = merged.select("parent_key").union(parts.where("key is null").select("parent_key")).where("parent_key is not null")
    children = children.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    digests = (
        edge.where("ends is not null").select("key", "no", "ends").repartition("key").sortWithinPartitions("key", "no")
        .select("key", "ends").mapInArrow(_digests, "key string, ends_sha256 string")
    )
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    at_edge = (
        merged.join(children, "key", "left").join(digests, "key", "left").join(parents, "parent_key", "left")
        .withColumn("parent_conv_id", F.col("_parent"))
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    )
    inside = parts.where("key is null").join(parents, "parent_key", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_parent")
    )
    return at_edge.select(*columns).union(inside.select(*columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of `conversations` after their openings are replaced."""
    return trie(rebuilt(load(spark, sf_dir, "conversations")))


OP13_SQL = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
), own as (
  select conv_id, list(struct_pack(role := role, text := text) order by pos) as t from turns group by conv_id
), hashed as (
  select conv_id, t, conv_id - conv_id % 100 as base, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda crc, c: list_reduce(
      [xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end
    )
  ) as crc
  from own
), openings as (
  select h.*, xor(crc, 4294967295::bigint) % 6 as h, coalesce(o.t, []) as b from hashed h left join own o on o.conv_id = h.base
), rebuilt as (
  select conv_id, list_concat(b[1:h], t[h + 1:]) as t from openings
), prefixes as (
  select conv_id, len(t) as n, d, md5(to_json(t[1:d])::varchar) as node, t[d].text as text,
    case when d > 0 then md5(to_json(t[1:d - 1])::varchar) end as parent
  from (select conv_id, t, unnest(range(0, len(t) + 1)) as d from rebuilt)
), nodes as (
  select node, d as depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(length(any_value(text)), 0) as size,
    sha256(coalesce(string_agg(case when n = d then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from prefixes group by node, d
), children as (
  select parent, count(*) as n from nodes where parent is not null group by parent
), below as (
  select p.node as ancestor, u.node, any_value(u.n_convs) as n_convs, any_value(u.size) as size, any_value(c.n) as n_children
  from nodes u join prefixes x on x.conv_id = u.conv_id and x.node = u.node
  join prefixes p on p.conv_id = u.conv_id and p.d <= x.d
  left join children c on c.parent = u.node
  group by p.node, u.node
), sums as (
  select ancestor, sum((n_convs - 1) * size)::bigint as saved_tokens, count(*) filter (where n_children is null) as n_leaves
  from below group by ancestor
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, s.n_leaves,
  s.saved_tokens, n.ends_sha256
from nodes n join sums s on s.ancestor = n.node left join nodes p on p.node = n.parent left join children c on c.parent = n.node
"""
