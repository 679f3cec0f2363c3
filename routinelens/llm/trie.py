"""The prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it, and the smallest of them owns it. Who owns
a node owns all nodes below it on its own path, so each conversation owns a suffix of its path, from one depth on. Sums over the
subtree of a node need no walk then: the tokens that its members have from its depth on, less those of the nodes that they own there, are the
tokens that sharing saves; each childless node is the end of one owner, each child is one member's own. All are sums over the members, by one
group-by of the prefixes.

Windows over each conversation give every prefix a key, the running exclusive or of hashes of place and turn (128 bits), its parent's key
(the last turn taken out again) and the tokens so far. They run over ``SLOT`` turns at a time and what comes before a slot is one carried row,
so a conversation however long is many tasks. A node's smallest member is a minimum combined before the shuffle, as the root and a hot
first turn have a large share of all rows; where a conversation's own suffix begins is the least depth among the nodes it owns. The digest of
a node's ends is made of sorted runs of ids, read in order as a stream.

Defined results: a null role or text is empty; turns without a conversation id belong to none and are left out. Of equal turn numbers the order is that
of the turns' SHA-256, null first; repeated rows are turns of their own. Texts are hashed and their words counted whole. Columns other than the four
are not read. No rows give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routinelens.storage import materialise

#: Conversations of a family share its first one's head: families of so many ids, heads of fewer turns than this.
FAMILY, HEADS = 20, 4
#: Turns of a window, and ids of a run whose text is one row.
SLOT, RUN = 1024, 4096
NODE = ["depth", "k1", "k2"]
_WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn: conv, its place p in the conversation (from 1), two longs of the SHA-256 of role and text, and the words of the text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda k: F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long")
    turn = F.col(turn_col).cast("long")
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), turn.alias("turn"), F.floor(turn / SLOT).alias("slot"), part(0).alias("d1"), part(1).alias("d2"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")
    )
    rows = materialise(rows.withColumn("slot", F.coalesce("slot", F.lit(-(1 << 62)))), "turns")
    nth = F.row_number().over(W.partitionBy("conv", "slot").orderBy(F.col("turn").asc_nulls_first(), "d1", "d2"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = rows.groupBy("conv", "slot").agg(F.count(F.lit(1)).alias("n")).select("conv", "slot", before.alias("before"))
    return rows.withColumn("nth", nth).join(carried, ["conv", "slot"]).select("conv", (F.col("before") + F.col("nth")).alias("p"), "d1", "d2", "words")


def regrafted(placed: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Rows of turns() with each conversation's first h turns replaced by those of its family's first one: conv, len, depth, d1, d2, words.

    h is the unsigned CRC-32 of the decimal id, modulo ``heads``. A row of depth 0 stands for each conversation.
    """
    placed = materialise(placed, "placed-turns")
    turn = F.struct(F.col("p").alias("depth"), "d1", "d2", "words")
    # at most heads - 1 turns are gathered of any conversation
    each = placed.groupBy("conv").agg(F.max("p").alias("n"), F.sort_array(F.collect_list(F.when(F.col("p") < heads, turn))).alias("head"))
    known = each.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int").alias("h"), (F.col("conv") - F.col("conv") % family).alias("first"))
    firsts = each.select(F.col("conv").alias("first"), "head")
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast(each.schema["head"].dataType))
    made = known.join(firsts, "first", "left").select("conv", "h", head.alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    made = materialise(made.select("conv", "h", "head", (F.size("head") + F.col("own")).alias("len")), "grafts")
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(0).cast("long").alias("words"))
    top = made.select("conv", "len", F.explode(F.concat(F.array(root), "head")).alias("t")).select("conv", "len", "t.*")
    rest = placed.join(made.select("conv", "h", "len", F.size("head").alias("k")), "conv").filter("p > h").select("conv", "len", (F.col("p") - F.col("h") + F.col("k")).alias("depth"), "d1", "d2", "words")
    return top.unionByName(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """Per row of regrafted(): conv, len, the node (NODE), its parent's keys (u1, u2) and the tokens of the turns above its last (before)."""
    deep = F.col("depth") > 0
    mixed = [F.when(deep, F.xxhash64(F.lit(salt), "depth", "d1", "d2")).otherwise(F.lit(0)).alias(name) for salt, name in ((1, "m1"), (2, "m2"))]
    rows = materialise(rows.select("conv", "len", "depth", F.floor(F.col("depth") / SLOT).alias("slot"), *mixed, "words"), "path-turns")
    run = W.partitionBy("conv", "slot").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    over = W.partitionBy("conv").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "slot").agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"), F.sum("words").alias("sw"))
    zero = F.lit(0).cast("long")
    carried = sums.select("conv", "slot", *[F.coalesce(f(c).over(over), zero).alias(to) for f, c, to in ((F.bit_xor, "s1", "c1"), (F.bit_xor, "s2", "c2"), (F.sum, "sw", "cw"))])
    found = rows.select("*", F.bit_xor("m1").over(run).alias("r1"), F.bit_xor("m2").over(run).alias("r2"), F.sum("words").over(run).alias("rw")).join(carried, ["conv", "slot"])
    k1, k2 = F.col("r1").bitwiseXOR(F.col("c1")), F.col("r2").bitwiseXOR(F.col("c2"))
    return found.select("conv", "len", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("m1")).alias("u1"), k2.bitwiseXOR(F.col("m2")).alias("u2"), (F.col("rw") + F.col("cw") - F.col("words")).alias("before"), "words")


def owners(paths: DataFrame) -> DataFrame:
    """Per conversation that owns a node: conv, since (the depth that its own suffix begins at), saved_from (its tokens above), over (owner of the node above) and leaf."""
    member = F.struct("conv", "before", "u1", "u2")
    nodes = materialise(paths.groupBy(*NODE).agg(F.min(member).alias("own"), F.max("len").alias("longest")).select(*NODE, "own.*", "longest"), "nodes")
    start = F.min(F.struct("depth", "before", "u1", "u2")).alias("start")
    each = nodes.groupBy("conv").agg(start, F.max(F.when(F.col("longest") == F.col("depth"), 1).otherwise(0)).alias("leaf")).select("conv", "start.*", "leaf")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv").alias("over"))
    below = each.filter("depth > 0").join(above, ["depth", "u1", "u2"]).select("conv", "depth", "before", "leaf", "over")
    top = each.filter("depth = 0").select("conv", "depth", "before", "leaf", F.lit(None).cast("long").alias("over"))
    return below.unionByName(top).select("conv", F.col("depth").alias("since"), F.col("before").alias("saved_from"), "leaf", "over")


def end_digests(paths: DataFrame) -> DataFrame:
    """Per node with members that end there: NODE and ends_sha256 of their decimal ids in order, comma-joined."""
    ends = paths.filter("depth = len").groupBy(*NODE, F.floor(F.col("conv") / RUN).alias("run"))
    runs = ends.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        schema = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for *node, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if node != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, state.hexdigest()), schema)], schema=schema)

    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "run").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _flag(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0).cast("long"))


def trie(paths: DataFrame) -> DataFrame:
    """Per node of prefixes(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    owned = owners(paths)
    since = F.coalesce("since", F.col("len") + 1)
    # a conversation that owns nothing shares all its tokens
    rows = paths.join(owned, "conv", "left").withColumn("since", since)
    shared = F.when(F.col("depth") >= F.col("since"), F.lit(0)).otherwise(F.coalesce("saved_from", "total") - F.col("before"))
    child = (F.col("since") <= F.col("depth") + 1) & (F.col("depth") < F.col("len"))
    totals = paths.filter("depth = len").select("conv", (F.col("before") + F.col("words")).alias("total"))
    first = F.min(F.struct("conv", "since", "over")).alias("first")
    nodes = rows.join(totals, "conv").groupBy(*NODE).agg(first, F.count(F.lit(1)).alias("n_convs"), _flag(child).alias("n_children"), F.sum(F.coalesce(F.col("leaf").cast("long"), F.lit(0))).alias("n_leaves"), F.sum(shared).alias("saved_tokens"))
    none = hashlib.sha256(b"").hexdigest()
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") > F.col("first.since"), F.col("first.conv")).otherwise(F.col("first.over"))
    return nodes.join(end_digests(paths), NODE, "left").select(F.col("first.conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations after regrafted()."""
    return trie(materialise(prefixes(regrafted(turns(conversations))), "prefixes"))


ORACLE = r"""
    WITH placed AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
        FROM conversations WHERE conv_id IS NOT NULL),
    whole AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY p) AS turns FROM placed GROUP BY conv_id),
    headed AS (
        SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
            lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
        FROM whole),
    rebuilt AS (
        SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
        FROM headed a LEFT JOIN whole b ON b.conv_id = a.conv_id - a.conv_id % 20),
    members AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
    nodes AS (
        SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest,
               (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) END AS saved,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
        FROM members GROUP BY path, d),
    above AS (SELECT path[1:e] AS top, d, e, longest, saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM nodes)),
    sums AS (
        SELECT top, e, count(*) FILTER (WHERE longest = d) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (WHERE d = e + 1) AS n_children
        FROM above GROUP BY top, e)
    SELECT v.conv_id, v.d::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, s.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
    FROM nodes v JOIN sums s ON s.top = v.path AND s.e = v.d
    LEFT JOIN nodes u ON u.d = v.d - 1 AND u.path = v.path[1:v.d - 1] AND v.d > 0"""
