"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities. A flow from old to new shards that costs nothing where a byte stays in
its shard and one where it moves tells how many bytes go where; blocks of documents then follow the flow, and only
files of shards that give or take blocks are written again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

#: Rows of a shard's file, about.
FILE_ROWS = 10_000


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost with all of supply[i] sent and at most capacity[j] received.

    Successive shortest paths on the residual graph; its size is old times new shards, whatever the data's size.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold what the old ones have")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford from all old shards with something left; nodes 0..n-1 are old, n..n+m-1 new shards.
        dist = [0 if x else None for x in left] + [None] * m
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + cost[i][j] < dist[n + j]):
                        dist[n + j], back[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] is not None and (dist[i] is None or dist[n + j] - cost[i][j] < dist[i]):
                        dist[i], back[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((n + j for j in range(m) if room[j] and dist[n + j] is not None), key=lambda v: dist[v])
        path, v = [], end
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        amount = min([left[v], room[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return flow


def stay_or_move(supply: Sequence[int], capacity: Sequence[int]) -> list[tuple[int, int, int]]:
    """(old, new, amount): min_cost_flow's for a cost of 0 where a byte stays in its shard and of 1 in any other, on a sparse network.

    All moves cost the same, so they may pass one hub: successive shortest paths are then those that stay, as far as capacities go, and after
    them those from the shards with something left, through the hub, to the ones with room, in order. There are as many amounts as shards, not as pairs of them.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold what the old ones have")
    kept = [min(s, capacity[i]) if i < len(capacity) else 0 for i, s in enumerate(supply)]
    flow = [(i, i, k) for i, k in enumerate(kept) if k]
    room = [c - (kept[j] if j < len(kept) else 0) for j, c in enumerate(capacity)]
    j = 0
    for i, left in enumerate(s - k for s, k in zip(supply, kept, strict=True)):
        while left:
            while not room[j]:
                j += 1
            amount = min(left, room[j])
            flow.append((i, j, amount))
            left, room[j] = left - amount, room[j] - amount
    return flow


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 2000, least_blocks: int = 256) -> DataFrame:
    """One row (id, size, text_crc32, old_shard, shard, slot) for each row of docs; size is the text's UTF-8 bytes plus 8.

    New shards 0.. take over old shards 0..; all get equal capacities in bytes. Documents move in blocks of about
    block_rows rows, at least least_blocks in an old shard, chosen by a hash of the id, so that a block is bounded whatever
    the sources are. A shard ends at most half a block beside its capacity for each old shard that it takes from; within
    an old shard large blocks stay and small ones move, so the cuts fall between small blocks. slot runs without gaps from
    0 within a shard.

    A null text has no bytes (size 8) and the CRC of nothing, 0; a null id is an id like any other; rows with equal ids are in
    one block, and equal rows take neighbouring slots in any order; other columns are neither read nor returned; an empty table gives no rows.
    old_shard must give 0 to n_old - 1.
    """
    rows, placed, _ = _plan(docs, old_shard, n_old, n_new, id_col, text_col, block_rows, least_blocks)
    in_block = Window.partitionBy("old_shard", "block").orderBy("id", "text_crc32", "size")
    return rows.join(placed, ["old_shard", "block"]).select(F.col("id").alias(id_col), "size", "text_crc32", "old_shard", "shard", (F.col("offset") + F.row_number().over(in_block) - 1).cast("long").alias("slot"))


def _body(text_col: str) -> tuple[Column, Column]:
    """A text's size and CRC."""
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return (F.octet_length(body) + 8).cast("long"), F.crc32(body)


def _plan(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, id_col: str, text_col: str, block_rows: int = 2000, least_blocks: int = 256) -> tuple[DataFrame, DataFrame, Callable[[str], Column]]:
    """The rows' sizes with their blocks; each block's shard and first slot there; and the block of an id beside its old_shard."""
    size, crc = _body(text_col)
    rows = materialize(docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), old_shard.cast("int").alias("old_shard")), "sizes")
    spark = docs.sparkSession

    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("old_shard").agg(F.sum("size"), F.count(F.lit(1))).collect()}  # at most n_old rows
    supply = [totals.get(i, (0, 0))[0] for i in range(n_old)]
    capacity = even(sum(supply), n_new)
    flows: list[list[tuple[int, int]]] = [[] for _ in range(n_old)]  # what stays first
    for i, j, amount in stay_or_move(supply, capacity):
        flows[i].append((j, amount))
    cuts, blocks_of = [], []
    for i in range(n_old):
        blocks_of.append((i, max(least_blocks, -(-totals.get(i, (0, 0))[1] // block_rows))))
        at = 0
        for k, (j, amount) in enumerate(flows[i]):
            cuts.append((i, j, float("-inf") if k == 0 else float(at), float("inf") if k == len(flows[i]) - 1 else float(at + amount)))
            at += amount

    per_old = F.element_at(F.create_map(*[F.lit(x) for pair in blocks_of for x in pair]), F.col("old_shard"))
    block = lambda id_col: F.pmod(F.xxhash64(F.lit(7), id_col), per_old.cast("long"))
    rows = rows.withColumn("block", block("id"))
    sizes = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("b_size"), F.count(F.lit(1)).alias("b_rows"))
    in_old = Window.partitionBy("old_shard").orderBy(F.desc("b_size"), "block").rowsBetween(Window.unboundedPreceding, 0)
    bounds = spark.createDataFrame(cuts, "c_old int, shard int, low double, high double")  # at most n_old + n_new amounts of moves, and n_old that stay
    middle = F.sum("b_size").over(in_old) - F.col("b_size") / 2
    placed = sizes.withColumn("middle", middle).join(F.broadcast(bounds), (F.col("old_shard") == F.col("c_old")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))
    in_new = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("old_shard", "block", "shard", (F.sum("b_rows").over(in_new) - F.col("b_rows")).alias("offset"))
    return rows, materialize(placed, "blocks"), block


def _touched(moves: DataFrame) -> list[int]:
    """The shards that give or take something; shard numbers only."""
    return sorted({r[0] for r in moves.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard"))).distinct().collect()})


def _replace(rows: DataFrame, touched: Sequence[int], filled: set[int], path: str) -> None:
    """Write rows, which lie together by shard, as the files of their shards in place of the present ones; a touched shard that is not filled loses its files."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    jvm = rows.sparkSession._jvm
    for shard in set(touched) - filled:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def rewrite(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Reshard docs as reshard does, write the affected shards to path/shard=N, and return reshard's columns as the files have them.

    A file holds whole rows of docs in the order of their slots, with slot and old_shard beside them. Only shards that give or take documents are written,
    in place of the files that path has of them; the rows of the others stay where docs has them and are returned from there.
    Rows go with their blocks, not by a join on the id, so null and repeated ids are rows like any other. docs must not have columns named as the new ones.
    """
    added = ["shard", "slot", "old_shard"]
    if clash := set(added) & {c.lower() for c in docs.columns}:
        raise ValueError(f"rename {sorted(clash)}: the files have columns of that name")
    spark = docs.sparkSession
    _, placed, block = _plan(docs, old_shard, n_old, n_new, id_col, text_col)
    touched = _touched(placed)
    size, crc = _body(text_col)
    # block, offset, size and CRC are kept apart from the documents' own columns, whose names are free.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), old_shard.cast("int").alias("old_shard"), F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"))
    rows = rows.withColumn("block", block("id")).join(F.broadcast(placed), ["old_shard", "block"]).withColumn("file", F.floor(F.col("offset") / FILE_ROWS))
    in_block = Window.partitionBy("shard", "file", "old_shard", "block").orderBy("id", "text_crc32", "size")
    slot = (F.col("offset") + F.row_number().over(in_block) - 1).cast("long").alias("slot")
    names = ["id", "size", "text_crc32", "old_shard", "shard", "slot"]
    stays = rows.where(~F.col("shard").isin(touched)).select(*names[:-1], slot)
    if touched:
        filled = {r[0] for r in placed.select("shard").distinct().collect()}  # at most n_new
        moved = rows.where(F.col("shard").isin(touched)).repartition("shard", "file").select("doc", "old_shard", "shard", slot)
        _replace(moved.sortWithinPartitions("shard", "slot").select("doc.*", "slot", "old_shard", "shard"), touched, filled, path)
        written = spark.read.schema(docs.select("*", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("old_shard"), F.lit(0).alias("shard")).schema).parquet(path)
        written = written.where(F.col("shard").isin(touched)).select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), "old_shard", "shard", "slot")
        stays = written.unionByName(stays) if n_old + n_new > len(touched) else written
    return stays.withColumnRenamed("id", id_col)


def rewrite_affected(docs: DataFrame, moves: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Write the files of the shards that give or take documents to path/shard=N in place of the present ones, and return these shards' numbers.

    docs has the rows of which moves tells the places; null and repeated ids are matched as the first, second ... row of an id, each once
    (of an id and an old_shard, where docs has that column, which it must if an id is in several old shards). Shards that nothing leaves or enters
    are not read for writing and keep their files.
    """
    touched = _touched(moves)
    keys = [id_col, *(c for c in docs.columns if c == "old_shard")]
    nth = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    part = moves.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("shard").alias("m_shard"), F.col("slot").alias("m_slot"), nth("slot").alias("m_nth"))
    match = F.col("nth") == F.col("m_nth")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"m_{k}"))
    rows = docs.withColumn("nth", nth(id_col)).join(part, match).where(F.col("m_shard").isin(touched))
    rows = rows.select(*docs.columns, F.col("m_shard").alias("shard"), F.col("m_slot").alias("slot")).repartition("shard", F.floor(F.col("slot") / 100_000))
    if touched:
        filled = {r[0] for r in moves.select("shard").distinct().collect()}  # shard numbers only
        _replace(rows.sortWithinPartitions("shard", "slot"), touched, filled, path)
    return touched
