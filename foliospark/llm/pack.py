"""Filling containers of fixed capacity: best fit with bitmaps of what a container holds.

Items come in order of falling size. The open containers lie in order of the room
they have left; the search starts at the tightest that takes the item and goes on
to the next until one is found that is compatible: it holds no copy of the item's
text (letters and digits alone count), and no more sources than allowed. If none is, a
new container is opened, unless copies alone stand against it: then the tightest of
these is taken (not if ``strict``), as a copy beside a copy costs nothing while a third
of all items may be copies of one text, and the row says so.

No task packs an unbounded group: a group is divided into shards of at most
``SHARD`` items by a dense index, or by a hash where the number of shards follows the
number of items. A shard leaves at most a few containers part-filled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import split

SHARD = 8_192


def cluster(text: Column) -> Column:
    """Equal for texts of equal letters and digits, whatever their case, blanks and marks."""
    return F.xxhash64(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def fill(sizes: list[int], clusters: list[int], sources: list, capacity: int, max_sources: int | None = None, strict: bool = False) -> list[tuple[int, bool]]:
    """For items by falling size, equals by cluster: the container of each, and whether it is compatible."""
    bits: dict[int, int] = {}
    several: set[int] = set()
    seen: set[int] = set()
    for c in clusters:
        (several if c in seen else seen).add(c)
    source_bit: dict = {}
    rooms: list[tuple[int, int]] = []  # (room, container), in order
    copies: list[int] = []  # bitmap of the clusters of more than one item
    held: list[int] = []  # bitmap of the sources
    out: list[tuple[int, bool]] = []
    last, resume = None, 0
    for size, cluster, source in zip(sizes, clusters, sources):
        bit = 1 << bits.setdefault(cluster, len(bits)) if cluster in several else 0
        s = 1 << source_bit.setdefault(source, len(source_bit))
        first = bisect_left(rooms, (size, -1))
        at = max(first, resume) if last == (size, cluster, source) else first
        beside = None
        while at < len(rooms):
            b = rooms[at][1]
            if max_sources is None or (held[b] | s).bit_count() <= max_sources:
                if not copies[b] & bit:
                    break
                beside = at if beside is None else beside
            at += 1
        fits = True
        if at == len(rooms) and not strict:
            if beside is None and at > first and resume > first:  # as for the equal item before, without compatible ones
                beside = next((k for k in range(first, len(rooms)) if max_sources is None or (held[rooms[k][1]] | s).bit_count() <= max_sources), None)
            if beside is not None:
                at, fits = beside, False
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(copies)
            copies.append(0)
            held.append(0)
        copies[b] |= bit
        held[b] |= s
        insort(rooms, (room - size, b))
        last, resume = (size, cluster, source), at + 1 if fits else len(rooms)
        out.append((b, fits))
    return out


def pack(items: DataFrame, group: str, shard: str, strict: bool = False) -> DataFrame:
    """Containers for items (group, shard, item_key, part, size, cluster, source, capacity, max_sources; the last two alike in a group, max_sources null without a limit).

    Adds container_no (from 0 within group and shard), compatible, and drops cluster and max_sources.
    Every size must be within the capacity. Items of one group and shard are packed
    by one task, others never meet in a container.
    """
    cols = [group, shard, "item_key", "part", "size", "cluster", "source", "capacity", "max_sources"]
    src = items.select(*cols).repartition(group, shard).sortWithinPartitions(group, shard, F.desc("size"), "cluster", "source", "item_key", "part")
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def emit(rows: pa.Table) -> pa.RecordBatch:
        placed = fill(rows["size"].to_pylist(), rows["cluster"].to_pylist(), rows["source"].to_pylist(), rows["capacity"][0].as_py(), rows["max_sources"][0].as_py(), strict)
        t = rows.drop_columns(["cluster", "max_sources"]).append_column("container_no", pa.array([b for b, _ in placed], pa.int32())).append_column("compatible", pa.array([c for _, c in placed], pa.bool_()))
        return t.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            pairs = list(zip(t[group].to_pylist(), t[shard].to_pylist()))
            start = 0
            for k, p in enumerate(pairs):
                if p != key:
                    if k > start:
                        held.append(t.slice(start, k - start))
                    if held:
                        yield emit(pa.concat_tables(held))
                    held, key, start = [], p, k
            held.append(t.slice(start))
        if held:
            yield emit(pa.concat_tables(held))

    out = [c for c in cols if c not in ("cluster", "max_sources")]
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in out) + ", container_no int, compatible boolean")


def containers(blocks: DataFrame, documents: DataFrame, budgets: DataFrame, max_sources: int | None = None, strict: bool = False) -> DataFrame:
    """All texts of blocks (per stem) and of documents (together) in containers of the 'pack' capacities.

    Columns: table_name, stem (null for documents), shard, container_no, item_key,
    part, size, source, capacity, compatible. A text above the capacity is divided
    at natural boundaries, without overlap, into parts numbered from 1; any other
    text has part 0. A null text is no item; an empty or blank one is, as it stands.
    Rows repeated under one key are one item; a null key part counts as empty.
    ``max_sources`` holds for documents; the blocks of a container are of one paper.
    """
    small = F.broadcast(split.limits(budgets, "pack").drop("overlap_chars"))  # a row per table
    b = blocks.where("text is not null").select(
        F.lit("blocks").alias("table_name"), F.coalesce("stem", F.lit("")).alias("stem"),
        F.floor(F.coalesce("block_ix", F.lit(0)) / SHARD).cast("int").alias("shard"),
        F.concat(F.coalesce("stem", F.lit("")), F.lit("/"), F.coalesce(F.col("block_ix").cast("string"), F.lit(""))).alias("item_key"),
        F.lower("type").alias("source"), "text",
    )
    d = documents.where("text is not null")
    shards = max(1, -(-d.count() // SHARD))
    d = d.select(
        F.lit("documents").alias("table_name"), F.lit("").alias("stem"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item_key"), "source", "text",
    )
    items = b.unionByName(d).join(small, "table_name").withColumn("n", F.length("text")).withColumn("home", F.concat_ws("\u0001", "table_name", "stem"))
    base = ["table_name", "stem", "home", "shard", "item_key", "source", "max_chars"]
    whole = items.where("n <= max_chars").select(*base, F.lit(0).alias("part"), F.col("n").alias("size"), cluster(F.col("text")).alias("cluster"))
    parts = split.pieces(items.where("n > max_chars").withColumn("none", F.lit(0)), base, "max_chars", "none")
    parts = parts.select(*base, F.col("piece_no").alias("part"), (F.col("end_char") - F.col("start_char")).cast("int").alias("size"), cluster(F.col("piece")).alias("cluster"))
    every = whole.unionByName(parts).repartition("home", "shard").dropDuplicates(["home", "shard", "item_key", "part"])
    most = F.when(F.startswith("home", F.lit("documents")), F.lit(max_sources)).cast("int")
    packed = pack(every.withColumnRenamed("max_chars", "capacity").withColumn("max_sources", most), "home", "shard", strict)
    return packed.select(
        F.expr("substring_index(home, '\u0001', 1)").alias("table_name"), F.when(F.expr("substring_index(home, '\u0001', 1)") == "blocks", F.expr("substring(home, instr(home, '\u0001') + 1)")).alias("stem"),
        "shard", "container_no", "item_key", "part", "size", "source", "capacity", "compatible",
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """Per table: items, containers, characters, capacity, the part filled, and the least number of containers thinkable.

    The least number is, per stem (for documents over all), the characters divided by the capacity, rounded up.
    """
    home = ["table_name", "stem"]
    per = packed.groupBy(*home, "shard", "container_no").agg(F.count("*").alias("items"), F.sum("size").alias("chars"), F.max("capacity").alias("capacity"), F.count_if(~F.col("compatible")).alias("beside_copy"))
    per = per.groupBy(*home).agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("chars").alias("chars"), F.max("capacity").alias("capacity"), F.sum("beside_copy").alias("beside_copy"))
    per = per.withColumn("least", F.greatest(F.lit(1), F.ceil(F.col("chars") / F.col("capacity"))))
    out = per.groupBy("table_name").agg(F.sum("items").alias("items"), F.sum("containers").alias("containers"), F.sum("chars").alias("chars"), F.sum("least").alias("least_containers"), F.sum("beside_copy").alias("beside_copy"), F.sum(F.col("containers") * F.col("capacity")).alias("room"))
    return out.select("table_name", "items", "containers", "least_containers", "chars", "room", F.round(F.col("chars") / F.col("room"), 6).alias("filled"), "beside_copy")
