"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest permitted length are cut into full-length pieces and a rest. Pieces
are dealt by a hash of their row into shards of a few thousand; each shard is packed on its own, longest piece
first. A piece goes into the open bin that it fills best. If none has room, a new bin is opened in the
permitted length whose cost per token is least, counting what the shorter pieces still to come can put
into its free space. At the end each bin shrinks to the smallest permitted length that holds its
contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WorkTables, word_count

LENGTHS = (512, 1024, 2048, 4096)
#: Fixed cost of a sequence, in tokens (its share of step overhead); it makes long sequences worth their room.
OVERHEAD = 16


def pack_shard(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each size; sizes must come in descending order."""
    below = np.zeros(max(lengths) + 2, np.int64)  # tokens still to come, by size
    np.add.at(below, sizes + 1, sizes)
    below = np.cumsum(below)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[tuple[int, int]] = []  # (free, bin), ascending
    used: list[int] = []
    seen = 0
    for i, size in enumerate(sizes.tolist()):
        seen += size
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            free, own = open_bins.pop(at)
        else:
            own, best = len(used), None
            for length in lengths:
                if length < size:
                    continue
                room = length - size
                # Pieces still to come are no longer than this one; those that fit the room may fill it.
                ahead = int(below[min(room, size) + 1]) if room < size else int(below[-1]) - seen
                cost = (length + overhead) / (size + min(room, max(0, ahead)))
                if best is None or cost < best[0]:
                    best = (cost, length)
            free = best[1]
            used.append(0)
        bins[i], offsets[i] = own, used[own]
        used[own] += size
        if free > size:
            insort(open_bins, (free - size, own))
    final = np.array(sorted(lengths))[np.searchsorted(sorted(lengths), np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if len(bins) else final


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, n_tokens, shard, bin, bin_offset, bin_length``.

    A token is a word; ``start`` is the piece's first word in its document. Defined cases: null, empty
    and blank texts have no tokens and take one piece of 0 tokens with null shard, bin, offset and
    length; a null id is an ordinary value; repeated rows are packed as often as they come; ties in size
    are broken by id, piece and row. A text of any length is cut without being held as an array. Other columns are
    ignored, so their names can't clash. An empty table gives an empty result.
    """
    longest = max(lengths)
    tables = WorkTables(docs.sparkSession)
    # Rows are numbered and written: shards go by row, so that one id (or none) on most rows can't fill a shard.
    counted = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), word_count(F.col(text_col)).alias("n")).withColumn("row", F.monotonically_increasing_id())
    counted = tables.save(counted, "counts")
    pieces = counted.where("n > 0").select(
        "doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / longest))).alias("piece")
    ).select("doc_id", "row", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("bigint"), F.col("n") - F.col("piece") * longest).alias("n_tokens"))
    many = counted.agg(F.sum(F.ceil(F.col("n") / longest))).first()[0] or 0
    shards = max(1, -(-int(many) // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit("shard")), F.lit(shards)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable").drop(columns="row")
        frame["bin"], frame["bin_offset"], frame["bin_length"] = pack_shard(frame["n_tokens"].to_numpy(np.int64), lengths)
        return frame

    packed = dealt.groupBy("shard").applyInPandas(run, "doc_id bigint, piece bigint, start bigint, n_tokens bigint, shard bigint, bin bigint, bin_offset bigint, bin_length bigint")
    nothing = F.lit(None).cast("bigint")
    blank = counted.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n_tokens"), nothing.alias("shard"), nothing.alias("bin"), nothing.alias("bin_offset"), nothing.alias("bin_length"))
    return packed.unionByName(blank)
