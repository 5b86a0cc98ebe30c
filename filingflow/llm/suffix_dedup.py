"""Removal of byte strings that occur more than once, by sharded suffix arrays.

Every byte that lies in a string of ``length`` bytes (a window) that also
starts anywhere else, in the same text or another one, is removed.  Windows
never cross texts, and all are judged on the input.

1. Anchors.  The anchor of a window is its leftmost ``GRAM``-byte string of
   least hash, so equal windows have equal anchors at equal offsets.  The
   windows of one anchor are consecutive; together they span the anchor's
   context.  About one position in 70 is an anchor.  Contexts that occur again
   in the same block of texts are repeated in full; their spans are known at
   once, and one of each goes on with the number of its copies.  Only anchors
   whose string occurs twice go on, found by grouped sums; no window is lost.
2. Contexts that occur twice, as whole byte strings, are repeated in full.  One
   of each is kept as a partner for contexts with the same anchor that occur once.
3. Shards of such contexts, all of an anchor in one shard, get a suffix array
   each: sorting by the first seven bytes, then Larsson-Sadakane refinement,
   where each round sorts the groups still tied by the rank of the suffix h
   bytes further on and doubles h.  Kasai's algorithm gives the common prefix
   of each group with the one before it, in lanes, one per context.  A window
   is repeated if a neighbour shares ``length`` bytes with it.
4. An anchor with more than ``HOT`` contexts is salted over several shards.
   Their windows are merged across shards afterwards: sets of 16 windows whose
   common core no other shard has are out, the rest meet in buckets by hash,
   where each shard's sorted run is searched for in the others by bisection.

Contexts of one anchor are compared by 64-bit hash of anchor and of context,
windows across shards by 128 bits, windows within a shard byte by byte.

Defined results: null and empty texts have nothing to remove; every row takes
part, with or without an id; rows equal in id and text repeat each other, so
their windows are removed from both; other columns are carried along, those
named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingflow.llm.store import Scratch
from filingflow.llm.textblocks import blocks, flat, mix, prefix_hash, span_hash

LENGTH = 200
#: Bytes of an anchor, at most LENGTH.
GRAM = 64
#: Contexts of one anchor in one shard, and contexts in a shard on average.
HOT, SHARD = 3000, 6000
_CORE = 16


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(text, anchor hash, context hash, anchor, first window, last window) of all anchors; positions in buf."""
    n = len(buf)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    prefix = prefix_hash(buf)
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, span, least = length - gram + 1, 1, key
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    starts = n - length + 1
    least = np.minimum(least[:starts], least[width - span:width - span + starts])
    fits = np.arange(starts) + length <= np.repeat(offs[1:], np.diff(offs))[:starts]
    s = np.flatnonzero(fits)
    if not len(s):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    p = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    p, s0, s1 = p[first], s[first], s[np.append(first[1:], len(s)) - 1]
    context = mix(span_hash(prefix, s0, s1 + length) + (p - s0).astype(np.uint64), 3)
    return np.searchsorted(offs, s0, "right") - 1, h[p], context, p, s0, s1


_ANCHOR_OUT = "key long, tag int, gram long, context long, at long, copies long, start long, end long"


def _copies(gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    """How often each context of an anchor occurs, at its first place; 0 at the others."""
    order = np.lexsort((context, gram))  # stable
    new = np.ones(len(order), bool)
    new[1:] = (gram[order[1:]] != gram[order[:-1]]) | (context[order[1:]] != context[order[:-1]])
    first = np.flatnonzero(new)
    copies = np.zeros(len(order), np.int64)
    copies[order[first]] = np.diff(np.append(first, len(order)))
    return copies


def _anchor_rows(length: int, gram: int):
    """The first place of every context of a block with the number of its copies there, and the spans of the other places."""
    def run(batches):
        for batch in batches:
            for a, b, buf, offs in blocks(batch.column("text")):
                text, g, c, p, s0, s1 = anchors(buf, offs, length, gram)
                copies = _copies(g, c)
                one, more = np.flatnonzero(copies), np.flatnonzero(copies == 0)
                row, nothing = pa.array(text[one] + a), pa.nulls(len(one), pa.int64())
                at = ((p - offs[text]) << 32 | (p - s0) << 16 | (p - s1))[one]
                names = ["key", "tag", "gram", "context", "at", "copies", "start", "end"]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(row), batch.column("tag").take(row), pa.array(g[one].view(np.int64)), pa.array(c[one].view(np.int64)), pa.array(at), pa.array(copies[one]), nothing, nothing], names)
                if len(more):
                    text, start, end = text[more], s0[more] - offs[text[more]], s1[more] + length - offs[text[more]]
                    new = np.ones(len(more), bool)
                    new[1:] = (text[1:] != text[:-1]) | (start[1:] > end[:-1])  # spans that meet are one
                    first = np.flatnonzero(new)
                    row, nothing = pa.array(text[first] + a), pa.nulls(len(first), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(row), batch.column("tag").take(row), nothing, nothing, nothing, nothing, pa.array(start[first]), pa.array(end[np.append(first[1:], len(more)) - 1])], names)
    return run


def suffix_groups(buf: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of all positions, each suffix ending at its end[p], compared over depth bytes at least.

    The rank is the index of the first of the suffixes that are still tied.
    """
    n = len(buf)
    place = np.arange(n)
    key = np.zeros(n, np.int64)
    padded = np.append(buf, np.zeros(7, np.uint8)).astype(np.int64) + 1  # 0 is the end of a suffix
    for j in range(7):
        key = key << 9 | np.where(place + j < end, padded[j:j + n], 0)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(start, np.diff(np.append(start, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # indices of the suffix array in groups of two or more
    h = 7
    while h < depth and len(tied):
        p = sa[tied]
        further = np.where(p + h < end[p], rank[np.minimum(p + h, n - 1)] + 1, 0)
        key = rank[p] * (n + 1) + further
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[tied] = p
        new = np.ones(len(p), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        rank[p] = np.repeat(tied[start], np.diff(np.append(start, len(p))))
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, rank


def common_prefixes(buf: np.ndarray, end: np.ndarray, sa: np.ndarray, rank: np.ndarray, first: np.ndarray, count: np.ndarray, cap: int) -> np.ndarray:
    """Kasai: bytes that p shares with the suffix before its group, up to cap, for p in the lanes first + 0..count-1 (else 0)."""
    n = len(buf)
    padded = np.append(buf, np.zeros(8, np.uint8))
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view("<u8").ravel()
    out = np.zeros(n, np.int64)
    shared = np.zeros(len(first), np.int64)
    lane = np.arange(len(first))
    for step in range(int(count.max(initial=0))):
        lane = lane[count[lane] > step]
        p = first[lane] + step
        h = np.maximum(shared[lane] - 1, 0)  # the next suffix shares all but the first byte
        has = rank[p] > 0
        q = np.where(has, sa[rank[p] - 1], 0)
        most = np.where(has, np.minimum(np.minimum(end[p] - p, end[q] - q), cap), 0)
        open_ = np.flatnonzero(h < most)
        while len(open_):
            x = word[p[open_] + h[open_]] ^ word[q[open_] + h[open_]]
            equal = np.where(x == 0, 8, np.log2((x & (~x + np.uint64(1))).astype(float) + (x == 0)).astype(np.int64) >> 3)
            h[open_] += equal
            open_ = open_[(equal == 8) & (h[open_] < most[open_])]
        h = np.minimum(h, most)
        out[p] = h
        shared[lane] = h
    return out


def repeated_windows(contexts: pa.Array, windows: np.ndarray, length: int):
    """(offs, repeated, representative) over the bytes of a shard's contexts; windows: starts per context."""
    buf, offs = flat(contexts)
    n = len(buf)
    end = np.repeat(offs[1:], np.diff(offs))
    sa, rank = suffix_groups(buf, end, length)
    shared = common_prefixes(buf, end, sa, rank, offs[:-1], windows, length)
    # classes of windows: neighbours in the suffix array that share length bytes, runs of groups
    is_start = np.zeros(n + 1, np.int64)
    np.add.at(is_start, offs[:-1], 1)
    np.add.at(is_start, offs[:-1] + windows, -1)
    is_start = np.cumsum(is_start)[:n] > 0
    p = sa[is_start[sa]]
    group = rank[p]
    joins = np.zeros(len(p), bool)
    joins[1:] = (group[1:] == group[:-1]) | (shared[p[1:]] >= length)
    first = np.flatnonzero(~joins)
    size = np.diff(np.append(first, len(p)))
    repeated, representative = np.zeros(n, bool), np.zeros(n, bool)
    repeated[p] = np.repeat(size > 1, size)
    representative[p[first]] = True
    return offs, repeated, representative


def _runs(flag: np.ndarray):
    """(first, last) of every run of True."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _unpack(at: np.ndarray):
    """(anchor, windows before the anchor, number of windows)"""
    return at >> 32, at >> 16 & 0xFFFF, (at >> 16 & 0xFFFF) - (at & 0xFFFF) + 1


_SHARD_OUT = "key long, tag int, start long, end long, at long, core long, reps int, open int, shard long"


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        anchor, before, windows = _unpack(at)
        offs, repeated, representative = repeated_windows(table.column("bytes").combine_chunks(), windows, length)
        begin = anchor - before - offs[:-1]  # text position = byte of the shard + begin
        single = table.column("n").to_numpy() == 1
        x, y = _runs(repeated)
        row = np.searchsorted(offs, x, "right") - 1
        # a run may go on into the next context: windows of a context are followed by length - 1 other bytes, so it cannot
        keep = single[row]
        x, y, row = x[keep], y[keep], row[keep]
        nothing = pa.nulls
        parts = [pa.table([table.column("key").take(row), table.column("tag").take(row), pa.array(x + begin[row]), pa.array(y + begin[row] + length),
                           nothing(len(row), pa.int64()), nothing(len(row), pa.int64()), nothing(len(row), pa.int32()), nothing(len(row), pa.int32()), nothing(len(row), pa.int64())],
                          names=["key", "tag", "start", "end", "at", "core", "reps", "open", "shard"])]
        hot = table.column("hot").to_numpy()
        if hot.any():
            buf, _ = flat(table.column("bytes"))
            prefix = prefix_hash(buf)
            is_rep = np.flatnonzero(representative)
            r = np.searchsorted(offs, is_rep, "right") - 1
            is_rep, r = is_rep[hot[r]], r[hot[r]]
            o = before[r] - (is_rep - offs[r])  # bytes before the anchor
            block = o // _CORE
            core = offs[r] + before[r] - block * _CORE
            h = span_hash(prefix, core, core + length - _CORE + 1)
            h = mix(h + table.column("gram").to_numpy()[r].view(np.uint64) + block.astype(np.uint64), 5)
            key = r * (1 << 16) + block
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            bit = np.left_shift(1, o % _CORE)
            free = np.where(~repeated[is_rep] & single[r], bit, 0)
            if len(first):
                bit, free = np.bitwise_or.reduceat(bit, first), np.bitwise_or.reduceat(free, first)
            row = r[first]
            parts.append(pa.table([table.column("key").take(row), table.column("tag").take(row), nothing(len(row), pa.int64()), nothing(len(row), pa.int64()), pa.array(at[row]), pa.array(h[first].view(np.int64)),
                                   pa.array(bit | block[first] << 16, pa.int32()), pa.array(free, pa.int32()), table.column("shard").take(row)], names=parts[0].column_names))
        return pa.concat_tables(parts)
    return run


def _windows(length: int):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            buf, offs = flat(batch.column("bytes"))
            prefix = prefix_hash(buf)
            anchor, before, _ = _unpack(batch.column("at").to_numpy())
            reps, free = batch.column("reps").to_numpy(), batch.column("open").to_numpy()
            bits = np.arange(_CORE)
            r, bit = np.nonzero(reps[:, None] >> bits & 1)
            o = (reps[r] >> 16) * _CORE + bit
            s = offs[r] + before[r] - o
            h = span_hash(prefix, s, s + length)
            second = mix(span_hash(prefix, s, s + length // 2), 7) + mix(span_hash(prefix, s + length // 3, s + length), 8)
            start = anchor[r] - o
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(r)), batch.column("tag").take(pa.array(r)), pa.array(start), pa.array(h.view(np.int64)), pa.array(second.view(np.int64)),
                                              pa.array((free[r] >> bit & 1).astype(bool)), batch.column("shard").take(pa.array(r))], ["key", "tag", "start", "h1", "h2", "open", "shard"])
    return run


def _merge(length: int):
    def run(table: pa.Table) -> pa.Table:
        h = np.empty(table.num_rows, [("a", "i8"), ("b", "i8")])
        h["a"], h["b"] = table.column("h1").to_numpy(), table.column("h2").to_numpy()
        _, code = np.unique(h, return_inverse=True)  # dense codes in hash order
        shard = table.column("shard").to_numpy()
        order = np.lexsort((code, shard))
        cuts = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1]))
        everywhere = np.sort(code)
        found = np.zeros(len(code), bool)
        for run_ in np.split(order, cuts[1:]):  # a shard's sorted run, searched for among all shards' windows
            mine = code[run_]
            total = np.searchsorted(everywhere, mine, "right") - np.searchsorted(everywhere, mine, "left")
            own = np.searchsorted(mine, mine, "right") - np.searchsorted(mine, mine, "left")
            found[run_] = total > own
        hit = pa.array(np.flatnonzero(found & table.column("open").to_numpy(zero_copy_only=False)))
        out = table.select(["key", "tag", "start"]).take(hit)
        start = out.column("start").to_numpy()
        return out.append_column("end", pa.array(start + length))
    return run


def _fetch(length: int):
    def run(batches):
        for batch in batches:
            for first, last, buf, offs in blocks(batch.column("text")):
                wanted = batch.column("wanted").slice(first, last - first)
                row = np.repeat(np.arange(last - first), wanted.value_lengths().to_numpy())
                w = wanted.flatten()
                at = w.field("at").to_numpy()
                anchor, before, windows = _unpack(at)
                start = offs[row] + anchor - before
                data = [buf[s:e].tobytes() for s, e in zip(start.tolist(), (start + windows + length - 1).tolist())]
                source = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([w.field("gram"), w.field("n"), w.field("hot"), w.field("shard"), batch.column("key").take(source), batch.column("tag").take(source), pa.array(at), pa.array(data, pa.binary())],
                                                 ["gram", "n", "hot", "shard", "key", "tag", "at", "bytes"])
    return run


def _whole_characters(buf: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """``kept`` without the bytes of characters of which a byte is not kept."""
    first = np.flatnonzero((buf & 0xC0) != 0x80)
    if kept.all() or not len(first):
        return kept
    size = np.diff(np.append(first, len(buf)))
    return kept & np.concatenate([np.ones(first[0], bool), np.repeat(np.logical_and.reduceat(kept, first), size)])


def _cut(keep: list[str], characters: bool):
    def run(batches):
        for batch in batches:
            for first, last, buf, offs in blocks(batch.column(len(keep))):
                n = last - first
                spans = batch.column(len(keep) + 1).slice(first, n)
                s = spans.flatten()
                row = np.repeat(np.arange(n), spans.value_lengths().fill_null(0).to_numpy())
                # coverage as a running sum of starts and ends; the slot after a text takes its ends
                shift = np.arange(n)
                edge = np.zeros(len(buf) + n + 1, np.int32)
                np.add.at(edge, offs[row] + shift[row] + s.field("start").to_numpy(), 1)
                np.add.at(edge, offs[row] + shift[row] + s.field("end").to_numpy(), -1)
                covered = np.cumsum(edge)[:-1] > 0
                x, y = _runs(covered)  # never across texts: the slot after a text is not covered
                owner = np.searchsorted(offs[:-1] + shift, x, "right") - 1
                base = offs[owner] + shift[owner]
                slot = np.ones(len(covered), bool)
                slot[offs[1:] + shift] = False
                kept = ~covered[slot]
                if characters:
                    kept = _whole_characters(buf, kept)
                left = np.concatenate([[0], np.cumsum(kept)])[offs]
                data = buf[kept].tobytes()
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(x - base), pa.array(y - base + 1)], ["start", "end"]))
                texts = pa.array([data[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, n) for c in range(len(keep))] + [texts, found, pa.array(np.diff(offs))], keep + ["kept_bytes", "spans", "n_bytes"])
    return run


def _rounded(n: float) -> int:
    return max(1, int(-(-n // 1)))


def remove_repeats(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, characters: bool = False) -> DataFrame:
    """The rows without ``text_col``, with kept_bytes (binary), spans (repeated, in bytes: start, end) and n_bytes.

    With ``characters``, kept_bytes also lacks the other bytes of characters that a span cuts.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.col(text_col).cast("string")
    keyed = df.withColumns({"__key": F.xxhash64(F.col(id_col), text), "__tag": F.hash(text)})
    source = keyed.select(F.col("__key").alias("key"), F.col("__tag").alias("tag"), text.alias("text"))
    # 1. anchors that occur twice
    made = scratch.put(source.mapInArrow(_anchor_rows(length, gram), _ANCHOR_OUT), "anchors")
    again = scratch.put(made.where("start is not null").select("key", "tag", "start", "end"), "again")
    all_anchors = made.where("start is null").drop("start", "end")
    # written, so that the join below reads two plain shuffles and Spark can split a hot anchor
    twice = scratch.put(all_anchors.groupBy("gram").agg(F.sum("copies").alias("times")).where("times > 1").select("gram"), "twice")
    shared = scratch.put(all_anchors.join(twice, "gram"), "shared")
    scratch.drop("anchors", "twice")
    # 2. whole contexts
    order = F.xxhash64("key", "tag", "at")
    kinds = scratch.put(shared.groupBy("gram", "context").agg(F.sum("copies").alias("n"), F.min(order).alias("first")), "kinds")
    covered = shared.join(kinds.where("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    anchor, before = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(0xFFFF)
    covered = covered.select("key", "tag", (anchor - before).alias("start"), (anchor - F.col("at").bitwiseAND(0xFFFF) + length).alias("end"))
    # 3. contexts of anchors that have several
    several = scratch.put(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("singles")).where("kinds > 1 and singles > 0"), "several")
    open_kinds = kinds.join(several, "gram")
    wanted = shared.join(open_kinds, ["gram", "context"]).where((F.col("n") == 1) | (F.col("first") == order))
    shards = _rounded((several.agg(F.sum("kinds")).first()[0] or 0) / shard)
    is_hot = F.col("kinds") > hot
    salt = F.when(is_hot, F.pmod(order, F.ceil(F.col("kinds") / hot))).otherwise(0)
    number = F.pmod(F.xxhash64("gram", salt), F.lit(shards))
    # a hot anchor's parts are numbered apart from the others, so none meets another part of it in one shard
    number = F.when(is_hot, F.xxhash64("gram", salt)).otherwise(number)
    wanted = wanted.select("key", "tag", F.struct("gram", "n", is_hot.alias("hot"), number.alias("shard"), "at").alias("w")).groupBy("key", "tag").agg(F.collect_list("w").alias("wanted"))
    contexts = scratch.put(source.join(wanted, ["key", "tag"]).mapInArrow(_fetch(length), "gram long, n long, hot boolean, shard long, key long, tag int, at long, bytes binary"), "contexts")
    local = scratch.put(contexts.groupBy("shard").applyInArrow(_shard(length), _SHARD_OUT), "local")
    within = local.where("start is not null").select("key", "tag", "start", "end")
    # 4. across shards
    cores = local.where("core is not null").select("key", "tag", "at", "core", "reps", "open", "shard")
    meeting = cores.groupBy("core").agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.max("open").alias("any")).where("low < high and any > 0").select("core")
    meeting = cores.join(meeting, "core", "left_semi").drop("core")
    windows = (meeting.join(contexts.select("key", "tag", "at", "bytes"), ["key", "tag", "at"])
               .mapInArrow(_windows(length), "key long, tag int, start long, h1 long, h2 long, open boolean, shard long"))
    windows = scratch.put(windows, "windows")
    buckets = _rounded(windows.count() / 500_000)
    across = windows.withColumn("bucket", F.pmod("h1", F.lit(buckets))).groupBy("bucket").applyInArrow(_merge(length), "key long, tag int, start long, end long")
    # removal
    found = again.unionByName(covered).unionByName(within).unionByName(across).groupBy("key", "tag").agg(F.collect_list(F.struct("start", "end")).alias("__found"))
    found = scratch.put(found.withColumnsRenamed({"key": "__of", "tag": "__of_tag"}), "found")
    keep = [f for f in df.schema.fields if f.name not in (text_col, "kept_bytes", "spans", "n_bytes")]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(keep + [T.StructField("kept_bytes", T.BinaryType()), T.StructField("spans", T.ArrayType(span)), T.StructField("n_bytes", T.LongType())])
    names = [f.name for f in keep]
    joined = keyed.join(found, (F.col("__key") == F.col("__of")) & (F.col("__tag") == F.col("__of_tag")), "left").select(*names, text.alias("__text"), "__found")
    out = joined.mapInArrow(_cut(names, characters), schema)
    scratch.drop("again", "shared", "kinds", "several", "contexts", "local", "windows")
    return out


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, and how much was removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, "doc_id", "text")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept_bytes")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
