"""Line deduplication by a segment-partition edit join.

Lines are compared by the edit distance of their UTF-8 bytes, up to ``DISTANCE``. A line of
length l is cut into ``DISTANCE + 1`` segments; of two lines that are near, the longer one holds
some segment of the shorter unchanged, not far from its place. Every line is therefore filed
under its own segments and looks up, for each length a partner may have, the substrings that
may match a segment there. Length, segment number and content make the key, so lines meet only
where all three agree. Candidates are held against each other by the parity of their counts of
bytes and byte pairs and triples, and then decided by banded bit-parallel edit distance.

Near lines are closed to classes. Of the lines of a class the first stays, by document id, row
and line number, wherever the others are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.components import BROADCAST_ROWS, scratch, stored
from orderloom.llm.linkage import hamming, linked_components, numpy_hamming
from orderloom.llm.ngram_join import NODES_REMEMBERED, row_key, within
from orderloom.llm.pairing import linking_pairs
from orderloom.llm.words import (
    content_hashes, mix, prefix_hashes, seeded_hashes, slices, span_hashes, text_bytes,
)

DISTANCE = 2
#: Shorter lines (in bytes) are never dropped: short ones recur in clean documents.
MIN_BYTES = 20
#: Bytes of lines that advance together.
TABLE_BYTES = 1 << 20
#: A line's sketch: for runs of one, two and three bytes, which of 128 classes it has an odd
#: number of. An edit takes away a run of each byte that it touches and adds as many.
RUNS = (1, 2, 3)
SKETCH_WORDS = 2
#: The class of a run: the highest bits of its product with an odd number, modulo 2^32.
_SPREAD = np.uint32(0x9E3779B1)
_TOP = np.uint32(32 - (SKETCH_WORDS * 64 - 1).bit_length())
_LINES = "row_key bigint, id bigint, line int, node bigint, check int"


def line_spans(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: first text, end, bytes, starts and ends of lines, and their text's number."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        feeds = np.flatnonzero(part == 0x0A)
        # A text begins a line, and so does every line feed.
        starts = np.concatenate([at[:-1], feeds + 1])
        owner = np.concatenate(
            [np.arange(last - first), np.searchsorted(at, feeds, "right") - 1]
        )
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = np.r_[starts[1:] - 1, len(part)]
        closing = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True])
        ends[closing] = at[owner[closing] + 1]
        yield first, last, part, starts, ends, owner


def identities(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node`` and ``check`` of lines: 64 and another 32 bits that tell different lines apart.

    Lines meet by node. A line is dropped only where the check agrees as well, so that one that shares
    its node with another by chance stays.
    """
    nodes, checks = seeded_hashes(part, starts, ends, (0, 1))
    return nodes.astype(np.int64), checks.astype(np.uint32).view(np.int32)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (row_key, id, text) as one row per line of ``MIN_BYTES`` or more."""
    for batch in batches:
        for first, last, part, starts, ends, owner in line_spans(batch.column(2)):
            number = np.arange(len(starts)) - np.searchsorted(owner, owner)
            long = ends - starts >= MIN_BYTES
            nodes, checks = identities(part, starts[long], ends[long])
            rows = pa.array(owner[long] + first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array(number[long].astype(np.int32)), pa.array(nodes),
                    pa.array(checks),
                ],
                ["row_key", "id", "line", "node", "check"],
            )


def segments(length: int, distance: int) -> list[tuple[int, int]]:
    """Start and length of ``distance + 1`` segments, as even as can be, longer ones last."""
    count = distance + 1
    short = length // count
    longer = length - short * count
    sizes = [short] * (count - longer) + [short + 1] * longer
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def probes(size: int, distance: int, least: int) -> list[tuple[int, int, int, int]]:
    """Where a line of ``size`` looks: (partner's length, segment, start, length).

    Partners have ``least`` bytes or more.
    Start positions are those that keep the errors before and after a segment within bounds
    (multi-match-aware selection). Its own segments are among them.
    """
    found = []
    for length in range(max(least, size - distance), size + 1):
        shift = size - length
        for i, (start, width) in enumerate(segments(length, distance)):
            low = max(0, start - i, start + shift - (distance - i))
            high = min(size - width, start + i, start + shift + (distance - i))
            found += [(length, i, at, width) for at in range(low, high + 1)]
    return found


def _places(size: int, distance: int, least: int) -> np.ndarray:
    """Where substrings looked up by a line of ``size`` begin and end, and the salts of their keys."""
    length, segment, start, width = np.array(probes(size, distance, least), np.int64).T
    salt = mix((length << 8 | segment).astype(np.uint64)).view(np.int64)
    return np.stack([start, start + width, salt])


def _signed(
    batches: Iterator[pa.RecordBatch], distance: int, least: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Batches of (text) as (key, node), for lines that may have near ones."""
    least = MIN_BYTES if least is None else least
    seen: set[int] = set()
    places: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, _, part, starts, ends, _ in line_spans(batch.column(0)):
            long = ends - starts >= least
            starts, sizes = starts[long], (ends - starts)[long]
            if not len(starts):
                continue
            sums = prefix_hashes(part)
            nodes = content_hashes(part, starts, starts + sizes).astype(np.int64)
            fresh = np.array([n not in seen for n in nodes.tolist()])
            seen.update(nodes.tolist())
            nodes, starts, sizes = nodes[fresh], starts[fresh], sizes[fresh]
            if len(nodes):
                lengths, of = np.unique(sizes, return_inverse=True)
                for size in lengths.tolist():
                    if size not in places:
                        places[size] = _places(size, distance, least)
                # Lines of one length look in the same places: those of all lengths in one table.
                tables = [places[size] for size in lengths.tolist()]
                counts = np.array([t.shape[1] for t in tables])
                begin, end, salt = np.concatenate(tables, axis=1)
                each = counts[of]
                before = np.cumsum(each) - each
                row = np.arange(int(each.sum())) + np.repeat((np.cumsum(counts) - counts)[of] - before, each)
                at = np.repeat(starts, each)
                hashes = span_hashes(sums, at + begin[row], at + end[row])
                keys = mix(hashes ^ salt[row].view(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.repeat(nodes, each))], ["key", "node"]
                )
            if len(seen) > NODES_REMEMBERED:
                seen = set()


def _sketched(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of (text) as (node, check, size, sketch)."""
    for batch in batches:
        for _, _, part, starts, ends, _ in line_spans(batch.column(0)):
            long = ends - starts >= least
            starts, ends = starts[long], ends[long]
            nodes, checks = identities(part, starts, ends)
            sketches = _sketches(part, starts, ends - starts)
            width = sketches.shape[1]
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes), pa.array(checks), pa.array((ends - starts).astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(sketches.ravel())),
                ],
                ["node", "check", "size", "sketch"],
            )


def _sketches(part: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``len(RUNS) * SKETCH_WORDS`` numbers per line; lines do not overlap."""
    classes, lines = SKETCH_WORDS * 64, len(starts)
    # The line of every byte; those of no line, and runs that leave theirs, go to one more.
    owner = np.full(len(part), lines, np.int32)
    before = np.cumsum(sizes) - sizes
    owner[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)] = np.repeat(
        np.arange(lines, dtype=np.int32), sizes
    )
    run, found = np.zeros(len(part), np.uint32), []
    for length in RUNS:
        places = max(0, len(part) - length + 1)
        run = run[:places] << np.uint32(8) | part[length - 1 :]
        first = owner[:places]
        cell = np.where(first == owner[length - 1 :], first, np.int32(lines)) * np.int32(classes)
        cell += (run * _SPREAD >> _TOP).astype(np.int32)
        odd = np.bincount(cell, minlength=(lines + 1) * classes)[: lines * classes] & 1
        bits = odd.astype(np.uint8).reshape(lines, classes)
        found.append(np.packbits(bits, axis=1, bitorder="little").view(np.int64))
    return np.concatenate(found, axis=1)


def _line_payloads(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of (text) as (node, payload), the bytes of the line."""
    for batch in batches:
        for _, _, part, starts, ends, _ in line_spans(batch.column(0)):
            long = ends - starts >= least
            starts, ends = starts[long], ends[long]
            nodes = content_hashes(part, starts, ends).astype(np.int64)
            lines = [part[a:z].tobytes() for a, z in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(lines, pa.binary())], ["node", "payload"]
            )


def near(line: bytes, others: list[bytes], distance: int = DISTANCE) -> np.ndarray:
    """Which of ``others`` are within ``distance`` edits of ``line``.

    What a pair has in common at its ends is taken off first; it never changes the distance. The
    rest of all pairs advances together, a column at a time. A bit vector per pair holds the
    vertical differences in the band of ``2 * distance + 1`` rows around the diagonal, and the
    distance is followed along the diagonal that ends in the last cell. Pairs that are
    too far already are dropped on the way.
    """
    result = np.zeros(len(others), bool)
    rest: list[tuple[int, bytes, bytes]] = []
    for i, other in enumerate(others):
        if abs(len(other) - len(line)) <= distance:
            a, b = _middle(line, other)
            if min(len(a), len(b)) == 0:
                result[i] = max(len(a), len(b)) <= distance
            else:
                rest.append((i, a, b) if len(a) >= len(b) else (i, b, a))
    # Pairs of like length together, and a few at a time if they are long.
    rest.sort(key=lambda x: len(x[1]))
    first = 0
    while first < len(rest):
        last = first + 1
        while last < len(rest) and (last + 1 - first) * len(rest[last][1]) <= TABLE_BYTES:
            last += 1
        chosen = rest[first:last]
        result[[i for i, _, _ in chosen]] = _near([x[1:] for x in chosen], distance)
        first = last
    return result


def _middle(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """Both without what they begin and end with alike."""
    head = _alike(a, b)
    a, b = a[head:], b[head:]
    tail = _alike(a[::-1], b[::-1])
    return a[: len(a) - tail], b[: len(b) - tail]


def _alike(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) if differ.any() else n


def _near(pairs: list[tuple[bytes, bytes]], distance: int) -> np.ndarray:
    """For pairs (longer, shorter), whether they are within ``distance`` edits."""
    rows = np.array([len(a) for a, _ in pairs])
    columns = np.array([len(b) for _, b in pairs])
    # Byte values plus 1; padding never matches.
    longer = np.zeros((len(pairs), rows.max(initial=0) + 2 * distance + 1), np.int16)
    shorter = np.full((len(pairs), max(1, columns.max(initial=0))), -1, np.int16)
    for i, (a, b) in enumerate(pairs):
        longer[i, distance : distance + len(a)] = np.frombuffer(a, np.uint8).astype(np.int16) + 1
        shorter[i, : len(b)] = np.frombuffer(b, np.uint8).astype(np.int16) + 1
    width = 2 * distance + 1
    mask = np.uint32((1 << width) - 1)
    score = rows - columns
    diagonal = (distance + score).astype(np.uint32)
    # Column 1's band has rows 1 - distance to 1 + distance; differences are +1 from row 1 on.
    plus = np.full(len(pairs), mask & ~np.uint32((1 << distance) - 1), np.uint32)
    minus = np.zeros(len(pairs), np.uint32)
    left = np.arange(len(pairs))
    one = np.uint32(1)
    for j in range(columns.max(initial=0)):
        same = np.zeros(len(left), np.uint32)
        for k in range(width):
            same |= (longer[left, j + k] == shorter[left, j]).astype(np.uint32) << np.uint32(k)
        zero = ((((same & plus) + plus) ^ plus) | same | minus) & mask
        up = (minus | ~(zero | plus)) & mask
        down = zero & plus
        moved = zero >> one
        plus, minus = (down | ~(moved | up)) & mask, moved & up
        still = j < columns[left]
        score[left] += (still & ((zero >> diagonal[left]) & one == 0)).astype(score.dtype)
        if j % 8 == 7:
            close = score[left] <= distance
            if not close.all():
                left, plus, minus = left[close], plus[close], minus[close]
                if not len(left):
                    break
    return score <= distance


def line_classes(
    docs: DataFrame, distance: int, row_id: str, text: str, least: int
) -> tuple[DataFrame, DataFrame]:
    """Lines as ``row_key, id, line, node, check``, and ``node, check, component`` of near ones of
    ``least`` bytes or more."""
    rows = docs.select(
        row_key(row_id, text).alias("_key"), F.col(row_id).cast("bigint").alias("_id"),
        F.col(text).alias("_text"),
    )
    lines = stored(rows.select("_key", "_id", "_text").mapInArrow(_listed, _LINES), "lines")
    items = stored(
        rows.select("_text")
        .mapInArrow(lambda b: _sketched(b, least), "node bigint, check int, size bigint, sketch array<bigint>")
        .dropDuplicates(["node"]),
        "line-sketches",
    )
    signatures = rows.select("_text").mapInArrow(
        lambda batches: _signed(batches, distance, least), "key bigint, node bigint"
    )

    def possible_sql(a: str, b: str) -> Column:
        chance = F.abs(F.col(f"{a}_size") - F.col(f"{b}_size")) <= distance
        for i, run in enumerate(RUNS):
            differ = hamming(f"{a}_sketch", f"{b}_sketch", SKETCH_WORDS, i * SKETCH_WORDS)
            chance = chance & (differ <= 2 * run * distance)
        return chance

    def possible(size, sketch, sizes, sketches):
        chance = np.abs(size - sizes) <= distance
        for i, run in enumerate(RUNS):
            own = slice(i * SKETCH_WORDS, (i + 1) * SKETCH_WORDS)
            chance &= numpy_hamming(sketch[..., own], sketches[..., own]) <= 2 * run * distance
        return chance

    def verify(pairs: DataFrame) -> DataFrame:
        with scratch(rows.sparkSession):
            nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
            if nodes.count() > BROADCAST_ROWS:
                nodes = stored(nodes.distinct(), "wanted")
            # The text of a line is taken from one of the rows that have it.
            homes = stored(
                within(lines.select("node", "row_key"), nodes, "node")
                .groupBy("node").agg(F.min("row_key").alias("_key")).select("_key"),
                "homes",
            )
            found = within(rows, homes, "_key").select("_text").mapInArrow(
                lambda batches: _line_payloads(batches, least), "node bigint, payload binary"
            )
            payloads = stored(within(found, nodes, "node").dropDuplicates(["node"]), "payloads")
            links = linking_pairs(pairs, payloads, lambda mine, others: near(mine, others, distance))
            return stored(links, "links", lasting=True)

    linked = linked_components(signatures, items, possible_sql, possible, verify)
    return lines, linked.join(items.select("node", "check"), "node")


def dedup_lines(
    docs: DataFrame, distance: int = DISTANCE, row_id: str = "doc_id", text: str = "text",
    min_near_bytes: int = MIN_BYTES,
) -> DataFrame:
    """``docs`` without lines that are near an earlier one, plus ``n_lines`` and ``n_dropped``.

    Lines are what line feeds separate. Those of ``MIN_BYTES`` or more count as copies if they
    are equal, those of ``min_near_bytes`` or more also if a chain of lines within
    ``distance`` byte edits joins them. Of each class the first line stays, by id (null ids
    last), row key and line number; all other text stays as it is, and so does every row.
    Rows that agree in id and text count as one and lose the same lines. A null text stays
    null and has no lines; an empty one has one empty line. Other columns are carried along;
    ``n_lines`` and ``n_dropped`` replace columns of these names.
    """
    with scratch(docs.sparkSession):
        lines, linked = line_classes(docs, distance, row_id, text, max(MIN_BYTES, min_near_bytes))
        linked = stored(linked, "line-classes")
        placed = lines.join(linked, ["node", "check"], "left").select(
            "row_key", "id", "line", F.coalesce("component", "node").alias("class"),
            F.when(F.col("component").isNull(), F.col("check")).otherwise(F.lit(0)).alias("check"),
            F.col("component").isNotNull().alias("near"),
        )
        place = F.struct(F.col("id").isNull(), "id", "row_key", "line")
        class_key = ["class", "check", "near"]
        classes = placed.groupBy(*class_key).agg(
            F.min(place).alias("first"), F.max(place).alias("last")
        ).where("first <> last").select(*class_key, F.col("first.row_key").alias("first_key"), F.col("first.line").alias("first_line"))
        dropped = (
            placed.join(classes, class_key)
            .where("row_key <> first_key OR line <> first_line")
            .groupBy(F.col("row_key").alias("_key"))
            .agg(F.collect_set("line").alias("_drop"))
        )
        dropped = stored(dropped, "dropped-lines", lasting=True)
    # The row travels as one value, so none of its columns can clash with those made here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        row_key(row_id, text).alias("_key"),
        F.split(F.col(text), "\n", -1).alias("_lines"),
    )
    # As many rows as there are documents with copies, so never a broadcast.
    rows = rows.join(dropped.hint("merge"), "_key", "left")
    rows = rows.withColumn("_drop", F.coalesce("_drop", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    cleaned = F.concat_ws("\n", F.transform(kept, lambda i: F.get("_lines", i)))
    own = {c: F.col("_row").getField(c) for c in docs.columns if c not in ("n_lines", "n_dropped")}
    own[text] = F.when(F.size("_drop") > 0, cleaned).otherwise(own[text])
    return rows.select(
        *[value.alias(name) for name, value in own.items()],
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("bigint").alias("n_lines"),
        F.size("_drop").cast("bigint").alias("n_dropped"),
    )
