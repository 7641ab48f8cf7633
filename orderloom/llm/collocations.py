"""Phrases whose words occur together, mined as relations in the manner of SETM.

The occurrences of phrases of one length are a relation sorted by piece and position. Step by
step it is joined with itself by piece and adjacent position to occurrences of phrases one word
longer, these are grouped and counted, and only occurrences of frequent groups stay for the
next step (a semi-join): what holds an infrequent phrase is infrequent.

The relation is stored in blocks, one row for some 300,000 occurrences of one language. A
block has the distinct phrases in it, and as two columns of numbers the phrase and the position of
each occurrence. Positions count on within a piece and skip one between pieces, so one number
stands for both, and as it ascends the merge join compares neighbours only. What is
shuffled is a block's distinct phrases with their counts, sorted by phrase: a run of them is added
up and, if it is frequent, passed on to the blocks. A very common phrase is one row of each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.components import small_batches, stored
from orderloom.llm.words import LOWER, slices, text_bytes, word_spans

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Digits of a count of occurrences; ten thousand times 10^9 words fit.
COUNT = "decimal(14,0)"

# What separates pieces, and what separates words in them.
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD_ENDS = _PIECE_ENDS.copy()
_WORD_ENDS[[0x20, 0x09]] = True

#: Occurrences of one block: ``keys`` are their phrases' numbers in it, ``far`` is true where the
#: next one is not at the next position.
_RELATION = "block bigint, ids array<bigint>, size int, keys binary, far binary"
_ARROW_RELATION = pa.schema(
    [
        ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("size", pa.int32()),
        ("keys", pa.binary()), ("far", pa.binary()),
    ]
)

#: From a block's batch and row, its listed phrases, keys and positions to new ids, keys and positions.
Filter = Callable[
    [pa.RecordBatch, int, pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]
]


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = 3,
    min_count: int = 10,
    cover_percent: int = 50,
    top: int | None = 2000,
) -> DataFrame:
    """``lang, rank, phrase, words, a, l, r, n, score``: the best phrases of each language.

    Texts, A-Z in lower case, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. A null language is ``und``. Candidates are the phrases of two to
    ``max_words`` words that occur ``min_count`` times or more within pieces, overlaps
    included; that count is ``a``. Cut after its first words, a phrase gives ``l`` and ``r``, the
    counts of its two parts, and the score ``floor(1000000 * a * a / (l * r))``. The cut of the
    lowest score counts, of several the first. A candidate is left out where a longer one
    that contains it has ``cover_percent`` per cent of its count. ``n`` counts all words of the
    language. ``rank`` goes by score and count, largest first, then by the bytes of the phrase; with
    ``top`` null all candidates are ranked.

    Null and empty texts have no words; texts are read whole; repeated rows count as often as
    they occur; other columns are not read; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        scored, totals = _mined(texts, max_words, min_count, cover_percent)
    return _ranked(scored, totals, top)


def _mined(
    texts: DataFrame, max_words: int, min_count: int, cover_percent: int
) -> tuple[DataFrame, DataFrame]:
    """All phrases of ``lang, text`` with their scores, and the number of words of each language."""
    block_bytes = BLOCK_BYTES
    words = stored(
        texts.mapInArrow(
            lambda batches: _occurrences(batches, block_bytes),
            "block bigint, lang string, words array<string>, counts array<bigint>, size int, "
            "keys binary, far binary",
        ),
        "word-occurrences",
    )
    totals = words.groupBy("lang").agg(F.sum(F.col("size").cast("bigint")).alias("n"))
    of_block = words.select(
        "block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("key", "met")
    ).select("lang", F.col("met.words").alias("word"), "block", "key", F.col("met.counts").alias("a"))
    frequent, known = _supported(of_block, ["lang", "word"], ["block", "key"], min_count, "words")
    relation = stored(
        _semi_joined(words.drop("lang", "words", "counts"), known, _frequent_words),
        "occurrences-1",
    )
    no_counts = F.expr("CAST(array() AS array<bigint>)")
    phrases = frequent.select(
        "id", "lang", F.array("word").alias("words"), "a", no_counts.alias("heads"),
        no_counts.alias("tails"),
    )
    candidates = []
    for length in range(2, max_words + 1):
        adjacent = relation.select("block", "ids", "size", "keys", "far").mapInArrow(
            _adjacent, "block bigint, head bigint, last bigint, a bigint"
        )
        if length < max_words:
            frequent, known = _supported(
                adjacent, ["head", "last"], ["block", "head", "last"], min_count, f"phrases-of-{length}"
            )
            relation = stored(_semi_joined(relation, known, _frequent_phrases), f"occurrences-{length}")
        else:
            frequent = stored(
                adjacent.groupBy("head", "last").agg(F.sum("a").alias("a"))
                .where(F.col("a") >= min_count)
                .withColumn("id", F.monotonically_increasing_id()),
                f"phrases-of-{length}",
            )
        if candidates:
            candidates[-1] = _uncovered(candidates[-1], frequent, cover_percent)
        phrases = stored(_named(frequent, phrases), f"phrases-{length}")
        candidates.append(phrases)
    found = candidates[0]
    for longer in candidates[1:]:
        found = found.unionByName(longer)
    return stored(_scored(found), "scored"), totals


# -- relations ---------------------------------------------------------------


def _occurrences(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, text) as blocks of word occurrences."""
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    names = ["block", "lang", "words", "counts", "size", "keys", "far"]
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of_row = langs.indices.to_numpy()
        for number, lang in enumerate(langs.dictionary.to_pylist()):
            data, offsets = text_bytes(batch.column(1).take(pa.array(np.flatnonzero(of_row == number))))
            for first, last in slices(offsets, block_bytes):
                at = offsets[first : last + 1] - offsets[first]
                words, keys, far = _words(LOWER[data[offsets[first] : offsets[last]]], at)
                if not len(keys):
                    continue
                counts = np.bincount(keys, minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), pa.array([lang]), _one_list(words), _one_list(pa.array(counts)),
                        *_packed(keys, far, len(words)),
                    ],
                    names,
                )
                block += 1


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words; of each occurrence the word's number, and if the next is not adjacent."""
    starts, ends, bounds = word_spans(data, offsets, _WORD_ENDS)
    # The words alone, end to end: told apart by their bytes, not by a hash.
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    inside = np.ascontiguousarray(data[~_WORD_ENDS[data]])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(inside))
    coded = words.dictionary_encode()
    ends_before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_PIECE_ENDS[data], out=ends_before[1:])
    far = ends_before[starts[1:]] > ends_before[ends[:-1]]
    last_of_text = bounds[1:-1] - 1
    far[last_of_text[(last_of_text >= 0) & (last_of_text < len(far))]] = True
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), far


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(keys: np.ndarray, far: np.ndarray, phrases: int) -> list[pa.Array]:
    """Columns ``size, keys, far`` of one block of ``phrases`` distinct ones."""
    narrow = keys.astype("<u2" if phrases <= 1 << 16 else "<u4")
    bits = np.packbits(far)
    return [
        pa.array([len(keys)], pa.int32()), pa.array([narrow.tobytes()], pa.binary()),
        pa.array([bits.tobytes()], pa.binary()),
    ]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Each block's batch and row, its ``keys`` and ``positions``."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in ("size", "keys", "far")]
        for row in range(batch.num_rows):
            size, keys, far = (c[row].as_py() for c in columns)
            found = np.frombuffer(keys, f"<u{len(keys) // size}").astype(np.int64)
            gaps = np.unpackbits(np.frombuffer(far, np.uint8), count=size - 1)
            positions = np.zeros(size, np.int64)
            np.cumsum(gaps + 1, out=positions[1:])
            yield batch, row, found, positions


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name))[row].values.to_numpy()


def _relation(block: int, ids: np.ndarray, keys: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    far = np.diff(positions) > 1
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), _one_list(pa.array(ids)), *_packed(keys, far, len(ids))],
        schema=_ARROW_RELATION,
    )


def _supported(
    met: DataFrame, keys: list[str], own: list[str], min_count: int, name: str
) -> tuple[DataFrame, DataFrame]:
    """Frequent groups, ``keys, a, id``, and which blocks have them, ``own, id``.

    ``met`` has a row for each key of a block, with its count ``a``. Sorted by key, a group is a run
    of rows, at most one of each block. Its rows are passed on as soon as they add up to
    ``min_count``, so fewer than that ever wait, however common a phrase is.
    """
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    names = list(dict.fromkeys(keys + own))
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", a bigint, id bigint"
    runs = stored(
        met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
            lambda batches: _runs(batches, keys, own, names, min_count), schema
        ),
        name,
    )
    return (
        runs.where("a IS NOT NULL").select(*keys, "a", "id"),
        runs.where("a IS NULL").select(*own, "id"),
    )


def _runs(
    batches: Iterator[pa.RecordBatch], keys: list[str], own: list[str], names: list[str], min_count: int
) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``keys`` as one row per frequent run, with ``a``, and its rows, without."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 33
    waiting: pa.RecordBatch | None = None
    # The run that goes on: its key and id, and the count so far.
    running: tuple[pa.RecordBatch, int, int] | None = None

    def rows(batch: pa.RecordBatch, kept: list[str], counts: pa.Array, ids: np.ndarray) -> pa.RecordBatch:
        columns = [
            batch.column(n) if n in kept else pa.nulls(batch.num_rows, batch.schema.field(n).type)
            for n in names
        ]
        return pa.RecordBatch.from_arrays([*columns, counts, pa.array(ids, pa.int64())], [*names, "a", "id"])

    def total(run: tuple[pa.RecordBatch, int, int]) -> pa.RecordBatch:
        return rows(run[0], keys, pa.array([run[2]], pa.int64()), np.array([run[1]]))

    for batch in batches:
        if waiting is not None:
            batch, waiting = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0], None
        size = batch.num_rows
        if not size:
            continue
        fresh = np.zeros(size, bool)
        for name in keys:
            column = batch.column(name)
            changes = pc.not_equal(column.slice(1), column.slice(0, size - 1))
            fresh[1:] |= changes.to_numpy(zero_copy_only=False)
        fresh[0] = True
        starts = np.flatnonzero(fresh)
        lengths = np.diff(np.append(starts, size))
        counts = np.add.reduceat(batch.column("a").to_numpy(), starts)
        goes_on = running is not None and all(batch.column(n)[0] == running[0].column(n)[0] for n in keys)
        if goes_on:
            counts[0] += running[2]
        elif running is not None:
            yield total(running)
        frequent = counts >= min_count
        fresh_ids = frequent.copy()
        fresh_ids[0] &= not goes_on
        ids = np.full(len(starts), running[1] if goes_on else -1)
        ids[fresh_ids] = number + np.arange(fresh_ids.sum())
        number += int(fresh_ids.sum())
        at = np.flatnonzero(np.repeat(frequent, lengths))
        yield rows(batch.take(pa.array(at)), own, pa.nulls(len(at), pa.int64()), np.repeat(ids, lengths)[at])
        ended = np.flatnonzero(frequent[:-1])
        yield rows(batch.take(pa.array(starts[ended])), keys, pa.array(counts[ended]), ids[ended])
        running = None
        if frequent[-1]:
            running = (batch.slice(int(starts[-1]), 1), int(ids[-1]), int(counts[-1]))
        else:
            waiting = batch.slice(int(starts[-1]))
    if running is not None:
        yield total(running)


def _semi_joined(relation: DataFrame, known: DataFrame, filtered: Filter) -> DataFrame:
    """The occurrences of frequent phrases; ``known`` lists those among each block's own."""

    def of_block(block: pa.Table, listed: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows and listed.num_rows:
            for batch, row, keys, positions in _blocks(block.to_batches()):
                ids, kept, at = filtered(batch, row, listed.combine_chunks(), keys, positions)
                rows.append(_relation(batch.column("block")[row].as_py(), ids, kept, at))
        return pa.Table.from_batches(rows, _ARROW_RELATION)

    # Another name, as both come from the same files.
    listed = known.withColumnRenamed("block", "of_block")
    return relation.groupBy("block").cogroup(listed.groupBy("of_block")).applyInArrow(of_block, _RELATION)


def _frequent_words(
    batch: pa.RecordBatch, row: int, listed: pa.Table, keys: np.ndarray, positions: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys and positions of the listed words of a block."""
    number = np.full(int(keys.max()) + 1, -1, np.int64)
    order, ids = _by_id(listed)
    number[listed.column("key").to_numpy()[order]] = np.arange(len(ids))
    kept = number[keys]
    stay = kept >= 0
    return ids, kept[stay], positions[stay]


def _frequent_phrases(
    batch: pa.RecordBatch, row: int, listed: pa.Table, keys: np.ndarray, positions: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the listed phrases, one word longer than the block's own."""
    own = _values(batch, "ids", row)
    by_id, ids = _by_id(listed)
    head, last = (np.searchsorted(own, listed.column(n).to_numpy()[by_id]) for n in ("head", "last"))
    both = head << 32 | last
    order = np.argsort(both)
    pairs, starts = _joined(keys, positions)
    at = np.minimum(np.searchsorted(both[order], pairs), len(both) - 1)
    stay = both[order[at]] == pairs
    return ids, order[at[stay]], starts[stay]


def _by_id(listed: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The order of the ids, and the ids in it: a block has its phrases in that order."""
    ids = listed.column("id").to_numpy()
    order = np.argsort(ids)
    return order, ids[order]


def _joined(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of a block with itself by adjacent position: pairs of keys and where they start."""
    at = np.flatnonzero(positions[1:] == positions[:-1] + 1)
    return keys[at] << 32 | keys[at + 1], positions[at]


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, head, last, a): the pairs of phrases at adjacent positions, counted by block."""
    for batch, row, keys, positions in _blocks(batches):
        pairs, counts = np.unique(_joined(keys, positions)[0], return_counts=True)
        ids = _values(batch, "ids", row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(pairs), batch.column(0)[row].as_py(), np.int64)),
                pa.array(ids[pairs >> 32]), pa.array(ids[pairs & 0xFFFFFFFF]), pa.array(counts),
            ],
            ["block", "head", "last", "a"],
        )


# -- phrases -----------------------------------------------------------------


def _named(frequent: DataFrame, shorter: DataFrame) -> DataFrame:
    """``id, lang, words, a, heads, tails`` of phrases; ``heads`` and ``tails`` are the counts of their
    first 1, 2, ... and last 1, 2, ... words."""
    first = shorter.select(
        F.col("id").alias("head"), "lang", F.col("words").alias("_words"),
        F.array_append("heads", F.col("a")).alias("heads"),
    )
    second = shorter.select(
        F.col("id").alias("last"), F.element_at("words", -1).alias("_word"),
        F.array_append("tails", F.col("a")).alias("tails"),
    )
    return frequent.join(first, "head").join(second, "last").select(
        "id", "lang", F.array_append("_words", F.col("_word")).alias("words"), "a", "heads", "tails"
    )


def _uncovered(phrases: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """Phrases that no phrase one word longer covers.

    That is enough: what a still longer one covers, the part of it one word longer covers too.
    """
    over = (
        longer.select(F.col("head").alias("id"), "a")
        .union(longer.select("last", "a"))
        .groupBy("id")
        .agg(F.max("a").alias("_over"))
    )
    covered = F.col("_over") * 100 >= F.col("a") * percent
    return phrases.join(over, "id", "left").where(~F.coalesce(covered, F.lit(False))).drop("_over")


def _scored(phrases: DataFrame) -> DataFrame:
    """Adds ``phrase``, ``l``, ``r`` and ``score``, in decimals that are exact."""
    cut = F.expr(
        "array_min(transform(heads, (left, i) -> named_struct('score', "
        f"(1000000BD * CAST(a AS {COUNT}) * CAST(a AS {COUNT})) div (CAST(left AS {COUNT}) "
        f"* CAST(tails[size(heads) - 1 - i] AS {COUNT})), 'words', i, 'l', left, "
        "'r', tails[size(heads) - 1 - i])))"
    )
    return phrases.withColumn("_cut", cut).select(
        "lang", F.array_join("words", " ").alias("phrase"), "words", "a", "_cut.l", "_cut.r", "_cut.score"
    )


def _ranked(phrases: DataFrame, totals: DataFrame, top: int | None) -> DataFrame:
    best: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # First the best of many parts, so that no task sorts all of a language.
        parts = phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")
        part = F.pmod(F.xxhash64("phrase"), F.lit(int(parts)))
        in_part = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))
        phrases = phrases.withColumn("_part", part).withColumn("_place", in_part).where(F.col("_place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")
    ranked = phrases.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "words", "a", "l", "r", "n", "score"
    )
