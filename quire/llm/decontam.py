"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents are read as templates (``templates``): numbers, names
and units become typed placeholders, everything else is lower-cased and stripped of
punctuation. Windows of five template tokens are hash-joined; for each alignment of
an item in a document the joined windows are compared token by token and their slots
must map one to one (the same value in the item is always the same value in the
document), so re-parameterised questions are found and chance template matches are not.
In a short item one changed word breaks most windows, so it is also compared token by
token where any window has placed it; an item shorter than a window is matched whole,
with equal slots, as its template alone says too little.

The benchmark is a stated query set. A small one, counted first, is hashed in the
memory of each task. A larger one stays distributed: hashes of its windows and of the
documents' meet in an equi-join, the rarest window of every four speaking for them, and
the pairs found are compared in full, in one pass over the documents whatever its size.
Documents are never collected; one yields at most one row for each item it holds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import batch_of, cut, fresh, map_batches, word_count, written
from quire.llm.templates import WINDOW, Reader, windows

#: An item is in a document if this share of its windows is, or this many consecutive ones (13 words).
MIN_SHARE, MIN_RUN = 0.8, 9
#: Items of fewer tokens than this are also found by MIN_SHARE of their tokens at one place: in longer ones a changed word leaves MIN_RUN windows.
SHORT_ITEM = 2 * (MIN_RUN + WINDOW - 1) + 1
#: Words and bytes of a benchmark that every task holds at most; a larger one is joined.
BLOCK_TOKENS, BLOCK_BYTES = 2_000_000, 64 << 20
#: Of so many windows in a row of a longer item one is sought: 80 % of its windows, or nine in a row, always have one of these.
ANCHOR_EVERY = 4
#: Bits of a hash that the filter of a larger benchmark looks at.
FILTER_BITS = 27

Item = tuple  # (item_id, slot kinds, values)


class Block:
    """A hashed part of the benchmark: window hashes in order, each with its item and place."""

    def __init__(self, items: list[tuple[int | None, str]]):
        reader, held = Reader(), []
        self.items: list[Item] = []
        self.whole: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            ids, slot, codes = reader.read(text)
            if 0 < len(ids) < WINDOW:
                self.whole[len(ids)][int(windows(codes, len(ids))[0])].append(len(self.items))
            held.append(windows(codes))
            self.items.append((item_id, slot.tolist(), [reader.values[k] for k in ids.tolist()]))
        sizes = [len(h) for h in held]
        hashes = np.concatenate([np.empty(0, np.uint64), *held])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.place = np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)])[order]
        # One bit for each hash prefix: nearly all windows of a document stop here.
        bits = 16
        while (1 << bits) < 64 * len(self.hashes) and bits < 26:
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.hashes >> self.shift] = True

    def matches(self, reader: Reader, text: str) -> list[dict]:
        """One entry for each item that the text holds."""
        ids, slot, codes = reader.read(text)
        out = [{"item_id": self.items[item][0], "n_matched": 1, "n_windows": 1, "longest_run": 1, "reparameterised": False} for item in sorted(self._short(reader, ids, slot, codes))]
        hashes = windows(codes)
        if not len(hashes):
            return out
        near = np.nonzero(self.filter[hashes >> self.shift])[0]
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        first, end = (np.searchsorted(self.hashes, hashes[near], side) for side in ("left", "right"))
        some = end > first
        for i, a, b in zip(near[some].tolist(), first[some].tolist(), end[some].tolist()):
            for item, j in zip(self.item[a:b].tolist(), self.place[a:b].tolist()):
                found[item, i - j].append(j)
        hit: dict[int, set[int]] = defaultdict(set)
        changed: dict[int, bool] = {}
        alike: set[int] = set()
        for (item, shift), js in found.items():
            good, same = self._consistent(item, shift, js, reader, ids, slot)
            hit[item].update(good)
            if good:
                changed[item] = changed.get(item, True) and not same
                size = len(self.items[item][1])
                if size < SHORT_ITEM and self._equal_tokens(item, shift, reader, ids, slot) >= MIN_SHARE * size:
                    alike.add(item)
        for item, js in sorted(hit.items()):
            total = len(self.items[item][1]) - WINDOW + 1
            run = best = 0
            last = None
            for j in sorted(js):
                run = run + 1 if last is not None and j == last + 1 else 1
                best, last = max(best, run), j
            if len(js) >= MIN_SHARE * total or best >= MIN_RUN or item in alike:
                out.append({"item_id": self.items[item][0], "n_matched": len(js), "n_windows": total, "longest_run": best, "reparameterised": changed.get(item, False)})
        return out

    def _short(self, reader: Reader, ids: np.ndarray, slot: np.ndarray, codes: np.ndarray) -> set[int]:
        """Items shorter than a window that the text holds, slot values included."""
        found: set[int] = set()
        for size, known in self.whole.items():
            hashes = windows(codes, size)
            wanted = np.fromiter(known, np.uint64, len(known))
            for i in np.nonzero(np.isin(hashes, wanted))[0].tolist():
                for item in known[int(hashes[i])]:
                    _, kinds, values = self.items[item]
                    if item not in found and kinds == slot[i : i + size].tolist() and values == [reader.values[k] for k in ids[i : i + size].tolist()]:
                        found.add(item)
        return found

    def _equal_tokens(self, item: int, shift: int, reader: Reader, ids: np.ndarray, slot: np.ndarray) -> int:
        """Tokens of an item that agree where it lies in the text: equal plain ones, and slots that keep one mapping."""
        _, kinds, values = self.items[item]
        to_doc: dict[tuple[int, str], str] = {}
        to_item: dict[tuple[int, str], str] = {}
        equal = 0
        for t in range(max(0, -shift), min(len(kinds), len(ids) - shift)):
            kind, mine, theirs = kinds[t], values[t], reader.values[ids[t + shift]]
            if kind != slot[t + shift]:
                continue
            equal += to_doc.setdefault((kind, mine), theirs) == theirs and to_item.setdefault((kind, theirs), mine) == mine if kind else mine == theirs
        return equal

    def _consistent(self, item: int, shift: int, js: list[int], reader: Reader, ids: np.ndarray, slot: np.ndarray) -> tuple[list[int], bool]:
        """The windows of one alignment whose plain tokens are equal and whose slots keep one mapping; whether all slots are equal."""
        _, kinds, values = self.items[item]
        to_doc: dict[tuple[int, str], str] = {}
        to_item: dict[tuple[int, str], str] = {}
        good, same = [], True
        for j in js:
            fresh: list[tuple[int, str, str]] = []
            for t in range(j, j + WINDOW):
                mine, theirs = values[t], reader.values[ids[t + shift]]
                kind = kinds[t]
                if kind != slot[t + shift] or (not kind and mine != theirs):
                    break
                if kind:
                    if to_doc.get((kind, mine), theirs) != theirs or to_item.get((kind, theirs), mine) != mine:
                        break
                    fresh.append((kind, mine, theirs))
            else:
                for kind, mine, theirs in fresh:
                    to_doc.setdefault((kind, mine), theirs)
                    to_item.setdefault((kind, theirs), mine)
                    same = same and mine == theirs
                good.append(j)
        return good, same


def small_benchmark(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> list[tuple[int | None, str]] | None:
    """The items with a text, if they have so few words and bytes that one block holds them; counted before they are collected."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(word_count(F.col("t"))).alias("words"), F.sum(F.octet_length("t") + 64).alias("bytes")).first()
    if (size.words or 0) > block_tokens or (size.bytes or 0) > BLOCK_BYTES:
        return None
    return [(r.i, r.t) for r in items.collect()]


def _window_rows(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, n, size, place, hash) of texts (row, text): the windows of WINDOW tokens, or of an item with fewer its whole; n is the number of tokens. For sizes, of documents: windows of each of them."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, _, codes = reader.read(text)
                for size in sizes or [min(WINDOW, len(codes))]:
                    found = windows(codes, size) if size else []
                    if len(found):
                        k = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row)), pa.array(np.full(k, len(codes))), pa.array(np.full(k, size)), pa.array(np.arange(k)), pa.array(found.view(np.int64))], names=["row", "n", "size", "place", "hash"])

    return map_batches(texts.select("row", "text"), per_batch, "row long, n long, size long, place long, hash long")


def _occurring(texts: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, size, hash): the windows of documents texts (row, text) that may be among wanted (hash), each once.

    One bit for each hash prefix says so; the bits are put together where the hashes lie and only they, 16 MB at most, reach the driver.
    """
    place = F.shiftrightunsigned(F.col("hash"), 64 - FILTER_BITS)
    words = wanted.select(place.alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(place & 63)))").alias("bits")).toArrow()
    held = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    held[words["word"].to_numpy()] = words["bits"].to_numpy()
    bits = texts.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(), bits.value
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, _, codes = reader.read(text)
                for size in sizes:
                    found = np.unique(windows(codes, size))
                    at = found >> np.uint64(64 - FILTER_BITS)
                    found = found[(known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), pa.array(np.full(len(found), size)), pa.array(found.view(np.int64))], names=["row", "size", "hash"])

    return map_batches(texts.where("text is not null").select("row", "text"), per_batch, "row long, size long, hash long")


def candidates(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item_row): documents texts (row, text) and items (row, text) that may match, none that does left out: an equi-join of window hashes.

    An item matches with 80 % of its windows or nine in a row, so of every four windows in a row one is enough to find it: the one that
    the fewest documents have. Items under SHORT_ITEM tokens, which one window may place, are sought by all of theirs.
    """
    mine = cut(_window_rows(items, []))
    sizes = sorted(r["size"] for r in mine.select("size").distinct().collect())  # five at most
    seen = cut(_occurring(texts, mine.select("hash").distinct(), sizes).join(mine.select("size", "hash").distinct(), ["size", "hash"], "left_semi"))
    frequent = seen.groupBy("size", "hash").agg(F.count("*").alias("docs"))
    block = F.when(F.col("n") < SHORT_ITEM, F.col("place")).otherwise(F.expr(f"place div {ANCHOR_EVERY}"))
    weighed = mine.join(frequent, ["size", "hash"], "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    anchors = weighed.groupBy(F.col("row").alias("item_row"), block.alias("block")).agg(F.min_by(F.struct("size", "hash"), F.struct("docs", "hash")).alias("a")).select("item_row", "a.size", "a.hash").distinct()
    return seen.join(anchors, ["size", "hash"]).select("row", "item_row").distinct()


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(row, m...) of every match of texts (row, text, ...) and items (row, item_id, text); candidates are compared in full."""
    pairs = candidates(texts, items)
    sides = pairs.join(texts.select("row", F.col("text").alias("doc_text")), "row").join(items.select(F.col("row").alias("item_row"), "item_id", F.col("text").alias("item_text")), "item_row")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            rows = [{"row": row, **m} for row, text, item_id, item_text in zip(*(c.to_pylist() for c in b.columns)) for m in Block([(item_id, item_text)]).matches(reader, text)]
            yield batch_of({"row": ([r["row"] for r in rows], pa.int64()), **{k: ([r[k] for r in rows], t) for k, t in _KINDS.items()}})

    return map_batches(sides.select("row", "doc_text", "item_id", "item_text"), per_batch, f"row long, {_MATCHED}")


_KINDS = {"item_id": pa.int64(), "n_matched": pa.int64(), "n_windows": pa.int64(), "longest_run": pa.int64(), "reparameterised": pa.bool_()}
_MATCHED = "item_id long, n_matched long, n_windows long, longest_run long, reparameterised boolean"
_MATCH = f"doc_id long, {_MATCHED}"


def _numbered(df: DataFrame, row: str) -> DataFrame:
    """df as a table whose rows have a number each; written, so that the numbers stay."""
    return written(df.withColumn(row, F.monotonically_increasing_id()))


def _items(benchmark: DataFrame) -> DataFrame:
    return _numbered(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null"), "row")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, longest_run, reparameterised): a row for each row of docs and item it holds.

    A benchmark of up to ``block_tokens`` words is hashed in the memory of each task; a larger one is joined by window hashes, with
    the same result, and never collected. Null and empty texts hold nothing, and nothing holds an item without a template token; items with
    under five count as one window. Repeated rows and items give repeated rows; null ids stay null; other columns are
    ignored; empty tables give no rows.
    """
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = small_benchmark(benchmark, block_tokens)
    if items is None:
        rows = _numbered(wanted, "row")
        return _joined(rows, _items(benchmark)).join(rows.select("row", "doc_id"), "row").select("doc_id", *_KINDS)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, reader = Block(items), Reader()
        for b in batches:
            rows = [{"doc_id": i, **m} for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for m in block.matches(reader, t)]
            yield batch_of({"doc_id": ([r["doc_id"] for r in rows], pa.int64()), **{k: ([r[k] for r in rows], t) for k, t in _KINDS.items()}})

    return map_batches(wanted, per_batch, _MATCH)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with all their columns; defined for odd rows as in contaminated."""
    items = small_benchmark(benchmark, block_tokens)
    if items is None:
        (row,) = fresh(docs, "_row")
        rows = _numbered(docs, row)
        hit = _joined(rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), _items(benchmark)).select(F.col("row").alias(row)).distinct()
        return rows.join(hit, row, "left_anti").select(*docs.columns)
    at = docs.columns.index("text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, reader = Block(items), Reader()
        for b in batches:
            yield b.filter(pa.array([not (t and block.matches(reader, t)) for t in b.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, per_batch, T.StructType(docs.schema.fields))
