"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation its dialogue is rendered once with that
speaker as the assistant and every other speaker as a named user; system turns keep
their role. A mask marks what a model is trained on: the assistant's text and end mark.

A conversation may hold a third of all turns, so none is gathered into one task.
Turns are range-partitioned by (conversation, order), the only time that texts travel, and
written to a checkpoint. A task reads its range in order and renders chunk by chunk, all
perspectives from the same turns. Only a conversation that begins in one range and ends in
another needs facts from elsewhere: how much of it lies before, and who speaks in it.
There is at most one such for each border of two ranges, so these facts are collected;
and only the chunks at the borders are put together afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of, cut, map_batches

SYSTEM_ROLES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: A chunk begins at the first turn behind each multiple of this many characters, so a usual dialogue is one chunk.
CHUNK_CHARS = 65_536
#: What a turn counts beside its text and its speaker's name: the marks around it. The same from every perspective.
TURN_CHARS = 32
#: Characters of a text that order turns with the same number and role, before a hash of the whole text does.
TIE_CHARS = 64
_NAME = re.compile("[^A-Za-z0-9_-]")
_OUT = "conv_id long, perspective string, chunk long, n_turns long, text string, mask string"

Turn = tuple  # (role, text)


def _header(role: str | None, perspective: str) -> str:
    if role in SYSTEM_ROLES:
        return f"{OPEN}system\n"
    return f"{OPEN}assistant\n" if role == perspective else f"{OPEN}user name={_NAME.sub('_', 'unknown' if role is None else role)}\n"


def _size(role: str | None, text: str | None) -> int:
    return len(text or "") + len("unknown" if role is None else role) + TURN_CHARS


def _speaks(role: str | None) -> bool:
    return role is not None and role not in SYSTEM_ROLES


def render(turns: list[Turn], perspective: str) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns in order, and the spans of it that are trained on, in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = _header(role, perspective), (text or "") + CLOSE
        parts += [head, body]
        if role == perspective:
            mask.append((at + len(head), at + len(head) + len(body) - 1))
        at += len(head) + len(body)
    return "".join(parts), mask


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns in order within their ranges, with part, the number of their range; fixed by a checkpoint.

    The last key only parts equal rows, whose order does not matter.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"start": F.substring("text", 1, TIE_CHARS), "hash": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("start").asc_nulls_first(), F.col("hash"), F.col("uid")]
    ranged = rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys)
    return cut(ranged.select("part", "conv_id", "role", "text"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, Iterator[Turn]]]:
    """(part, conv_id, its turns in this range) one after another; the turns are to be used up before the next."""
    rows = ((p, c, r, t) for b in batches for p, c, r, t in zip(*(b.column(k).to_pylist() for k in range(4))))
    ahead = next(rows, None)

    def turns(conv: int | None) -> Iterator[Turn]:
        nonlocal ahead
        while ahead is not None and ahead[1] == conv:
            role, text = ahead[2:]
            ahead = next(rows, None)
            yield role, text

    while ahead is not None:
        part, conv = ahead[:2]
        mine = turns(conv)
        yield part, conv, mine
        for _ in mine:
            pass


def _borders(rows: DataFrame) -> dict[int, dict[int | None, tuple[int, list[str], bool, bool]]]:
    """For each range, of its first and last conversation if it goes on in another: (characters before, speakers, begun before, goes on)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[dict] = []
        for part, conv, turns in _conversations(batches):
            size, speakers = 0, set()
            for role, text in turns:
                size += _size(role, text)
                if _speaks(role):
                    speakers.add(role)
            ends[1:] = [{"part": part, "conv_id": conv, "size": size, "speakers": sorted(speakers)}]
        kinds = {"part": pa.int32(), "conv_id": pa.int64(), "size": pa.int64(), "speakers": pa.list_(pa.string())}
        yield batch_of({k: ([e[k] for e in ends], t) for k, t in kinds.items()})

    # at most two rows for each range
    found = sorted(map_batches(rows, per_batch, "part int, conv_id long, size long, speakers array<string>").collect(), key=lambda r: (r.part, r.conv_id is not None, r.conv_id or 0))
    parts: dict[int | None, list] = {}
    for r in found:
        parts.setdefault(r.conv_id, []).append(r)
    out: dict[int, dict] = {}
    for conv, mine in parts.items():
        speakers, before = sorted({s for r in mine for s in r.speakers}), 0
        for k, r in enumerate(mine):
            if len(mine) > 1:
                out.setdefault(r.part, {})[conv] = (before, speakers, k > 0, k < len(mine) - 1)
            before += r.size
    return out


def _chunks(turns: Iterator[Turn], before: int, chunk_chars: int) -> Iterator[tuple[int, list[Turn]]]:
    """(chunk, its turns) of turns that begin this many characters into their conversation."""
    at, number, held = before, None, []
    for role, text in turns:
        if held and at // chunk_chars != number:
            yield number, held
            held = []
        number = at // chunk_chars
        held.append((role, text))
        at += _size(role, text)
    if held:
        yield number, held


def _rendered(rows: DataFrame, borders: dict, chunk_chars: int, at_borders: bool) -> DataFrame:
    """Rendered chunks with their range: those that may go on in another range, or all others."""

    def pieces(part: int, conv: int | None, turns: Iterator[Turn]) -> Iterator[dict]:
        known = borders.get(part, {}).get(conv)
        if known is None:
            if at_borders:
                return
            turns = list(turns)  # it lies within this range
            before, speakers, begun, goes_on = 0, sorted({r for r, _ in turns if _speaks(r)}), False, False
        else:
            before, speakers, begun, goes_on = known
        chunks, first = _chunks(iter(turns), before, chunk_chars), True
        ahead = next(chunks, None)
        while ahead is not None:
            (number, held), ahead = ahead, next(chunks, None)
            if at_borders == ((first and begun) or (ahead is None and goes_on)):
                for who in speakers:
                    text, mask = render(held, who)
                    yield {"part": part, "conv_id": conv, "perspective": who, "chunk": number, "n_turns": len(held), "text": text, "mask": ",".join(f"{a}:{b}" for a, b in mask)}
            first = False

    kinds = {"part": pa.int32(), "conv_id": pa.int64(), "perspective": pa.string(), "chunk": pa.int64(), "n_turns": pa.int64(), "text": pa.string(), "mask": pa.string()}

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for part, conv, turns in _conversations(batches):
            for piece in pieces(part, conv, turns):
                out.append(piece)
                size += len(piece["text"])
                if size > 4_000_000:
                    yield batch_of({k: ([p[k] for p in out], t) for k, t in kinds.items()})
                    out, size = [], 0
        yield batch_of({k: ([p[k] for p in out], t) for k, t in kinds.items()})

    return map_batches(rows, per_batch, f"part int, {_OUT}")


def format_chats(turns: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(conv_id, perspective, chunk, n_turns, text, mask): every rendering, in chunks.

    text is the chunk's segments in order; mask lists start:end, comma-joined, of what is trained on, in code
    points of the chunk's text (the end mark's line feed is outside). Order is by turn (null last), then role, then the
    first 64 characters of the text, then a hash of it. Chunks of a rendering are numbered by the characters of text,
    names and marks before them, so they hold the same turns from every perspective; they join to the whole, and a
    turn is never split. Null texts render empty, null roles as user "unknown"; a conversation without speakers has no
    rendering; a null conv_id is a conversation of its own; repeated turns stay; other columns are ignored; an empty
    table gives no rows.
    """
    rows = _ordered(turns)
    borders = _borders(rows)
    inner = _rendered(rows, borders, chunk_chars, False).drop("part")
    if not borders:
        return inner
    pieces = _rendered(rows, borders, chunk_chars, True).groupBy("conv_id", "perspective", "chunk").agg(F.sort_array(F.collect_list(F.struct("part", "n_turns", "text", "mask"))).alias("p"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(3).to_pylist():
                text, mask = "", []
                for p in parts:
                    mask += [f"{len(text) + int(a)}:{len(text) + int(e)}" for a, e in (m.split(":") for m in p["mask"].split(",") if m)]
                    text += p["text"]
                out.append((sum(p["n_turns"] for p in parts), text, ",".join(mask)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([n for n, _, _ in out], pa.int64()), pa.array([t for _, t, _ in out], pa.string()), pa.array([m for _, _, m in out], pa.string())], names=["conv_id", "perspective", "chunk", "n_turns", "text", "mask"])

    return inner.union(map_batches(pieces, joined, _OUT))


#: The same for DuckDB, where one conversation may be one group. Texts that agree in 64 characters and tie are ordered by text.
FORMAT_SQL = f"""
WITH turns AS (SELECT conv_id, turn, role, text, row_number() OVER () AS uid FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role IS NOT NULL AND role <> 'system'),
sized AS (SELECT *, row_number() OVER w AS position, sum(length(coalesce(text, '')) + length(coalesce(role, 'unknown')) + {TURN_CHARS}) OVER w - length(coalesce(text, '')) - length(coalesce(role, 'unknown')) - {TURN_CHARS} AS before FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST, uid ROWS UNBOUNDED PRECEDING)),
wide AS (SELECT t.*, before // {CHUNK_CHARS} AS chunk, p.perspective, coalesce(t.role = p.perspective, false) AS mine,
  CASE WHEN coalesce(t.role = 'system', false) THEN '{OPEN}system' || chr(10) WHEN coalesce(t.role = p.perspective, false) THEN '{OPEN}assistant' || chr(10)
  ELSE '{OPEN}user name=' || regexp_replace(coalesce(t.role, 'unknown'), '[^A-Za-z0-9_-]', '_', 'g') || chr(10) END AS header,
  coalesce(t.text, '') || '<|im_end|>' || chr(10) AS body FROM sized t JOIN speakers p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (SELECT *, sum(length(header) + length(body)) OVER w - length(header) - length(body) AS start FROM wide WINDOW w AS (PARTITION BY conv_id, perspective, chunk ORDER BY position ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(chunk AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n_turns, string_agg(header || body, '' ORDER BY position) AS text,
  coalesce(string_agg(CAST(CAST(start + length(header) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + length(header) + length(body) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY position) FILTER (mine), '') AS mask
FROM placed GROUP BY conv_id, perspective, chunk"""
