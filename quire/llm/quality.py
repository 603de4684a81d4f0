"""Quality rules: simple counts, then divergence of a text from its language.

Pass one counts, for every whole text, the base rules and two histograms:
character classes, and the common words of each reference language. The
references are the means of the normalised histograms over all rows of a language
that pass the base rules, so that no long text outweighs others, taken once more
over those near the first means, so that junk moves them little. Pass two
takes, for each text, the Jensen-Shannon distance of either histogram to every
reference; the nearest language decides. A histogram of too short a text is noise,
so each has a least length, below which it is not judged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import cut, fresh, map_batches, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Guards: fewer letters, or fewer words, than these and the histogram is not judged.
MIN_CHARS, MIN_COMMON_WORDS = 200, 80
#: Jensen-Shannon distances (base 2, square root) from the nearest language. A text is rejected beyond
#: FAR_CLASS, or if both histograms are somewhat off; rows beyond TRIM do not count in the second means.
FAR_CLASS, OFF_CLASS, OFF_WORD, TRIM = 0.35, 0.10, 0.25, 0.15

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# Frequent function words of the reference languages, in the usual order of frequency.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "by", "he", "this", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
}
CLASSES = ["vowel", "consonant", "accented", "upper", "digit", "blank", "stop", "mark", "symbol", "other"]
_TABLE_SIZE = 0x3000


def class_table() -> np.ndarray:
    """Class number of each code point below 0x3000; those above count as other."""
    out = np.full(_TABLE_SIZE, CLASSES.index("other"), np.uint8)
    for cp in range(_TABLE_SIZE):
        c = chr(cp)
        if c in BLANKS:
            kind = "blank"
        elif c in "aeiou":
            kind = "vowel"
        elif c.isdigit():
            kind = "digit"
        elif c.isalpha() and c.isupper():
            kind = "upper"
        elif c.isalpha():
            kind = "consonant" if cp < 128 else "accented"
        elif c in ".,":
            kind = "stop"
        elif c in SYMBOLS:
            kind = "symbol"
        elif cp < 128:
            kind = "mark"
        else:
            continue
        out[cp] = CLASSES.index(kind)
    return out


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of 8 words that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(roll, kind="stable")
    same = roll[order[1:]] == roll[order[:-1]]
    if not same.any():  # equal windows hash alike, so there are none
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    keys = [tuple(words[i : i + WINDOW]) for i in at]
    seen = Counter(keys)
    ends = np.zeros(len(words) + 1, np.int32)
    hit = np.array([i for i, k in zip(at, keys) if seen[k] > 1], np.int64)
    np.add.at(ends, hit, 1)
    np.add.at(ends, hit + WINDOW, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


class Profiler:
    """Counts of texts: the base rules, the character classes and the common words."""

    def __init__(self) -> None:
        self.table = class_table()
        common = sorted({w for ws in COMMON_WORDS.values() for w in ws})
        self.at = {w.encode(): k for k, w in enumerate(common)}
        self.other = len(common)

    def of(self, text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
        text = text or ""
        words = text.encode().split()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = np.bincount(self.table[np.minimum(points, _TABLE_SIZE - 1)], minlength=len(CLASSES))
        hist = np.zeros(self.other + 1, np.int64)
        for w, n in Counter(words).items():
            hist[self.at.get(w.rstrip(b".,"), self.other)] += n
        return base_counts(text, words), classes, hist


def _profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, the five base counts, classes array<long>, words array<long>), one row for each row of docs."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler()
        for b in batches:
            base, classes, hists = zip(*map(profiler.of, b.column(2).to_pylist())) if b.num_rows else ([], [], [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([x[k] for x in base], pa.int64()) for k in range(5)), pa.array([c.tolist() for c in classes], longs), pa.array([h.tolist() for h in hists], longs)],
                names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "words"],
            )

    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")),
        per_batch,
        "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, words array<long>",
    )


def references(profiles: DataFrame) -> dict[str, np.ndarray]:
    """For classes and words: one mean histogram for each reference language, over all its rows that pass the base rules."""
    passed = (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    known = profiles.where(F.col("lang").isin(list(COMMON_WORDS)) & passed)

    def shares(what: str) -> Column:
        # Shares in whole millionths: the sums do not depend on the order of rows, so reruns agree.
        size = F.aggregate(what, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.transform(F.col(what), lambda x, k: F.struct(F.lit(what).alias("what"), k.alias("pos"), F.round(x * 1e6 / size).cast("long").alias("n")))

    rows = known.select("lang", F.explode(F.concat(shares("classes"), shares("words"))).alias("s"))
    sums = rows.groupBy("lang", "s.what", "s.pos").agg(F.sum("s.n").alias("n")).collect()  # languages x bins
    langs, out = sorted({r.lang for r in sums}), {}
    for what in ("classes", "words"):
        mine = [r for r in sums if r.what == what]
        total = np.zeros((len(langs), max((r.pos for r in mine), default=-1) + 1))
        for r in mine:
            total[langs.index(r.lang), r.pos] = r.n
        out[what] = total / np.maximum(total.sum(axis=1, keepdims=True), 1)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root, base 2) of each row of p to each row of q: (rows of p, rows of q)."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(d / 2, 0))


def nearest(hists: np.ndarray, refs: np.ndarray, least: int) -> np.ndarray:
    """Distance of each histogram to the nearest reference; nan where there is too little to judge."""
    if not len(hists) or not len(refs):
        return np.full(len(hists), np.nan)
    size = hists.sum(axis=1)
    return np.where(size >= least, js_distance(hists / np.maximum(size, 1)[:, None], refs).min(axis=1), np.nan)


HISTOGRAMS = {"class_distance": ("classes", MIN_CHARS), "word_distance": ("words", MIN_COMMON_WORDS)}


def distances(profiles: DataFrame, refs: dict[str, np.ndarray], names: tuple[str, ...] = tuple(HISTOGRAMS)) -> DataFrame:
    """profiles with class_distance and word_distance to the nearest reference; null where there is too little to judge."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [nearest(np.array(b.column(w).to_pylist(), float), refs[w], least) for w, least in (HISTOGRAMS[n] for n in names)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.float64(), from_pandas=True) for x in judged)], names=[*b.schema.names, *names])

    return map_batches(profiles, per_batch, ", ".join(f"{n} {t}" for n, t in [*profiles.dtypes, *((n, "double") for n in names)]))


def learned_references(profiles: DataFrame) -> dict[str, np.ndarray]:
    """The means over all rows, then over those near the first means."""
    first = references(profiles)
    second = references(distances(profiles, first, ("class_distance",)).where(F.col("class_distance") <= TRIM))
    return second if len(second["classes"]) else first


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, class_distance, word_distance) for every row of docs (doc_id, text, lang, ...).

    A distance is null where the text is too short to judge, or no row of the table has a reference
    language; null distances never reject. Null and empty texts have no words and fail the base rules.
    Null or unknown languages are judged by the nearest reference like all others. Repeated rows stay
    (they also count repeatedly in the references), a null doc_id stays null, other columns are ignored,
    an empty table gives no rows.
    """
    profiles = cut(_profiles(docs))
    judged = distances(profiles, learned_references(profiles))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    off = (F.col("class_distance") > FAR_CLASS) | ((F.col("class_distance") > OFF_CLASS) & (F.col("word_distance") > OFF_WORD))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.coalesce(off, F.lit(False))).alias("kept"), "class_distance", "word_distance"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality keeps, with all their columns.

    Every text is profiled once: rows are written with their profiles, the references are learned from these, and the
    rows that pass are read back, so no text is shuffled.
    """
    own, at, names = list(docs.columns), docs.columns.index("text"), fresh(docs, "q_words", "q_repeat", "q_classes", "q_hist")
    n_words, n_repeat, classes, hist = names

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, longs = Profiler(), pa.list_(pa.int64())
        for b in batches:
            found = [profiler.of(t) for t in b.column(at).to_pylist()]
            added = [pa.array([f[0][0] for f in found], pa.int64()), pa.array([f[0][4] for f in found], pa.int64()), pa.array([f[1].tolist() for f in found], longs), pa.array([f[2].tolist() for f in found], longs)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, n_words, n_repeat, classes, hist])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_repeat, T.LongType()), T.StructField(classes, longs), T.StructField(hist, longs)])
    rows = written(map_batches(docs, profile, schema))
    of_lang = F.col("lang").cast("string") if "lang" in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    refs = learned_references(rows.select(of_lang.alias("lang"), F.col(n_words).alias("n_words"), F.col(n_repeat).alias("n_repeat_words"), F.col(classes).alias("classes"), F.col(hist).alias("words")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, repeat = (b.column(n).to_numpy(zero_copy_only=False) for n in (n_words, n_repeat))
            by_class, by_word = (nearest(np.array(b.column(n).to_pylist(), float), refs[w], least) for n, w, least in ((classes, "classes", MIN_CHARS), (hist, "words", MIN_COMMON_WORDS)))
            failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
            off = (by_class > FAR_CLASS) | ((by_class > OFF_CLASS) & (by_word > OFF_WORD))
            yield b.filter(pa.array(~failed & ~off)).select(own)

    return map_batches(rows, judge, docs.schema)
