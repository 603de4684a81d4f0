"""Texts as templates: numbers, names and units become typed placeholders with slot values."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WINDOW = 5
PLAIN, EMPTY, NUMBER, UNIT, CAPITAL, NAME = range(6)
_EDGES = ".,;:!?\"'`()[]{}<>*#%&|$€£~_-+=/\\…“”‘’«»–—"
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|[a-zµ%°]{1,3})?")
# Number words, units of measure and common given names.
NUMBER_WORDS = set("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen twice".split())
UNITS = set(
    "mm cm m km meter meters metre metres inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh watt watts volt volts byte bytes kb mb gb tb hz khz mhz ghz".split()
)
NAMES = set(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel lisa matthew nancy anthony betty mark sandra paul ashley steven emily andrew anna "
    "kevin laura brian emma george olivia edward sophia alice bob carol dave eve frank grace henry jack kate liam maria natalia noah peter ravi tom weng".split()
)
_STOP = re.compile(r"[.!?:][\"'”’»)\]*#$%&|]*$")
_MASK = (1 << 64) - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def kind_of(raw: str) -> tuple[int, str]:
    """(kind, value) of a word; the value is lower-cased and without punctuation at its edges."""
    body = raw.strip(_EDGES)
    value = body.lower()
    if not value:
        return EMPTY, ""
    if value in NUMBER_WORDS or _NUMBER.fullmatch(value):
        return NUMBER, value
    if value in UNITS:
        return UNIT, value
    if value in NAMES and body[0].isupper():
        return NAME, value
    if body[0].isupper() and body[1:].islower() and len(body) > 1:
        return CAPITAL, value
    return PLAIN, value


def code_of(token: str) -> int:
    """A 64-bit code of a canonical token, the same on every machine."""
    return xxhash.xxh64_intdigest(token.encode())


PLACEHOLDERS = {NUMBER: "\x00number", UNIT: "\x00unit", NAME: "\x00name"}


class Reader:
    """Reads texts as templates; remembers words, up to a bound."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self._clear()
        self.codes = {k: np.uint64(code_of(t)) for k, t in PLACEHOLDERS.items()}

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.values: list[str] = []
        self.kind = np.zeros(1 << 16, np.int8)
        self.code = np.zeros(1 << 16, np.uint64)
        self.stop = np.zeros(1 << 16, bool)

    def _id(self, raw: str) -> int:
        k = self.ids.get(raw)
        if k is None:
            kind, value = kind_of(raw)
            k = self.ids[raw] = len(self.values)
            if k == len(self.kind):
                self.kind, self.code, self.stop = (np.concatenate([a, np.zeros_like(a)]) for a in (self.kind, self.code, self.stop))
            self.values.append(value)
            self.kind[k], self.code[k], self.stop[k] = kind, code_of(value), bool(_STOP.search(raw))
        return k

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, slot kinds with 0 for plain, codes) of the canonical tokens.

        A capitalised word is a name unless it begins a sentence, a unit only counts behind a number.
        """
        if len(self.ids) > self.LIMIT:
            self._clear()
        words = text.split()
        ids = np.fromiter(map(self._id, words), np.int64, len(words))
        begins = np.ones(len(ids), bool)
        begins[1:] = self.stop[ids[:-1]]
        full = self.kind[ids] != EMPTY
        ids, begins = ids[full], begins[full]
        kind = self.kind[ids]
        behind = np.zeros(len(ids), bool)
        behind[1:] = kind[:-1] == NUMBER
        slot = np.where(kind == NUMBER, NUMBER, 0)
        slot = np.where((kind == UNIT) & behind, UNIT, slot)
        slot = np.where((kind == NAME) | ((kind == CAPITAL) & ~begins), NAME, slot)
        codes = self.code[ids]
        for k, c in self.codes.items():
            codes = np.where(slot == k, c, codes)
        return ids, slot, codes


def windows(codes: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """A 64-bit hash of every window of so many canonical tokens."""
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = (out ^ (out >> np.uint64(29))) * _FACTOR + codes[j : j + n]
    return out
