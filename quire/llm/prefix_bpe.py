"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The vocabulary is a byte-level BPE with word ends: text is NFC-normalised, white
space collapsed, lower-cased and cut into pre-tokens; merges never cross a
pre-token. For a pre-token let L[k] be the last token of the encoding of its
first k symbols, and E[k] the same with the word end put on symbol k. A sequence
of tokens is the encoding of its concatenation exactly if every neighbouring pair
is, so L[k] and E[k] are the only vocabulary entries that end at k and agree with
L at their own start; counts follow by one addition. The last token and the count of
every prefix met are kept, so words that begin alike share their work and a prefix is
never encoded again: the counts of pre-tokens add up to those of every prefix of the text,
and a word's table of prefix counts settles what falls inside a word.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import accumulate, islice

import regex

#: Words, pre-tokens or prefixes kept by a worker; beyond it a cache starts anew, which only costs time.
CACHE_WORDS = 500_000
#: Longer pre-tokens are worked out in arrays of their own and not kept.
SHORT = 48
#: Characters of a pre-token up to which it is cut anew when something is put behind it.
_NEAR = 4
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_WORDS = re.compile(_SPACE.pattern.replace("[", "[^", 1))
_LETTER = regex.compile(r"\p{L}")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def joining() -> frozenset[str]:
    """Code points that may change what stands before them under normal form C: marks, and those that are the second half of a composition."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of Hangul compose by rule
    for c in map(chr, range(0x110000)):
        if unicodedata.combining(c):
            out.add(c)
        else:
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                out.add(chr(int(parts[1], 16)))
            elif parts and not parts[0].startswith("<") and unicodedata.combining(unicodedata.normalize("NFD", c)[0]):
                out.add(c)
    return frozenset(out)


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PrefixCounter:
    """Counts of the tokenizer in a ``tokenizers`` JSON file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = set(model["vocab"])
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.symbols = {b: c for b, c in enumerate(_byte_symbols())}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        #: For each token that its own symbols merge into: the rank of its last merge (-1: a symbol) and that merge's halves.
        self.made: dict[str, int] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for t in self.vocab:
            if len(t.removesuffix(self.end)) == 1:
                self.made[t] = -1
        for pair, rank in self.ranks.items():  # in the order of the merges: the first that makes a token is the one that does
            if pair[0] in self.made and pair[1] in self.made and pair[0] + pair[1] not in self.made:
                self.made[pair[0] + pair[1]], self.halves[pair[0] + pair[1]] = rank, pair
        self.joining: frozenset[str] | None = None  # found when the first word needs it
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple[str, int]] = {}
        self.totals: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def agree(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is just these two tokens.

        Undo the merges next to the boundary from the latest to the earliest; the pair stands
        unless some pair of symbols that met there would have merged before the merge undone.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, limit, stands = left, right, 1 << 40, True
        made, halves, ranks = self.made, self.halves, self.ranks
        while True:
            if ranks.get((a, b), 1 << 40) < limit:
                stands = False
                break
            ra, rb = made[a], made[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                a, limit = halves[a][1], ra
            else:
                b, limit = halves[b][0], rb + 1
        if len(self.pairs) >= CACHE_WORDS:
            self.pairs.clear()
        self.pairs[left, right] = stands
        return stands

    def _last(self, s: str, k: int, suffix: str, last: list[str], counts: list[int]) -> tuple[str, int]:
        made = self.made
        for j in range(max(0, k - self.longest), k):
            token = s[j:k] + suffix
            if token in made and (not last[j] or self.agree(last[j], token)):
                return token, counts[j] + 1
        raise ValueError(f"no token ends at {k} of {s!r}")

    def symbols_of(self, piece: str) -> str:
        """One symbol for each byte of a pre-token; ASCII letters and digits stand for themselves."""
        return piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.symbols)

    def _states(self, piece: str) -> tuple[str, list[int], list[str], list[int]]:
        """(symbols, tokens of the first k of them as a word of their own, last token and count of the first k) of a pre-token."""
        s = self.symbols_of(piece)
        last, counts, out = [""], [0], []
        for k in range(1, len(s) + 1):
            out.append(self._last(s, k, self.end, last, counts)[1])
            t, c = self._last(s, k, "", last, counts)
            last.append(t)
            counts.append(c)
        return s, out, last, counts

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of the first k symbols (bytes) of a pre-token, as a word of their own, for k = 1 .. its length."""
        return self._states(piece)[1]

    def _kept(self, s: str) -> int:
        """Tokens of a short pre-token; the states of its prefixes are looked up, or worked out and kept."""
        states, made, longest, n = self.states, self.made, self.longest, len(s)
        if len(states) >= CACHE_WORDS:
            states.clear()
        known = n - 1
        while known and s[:known] not in states:
            known -= 1
        for k in range(known + 1, n + 1):
            suffix = self.end if k == n else ""
            for j in range(max(0, k - longest), k):
                token = s[j:k] + suffix if suffix else s[j:k]
                if token in made:
                    if not j:
                        count = 1
                        break
                    last, before = states[s[:j]]
                    if self.agree(last, token):
                        count = before + 1
                        break
            else:
                raise ValueError(f"no token ends at {k} of {s!r}")
            if suffix:
                return count
            states[s[:k]] = token, count
        raise ValueError("an empty pre-token")

    def piece_total(self, piece: str) -> int:
        """The last of piece_counts."""
        total = self.totals.get(piece)
        if total is None:
            s = self.symbols_of(piece)
            if len(s) > SHORT:
                return self._long(s)
            if len(self.totals) >= CACHE_WORDS:
                self.totals.clear()
            total = self.totals[piece] = self._kept(s)
        return total

    def _long(self, s: str) -> int:
        last, counts = [""], [0]
        for k in range(1, len(s)):
            t, c = self._last(s, k, "", last, counts)
            last.append(t)
            counts.append(c)
        return self._last(s, len(s), self.end, last, counts)[1]

    def word_total(self, word: str) -> int:
        total = self.words.get(word)
        if total is None:
            total = self.piece_total(word) if word.isascii() and word.isalpha() else sum(map(self.piece_total, self.pieces.findall(word)))
        return total

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of the first k characters of a word, for k = 0 .. its length."""
        normal = self.normalise(word)
        table, starts, states = self._table(normal)
        if word.isascii() or (len(normal) == len(word) and unicodedata.is_normalized("NFC", word)):
            return table
        # The word in segments whose normal forms stand one after another; inside one, what comes before it stays.
        if self.joining is None:
            self.joining = joining()
        begins = [0, *(k for k in range(1, len(word)) if word[k] not in self.joining), len(word)]
        out, at, piece = [0], 0, 0
        for start, end in zip(begins, begins[1:]):
            for k in range(start + 1, end):
                out.append(self._with_tail(normal, at, self.normalise(word[start:k]), table, starts[piece], states[piece]))
            at += len(self.normalise(word[start:end]))
            out.append(table[at])
            while piece + 1 < len(starts) and starts[piece + 1] < at:
                piece += 1
        return out

    def _table(self, normal: str) -> tuple[list[int], list[int], list[tuple]]:
        """(tokens of the first k characters of a normalised word, where its pre-tokens start, their states)."""
        out, done, starts, states = [0], 0, [], []
        for piece in self.pieces.findall(normal):
            starts.append(len(out) - 1)
            if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():  # a part of such an ending is cut in another way
                counts = [sum(map(self.piece_total, self.pieces.findall(piece[:k]))) for k in range(1, len(piece) + 1)]
                states.append(())
            else:
                held, at = self._states(piece), 0
                states.append(held)
                counts = []
                for c in piece:
                    at += len(c.encode())
                    counts.append(held[1][at - 1])
            out += [done + c for c in counts]
            done += counts[-1]
        return out, starts, states

    def _with_tail(self, normal: str, at: int, tail: str, table: list[int], start: int, states: tuple) -> int:
        """Tokens of normal[:at] + tail, if the pre-token that ends at ``at`` or holds it starts at ``start``; the work is that of the tail."""
        if not at:
            return sum(map(self.piece_total, self.pieces.findall(tail)))
        if not states or at - start <= _NEAR:  # such as an apostrophe that may become an ending
            return table[start] + sum(map(self.piece_total, self.pieces.findall(normal[start:at] + tail)))
        # pre-tokens of more characters are runs of letters or of marks, and go on with their like
        run = self.pieces.findall(("a" if _LETTER.match(normal, at - 1) else "!") + tail)  # an apostrophe would look like an ending
        more = run[0][1:]
        if not more:
            return table[at] + sum(map(self.piece_total, self.pieces.findall(tail)))
        s, _, last, counts = states
        b = len(normal[start:at].encode())
        low = max(0, b - self.longest)
        own, last, counts = s[low:b] + self.symbols_of(more), last[low : b + 1], counts[low : b + 1]
        for k in range(b - low + 1, len(own)):
            t, c = self._last(own, k, "", last, counts)
            last.append(t)
            counts.append(c)
        return table[start] + self._last(own, len(own), self.end, last, counts)[1] + sum(map(self.piece_total, run[1:]))

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # lower-casing looks at one code point only

    def split_words(self, text: str) -> list[str]:
        """The words of a normalised text, between white space as the tokenizer sees it."""
        if _SEPARATORS.search(text):  # str.split() takes these for white space
            return [w for w in _SPACE.split(text) if w]
        return text.split()

    def word_totals(self, words: list[str]) -> list[int]:
        """The totals of words, each worked out once; short ones are kept for other texts."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        new = set(words).difference(self.words)
        self.words.update({w: self.word_total(w) for w in new})
        out = list(map(self.words.__getitem__, words))
        for w in new:
            if len(w) > SHORT:
                del self.words[w]
        return out

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; special strings are their own tokens."""
        return self.measure(text, None)[0]

    def measure(self, text: str | None, budget: int | None) -> tuple[int, int]:
        """(tokens, length in code points of the longest prefix within the budget) from one pass over the words.

        The prefix does not end in white space; if it is not the whole text, the word at which the budget runs out is
        looked up in its table of prefix counts.
        """
        if not text:
            return 0, 0
        total, at, cut = 0, 0, None
        for k, part in enumerate(self.split_special.split(text) if "<|" in text else [text]):
            if k % 2:
                if cut is None and budget is not None and total + 1 > budget:
                    cut = len(text[:at].rstrip())
                total += 1
            else:
                counts = self.word_totals(self.split_words(self.normalise(part)))
                before, total = total, total + sum(counts)
                if cut is None and budget is not None and total > budget:
                    sums = accumulate(counts, initial=before)
                    full = next(n for n, x in enumerate(sums) if x > budget) - 1
                    cut = at + self._cut_in(part, full, budget - before - sum(counts[:full]))
                    if cut == at:
                        cut = len(text[:at].rstrip())
            at += len(part)
        return total, len(text) if cut is None else cut

    def _cut_in(self, part: str, full: int, left: int) -> int:
        """Where a part is cut of which this many words fit, and of the next so much that it has at most so many tokens."""
        spans = [m.span() for m in islice(_WORDS.finditer(part), full + 1)]
        start, end = spans[full]
        table = self.word_prefixes(part[start:end])
        inside = max((n for n, c in enumerate(table) if c <= left), default=0)
        return start + inside if inside else spans[full - 1][1] if full else 0

    def every_prefix(self, text: str | None) -> list[int]:
        """Tokens of the first k code points of a text, for k = 0 .. its length: table lookups, nothing is encoded again.

        Only the insides of special strings are counted one by one.
        """
        text = text or ""
        out, at = [0], 0
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:  # until it is whole, a special string is text behind the word that it touches
                word = max((m.end() for m in _SPACE.finditer(text, 0, at)), default=0)
                out += [out[word] + self.count(text[word:end]) for end in range(at + 1, at + len(part))]
                out.append(out[at] + 1)
            else:
                done, last = out[at], 0
                for m in _WORDS.finditer(part):
                    out += [done] * (m.start() - last)
                    table = self.word_prefixes(m.group())
                    out += [done + n for n in table[1:]]
                    done, last = out[-1], m.end()
                out += [done] * (len(part) - last)
            at += len(part)
        return out

    def boundaries(self, text: str | None) -> tuple[list[int], list[int]]:
        """(ends, counts): for each word of the text its end as an offset in code points, and the tokens up to there.

        Count at a word end is the count of that prefix; both lists grow with the text, so a budget or an
        offset is answered by bisection, and one word's piece_counts settle what falls inside a word.
        """
        ends, counts, at, total = [], [], 0, 0
        for k, part in enumerate(self.split_special.split(text or "")):
            if k % 2:
                total += 1
                ends.append(at + len(part))
                counts.append(total)
            else:
                for m in re.finditer(r"[^\t-\r \x85\xa0  -     　]+", part):
                    total += sum(self.word_total(w) for w in self.split_words(self.normalise(m.group())))
                    ends.append(at + m.end())
                    counts.append(total)
            at += len(part)
        return ends, counts

    def prefix_count(self, text: str, length: int, ends: list[int], counts: list[int]) -> int:
        """Tokens of text[:length], from stored boundaries: one partial word is counted, the rest looked up."""
        from bisect import bisect_right

        k = bisect_right(ends, length)
        done = counts[k - 1] if k else 0
        return done + self.count(text[ends[k - 1] if k else 0 : length])

    def cut_for(self, text: str, budget: int, ends: list[int], counts: list[int]) -> int:
        """A longest prefix within the budget that ends at a word end: its length in code points."""
        from bisect import bisect_right

        k = bisect_right(counts, budget)
        return ends[k - 1] if k else 0
