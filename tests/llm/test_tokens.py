import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import tokens
from quire.llm.prefix_bpe import PrefixCounter

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "<|startoftext|> hi<|endoftext|>x <|endoftext", "don't they'RE I'll x'd 'S", "ΣΑΣ ΟΔΟΣ", "İstanbul", "é é", "\x1c a\x1db", "😀👍🏽 x", "a\x85b　c\xa0d", "١٢٣ ½ ²", "日本語テスト", "ǅ ﬁ", "﻿x​z", "'''s", "word " * 3000, "x" * 3000]


@pytest.fixture(scope="module")
def pair():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(PATH)
    return PrefixCounter(PATH), lambda t: len(library.encode(t, add_special_tokens=False).ids)


def texts():
    r = random.Random(2)
    return ODD + ["".join(r.choice("aeiou'sStTrelvdmx019!?.,-_ \n\t́éßΣσςİ日😀\x1f\x85　<|>½") for _ in range(r.randrange(1, 30))) for _ in range(800)]


def test_counts_match_the_library(pair):
    mine, library = pair
    assert [(t, mine.count(t)) for t in texts()] == [(t, library(t)) for t in texts()]


def test_every_prefix(pair):
    mine, library = pair
    word = "internationalisation"
    assert mine.piece_counts(word) == [library(word[:k]) for k in range(1, len(word) + 1)]
    text = "Don't cut  here: naïve cafés, they'll cost 12½ <|endoftext|> more."
    ends, counts = mine.boundaries(text)
    assert [mine.prefix_count(text, k, ends, counts) for k in range(len(text) + 1)] == [library(text[:k]) for k in range(len(text) + 1)]
    for budget in range(counts[-1] + 2):
        cut = mine.cut_for(text, budget, ends, counts)
        assert library(text[:cut]) <= budget and (cut == ends[-1] or library(text[: ends[ends.index(cut) + 1 if cut else 0]]) > budget)


def test_longest_prefix_within_a_budget(pair):
    mine, library = pair
    r = random.Random(6)
    made = ["Don't cut  here: naïve cafés, they'll cost 12½ <|endoftext|> more. ", "  internationalisation of antidisestablishmentarianism", "x<|endoftext|>y", "日本語テスト and 😀👍🏽 done", " ", "they'rE'S"]
    made += ["".join(r.choice("aeiou'sStTrelvdmx019!?., \nßé日😀") for _ in range(r.randrange(1, 40))) for _ in range(60)]
    for text in made:
        total = library(text)
        counts = [library(text[:k]) for k in range(len(text) + 1)]
        for budget in {0, 1, 2, 3, total // 2, max(0, total - 1), total, total + 1}:
            got = mine.measure(text, budget)
            want = len(text) if total <= budget else max((k for k in range(len(text)) if counts[k] <= budget and not text[k - 1 : k].isspace() and not inside_special(text, k)), default=0)
            assert got == (total, want), (text, budget)


def test_the_table_of_every_prefix(spark, pair):
    mine, library = pair
    r = random.Random(11)
    made = ["", None, "Don't cut  here: naïve cafés, they'll cost 12½ <|endoftext|> more. ", "a!<|endoftext|><|endoftext|>b", "e\u0301te\u0301 İs", "日本語テスト 😀👍🏽 ", "they'rE'S 've", "x" * 120]
    made += ["".join(r.choice("aeiou'sStTrelvdmx019!?., \nßé日😀<|>") for _ in range(r.randrange(1, 40))) for _ in range(80)]
    for text in made:
        assert mine.every_prefix(text) == [library((text or "")[:k]) for k in range(len(text or "") + 1)], text
    table = tokens.every_prefix(spark.createDataFrame([(1, made[2]), (2, None)], "doc_id long, text string"), PATH)
    counts = mine.every_prefix(made[2])
    for budget in (0, 3, 9, 100):
        best = max(k for k, n in enumerate(counts) if n <= budget)
        assert {tuple(x) for x in tokens.longest_within(table, budget).collect()} == {(1, best, counts[best]), (2, 0, 0)}


def inside_special(text, k):
    return any(a < k < a + len(s) for s in ("<|startoftext|>", "<|endoftext|>") for a in range(len(text)) if text.startswith(s, a))


def test_prefix_states_are_shared_and_bounded(pair, monkeypatch):
    from quire.llm import prefix_bpe

    mine, library = PrefixCounter(PATH), pair[1]
    monkeypatch.setattr(prefix_bpe, "CACHE_WORDS", 50)
    r = random.Random(9)
    for _ in range(300):
        text = " ".join("".join(r.choice(["er", "en", "th", "in", "xq", "é"]) for _ in range(r.randrange(1, 30))) for _ in range(5))
        assert mine.count(text) == library(text)
    assert len(mine.states) <= 50 + prefix_bpe.SHORT and len(mine.words) <= 60


def test_operator(spark, pair):
    _, library = pair
    rows = [(k, t, "x", 5) for k, t in enumerate(ODD)] + [(None, "a b", "x", 5), (1, None, None, None), (1, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    got = sorted(tokens.token_counts(df, PATH, limit=2048).collect(), key=str)
    want = sorted([(i, len((t or "").encode()), library(t or ""), library(t or "") > 2048) for i, t, _, _ in rows], key=str)
    assert sorted([tuple(r)[:4] for r in got], key=str) == want
    assert {r.limit_chars for r in got if r.doc_id == ODD.index("word " * 3000)} == {2048 * 5 - 1}
    assert tokens.token_counts(df.where("false"), PATH).count() == 0
    held = tokens.prefix_table(df, PATH)
    cuts = {(r.doc_id, r.chars, r.n_tokens) for r in tokens.longest_prefix(held.where(f"doc_id = {ODD.index('word ' * 3000)}"), 7).collect()}
    assert cuts == {(ODD.index("word " * 3000), 7 * 5 - 1, 7)}


#: Runs of code points whose normal forms join: Thai, Hangul as letters, marks in odd order, and composites that decompose.
SCRIPTS = ["กขคงจฉำแเ\u0e31\u0e34\u0e48\u0e33", "\u1100\u1103\u1112\u1161\u1175\u11a8\u11c2가힣", "aeoNs'!'\u0301\u0327\u0308\u0345ß", "\u09c7\u09be\u0bc6\u0bbe\u0344\u0958\u212b\u2126İΣ1½", "日本語か\u3099は\u309a。、\u0f71\u0f72"]


def test_words_outside_normal_form_against_the_library(pair):
    mine, library = pair
    r = random.Random(21)
    for script in SCRIPTS:
        for n in (1, 2, 3, 5, 9, 14, 40):
            for _ in range(12):
                text = "".join(r.choice(script) for _ in range(n))
                if r.random() < 0.3:
                    text = "they'" + text + r.choice([" x", "", "re", "<|endoftext|>"])
                assert mine.every_prefix(text) == [library(text[:k]) for k in range(len(text) + 1)], ascii(text)
                total = library(text)
                counts = mine.every_prefix(text)
                for budget in {1, total // 2, max(0, total - 1)}:
                    want = len(text) if total <= budget else max((k for k in range(len(text)) if counts[k] <= budget and not text[k - 1 : k].isspace() and not inside_special(text, k)), default=0)
                    assert mine.measure(text, budget) == (total, want), ascii(text)


def test_long_words_outside_normal_form_take_time_in_proportion(pair):
    import time

    mine, library = pair
    r = random.Random(22)
    took = {}
    for n in (20_000, 100_000):
        text = "".join(r.choice("กขคงจฉชซ") for _ in range(n)) + "e\u0301" + "日本語" * 10
        began = time.time()
        counts = mine.every_prefix(text)
        took[n] = time.time() - began
        assert len(counts) == len(text) + 1 and counts[-1] == library(text) == mine.count(text)
        for k in r.sample(range(len(text)), 5):
            assert counts[k] == library(text[:k])
        total, cut = mine.measure(text, 2048)
        assert total == counts[-1] and cut == max(k for k in range(len(text)) if counts[k] <= 2048)
    assert took[100_000] < 8 * took[20_000] + 1
    for odd in ("!!!!!!'s\u0301t", "......'re\u0301", "abcdefg's\u0301", "abcdefg'\u0301s", "!!!!!!\u0301a\u0301", "abcdef\u0301\u0327x"):
        assert mine.every_prefix(odd) == [library(odd[:k]) for k in range(len(odd) + 1)], ascii(odd)
    decomposed = "e\u0301o\u0308" * 5_000
    assert mine.every_prefix(decomposed)[-1] == library(decomposed)
