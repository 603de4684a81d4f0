import random

from quire.llm import decontam
from quire.llm.templates import Reader

ITEM = "Natalia sold 48 clips to Weng in April, and then she sold 12 clips and 48 pins in May for 5 dollars each."


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijk") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus():
    r = random.Random(8)
    bench = [(k, prose(r, r.randint(15, 60))) for k in range(20)] + [(90, ITEM), (91, None), (92, ""), (93, "one two"), (None, prose(r, 20)), (90, ITEM)]
    docs = [(k, prose(r, 200)) for k in range(30)]
    planted = {}
    for k in range(8):
        docs.append((100 + k, prose(r, 40) + " " + bench[k][1] + " " + prose(r, 40)))
        planted[100 + k] = k
    docs += [(200, "Intro. Maria sold 31 clips to Peter in June, and then she sold 7 clips and 31 pins in July for 2 euros each."), (201, "Maria sold 31 clips to Peter in June, and then"), (202, None), (203, ""), (None, bench[3][1].upper()), (204, bench[5][1] + "###")]
    return docs, bench, planted


def brute(text, item):
    """Verbatim containment of an item's 5-word windows, for texts without slots."""
    clean = lambda t: [w for w in (x.strip(".,###").lower() for x in t.split()) if w]
    d, b = clean(text), clean(item)
    windows = {tuple(d[i : i + 5]) for i in range(len(d) - 4)}
    mine = [tuple(b[i : i + 5]) in windows for i in range(len(b) - 4)]
    return bool(mine) and sum(mine) >= 0.8 * len(mine)


def test_matches_brute_force_and_planted_items(spark):
    docs, bench, planted = corpus()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, source string")
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, doc_id int")
    got = decontam.contaminated(d, b).collect()
    pairs = sorted((str(r.doc_id), str(r.item_id)) for r in got)
    want = [(str(i), str(j)) for i, t in docs for j, x in bench if t and x and j != 90 and brute(t, x)] + [("200", "90")] * 2
    assert pairs == sorted(want)
    assert all(r.reparameterised for r in got if r.doc_id == 200) and not any(r.reparameterised for r in got if r.doc_id in planted)
    small = decontam.contaminated(d, b, block_tokens=30).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    clean = decontam.decontaminate(d, b, block_tokens=100)
    assert clean.columns == d.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in docs if str(i) not in {p for p, _ in pairs})
    assert decontam.contaminated(d.where("false"), b).count() == 0 == decontam.contaminated(d, b.where("false")).count()
    assert decontam.decontaminate(d, b.where("false")).count() == len(docs)


def test_slots_must_map_one_to_one():
    block, reader = decontam.Block([(1, ITEM)]), Reader()
    good = block.matches(reader, "Anna sold 3 clips to Bob in May, and then she sold 9 clips and 3 pins in June for 4 euros each.")
    assert good[0]["n_matched"] == good[0]["n_windows"] and good[0]["reparameterised"]
    broken = block.matches(reader, "Anna sold 3 clips to Bob in May, and then she sold 9 clips and 8 pins in June for 4 euros each.")
    assert not broken or broken[0]["n_matched"] < good[0]["n_matched"]
    assert not block.matches(reader, "and then she sold")


def test_short_items():
    reader = Reader()
    block = decontam.Block([(1, "capital of France"), (2, "add 12 apples"), (3, "..."), (4, "")])
    found = lambda t: sorted(m["item_id"] for m in block.matches(reader, t))
    assert found("What is the capital of France, please?") == [1] and found("Capital of France") == [1]
    assert found("the capital of Spain") == [] and found("add 12 apples and add 13 apples") == [2] and found("add 13 apples") == []


def test_one_changed_word_in_a_short_item():
    r = random.Random(3)
    for n in range(6, 40):
        item = prose(r, n).split()
        block = decontam.Block([(1, " ".join(item))])
        for at in range(n):
            text = prose(r, 30).split() + item[:at] + ["zzzz"] + item[at + 1 :] + prose(r, 30).split()
            windows = sum(not j <= at < j + 5 for j in range(n - 4))
            assert bool(block.matches(Reader(), " ".join(text))) == (windows > 0), (n, at)
    assert not block.matches(Reader(), prose(r, 3000))


def test_join_of_a_large_benchmark_is_the_same(spark):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    common = " ".join(r.choice(words) for _ in range(12))
    item = lambda n: " ".join(r.choice([r.choice(words), str(r.randint(1, 50)), "Maria", "kg"]) for _ in range(n))
    bench = [(k, item(r.choice([2, 4, 6, 10, 26, 27, 40, 90])) + (" " + common if k % 5 == 0 else "")) for k in range(120)]
    docs = []
    for k in range(150):
        text = [item(40)]
        for _ in range(r.randint(0, 3)):
            own = r.choice(bench)[1].split()
            a = r.randrange(len(own))
            kept = own if r.random() < 0.4 else own[a : a + r.randint(5, 20)] if r.random() < 0.5 else [w if r.random() < 0.93 else "zzz" for w in own]
            text += [" ".join(kept), common if r.random() < 0.3 else "", item(r.randint(1, 30))]
        docs.append((k, " ".join(text)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    small, joined = (sorted(map(tuple, decontam.contaminated(d, b, block_tokens=n).collect())) for n in (10**9, 10))
    assert small == joined and len({x[0] for x in small}) > 40 and len({x[1] for x in small}) > 40
    clean = {x.doc_id for x in decontam.decontaminate(d.selectExpr("doc_id", "text", "1 as _ROW", "'x' as row"), b, 10).collect()}
    assert clean == {k for k, _ in docs} - {x[0] for x in small}
    pairs = decontam.candidates(d.selectExpr("doc_id as row", "text"), b.selectExpr("item_id as row", "text")).count()
    assert pairs < 0.5 * len(docs) * len(bench)


def test_a_benchmark_of_many_tokens_in_one_scan(spark):
    """A benchmark of two million tokens is joined, and planted items are found."""
    base = spark.range(40_000).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(1, 50), k -> substr(md5(concat(id, '-', k)), 1, 6))) as text")
    docs = base.where("item_id % 400 = 7").selectExpr("item_id as doc_id", "concat('some words before this ', text, ' and some behind') as text").union(spark.range(200).selectExpr("-id - 1", "concat_ws(' ', transform(sequence(1, 300), k -> substr(md5(concat('d', id, '-', k)), 1, 6)))"))
    got = decontam.contaminated(docs, base, block_tokens=1_000_000).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(7, 40_000, 400)}
