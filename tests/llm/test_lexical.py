import math
import random
import re
from collections import Counter

import duckdb
import pytest

from quire.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=X.BEST):
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n, total = len(held), sum(k for *_, k in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c, k in held:
            m = 50 + 50 * k * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:best])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, "b") for i, t in docs], "doc_id long, text string, tf int, bucket string"), spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, row int")


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def data():
    r = random.Random(8)
    words = ["".join(r.choice("abcé中1") for _ in range(r.randint(1, 3))) for _ in range(60)]
    text = lambda n: "".join(r.choice([w, w.upper(), w.capitalize()]) + r.choice([" ", ", ", "\n", "_", "--"]) for w in (r.choice(words[: r.randint(1, 60)]) for _ in range(n)))
    docs = [(k, text(r.randint(0, 80))) for k in range(150)] + [(None, text(9)), (500, None), (501, ""), (502, "!?"), (503, text(4000))]
    docs += [docs[3], docs[3], (600, docs[5][1]), (601, docs[5][1])]
    items = [(k, text(r.randint(0, 12))) for k in range(12)] + [(3, text(5)), (None, text(6)), (50, None), (51, "none-of-these-words")]
    return docs, items


def test_equals_brute_force(spark, data):
    assert got(X.rank_documents(*frames(spark, *data))) == brute(*data)


def test_shuffled_joins_give_the_same(spark, data, monkeypatch):
    monkeypatch.setattr(X, "MOST_ROWS", 3)
    assert got(X.rank_documents(*frames(spark, *data), 7)) == brute(*data, 7)


def test_whole_index_answers_any_items(spark, data):
    docs, items = frames(spark, *data)
    index = X.stored(X.postings(docs))
    assert got(X.search(items, index)) == brute(*data)
    held = [c for _, t in data[0] if (c := Counter(split(t)))]
    assert index.where("term is null").count() == len(held) and index.where("term is not null").count() == sum(map(len, held))
    for part in index.where("term is not null").selectExpr("spark_partition_id() as p", "bucket", "term", "pmod(xxhash64(term), 256) as b").collect():
        assert part.bucket == part.b


def test_empty_tables(spark, data):
    docs, items = data
    assert got(X.rank_documents(*frames(spark, [], items))) == [] == got(X.rank_documents(*frames(spark, docs, []))) == got(X.rank_documents(*frames(spark, [(1, None)], items)))


def test_ties_go_by_id_and_all_matches_come_if_fewer(spark):
    docs = [(k, "same words here") for k in range(80, 0, -1)] + [(100 + k, f"other text {k}") for k in range(200)]
    found = got(X.rank_documents(*frames(spark, docs, [(1, "words"), (2, "text 7")])))
    assert [(r[1], r[2]) for r in sorted(found) if r[0] == 1] == [(k, k) for k in range(1, 51)]
    assert found == brute(docs, [(1, "words"), (2, "text 7")])


def test_sql_is_the_same(spark, data):
    docs, items = ([x for x in rows if x[0] is not None] for rows in data)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(con.execute(X.RANK_SQL).fetchall(), key=str) == got(X.rank_documents(*frames(spark, docs, items)))
