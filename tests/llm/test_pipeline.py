import random

import pytest

import corpus_pipeline
from quire.llm import decontam, pii, quality, simhash

WORDS = "the of and to in is that for it was on are as with be by this from house river green small people water light found".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))
    bench = [(1, prose(30))]
    docs = [(k, prose(r.randint(60, 200))) for k in range(40)]
    docs += [(100, docs[0][1]), (101, docs[1][1]), (102, prose(40) + " " + bench[0][1] + " " + prose(40)), (103, prose(50) + " mail me@host.org now"), (104, "too short"), (105, None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        docs = spark.createDataFrame(made.collect(), made.schema)
        at[name] = {r.doc_id: r for r in docs.collect()}
        if name != "source mixing":
            assert docs.columns == columns
    assert {104, 105} & at["quality rules"].keys() == set() and len(at["quality rules"]) == 44
    assert {100, 101} & at["near duplicates"].keys() == set() and {0, 1, 102, 103} <= at["near duplicates"].keys()
    assert 102 not in at["decontamination"] and len(at["decontamination"]) == len(at["near duplicates"]) - 1
    assert at["personal data"][103].text.endswith("mail [EMAIL] now") and at["personal data"][103].n_chars == len(at["personal data"][103].text)
    assert at["source mixing"].keys() == at["personal data"].keys()
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, at["source mixing"].values()))


def test_stages_use_the_operators():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5
    assert corpus_pipeline.keep_good is quality.keep_good and corpus_pipeline.keep_one is simhash.keep_one
    assert corpus_pipeline.decontaminate is decontam.decontaminate and corpus_pipeline.redact is pii.redact


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, d, docs, bench, columns=COLUMNS):
    spark.createDataFrame(docs, columns).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_empty_tables(spark, tmp_path):
    made = corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], [(1, "a b c d e f")]))
    assert made.collect() == [] and {"doc_id", "size", "source_size", "target", "taken"} <= set(made.columns)
    r = random.Random(5)
    docs = [(k, " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(80)), "en", "a", 1) for k in range(5)]
    made = corpus_pipeline.run(spark, written(spark, tmp_path / "some", docs, []))
    assert sorted(x.doc_id for x in made.collect()) == list(range(5))


def test_nulls_repeated_ids_and_clashing_columns(spark, tmp_path):
    r = random.Random(6)
    prose = lambda: " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(90))
    texts = [prose() for _ in range(7)]
    docs = [(None, texts[0], "en", "a", 1), (None, texts[1], None, None, None), (3, texts[2], "en", None, 1), (3, texts[3], "en", "a", 1), (4, texts[4], "en", "a", 1), (4, texts[4], "en", "a", 1), (None, texts[4], "en", "b", 1), (6, None, "en", "b", 0), (7, "", "en", "b", 0), (8, texts[5], "en", "b", 1), (9, texts[6] + " 4111 1111 1111 1111", "en", "b", 1)]
    wide = [(*d, 7, "x", 0.5) for d in docs]
    folder = written(spark, tmp_path / "odd", wide, [(None, texts[5]), (2, None)], COLUMNS + ", `_fp` int, pii_spans string, size double")
    frame, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        columns = columns or frame.columns
        assert frame.columns == columns, name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
    kept = sorted(((x.doc_id, x.source, x.size) for x in frame.collect()), key=str)
    # two texts without an id, two texts under one id, one of the copies, none of the benchmark's or without words
    assert kept == sorted([(None, "a", 0.5), (None, None, 0.5), (3, None, 0.5), (3, "a", 0.5), (4, "a", 0.5), (9, "b", 0.5)], key=str)
    assert frame.where("doc_id = 9").first().text.endswith(" [CARD]")
    mixed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(x.doc_id), x.size) for x in mixed) == sorted((str(i), 91 if i == 9 else 90) for i, _, _ in kept)
