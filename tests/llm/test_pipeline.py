"""Each stage of the pipeline on nulls, empty tables, repeats, clashing names and a long text."""

from collections import Counter

import pytest

import corpus_pipeline as P
from booktide.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, _copy int, _times int, n_lines int, n_kept int, _doc int, row int"
LONG = " ".join(f"w{k}" for k in range(150_000))  # about 1 MB


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "one text of some words that is clean"), (1, "one text of some words that is clean"), (None, "another text without an id at all"), (2, None), (3, ""), (4, LONG), (5, "a line\n\na line\nsome other line that is longer")]
    return spark.createDataFrame([(i, t, "en", None if i == 2 else "s", 1, 77, 78, 79, 80, 81, 82, 83) for i, t in texts], SCHEMA).cache()


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_empty(spark, docs, folder, name, stage):
    out = stage(spark, docs.limit(0), folder)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_columns_stay(spark, docs, folder, name, stage):
    rows = stage(spark, docs, folder).collect()
    own = Counter(r.doc_id for r in rows)
    assert rows and all(tuple(r)[5:] == (77, 78, 79, 80, 81, 82, 83) for r in rows)
    want = {
        "toxicity": lambda: sum(own.values()) <= 7, "line_dedup": lambda: sum(own.values()) == 7,
        "ngram_join": lambda: own == Counter([1, None, 2, 3, 4, 5]), "mixing": lambda: not {2, 3} & set(own) and None in own or 4 in own,
    }
    assert want[name]()


def test_packing(spark, docs, folder):
    rows = P.pack_sequences(spark, docs, folder).collect()
    by = Counter(r.doc_id for r in rows)
    assert by[1] == 2 and by[2] == by[3] == by[None] == 1 and by[4] > 100 and max(r.offset + r.length for r in rows) <= 2048


def test_counts_beside_columns_of_their_name(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_kept_"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_lines_, r.n_kept_) for r in out.where("doc_id in (2, 5)").collect()}
    assert got == {2: (None, 80, 0, 0), 5: ("a line\n\nsome other line that is longer", 80, 4, 3)}
